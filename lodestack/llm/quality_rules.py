"""Quality rules with risk-controlled thresholds.

Each rule rejects a document whose statistic lies above a cutoff. Cutoffs come from labelled holdouts: for each
stratum and rule, among fixed candidate cutoffs, the tightest one whose false rejections (documents labelled good
that it would reject) have an exact binomial upper confidence bound of at most its share of `risk`, of which each rule
has as much. The confidence is shared out over all rules, strata and candidates (Bonferroni), so with probability
1 - `delta` all rules together reject at most `risk` of the good documents of each stratum. A stratum with too few
labels gets no cutoff: nothing is rejected.

Nulls and empty texts have no words; they fail the base rule. Very long texts are counted whole. Rows with equal ids
are judged each on its own text; a label counts for all rows of its id. Other columns, whatever their names, are kept
as they are by filter_documents. Empty tables give no rows, and without labels only the base rule rejects.
"""

from __future__ import annotations

import math
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestack.llm.common import staged, trimmed

#: Fixed values of the base rules.
SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\x0b\x0c\r"
MIN_WORDS, MAX_REPEATED_PERCENT, WINDOW = 10, 20, 5

#: Highest share of a stratum's good documents that all rules together may reject, and the chance that any stratum exceeds it.
RISK, DELTA = 0.02, 0.05
#: Words at which a stratum ends; the last has no end.
STRATA = (50, 150, 400, 1000)
#: Rules: statistic and candidate cutoffs, from the tightest.
RULES: dict[str, tuple[float, ...]] = {
    "symbol_ratio": (0.02, 0.05, 0.1, 0.2, 0.3, 0.5, 0.8, 1.0),
    "exclaim_ratio": (0.02, 0.05, 0.1, 0.2, 0.3, 0.5, 0.8, 1.0),
    "upper_share": (0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.7, 0.9),
    "same_as_before_share": (0.02, 0.05, 0.1, 0.2, 0.3, 0.5, 0.7),
    "dup_line_share": (0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.7),
    "repeat_share": (0.02, 0.05, 0.1, 0.15, 0.2),
    "mean_word_chars": (8.0, 10.0, 12.0, 15.0, 20.0, 40.0),
}

_COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_exclaims", "n_upper", "n_same_as_before")


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words in windows that occur twice or more, the first occurrence included."""
    n = len(words)
    if n <= window:
        return 0
    windows = list(zip(*(words[i : n - window + 1 + i] for i in range(window)), strict=True))
    first: dict[tuple, int] = {}
    again = [i for i, w in enumerate(windows) if first.setdefault(w, i) != i] if len(set(windows)) < len(windows) else []
    if not again:
        return 0
    hit = np.zeros(n + 1, dtype=np.int32)
    for i in set(again) | {first[windows[i]] for i in again}:
        hit[i] += 1
        hit[i + window] -= 1
    return int((np.cumsum(hit[:n]) > 0).sum())


def capitals(text: str) -> int:
    """Letters of the category Lu; str.isupper also takes capital-like numerals and symbols."""
    n = sum(map(str.isupper, text))
    return n if n == 0 or text.isascii() else n - sum(unicodedata.category(c) != "Lu" for c in text if c.isupper())


def counts(text: str | None) -> tuple[int, ...]:
    """The counts of a text, as named in _COUNTS. Words are runs of other than ASCII white space."""
    text = text or ""
    data = text.encode()
    words = data.split()
    lines = [x for x in data.split(b"\n") if x.strip(SPACES)]
    spaces = len(data) - len(data.translate(None, SPACES))
    return (
        len(words),
        len(text) - spaces,
        len(data) - len(data.translate(None, SYMBOLS)),
        len(lines),
        len(lines) - len(set(lines)),
        repeated_words(words),
        data.count(b"!"),
        capitals(text),
        sum(map(bytes.__eq__, words, words[1:])),
    )


def document_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id and the counts of every whole text; rows stay where they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = np.array([counts(t.as_py()) for t in batch.column(1)], dtype="int64").reshape(-1, len(_COUNTS))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(table[:, i]) for i in range(len(_COUNTS)))], ["doc_id", *_COUNTS])

    return docs.selectExpr("cast(doc_id as bigint) doc_id", text).mapInArrow(trimmed(run), "doc_id long, " + ", ".join(f"{c} long" for c in _COUNTS))


def statistics(prefix: str = "") -> dict[str, Column]:
    """The rules' statistics from the counts."""
    c = {n: F.col(prefix + n) for n in _COUNTS}
    per = lambda a, b: F.when(c[b] > 0, c[a] / c[b]).otherwise(F.lit(0.0))
    return {
        "symbol_ratio": per("n_symbols", "n_words"),
        "exclaim_ratio": per("n_exclaims", "n_words"),
        "upper_share": per("n_upper", "word_chars"),
        "same_as_before_share": per("n_same_as_before", "n_words"),
        "dup_line_share": per("n_dup_lines", "n_lines"),
        "repeat_share": per("n_repeat_words", "n_words"),
        "mean_word_chars": per("word_chars", "n_words"),
    }


def stratum() -> Column:
    """The number of a row's stratum, by its words."""
    return sum((F.when(F.col("n_words") >= s, 1).otherwise(0) for s in STRATA), F.lit(0)).cast("int")


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words"))


def at_most(rejected: int, total: int, risk: float, level: float) -> bool:
    """Whether the exact (Clopper-Pearson) upper bound of a rate is at most `risk`: P(X <= rejected | total, risk) <= level."""
    # Above its mean the sum is more than any level; below it terms fall fast, so they are added from the largest.
    if total == 0 or rejected >= risk * total:
        return False
    term = math.lgamma(total + 1) - math.lgamma(rejected + 1) - math.lgamma(total - rejected + 1) + rejected * math.log(risk) + (total - rejected) * math.log1p(-risk)
    share, tail = 1.0, 0.0
    for k in range(rejected, -1, -1):
        tail += share
        share *= k * (1 - risk) / ((total - k + 1) * risk)
        if share < 1e-17 * tail:
            break
    return term + math.log(tail) <= math.log(level)


def choose_cutoffs(good: DataFrame, risk: float = RISK, delta: float = DELTA) -> dict[tuple[int, str], float]:
    """Cutoffs by (stratum, rule) from the counts of documents labelled good that pass the base rule.

    Spark adds up, for each stratum, how many a candidate would reject: one row a stratum reaches the driver.
    """
    stats = statistics()
    aggs = [F.sum((stats[r] > c).cast("long")).alias(f"{r}|{c}") for r, cs in RULES.items() for c in cs]
    rows = good.filter(~base_failed()).groupBy(stratum().alias("stratum")).agg(F.count(F.lit(1)).alias("total"), *aggs).collect()
    level = delta / (sum(map(len, RULES.values())) * (len(STRATA) + 1))
    chosen = {}
    for row in rows:
        for r, cs in RULES.items():
            fit = next((c for c in cs if at_most(row[f"{r}|{c}"], row["total"], risk / len(RULES), level)), None)
            if fit is not None:
                chosen[row["stratum"], r] = fit
    return chosen


def rejected_by(cutoffs: dict[tuple[int, str], float]) -> Column:
    """Whether any chosen cutoff rejects the row."""
    stats, out = statistics(), F.lit(False)
    for (s, r), c in sorted(cutoffs.items()):
        out = out | ((stratum() == s) & (stats[r] > c))
    return out


def apply_rules(docs: DataFrame, labels: DataFrame, counted: DataFrame | None = None) -> DataFrame:
    """Counts, base_failed, rejected (the method's) and kept of every document. labels: doc_id, quality."""
    counted = staged(document_counts(docs), "counts") if counted is None else counted
    good = counted.join(labels.filter("quality = 1").select("doc_id").distinct(), "doc_id", "left_semi")
    cutoffs = choose_cutoffs(good)
    return counted.withColumn("base_failed", base_failed()).withColumn("rejected", rejected_by(cutoffs)).withColumn("kept", ~F.col("base_failed") & ~F.col("rejected"))


def filter_documents(docs: DataFrame, labels: DataFrame, text: str = "text") -> DataFrame:
    """The documents, with all their columns, that the base rule and the chosen cutoffs keep; rows stay where they are."""

    @F.pandas_udf(", ".join(f"{c} long" for c in _COUNTS))
    def counts_column(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([counts(t) for t in texts], columns=list(_COUNTS), dtype="int64")

    counted = document_counts(docs, text)
    good = counted.join(labels.filter("quality = 1").select("doc_id").distinct(), "doc_id", "left_semi")
    cutoffs = choose_cutoffs(good)
    mine = docs.select(F.struct("*").alias("row"), counts_column(text).alias("c")).select("row", "c.*")
    return mine.filter(~base_failed() & ~rejected_by(cutoffs)).select("row.*")


def oracle_sql() -> str:
    """doc_id, the base counts, base_failed and kept of apply_rules() in DuckDB SQL."""
    rules = ", ".join(f"('{r}', {c}::DOUBLE)" for r, cs in RULES.items() for c in cs)
    level, risk = DELTA / (sum(map(len, RULES.values())) * (len(STRATA) + 1)), RISK / len(RULES)
    stratum_sql = " + ".join(f"(n_words >= {s})::INT" for s in STRATA)
    per = lambda a, b: f"CASE WHEN {b} > 0 THEN {a}::DOUBLE / {b} ELSE 0 END"
    stats = {
        "symbol_ratio": per("n_symbols", "n_words"), "exclaim_ratio": per("n_exclaims", "n_words"), "upper_share": per("n_upper", "word_chars"), "same_as_before_share": per("n_same", "n_words"),
        "dup_line_share": per("n_dup_lines", "n_lines"), "repeat_share": per("n_repeat_words", "n_words"), "mean_word_chars": per("word_chars", "n_words"),
    }
    tall = " UNION ALL ".join(f"SELECT r, '{n}' AS rule, {x} AS v FROM d" for n, x in stats.items())
    return rf"""
WITH w AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS x, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (SELECT r, i, array_to_string(ws[i:i + {WINDOW - 1}], ' ') AS s FROM (SELECT r, ws, unnest(range(1, len(ws) - {WINDOW - 2})) AS i FROM w WHERE len(ws) >= {WINDOW})),
again AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, s) AS n FROM win) WHERE n > 1),
rep AS (SELECT r, count(DISTINCT i + j) AS n FROM again, range({WINDOW}) t(j) GROUP BY r),
lines AS (SELECT r, list_filter(string_split(x, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls FROM w),
n AS (SELECT r, doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(x, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  len(ls) AS n_lines, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, length(regexp_replace(x, '[^!]', '', 'g')) AS n_exclaims,
  length(regexp_replace(x, '[^\p{{Lu}}]', '', 'g')) AS n_upper, len(list_filter(range(1, len(ws)), lambda i: ws[i] = ws[i + 1])) AS n_same
  FROM w JOIN lines USING (r) LEFT JOIN rep USING (r)),
d AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED_PERCENT} * n_words AS base_failed, {stratum_sql} AS stratum FROM n),
v AS ({tall}), cut(rule, c) AS (VALUES {rules}),
good AS (SELECT r, stratum FROM d WHERE NOT base_failed AND doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)),
tried AS (SELECT stratum, rule, c, count(*) AS n, count(*) FILTER (v > c) AS k FROM good JOIN v USING (r) JOIN cut USING (rule) GROUP BY ALL),
fit AS (SELECT stratum, rule, min(c) AS c FROM tried WHERE list_sum(list_transform(range(0, k + 1), lambda j: exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({risk!r}) + (n - j) * ln(1 - {risk!r})))) <= {level!r} GROUP BY ALL),
bad AS (SELECT DISTINCT r FROM d JOIN v USING (r) JOIN fit USING (stratum, rule) WHERE v > c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND r NOT IN (SELECT r FROM bad) AS kept FROM d"""
