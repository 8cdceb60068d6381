"""Licence scans by diagonal voting, in DataFrame operations only.

Texts and templates are cut into words; every rolling pair of words (k = 2) of a text is joined by hash to the
places where a template has that pair, and the words themselves must be equal, which verifies each vote. A vote lies
on the diagonal `place in the text - place in the template`. Votes are gathered by document, template and diagonal;
diagonals at most SLACK apart are merged, so a span survives inserted or lost words; the merged span is verified by
the share of the template's pairs that it holds. A base phrase counts where one diagonal holds all its pairs.

Templates are a fixed list of a few dozen rows, so they are broadcast. Null and empty texts have no words: one row
with no labels, null first_word and last_word and score 0. Rows with equal ids are scanned apart.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The base phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Sentences of public licences, in the words of this scan, and their labels.
TEMPLATES = {
    "released under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy of this software": "mit",
    "licensed under the apache license version 2 0": "apache-2.0",
    "this work is licensed under the gnu general public license version 3": "gpl-3.0",
    "you can redistribute it and or modify it under the terms of the gnu general public license": "gpl-notice",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd",
    "licensed under cc by nc 4 0": "cc-by-nc-4.0",
    "licensed under a creative commons attribution 4 0 international license": "cc-by-4.0",
    "subject to the terms of the mozilla public license v 2 0": "mpl-2.0",
    "this is free and unencumbered software released into the public domain": "unlicense",
}
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Diagonals up to this far apart are one span; share of a template's pairs that a span must hold.
SLACK, COVERAGE = 2, 0.8
#: The pair that stands for the document itself; no word holds a full stop.
_SELF = "."


def template_pairs() -> list[tuple[int, bool, str, int, int, str, str]]:
    """(template, is base, label, pairs of it, place, word, next word)."""
    rows = [(-1, False, "", 1, 0, _SELF, _SELF)]
    for n, (phrase, label) in enumerate([*BASE.items(), *TEMPLATES.items()]):
        words = phrase.split()
        rows += [(n, n < len(BASE), label, len(words) - 1, i, a, b) for i, (a, b) in enumerate(zip(words, words[1:], strict=False))]
    return rows


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score of every whole text."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    templates = docs.sparkSession.createDataFrame(template_pairs(), "template int, base boolean, label string, pairs int, at int, a string, b string")
    templates = F.broadcast(templates.withColumn("h", F.xxhash64("a", "b")))
    words = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), upper, lower), F.lit(WORD), F.lit(0)).alias("w"),
    )
    n = F.size("w")
    pairs = F.when(n > 1, F.arrays_zip(F.slice("w", 1, n - 1).alias("a"), F.slice("w", 2, n - 1).alias("b")))
    none = F.expr("cast(array() as array<struct<a:string,b:string>>)")
    own = F.array(F.struct(F.lit(_SELF).alias("a"), F.lit(_SELF).alias("b")))
    rolled = words.select("row", "doc_id", n.cast("long").alias("n_words"), F.posexplode(F.concat(own, F.coalesce(pairs, none))).alias("pos", "p"))
    rolled = rolled.select("row", "doc_id", "n_words", "pos", F.col("p.a").alias("wa"), F.col("p.b").alias("wb"))
    votes = rolled.join(templates, (F.xxhash64("wa", "wb") == F.col("h")) & (F.col("wa") == F.col("a")) & (F.col("wb") == F.col("b")))
    votes = votes.select("row", "doc_id", "n_words", "template", "base", "label", "pairs", "at", (F.col("pos") - 1 - F.col("at")).alias("diagonal"))
    # From here on all grouping is within a document's row: one exchange.
    keys = ["row", "doc_id", "n_words", "template", "base", "label", "pairs"]
    diagonals = votes.repartition("row").groupBy(*keys, "diagonal").agg(F.expr("bit_or(shiftleft(1L, at))").alias("held"))
    diagonals = diagonals.selectExpr("*", f"case when diagonal - lag(diagonal) over (partition by row, template order by diagonal) <= {SLACK} and not base then 0 else 1 end as opens")
    diagonals = diagonals.selectExpr("*", "sum(opens) over (partition by row, template order by diagonal) as span")
    spans = diagonals.groupBy(*keys, "span").agg(F.expr("bit_count(bit_or(held))").alias("n_held"), F.min("diagonal").cast("long").alias("start"))
    cover = F.col("n_held") / F.col("pairs")
    at_base = F.col("base") & (F.col("n_held") == F.col("pairs"))
    labelled = at_base | (~F.col("base") & (F.col("template") >= 0) & (cover >= COVERAGE))
    join = lambda of: F.array_join(F.array_sort(F.collect_set(F.when(of, F.col("label")))), ",")
    return (
        spans.groupBy("row", "doc_id", "n_words")
        .agg(
            F.sum(at_base.cast("long")).alias("n_base"),
            F.min(F.when(at_base, F.col("start"))).alias("first_word"),
            F.max(F.when(at_base, F.col("start"))).alias("last_word"),
            join(at_base).alias("base_labels"),
            join(labelled).alias("labels"),
            F.coalesce(F.max(F.when(at_base, F.lit(1.0)).when(~F.col("base") & (F.col("template") >= 0), cover)), F.lit(0.0)).alias("score"),
        )
        .drop("row")
    )


def oracle_sql() -> str:
    """The same in DuckDB SQL."""
    rows = ", ".join(f"({t}, {str(b).lower()}, '{x}', {p}, {i}, '{a}', '{c}')" for t, b, x, p, i, a, c in template_pairs())
    return rf"""
WITH t(template, base, label, pairs, tpos, a, b) AS (VALUES {rows}),
d AS (SELECT row_number() OVER () AS r, CAST(doc_id AS BIGINT) AS doc_id,
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS w FROM documents),
g AS (SELECT r, doc_id, CAST(len(w) AS BIGINT) AS n_words, unnest(range(0, greatest(len(w), 1))) AS i, w FROM d),
p AS (SELECT r, doc_id, n_words, CASE WHEN i = 0 THEN -1 ELSE i - 1 END AS pos, CASE WHEN i = 0 THEN '{_SELF}' ELSE w[i] END AS a, CASE WHEN i = 0 THEN '{_SELF}' ELSE w[i + 1] END AS b FROM g),
v AS (SELECT r, doc_id, n_words, template, base, label, pairs, tpos, pos - tpos AS diagonal FROM p JOIN t USING (a, b)),
di AS (SELECT r, doc_id, n_words, template, base, label, pairs, diagonal, bit_or(CAST(1 AS BIGINT) << tpos) AS held FROM v GROUP BY ALL),
o AS (SELECT *, CASE WHEN diagonal - lag(diagonal) OVER (PARTITION BY r, template ORDER BY diagonal) <= {SLACK} AND NOT base THEN 0 ELSE 1 END AS opens FROM di),
s AS (SELECT *, sum(opens) OVER (PARTITION BY r, template ORDER BY diagonal) AS span FROM o),
sp AS (SELECT r, doc_id, n_words, template, base, label, pairs, span, bit_count(bit_or(held)) AS n_held, min(diagonal) AS start FROM s GROUP BY ALL),
f AS (SELECT *, base AND n_held = pairs AS at_base, (base AND n_held = pairs) OR (NOT base AND template >= 0 AND n_held / pairs >= {COVERAGE}) AS labelled FROM sp)
SELECT doc_id, n_words, CAST(sum(CAST(at_base AS INT)) AS BIGINT) AS n_base,
  CAST(min(CASE WHEN at_base THEN start END) AS BIGINT) AS first_word, CAST(max(CASE WHEN at_base THEN start END) AS BIGINT) AS last_word,
  coalesce(array_to_string(list_sort(list(DISTINCT label) FILTER (at_base)), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list(DISTINCT label) FILTER (labelled)), ','), '') AS labels,
  coalesce(max(CASE WHEN at_base THEN 1.0::DOUBLE WHEN NOT base AND template >= 0 THEN n_held::DOUBLE / pairs END), 0.0::DOUBLE) AS score
FROM f GROUP BY r, doc_id, n_words"""
