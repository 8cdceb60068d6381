"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic documents are the positives, a sample of all documents the unlabelled; a label of 0 is never used as a
negative; the held-out fold's documents aren't looked at. A linear model on word features minimises the class-prior-corrected risk
    prior * E_p[loss(+)] + max(0, E_u[loss(-)] - prior * E_p[loss(-)])
with logistic loss: while the second part is below zero, the step goes back along it instead. The prior is the share
of toxic documents among the labelled ones. Features are the words of a text and their first letters; those that are
no more frequent among positives than among all training rows are left out.

The gradient steps use bounded samples of the training rows: about MAX_POSITIVE positives and MAX_UNLABELLED
unlabelled ones, drawn by row. The frequencies of features are counted over all training rows, and scoring reads every
whole text, however long. Null and empty texts have no features and get the score of the bias and the size alone. Equal
texts score alike. An id with several labels is positive if one of them is. Without any positive, every score is the
prior (0 if there are no labels). Other columns, whatever their names, are not looked at. An empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestack.llm.common import crc_mod, release, staged, trimmed

MAX_POSITIVE, MAX_UNLABELLED = 3000, 6000
#: Features are hashed to so many numbers.
SPACE = 1 << 20
#: Rows of sums that partitions are gathered to before the driver adds them.
GATHER = 16
#: Features for a text's number of distinct words, by doublings; always kept, as a long text has more of all others.
SIZES = 24
#: A feature is kept if so many positives have it and it is so many times as frequent there as among all.
MIN_POSITIVE, MIN_SHARE, MIN_LIFT = 2, 0.003, 2.0
STEPS, RATE, DECAY, SEED = 400, 0.05, 1e-4, 7
PREFIXES = (3, 4, 5, 6)
THRESHOLD = 0.7
_WORD = re.compile(r"\w+")
_SPLIT_LIMIT = 300_000


class Features:
    """Feature numbers of texts, with a bounded memo of words; of `keep` only, if given."""

    def __init__(self, keep: dict[int, int] | None = None) -> None:
        self.keep, self.memo = keep, {}

    def of_word(self, word: str) -> tuple[int, ...]:
        found = [zlib.crc32(f"w {word}".encode()) % SPACE, *(zlib.crc32(f"{n} {word[:n]}".encode()) % SPACE for n in PREFIXES if len(word) > n)]
        return tuple(found) if self.keep is None else tuple(self.keep[f] for f in found if f in self.keep)

    def of_text(self, text: str | None) -> set[int]:
        out: set[int] = set()
        memo = self.memo
        if len(memo) > _SPLIT_LIMIT:
            memo.clear()
        words = set(_WORD.findall((text or "").lower()))
        size = SPACE + min(len(words).bit_length(), SIZES - 1)
        if self.keep is None or size in self.keep:
            out.add(size if self.keep is None else self.keep[size])
        for w in words:
            found = memo.get(w)
            if found is None:
                found = memo[w] = self.of_word(w)
            if found:
                out.update(found)
        return out


def fit_nnpu(positive: list[np.ndarray], unlabelled: list[np.ndarray], size: int, prior: float) -> tuple[np.ndarray, float]:
    """Weights and bias of the linear model, by Adam on all rows; each row is the numbers of its features."""
    rows = [*positive, *unlabelled]
    at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    col = np.concatenate(rows).astype("int64") if rows else np.empty(0, "int64")
    n, n_p, n_u = len(rows), len(positive), len(unlabelled)
    is_p = np.arange(n) < n_p
    theta = np.zeros(size + 1)
    theta[-1] = np.log(prior / (1 - prior))
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    sigmoid = lambda x: 1 / (1 + np.exp(-np.clip(x, -30, 30)))
    for step in range(1, STEPS + 1):
        z = np.bincount(at, theta[col], n) + theta[-1]
        s = sigmoid(z)
        loss_minus = np.logaddexp(0, z)
        negative = loss_minus[~is_p].mean() - prior * loss_minus[is_p].mean()
        # Derivatives by z: of loss(+) it is s - 1, of loss(-) it is s.
        d_negative = np.where(is_p, -prior * s / n_p, s / n_u)
        d = np.where(is_p, prior * (s - 1) / n_p, 0) + d_negative if negative >= 0 else -d_negative
        g = np.append(np.bincount(col, d[at], size), d.sum())
        g[:-1] += DECAY * theta[:-1]
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
        theta = theta - RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return theta[:-1], float(theta[-1])


def train(docs: DataFrame, labels: DataFrame, in_training: Column, text: str = "text") -> tuple[dict[int, float], float]:
    """Weights by feature number, and the bias. labels: doc_id, toxic; in_training: which doc_ids labels are learnt from."""
    mine = labels.filter(in_training & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    shares = mine.agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("p")).first()
    if not shares["n"] or not shares["p"] or shares["p"] == shares["n"]:
        share = min(max((shares["p"] or 0) / max(shares["n"], 1), 1e-9), 1 - 1e-9)
        return {}, float(np.log(share / (1 - share)))
    prior = shares["p"] / shares["n"]
    base = docs.filter(in_training)
    ids = mine.filter("toxic = 1").select("doc_id").orderBy(F.xxhash64(F.lit(SEED), "doc_id"), "doc_id").limit(MAX_POSITIVE)
    ids = F.broadcast(staged(ids, "toxicity-ids"))  # at most MAX_POSITIVE
    n_p, n_u = base.select("doc_id").join(ids, "doc_id", "left_semi").count(), base.count()
    if not n_p or not n_u:
        return {}, float(np.log(prior / (1 - prior)))
    positive = staged(_sampled(base.join(ids, "doc_id", "left_semi"), n_p, MAX_POSITIVE, text), "toxicity-positive")
    sample = staged(_sampled(base, n_u, MAX_UNLABELLED, text), "toxicity-unlabelled")
    p_rows, u_rows = _rows(positive), _rows(sample)
    if not p_rows or not u_rows:
        return {}, float(np.log(prior / (1 - prior)))
    # Candidates come from the positives; how frequent they are is counted over all training rows.
    p = np.bincount(np.concatenate(p_rows), minlength=SPACE + SIZES)[:SPACE]
    candidates = np.flatnonzero(p >= max(MIN_POSITIVE, MIN_SHARE * len(p_rows)))
    u = _counts(base, candidates, text)
    lift = (p[candidates] / len(p_rows)) / ((u + 0.5) / n_u)
    kept = [*candidates[lift >= MIN_LIFT].tolist(), *range(SPACE, SPACE + SIZES)]
    number = np.full(SPACE + SIZES, -1)
    number[kept] = np.arange(len(kept))
    slim = lambda rows: [x[x >= 0] for x in (number[r] for r in rows)]
    weights, bias = fit_nnpu(slim(p_rows), slim(u_rows), len(kept), prior)
    release(positive, sample)
    return {f: float(weights[i]) for i, f in enumerate(kept)}, bias


def _rows(sample: DataFrame) -> list[np.ndarray]:
    """The feature numbers of a sample's rows, on the driver."""
    found = sample.toArrow().column("features").combine_chunks()
    return np.split(found.flatten().to_numpy(), np.cumsum(found.value_lengths().to_numpy())[:-1]) if len(found) else []


def _sampled(rows: DataFrame, n: int, most: int, text: str) -> DataFrame:
    """features of about `most` of n rows, drawn by a hash of the row's place: rows, not ids, so that repeated ids and texts add none."""

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Features().of_text
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([sorted(of(t)) for t in batch.column(0).to_pylist()], pa.list_(pa.int32()))], ["features"])

    drawn = rows
    if n > most:
        whole = 1 << 40
        drawn = rows.filter(F.pmod(F.xxhash64(F.lit(SEED), F.monotonically_increasing_id()), F.lit(whole)) < most * whole // n)
    return drawn.select(text).mapInArrow(trimmed(features), "features array<int>")


def _counts(rows: DataFrame, candidates: np.ndarray, text: str) -> np.ndarray:
    """How many rows have each candidate feature. Partitions add up; the driver gets GATHER rows of 8 bytes a candidate."""
    place = {f: i for i, f in enumerate(candidates.tolist())}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, seen = Features(place).of_text, np.zeros(len(place), dtype="int64")
        for batch in batches:
            found = [f for t in batch.column(0).to_pylist() for f in of(t)]
            seen += np.bincount(found, minlength=len(place)).astype("int64")
        yield pa.RecordBatch.from_arrays([pa.array([seen.tobytes()], pa.binary())], ["sums"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(place), dtype="int64")
        for batch in batches:
            for sums in batch.column(0).to_pylist():
                total += np.frombuffer(sums, dtype="int64")
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])

    parts = rows.select(text).mapInArrow(trimmed(count), "sums binary").repartition(GATHER).mapInArrow(add, "sums binary").collect()
    return sum((np.frombuffer(r["sums"], dtype="int64") for r in parts), np.zeros(len(place), dtype="int64"))


def score(docs: DataFrame, model: tuple[dict[int, float], float], text: str = "text") -> DataFrame:
    """doc_id and score of every whole text; rows stay where they are."""
    weights, bias = model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Features({f: f for f in weights}).of_text
        for batch in batches:
            z = np.array([bias + sum(map(weights.__getitem__, of(t))) for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(1 / (1 + np.exp(-np.clip(z, -40, 40))), pa.float64())], ["doc_id", "score"])

    return docs.selectExpr("cast(doc_id as bigint) doc_id", text).mapInArrow(trimmed(run), "doc_id long, score double")


def score_documents(docs: DataFrame, labels: DataFrame, folds: int = 3, held_out: int = 1) -> DataFrame:
    """doc_id, held_out, score and predicted of every document; labels of the held-out fold are not read."""
    fold = F.coalesce(crc_mod(F.col("doc_id"), folds), F.lit(0))
    model = train(docs, labels, fold != held_out)
    return score(docs, model).select("doc_id", (fold == held_out).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
