"""Quality classifier: random Fourier features, ridge regression, isotonic calibration.

Statistics of a document (word and line counts, shares of marks, capitals and repetitions) are standardised and mapped
to D random cosines, which approximate a Gaussian kernel. Each partition adds up its normal equations; their sums, of a
fixed size, are solved on the driver. Part of the training rows is kept for the calibration: scores are counted in a
fixed number of bins and made a non-decreasing rate of good documents by pooling adjacent violators.

Labels are used by doc_id only; a document with several labels counts with their mean, rows of an id with that id's.
Null and empty texts have zero statistics and are scored like any other, very long ones by their whole text, equal
texts alike. Other columns, whatever their names, are not looked at and kept by filter_documents. An empty table gives
no rows. Without labels of both kinds every score is the share of good labels (0.5
if there are none).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestack.llm.common import crc_mod, staged, trimmed
from lodestack.llm.quality_rules import counts

FEATURES, GAMMA, RIDGE, SEED = 256, 0.05, 1e-3, 11
#: Rows of sums that partitions are gathered to before the driver adds them.
GATHER = 16
BINS = 2000
THRESHOLD = 0.7
STATISTICS = (
    "log_words", "mean_word", "longest_word", "symbols", "exclaims", "capitals", "digits", "marks", "same_as_before",
    "dup_lines", "repeats", "distinct_words", "distinct_pairs", "log_line", "short_words", "spread",
)


def statistics(text: str | None) -> tuple[float, ...]:
    """A document's statistics, as named in STATISTICS."""
    text = text or ""
    n, chars, symbols, lines, dup, repeats, exclaims, upper, same = counts(text)
    if not n:
        return (0.0,) * len(STATISTICS)
    data = text.encode()
    words = data.split()
    sizes = np.fromiter(map(len, words), dtype="int64", count=n)
    distinct = len(set(words))
    pairs = len(set(zip(words, words[1:], strict=False)))
    digits = len(data) - len(data.translate(None, b"0123456789"))
    marks = len(data) - len(data.translate(None, b".,;:?!\"'()-"))
    return (
        np.log1p(n), chars / n, np.log1p(sizes.max()), min(symbols / n, 3.0), min(exclaims / n, 2.0), upper / chars, digits / chars, min(marks / n, 3.0), same / n,
        dup / max(lines, 1), repeats / n, distinct / n, pairs / max(n - 1, 1), np.log1p(n / max(lines, 1)), float((sizes <= 2).mean()), float(sizes.std()),
    )


def document_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id and the statistics of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = np.array([statistics(t.as_py()) for t in batch.column(1)], dtype="float64").reshape(-1, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(table[:, i]) for i in range(len(STATISTICS)))], ["doc_id", *STATISTICS])

    return docs.selectExpr("cast(doc_id as bigint) doc_id", text).mapInArrow(trimmed(run), "doc_id long, " + ", ".join(f"{s} double" for s in STATISTICS))


@dataclass
class Model:
    """A fitted classifier; without `weights` it gives `share` for all."""

    share: float
    mean: np.ndarray | None = None
    scale: np.ndarray | None = None
    weights: np.ndarray | None = None
    knots: tuple[np.ndarray, np.ndarray] | None = None

    def features(self, x: np.ndarray) -> np.ndarray:
        """Random Fourier features of statistics, and a constant."""
        rng = np.random.default_rng(SEED)
        w = rng.normal(0, np.sqrt(2 * GAMMA), (x.shape[1], FEATURES))
        b = rng.uniform(0, 2 * np.pi, FEATURES)
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.hstack([np.sqrt(2 / FEATURES) * np.cos(z @ w + b), np.ones((len(x), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        """Calibrated scores; within a flat step the raw score still orders, by at most 0.001."""
        if self.weights is None:
            return np.full(len(x), self.share)
        raw = self.raw(x)
        rate = np.interp(raw, *self.knots) if self.knots is not None else np.clip(raw, 0, 1)
        return np.clip(0.999 * rate + 0.001 / (1 + np.exp(-4 * (raw - 0.5))), 0, 1)


def isotonic(y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The non-decreasing fit to y, by pooling adjacent violators."""
    blocks: list[list[float]] = []
    for value, w in zip(y.tolist(), weight.tolist(), strict=True):
        blocks.append([value, w, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v, w2, n = blocks.pop()
            u = blocks[-1]
            u[0] = (u[0] * u[1] + v * w2) / (u[1] + w2)
            u[1] += w2
            u[2] += n
    return np.repeat([b[0] for b in blocks], [int(b[2]) for b in blocks])


def train(stats: DataFrame, labels: DataFrame, in_training: Column, in_calibration: Column) -> Model:
    """Fit on labels (doc_id, quality) of the training rows; `in_calibration` says which of them calibrate only."""
    # One row an id, so that labels never multiply a repeated id's rows.
    known = labels.filter(in_training & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.avg((F.col("quality") == 1).cast("double")).alias("y"))
    rows = staged(
        stats.join(known, "doc_id").select(*STATISTICS, "y", in_calibration.alias("calibrates")),
        "quality-rows",
    )
    fit = rows.filter(~F.col("calibrates"))
    moments = fit.agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("share"), *(F.avg(s).alias(f"m_{s}") for s in STATISTICS), *(F.stddev_pop(s).alias(f"s_{s}") for s in STATISTICS)).first()
    if not moments["n"] or moments["share"] in (0, 1):
        return Model(0.5 if not moments["n"] else float(moments["share"]))
    model = Model(float(moments["share"]), np.array([moments[f"m_{s}"] for s in STATISTICS]), np.array([max(moments[f"s_{s}"], 1e-6) for s in STATISTICS]))
    size = FEATURES + 1

    def equations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size + 1))
        for batch in batches:
            z = model.features(np.column_stack([batch.column(s).to_numpy() for s in STATISTICS]))
            y = batch.column("y").to_numpy()
            total += z.T @ np.column_stack([z, y])
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size * (size + 1))
        for batch in batches:
            for sums in batch.column(0).to_pylist():
                total += np.frombuffer(sums)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])

    # Sums of partitions are added in GATHER tasks, so the driver gets GATHER rows of a fixed size.
    parts = fit.mapInArrow(equations, "sums binary").repartition(GATHER).mapInArrow(add, "sums binary").collect()
    total = sum((np.frombuffer(r["sums"]) for r in parts), np.zeros(size * (size + 1))).reshape(size, size + 1)
    model.weights = np.linalg.solve(total[:, :size] + RIDGE * moments["n"] * np.diag([*[1.0] * FEATURES, 1e-6]) / FEATURES, total[:, size])

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((BINS, 2))
        for batch in batches:
            raw = model.raw(np.column_stack([batch.column(s).to_numpy() for s in STATISTICS]))
            at = np.clip(((raw + 0.5) / 2 * BINS).astype("int64"), 0, BINS - 1)
            seen[:, 0] += np.bincount(at, minlength=BINS)
            seen[:, 1] += np.bincount(at, batch.column("y").to_numpy(), BINS)
        full = np.flatnonzero(seen[:, 0])
        yield pa.RecordBatch.from_arrays([pa.array(full), pa.array(seen[full, 0]), pa.array(seen[full, 1])], ["bin", "n", "good"])

    bins = rows.filter("calibrates").mapInArrow(binned, "bin long, n double, good double").groupBy("bin").agg(F.sum("n").alias("n"), F.sum("good").alias("good")).orderBy("bin").collect()
    if bins:
        n, good = np.array([r["n"] for r in bins]), np.array([r["good"] for r in bins])
        model.knots = ((np.array([r["bin"] for r in bins]) + 0.5) / BINS * 2 - 0.5, isotonic(good / n, n))
    return model


def score(stats: DataFrame, model: Model) -> DataFrame:
    """doc_id and score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.column_stack([batch.column(s).to_numpy() for s in STATISTICS])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.score(x))], ["doc_id", "score"])

    return stats.mapInArrow(run, "doc_id long, score double")


def score_documents(docs: DataFrame, labels: DataFrame, folds: int = 4, held_out: int = 2, calibrate: int = 3) -> DataFrame:
    """doc_id, held_out, score and predicted of every document; labels of the held-out fold are not read."""
    fold = F.coalesce(crc_mod(F.col("doc_id"), folds), F.lit(0))
    stats, model = fit_documents(docs, labels, folds, held_out, calibrate)
    return score(stats, model).select("doc_id", (fold == held_out).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def fit_documents(docs: DataFrame, labels: DataFrame, folds: int = 4, held_out: int = 2, calibrate: int = 3, text: str = "text") -> tuple[DataFrame, Model]:
    """The documents' statistics and the model fitted on them."""
    fold = F.coalesce(crc_mod(F.col("doc_id"), folds), F.lit(0))
    stats = staged(document_statistics(docs, text), "quality-statistics")
    return stats, train(stats, labels, fold != held_out, fold == calibrate)


def filter_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, text: str = "text") -> DataFrame:
    """The documents, with all their columns, whose score is at least `threshold`; rows stay where they are."""
    _, model = fit_documents(docs, labels, text=text)

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.array([statistics(t) for t in texts], dtype="float64").reshape(-1, len(STATISTICS))))

    return docs.select(F.struct("*").alias("row"), scored(text).alias("score")).filter(F.col("score") >= threshold).select("row.*")
