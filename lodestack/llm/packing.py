"""Best-fit packing by patterns whose repeats are fitted by non-negative least squares.

Documents are tokenised and cut into pieces; only the histogram of piece lengths (at most SEQUENCE numbers) reaches
the driver. Patterns of up to DEPTH coarse lengths that fill a sequence are enumerated, how often each is used is
fitted to the histogram by non-negative least squares, and the numbers are rounded down. A pattern's pieces are taken
by exact length, the last one being the longest that still fits. What the patterns leave over is packed best fit
first, from the longest length. All this works on lengths and counts, so its cost doesn't grow with the corpus.

The plan says which pieces of a length, by number, go to which sequences at which offset. Pieces are numbered within
their length in salted groups, so a length that a third of all rows share is no single task's, whatever the rows: null
ids, repeated ids and equal rows are packed like any others. Null and empty texts are a piece of the end id alone; very
long ones are as many pieces as they need. Columns other than doc_id and text, whatever their names, are not looked at.
An empty table gives no pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestack.llm.common import staged, trimmed
from lodestack.llm.tokens import library_encoder, worker_encoder

VOCABULARY = "word_bpe_49k.json"
END = 0
SEQUENCE = 2048
#: Coarse lengths that a sequence is cut into for the patterns, and pieces of a pattern.
GRID, DEPTH = 64, 4
#: Pieces of a group that is numbered by one task.
SALTED = 5000
_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut_documents(docs: DataFrame, vocabulary: str = VOCABULARY, sequence: int = SEQUENCE, text: str = "text") -> DataFrame:
    """Pieces of every document: ids of the whole text and the end id, cut only if longer than a sequence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(vocabulary, lambda: library_encoder(vocabulary, False))
        end = END.to_bytes(4, "little")
        for batch in batches:
            rows = []
            for doc_id, ids in zip(batch.column(0).to_pylist(), encoder.encode([t or "" for t in batch.column(1).to_pylist()]), strict=True):
                ids += end
                for n, at in enumerate(range(0, len(ids), 4 * sequence)):
                    part = ids[at : at + 4 * sequence]
                    rows.append((doc_id, n, at // 4, len(part) // 4, zlib.crc32(part)))
            kinds = pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], k) for k in kinds], [f.split()[0] for f in _PIECES.split(", ")])

    return docs.selectExpr("cast(doc_id as bigint) doc_id", text).mapInArrow(trimmed(run, encodes=True), _PIECES)


def patterns(grid: int = GRID, depth: int = DEPTH) -> list[tuple[int, ...]]:
    """All descending tuples of up to `depth` coarse lengths that add up to `grid`."""

    def grow(left: int, most: int, places: int) -> Iterator[tuple[int, ...]]:
        if left == 0:
            yield ()
        elif places:
            for a in range(min(left, most), (left - 1) // places, -1):
                for rest in grow(left - a, a, places - 1):
                    yield (a, *rest)

    return list(grow(grid, grid, depth))


def nnls(a: np.ndarray, b: np.ndarray, steps: int | None = None) -> np.ndarray:
    """x >= 0 that minimises |a x - b|, by an active set."""
    n = a.shape[1]
    x, active = np.zeros(n), np.zeros(n, dtype=bool)
    for _ in range(steps or 3 * a.shape[0]):
        gain = a.T @ (b - a @ x)
        gain[active] = -np.inf
        j = int(np.argmax(gain))
        if gain[j] <= 1e-9 * max(1.0, np.abs(b).max()):
            break
        active[j] = True
        while True:
            at = np.flatnonzero(active)
            s = np.linalg.lstsq(a[:, at], b, rcond=None)[0]
            if (s > 0).all():
                x[:] = 0
                x[at] = s
                break
            low = s <= 0
            old = x[at]
            step = (old[low] / np.maximum(old[low] - s[low], 1e-300)).min()
            x[at] = np.maximum(old + step * (s - old), 0)
            active[at[x[at] <= 1e-12]] = False
            x[~active] = 0
    return x


def plan(histogram: np.ndarray, sequence: int = SEQUENCE, grid: int = GRID) -> list[tuple[tuple[int, ...], int]]:
    """(piece lengths, repeats) that use up the histogram (count by length, index 0 unused). Its size is bounded by the lengths, not by the counts."""
    left = histogram.astype("int64").copy()
    width = max(1, sequence // grid)
    out: list[tuple[tuple[int, ...], int]] = []

    def take(lengths: tuple[int, ...], times: int) -> None:
        for x in lengths:
            left[x] -= times
        out.append((lengths, times))

    if left[sequence]:
        take((sequence,), int(left[sequence]))
    coarse = np.bincount(-(-np.arange(sequence + 1) // width), left, grid + 1)[1:]
    found = patterns(grid)
    if coarse.sum():
        a = np.zeros((grid, len(found)))
        for j, p in enumerate(found):
            for x in p:
                a[x - 1, j] += 1
        # Short pieces fill gaps anyway, so their residuals weigh less.
        weight = np.sqrt(np.arange(1, grid + 1) / grid)
        repeats = np.floor(nnls(a * weight[:, None], coarse * weight)).astype("int64")
        for j in np.flatnonzero(repeats):
            use_pattern(found[j], int(repeats[j]), left, width, sequence, take)
    best_fit(left, sequence, take)
    return out


def use_pattern(pattern: tuple[int, ...], times: int, left: np.ndarray, width: int, sequence: int, take) -> None:
    """Take a pattern's pieces, many sequences at once: of each coarse length the longest there is, at last the longest that fits."""
    while times > 0:
        lengths: list[int] = []
        for x in pattern[:-1] if len(pattern) > 1 else pattern:
            have = [y for y in range(min(x * width, sequence - sum(lengths)), (x - 1) * width, -1) if left[y] > lengths.count(y)]
            if not have:
                return
            lengths.append(have[0])
        if len(pattern) > 1:
            room = sequence - sum(lengths)
            last = next((y for y in range(room, (pattern[-1] - 1) * width, -1) if left[y] > lengths.count(y)), None)
            if last is None:
                return
            lengths.append(last)
        repeats = min(times, *(int(left[y]) // lengths.count(y) for y in set(lengths)))
        take(tuple(lengths), repeats)
        times -= repeats


def best_fit(left: np.ndarray, sequence: int, take) -> None:
    """Use up the rest: open sequences with the longest piece and fill each with the longest that fits, many at once."""
    while left.any():
        lengths: list[int] = []
        room = sequence
        while room:
            fits = np.flatnonzero(left[1 : room + 1]) + 1
            fits = [y for y in fits[::-1].tolist() if left[y] > lengths.count(y)][:1]
            if not fits:
                break
            lengths.append(fits[0])
            room -= fits[0]
        # Lowering a count may open a better fit, so all the same sequences are taken at once only while none runs out.
        repeats = max(1, min(int(left[y]) // lengths.count(y) for y in set(lengths)))
        take(tuple(lengths), repeats)


def pack_documents(docs: DataFrame, vocabulary: str = VOCABULARY, sequence: int = SEQUENCE) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece."""
    spark = docs.sparkSession
    pieces = staged(cut_documents(docs, vocabulary, sequence).withColumn("row", F.monotonically_increasing_id()), "pieces")
    histogram = np.zeros(sequence + 1, dtype="int64")
    for length, n in pieces.groupBy("length").count().collect():  # at most `sequence` rows
        histogram[length] = n
    # slots[length]: number of its first piece, first sequence and offset, in order of the number.
    slots: dict[int, list[tuple[int, int, int]]] = {}
    used, first = np.zeros(sequence + 1, dtype="int64"), 0
    for lengths, times in plan(histogram, sequence):
        offset = 0
        for x in lengths:
            slots.setdefault(x, []).append((int(used[x]), first, offset))
            used[x] += times
            offset += x
        first += times
    tables = {x: tuple(np.array(c, dtype="int64") for c in zip(*rows, strict=True)) for x, rows in slots.items()}

    # Pieces of a length are numbered in groups of about SALTED, dealt by a row number that was written with them.
    salts = F.get(F.expr("array(" + ", ".join(map(str, np.maximum(1, -(-histogram // SALTED)))) + ")"), F.col("length").cast("int"))
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("row"), salts))
    inside = salted.withColumn("number", F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "row")))
    counts = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("length", "salt", (F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).alias("before"))
    numbered = inside.join(before, ["length", "salt"]).withColumn("number", F.col("number") - 1 + F.col("before"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, number = batch.column("length").to_numpy(), batch.column("number").to_numpy()
            seq, offset = np.empty(len(length), "int64"), np.empty(len(length), "int64")
            for x in np.unique(length).tolist():
                of = np.flatnonzero(length == x)
                starts, firsts, offsets = tables[x]
                at = np.searchsorted(starts, number[of], side="right") - 1
                seq[of] = firsts[at] + number[of] - starts[at]
                offset[of] = offsets[at]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(seq), pa.array(offset)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return numbered.select("doc_id", "piece", "start", "length", "ids_crc32", F.col("number").cast("long").alias("number")).mapInArrow(trimmed(place, encodes=True), _PIECES + ", sequence_id long, offset long")
