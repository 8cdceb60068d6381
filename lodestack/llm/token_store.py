"""A token store of directly addressable codes.

Ids are cut into chunks of 8 bits. Level 0 holds the lowest chunk of every id; a bitmap says which ids go on; level 1
holds the next chunk of those, and so on. A directory with the count of set bits before every 512th bit gives the
place of an id's next chunk, so any token is read without decoding what stands before it.

A file of the store is a row of a Parquet table in the shared folder: the code of about a million tokens (`codes`),
with the documents it holds and where they end. Files of a range of doc_id follow each other; ranges are in
ascending order. Null ids come first. Null and empty texts are the end id alone; a long text may fill a file of its
own. Equal ids stand side by side, ordered by text within a range; an id with very many rows, equal ones too, has
several ranges. Other columns of the table, whatever their names, are not looked at. An empty table gives an empty
store.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.llm.common import KeyRanges, gathered, range_count, trimmed, work_dir
from lodestack.llm.tokens import library_encoder, worker_encoder

VOCABULARY = "byte_bpe_50k.json"
#: The id after each document.
END = 0
#: Tokens at which a file is full.
FILE_TOKENS = 1 << 20
_BITS, _STEP = 8, 512
_MAGIC = b"DAC1"


def pack(ids: np.ndarray) -> bytes:
    """The code of ids (unsigned 32-bit)."""
    rest = np.ascontiguousarray(ids, dtype="<u4")
    levels = []
    while True:
        more = rest > 0xFF
        bits = np.packbits(more, bitorder="little")
        blocks = bits[: len(rest) // _STEP * (_STEP // 8)].reshape(-1, _STEP // 8)
        before = np.concatenate(([0], np.cumsum(np.bitwise_count(blocks).sum(axis=1)))).astype("<u4")
        levels.append(struct.pack("<III", len(rest), len(bits), len(before)) + rest.astype("u1").tobytes() + bits.tobytes() + before.tobytes())
        if not more.any():
            break
        rest = rest[np.flatnonzero(more)] >> _BITS
    return _MAGIC + struct.pack("<I", len(levels)) + b"".join(levels)


class Codes:
    """Reads packed ids."""

    def __init__(self, data: bytes) -> None:
        if data[:4] != _MAGIC:
            raise ValueError("not a token file")
        self.levels, at = [], 8
        for _ in range(struct.unpack_from("<I", data, 4)[0]):
            n, bits, ranks = struct.unpack_from("<III", data, at)
            at += 12
            chunks = np.frombuffer(data, "u1", n, at)
            bitmap = np.frombuffer(data, "u1", bits, at + n)
            directory = np.frombuffer(data, "<u4", ranks, at + n + bits)
            at += n + bits + 4 * ranks
            self.levels.append((chunks, bitmap, directory))

    def __len__(self) -> int:
        return len(self.levels[0][0])

    def __getitem__(self, i: int) -> int:
        """One id, by a step down the levels."""
        if not 0 <= i < len(self):
            raise IndexError(i)
        out = shift = 0
        for chunks, bitmap, directory in self.levels:
            out |= int(chunks[i]) << shift
            if not bitmap[i >> 3] >> (i & 7) & 1:
                break
            start = i - i % _STEP
            i = int(directory[i // _STEP]) + int(np.unpackbits(bitmap[start >> 3 : (i >> 3) + 1], bitorder="little")[: i - start].sum())
            shift += _BITS
        return out

    def all(self) -> np.ndarray:
        """All ids."""
        above: np.ndarray | None = None
        for chunks, bitmap, _ in reversed(self.levels):
            ids = chunks.astype("<u4")
            if above is not None:
                more = np.flatnonzero(np.unpackbits(bitmap, count=len(chunks), bitorder="little"))
                ids[more] |= above << np.uint32(_BITS)
            above = ids
        return above


#: first_id and last_id (of the non-null ids) let a reader skip files.
_FILE = "range int, file int, first long, first_id long, last_id long, doc_ids array<long>, ends array<long>, codes binary"


def write(docs: DataFrame, path: str | None = None, vocabulary: str = VOCABULARY, ranges: int | None = None, text: str = "text") -> str:
    """Encode all documents in ascending doc_id order into token files under `path`; gives the path.

    One shuffle moves the texts to their ranges; a task encodes and writes its range in order, a file at a time.
    """
    spark = docs.sparkSession
    path = path or work_dir(spark, "tokens")
    cut = KeyRanges(docs.select("doc_id"), ranges or range_count(docs))
    placed = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"))
        .withColumn("range", cut.column())
        .repartitionById(cut.n, "range")
        .sortWithinPartitions("range", F.asc_nulls_first("doc_id"), F.asc_nulls_first("text"))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(vocabulary, lambda: library_encoder(vocabulary, True))
        end = struct.pack("<I", END)
        held: list[bytes] = []
        ids: list[int | None] = []
        ends: list[int] = []
        state = {"range": None, "file": 0, "first": 0, "n": 0}

        def full() -> pa.RecordBatch:
            codes = pack(np.frombuffer(b"".join(held), dtype="<u4"))
            some = [i for i in ids if i is not None]
            row = [state["range"]], [state["file"]], [state["first"]], [min(some, default=None)], [max(some, default=None)], [list(ids)], [list(ends)], [codes]
            kinds = pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()
            state.update(file=state["file"] + 1, first=state["first"] + state["n"], n=0)
            held.clear(), ids.clear(), ends.clear()
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds, strict=True)], [f.split()[0] for f in _FILE.split(", ")])

        for some in gathered(batches):
            for doc_id, r, got in zip(some.column(0).to_pylist(), some.column(2).to_pylist(), encoder.encode_column(some.column(1)), strict=True):
                if r != state["range"]:
                    if held:
                        yield full()
                    state.update(range=r, file=0, first=0)
                held.append(got + end)
                state["n"] += len(got) // 4 + 1
                ids.append(doc_id)
                ends.append(state["n"])
                if state["n"] >= FILE_TOKENS:
                    yield full()
        if held:
            yield full()

    placed.mapInArrow(trimmed(run, encodes=True), _FILE).write.parquet(path)
    return path


def read(spark: SparkSession, path: str) -> DataFrame:
    """Each document of the store: doc_id, start (ids of all documents before it), n_tokens, ids (binary, unsigned 32-bit)."""
    return _read(spark, path, lambda ids: ids.tobytes(), "ids binary", pa.binary())


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """The same with ids_crc32 in place of the ids."""
    return _read(spark, path, lambda ids: zlib.crc32(ids.tobytes()), "ids_crc32 long", pa.int64())


def _read(spark: SparkSession, path: str, of, field: str, kind: pa.DataType) -> DataFrame:
    files = spark.read.schema(_FILE).parquet(path)
    # One row a range: as many as the store was cut into, whatever the rows.
    totals = sorted((r["range"], r["n"]) for r in files.groupBy("range").agg(F.sum(F.element_at("ends", -1)).alias("n")).collect())
    before, at = {}, 0
    for r, n in totals:
        before[r] = at
        at += n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, ends = Codes(row["codes"]).all(), row["ends"]
                starts = [0, *ends[:-1]]
                first = before[row["range"]] + row["first"]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(row["doc_ids"], pa.int64()),
                        pa.array([first + s for s in starts], pa.int64()),
                        pa.array([e - s for s, e in zip(starts, ends, strict=True)], pa.int64()),
                        pa.array([of(ids[s:e]) for s, e in zip(starts, ends, strict=True)], kind),
                    ],
                    ["doc_id", "start", "n_tokens", field.split()[0]],
                )

    return files.mapInArrow(trimmed(run, encodes=True), f"doc_id long, start long, n_tokens long, {field}")


def token_at(spark: SparkSession, path: str, doc_id: int, i: int) -> int | None:
    """Token i of a document, read from its file alone; None if there is none. Of equal ids, the first document counts."""
    near = F.lit(doc_id).between(F.col("first_id"), F.col("last_id"))
    row = spark.read.schema(_FILE).parquet(path).filter(near & F.array_contains("doc_ids", F.lit(doc_id).cast("long"))).orderBy("range", "file").first()
    if row is None:
        return None
    k = row["doc_ids"].index(doc_id)
    start = row["ends"][k - 1] if k else 0
    return Codes(row["codes"])[start + i] if 0 <= i < row["ends"][k] - start else None
