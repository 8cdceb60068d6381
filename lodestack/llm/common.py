"""What the operators of this package share: inputs, the shared work folder, staged tables, key ranges."""

from __future__ import annotations

import contextlib
import ctypes
import math
import re
import tempfile
import uuid
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.llm.tokens import COLUMN_BYTES, drop_encoder

#: Rows of an Arrow batch, and its bytes (or one row): texts can be long, so batches are short.
BATCH_ROWS, BATCH_BYTES = 500, 4 << 20
#: Rows that a task reads from Parquet at once; their texts are all in its heap, twice while their array grows.
READ_ROWS = 128
#: Rows of a range of ids, at most about.
RANGE_ROWS = 20_000
#: What a null id counts as in an order of ids.
NULL_ID = -(1 << 63)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents table; Arrow batches, and those that Parquet is read in, are kept short from here on."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    most = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    if not 0 < spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(most) <= BATCH_BYTES:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", f"{BATCH_BYTES}b")
    if int(spark.conf.get("spark.sql.parquet.columnarReaderBatchSize")) > READ_ROWS:
        spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", str(READ_ROWS))
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labels table."""
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder that all executors share: under spark.checkpoint.dir. Only a local master may leave that unset."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not re.fullmatch(r"local(\[[^\[\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="lodestack-"))
        root = spark.sparkContext.getCheckpointDir()
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read again: its lineage is cut and it runs once. release() deletes it."""
    spark = df.sparkSession
    path = work_dir(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_path = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete staged tables that nothing reads any more: what was made of them has been written."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.staged_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def trimmed(run: Callable[[Iterator], Iterator], encodes: bool = False) -> Callable[[Iterator], Iterator]:
    """A function of Arrow batches that gives back the memory it has freed when it ends, so that an idle worker holds little.

    The encoder that another operator left in the worker is dropped first, with its memo, unless this one `encodes` too.
    """

    def of(batches: Iterator) -> Iterator:
        if not encodes:
            drop_encoder()
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # where the C library isn't glibc
                ctypes.CDLL("libc.so.6").malloc_trim(0)

    return of


def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arrow batches put together, to about what an encoder splits at once."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if held and sum(b.nbytes for b in held) + batch.nbytes > COLUMN_BYTES:
            yield pa.concat_batches(held)
            held = []
        held.append(batch)
    if held:
        yield pa.concat_batches(held)


def without(docs: DataFrame, taken: Iterable[str]) -> DataFrame:
    """docs; a column with a name that is taken for a result (in any case of letters) becomes input_<name>."""
    names = {c.lower() for c in docs.columns} | {t.lower() for t in taken}
    new = []
    for c in docs.columns:
        to = c
        if c.lower() in {t.lower() for t in taken}:
            to = f"input_{c}"
            while to.lower() in names:
                to += "_"
            names.add(to.lower())
        new.append(to)
    return docs.toDF(*new)


def range_count(docs: DataFrame) -> int:
    """How many ranges documents are cut into: as their rows ask for, and at least one for each shuffle partition."""
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-docs.count() // RANGE_ROWS))


def crc_mod(col: Column, n: int) -> Column:
    """crc32 of a column's text, modulo n."""
    return F.crc32(col.cast("string").cast("binary")) % n


class KeyRanges:
    """Ranges of doc_id of about equal row counts, in ascending order; null ids come first, as the smallest number.

    The cuts are approximate quantiles, so their number is bounded by `n` and no row reaches the driver. An id that
    several quantiles fall on has ranges of its own, as many as those, between which its rows are dealt by a hash of
    their text and place: one id may hold any share of the rows, equal ones too.
    """

    def __init__(self, df: DataFrame, n: int, key: str = "doc_id", text: str = "text") -> None:
        self.key, self.text = F.coalesce(F.col(key).cast("long"), F.lit(NULL_ID)), text
        qs = [i / n for i in range(1, n)]
        found = (df.agg(F.percentile_approx(self.key, qs, max(10_000, 8 * n))).first()[0] or []) if n > 1 else []
        #: The last id of each range but the last, and in how many pieces each is cut.
        self.lasts: list[int] = []
        self.pieces: list[int] = []
        for c, times in sorted(Counter(found).items()):
            if times > 1 and c > NULL_ID and (not self.lasts or self.lasts[-1] < c - 1):
                self.lasts.append(c - 1)
                self.pieces.append(1)
            self.lasts.append(c)
            self.pieces.append(times)
        self.pieces.append(1)
        self.n = sum(self.pieces)

    def column(self) -> Column:
        """The number of a row's range, from 0."""
        if not self.lasts:
            return F.lit(0)
        # How many lasts are below the key, by blocks of about the root of their number.
        width = math.isqrt(len(self.lasts) - 1) + 1
        heads, key = self.lasts[::width], self.key
        blocks = [self.lasts[i : i + width] for i in range(0, len(self.lasts), width)]
        below = lambda xs: F.size(F.filter(xs, lambda c: c < key))
        block = below(_longs(heads))
        inside = below(F.get(F.array(*map(_longs, blocks)), block - 1))
        at = F.when(block == 0, 0).otherwise((block - 1) * width + inside)
        if self.n == len(self.pieces):
            return at.cast("int")
        before = [sum(self.pieces[:i]) for i in range(len(self.pieces))]
        pieces = F.get(_longs(self.pieces), at)
        dealt = F.when(pieces > 1, F.pmod(F.xxhash64(self.text, F.monotonically_increasing_id()), pieces)).otherwise(0)
        return (F.get(_longs(before), at) + dealt).cast("int")


def _longs(xs: list[int]) -> Column:
    """A literal array, written as SQL text: there may be many."""
    return F.expr("array(" + ", ".join(f"bigint('{x}')" for x in xs) + ")")
