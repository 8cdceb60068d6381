"""Sharding by a two-pass external shuffle.

First pass: a seeded hash scatters records uniformly into buckets that fit in memory. Second pass: each bucket is put
in a canonical order, shuffled by Fisher-Yates with a seed of its own and written. The buckets in turn, each in its
shuffled order, are a uniformly random order of all records; shard s takes the places from s*N/k to (s+1)*N/k, so the
shards' row counts are at most one apart (law `rows`).

The same seed, ids, texts and bucket count give the same shards, whatever the cluster, unless there are null ids, which
are scattered by the row's place in the input too, as are equal rows once they fill a bucket: how many of these a bucket
gets depends on the input's files. A null text has no bytes, an empty one none either; a very long one is one record.
Equal rows are shuffled like any others. Input columns named `shard` or `slot` come back as input_shard and
input_slot. An empty table gives no shards.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestack.llm.common import without, work_dir

SEED = 20_240_607
#: Bytes of text a bucket holds on average, and the fewest buckets.
BUCKET_BYTES, MIN_BUCKETS = 48 << 20, 64
#: Times the mean size from which a bucket is scattered anew.
HEAVY = 4
#: Bytes a record takes besides its text.
RECORD_BYTES = 16


def record_size(text: str = "text") -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + RECORD_BYTES


def fisher_yates(n: int, rng: np.random.Generator) -> np.ndarray:
    """A uniformly random order of n places."""
    order = np.arange(n)
    if n > 1:
        picks = rng.integers(0, np.arange(n, 1, -1))
        for i, j in zip(range(n - 1, 0, -1), picks.tolist(), strict=True):
            order[i], order[j] = order[j], order[i]
    return order


def bucket_column(buckets: int, seed: int = SEED, text: str = "text") -> Column:
    """The bucket of a record, by its id and text; of one without an id, also by its place."""
    place = F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id())
    return F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id").cast("long"), text, place), F.lit(buckets)).cast("int")


def scattered(docs: DataFrame, buckets: int, seed: int, text: str) -> tuple[DataFrame, np.ndarray]:
    """docs as (record, id_, text_, bucket_), and each bucket's rows.

    Where a bucket is several times as large as the mean, equal rows that together exceed the mean are scattered anew
    by their place. Rows that are large or meet by chance stay, so that their places depend on ids and texts alone.
    """
    mine = docs.select(F.struct("*").alias("record"), F.col("doc_id").cast("long").alias("id_"), F.col(text).alias("text_"), bucket_column(buckets, seed, text).alias("bucket_"))
    rows, sizes = counted(mine, buckets)
    heavy = np.flatnonzero((sizes > HEAVY * max(1, sizes.mean())) & (rows > 1))
    if not len(heavy):
        return mine, rows
    row = F.xxhash64(F.lit(seed + 2), "id_", "text_")
    among = mine.filter(_in(F.col("bucket_"), heavy, "int")).select(row.alias("row"), record_size("text_").alias("size"))
    # All rows hold `buckets` times the mean, so there are fewer such groups than buckets.
    groups = among.groupBy("row").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size")).filter((F.col("n") > 1) & (F.col("size") > float(sizes.mean())))
    equal = groups.select("row").toArrow().column("row").to_numpy()
    if not len(equal):
        return mine, rows
    anew = F.pmod(F.xxhash64(F.lit(seed + 1), F.monotonically_increasing_id()), F.lit(buckets)).cast("int")
    mine = mine.withColumn("bucket_", F.when(_in(row, equal, "bigint"), anew).otherwise(F.col("bucket_")))
    return mine, counted(mine, buckets)[0]


def _in(col: Column, values: np.ndarray, kind: str) -> Column:
    """Whether col is among the values, written as SQL text: there may be many."""
    return F.array_contains(F.expr("array(" + ", ".join(f"{kind}('{x}')" for x in np.sort(values)) + ")"), col)


def counted(placed: DataFrame, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and bytes of each bucket: 16 bytes for each 48 MB of input reach the driver."""
    rows, sizes = np.zeros(buckets, "int64"), np.zeros(buckets, "int64")
    found = placed.groupBy("bucket_").agg(F.count(F.lit(1)).alias("n"), F.sum(record_size("text_")).alias("size")).toArrow()
    at = found.column("bucket_").to_numpy()
    rows[at], sizes[at] = found.column("n").to_numpy(), found.column("size").to_numpy()
    return rows, sizes


def write_shards(docs: DataFrame, shards: int, path: str | None = None, seed: int = SEED, buckets: int | None = None, text: str = "text") -> str:
    """Shuffle all records and write them under `path` as (record, slot), partitioned by shard; slots count from 0 in each."""
    spark = docs.sparkSession
    path = path or work_dir(spark, "shards")
    if buckets is None:
        total = docs.agg(F.sum(record_size(text))).first()[0] or 0
        buckets = max(MIN_BUCKETS, -(-total // BUCKET_BYTES))
    placed, rows = scattered(docs, buckets, seed, text)
    before, total = np.cumsum(rows) - rows, int(rows.sum())
    schema = T.StructType([placed.schema["record"], T.StructField("shard", T.IntegerType()), T.StructField("slot", T.LongType())])

    def run(group: pa.Table) -> pa.Table:
        bucket = group.column("bucket_")[0].as_py()
        keys = pd.DataFrame({"id": group.column("id_").to_pandas(), "text": group.column("text_").to_pandas()})
        canonical = keys.sort_values(["id", "text"], kind="stable", na_position="first").index.to_numpy()
        order = canonical[fisher_yates(len(canonical), np.random.default_rng([seed, bucket]))]
        place = before[bucket] + np.arange(len(order), dtype="int64")
        # Shard s starts at ceil(s * total / shards).
        shard = place * shards // total
        start = -(-shard * total // shards)
        return pa.table({"record": group.column("record").take(pa.array(order)), "shard": pa.array(shard.astype("int32")), "slot": pa.array(place - start)})

    placed.groupBy("bucket_").applyInArrow(run, schema).write.partitionBy("shard").parquet(path)
    return path


def read_shards(spark: SparkSession, path: str, docs: DataFrame) -> DataFrame:
    """The written records with shard and slot; a column of docs with such a name is input_shard or input_slot."""
    schema = T.StructType([T.StructField("record", docs.schema), T.StructField("slot", T.LongType()), T.StructField("shard", T.IntegerType())])
    names = without(docs, ("shard", "slot")).columns
    return spark.read.schema(schema).parquet(path).select(*(F.col("record").getField(c).alias(to) for c, to in zip(docs.columns, names, strict=True)), "shard", "slot")


def shard_documents(docs: DataFrame, shards: int, text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard (null: the law isn't `key`) of every document, read from the written shards."""
    mine = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"))
    path = write_shards(mine, shards)
    return read_shards(docs.sparkSession, path, mine).select(
        "doc_id",
        record_size().alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )

