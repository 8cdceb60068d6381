"""Shards depend on ids and texts, not on where rows stand; equal rows that fill a bucket are still spread."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from lodestack.llm import sharding


def test_long_texts_that_meet_by_chance_stay(spark):
    # Long texts make several buckets heavy that hold other rows too; every row is its own.
    docs = spark.range(0, 300, 1, 5).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 30 == 0, F.repeat(F.lit("x"), 50_000)).otherwise(F.lit("y")).alias("text"))
    mine = [sharding.scattered(d, 64, sharding.SEED, "text") for d in (docs, docs.repartition(3, "text", "doc_id"))]
    _, sizes = sharding.counted(mine[0][0], 64)
    assert ((sizes > sharding.HEAVY * sizes.mean()) & (mine[0][1] > 1)).any()
    one, two = ({(r["id_"], r["bucket_"]) for r in d.select("id_", "bucket_").collect()} for d, _ in mine)
    assert one == two


def test_equal_rows_are_spread(spark):
    docs = spark.range(0, 4000, 1, 5).select(F.when(F.col("id") < 2000, 7).otherwise(F.col("id")).alias("doc_id"), F.lit("some words").alias("text"))
    placed, rows = sharding.scattered(docs, 64, sharding.SEED, "text")
    assert rows.sum() == 4000 and rows.max() < 200
    found = np.zeros(64, "int64")
    for r in placed.filter("id_ = 7").groupBy("bucket_").count().collect():
        found[r["bucket_"]] = r["count"]
    assert found.sum() == 2000 and found.max() < 100
