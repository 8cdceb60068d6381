"""What bounds the memory of an executor: one Python worker a task, short batches, no memo that a stage left behind."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F

from lodestack.llm import common, near_dedup, tokens


def test_representatives_run_python_once(docs):
    plan = near_dedup.representatives(docs)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_batches_are_bounded_in_bytes(spark, tmp_path):
    spark.range(0, 300, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), 100_000).alias("text")).write.parquet(f"{tmp_path}/documents.parquet")

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], ["n", "bytes"])

    got = common.documents(spark, str(tmp_path)).mapInArrow(sizes, "n long, bytes long").collect()
    assert sum(r["n"] for r in got) == 300
    assert max(r["bytes"] for r in got) <= common.BATCH_BYTES + 200_000


def test_an_encoder_is_dropped_by_the_next_operator(monkeypatch):
    monkeypatch.setattr(tokens, "_ENCODER", {"a": object()})
    assert list(common.trimmed(lambda b: b, encodes=True)(iter([1]))) == [1]
    assert tokens._ENCODER
    assert list(common.trimmed(lambda b: b)(iter([1]))) == [1]
    assert not tokens._ENCODER


def test_parquet_is_read_in_short_batches(spark, tmp_path):
    # 4096 texts of 400 kB are a batch of 1.6 GB, more than a small executor's heap.
    spark.conf.unset("spark.sql.parquet.columnarReaderBatchSize")
    spark.range(0, 2000, 1, 1).select(F.col("id").alias("doc_id"), F.lit("x").alias("text")).write.parquet(f"{tmp_path}/documents.parquet")
    docs = common.documents(spark, str(tmp_path))
    assert int(spark.conf.get("spark.sql.parquet.columnarReaderBatchSize")) <= common.READ_ROWS
    assert docs.count() == 2000
