"""Incremental postings from a stream of files: an extension of the batch update for folders that keep growing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from lodestack.operators.postings import postings


def stream_postings(spark: SparkSession, source: str, schema: str, out: str, checkpoint: str) -> StreamingQuery:
    """Postings of every new parquet file of documents (id, title, body) under `source`, appended to `out` once each.

    A batch is written to a folder of its number and replaced if it runs again, so a restart repeats nothing.
    """

    def write(batch: DataFrame, number: int) -> None:
        postings(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return spark.readStream.schema(schema).parquet(source).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
