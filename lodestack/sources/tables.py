"""The given tables as a document store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, collection (language), path (source/id.md), title (source), body, hash. Hash is over the UTF-8 text."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("id"), F.col("lang").alias("collection"), F.concat(F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), F.col("source").alias("title"), F.col("text").alias("body"), F.sha2("text", 256).alias("hash"))


def with_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with typed metadata values: source, lang and n_chars, and quality and toxic where labelled."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    both = d.join(table(spark, sf_dir, "labels"), "doc_id", "left")
    none = lambda t: F.lit(None).cast(t)

    def value(key: str, ordinal: int, kind: str, col):
        return F.when(col.isNotNull(), F.struct(
            F.lit(key).alias("key"), F.lit(ordinal).alias("ordinal"), F.lit(kind).alias("value_type"), (col if kind == "string" else none("string")).alias("text_value"),
            (col.cast("double") if kind == "number" else none("double")).alias("number_value"), (col if kind == "boolean" else none("boolean")).alias("boolean_value"),
        ))

    values = F.array_compact(F.array(
        value("source", 0, "string", F.col("source")), value("tags", 0, "string", F.col("lang")), value("tags", 1, "string", F.col("source")),
        value("n_chars", 0, "number", F.col("n_chars")), value("quality", 0, "number", F.col("quality")), value("toxic", 0, "boolean", F.col("toxic") == 1),
    ))
    return both.select(F.col("doc_id").alias("id"), values.alias("values"))
