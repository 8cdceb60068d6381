"""A corpus pipeline over `documents`: score and drop poor documents, apply quality rules, drop near-duplicates, pack.

Each stage gets all documents that the one before kept, whole, and returns the columns of documents; the last one
returns the packed pieces. Stages are written as Parquet and read again, so a lost executor costs a part of one stage.
Nulls and empty texts fail the quality rules; rows with equal words are near-duplicates of each other.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestack.llm import near_dedup, packing, quality_model, quality_rules
from lodestack.llm.common import documents, labels, staged


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier scores at its threshold or higher."""
    documents(spark, sf_dir)  # short Arrow batches
    return quality_model.filter_documents(docs, labels(spark, sf_dir))


def keep_by_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule and the risk-controlled cutoffs keep."""
    documents(spark, sf_dir)
    return quality_rules.filter_documents(docs, labels(spark, sf_dir))


def keep_distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates."""
    documents(spark, sf_dir)
    return near_dedup.representatives(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents with their places in sequences."""
    documents(spark, sf_dir)
    return packing.pack_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", keep_good),
    ("quality_rules", keep_by_rules),
    ("near_dedup", keep_distinct),
    ("packing", pack),
]

#: The classifier's fit, the signatures and the tokenizer can't be expressed in SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn over documents."""
    docs = documents(spark, sf_dir)
    for n, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n + 1 < len(STAGES):
            docs = staged(docs, name)
    return docs
