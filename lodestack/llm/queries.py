"""The queries op1_ to op10_ and the pipeline: each operator, with its production parameters, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestack.llm import bpe, fingerprint, license_scan, near_dedup, packing, quality_model, quality_rules, sharding, token_store, toxicity
from lodestack.llm.common import documents, labels

SHARDS = 40


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest_documents(documents(spark, sf_dir))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.apply_rules(documents(spark, sf_dir), labels(spark, sf_dir))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op3_invertible_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.compare_documents(documents(spark, sf_dir))


def op4_external_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(documents(spark, sf_dir), SHARDS)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(documents(spark, sf_dir), labels(spark, sf_dir))


def op6_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.score_documents(documents(spark, sf_dir), labels(spark, sf_dir))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(documents(spark, sf_dir))


def op8_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.read_digests(spark, token_store.write(documents(spark, sf_dir)))


def op9_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir))


def op10_bag_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.classes(documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_byte_bpe, op2_quality_rules, op3_invertible_sketch, op4_external_shuffle, op5_toxicity, op6_quality_model, op7_license_scan, op8_token_store, op9_pattern_packing, op10_bag_minhash)
}
ORACLES: dict[str, str] = {
    "op2_quality_rules": quality_rules.oracle_sql(),
    "op7_license_scan": license_scan.oracle_sql(),
    "op10_bag_minhash": near_dedup.oracle_sql(),
}
