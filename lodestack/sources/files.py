"""Documents from folders of files."""

from __future__ import annotations

import os

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.functions.text import glob_regex, split_masks, title

#: Folders that are never searched.
SKIPPED = ("node_modules", ".git", ".cache", "vendor", "dist", "build")


def included(path: Column, mask: str, ignore: list[str] | None = None) -> Column:
    """Whether a relative path fits the mask and isn't hidden, in a skipped folder or ignored (there `*` crosses slashes)."""
    fits = F.lit(False)
    for m in split_masks(mask):
        fits = fits | path.rlike(glob_regex(m))
    parts = F.split(path, "/")
    hidden = F.exists(parts, lambda p: p.startswith("."))
    folders = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    skipped = F.arrays_overlap(folders, F.array(*map(F.lit, SKIPPED)))
    test = fits & ~hidden & ~skipped
    for pattern in ignore or []:
        crossing = "".join({"*": ".*", "?": "."}.get(c) or (c if c in "[]" or c.isalnum() else "\\" + c) for c in pattern)
        test = test & ~path.rlike(f"(?s)^{crossing}$")
    return test


def scan(spark: SparkSession, root: str, collection: str, mask: str = "**/*.md", ignore: list[str] | None = None) -> DataFrame:
    """collection, path, title, hash, body, modified_at, skipped of the files under root.

    `skipped` says why a file has no body (invalid UTF-8, or a link that leads out of the root: links are only known to
    local file systems); blank files are as if they weren't there. Line ends become \\n before hashing.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = root.rstrip("/").split("://")[-1]
    relative = F.regexp_replace(F.regexp_replace("path", "^[a-z]+:/*", "/"), "^/*" + _quoted(base.lstrip("/")) + "/", "")
    found = files.select(relative.alias("path"), F.col("modificationTime").alias("modified_at"), "content", _outside(spark, root).alias("outside")).filter(included(F.col("path"), mask, ignore))
    valid = F.is_valid_utf8(F.col("content").cast("string"))
    body = F.when(valid & ~F.col("outside"), F.regexp_replace(F.col("content").cast("string"), "\r\n?", "\n"))
    out = found.select(F.lit(collection).alias("collection"), "path", body.alias("body"), "modified_at", F.when(F.col("outside"), "OUTSIDE_COLLECTION").when(~valid, "UnicodeDecodeError").alias("skipped"))
    kept = out.filter(F.col("skipped").isNotNull() | F.col("body").rlike(r"\S"))
    return kept.select("collection", "path", F.when(F.col("skipped").isNull(), title(F.col("body"), F.col("path"))).alias("title"), F.sha2("body", 256).alias("hash"), "body", "modified_at", "skipped")


def _outside(spark: SparkSession, root: str) -> Column:
    """Whether a file's real path isn't under the real root; never where the file system isn't a local one."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).getUri().getScheme() != "file":
        return F.lit(False)
    real = os.path.realpath(path.toUri().getPath())

    @F.pandas_udf("boolean")
    def leads_out(paths: pd.Series) -> pd.Series:
        return paths.map(lambda p: os.path.commonpath([real, os.path.realpath("/" + p.removeprefix("file:").lstrip("/"))]) != real)

    return leads_out("path")


def _quoted(text: str) -> str:
    return "".join(c if c.isalnum() or c in "/_-" else "\\" + c for c in text)


def bench_fixture(spark: SparkSession, path: str) -> DataFrame:
    """id, query, type, description, expected_files, expected_in_top_k of a fixture file; raises if a field lacks or a query is structured."""
    schema = "description string, version int, collection string, queries array<struct<id:string,query:string,type:string,description:string,expected_files:array<string>,expected_in_top_k:int>>"
    rows = spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("queries").alias("q")).select("q.*")
    bad = rows.filter("id is null or query is null or expected_files is null or expected_in_top_k is null or query rlike '(?m)^(lex|vec|hyde|intent):'")
    if (first := bad.first()) is not None:
        raise ValueError(f"bad query in the fixture: {first['id'] or first['query']}")
    return rows


def qrels(spark: SparkSession, path: str) -> DataFrame:
    """query_id, file, score of a tab-separated file; a missing score is 1."""
    rows = spark.read.csv(path, sep="\t", header=True)
    score = F.col("score").cast("int") if "score" in rows.columns else F.lit(1)
    return rows.select(F.col("query-id").alias("query_id"), F.col("corpus-id").alias("file"), F.coalesce(score, F.lit(1)).alias("score"))


def beir_corpus(spark: SparkSession, path: str) -> DataFrame:
    """_id and markdown (`# title`, blank line, text) of a JSON-lines corpus."""
    rows = spark.read.schema("_id string, title string, text string").json(path)
    return rows.select("_id", F.concat(F.lit("# "), F.coalesce("title", F.lit("")), F.lit("\n\n"), F.coalesce("text", F.lit("")), F.lit("\n")).alias("markdown"))
