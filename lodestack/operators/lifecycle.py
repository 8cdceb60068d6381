"""The store's life: content addressing, incremental updates, tombstones, garbage, collections, status."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.functions.chunks import front_matter, metadata_values
from lodestack.functions.format import half_up_percent


def contents(docs: DataFrame) -> DataFrame:
    """hash and doc, one row a content. Copies meet as hashes with one text each, aggregated before they move."""
    return docs.groupBy("hash").agg(F.first("body").alias("doc"))


def scan_diff(existing: DataFrame, scanned: DataFrame) -> DataFrame:
    """collection, path, action, id of an update.

    existing: id, collection, path, title, hash, active; scanned: collection, path, title, hash. A file that was
    removed before and is back is reactivated under its old id.
    """
    a = existing.select("collection", "path", "id", "active", F.col("title").alias("old_title"), F.col("hash").alias("old_hash"))
    b = scanned.select("collection", "path", F.col("title").alias("new_title"), F.col("hash").alias("new_hash"))
    both = a.join(b, ["collection", "path"], "full_outer")
    action = (
        F.when(F.col("id").isNull(), "indexed")
        .when(F.col("new_hash").isNull() & F.col("active"), "removed")
        .when(F.col("new_hash").isNull(), "gone")
        .when(~F.col("active"), "reactivated")
        .when((F.col("old_hash") == F.col("new_hash")) & F.col("old_title").eqNullSafe(F.col("new_title")), "unchanged")
        .otherwise("updated")
    )
    return both.select("collection", "path", "id", action.alias("action"))


def apply_scan(existing: DataFrame, scanned: DataFrame, now: Column) -> DataFrame:
    """The next snapshot: id, collection, path, title, hash, created_at, modified_at, active. New rows get ids after the highest old one."""
    from pyspark.sql.window import Window

    diff = scan_diff(existing, scanned).select("collection", "path", "action")
    old = existing.select("collection", "path", "id", "created_at", "modified_at", F.col("title").alias("old_title"), F.col("hash").alias("old_hash"))
    new = scanned.select("collection", "path", "title", "hash")
    rows = diff.join(old, ["collection", "path"], "left").join(new, ["collection", "path"], "left")
    top = existing.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))
    # Only new rows are numbered, by path within a collection and the collections' offsets.
    fresh = rows.filter("action = 'indexed'")
    sizes = fresh.groupBy("collection").count()
    before = sizes.select("collection", (F.sum("count").over(Window.orderBy("collection")) - F.col("count")).alias("before"))
    numbered = fresh.select("collection", "path", F.row_number().over(Window.partitionBy("collection").orderBy("path")).alias("n")).join(F.broadcast(before), "collection")
    ids = numbered.crossJoin(F.broadcast(top)).select("collection", "path", (F.col("top") + F.col("before") + F.col("n")).alias("new_id"))
    seen = ~F.col("action").isin("removed", "gone")
    touched = F.col("action").isin("indexed", "updated", "reactivated")
    return rows.join(ids, ["collection", "path"], "left").select(
        F.coalesce("id", "new_id").alias("id"), "collection", "path", F.coalesce("title", "old_title").alias("title"), F.coalesce("hash", "old_hash").alias("hash"),
        F.coalesce("created_at", now).alias("created_at"), F.when(touched, now).otherwise(F.col("modified_at")).alias("modified_at"), seen.alias("active"),
    )


def orphans(content: DataFrame, docs: DataFrame) -> DataFrame:
    """Hashes that no active document has."""
    return content.select("hash").join(docs.filter("active").select("hash").distinct(), "hash", "left_anti")


def purge(docs: DataFrame) -> DataFrame:
    """Documents without the tombstones."""
    return docs.filter("active")


def representatives(docs: DataFrame) -> DataFrame:
    """hash and the smallest path of its active documents."""
    return docs.filter("active").groupBy("hash").agg(F.min("path").alias("path"))


def collection_stats(docs: DataFrame) -> DataFrame:
    return docs.filter("active").groupBy("collection").agg(F.count(F.lit(1)).alias("documents"), F.max("modified_at").alias("last_modified"))


def status(docs: DataFrame, vectors: DataFrame, pending: DataFrame) -> DataFrame:
    """One row: active documents, vectors, pending hashes and their share in per cent, and whether that is worth a warning."""
    d = docs.filter("active").agg(F.count(F.lit(1)).alias("documents"), F.countDistinct("hash").alias("contents"))
    out = d.crossJoin(vectors.agg(F.count(F.lit(1)).alias("vectors"))).crossJoin(pending.agg(F.count(F.lit(1)).alias("pending")))
    percent = half_up_percent(F.col("pending"), F.col("contents"))
    return out.withColumn("pending_percent", percent).withColumn("warn", percent >= 10)


def pending_metadata(docs: DataFrame, metadata: DataFrame, version: int) -> DataFrame:
    """Active documents without metadata (id, extraction_version, extraction_error) of this version that is free of errors."""
    ready = metadata.filter((F.col("extraction_version") == version) & F.col("extraction_error").isNull())
    return docs.filter("active").join(ready.select("id"), "id", "left_anti")


def sync_metadata(docs: DataFrame, metadata: DataFrame, version: int, now: Column, only_if_stale: bool = True) -> DataFrame:
    """The next metadata: id, metadata_json, extraction_version, extraction_error, extracted_at. docs: id, path, body.

    Documents without a row of this version (or, without only_if_stale, all) are read anew; their rows are replaced. A
    block that can't be read leaves no metadata and its error. Rows of other documents stay.
    """
    columns = ["id", "metadata_json", "extraction_version", "extraction_error", "extracted_at"]
    current = metadata.filter(F.col("extraction_version") == version)
    stale = docs.join(current.select("id"), "id", "left_anti") if only_if_stale else docs

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [front_matter(body or "", path or "") for path, body in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([json.dumps(m) for m, _ in found], pa.string()), pa.array([e for _, e in found], pa.string())], ["id", "metadata_json", "extraction_error"])

    new = stale.selectExpr("cast(id as bigint) id", "path", "body").mapInArrow(extract, "id long, metadata_json string, extraction_error string")
    new = new.withColumn("extraction_version", F.lit(version)).withColumn("extracted_at", now).select(columns)
    return metadata.join(stale.select("id"), "id", "left_anti").select(columns).unionByName(new)


def metadata_table(metadata: DataFrame) -> DataFrame:
    """id, key, ordinal, value_type, text_value, number_value, boolean_value of metadata (id, metadata_json): a row a value."""

    def values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, *v) for i, m in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for v in metadata_values(json.loads(m or "{}"))]
            kinds = (pa.int64(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.float64(), pa.bool_())
            columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["id", "key", "ordinal", "value_type", "text_value", "number_value", "boolean_value"])

    out = "id long, key string, ordinal int, value_type string, text_value string, number_value double, boolean_value boolean"
    return metadata.selectExpr("cast(id as bigint) id", "metadata_json").mapInArrow(values, out)


@dataclass
class Tables:
    """A store's tables: docs (id, collection, hash, active), content (hash), vectors (hash), metadata and values (id)."""

    docs: DataFrame
    content: DataFrame
    vectors: DataFrame
    metadata: DataFrame
    values: DataFrame

    def without_collection(self, name: str) -> Tables:
        """The tables after a collection is removed, with its documents' metadata and the contents and vectors that no active document has any more."""
        gone = self.docs.filter(F.col("collection") == name).select("id")
        kept = self.docs.filter(~F.col("collection").eqNullSafe(name))
        dead = orphans(self.content, kept)
        drop = lambda df, ids, key: df.join(ids, key, "left_anti")
        return Tables(kept, drop(self.content, dead, "hash"), drop(self.vectors, dead, "hash"), drop(self.metadata, gone, "id"), drop(self.values, gone, "id"))


def cleanup(docs: DataFrame, content: DataFrame) -> DataFrame:
    """What a clean-up would remove: kind, n."""
    gone = docs.agg(F.sum((~F.col("active")).cast("long")).alias("n")).select(F.lit("inactive_documents").alias("kind"), F.coalesce("n", F.lit(0)).alias("n"))
    return gone.union(orphans(content, docs).agg(F.count(F.lit(1)).alias("n")).select(F.lit("orphan_contents"), "n"))


@dataclass
class Catalog:
    """Collections and their contexts: a short list, as a table by frame()."""

    spark: SparkSession
    rows: list[dict]

    COLUMNS = "name string, root string, pattern string, ignore_patterns array<string>, include_by_default boolean, update_command string, context array<struct<prefix:string,text:string>>"

    def frame(self) -> DataFrame:
        return self.spark.createDataFrame([{**r} for r in self.rows], self.COLUMNS)

    def _row(self, name: str) -> dict:
        found = next((r for r in self.rows if r["name"] == name), None)
        if found is None:
            raise KeyError(f"no collection {name!r}")
        return found

    def add(self, name: str, root: str, pattern: str = "**/*.md", ignore: list[str] | None = None, update_command: str | None = None) -> None:
        if any(r["name"] == name or (r["root"], r["pattern"]) == (root, pattern) for r in self.rows):
            raise ValueError(f"collection {name!r} or its path and pattern are there already")
        self.rows.append({"name": name, "root": root, "pattern": pattern, "ignore_patterns": ignore or [], "include_by_default": True, "update_command": update_command, "context": []})

    def remove(self, name: str, docs: DataFrame) -> DataFrame:
        """The documents without the collection's."""
        self.rows.remove(self._row(name))
        return docs.filter(F.col("collection") != name)

    def rename(self, name: str, to: str, docs: DataFrame) -> DataFrame:
        if any(r["name"] == to for r in self.rows):
            raise ValueError(f"collection {to!r} is there already")
        self._row(name)["name"] = to
        return docs.withColumn("collection", F.when(F.col("collection") == name, to).otherwise(F.col("collection")))

    def include(self, name: str, by_default: bool) -> None:
        self._row(name)["include_by_default"] = by_default

    def set_update_command(self, name: str, command: str | None) -> None:
        self._row(name)["update_command"] = command

    def excluded(self) -> list[str]:
        return [r["name"] for r in self.rows if not r["include_by_default"]]

    def set_context(self, name: str, prefix: str, text: str | None) -> None:
        """Add, change or (null) remove the text of a path prefix."""
        row = self._row(name)
        row["context"] = [c for c in row["context"] if c["prefix"] != prefix] + ([{"prefix": prefix, "text": text}] if text else [])

    def contexts(self) -> DataFrame:
        return self.frame().select(F.col("name").alias("collection"), F.explode("context").alias("c")).select("collection", "c.*")
