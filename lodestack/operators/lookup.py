"""Finding documents: by identifier, glob, list, path prefix; contexts of paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestack.functions.text import glob_regex

SCHEME = "doc://"


def uri() -> Column:
    return F.concat(F.lit(SCHEME), display_path())


def display_path() -> Column:
    return F.concat_ws("/", "collection", "path")


def docid(column: str = "hash") -> Column:
    return F.left(F.col(column), F.lit(6))


def by_identifier(docs: DataFrame, idents: DataFrame) -> DataFrame:
    """ident and the document (id, collection, path, hash) it names; none if nothing fits.

    After the scheme and a leading # are taken off: with a slash, an exact collection/path; else a hash prefix, or
    failing that an exact path in any collection. Of several, the first by collection and path. idents is a short
    list given by the caller.
    """
    asked = idents.select("ident", F.regexp_replace(F.regexp_replace("ident", f"^{SCHEME}", ""), "^#", "").alias("x")).withColumn("whole", F.contains("x", F.lit("/")))
    d = docs.select("id", "collection", "path", "hash")
    whole = d.join(F.broadcast(asked.filter("whole")), F.concat_ws("/", "collection", "path") == F.col("x")).withColumn("way", F.lit(0))
    prefix = d.join(F.broadcast(asked.filter("not whole and x <> ''")), F.col("hash").startswith(F.lower("x"))).withColumn("way", F.lit(1))
    path = d.join(F.broadcast(asked.filter("not whole")), F.col("path") == F.col("x")).withColumn("way", F.lit(2))
    row = F.struct("id", "collection", "path", "hash")
    best = whole.union(prefix).union(path).groupBy("ident").agg(F.min_by(row, F.struct("way", "collection", "path")).alias("d"))
    return best.select("ident", "d.*")


def by_glob(docs: DataFrame, pattern: str) -> DataFrame:
    """Documents whose URI, path or collection/path matches a glob with braces, by collection and path."""
    regex = glob_regex(pattern.removeprefix(SCHEME), braces=True, deep=False)
    test = F.col("path").rlike(regex) | display_path().rlike(regex)
    if pattern.startswith(SCHEME):
        test = display_path().rlike(regex)
    return docs.filter(test).orderBy("collection", "path")


def multi_get(docs: DataFrame, pattern: str, max_bytes: int = 10_240) -> DataFrame:
    """place, ident, id, path, status (ok, skipped, not_found) and body of a glob or a comma list; documents over max_bytes are skipped.

    The place is that in the list; a glob's rows share place 0 and come by collection and path.
    """
    spark = docs.sparkSession
    if any(c in pattern for c in "*?{"):
        found = by_glob(docs, pattern).select(F.lit(0).alias("place"), F.lit(pattern).alias("ident"), "id", "path", "body")
    else:
        idents = [x.strip() for x in pattern.split(",") if x.strip()]
        asked = spark.createDataFrame(list(enumerate(idents)), "place int, ident string")
        hit = by_identifier(docs, asked).select("ident", "id").join(docs.select("id", "path", "body"), "id")
        found = asked.join(hit, "ident", "left")
    big = F.octet_length("body") > max_bytes
    status = F.when(F.col("id").isNull(), "not_found").when(big, "skipped").otherwise("ok")
    return found.select("place", "ident", "id", "path", status.alias("status"), F.when(status == "ok", F.col("body")).alias("body"))


def pages(docs: DataFrame, pattern: str, max_bytes: int = 10_240, known: DataFrame | None = None) -> DataFrame:
    """place, docid, file, title, context, skipped, reason, body of what a multi-get finds, for the document sinks. known: contexts (id, context)."""
    got = multi_get(docs, pattern, max_bytes).filter("status <> 'not_found'").select("place", "id", "status", F.col("body").alias("shown"))
    rows = got.join(docs.select("id", "collection", "path", "title", "hash", "body"), "id")
    rows = rows.join(known, "id", "left") if known is not None else rows.withColumn("context", F.lit(None).cast("string"))
    size = F.floor(F.octet_length("body") / 1024)
    reason = F.concat(F.lit("File too large ("), size.cast("string"), F.lit(f"KB > {max_bytes // 1024}KB)"))
    return rows.select("place", docid().alias("docid"), display_path().alias("file"), "title", "context", (F.col("status") == "skipped").alias("skipped"), reason.alias("reason"), F.col("shown").alias("body"))


def under(docs: DataFrame, collection: str, prefix: str = "") -> DataFrame:
    """Documents of a collection at a path or below it."""
    p = prefix.rstrip("/")
    kept = docs.filter(F.col("collection") == collection)
    return kept if not p else kept.filter((F.col("path") == p) | F.col("path").startswith(p + "/"))


def scope(names: list[str] | str | None, excluded: list[str]) -> Column:
    """Which collections a search looks at: those named, or all but the excluded; an empty list is as none."""
    if isinstance(names, str):
        names = [names]
    if names:
        return F.col("collection").isin(*names)
    return ~F.col("collection").isin(*excluded) if excluded else F.lit(True)


def contexts(docs: DataFrame, prefixes: DataFrame) -> DataFrame:
    """id and context: the texts of all prefixes (collection, prefix, text) of a document's path, shortest first.

    A prefix is one of characters, so /foo also covers /foobar. The list of prefixes is written by hand and small.
    """
    p = prefixes.select(F.col("collection").alias("c"), "prefix", "text")
    path = F.concat(F.lit("/"), F.col("path"))
    hit = docs.select("id", "collection", "path").join(F.broadcast(p), (F.col("collection") == F.col("c")) & path.startswith(F.col("prefix")))
    ordered = F.array_sort(F.collect_list(F.struct(F.length("prefix").alias("n"), "prefix", "text")))
    return hit.groupBy("id").agg(F.array_join(F.transform(ordered, lambda x: x["text"]), "\n\n").alias("context"))


def containing(paths: DataFrame, collections: DataFrame) -> DataFrame:
    """file and the collection (name, root) with the longest root above it; null if none."""
    roots = collections.select("name", F.rtrim("root", F.lit("/")).alias("root"))
    hit = paths.join(F.broadcast(roots), (F.col("file") == F.col("root")) | F.col("file").startswith(F.concat("root", F.lit("/"))), "left")
    return hit.groupBy("file").agg(F.max_by("name", F.length("root")).alias("collection"))
