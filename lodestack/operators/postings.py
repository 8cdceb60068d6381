"""The inverted index: postings, dictionary, lengths, statistics, and maintenance."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestack.functions.stem import stem
from lodestack.functions.text import tokens
from lodestack.sources.shared import shared_folder

#: Bytes of texts whose postings one task of an index sorts, about.
INDEX_BYTES = 16 << 20


def postings(docs: DataFrame, stemmed: bool = False) -> DataFrame:
    """id, field (title or body), pos, term of docs (id, title, body)."""
    fields = F.explode(F.array(F.struct(F.lit("title").alias("field"), F.col("title").alias("t")), F.struct(F.lit("body").alias("field"), F.col("body").alias("t"))))
    found = docs.select("id", fields.alias("f")).select("id", "f.field", F.posexplode(tokens(F.col("f.t"))).alias("pos", "term"))
    return stem_terms(found) if stemmed else found


def stem_terms(found: DataFrame) -> DataFrame:
    """Terms replaced by their stems; only the distinct terms pass through Python."""

    @F.pandas_udf(T.StringType())
    def stems(terms):
        return terms.map(stem)

    # As if it weren't deterministic, or a filter on stems would run it on every posting, each with its whole text.
    known = found.select("term").distinct().withColumn("stem", stems.asNondeterministic()("term"))
    return found.join(known, "term").withColumn("term", F.col("stem")).drop("stem").select(*found.columns)


def matching(docs: DataFrame, asked: Callable[[Column], Column]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Postings of the terms for which `asked` holds, lengths and statistics of docs (id, title, body).

    The texts are read and cut once, by this call; what is asked for and a length a document are kept in the shared
    folder.
    """

    def hits(field: str) -> Column:
        rows = F.transform(field, lambda x, i: F.struct(F.lit(field).alias("field"), i.alias("pos"), x.alias("term")))
        return F.filter(rows, lambda r: asked(r["term"]))

    found = docs.select("id", tokens(F.col("title")).alias("title"), tokens(F.col("body")).alias("body"))
    path = shared_folder(docs.sparkSession, "matching")
    found.select("id", (F.size("title") + F.size("body")).cast("long").alias("dl"), F.concat(hits("title"), hits("body")).alias("hits")).write.parquet(path)
    kept = docs.sparkSession.read.parquet(path)
    lengths = kept.groupBy("id").agg(F.sum("dl").alias("dl")).filter("dl > 0")
    return kept.select("id", F.explode("hits").alias("h")).select("id", "h.*"), lengths, statistics(kept, kept)


def document_lengths(post: DataFrame) -> DataFrame:
    return post.groupBy("id").agg(F.count(F.lit(1)).alias("dl"))


def token_counts(docs: DataFrame) -> DataFrame:
    """document_lengths of the postings of docs, without their rows."""
    n = (F.size(tokens(F.col("title"))) + F.size(tokens(F.col("body")))).cast("long")
    return docs.select("id", n.alias("dl")).groupBy("id").agg(F.sum("dl").alias("dl")).filter("dl > 0")


def dictionary(post: DataFrame) -> DataFrame:
    """term, df (documents), cf (occurrences). A term's documents are counted from per-document counts, so a frequent term is no single task's."""
    per_doc = post.groupBy("term", "id").agg(F.count(F.lit(1)).alias("n"))
    return per_doc.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("n").alias("cf"))


def statistics(docs: DataFrame, lengths: DataFrame) -> DataFrame:
    """One row: n documents and their average length (documents without tokens count)."""
    n = docs.agg(F.count(F.lit(1)).alias("n_docs"))
    return n.crossJoin(lengths.agg(F.coalesce(F.sum("dl"), F.lit(0)).alias("tokens"))).select("n_docs", (F.col("tokens") / F.col("n_docs")).alias("avgdl"))


def write_index(docs: DataFrame, path: str, stemmed: bool = False) -> None:
    """Postings sorted by term, lengths and statistics of docs under `path`, once for all searches.

    Files are ranges of (term, id), so a frequent term has several, and a search reads only those whose range holds its
    terms or prefixes. They are as many as the texts ask for, so none grows with them.
    """
    size = docs.agg(F.sum(F.octet_length("body").cast("long"))).first()[0] or 0
    files = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // INDEX_BYTES))
    post = postings(docs, stemmed)
    post.repartitionByRange(files, "term", "id").sortWithinPartitions("term", "id", "field", "pos").write.parquet(f"{path}/postings")
    token_counts(docs).write.parquet(f"{path}/lengths")
    statistics(docs, docs.sparkSession.read.parquet(f"{path}/lengths")).write.parquet(f"{path}/statistics")


def read_index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Postings, lengths and statistics of a stored index."""
    return tuple(spark.read.parquet(f"{path}/{name}") for name in ("postings", "lengths", "statistics"))


def refresh(post: DataFrame, changed: DataFrame, removed: DataFrame, stemmed: bool = False) -> DataFrame:
    """Postings after an update: those of changed (id, title, body) and removed (id) documents are replaced."""
    gone = changed.select("id").union(removed.select("id"))
    return post.join(gone, "id", "left_anti").unionByName(postings(changed, stemmed))
