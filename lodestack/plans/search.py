"""The hybrid query: keyword and vector lists of many queries, fused, reranked, cut, in one lazy plan."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestack.functions.chunks import QUERY_SIZES, chunk_table, intent_terms, query_terms, snippet
from lodestack.operators import bm25, fusion, vectors
from lodestack.operators.lookup import display_path, docid


@dataclass
class Query:
    """One query: its text, its vector (from an embedder), what it is for, and an expander's parts (type, text, vector)."""

    text: str
    vector: list[float] | None = None
    intent: str | None = None
    parts: list[tuple[str, str, list[float] | None]] = field(default_factory=list)


def ranked_lists(post: DataFrame | None, docs: DataFrame, embedded: DataFrame, queries: dict[str, Query], depth: int = fusion.CANDIDATES, eligible: DataFrame | None = None) -> DataFrame:
    """query_id, list_idx, rank from 0, file (id), weight. List 0 is the vector list, 1 the keyword list; an expansion's lists follow.

    post: see bm25.scores(). With a strong keyword hit the lists of the expansion are left out, by a flag in the plan and not a collected row.
    """
    spark = docs.sparkSession
    texts, vecs, weights = {}, [], []
    for q, x in queries.items():
        lists = [("vec", x.text, x.vector), ("lex", x.text, None), *x.parts]
        for i, (kind, text, vector) in enumerate(lists):
            name = f"{q}\x1f{i}"
            weights.append((name, q, i, fusion.ORIGINAL if i < 2 else fusion.EXPANDED))
            if kind == "lex":
                texts[name] = text
            elif vector is not None:
                vecs.append((name, [float(v) for v in vector]))
    search = bm25.search(post, docs, texts, depth, eligible).select("query_id", "rank", "id", "score")
    # A vector without a document takes no candidate's place.
    pool = embedded.join((docs if eligible is None else eligible).select("id"), "id", "left_semi")
    near = vectors.nearest(pool, spark.createDataFrame(vecs, "query_id string, embedding array<double>"), depth)
    near = near.select("query_id", "rank", "id", F.greatest(F.lit(0.0), 1 - F.col("distance") / 2).alias("score"))
    named = spark.createDataFrame(weights, "name string, q string, list_idx int, weight double")
    lists = search.unionByName(near).withColumnRenamed("query_id", "name").join(F.broadcast(named), "name")
    lists = lists.select(F.col("q").alias("query_id"), "list_idx", (F.col("rank") - 1).alias("rank"), F.col("id").alias("file"), "weight", "score")
    if not any(x.parts for x in queries.values()):
        return lists
    intents = spark.createDataFrame([(q, bool(x.intent)) for q, x in queries.items()], "query_id string, has_intent boolean")
    probe = lists.filter("list_idx = 1").select("query_id", (F.col("rank") + 1).alias("rank"), "score").join(F.broadcast(intents), "query_id")
    strong = fusion.strong_signal(probe).join(F.broadcast(intents), "query_id").select("query_id", (F.col("strong") & ~F.col("has_intent")).alias("strong"))
    return lists.join(strong, "query_id", "left").filter(~F.coalesce("strong", F.lit(False)) | (F.col("list_idx") < 2)).drop("strong")


#: (what is asked, chunk text) -> score in [0, 1], as columns: an expression, or a pandas UDF that holds a model.
Reranker = Callable[[Column, Column], Column]


def hybrid(post: DataFrame | None, docs: DataFrame, embedded: DataFrame, queries: dict[str, Query], limit: int = 10, min_score: float = 0.0, rerank: Reranker | None = fusion.term_share, depth: int = fusion.CANDIDATES, eligible: DataFrame | None = None) -> DataFrame:
    """query_id, rank, file (id), rrf, score, pos of the best `limit` documents of each query. docs: id, body, ... ; embedded: id, embedding; post: see bm25.scores().

    Only the best chunk of a candidate, at its place `pos`, goes to the reranker, below the query's intent and the
    query itself; without a reranker the fused place decides.
    """
    spark = docs.sparkSession
    fused = fusion.reciprocal_rank_fusion(ranked_lists(post, docs, embedded, queries, depth, eligible), depth)
    rows = [(q, query_terms(x.text), intent_terms(x.intent), f"{x.intent}\n\n{x.text}" if x.intent else x.text) for q, x in queries.items()]
    terms = spark.createDataFrame(rows, "query_id string, terms array<string>, intent_terms array<string>, asked string")
    # At most `depth` candidates a query go to the documents, which stay where they are; each is cut once, however many queries want it.
    wanted = docs.join(F.broadcast(fused.select(F.col("file").alias("id")).distinct()), "id", "left_semi")
    pieces = chunk_table(wanted.select("id", F.coalesce("body", F.lit("")).alias("body")), QUERY_SIZES, empty=True).withColumnRenamed("id", "file")
    # The queries' own texts, which came through the driver.
    chosen = fusion.best_chunk(fused.join(F.broadcast(terms), "query_id").join(pieces, "file"))
    scored = fusion.blend(chosen, rerank(F.col("asked"), F.col("text")) if rerank else None)
    return fusion.finalise(scored.select("query_id", "file", "rrf", "rank", "score", "pos"), limit, min_score).select("query_id", F.col("place").alias("rank"), "file", "rrf", "score", "pos")


def result_rows(found: DataFrame, docs: DataFrame, queries: dict[str, Query], contexts: DataFrame | None = None, values: DataFrame | None = None) -> DataFrame:
    """Search results as a user sees them: query_id, rank, id, docid, file (collection/path), title, score, context, metadata, line, snippet, body.

    found: query_id, rank, file (id), score and, of a hybrid query, pos: a search's limit a query, so it goes to the
    documents, which stay where they are. contexts: id, context; values: id, values.
    """
    spark = docs.sparkSession
    words = spark.createDataFrame([(q, x.text.lower().split(), intent_terms(x.intent)) for q, x in queries.items()], "query_id string, terms array<string>, intent_terms array<string>")
    rows = F.broadcast(found.withColumnRenamed("file", "id")).join(docs.select("id", "collection", "path", "title", "hash", "body"), "id").join(F.broadcast(words), "query_id")
    rows = rows.join(contexts, "id", "left") if contexts is not None else rows.withColumn("context", F.lit(None).cast("string"))
    rows = rows.join(values.select("id", F.col("values").alias("metadata")), "id", "left") if values is not None else rows.withColumn("metadata", F.lit(None).cast("string"))
    at = F.col("pos") if "pos" in found.columns else None
    rows = rows.withColumn("shown", snippet(F.col("body"), F.col("terms"), F.col("intent_terms"), at))
    return rows.select("query_id", "rank", "id", docid().alias("docid"), display_path().alias("file"), "title", "score", "context", "metadata", F.col("shown.line").alias("line"), F.col("shown.text").alias("snippet"), "body")
