"""Exact vector search: cosine top-k with numpy a batch at a time, chunks to documents, embedding bookkeeping."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestack.functions.chunks import chunk_table

#: Query vectors that are compared at once: a block of them travels with each copy of the vectors' tasks.
QUERY_BLOCK = 10_000
#: Of these, so many meet a batch of vectors at once, and as few as make so many distances.
TOGETHER, DISTANCES = 500, 1 << 20
#: Fixed value: neighbours that an over-fetching search asks for at most.
MOST_NEAREST = 4096


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine as an expression, in double."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return 1 - dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def nearest(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, id, distance: the k nearest rows of vectors (id, embedding) to each of queries (query_id, embedding).

    Every batch keeps its own k nearest, so the shuffle sees k rows a query and batch. Null and zero vectors are no
    one's neighbours. The query vectors pass the driver and the vectors in blocks of QUERY_BLOCK.
    """
    mine = vectors.selectExpr("cast(id as bigint) id", "embedding").filter("embedding is not null")
    rows = queries.select("query_id", "embedding").filter("embedding is not null").toLocalIterator()
    found = None
    while (block := list(itertools.islice(rows, QUERY_BLOCK))) or found is None:
        part = _partial(mine, block, k)
        found = part if found is None else found.union(part)
    order = Window.partitionBy("query_id").orderBy(F.round("distance", 9), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "id", "distance")


def _partial(vectors: DataFrame, rows: list[Row], k: int) -> DataFrame:
    """query_id, id, distance: what each batch of vectors keeps for the queries of a block."""
    names = [r["query_id"] for r in rows]
    unit = _unit(np.array([r["embedding"] for r in rows], dtype="float64")) if rows else np.empty((0, 0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            if not len(ids) or not len(names):
                continue
            x = np.asarray(batch.column(1).flatten().to_numpy(zero_copy_only=False), dtype="float64").reshape(len(ids), -1)
            size = np.linalg.norm(x, axis=1)
            ids, x = ids[size > 0], x[size > 0]
            if not len(ids):
                continue
            x = _unit(x).T
            together = max(1, min(TOGETHER, DISTANCES // len(ids)))
            for at in range(0, len(names), together):
                d = 1 - unit[at : at + together] @ x
                best = np.argpartition(d, min(k, d.shape[1]) - 1, axis=1)[:, :k] if d.shape[1] > k else np.tile(np.arange(d.shape[1]), (len(d), 1))
                # Ties with the k-th nearest are all kept; the window breaks them by id.
                worst = np.take_along_axis(d, best, 1).max(axis=1)
                q, j = np.nonzero(d <= worst[:, None] + 1e-12)
                yield pa.RecordBatch.from_arrays([pa.array([names[at + i] for i in q]), pa.array(ids[j]), pa.array(d[q, j])], ["query_id", "id", "distance"])

    return vectors.mapInArrow(run, "query_id string, id long, distance double")


def _unit(x: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(size > 0, size, 1)


def best_chunks(found: DataFrame, chunks: DataFrame, limit: int) -> DataFrame:
    """query_id, rank, doc_id, seq, distance, score: each document by its nearest chunk; chunks maps id to doc_id and seq."""
    each = found.join(chunks.select("id", "doc_id", "seq"), "id")
    best = each.groupBy("query_id", "doc_id").agg(F.min_by(F.struct("distance", "seq"), F.struct(F.round("distance", 9), "seq")).alias("b"))
    scored = best.select("query_id", "doc_id", "b.seq", "b.distance", F.greatest(F.lit(0.0), 1 - F.col("b.distance") / 2).alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "doc_id")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)


def overfetched(vectors: DataFrame, queries: DataFrame, chunks: DataFrame, limit: int, eligible: DataFrame | None = None) -> DataFrame:
    """best_chunks of the `limit` * 3 nearest vectors (* 30 with eligible documents, doc_id; MOST_NEAREST at most), which are filtered after that cut.

    So a query can get fewer than `limit` documents. Without that: eligible vectors go into nearest(), with no cut.
    """
    found = nearest(vectors, queries, max(1, min(MOST_NEAREST, limit * (3 if eligible is None else 30))))
    mine = chunks if eligible is None else chunks.join(eligible.select("doc_id"), "doc_id", "left_semi")
    return best_chunks(found, mine, limit)


def document_input(title: Column, text: Column) -> Column:
    """What is embedded for a chunk."""
    return F.concat(F.lit("title: "), F.coalesce(F.nullif(title, F.lit("")), F.lit("none")), F.lit(" | text: "), text)


def query_input(text: Column) -> Column:
    return F.concat(F.lit("task: search result | query: "), text)


def fingerprint(*parts: str) -> Column:
    """Six hex digits that change with model, sizes or input format."""
    return F.left(F.sha2(F.lit("\n".join(parts)), 256), F.lit(6))


def pending(contents: DataFrame, chunk_vectors: DataFrame, current: Column) -> DataFrame:
    """Hashes of contents (hash) without vectors, with some missing or of another fingerprint; chunk_vectors: hash, seq, fingerprint, total_chunks."""
    have = chunk_vectors.groupBy("hash").agg(F.count(F.lit(1)).alias("n"), F.max("total_chunks").alias("total"), F.min((F.col("fingerprint") == current).cast("int")).alias("fresh"))
    return contents.select("hash").distinct().join(have, "hash", "left").filter("n is null or n < total or fresh = 0").select("hash")


def embed_contents(contents: DataFrame, stored: DataFrame, embed: Callable[[Column], Column], current: str, force: bool = False) -> DataFrame:
    """The stored chunk vectors (hash, seq, pos, embedding, fingerprint, total_chunks) after an update.

    contents: hash, title, body, a row a hash. All vectors of a hash are written anew if its chunks' places, or the
    fingerprint of one, aren't the present ones (or by `force`); the rest stay and are not embedded again. embed: the
    input texts' vectors as a column, such as a pandas UDF that holds a model. Vectors of other hashes stay.
    """
    pieces = chunk_table(contents.select(F.col("hash").alias("id"), "body")).withColumnRenamed("id", "hash")
    places = lambda df, *more: df.groupBy("hash").agg(F.sort_array(F.collect_list("pos")).alias("places"), *more)
    have = places(stored, F.min((F.col("fingerprint") == current).cast("int")).alias("fresh")).withColumnRenamed("places", "old")
    want = places(pieces).join(have, "hash", "left")
    stale = (want if force else want.filter(~(F.col("places").eqNullSafe(F.col("old")) & F.coalesce(F.col("fresh") == 1, F.lit(False))))).select("hash", F.size("places").alias("total_chunks"))
    new = pieces.join(stale, "hash").join(contents.select("hash", "title"), "hash")
    new = new.select("hash", "seq", "pos", embed(document_input(F.col("title"), F.col("text"))).alias("embedding"), F.lit(current).alias("fingerprint"), "total_chunks")
    return clear(stored.select(*new.columns), stale).unionByName(new)


def clear(chunk_vectors: DataFrame, hashes: DataFrame) -> DataFrame:
    return chunk_vectors.join(hashes.select("hash"), "hash", "left_anti")
