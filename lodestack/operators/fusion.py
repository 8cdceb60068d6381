"""Fusing ranked lists, blending with a reranker, best chunks."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

K = 60
ORIGINAL, EXPANDED = 2.0, 1.0
STRONG, GAP = 0.85, 0.15
CANDIDATES = 40


def reciprocal_rank_fusion(lists: DataFrame, limit: int | None = None) -> DataFrame:
    """query_id, file, rrf, rank of lists (query_id, list_idx, rank from 0, file, weight).

    A sum of weight / (K + rank + 1), and a bonus for a best rank of 0 or up to 2. Ties stand in first-seen order. A
    file that occurs twice in a list counts with each place.
    """
    seen = F.min(F.struct("list_idx", "rank")).alias("seen")
    fused = lists.groupBy("query_id", "file").agg(F.sum(F.col("weight") / (K + F.col("rank") + 1)).alias("s"), F.min("rank").alias("best"), seen)
    bonus = F.when(F.col("best") == 0, 0.05).when(F.col("best") <= 2, 0.02).otherwise(0.0)
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("rrf", 12)), "seen", "file")
    out = fused.withColumn("rrf", F.col("s") + bonus).withColumn("rank", F.row_number().over(order))
    return (out.filter(F.col("rank") <= limit) if limit else out).select("query_id", "file", "rrf", "rank")


def strong_signal(probe: DataFrame, has_intent: Column | None = None) -> DataFrame:
    """query_id, top, second, strong from the keyword results (query_id, rank from 1, score): no expansion is needed."""
    two = probe.filter("rank <= 2").groupBy("query_id").agg(F.max("score").alias("top"), F.coalesce(F.max(F.when(F.col("rank") == 2, F.col("score"))), F.lit(0.0)).alias("second"))
    strong = (F.col("top") >= STRONG) & (F.col("top") - F.col("second") >= GAP)
    return two.withColumn("strong", strong if has_intent is None else strong & ~has_intent)


def blend(fused: DataFrame, rerank: Column | None) -> DataFrame:
    """score: mean of the fused score over its query's highest and the reranker's; without one, 1 / place."""
    if rerank is None:
        return fused.withColumn("score", 1 / F.col("rank"))
    top = F.max("rrf").over(Window.partitionBy("query_id"))
    return fused.withColumn("score", (F.col("rrf") / top + rerank) / 2)


def blend_by_place(place: Column, rerank: Column) -> Column:
    """Another blend: the weight of the place falls from 0.75 to 0.6 after three and to 0.4 after ten."""
    w = F.when(place <= 3, 0.75).when(place <= 10, 0.6).otherwise(0.4)
    return w / place + (1 - w) * rerank


def calibrated(x: Column, shift: float, spread: float) -> Column:
    return 1 / (1 + F.exp(-(x - shift) / spread))


def term_share(asked: Column, text: Column) -> Column:
    """A stand-in reranker: the share of the words of over two characters of what is asked that occur in the text."""
    terms = F.filter(F.split(F.lower(asked), r"\s+"), lambda w: F.length(w) > 2)
    n = F.size(terms)
    return F.when(n > 0, F.size(F.filter(terms, lambda t: F.contains(F.lower(text), t))) / n).otherwise(F.lit(0.0))


def best_chunk(chunks: DataFrame) -> DataFrame:
    """The best row of each (query_id, file) of chunks (query_id, file, seq, pos, text, terms, intent_terms): terms count 1, intent terms half, the first of equals."""
    count = lambda terms, low: F.size(F.filter(terms, lambda t: F.contains(low, t)))
    low = F.transform(F.array(F.lower("text")), lambda x: count(F.col("terms"), x) + 0.5 * count(F.coalesce("intent_terms", F.expr("cast(array() as array<string>)")), x))
    scored = chunks.withColumn("chunk_score", low[0])
    order = Window.partitionBy("query_id", "file").orderBy(F.desc("chunk_score"), "seq")
    return scored.withColumn("r", F.row_number().over(order)).filter("r = 1").drop("r")


def expansion_parts(lines: str, query: str) -> list[tuple[str, str]]:
    """(type, text) of an expander's lines: those that share a word with the query, or else three made from it; never the query itself."""
    found = [(m[1], m[2].strip()) for m in re.finditer(r"^(lex|vec|hyde):[ \t]*(.+)$", lines, re.M)]
    words = re.findall(r"\w+", query.lower())
    found = [p for p in found if p[1] and any(w in p[1].lower() for w in words)]
    found = found or [("hyde", f"Information about {query}"), ("lex", query), ("vec", query)]
    return [p for p in found if p[1] != query]


def well_formed(lines: Column) -> Column:
    """Whether an expander kept to the grammar."""
    return lines.rlike(r"\A(?:(?:lex|vec|hyde): [^\n]+\n)+\z")


def expansion_seed(*parts: Column) -> Column:
    return F.conv(F.left(F.sha2(F.concat_ws("\n", *parts), 256), F.lit(8)), 16, 10).cast("long")


def finalise(scored: DataFrame, limit: int, min_score: float = 0.0) -> DataFrame:
    """One row a file, a threshold, then the best `limit`; ties by the fused place."""
    one = Window.partitionBy("query_id", "file").orderBy("rank")
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 12)), "rank")
    kept = scored.withColumn("d", F.row_number().over(one)).filter((F.col("d") == 1) & (F.col("score") >= min_score))
    return kept.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= limit).drop("d")
