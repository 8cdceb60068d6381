"""Retrieval metrics over ranked lists, for all queries at once; statistics of repeated runs; bootstrap intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def shared_sets(queries: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(query_id, relevant_set) and (relevant_set, file) where a query's relevant files are those of its groups: queries (query_id, group), files (group, file).

    Queries of the same groups share one set, so no pair of a query and a file is listed: as many rows as were given, not their product.
    """
    of_query = queries.filter("group is not null").groupBy("query_id").agg(F.sort_array(F.collect_set("group")).alias("relevant_set"))
    each = of_query.select("relevant_set").distinct().select("relevant_set", F.explode("relevant_set").alias("group"))
    return of_query, files.join(each, "group").select("relevant_set", "file").distinct()


def credited(ranked: DataFrame, relevant: DataFrame, sets: DataFrame | None = None) -> DataFrame:
    """ranked (query_id, rank from 1, file) with `hit`: the file is relevant (query_id, file) and seen for the first time. With sets (relevant_set, file), relevant is query_id, relevant_set."""
    first = Window.partitionBy("query_id", "file").orderBy("rank")
    seen, keys = ranked.withColumn("n", F.row_number().over(first)), ["query_id", "file"]
    if sets is not None:
        seen, relevant, keys = seen.join(relevant.select("query_id", "relevant_set"), "query_id", "left"), sets, ["relevant_set", "file"]
    marks = relevant.select(*keys).distinct().withColumn("rel", F.lit(True))
    return seen.join(marks, keys, "left").withColumn("hit", F.coalesce(F.col("rel") & (F.col("n") == 1), F.lit(False)))


def per_query(ranked: DataFrame, relevant: DataFrame, k: int, sets: DataFrame | None = None) -> DataFrame:
    """query_id, n_relevant, reciprocal_rank, recall, precision, f1, ndcg (the last four at k) of every query with relevant files. sets: see credited()."""
    hits = credited(ranked, relevant, sets)
    top = F.col("hit") & (F.col("rank") <= k)
    found = hits.groupBy("query_id").agg(
        F.max(F.when(F.col("hit"), 1 / F.col("rank"))).alias("rr"),
        F.sum(top.cast("int")).alias("n_hits"),
        F.sum(F.when(top, 1 / F.log2(F.col("rank") + 1)).otherwise(0.0)).alias("dcg"),
    )
    key = "query_id" if sets is None else "relevant_set"
    wanted = (relevant if sets is None else sets).groupBy(key).agg(F.countDistinct("file").alias("n_relevant"))
    wanted = wanted if sets is None else relevant.join(wanted, key).select("query_id", "n_relevant")
    n = F.least(F.lit(k), F.col("n_relevant"))
    ideal = F.aggregate(F.sequence(F.lit(1), n.cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    out = wanted.join(found, "query_id", "left").withColumn("h", F.coalesce("n_hits", F.lit(0)))
    recall, precision = F.col("h") / F.col("n_relevant"), F.col("h") / n
    both = recall + precision
    return out.select(
        "query_id", "n_relevant", F.coalesce("rr", F.lit(0.0)).alias("reciprocal_rank"), recall.alias("recall"), precision.alias("precision"),
        F.when(both > 0, 2 * recall * precision / both).otherwise(F.lit(0.0)).alias("f1"), (F.coalesce("dcg", F.lit(0.0)) / ideal).alias("ndcg"),
    )


def means(each: DataFrame, by: list[str] | None = None) -> DataFrame:
    return each.groupBy(*(by or [])).agg(*(F.avg(c).alias(c) for c in ("reciprocal_rank", "recall", "precision", "f1", "ndcg")))


def overlap(a: DataFrame, b: DataFrame, k: int) -> DataFrame:
    """query_id, overlap: common files of the first k of two lists (query_id, rank, file) over min(k, both lengths)."""
    x = a.filter(F.col("rank") <= k).groupBy("query_id").agg(F.collect_set("file").alias("fa"))
    y = b.filter(F.col("rank") <= k).groupBy("query_id").agg(F.collect_set("file").alias("fb"))
    both = x.join(y, "query_id", "full_outer")
    n = F.least(F.size(F.coalesce("fa", F.array())), F.size(F.coalesce("fb", F.array())))
    return both.select("query_id", F.when(n > 0, F.size(F.array_intersect("fa", "fb")) / n).otherwise(F.lit(0.0)).alias("overlap"))


def spearman(a: DataFrame, b: DataFrame) -> DataFrame:
    """query_id, n_shared, spearman over the files that both lists have, ranked anew; null under two."""
    both = a.select("query_id", "file", F.col("rank").alias("ra")).join(b.select("query_id", "file", F.col("rank").alias("rb")), ["query_id", "file"])
    place = lambda c: F.row_number().over(Window.partitionBy("query_id").orderBy(c))
    d = both.withColumn("x", place("ra")).withColumn("y", place("rb"))
    n = F.count(F.lit(1))
    out = d.groupBy("query_id").agg(n.alias("n_shared"), F.sum((F.col("x") - F.col("y")) * (F.col("x") - F.col("y"))).alias("d2"))
    m = F.col("n_shared")
    return out.select("query_id", "n_shared", F.when(m >= 2, 1 - 6 * F.col("d2") / (m * (m * m - 1))).alias("spearman"))


def average_ranks(scores: DataFrame) -> DataFrame:
    """scores (query_id, file, score) with `place`: rank by falling score, ties averaged."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"))
    same = Window.partitionBy("query_id", "score")
    return scores.withColumn("place", F.rank().over(order) + (F.count(F.lit(1)).over(same) - 1) / 2)


def latency(df: DataFrame, by: str, ms: str) -> DataFrame:
    """Mean, median, 95th percentile (interpolated), least and most of a column by group."""
    return df.groupBy(by).agg(F.avg(ms).alias("mean"), F.expr(f"percentile({ms}, 0.5)").alias("median"), F.expr(f"percentile({ms}, 0.95)").alias("p95"), F.min(ms).alias("least"), F.max(ms).alias("most"))


def margin(runs: DataFrame, metric: str, queries: int) -> DataFrame:
    """Mean and sample deviation over runs, and how far below the mean a result may lie: three deviations, one query's worth at least; 0.05 for a single run."""
    out = runs.agg(F.avg(metric).alias("mean"), F.stddev_samp(metric).alias("sd"))
    return out.withColumn("margin", F.when(F.col("sd").isNull(), 0.05).otherwise(F.greatest(3 * F.col("sd"), F.lit(1.0 / queries))))


def bootstrap(clusters: DataFrame, resamples: int = 1000, level: float = 0.95, seed: int = 17) -> DataFrame:
    """mean, low, high: percentile interval of sum(total) / sum(n) when whole clusters (cluster, total, n) are drawn again.

    A draw gives each cluster a Poisson(1) number of copies, from a hash of its name and the draw's number: no cluster
    need meet another, so any number of clusters is one pass with partial sums for each draw.
    """
    u = (F.xxhash64(F.lit(seed), "cluster", "draw").bitwiseAND(F.lit((1 << 53) - 1)).cast("double")) / float(1 << 53)
    copies, cumulated, p = F.lit(0), 0.0, 0.36787944117144233
    for i in range(12):
        cumulated += p
        copies = copies + F.when(u >= cumulated, 1).otherwise(0)
        p /= i + 1
    draws = clusters.select("cluster", "total", "n", F.explode(F.sequence(F.lit(1), F.lit(resamples))).alias("draw")).withColumn("w", copies)
    each = draws.groupBy("draw").agg((F.sum(F.col("w") * F.col("total")) / F.sum(F.col("w") * F.col("n"))).alias("m"))
    tail = (1 - level) / 2
    span = each.agg(F.expr(f"percentile(m, {tail})").alias("low"), F.expr(f"percentile(m, {1 - tail})").alias("high"))
    return clusters.agg((F.sum("total") / F.sum("n")).alias("mean")).crossJoin(span)


def overlapping(chunks: DataFrame, spans: DataFrame) -> DataFrame:
    """chunk rows (page, seq, pos, len) with a span (page, start, end) that they overlap."""
    s = spans.select(F.col("page").alias("p"), "start", "end")
    return chunks.join(s, (F.col("page") == F.col("p")) & (F.col("pos") < F.col("end")) & (F.col("start") < F.col("pos") + F.col("len"))).drop("p")


def file_key(path: Column) -> Column:
    """A path as a fixture and a result are compared: of a URI the part after the collection, without outer slashes, lower case."""
    return F.lower(F.trim(F.regexp_replace(path, "^doc://(?:[^/]*/)?", ""), F.lit("/")))


def file_matches(result: Column, expected: Column) -> Column:
    """Equal, or one ends with the other at a slash."""
    return keys_match(file_key(result), file_key(expected))


def keys_match(a: Column, b: Column) -> Column:
    """file_matches of two file_keys."""
    return (a == b) | F.endswith(a, F.concat(F.lit("/"), b)) | F.endswith(b, F.concat(F.lit("/"), a))


def decision(low: Column, point: Column, needed: float) -> Column:
    """adopt if the interval lies above 0 and the gain is large enough; reject if the point is not above 0; else unclear."""
    return F.when((low > 0) & (point >= needed), "adopt").when(point <= 0, "reject").otherwise("unclear")


def rank_metrics(rank: Column) -> list[Column]:
    """page_mrr, page_ndcg10, page_recall10 of the one right page's rank; a null rank (it isn't there) scores 0."""
    top = F.coalesce(rank <= 10, F.lit(False))
    return [
        F.coalesce(1 / rank, F.lit(0.0)).alias("page_mrr"),
        F.when(top, 1 / F.log2(rank + 1.0)).otherwise(0.0).alias("page_ndcg10"),
        top.cast("double").alias("page_recall10"),
    ]


def page_metrics(ranked: DataFrame, gold: DataFrame) -> DataFrame:
    """query_id and rank_metrics of ranked pages (query_id, rank from 1, page) for each of gold (query_id, page)."""
    best = ranked.groupBy("query_id", "page").agg(F.min("rank").alias("rank"))
    return gold.join(best, ["query_id", "page"], "left").select("query_id", *rank_metrics(F.col("rank")))


def chunk_metrics(scores: DataFrame, gold: DataFrame) -> DataFrame:
    """Chunk, in-page and page metrics of each query from scores (query_id, page, seq, score) and its gold chunks (query_id, page, seq) of one page.

    A rank is one more than the number of strictly higher scores; a page scores as its best chunk. Sums of fixed size
    a query, so no query's scores meet in one task.
    """
    marked = scores.join(gold.select("query_id", "page", "seq").distinct().withColumn("gold", F.lit(True)), ["query_id", "page", "seq"], "left")
    best = F.max_by(F.struct(F.coalesce("gold", F.lit(False)).alias("gold")), F.struct("score", -F.col("seq")))
    pages = marked.groupBy("query_id", "page").agg(F.max("score").alias("s"), F.max(F.when(F.col("gold"), F.col("score"))).alias("g"), best.alias("top"))
    asked = pages.filter("g is not null").select("query_id", F.col("g").alias("gold_score"), F.col("s").alias("page_score"), F.col("top.gold").alias("in_page"))
    chunk = scores.join(asked, "query_id").groupBy("query_id").agg((1 + F.sum((F.col("score") > F.col("gold_score")).cast("long"))).alias("c"))
    page = pages.join(asked, "query_id").groupBy("query_id", "in_page").agg((1 + F.sum((F.col("s") > F.col("page_score")).cast("long"))).alias("p"))
    hits = [(F.col("c") <= k).cast("double").alias(f"chunk_hit{k}") for k in (1, 5, 10)]
    return chunk.join(page, "query_id").select("query_id", (1 / F.col("c")).alias("chunk_mrr"), *hits, F.col("in_page").cast("double").alias("in_page_hit1"), *rank_metrics(F.col("p")))


def median_match(logits: DataFrame, relevant: float, other: float) -> DataFrame:
    """bias, temperature: sigmoid((x - bias) / temperature) takes the median of the relevant logits (relevant, x) to one target, of the others to another."""
    import math

    a, b = (math.log(t / (1 - t)) for t in (relevant, other))
    medians = logits.agg(*(F.expr(f"percentile(x, 0.5) FILTER (WHERE {c})").alias(n) for n, c in (("r", "relevant"), ("o", "not relevant"))))
    spread = (F.col("r") - F.col("o")) / (a - b)
    return medians.select((F.col("r") - spread * a).alias("bias"), spread.alias("temperature"))


def share_above(x: Column, least: float = 0.5) -> Column:
    """An aggregate: the share of values above a threshold."""
    return F.avg((x > least).cast("double"))


def pool(top: DataFrame, gold: DataFrame) -> DataFrame:
    """query_id, place, file: the keyword results (query_id, rank, file), then, by name, the right files (query_id, file) that they lack."""
    missing = gold.select("query_id", "file").distinct().join(top.select("query_id", "file"), ["query_id", "file"], "left_anti")
    after = missing.join(top.groupBy("query_id").agg(F.max("rank").alias("last")), "query_id", "left")
    place = F.coalesce("last", F.lit(0)) + F.row_number().over(Window.partitionBy("query_id").orderBy("file"))
    return top.select("query_id", F.col("rank").alias("place"), "file").unionByName(after.select("query_id", place.alias("place"), "file"))


def evidence(items: DataFrame, pages: DataFrame, strict: bool = False) -> DataFrame:
    """query_id, page, item, status, start, end: where evidence (query_id, page, item, text) stands in pages (page, body).

    All places that don't overlap, or with `strict` only an item that stands on its page once, at word boundaries; one
    that stands there more often is `ambiguous`. An item that isn't found (or is blank) is one row, `missing`.
    """
    quoted = F.concat(F.lit("\\Q"), F.replace("text", F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    pattern = F.concat(F.lit(r"(?U)(?<!\w)"), quoted, F.lit(r"(?!\w)")) if strict else quoted
    found = items.join(pages.select("page", "body"), "page", "left").withColumn("text", F.coalesce("text", F.lit("")))
    # A place follows each part but the last: the parts' lengths say where.
    parts = F.when(F.col("text") != "", F.split(F.coalesce("body", F.lit("")), pattern, -1)).otherwise(F.array(F.lit("")))
    row = found.withColumn("parts", parts).withColumn("n", F.size("parts") - 1)
    many = (F.col("n") > 1) if strict else F.lit(False)
    row = row.withColumn("status", F.when(F.col("n") == 0, "missing").when(many, "ambiguous").otherwise("found"))
    before = lambda i: F.aggregate(F.slice("parts", 1, i), F.lit(0), lambda s, x: s + F.length(x)) + (i - 1) * F.length("text")
    starts = F.when(F.col("status") == "found", F.transform(F.sequence(F.lit(1), F.greatest("n", F.lit(1))), before)).otherwise(F.array(F.lit(None).cast("int")))
    out = row.select("query_id", "page", "item", "status", F.explode(starts).alias("start"), F.length("text").alias("size"))
    return out.select("query_id", "page", "item", "status", "start", (F.col("start") + F.col("size")).alias("end"))
