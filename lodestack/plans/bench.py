"""Judging search backends against a fixture: claimed files, scores of each query, averages and their spread over samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestack.operators.metrics import file_key, keys_match

METRICS = ("recall_at_k", "mrr", "ndcg_at_k")
_NONE = "cast(array() as array<string>)"


def claims(ranked: Column, expected: Column) -> Column:
    """The ranked paths, best first, each as the expected file that it claims, or as its own normal form.

    A path claims one file that it matches and no better path has claimed: one with an equal normal form if there is
    one, else the first. So a bare name that several paths end with is credited once. For a row with few files;
    claimed_places() is the same for any number.
    """

    def step(state: Column, path: Column) -> Column:
        fits = F.filter(state["left"], lambda e: keys_match(path, e["key"]))
        claimed = F.coalesce(F.get(F.filter(fits, lambda e: e["key"] == path), F.lit(0)), F.get(fits, F.lit(0)))
        left = F.when(claimed.isNull(), state["left"]).otherwise(F.array_remove(state["left"], claimed))
        return F.struct(left.alias("left"), F.concat(state["out"], F.array(F.coalesce(claimed["name"], path))).alias("out"))

    # Keys are made once a path, not once a pair.
    wanted = F.transform(expected, lambda e: F.struct(e.alias("name"), file_key(e).alias("key")))
    return F.aggregate(F.transform(ranked, file_key), F.struct(wanted.alias("left"), F.expr(_NONE).alias("out")), step, lambda s: s["out"])


def _tails(key: Column) -> Column:
    """What follows each slash of a key."""
    parts = F.split(key, "/")
    n = F.size(parts)
    return F.when(n > 1, F.transform(F.sequence(F.lit(2), F.greatest(n, F.lit(2))), lambda i: F.array_join(F.slice(parts, i, n), "/"))).otherwise(F.expr(_NONE))


def claimed_places(lists: DataFrame, expected: DataFrame) -> DataFrame:
    """list, places (from 1) of the paths that claim a file, by claims(). lists: list, set, paths; expected: set, place, name, a row a file, in the set's order by place, then name.

    Paths meet the files that they match by equal keys or tails of keys, so lists never meet whole sets. A path of n can
    find n - 1 files claimed, so it keeps its first n.
    """
    at = lists.select("list", "set", F.size("paths").alias("most"), F.posexplode(F.transform("paths", file_key)).alias("at", "key"))
    files = expected.select("set", F.struct("place", "name").alias("file"), file_key(F.col("name")).alias("key"))
    longer = at.select("*", F.explode(F.concat(F.array("key"), _tails(F.col("key")))).alias("tail"))
    found = longer.join(files.withColumnRenamed("key", "tail"), ["set", "tail"]).select("list", "most", "at", (F.col("tail") != F.col("key")).alias("other"), "file")
    shorter = files.select("set", "file", F.explode(F.array_distinct(_tails(F.col("key")))).alias("key"))
    found = found.unionByName(at.join(shorter, ["set", "key"]).select("list", "most", "at", F.lit(True).alias("other"), "file"))
    first = F.row_number().over(Window.partitionBy("list", "at").orderBy("other", "file"))
    found = found.distinct().withColumn("n", first).filter(F.col("n") <= F.col("most"))

    def step(state: Column, x: Column) -> Column:
        free = ~F.array_contains(state["places"], x["at"] + 1) & ~F.array_contains(state["taken"], x["file"])
        place, taken = F.array(x["at"] + 1), F.array(x["file"])
        return F.when(free, F.struct(F.concat(state["places"], place).alias("places"), F.concat(state["taken"], taken).alias("taken"))).otherwise(state)

    kept = found.groupBy("list").agg(F.array_sort(F.collect_list(F.struct("at", "n", "file"))).alias("fits"))
    none = F.struct(F.expr("cast(array() as array<int>)").alias("places"), F.filter(F.transform("fits", lambda x: x["file"]), lambda x: F.lit(False)).alias("taken"))
    return kept.select("list", F.aggregate("fits", none, step, lambda s: s["places"]).alias("places"))


def scores(backends: dict[str, list[DataFrame]], fixture: DataFrame, sets: DataFrame | None = None) -> DataFrame:
    """backend, sample, query_id, recall_at_k, mrr, ndcg_at_k. fixture: id, expected_files, expected_in_top_k.

    With sets (expected_set, file) the fixture names an expected_set instead, which queries may share: its files are
    rows, as many as there are, and no query holds them. backends: by name, the ranked lists (query_id, rank, path) of
    each sample. A list is as long as its search's limit, so one row holds it. Repeated paths count where they are
    first; a query without results, or without expected files, scores 0. A batch answers all queries at once, so it has
    no latency of one query: metrics.latency takes measured times.
    """
    runs = [found.select(F.lit(name).alias("backend"), F.lit(n).alias("sample"), "query_id", "rank", "path") for name, samples in backends.items() for n, found in enumerate(samples)]
    lists = runs[0]
    for more in runs[1:]:
        lists = lists.unionByName(more)
    paths = F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("rank", "path"))), lambda x: x["path"]))
    lists = lists.groupBy("backend", "sample", "query_id").agg(paths.alias("paths"))
    if sets is None:
        # Equal lists of files are one set.
        expected = F.array_distinct("expected_files")
        fixture = fixture.withColumn("expected_set", F.sha2(F.to_json(expected), 256))
        files = fixture.select(F.col("expected_set").alias("set"), F.posexplode(expected).alias("place", "name")).distinct()
    else:
        files = sets.select(F.col("expected_set").alias("set"), F.lit(0).alias("place"), F.col("file").alias("name")).distinct()
    every = F.explode(F.array(*(F.struct(F.lit(name).alias("backend"), F.lit(n).alias("sample")) for name, samples in backends.items() for n in range(len(samples)))))
    asked = fixture.select(F.col("id").alias("query_id"), F.col("expected_set").alias("set"), F.col("expected_in_top_k").alias("k"))
    list_id = F.struct("backend", "sample", "query_id", "set").alias("list")
    places = claimed_places(lists.join(asked.select("query_id", "set").distinct(), "query_id").select(list_id, "set", "paths"), files)
    rows = asked.select("*", every.alias("b")).select("query_id", "set", "k", F.struct(F.col("b.backend").alias("backend"), F.col("b.sample").alias("sample"), "query_id", "set").alias("list")).join(files.groupBy("set").agg(F.count(F.lit(1)).cast("int").alias("n")), "set", "left")
    rows = rows.join(places, "list", "left").select("list.*", "k", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("places", F.expr("cast(array() as array<int>)")).alias("places"))
    gain = lambda ps: F.aggregate(ps, F.lit(0.0), lambda s, p: s + 1 / F.log2(p + 1.0))
    n = F.col("n")
    rows = rows.withColumn("top", F.filter("places", lambda p: p <= F.col("k")))
    ideal = gain(F.sequence(F.lit(1), F.greatest(F.least("k", n), F.lit(1))))
    return rows.select(
        "backend", "sample", "query_id", F.when(n > 0, F.size("top") / n).otherwise(F.lit(0.0)).alias("recall_at_k"),
        F.coalesce(1 / F.array_min("places"), F.lit(0.0)).alias("mrr"), (gain(F.col("top")) / ideal).alias("ndcg_at_k"),
    )


def summary(scored: DataFrame) -> DataFrame:
    """A row a backend: avg_ of each metric over queries and samples, min_ and max_ of its averages over each sample."""
    each = scored.groupBy("backend", "sample").agg(*(F.avg(m).alias(m) for m in METRICS))
    # All samples answer the same queries, so the mean of their averages is the mean of all.
    return each.groupBy("backend").agg(*(f(m).alias(f"{name}_{m}") for m in METRICS for name, f in (("avg", F.avg), ("min", F.min), ("max", F.max))))


def all_zero() -> Column:
    """An aggregate over summary(): no backend found anything, so the fixture hardly fits the store."""
    return F.coalesce(F.max(F.greatest(*(f"avg_{m}" for m in METRICS))) == 0, F.lit(False))
