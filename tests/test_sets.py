"""Relevant and expected files that queries share: the same figures as of every pair of a query and a file."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestack import catalog
from lodestack.operators import metrics, vectors
from lodestack.plans import bench


def test_shared_sets_score_as_pairs_do(spark):
    rng = random.Random(3)
    files = spark.createDataFrame([(g, f) for f in range(60) for g in ({f % 4, f % 7 + 10} if f % 5 else {f % 4, None})], "group int, file long")
    queries = spark.createDataFrame([(str(q), g) for q in range(12) for g in ([q % 4] if q % 3 else [q % 4, 10 + q % 7])] + [("none", None), ("empty", 99)], "query_id string, group int")
    ranked = spark.createDataFrame([(str(q), r + 1, f) for q in range(12) for r, f in enumerate(rng.choices(range(60), k=15))], "query_id string, rank int, file long")
    relevant = queries.join(files, "group").select("query_id", "file").distinct()
    of_query, sets = metrics.shared_sets(queries, files)
    got, want = metrics.per_query(ranked, of_query, 10, sets), metrics.per_query(ranked, relevant, 10)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and want.count() == 12


def test_claimed_places_are_those_of_claims(spark):
    rng = random.Random(5)
    names = ["x.md", "a/x.md", "b/x.md", "c/a/x.md", "y.md", "/A/y.md/", "doc://c/a/x.md", "a//x.md", "", "z/", "a", "a/a"]
    lists = [(i, rng.sample(names, rng.randint(0, 7)), rng.sample(names, rng.randint(0, 9))) for i in range(120)]
    df = spark.createDataFrame(lists, "list int, paths array<string>, expected array<string>")
    claimed = df.withColumn("claimed", bench.claims(F.col("paths"), F.col("expected")))
    want = {r["list"]: sorted(r["claimed"].index(e) + 1 for e in r["expected"] if e in r["claimed"]) for r in claimed.collect()}
    expected = df.select(F.col("list").alias("set"), F.posexplode("expected").alias("place", "name"))
    found = bench.claimed_places(df.select("list", F.col("list").alias("set"), "paths"), expected)
    got = {r["list"]: sorted(r["places"]) for r in found.collect()}
    assert {k: v for k, v in want.items() if v} == {k: v for k, v in got.items() if v}


@pytest.mark.parametrize("name", ["ir_metrics", "ir_means", "bench_run"])
def test_no_pair_of_query_and_file_is_made(spark, tmp_path, name):
    """4000 vectors of one label are the files of 80 queries: 320,000 pairs, which no step may write or join."""
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=4).tolist(), 0) for i in range(4000)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    found = catalog.QUERIES[name](spark, str(tmp_path))
    found.collect()
    plan, most = found._jdf.queryExecution().executedPlan(), 0
    todo = [plan]
    while todo:
        node = todo.pop()
        rows_out = node.metrics().get("numOutputRows")
        if rows_out.isDefined():
            most = max(most, rows_out.get().value())
        kids = node.children()
        todo += [kids.apply(i) for i in range(kids.size())]
        kind = node.nodeName()
        if kind == "AdaptiveSparkPlan":
            todo.append(node.executedPlan())
        elif "QueryStage" in kind:
            todo.append(node.plan())
    assert 0 < most < 40_000


def test_distances_meet_in_bounded_blocks(spark, monkeypatch):
    rng = np.random.default_rng(2)
    e = spark.createDataFrame([(i, rng.normal(size=8).tolist()) for i in range(600)], "id long, embedding array<double>")
    q = e.filter("id % 20 = 0").select(F.col("id").cast("string").alias("query_id"), "embedding")
    want = sorted(map(tuple, vectors.nearest(e, q, 7).select("query_id", "rank", "id").collect()))
    monkeypatch.setattr(vectors, "DISTANCES", 1000)
    assert sorted(map(tuple, vectors.nearest(e, q, 7).select("query_id", "rank", "id").collect())) == want
