"""Fixtures, example splits, metadata, removed collections and links, by hand-worked values."""

from __future__ import annotations

import json
import math
import os

import pytest
from pyspark.sql import functions as F

from lodestack.functions.text import char_offset
from lodestack.operators import lifecycle, vectors
from lodestack.operators.examples import split_examples
from lodestack.plans import bench
from lodestack.sources.files import scan


@pytest.mark.parametrize(
    ("ranked", "expected", "want"),
    [
        (["docs/a/readme.md", "docs/b/readme.md"], ["readme.md"], ["readme.md", "docs/b/readme.md"]),
        (["doc://c/Docs/x.md"], ["/docs/x.md/"], ["/docs/x.md/"]),
        (["b/x.md", "x.md"], ["x.md", "b/x.md"], ["b/x.md", "x.md"]),
        (["docs/myreadme.md"], ["readme.md"], ["docs/myreadme.md"]),
        (["x.md"], ["a/x.md", "b/x.md"], ["a/x.md"]),
        (["doc://alone", "z"], [], ["alone", "z"]),
        ([], ["a"], []),
    ],
)
def test_claims(spark, ranked, expected, want):
    rows = spark.createDataFrame([(ranked, expected)], "r array<string>, e array<string>")
    assert rows.select(bench.claims(F.col("r"), F.col("e"))).first()[0] == want


def test_scores_and_summary(spark):
    fixture = spark.createDataFrame([("q", ["a.md", "b.md"], 2), ("r", ["x"], 1), ("none", [], 3)], "id string, expected_files array<string>, expected_in_top_k int")
    one = spark.createDataFrame([("q", 1, "z"), ("q", 2, "d/b.md"), ("q", 3, "a.md"), ("q", 4, "z"), ("none", 1, "z")], "query_id string, rank int, path string")
    two = spark.createDataFrame([("q", 1, "a.md"), ("q", 2, "b.md"), ("r", 1, "x")], "query_id string, rank int, path string")
    got = bench.scores({"kw": [one], "full": [one, two]}, fixture)
    by = {(r["backend"], r["sample"], r["query_id"]): r for r in got.collect()}
    assert len(by) == 9
    q = by["kw", 0, "q"]
    assert (q["recall_at_k"], q["mrr"]) == (0.5, 0.5) and q["ndcg_at_k"] == pytest.approx((1 / math.log2(3)) / (1 + 1 / math.log2(3)))
    assert tuple(by["full", 1, "r"])[3:] == (1.0, 1.0, 1.0) and tuple(by["kw", 0, "r"])[3:] == (0.0, 0.0, 0.0) and tuple(by["kw", 0, "none"])[3:] == (0.0, 0.0, 0.0)
    full = {r["backend"]: r for r in bench.summary(got).collect()}["full"]
    assert full["min_mrr"] == pytest.approx(0.5 / 3) and full["max_mrr"] == pytest.approx(2 / 3) and full["avg_mrr"] == pytest.approx((0.5 / 3 + 2 / 3) / 2)
    assert bench.summary(got).agg(bench.all_zero()).first()[0] is False


def test_split(spark):
    rows = [(f" Query {i}\n" if i % 2 else f"query {i}", i, "first") for i in range(50)] + [(f"QUERY {i}", 100 + i, "later") for i in range(50)] + [(None, 999, "first")]
    df = spark.createDataFrame(rows, "query string, line int, note string")
    got = sorted(split_examples(df, ["line"], 0.2).collect(), key=lambda r: r["place"])
    assert [r["place"] for r in got] == list(range(51)) and all(r["note"] == "first" for r in got)
    assert [r["split"] for r in got] == ["train"] * 40 + ["valid"] * 11
    assert split_examples(df.filter("false"), ["line"]).count() == 0
    assert [r["line"] for r in got] != sorted(r["line"] for r in got)


def test_metadata_and_removal(spark):
    body = "---\nsearch:\n  metadata:\n    tags: [a, b, a]\n    n: 2\n    ok: true\n---\ntext"
    docs = spark.createDataFrame([(1, "x", "a.md", body, "h1", True), (2, "x", "b.md", "---\nsearch: {metadata: [1]}\n---\n", "h2", True), (3, "y", "c.md", body, "h1", True), (4, "y", "d.md", None, "h3", False)], "id long, collection string, path string, body string, hash string, active boolean")
    old = spark.createDataFrame([(1, '{"was": 1}', 1, None, "t0"), (3, '{"kept": 1}', 2, None, "t0"), (9, "{}", 1, None, "t0")], "id long, metadata_json string, extraction_version int, extraction_error string, extracted_at string")
    new = lifecycle.sync_metadata(docs, old, 2, F.lit("t1"))
    got = {r["id"]: r for r in new.collect()}
    assert json.loads(got[1]["metadata_json"]) == {"tags": ["a", "b"], "n": 2, "ok": True} and got[1]["extracted_at"] == "t1"
    assert got[2]["metadata_json"] == "{}" and got[2]["extraction_error"] and got[3]["extracted_at"] == "t0" and got[4]["metadata_json"] == "{}" and got[9]["extraction_version"] == 1
    assert json.loads({r["id"]: r for r in lifecycle.sync_metadata(docs, old, 2, F.lit("t1"), only_if_stale=False).collect()}[3]["metadata_json"])["n"] == 2
    values = lifecycle.metadata_table(new)
    assert [tuple(r)[1:] for r in values.filter("id = 1").orderBy("key", "ordinal").collect()] == [
        ("n", 0, "number", None, 2.0, None), ("ok", 0, "boolean", None, None, True), ("tags", 0, "string", "a", None, None), ("tags", 1, "string", "b", None, None),
    ]
    hashes = docs.select("hash").distinct()
    left = lifecycle.Tables(docs, hashes, hashes, new, values).without_collection("x")
    ids = lambda df, c: sorted({r[c] for r in df.collect()})
    assert ids(left.docs, "id") == [3, 4] and ids(left.content, "hash") == ["h1"] and ids(left.vectors, "hash") == ["h1"]
    assert ids(left.metadata, "id") == [3, 4, 9] and ids(left.values, "id") == [3]


def test_overfetch_starves(spark):
    e = spark.createDataFrame([(i, [1.0, i / 1000]) for i in range(100)], "id long, embedding array<double>")
    chunks = e.select("id", F.col("id").alias("doc_id"), F.lit(0).alias("seq"))
    q = spark.createDataFrame([("q", [1.0, 0.0])], "query_id string, embedding array<double>")
    got = lambda *more: [r["doc_id"] for r in vectors.overfetched(e, q, chunks, 2, *more).orderBy("rank").collect()]
    assert got() == [0, 1] and got(chunks.filter("doc_id >= 59")) == [59] and got(chunks.filter("doc_id >= 60")) == []


def test_byte_places(spark):
    df = spark.createDataFrame([("aé日🎉b", b) for b in (0, 1, 3, 6, 10, 11)], "t string, b int")
    assert [r[0] for r in df.select(char_offset(F.col("t"), F.col("b"))).collect()] == [0, 1, 2, 3, 4, 5]


def test_a_link_out_of_the_root_is_skipped(spark, tmp_path):
    root, other = tmp_path / "root", tmp_path / "other"
    root.mkdir()
    other.mkdir()
    (root / "in.md").write_text("# in\n")
    (other / "out.md").write_text("# secret\n")
    os.symlink(other / "out.md", root / "link.md")
    os.symlink(root / "in.md", root / "own.md")
    got = {r["path"]: (r["skipped"], r["body"]) for r in scan(spark, str(root), "c").collect()}
    assert got == {"in.md": (None, "# in\n"), "own.md": (None, "# in\n"), "link.md": ("OUTSIDE_COLLECTION", None)}
