"""Reranker evaluation, evidence, embedding updates, and the hybrid query's own choices, by hand-worked values."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from lodestack.functions import format, text
from lodestack.operators import lifecycle, metrics, postings, vectors
from lodestack.plans.search import Query, hybrid, result_rows


def test_chunk_metrics(spark):
    rows = [("q", "a", 0, 0.9), ("q", "a", 1, 0.5), ("q", "b", 0, 0.7), ("q", "b", 1, 0.7), ("q", "c", 0, 0.1)]
    scores = spark.createDataFrame(rows, "query_id string, page string, seq int, score double")
    got = metrics.chunk_metrics(scores, spark.createDataFrame([("q", "b", 1)], "query_id string, page string, seq int")).first().asDict()
    assert got["chunk_mrr"] == 0.5 and got["chunk_hit1"] == 0 and got["chunk_hit5"] == 1
    assert got["in_page_hit1"] == 0, "the first of equal chunks counts"
    assert got["page_mrr"] == 0.5 and got["page_ndcg10"] == pytest.approx(1 / math.log2(3)) and got["page_recall10"] == 1


def test_page_metrics(spark):
    ranked = spark.createDataFrame([("q", i, f"p{i}") for i in range(1, 13)], "query_id string, rank int, page string")
    gold = spark.createDataFrame([("q", "p12"), ("r", "x")], "query_id string, page string")
    got = {r["query_id"]: tuple(r)[1:] for r in metrics.page_metrics(ranked, gold).collect()}
    assert got == {"q": (1 / 12, 0.0, 0.0), "r": (0.0, 0.0, 0.0)}


def test_median_match_and_pool(spark):
    x = spark.createDataFrame([(True, 1.0), (True, 3.0), (True, 9.0), (False, -1.0), (False, -2.0), (False, -9.0)], "relevant boolean, x double")
    bias, t = metrics.median_match(x, 0.9, 0.1).first()
    assert 1 / (1 + math.exp(-(3 - bias) / t)) == pytest.approx(0.9) and 1 / (1 + math.exp(-(-2 - bias) / t)) == pytest.approx(0.1)
    assert x.agg(metrics.share_above(F.col("x"))).first()[0] == 0.5
    top = spark.createDataFrame([("q", 1, "a"), ("q", 2, "b")], "query_id string, rank int, file string")
    gold = spark.createDataFrame([("q", "b"), ("q", "z"), ("q", "y")], "query_id string, file string")
    assert [r["file"] for r in metrics.pool(top, gold).orderBy("place").collect()] == ["a", "b", "y", "z"]


def test_evidence(spark):
    pages = spark.createDataFrame([("p", "You must: pay. You must: go (now). pays")], "page string, body string")
    items = spark.createDataFrame([("q", "p", 0, "You must:"), ("q", "p", 1, "go (now)"), ("q", "p", 2, "pay"), ("q", "p", 3, "nix"), ("q", "p", 4, "")], "query_id string, page string, item int, text string")
    loose = [(r["item"], r["status"], r["start"], r["end"]) for r in metrics.evidence(items, pages).orderBy("item", "start").collect()]
    assert loose == [(0, "found", 0, 9), (0, "found", 15, 24), (1, "found", 25, 33), (2, "found", 10, 13), (2, "found", 35, 38), (3, "missing", None, None), (4, "missing", None, None)]
    strict = {r["item"]: (r["status"], r["start"]) for r in metrics.evidence(items, pages, strict=True).collect()}
    assert strict == {0: ("ambiguous", None), 1: ("found", 25), 2: ("found", 10), 3: ("missing", None), 4: ("missing", None)}


def test_context_window(spark):
    df = spark.createDataFrame([("abcdefghij", 4, 2), ("abcdefghij", 9, 1), ("abc", 0, 1)], "b string, p int, n int")
    assert [r[0] for r in df.select(text.context_window(F.col("b"), F.col("p"), F.col("n"), 4)).collect()] == ["defg", "ghij", "abc"]


def test_pending_metadata(spark):
    docs = spark.createDataFrame([(1, True), (2, True), (3, True), (4, False), (5, True)], "id long, active boolean")
    seen = spark.createDataFrame([(1, 2, None), (2, 1, None), (3, 2, "bad")], "id long, extraction_version int, extraction_error string")
    assert {r["id"] for r in lifecycle.pending_metadata(docs, seen, 2).collect()} == {2, 3, 5}


def test_embedding_update(spark):
    contents = spark.createDataFrame([("h1", "t", "one"), ("h2", "t", "two"), ("h3", "t", "word " * 900), ("h4", "t", "")], "hash string, title string, body string")
    stored = spark.createDataFrame([("h1", 0, 0, [9.0], "f1", 1), ("h2", 0, 0, [9.0], "old", 1), ("h3", 0, 0, [9.0], "f1", 2), ("gone", 0, 0, [9.0], "old", 1)], "hash string, seq int, pos int, embedding array<double>, fingerprint string, total_chunks int")
    embed = lambda t: F.array(F.length(t).cast("double"))
    got = {(r["hash"], r["seq"]): r for r in vectors.embed_contents(contents, stored, embed, "f1").collect()}
    assert got.keys() == {("h1", 0), ("h2", 0), ("h3", 0), ("h3", 1), ("gone", 0)}
    assert got["h1", 0]["embedding"] == [9.0] and got["gone", 0]["fingerprint"] == "old"
    assert got["h2", 0]["embedding"] == [float(len("title: t | text: two"))] and got["h3", 1]["total_chunks"] == 2
    assert {r["embedding"][0] == 9.0 for r in vectors.embed_contents(contents, stored, embed, "f1", force=True).filter("hash <> 'gone'").collect()} == {False}


def test_documents_as_text(spark):
    df = spark.createDataFrame([("abc123", "c/a.md", "A", "x \"y\"", False, "", "a<b"), (None, "c/b.md", "c/b.md", None, True, "File too large (3KB > 2KB)", None)], "docid string, file string, title string, context string, skipped boolean, reason string, body string")
    got = {f: [r["out"] for r in format.documents_as(df, f).collect()] for f in format.FORMATS}
    assert got["files"] == ['#abc123,c/a.md,"x ""y"""', "c/b.md,[SKIPPED]"]
    assert got["csv"] == ['#abc123,c/a.md,A,"x ""y""",false,a<b', ",c/b.md,c/b.md,,true,File too large (3KB > 2KB)"]
    assert got["md"][1] == "## c/b.md\n\n> File too large (3KB > 2KB)\n" and "**Title:** A" in got["md"][0]
    assert "<body>a&lt;b</body>" in got["xml"][0] and "<skipped>true</skipped>" in got["xml"][1] and "docid" not in got["xml"][1]
    assert got["json"][1] == '{"file":"c/b.md","title":"c/b.md","skipped":true,"reason":"File too large (3KB > 2KB)"}'
    assert "Folder Context: x \"y\"\n---\n\na<b" in got["cli"][0] and got["cli"][1].endswith("[SKIPPED: File too large (3KB > 2KB)]")
    assert format.framed(got["json"], "json").startswith("[{") and format.framed([], "xml").endswith("<documents>\n\n</documents>")
    with pytest.raises(ValueError):
        format.documents_as(df, "pdf")


def test_hybrid_judges_the_best_chunk_below_the_intent(spark):
    long = "start\n" + "filler words\n" * 400 + "apples here and pears\n" + "more filler\n" * 50
    docs = spark.createDataFrame([(1, "c", "a.md", "A", long, "h1"), (2, "c", "b.md", "B", "apples", "h2")], "id long, collection string, path string, title string, body string, hash string")
    embedded = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (99, [1.0, 0.0])], "id long, embedding array<double>")
    queries = {"q": Query("apples", [1.0, 0.0], "find pears")}
    asked = lambda a, t: F.when((a == "find pears\n\napples") & F.contains(t, F.lit("pears")) & ~F.startswith(t, F.lit("start")), 1.0).otherwise(0.0)
    found = hybrid(postings.postings(docs), docs, embedded, queries, rerank=asked)
    rows = {r["file"]: r for r in found.collect()}
    assert rows.keys() == {1, 2} and rows[1]["rank"] == 1 and rows[1]["pos"] > 0 and rows[2]["pos"] == 0
    shown = {r["id"]: r for r in result_rows(found, docs, queries).collect()}
    assert shown[1]["line"] == 402 and "apples here" in shown[1]["snippet"] and shown[2]["file"] == "c/b.md" and shown[2]["docid"] == "h2"
