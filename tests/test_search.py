"""Keyword search against SQLite's FTS5, fusion laws, filters, metrics."""

from __future__ import annotations

import math
import sqlite3

import pytest
from pyspark.sql import functions as F

from lodestack.functions import stem
from lodestack.operators import bm25, filters, fusion, lifecycle, lookup, metrics, postings, vectors

DOCS = [
    (1, "Guide", "Configuring the server. The configuration is easy to configure."),
    (2, "Notes", "Multi-agent systems: multi agent, O'Brien's café and multi_word names"),
    (3, "Guide two", "Running runner runs; an authorization server authorizes a runner."),
    (4, "Other", "nothing here but relational rationals and hopeful happiness"),
    (5, "Guide three", "日本語 text about servers and cafés"),
    (6, "Guide four", "server server server configured"),
]
SEARCHES = ["configuring", "server", '"multi agent"', "multi-agent", "guide -server", "runs server", "café", "o'brien", "hopefulness", "日本", '"the server', "-guide"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, "id long, title string, body string")


@pytest.mark.parametrize("search", SEARCHES)
def test_bm25_equals_fts5(spark, docs, search):
    db = sqlite3.connect(":memory:")
    db.execute("create virtual table d using fts5(path unindexed, title, body, tokenize='porter unicode61')")
    spaced = lambda s: bm25._CJK.sub(r" \1 ", s)
    db.executemany("insert into d(rowid, path, title, body) values (?, '', ?, ?)", [(i, spaced(t), spaced(b)) for i, t, b in DOCS])
    parsed = bm25.parse(search)
    got = {r["id"]: r["bm25"] for r in bm25.search(postings.postings(docs, stemmed=True), docs, {"q": search}, 20, stemmed=True).collect()}
    if parsed is None:
        assert got == {}
        return
    text = lambda p: '"' + " ".join(p.tokens) + '"' + ("*" if p.prefix else "")
    match = " AND ".join(text(p) for p in parsed if not p.negated)
    for p in parsed:
        if p.negated:
            match = f"({match}) NOT {text(p)}"
    want = dict(db.execute("select rowid, bm25(d, 1.5, 4.0, 1.0) from d where d match ?", (match,)).fetchall())
    assert got.keys() == want.keys()
    for i in want:
        assert got[i] == pytest.approx(want[i], rel=1e-9, abs=1e-12)


def test_stems():
    # Examples of the published algorithm.
    for word, want in {"caresses": "caress", "ponies": "poni", "relational": "relat", "hopping": "hop", "falling": "fall", "happy": "happi", "sky": "sky", "adoption": "adopt", "controll": "control", "probate": "probat", "agreed": "agre", "sized": "size"}.items():
        assert stem.stem(word) == want


def test_parse():
    assert bm25.parse("-only") is None
    assert bm25.parse('a "b c" -d') == [bm25.Phrase(("a",), True), bm25.Phrase(("b", "c")), bm25.Phrase(("d",), True, True)]
    assert bm25.parse('"open end') == [bm25.Phrase(("open", "end"))]


@pytest.mark.parametrize(
    ("search", "want"),
    [
        # Written by hand from the rules: an apostrophe or underscore stays in its term, a quote ends one.
        ("o'bri", [(("o", "bri"), True, False)]),
        ("multi_wo", [(("multi", "wo"), True, False)]),
        ("multi-agent", [(("multi", "agent"), False, False)]),
        ('foo"bar baz"', [(("foo",), True, False), (("bar", "baz"), False, False)]),
        ('-"a b" c', [(("a", "b"), False, True), (("c",), True, False)]),
        ("日本 x", [(("日", "本"), False, False), (("x",), True, False)]),
        ("- x", [(("x",), True, False)]),
    ],
)
def test_parse_by_hand(search, want):
    assert [(p.tokens, p.prefix, p.negated) for p in bm25.parse(search)] == want


@pytest.mark.parametrize(("search", "match"), [("o'bri", '"o\'bri"*'), ("multi_wo", '"multi_wo"*'), ('guide"the server"', '"guide"* AND "the server"')])
def test_matches_of_hand_written_fts5(spark, docs, search, match):
    db = sqlite3.connect(":memory:")
    db.execute("create virtual table d using fts5(title, body, tokenize='porter unicode61')")
    db.executemany("insert into d(rowid, title, body) values (?, ?, ?)", DOCS)
    want = {r for (r,) in db.execute("select rowid from d where d match ?", (match,))}
    assert want and {r["id"] for r in bm25.search(postings.postings(docs, stemmed=True), docs, {"q": search}, 20, stemmed=True).collect()} == want


def test_only_distinct_terms_are_stemmed(spark, docs):
    found = bm25.search(postings.postings(docs, stemmed=True), docs, {"q": "licensed rights"}, 5, stemmed=True)
    lines = found._jdf.queryExecution().executedPlan().toString().split("\n")
    below = [lines[k + 1] for k, line in enumerate(lines) if "ArrowEvalPython" in line]
    assert below and all("HashAggregate" in line for line in below)


def test_stored_index_is_pruned(spark, docs, tmp_path):
    postings.write_index(docs, str(tmp_path))
    post, lengths, stats = postings.read_index(spark, str(tmp_path))
    found = bm25.search(post, docs, {"q": "server guide"}, 5, lengths=lengths, stats=stats)
    assert "StringStartsWith(term,server)" in found._jdf.queryExecution().toString()
    want = bm25.search(postings.postings(docs), docs, {"q": "server guide"}, 5)
    assert [tuple(r) for r in found.orderBy("rank").collect()] == [tuple(r) for r in want.orderBy("rank").collect()]


def test_starvation_only_on_request(spark, docs):
    post = postings.postings(docs)
    only = docs.filter("id = 1")
    assert bm25.search(post, docs, {"q": "server"}, 5, only).count() == 1
    assert bm25.search(post, docs, {"q": "server"}, 5, only, overfetch=1).count() == 0


def test_rrf(spark):
    rows = [("q", i, r, f, 2.0 if i < 2 else 1.0) for i, fs in enumerate((["a", "b", "c"], ["b", "a", "d"], ["e"])) for r, f in enumerate(fs)]
    got = {r["file"]: (r["rrf"], r["rank"]) for r in fusion.reciprocal_rank_fusion(spark.createDataFrame(rows, "query_id string, list_idx int, rank int, file string, weight double")).collect()}
    assert got["a"][0] == pytest.approx(2 / 61 + 2 / 62 + 0.05)
    assert got["a"][1] == 1 and got["b"][1] == 2  # a tie: the first list's first stands first
    assert got["e"][0] == pytest.approx(1 / 61 + 0.05)
    assert got["c"][0] == pytest.approx(2 / 63 + 0.02)


def test_expansion():
    assert fusion.expansion_parts("lex: red car\nvec: nothing\nhyde: the car is red\n", "car") == [("lex", "red car"), ("hyde", "the car is red")]
    assert fusion.expansion_parts("", "car") == [("hyde", "Information about car")]


VALUES = [
    (1, [("s", 0, "string", "a", None, None), ("n", 0, "number", None, 3.0, None), ("t", 0, "string", "x", None, None), ("t", 1, "string", "y", None, None)]),
    (2, [("s", 0, "string", "b", None, None), ("f", 0, "boolean", None, None, True)]),
    (3, [("n", 0, "string", "3", None, None)]),
    (4, None),
]


@pytest.mark.parametrize(
    ("tree", "want"),
    [
        ({"key": "s", "operator": "eq", "value": "a"}, {1}),
        ({"key": "s", "operator": "ne", "value": "a"}, {2}),
        ({"key": "n", "operator": "gte", "value": 3}, {1}),
        ({"key": "n", "operator": "eq", "value": "3"}, {3}),
        ({"key": "t", "operator": "all", "value": ["x", "y"]}, {1}),
        ({"key": "t", "operator": "nin", "value": ["z"]}, {1}),
        ({"key": "s", "operator": "in", "value": ["b", "c"]}, {2}),
        ({"key": "f", "operator": "eq", "value": True}, {2}),
        ({"key": "s", "operator": "exists", "value": False}, {3, 4}),
        ({"operator": "not", "operand": {"key": "s", "operator": "eq", "value": "a"}}, {2, 3, 4}),
        ({"operator": "not", "operand": {"operator": "not", "operand": {"key": "s", "operator": "eq", "value": "a"}}}, {1}),
    ],
)
def test_filters(spark, tree, want):
    df = spark.createDataFrame(VALUES, f"id long, v {filters.VALUES}")
    assert {r["id"] for r in df.filter(filters.compile_filter(filters.parse(tree), F.col("v"))).collect()} == want


@pytest.mark.parametrize(
    ("tree", "at"),
    [
        ({"operator": "and", "operands": []}, "$.operands"),
        ({"operator": "and", "operands": [{"key": "a", "operator": "eq", "value": 1}, {"key": "a", "operator": "eq", "value": None}]}, "$.operands[1].value"),
        ({"key": "a", "operator": "eq", "value": 1, "x": 2}, "$"),
        ({"key": "a", "operator": "gt", "value": True}, "$.value"),
        ({"key": "a", "operator": "in", "value": [1, "b"]}, "$.value"),
        ({"key": "a", "operator": "like", "value": "b"}, "$.operator"),
        ({"key": "a", "operator": "eq", "value": float("inf")}, "$.value"),
        ({"key": "k" * 129, "operator": "eq", "value": 1}, "$.key"),
        ({"key": "a", "operator": "in", "value": ["b" * 1025]}, "$.value[0]"),
    ],
)
def test_bad_filters(tree, at):
    with pytest.raises(filters.FilterError, match=r"^" + at.replace("$", r"\$").replace("[", r"\[") + ":"):
        filters.parse(tree)


def test_repeated_members_count_once():
    assert filters.parse({"key": "a", "operator": "in", "value": ["b", "a", "b"]}).value == ("b", "a")


def test_metrics(spark):
    ranked = spark.createDataFrame([("q", 1, "x"), ("q", 2, "a"), ("q", 3, "a"), ("q", 4, "b")], "query_id string, rank int, file string")
    relevant = spark.createDataFrame([("q", "a"), ("q", "b"), ("q", "c"), ("none", "z")], "query_id string, file string")
    got = {r["query_id"]: r for r in metrics.per_query(ranked, relevant, 4).collect()}
    assert got["q"]["reciprocal_rank"] == 0.5 and got["q"]["recall"] == pytest.approx(2 / 3)
    ideal = sum(1 / math.log2(i + 1) for i in (1, 2, 3))
    assert got["q"]["ndcg"] == pytest.approx((1 / math.log2(3) + 1 / math.log2(5)) / ideal)
    assert got["none"]["recall"] == 0 and got["none"]["f1"] == 0


def test_bootstrap_covers_the_mean(spark):
    rows = [(f"c{i}", float(i % 7), 1.0) for i in range(200)]
    got = metrics.bootstrap(spark.createDataFrame(rows, "cluster string, total double, n double"), 300).first()
    assert got["low"] < got["mean"] < got["high"] and got["high"] - got["low"] < 1.0


def test_nearest_is_exact(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 8))
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)] + [(900, [0.0] * 8)], "id long, embedding array<double>")
    q = spark.createDataFrame([("a", x[3].tolist())], "query_id string, embedding array<double>")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = np.argsort(1 - unit @ unit[3])[:5].tolist()
    assert [r["id"] for r in vectors.nearest(v, q, 5).orderBy("rank").collect()] == want


def test_reactivation_and_tombstones(spark):
    old = spark.createDataFrame([(1, "c", "a", "A", "h1", True), (2, "c", "b", "B", "h2", False), (3, "c", "d", "D", "h3", True)], "id long, collection string, path string, title string, hash string, active boolean")
    new = spark.createDataFrame([("c", "a", "A2", "h1"), ("c", "b", "B", "h2"), ("c", "e", "E", "h4")], "collection string, path string, title string, hash string")
    got = {r["path"]: r["action"] for r in lifecycle.scan_diff(old, new).collect()}
    assert got == {"a": "updated", "b": "reactivated", "d": "removed", "e": "indexed"}
    stamp = F.lit("2026-01-01").cast("timestamp")
    after = {r["path"]: (r["id"], r["active"]) for r in lifecycle.apply_scan(old.withColumn("created_at", stamp).withColumn("modified_at", stamp), new, stamp).collect()}
    assert after == {"a": (1, True), "b": (2, True), "d": (3, False), "e": (4, True)}


def test_context_is_a_string_prefix(spark):
    docs = spark.createDataFrame([(1, "c", "foobar/x.md"), (2, "c", "a/b/x.md")], "id long, collection string, path string")
    ctx = spark.createDataFrame([("c", "", "all"), ("c", "/foo", "foo"), ("c", "/a", "A"), ("c", "/a/b", "AB")], "collection string, prefix string, text string")
    assert {r["id"]: r["context"] for r in lookup.contexts(docs, ctx).collect()} == {1: "all\n\nfoo", 2: "all\n\nA\n\nAB"}


def test_catalog_of_collections(spark):
    c = lifecycle.Catalog(spark, [])
    c.add("one", "/tmp/one")
    with pytest.raises(ValueError):
        c.add("two", "/tmp/one")
    c.include("one", False)
    c.set_context("one", "/a", "text")
    assert c.excluded() == ["one"] and c.contexts().first()["text"] == "text"
