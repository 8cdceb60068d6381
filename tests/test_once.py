"""Searches that read the texts once, short batches, and an index whose tasks don't grow."""

from __future__ import annotations

import glob

import duckdb
import pytest
from pyspark.sql import functions as F

from lodestack import catalog
from lodestack.functions import chunks, stem
from lodestack.functions.text import tokens
from lodestack.operators import bm25, postings
from lodestack.sources import tables

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["bm25_batch", "bm25_stemmed", "bm25_or_okapi"])
def test_a_search_leaves_no_text_to_read(spark, name):
    assert not [f for f in catalog.QUERIES[name](spark, SF).inputFiles() if "documents" in f]


@pytest.mark.parametrize("stemmed", [False, True])
def test_asked_postings_score_as_all_do(spark, stemmed):
    d = tables.documents(spark, SF)
    d = d.unionByName(d.filter("id < 20").withColumn("body", F.lit("possibility of happiness, LICENSES"))).unionByName(d.limit(1).withColumn("id", F.lit(9999).cast("long")).withColumn("title", F.lit(None)).withColumn("body", F.lit(None)))
    queries = {"a": "licensed", "b": '"possible" happy', "c": 'the -"of the"', "d": "ere", "e": "nothinglikeit", "f": '"in"'}
    rows = lambda post: sorted((r["query_id"], r["id"], round(r["bm25"], 9)) for r in bm25.scores(post, d, queries, stemmed).collect())
    got = rows(None)
    assert got == rows(postings.postings(d, stemmed)) and len({r[0] for r in got}) >= 3


def test_too_many_terms_to_write_out(spark, monkeypatch):
    d, queries = tables.documents(spark, SF), {"a": "licensed", "b": '"of the"'}
    want = sorted(map(tuple, bm25.search(None, d, queries, 5).select("query_id", "rank", "id").collect()))
    monkeypatch.setattr(bm25, "PUSHED", 1)
    assert sorted(map(tuple, bm25.search(None, d, queries, 5).select("query_id", "rank", "id").collect())) == want


def test_a_word_begins_as_its_stem_does(spark):
    words = {r[0] for r in duckdb.sql("SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) FROM '/root/testdata/sf0.01/documents.parquet'").fetchall()}
    ends = [*stem._STEP2, *stem._STEP3, *stem._STEP4, "y", "ed", "ing", "s", "ies", "sses", "eed", "e", "ll", "ated", "bling", "izing", "bility", "ency", "ancy", "logy"]
    words |= {b + e + more for b in ("happ", "possi", "mo", "relat", "hop", "b", "oba", "vileni", "triplic") for e in ends for more in ("", "s", "ed", "ing", "ly")}
    assert all(w.startswith(x[: max(1, len(x) - bm25.STEM_END)]) for w in words for x in [stem.stem(w)])


def test_tokens(spark):
    texts = ["", None, " -a", "Ünï c0de-x_y", "日本語 kana・かな1", "éa ́", "\U0001d400b\U0001f389c", "ab"]
    got = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(tokens(F.col("t"))).collect()]
    assert got == [[], [], ["a"], ["uni", "c0de", "x", "y"], ["日", "本", "語", "kana", "か", "な", "1"], ["ea"], ["\U0001d400b", "c"], ["ab"]]


def test_an_index_has_files_in_proportion(spark, tmp_path, monkeypatch):
    d = tables.documents(spark, SF)
    monkeypatch.setattr(postings, "INDEX_BYTES", 20_000, raising=False)
    postings.write_index(d, str(tmp_path / "i"))
    assert len(glob.glob(f"{tmp_path}/i/postings/*.parquet")) >= 20
    post, lengths, _ = postings.read_index(spark, str(tmp_path / "i"))
    assert sorted(map(tuple, lengths.collect())) == sorted(map(tuple, postings.document_lengths(post).collect()))


def test_chunks_leave_in_short_batches(spark, monkeypatch):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    monkeypatch.setattr(chunks, "TOGETHER", 3000, raising=False)
    d = spark.createDataFrame([(1, "word " * 4000), (2, ""), (3, None), (4, "x")], "id long, body string")
    got = sorted(map(tuple, chunks.chunk_table(d, empty=True).collect()))
    want = [(i, n, p, t) for i, body in ((1, "word " * 4000), (2, ""), (4, "x")) for n, (p, t) in enumerate(chunks.chunks(body))]
    assert got == want and int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 500
