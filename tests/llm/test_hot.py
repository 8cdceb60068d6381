"""One id on half of the rows, equal rows, columns with names that results use."""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestack.llm import bpe, fingerprint, near_dedup, packing, quality_model, quality_rules, sharding, token_store, tokens, toxicity
from lodestack.llm.common import NULL_ID, KeyRanges, range_count
from tests.llm.conftest import prose

CLASHING = "doc_id long, text string, shard int, Slot long, __key string, __k long, row int, record string, label int, range int, score double, key binary, number int, salt int, features int, h long"


@pytest.fixture(scope="module")
def hot(spark, tmp_path_factory):
    """Id 7 on half of the rows, a third of all rows equal, the rest distinct."""
    same = prose(1, 60)
    rows = [(7, same)] * 120 + [(7, prose(100 + i, 20 + i % 40)) for i in range(60)] + [(i, prose(500 + i, 20 + i % 40)) for i in range(8, 188)]
    path = str(tmp_path_factory.mktemp("hot") / "documents.parquet")
    filler = [None] * (CLASHING.count(",") - 1)
    spark.createDataFrame([(*r, *filler) for r in rows], CLASHING).repartition(4).write.parquet(path)
    return spark.read.parquet(path), rows


def test_ranges_split_a_hot_id(hot):
    docs, rows = hot
    cut = KeyRanges(docs, 12)
    of = docs.withColumn("r", cut.column()).groupBy("r").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).orderBy("r").collect()
    assert max(r["n"] for r in of) < len(rows) / 4 and all(a["hi"] <= b["lo"] for a, b in zip(of, of[1:], strict=False))
    assert KeyRanges(docs.filter("false"), 12).n == 1 and range_count(docs) >= 1 and NULL_ID < 0


def test_op3_and_op8(spark, hot):
    docs, rows = hot
    got = fingerprint.compare_documents(docs).collect()
    assert Counter((r["doc_id"], r["n_chars"]) for r in got) == Counter((i, len(t)) for i, t in rows)
    read = sorted(token_store.read_digests(spark, token_store.write(docs, ranges=12)).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in read] == sorted(i for i, _ in rows)
    assert all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(read, read[1:], strict=False))
    encoder = tokens.library_encoder(token_store.VOCABULARY, True)
    want = Counter((i, zlib.crc32(e + bytes(4))) for (i, _), e in zip(rows, encoder.encode([t for _, t in rows]), strict=True))
    assert Counter((r["doc_id"], r["ids_crc32"]) for r in read) == want


def test_op4(spark, hot, monkeypatch):
    docs, rows = hot
    placed, counts = sharding.scattered(docs, 40, 1, "text")
    assert counts.sum() == len(rows) and counts.max() < 40
    back = sharding.read_shards(spark, sharding.write_shards(docs, 5, buckets=40), docs)
    assert {"shard", "slot", "input_shard", "input_Slot", "__key"} <= set(back.columns)
    slots = defaultdict(list)
    for r in back.collect():
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert Counter((r["doc_id"], r["text"]) for r in back.collect()) == Counter(rows)


def test_op9(hot, monkeypatch):
    docs, rows = hot
    monkeypatch.setattr(packing, "SALTED", 10)
    got = packing.pack_documents(docs).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(i for i, _ in rows)
    assert len({(r["sequence_id"], r["offset"]) for r in got}) == len(rows)


def test_op5_and_op6(spark, hot, monkeypatch):
    docs, rows = hot
    many = spark.createDataFrame([(7, 1, 1)] * 50 + [(i, i % 2, 0) for i in range(8, 188)], "doc_id long, quality int, toxic int")
    monkeypatch.setattr(toxicity, "MAX_POSITIVE", 60)
    monkeypatch.setattr(toxicity, "MAX_UNLABELLED", 100)
    drawn = toxicity._sampled(docs, len(rows), 100, "text").count()
    assert 50 < drawn < 160
    assert toxicity.score_documents(docs, many).count() == len(rows)
    stats = quality_model.document_statistics(docs)
    assert quality_model.train(stats, many, F.lit(True), F.lit(False)).weights is not None
    assert quality_model.score_documents(docs, many).count() == len(rows)


def test_other_columns_are_kept(hot, labels):
    docs, rows = hot
    kept = near_dedup.representatives(docs)
    assert kept.columns == docs.columns and kept.count() == len({t for _, t in rows})
    assert near_dedup.classes(docs).count() == len(rows) and bpe.digest_documents(docs).count() == len(rows)
    assert quality_rules.filter_documents(docs, labels).columns == docs.columns
    assert quality_model.filter_documents(docs, labels).columns == docs.columns


def test_prefix_filter_loses_no_pair():
    rng = np.random.default_rng(5)
    for trial in range(30):
        base = rng.integers(0, 400, 60)
        texts = []
        for _ in range(24):
            t = base.copy()
            t[rng.integers(0, 60, rng.integers(0, 5))] = rng.integers(0, 400)
            texts.append(np.append(t, rng.integers(0, 9, rng.integers(0, 5))))
        bags = [np.unique(t.astype("uint64"), return_counts=True) for t in texts]
        for left in (24, 10):
            found = {(x, y) for x, ys in near_dedup.prefix_pairs(bags, left, 0.8) for y in ys.tolist()}
            want = {(x, y) for x in range(left) for y in range(x + 1, 24) if (left == 24 or y >= left) and near_dedup.similarity_of(bags[x], bags[y]) >= 0.8}
            assert want <= found and want


def test_a_memo_is_bounded():
    encoder = tokens.library_encoder("byte_bpe_50k.json", True)
    encoder.words.limit = encoder.bare.limit = 200_000
    texts = [prose(s, 300) for s in range(60)]
    fresh = tokens.library_encoder("byte_bpe_50k.json", True)
    assert [encoder.encode([t])[0] for t in texts] == fresh.encode(texts)
    assert encoder.words.size < 300_000 and encoder.words.old
