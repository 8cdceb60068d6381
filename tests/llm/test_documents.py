"""Rules, fingerprints, classifiers, licence scans and near-duplicates against brute force."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from lodestack.llm import fingerprint, license_scan, near_dedup, quality_model, quality_rules, toxicity
from tests.compare import connection, rows as plain

SF = "/root/testdata/sf0.001"


def brute_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    hit = {i + j for i in range(len(words) - 4) for j in range(5) if windows[tuple(words[i : i + 5])] > 1}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), sum(x in lines[:i] for i, x in enumerate(lines)), len(hit)


@given(st.text(alphabet="ab \n #", max_size=80))
@settings(max_examples=200, deadline=None)
def test_counts(text):
    got = dict(zip(quality_rules._COUNTS, quality_rules.counts(text), strict=True))
    assert tuple(got[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == brute_counts(text)


def test_op2(spark, docs, rows, labels, no_labels, empty):
    got = Counter(tuple(r) for r in quality_rules.apply_rules(docs, labels).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect())
    want = Counter()
    for r in rows:
        n = brute_counts(r[1])
        want[(r[0], *n, n[0] < 10 or 100 * n[4] > 20 * n[0])] += 1
    assert got == want
    assert quality_rules.apply_rules(empty, labels).count() == 0
    assert all(r["kept"] != r["base_failed"] for r in quality_rules.apply_rules(docs, no_labels).collect())
    kept = quality_rules.filter_documents(docs, no_labels)
    assert kept.columns == docs.columns and kept.count() == sum(not k[-1] for k in want.elements())


def test_binomial_bound():
    # The bound of 0 of n is 1 - level ** (1 / n).
    for n in (10, 100, 1000):
        p = 1 - 0.05 ** (1 / n)
        assert quality_rules.at_most(0, n, p * 1.0001, 0.05) and not quality_rules.at_most(0, n, p * 0.9999, 0.05)
    assert not quality_rules.at_most(0, 0, 0.5, 0.05)


def test_cutoffs_control_false_rejection(spark):
    rng = np.random.default_rng(0)
    n = 5000
    good = [(int(i), 200, 1000, int(s), 10, 0, 0, 0, 0, 0) for i, s in enumerate(rng.poisson(3, n))]
    df = spark.createDataFrame(good, "doc_id long, " + ", ".join(f"{c} long" for c in quality_rules._COUNTS))
    cutoffs = quality_rules.choose_cutoffs(df)
    for (stratum, rule), c in cutoffs.items():
        assert stratum == 2
        if rule == "symbol_ratio":
            assert np.mean([g[3] / 200 > c for g in good]) <= quality_rules.RISK
    assert (2, "symbol_ratio") in cutoffs


def test_paragraphs_are_the_text(rows):
    for r in rows:
        assert "".join(fingerprint.paragraphs(r[1] or "")) == (r[1] or "")


@given(st.lists(st.integers(0, 2**64 - 1), max_size=60, unique=True), st.lists(st.integers(0, 2**64 - 1), max_size=20, unique=True))
@settings(max_examples=60, deadline=None)
def test_peeling_recovers_the_difference(a, b):
    one, two = fingerprint.Document(""), fingerprint.Document("")
    one.items, two.items = a, [*a[:40], *(x for x in b if x not in a)]
    only_a, only_b = fingerprint.difference(one, two)
    assert set(only_a) == set(a) - set(two.items) and set(only_b) == set(two.items) - set(a)


def test_numbers_of_paragraphs_are_no_text():
    # Both were the digest of "1\0x. ", which no table of any size could peel: they grew until the memory was out.
    text = "x. x. 1\0x. 0\0x. "
    assert len(set(fingerprint.digests(text))) == 4
    assert fingerprint.likeness(fingerprint.Document(text), fingerprint.Document("y. ")) == (0.0, 5)
    assert fingerprint.likeness(fingerprint.Document(text), fingerprint.Document(text)) == (1.0, 0)


def test_peeling_ends_at_a_wrong_digest():
    # A cell that passes as a single digest by chance: the digest's other cells don't hold it, so it came back without end.
    table = fingerprint.Sketch(16, [12345])
    for at in (16 + (12345 >> 20 & 15), 32 + (12345 >> 40 & 15)):
        table.counts[at] = table.sums[at] = 0
    assert table.peel() is None
    assert fingerprint.Sketch(16, [12345]).peel() == ([12345], [])


def test_op3(docs, rows, empty):
    got = fingerprint.compare_documents(docs).collect()
    tie = {r["t"]: r["h"] for r in docs.select(F.coalesce("text", F.lit("")).alias("t"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).collect()}
    ordered = sorted(((r[0], r[1] or "") for r in rows), key=lambda r: (r[0] is None, -(r[0] or 0), -tie[r[1]]))
    want = Counter()
    prints = {}
    for i, (doc_id, text) in enumerate(ordered):
        following = ordered[(i + 1) % len(ordered)][1]
        edited = text[: len(text) - len(text) // 3] + following[: len(text) // 3]
        a, b, c = (Counter(fingerprint.digests(t)) for t in (text, edited, following))
        like = lambda x, y: 2 * sum((x & y).values()) / (sum(x.values()) + sum(y.values())) if x or y else 1.0
        want[doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), round(like(a, b), 9), round(like(a, c), 9)] += 1
        prints[text] = fingerprint.Document(text).fingerprint()
    assert Counter((r["doc_id"], r["n_chars"], r["edited_sha256"], round(r["near_edited"], 9), round(r["near_next"], 9)) for r in got) == want
    assert {r["fingerprint"] for r in got} == set(prints.values()) and len(set(prints.values())) == len(prints)
    n, table = fingerprint.parse(prints[ordered[5][1]])
    assert table.text(n) == prints[ordered[5][1]]
    assert fingerprint.compare_documents(empty).count() == 0


def test_nnpu_finds_the_signal():
    rng = np.random.default_rng(0)
    positive = [np.unique(np.append(rng.integers(5, 50, 3), rng.integers(0, 5, 2))) for _ in range(150)]
    unlabelled = [rng.integers(5, 50, 3) for _ in range(900)] + [np.append(rng.integers(5, 50, 3), rng.integers(0, 5, 2)) for _ in range(100)]
    w, bias = toxicity.fit_nnpu(positive, [np.unique(u) for u in unlabelled], 50, 0.1)
    score = lambda f: bias + w[f].sum()
    assert min(map(score, positive)) > np.percentile([score(np.unique(u)) for u in unlabelled[:900]], 99)


def test_op5(docs, labels, no_labels, empty, rows):
    for l in (labels, no_labels):
        got = toxicity.score_documents(docs, l).collect()
        assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got)
    assert toxicity.score_documents(empty, labels).count() == 0


def test_op6(docs, labels, no_labels, empty, rows):
    for l in (labels, no_labels):
        got = quality_model.score_documents(docs, l).collect()
        assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got)
    assert quality_model.score_documents(empty, labels).count() == 0
    kept = quality_model.filter_documents(docs, no_labels, 0.6)
    assert kept.columns == docs.columns and kept.count() == 0


def test_isotonic():
    assert quality_model.isotonic(np.array([0.0, 1, 0, 1]), np.ones(4)).tolist() == [0, 0.5, 0.5, 1]
    rng = np.random.default_rng(1)
    fit = quality_model.isotonic(rng.normal(size=100), np.ones(100))
    assert (np.diff(fit) >= 0).all()


@pytest.mark.parametrize(("name", "label", "least"), [("op5_toxicity", "toxic", 0.85), ("op6_quality_model", "quality", 0.95)])
def test_held_out_accuracy(spark, name, label, least):
    sf = SF.replace("0.001", "0.01")
    got = __spark_entry__.queries()[name](spark, sf).toPandas()
    truth = spark.read.parquet(f"{sf}/labels.parquet").toPandas()
    both = got.merge(truth, on="doc_id")
    both = both[both["held_out"]]
    order, y = both["score"].rank(), both[label] == 1
    auc = (order[y].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (~y).sum())
    assert auc > least


def brute_base(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(license_scan.WORD, low)
    places = [(i, label) for phrase, label in license_scan.BASE.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    return len(words), len(places), min((p for p, _ in places), default=None), max((p for p, _ in places), default=None), ",".join(sorted({x for _, x in places}))


def test_op7(docs, rows, empty):
    got = license_scan.scan(docs).collect()
    assert Counter((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in got) == Counter((r[0], *brute_base(r[1])) for r in rows)
    by = {r["doc_id"]: r for r in got}
    assert by[12]["labels"] == "cc-by,gpl,gpl-3.0,reserved" and by[13]["labels"] == "cc-by,cc-by-nc-4.0"
    assert 0 < by[14]["score"] < 1  # a word in between: the neighbouring diagonals make one span
    assert by[0]["labels"] == "" and by[0]["score"] == 0
    assert license_scan.scan(empty).count() == 0


def test_op7_sql(spark):
    got = license_scan.scan(spark.read.parquet(f"{SF}/documents.parquet")).toPandas()
    assert plain(got) == plain(connection(SF).sql(license_scan.oracle_sql()).df())


def brute_bag(text):
    words = (text or "").encode().split()
    n = min(5, len(words))
    return Counter(tuple(words[i : i + n]) for i in range(len(words) - n + 1)) if words else Counter()


def brute_classes(texts, least=0.8):
    bags, parent = [brute_bag(t) for t in texts], list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(bags):
        for j in range(i):
            both = sum((a | bags[j]).values())
            if (sum((a & bags[j]).values()) >= least * both) if both else True:
                parent[find(i)] = find(j)
    return [find(i) for i in range(len(texts))]


def test_bag_minhash_is_unbiased():
    rng = np.random.default_rng(3)
    shingles = rng.integers(0, 2**63, 300, dtype="uint64")
    a, b = rng.integers(1, 9, 300), rng.integers(1, 9, 300)
    want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    order = np.argsort(shingles)
    s = near_dedup.bag_minhash([(shingles[order], a[order]), (shingles[order], b[order])], 4000)
    assert abs((s[0] == s[1]).mean() - want) < 4 * math.sqrt(want * (1 - want) / 4000)


def test_op10(spark, docs, rows, empty):
    got = near_dedup.classes(docs).collect()
    roots = brute_classes([r[1] for r in rows])
    least = {}
    for root, r in zip(roots, rows, strict=True):
        if r[0] is not None:
            least[root] = min(least.get(root, r[0]), r[0])
    assert Counter((r["doc_id"], r["class_id"]) for r in got) == Counter((r[0], least.get(x)) for x, r in zip(roots, rows, strict=True))
    kept = near_dedup.representatives(docs)
    assert kept.columns == docs.columns and kept.count() == len(set(roots))
    assert near_dedup.classes(empty).count() == 0 and near_dedup.representatives(empty).count() == 0


def test_op10_loses_no_link(spark):
    """A family of texts with more and more edits: links are near the threshold and some only hold between non-hubs."""
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in rng.integers(0, 400, 150)]
    texts = []
    for i in range(150):
        words = list(base)
        for at in rng.integers(0, 150, int(rng.integers(0, 7))):
            words[at] = f"x{i}-{at}"
        texts.append(" ".join(words))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.classes(df).collect()}
    roots = brute_classes(texts)
    assert got == {i: roots.index(r) for i, r in enumerate(roots)}


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    stage, now = dict(corpus_pipeline.STAGES), docs
    good = stage["quality_classifier"](spark, now, SF)
    assert good.columns == docs.columns and 0 < good.count() <= len(before)
    ruled = stage["quality_rules"](spark, good, SF)
    assert all(not (n[0] < 10 or 100 * n[4] > 20 * n[0]) for n in (brute_counts(r["text"]) for r in ruled.collect()))
    texts = [r["text"] for r in ruled.collect()]
    distinct = stage["near_dedup"](spark, ruled, SF)
    assert distinct.columns == docs.columns and distinct.count() == len(set(brute_classes(texts)))
    pieces = stage["packing"](spark, distinct, SF)
    assert pieces.select("doc_id").distinct().count() == distinct.count()
    assert corpus_pipeline.run(spark, SF).count() == pieces.count()
