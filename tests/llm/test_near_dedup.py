"""Block comparison of near-duplicate candidates."""

from __future__ import annotations

import numpy as np

from lodestack.llm import near_dedup
from tests.llm.conftest import prose

MEMBERS = "h long, band int, key binary, label binary, short binary, bands array<long>, text string"


def members(spark, texts, bands, shorts):
    """Every node in the buckets of its bands, each with its own label."""
    keys = [bytes([i]) for i in range(len(texts))]
    rows = [(int(h), k, key, key, s, [int(x) for x in b], t) for key, t, b, s in zip(keys, texts, bands, shorts, strict=True) for k, h in enumerate(b)]
    return spark.createDataFrame(rows, MEMBERS)


def near_pair():
    words = prose(11, 200).split()
    return " ".join(words), " ".join([*words[:-1], "changed"])


def test_a_pair_is_skipped_only_where_one_bucket_held_both(spark):
    one, two = near_pair()
    bands = np.arange(2 * near_dedup.BANDS).reshape(2, -1) + 1000
    bands[1, 5] = bands[0, 5]  # the only common bucket; the 8-bit places look equal in every band
    short = bytes(near_dedup.PLACES)
    links = near_dedup.block_links(members(spark, (one, two), bands, (short, short))).collect()
    assert {frozenset((bytes(r["a"]), bytes(r["b"]))) for r in links} == {frozenset((b"\0", b"\1"))}


def test_every_pair_of_a_block_is_verified(spark):
    one, two = near_pair()
    bands = np.arange(2 * near_dedup.BANDS).reshape(2, -1) + 1000
    bands[1, 5] = bands[0, 5]
    agree = 73  # of 112 places: as few as chance allows at the similarity
    shorts = bytes(near_dedup.PLACES), bytes(agree) + b"\1" * (near_dedup.PLACES - agree)
    links = near_dedup.block_links(members(spark, (one, two), bands, shorts)).collect()
    assert {frozenset((bytes(r["a"]), bytes(r["b"]))) for r in links} == {frozenset((b"\0", b"\1"))}


def test_blocks_find_all_links(spark, monkeypatch):
    """A bucket of several blocks against every pair in turn, with other shared bands."""
    monkeypatch.setattr(near_dedup, "BLOCK", 7)
    rnd = np.random.default_rng(3)
    base = prose(12, 60).split()
    texts = [" ".join("x" if p < 0.03 else w for w, p in zip(base, rnd.random(60), strict=True)) for _ in range(40)]
    texts = list(dict.fromkeys([*texts, "same " * 50, "same " * 60, "a b"]))
    bands = np.arange(len(texts) * near_dedup.BANDS).reshape(len(texts), -1) + 1000
    bands[:, 9] = 1
    bands[::2, 3] = 2
    links = near_dedup.block_links(members(spark, texts, bands, [bytes(near_dedup.PLACES)] * len(texts))).collect()
    shingler = near_dedup.Shingler()
    bags = [shingler.bag(near_dedup.words_of(t)) for t in texts]
    want = {(i, j): s for i in range(len(bags)) for j in range(i + 1, len(bags)) if (s := near_dedup.similarity_of(bags[i], bags[j])) >= 0.8}
    got = [(tuple(sorted((r["a"][0], r["b"][0]))), r["similarity"]) for r in links]
    assert 0 < len(want) < len(bags) * (len(bags) - 1) / 2
    assert dict(got) == want and len(got) == len(want)
