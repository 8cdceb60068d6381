"""Encoders against their libraries, the token store, packing and sharding against their laws."""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lodestack.llm import bpe, packing, sharding, token_store, tokens

TEXT = st.text(alphabet=st.sampled_from(list(" \n\t'sabcXÉé日1.,!_́\x1c ßİ")), max_size=60)


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.vocabulary_of(bpe.VOCABULARY)


@pytest.fixture(scope="module")
def tik(vocabulary):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocabulary.ranks, special_tokens={})


def library(name):
    t = Tokenizer.from_file(public_tokenizers.path(name))
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


ENCODERS = {}


def own(name):
    if name not in ENCODERS:
        ENCODERS[name] = bpe.text_encoder(bpe.vocabulary_of(bpe.VOCABULARY), public_tokenizers.PATTERN) if name == "prefix" else tokens.library_encoder(name, name.startswith("byte"))
    return lambda text: np.frombuffer(ENCODERS[name].encode([text])[0], "<u4").tolist()


@given(TEXT)
@settings(max_examples=400, deadline=None)
def test_encoders_equal_the_libraries(text):
    v = bpe.vocabulary_of(bpe.VOCABULARY)
    tik = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=v.ranks, special_tokens={})
    assert own("prefix")(text) == tik.encode_ordinary(text)
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        assert own(name)(text) == library(name)(text)


@given(st.binary(max_size=40), st.binary(max_size=10), st.integers(0, 40), st.integers(0, 10))
@settings(max_examples=200, deadline=None)
def test_prefix_table_edits(data, new, at, length):
    v = bpe.vocabulary_of(bpe.VOCABULARY)
    at = min(at, len(data))
    table = bpe.PrefixTable(v, data)
    assert table.ids() == v.merge(data)
    table.replace(at, min(len(data), at + length), new)
    edited = data[:at] + new + data[at + length :]
    assert table.ids() == v.merge(edited) and bpe.decode(table.ids(), v) == edited


@given(st.lists(st.tuples(st.integers(0, 60), st.integers(0, 6), TEXT), max_size=5))
@settings(max_examples=150, deadline=None)
def test_text_state_edits(edits):
    v = bpe.vocabulary_of(bpe.VOCABULARY)
    tik = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=v.ranks, special_tokens={})
    state = bpe.TextState(v, public_tokenizers.PATTERN, "start of it")
    for at, length, new in edits:
        at = min(at, len(state.text))
        state.edit(at, min(len(state.text), at + length), new)
        assert state.ids() == tik.encode_ordinary(state.text)


def test_op1(docs, rows, tik, empty):
    got = Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe.digest_documents(docs).collect())
    want = Counter()
    for r in rows:
        ids = tik.encode_ordinary(r[1] or "")
        want[r[0], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((r[1] or "").encode()).hexdigest()] += 1
    assert got == want
    assert bpe.digest_documents(empty).count() == 0
    assert {bytes(r["decoded"]) for r in bpe.encode_documents(docs).collect()} == {(r[1] or "").encode() for r in rows}


@given(st.lists(st.integers(0, 2**32 - 1), max_size=1500))
@settings(max_examples=40, deadline=None)
def test_codes_are_directly_addressable(ids):
    codes = token_store.Codes(token_store.pack(np.array(ids, dtype="<u4")))
    assert codes.all().tolist() == ids and len(codes) == len(ids)
    for i in range(0, len(ids), 7):
        assert codes[i] == ids[i]
    with pytest.raises(IndexError):
        codes[len(ids)]


def test_op8(spark, docs, rows, empty):
    encode = library(token_store.VOCABULARY)
    path = token_store.write(docs, ranges=3)
    got = token_store.read_digests(spark, path).collect()
    want, at = [], 0
    for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = np.array([*encode(r[1]), token_store.END], "<u4")
        want.append((r[0], at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted((tuple(r) for r in got), key=lambda r: r[1]) == want
    assert token_store.token_at(spark, path, 9, 5) == encode(rows[9][1])[5]
    assert token_store.token_at(spark, path, 9, 10**6) is None and token_store.token_at(spark, path, -5, 0) is None
    assert token_store.read_digests(spark, token_store.write(empty)).count() == 0


def test_files_are_cut(spark, docs, rows, monkeypatch):
    monkeypatch.setattr(token_store, "FILE_TOKENS", 500)
    got = token_store.read(spark, token_store.write(docs, ranges=2)).collect()
    ends = sorted((r["start"], r["start"] + r["n_tokens"]) for r in got)
    assert len(got) == len(rows) and all(a[1] == b[0] for a, b in zip(ends, ends[1:], strict=False))


@pytest.mark.parametrize("seed", range(4))
def test_plan_uses_up_the_histogram(seed):
    rng = np.random.default_rng(seed)
    lengths = np.clip(rng.lognormal(3 + seed, 1, 3000).astype(int), 1, 256)
    histogram = np.bincount(lengths, minlength=257)
    found = packing.plan(histogram, 256, 32)
    used = np.zeros(257, dtype=int)
    for parts, times in found:
        assert sum(parts) <= 256 and times > 0
        for x in parts:
            used[x] += times
    assert (used == histogram).all()
    assert sum(t for _, t in found) <= 1.03 * -(-lengths.sum() // 256) + 1


def test_nnls():
    a, b = np.array([[1.0, 0, 2], [0, 1, 1]]), np.array([2.0, 3])
    x = packing.nnls(a, b)
    assert (x >= 0).all() and np.allclose(a @ x, b)
    assert np.allclose(packing.nnls(np.array([[1.0]]), np.array([-1.0])), 0)


def test_op9(docs, rows, empty):
    encode = library(packing.VOCABULARY)
    got = packing.pack_documents(docs).collect()
    want = Counter()
    for r in rows:
        ids = np.array([*encode(r[1]), packing.END], "<u4")
        for n, at in enumerate(range(0, len(ids), packing.SEQUENCE)):
            part = ids[at : at + packing.SEQUENCE]
            want[r[0], n, at, len(part), zlib.crc32(part.tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    places = defaultdict(list)
    for r in got:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in places.values():
        parts.sort()
        assert parts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:], strict=False)) and sum(parts[-1]) <= packing.SEQUENCE
    assert len(places) <= -(-sum(r["length"] for r in got) // packing.SEQUENCE) + 2
    assert packing.pack_documents(empty).count() == 0


def test_op4(docs, rows, empty):
    got = sharding.shard_documents(docs, 7).collect()
    want = Counter((r[0], len((r[1] or "").encode()) + 16, zlib.crc32((r[1] or "").encode())) for r in rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    sizes = [len(s) for s in slots.values()]
    assert len(slots) == 7 and max(sizes) - min(sizes) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    known = docs.filter("doc_id is not null").dropDuplicates(["doc_id"])
    one, two = ({(r["doc_id"], r["shard"], r["slot"]) for r in sharding.shard_documents(d, 7).collect()} for d in (known, known.repartition(3)))
    assert one == two
    assert sharding.shard_documents(empty, 7).count() == 0


def test_fisher_yates_is_uniform():
    seen = Counter(tuple(sharding.fisher_yates(3, np.random.default_rng(s))) for s in range(3000))
    assert len(seen) == 6 and min(seen.values()) > 400


def test_written_shards_hold_the_records(spark, docs, rows):
    path = sharding.write_shards(docs, 3)
    back = sharding.read_shards(spark, path, docs)
    assert Counter(r["text"] for r in back.collect()) == Counter(r[1] for r in rows)
