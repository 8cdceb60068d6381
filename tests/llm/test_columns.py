"""Whole columns to ids: the library's ids, and a look-up for each distinct word of a group only."""

from __future__ import annotations

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lodestack.llm import common, token_store, tokens
from tests.llm.conftest import make_rows, prose

PARTS = [*" \n\t\r\0'sabX.,!_1", "Éé", "日", "́", "\x1c", "\xa0", "à", "ß", "İ", "ª", "²", "🎉", "'ll", "...", " the", "\n\n", "\n ", " \n", "\0\n", " \0", "<|endoftext|>"]
TEXTS = st.lists(st.none() | st.lists(st.sampled_from(PARTS), max_size=30).map("".join), max_size=8)


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(public_tokenizers.path(token_store.VOCABULARY))
    return lambda text: np.array(t.encode(text or "", add_special_tokens=False).ids, "<u4").tobytes()


@pytest.fixture(scope="module")
def encoder():
    return tokens.library_encoder(token_store.VOCABULARY, True)


@given(texts=TEXTS)
@settings(max_examples=400, deadline=None)
def test_columns_equal_the_library(encoder, library, texts):
    want = [library(t) for t in texts]
    for kind in (pa.string(), pa.large_string()):
        assert encoder.encode_column(pa.array(texts, kind)) == want
        assert encoder.encode_column(pa.array(["x y", *texts, " z"], kind).slice(1, len(texts))) == want


def test_groups_do_not_change_ids(encoder, library, monkeypatch):
    texts = [r[1] for r in make_rows()]
    want = [library(t) for t in texts]
    for most in (1, 700, 1 << 20):
        monkeypatch.setattr(tokens, "COLUMN_BYTES", most)
        assert encoder.encode_column(pa.array(texts)) == want


def test_a_short_memo_forgets_nothing(library):
    encoder = tokens.library_encoder(token_store.VOCABULARY, True)
    encoder.words.limit = encoder.bare.limit = 20_000
    for s in range(40):
        texts = [prose(s, 200), prose(s // 2, 200)]
        assert encoder.encode_column(pa.array(texts)) == [library(t) for t in texts]
    assert encoder.words.old and encoder.words.size < 200_000


class Counted(dict):
    """Counts look-ups."""

    n = 0

    def get(self, *a):
        self.n += 1
        return super().get(*a)


def test_python_meets_distinct_words_once():
    encoder = tokens.library_encoder(token_store.VOCABULARY, True)
    encoder.words.young = known = Counted()
    marks = (".", ",", "!", ");", "...", "")
    texts = ["x " + " ".join(f"{w}{m}" for w in ("alpha", "beta", "gamma") for m in marks) + "\nalpha. Beta"] * 300
    encoder.encode_column(pa.array(texts))
    # Three words and Beta, looked up again when they have been learned; no entry for a word with its marks.
    assert known.n <= 8 and set(known) == {"alpha", "beta", "gamma", "Beta"}


def test_words_that_a_token_could_span(encoder, library):
    # Some tokens hold a space inside; words that stand side by side in the model must not make one.
    texts = ["a \xa0 \xa0 \xa0 b", "a à àà \xc2 \xa0à", " ".join(chr(c) for c in range(0xC0, 0x250))]
    assert encoder.encode_column(pa.array(texts)) == [library(t) for t in texts]
    assert encoder.encode_many(["Ġà", "Âł", "Âł", "Âł"], " ") == [library(f" {w}") for w in ("Ġà", "Âł", "Âł", "Âł")]


def test_batches_are_gathered(monkeypatch):
    batches = [pa.RecordBatch.from_pydict({"a": [f"{i:0100}"]}) for i in range(10)]
    monkeypatch.setattr(common, "COLUMN_BYTES", 350)
    got = list(common.gathered(iter(batches)))
    assert sum(b.num_rows for b in got) == 10 and 1 < len(got) < 10 and max(b.nbytes for b in got) <= 350 and pa.Table.from_batches(got).equals(pa.Table.from_batches(batches).combine_chunks())
    assert not list(common.gathered(iter([])))
