"""Byte-level BPE by prefix dynamic programming.

Every prefix of a byte string has one valid last token: the token t that ends there such that t is what BPE makes of
its own bytes, and BPE leaves the pair (last token of the prefix before t, t) as it is. A PrefixTable stores that
token for each prefix, so bytes can be appended, cut off or replaced, and only prefixes after the change are
computed again; the ids are read from the end backwards. TextState does the same for a whole text whose pattern
matches (pieces) are encoded separately.

Documents are encoded where they are, without a shuffle: a null text counts as empty, an empty one has no ids, a very
long one is encoded whole, and repeated rows each give a row. Other columns, whatever their names, are not looked at.
An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import os
from array import array
from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from lodestack.llm.common import trimmed
from lodestack.llm.tokens import WordEncoder, ranks_of, worker_encoder

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Pairs of tokens whose validity is remembered.
PAIR_MEMO = 1_000_000
#: Pieces before a change that are matched again: a match looks at most this many pieces ahead.
LOOK_BACK = 3


class Vocabulary:
    """Ranks of tokens and which of their pairs BPE leaves as they are."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.tokens = {i: b for b, i in ranks.items()}
        #: Of tokens that end in these two bytes (or are this one), the longest one's length.
        self.longest: dict[bytes, int] = {}
        for b in ranks:
            self.longest[b[-2:]] = max(self.longest.get(b[-2:], 0), len(b))
        self._pairs: dict[int, bool] = {}
        self._inner: dict[int, tuple[int, int] | None] = {}
        self._edges: tuple[dict[int, list[int]], dict[int, list[int]]] = ({}, {})

    def merge(self, data: bytes, until: int = 1) -> list[int]:
        """Plain BPE: merge the adjacent parts of the lowest rank, leftmost first, until none is in the vocabulary or `until` are left."""
        parts = [data[i : i + 1] for i in range(len(data))]
        ranks = self.ranks
        while len(parts) > until:
            best, at = min((ranks.get(parts[i] + parts[i + 1], 1 << 40), i) for i in range(len(parts) - 1))
            if best == 1 << 40:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [ranks[p] for p in parts]

    def inner(self, token: int) -> tuple[int, int] | None:
        """The two tokens that BPE merges last into this one; None for a byte, (-1, -1) if BPE doesn't make it."""
        if token not in self._inner:
            data = self.tokens[token]
            two = self.merge(data, 2) if len(data) > 1 else None
            self._inner[token] = None if two is None else (two[0], two[1]) if len(two) == 2 else (-1, -1)
        return self._inner[token]

    def alone(self, token: int) -> bool:
        """Whether BPE makes this token of its own bytes."""
        return self.inner(token) != (-1, -1)

    def _edge(self, token: int, side: int) -> list[int]:
        """The parts at one end of a token, as BPE builds it: from its last byte (side 1) or first byte (0) to itself."""
        known = self._edges[side]
        if token not in known:
            out, at = [token], self.inner(token)
            while at is not None:
                out.append(at[side])
                at = self.inner(at[side])
            known[token] = out[::-1]
        return known[token]

    def pair(self, left: int, right: int) -> bool:
        """Whether BPE of the two tokens' bytes is the two tokens: at no time would it rather merge across the border.

        Both must be tokens that BPE makes. Parts at the border grow in the order of their ranks; of equal ranks the
        leftmost merge goes first.
        """
        key = left << 32 | right
        found = self._pairs.get(key)
        if found is None:
            if len(self._pairs) >= PAIR_MEMO:
                self._pairs.clear()
            found = self._pairs[key] = self._apart(self._edge(left, 1), self._edge(right, 0))
        return found

    def _apart(self, before: list[int], after: list[int]) -> bool:
        i = j = 0
        tokens, get, never = self.tokens, self.ranks.get, 1 << 40
        while True:
            next_left = before[i + 1] if i + 1 < len(before) else never
            next_right = after[j + 1] if j + 1 < len(after) else never
            across = get(tokens[before[i]] + tokens[after[j]], never)
            if across < next_left and across <= next_right and across != never:
                return False
            if next_left == next_right == never:
                return True
            if next_left <= next_right:
                i += 1
            else:
                j += 1


class PrefixTable:
    """The last token of each prefix of a byte string."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b"") -> None:
        self.vocabulary, self.data, self.last = vocabulary, b"", []
        self.append(data)

    def append(self, more: bytes) -> None:
        """Add bytes at the end; the table of the old prefixes stands."""
        v, last, start = self.vocabulary, self.last, len(self.last)
        data = self.data = self.data + more
        get, pairs, pair, longest = v.ranks.get, v._pairs.get, v.pair, v.longest
        for end in range(start + 1, len(data) + 1):
            first = end - longest.get(data[end - 2 : end], 1) if end > 1 else 0
            for begin in range(first if first > 0 else 0, end):
                token = get(data[begin:end])
                if token is None:
                    continue
                if begin == 0:
                    if v.alone(token):
                        break
                    continue
                left = last[begin - 1]
                known = pairs(left << 32 | token)
                if known is None:
                    known = v.alone(token) and pair(left, token)
                if known:
                    break
            else:
                raise ValueError("a byte is not in the vocabulary")
            last.append(token)

    def cut(self, length: int) -> None:
        """Keep a prefix."""
        self.data = self.data[:length]
        del self.last[length:]

    def replace(self, start: int, end: int, new: bytes) -> None:
        """Put other bytes in place of [start, end); prefixes up to start keep their tokens."""
        tail = self.data[end:]
        self.cut(start)
        self.append(new + tail)

    def ids(self) -> list[int]:
        """The encoding of the whole string."""
        out, at, last, tokens = [], len(self.last), self.last, self.vocabulary.tokens
        while at:
            token = last[at - 1]
            out.append(token)
            at -= len(tokens[token])
        return out[::-1]


class TextState:
    """A text with its pieces' tables, for exact appends and edits."""

    def __init__(self, vocabulary: Vocabulary, pattern: str, text: str = "") -> None:
        self.vocabulary, self.pattern = vocabulary, regex.compile(pattern)
        self.text, self.starts, self.tables = "", [], []
        self.edit(0, 0, text)

    def append(self, more: str) -> None:
        self.edit(len(self.text), len(self.text), more)

    def edit(self, start: int, end: int, new: str) -> None:
        """Replace text[start:end]; pieces are matched anew from a little before it until a match starts where an old one did."""
        old_starts, old_tables, shift = self.starts, self.tables, len(new) - (end - start)
        keep = max(0, next((i for i, s in enumerate(old_starts) if s >= start), len(old_starts)) - LOOK_BACK)
        self.text = self.text[:start] + new + self.text[end:]
        later = {s + shift: i for i, s in enumerate(old_starts) if s >= end}
        starts, tables = old_starts[:keep], old_tables[:keep]
        at = old_starts[keep] if keep < len(old_starts) else 0
        for m in self.pattern.finditer(self.text, at):
            if m.start() >= start + len(new) and m.start() in later:
                i = later[m.start()]
                starts += [s + shift for s in old_starts[i:]]
                tables += old_tables[i:]
                break
            data = m.group().encode()
            was = old_tables[len(tables)] if len(tables) < len(old_tables) else None
            same = 0
            if was is not None and m.start() == old_starts[len(tables)]:
                while same < min(len(was.data), len(data)) and was.data[same] == data[same]:
                    same += 1
            table = PrefixTable(self.vocabulary)
            if same:
                table.data, table.last = was.data[:same], was.last[:same]
            table.append(data[same:])
            starts.append(m.start())
            tables.append(table)
        self.starts, self.tables = starts, tables

    def ids(self) -> list[int]:
        return [i for t in self.tables for i in t.ids()]


def decode(ids: Iterable[int], vocabulary: Vocabulary) -> bytes:
    """The bytes of ids."""
    return b"".join(map(vocabulary.tokens.__getitem__, ids))


def encode_pieces(vocabulary: Vocabulary, pieces: Iterable[bytes]) -> dict[bytes, bytes]:
    """Ids of byte strings, each on its own. In sorted order, a string shares a prefix and so a part of its table with the one before."""
    out, table = {}, PrefixTable(vocabulary)
    for data in sorted(pieces):
        was = table.data
        same = len(os.path.commonprefix((was, data)))
        table.cut(same)
        table.append(data[same:])
        out[data] = array("I", table.ids()).tobytes()
    return out


def text_encoder(vocabulary: Vocabulary, pattern: str) -> WordEncoder:
    """Whole texts by prefix tables of their pieces."""
    find = regex.compile(pattern).findall

    def many(strings: list[str], lead: str) -> list[bytes]:
        strings = [lead + s for s in strings]
        # A surrogate can't stand in a Spark string, so encoding doesn't fail.
        found = [[s.encode()] if len(s) > 1 and s[1:].isalpha() and (s[0] == " " or s[0].isalpha()) else [p.encode() for p in find(s)] for s in strings]
        ids = encode_pieces(vocabulary, {p for ps in found for p in ps}).__getitem__
        return [ids(ps[0]) if len(ps) == 1 else b"".join(map(ids, ps)) for ps in found]

    return WordEncoder(many, spaced=True)


_VOCABULARIES: dict[str, Vocabulary] = {}


def vocabulary_of(name: str) -> Vocabulary:
    """One vocabulary of each name in a process."""
    if name not in _VOCABULARIES:
        _VOCABULARIES[name] = Vocabulary(ranks_of(name))
    return _VOCABULARIES[name]


def encode_documents(docs: DataFrame, vocabulary: str = VOCABULARY, text: str = "text") -> DataFrame:
    """doc_id, ids (binary, little-endian unsigned 32-bit), n_tokens and decoded bytes of every text.

    A null text counts as empty; an empty text has no ids. Rows stay where they are: no shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, v = _worker(vocabulary)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            ids = encoder.encode(texts)
            tokens = v.tokens.__getitem__
            decoded = [b"".join(map(tokens, memoryview(i).cast("I"))) if i else b"" for i in ids]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array(decoded, pa.binary())],
                ["doc_id", "n_tokens", "ids", "decoded"],
            )

    return docs.selectExpr("cast(doc_id as bigint) doc_id", text).mapInArrow(trimmed(run, encodes=True), "doc_id long, n_tokens long, ids binary, decoded binary")


def digest_documents(docs: DataFrame, vocabulary: str = VOCABULARY, text: str = "text") -> DataFrame:
    """encode_documents with sha256 digests of ids and decoded bytes in place of both; digests are taken where the ids are made."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, v = _worker(vocabulary)
        tokens = v.tokens.__getitem__
        for batch in batches:
            ids = encoder.encode([t or "" for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(i) // 4 for i in ids], pa.int64()),
                    pa.array([hashlib.sha256(i).hexdigest() for i in ids]),
                    pa.array([hashlib.sha256(b"".join(map(tokens, memoryview(i).cast("I"))) if i else b"").hexdigest() for i in ids]),
                ],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.selectExpr("cast(doc_id as bigint) doc_id", text).mapInArrow(trimmed(run, encodes=True), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _worker(name: str) -> tuple[WordEncoder, Vocabulary]:
    import public_tokenizers

    v = vocabulary_of(name)
    return worker_encoder(f"prefix {name}", lambda: text_encoder(v, public_tokenizers.PATTERN)), v
