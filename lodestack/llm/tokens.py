"""Whole texts to token ids, a word at a time with a bounded memo.

A byte-level pattern never matches across a single space or line end that stands between two non-space characters,
and the word-level pattern never matches across either; so words are encoded on their own and their ids joined. The
ids are exactly those of the whole text. A text that holds an added token's string is encoded whole by the library,
which makes one id of it.

A memo is two generations of words: when the young one is full it becomes the old one, whose words move up as they
are met again. So frequent words stay, and its bytes are bounded. Empty texts have no ids; very long ones are split
like any others.

Byte-level texts that come as an Arrow column are cut, and their ids joined, by Arrow: Python meets a group's distinct
words only, the marks after them apart.
"""

from __future__ import annotations

import base64
import codecs
import contextlib
import gc
import os
import re
import string
from array import array
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes that the words and ids of one memo take, in both generations.
MEMO_BYTES = 224 << 20
#: Bytes of an entry besides the characters and ids: two object heads and the dictionary's own.
ENTRY = 190
#: Words that the library's model gets in one string, and strings in one call.
RUN, RUNS = 200, 16
#: Characters of the texts that are split at once.
GROUP_CHARS = 1_500_000
#: Bytes of the texts of a column that are split at once, or one text: the more, the fewer distinct words to look up.
COLUMN_BYTES = 12 << 20

_SAFE = re.compile(r"(?<=\S) (?=\S)")
_LINE = re.compile(r"(?<=\S)\n(?=\S)")
#: Lines of letters that no normaliser joins or parts and that are letters in every Unicode version.
_PLAIN = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f\u0400-\u0481\u4e00-\u9fa5\n]+")
#: What stands before a line end in a word that begins a line: "\0\n" at a word's start is always such a mark.
_OPENS = "\0\n"


def ranks_of(name: str) -> dict[bytes, int]:
    """A tiktoken vocabulary file as bytes -> rank; the file comes with the public_tokenizers package on each machine."""
    import public_tokenizers

    with open(public_tokenizers.path(name), "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@contextlib.contextmanager
def uncollected() -> Iterator[None]:
    """Without the cycle collector, which would walk the memos again and again: encoding makes no cycles."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


class Memo:
    """Strings and their ids, in two generations of together at most `limit` bytes (and one group of texts more)."""

    def __init__(self, limit: int) -> None:
        self.limit, self.size = limit, 0
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def turn(self) -> None:
        """Make room, between groups."""
        if self.size > self.limit // 2:
            self.old, self.young, self.size = self.young, {}, 0

    def add(self, strings: list[str], ids: list[bytes]) -> None:
        self.young.update(zip(strings, ids, strict=True))
        self.size += ENTRY * len(strings) + sum(map(len, strings)) + sum(map(len, ids))

    def recall(self, lacking: set[str]) -> set[str]:
        """Those of strings that the young generation lacks which the old one lacks too; the others move up."""
        old = self.old
        if not old or not (again := [s for s in lacking if s in old]):
            return lacking
        self.add(again, [old[s] for s in again])
        return lacking.difference(again)


class WordEncoder:
    """Texts to ids (little-endian unsigned 32-bit, as bytes) through `encode_many`, which maps strings, each with the
    lead that it is given (a space or nothing) before it, to ids.

    spaced: a word keeps the space before it (byte-level vocabularies); such a word with white space at an end, or
    an empty one, makes its text be cut anew, at safe spaces only. ASCII marks after letters are encoded apart from
    them. whole: strings whose texts `encode_many` gets as they are.
    """

    def __init__(self, encode_many: Callable[[list[str], str], list[bytes]], spaced: bool, memo: int = MEMO_BYTES, whole: Iterable[str] = ()) -> None:
        self.encode_many, self.spaced, self.whole = encode_many, spaced, tuple(whole)
        #: Ids of words with their space before them, and of strings without one.
        self.words = Memo(memo if not spaced else memo * 3 // 4)
        self.bare = self.words if not spaced else Memo(memo // 4)

    def _words(self, text: str) -> list[str]:
        """A text's words; one that begins a line has _OPENS before it."""
        if not self.spaced:
            return text.replace("\n", " ").split(" ")
        if "\n" not in text:
            return text.split(" ")
        if "\n\n" in text or "\n " in text or " \n" in text:
            return _LINE.sub(" \0\n", text).split(" ")
        return text.replace("\n", " \0\n").split(" ")

    def _encode_into(self, memo: Memo, strings: set[str], lead: str) -> None:
        """Put strings into a memo, those that it lacks, with `lead` before each."""
        if lacking := list(memo.recall({s for s in strings if s not in memo.young})):
            memo.add(lacking, self.encode_many(lacking, lead))

    def _learn(self, lacking: set[str]) -> None:
        """Put ids of words that the memo lacks into it; those that can't be encoded on their own stay out."""
        spaced, words, bare = self.spaced, self.words, self.bare
        lead, marks = " " if spaced else "", string.punctuation
        lacking = words.recall(lacking)
        plain = [w for w in lacking if w.isalpha()]
        whole: set[str] = set()
        later: set[str] = {"\n"}
        #: Words of several parts: those that begin with a spaced word, and those of a line's start.
        marked: list[tuple[str, str, str]] = []
        opening: list[tuple[str, str, str]] = []
        for w in lacking.difference(plain):
            stem = w.rstrip(marks)
            # A capital I with a dot ends in a mark when lowered, which would join the marks after it.
            if stem.isalpha() and (stem.isascii() or stem.lower().isalpha()):
                marked.append((w, stem, w[len(stem) :]))
                continue
            if not spaced:
                whole.add(w)
            elif w.startswith(_OPENS):
                stem = stem[2:]
                if stem.isalpha():
                    opening.append((w, stem, w[len(stem) + 2 :]))
                elif (stem := w[2:]) and not stem[0].isspace() and not stem[-1].isspace():
                    opening.append((w, stem, ""))
            elif not w[0].isspace() and not w[-1].isspace():
                whole.add(w)
        if plain:
            words.add(plain, self.encode_many(plain, lead))
        whole.update([s for _, s, _ in marked])
        later.update([m for _, _, m in marked])
        later.update([s for _, s, _ in opening], [m for _, _, m in opening])
        later.discard("")
        self._encode_into(words, whole, lead)
        self._encode_into(bare, later, "")
        known, apart = words.young, bare.young
        if marked:
            words.add([w for w, _, _ in marked], [known[s] + apart[m] for _, s, m in marked])
        if opening:
            line = apart["\n"]
            words.add([w for w, _, _ in opening], [line + apart[s] + apart[m] if m else line + apart[s] for _, s, m in opening])

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text."""
        out: list[bytes] = []
        at = 0
        while at < len(texts):
            end, chars = at, 0
            while end < len(texts) and (end == at or chars + len(texts[end]) <= GROUP_CHARS):
                chars += len(texts[end])
                end += 1
            with uncollected():
                out += self._group(texts[at:end])
            at = end
        return out

    def _group(self, texts: list[str]) -> list[bytes]:
        if any(s in t for s in self.whole for t in texts):
            odd = {i for i, t in enumerate(texts) if any(s in t for s in self.whole)}
            plain = iter(self._group([t for i, t in enumerate(texts) if i not in odd]))
            return [self.encode_many([t], "")[0] if i in odd else next(plain) for i, t in enumerate(texts)]
        self.words.turn()
        self.bare.turn()
        split = list(map(self._words, texts))
        heads = [w.pop(0) for w in split] if self.spaced else []
        known = self.words.young
        if not self.spaced:
            known[""] = b""
        found = [list(map(known.get, words)) for words in split]
        holes = [[k for k, i in enumerate(ids) if i is None] for ids in found]
        lacking = {words[k] for words, ks in zip(split, holes, strict=True) for k in ks}
        lacking.discard("")
        if lacking:
            self._learn(lacking)
            get = known.get
            for words, ids, ks in zip(split, found, holes, strict=True):
                for k in ks:
                    ids[k] = get(words[k])
        if not self.spaced:
            return list(map(b"".join, found))
        self._encode_into(self.bare, {h for h in heads if h}, "")
        bare = self.bare.young
        out = []
        for text, head, ids in zip(texts, heads, found, strict=True):
            try:
                out.append((bare[head] if head else b"") + b"".join(ids))
            except TypeError:  # a None
                out.append(self._safely(text))
        return out

    def encode_column(self, texts: pa.Array) -> list[bytes]:
        """Ids of each text (null: empty) of an Arrow column, for a vocabulary whose words keep the space before them."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        ends = np.cumsum(pc.binary_length(texts).to_numpy())
        out: list[bytes] = []
        at = 0
        while at < len(texts):
            before = ends[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(ends, before + COLUMN_BYTES, "right")))
            with uncollected():
                out += self._column(texts.slice(at, end - at))
            at = end
        return out

    def _column(self, texts: pa.LargeStringArray) -> list[bytes]:
        starts, data = _buffers(texts)
        held = bytes(memoryview(data)[starts[0] : starts[-1]])
        if seen := [s for s in self.whole if s.encode() in held]:
            odd = np.logical_or.reduce([pc.match_substring(texts, s).to_numpy(zero_copy_only=False) for s in seen])
            if odd.any():
                rest = iter(self._column(texts.filter(pa.array(~odd))) if not odd.all() else [])
                apart = iter(self.encode(texts.filter(pa.array(odd)).to_pylist()))
                return [next(apart if o else rest) for o in odd.tolist()]
        self.words.turn()
        self.bare.turn()
        # A word begins at a space or at a line end that no space or line end stands beside, a text's first one at its start.
        units = np.frombuffer(held, "u1")
        blank = (units == 32) | (units == 10)
        lines = np.flatnonzero(units == 10)
        beside = blank[lines - 1] | blank[np.minimum(lines + 1, len(units) - 1)] & (lines + 1 < len(units))
        blank[lines[beside]] = False
        marks = np.flatnonzero(blank)
        starts = starts - starts[0]
        at = np.searchsorted(marks, starts) + np.arange(len(starts))
        cuts = np.empty(len(marks) + len(starts), dtype="<i8")
        inner = np.ones(len(cuts), dtype=bool)
        inner[at] = False
        cuts[at], cuts[inner] = starts, marks
        flat = pa.LargeStringArray.from_buffers(len(cuts) - 1, pa.py_buffer(cuts), pa.py_buffer(held))
        coded = flat.dictionary_encode()
        # Place of each word's ids; first words, which have no space before them, have places of their own.
        places = coded.indices.to_numpy().astype("i8")
        places[at[:-1]] = len(coded.dictionary) + np.arange(len(texts))
        found = pa.concat_arrays([self._distinct(coded.dictionary), self._bare(flat.take(pa.array(at[:-1])))])
        ids = found.take(pa.array(places))
        ends, data = _buffers(ids)
        ends, data = ends[at].tolist(), memoryview(data)
        out = [bytes(data[b:e]) for b, e in zip(ends[:-1], ends[1:], strict=True)]
        if ids.null_count:  # words that can't be encoded on their own
            lost = np.logical_or.reduceat(ids.is_null().to_numpy(zero_copy_only=False), at[:-1])
            for i in np.flatnonzero(lost).tolist():
                out[i] = self._safely(texts[i].as_py())
        return out

    def _bare(self, strings: pa.LargeStringArray) -> pa.LargeBinaryArray:
        """Ids of strings without a space before them."""
        keys = _strings(strings)
        self._encode_into(self.bare, {s for s in keys if s}, "")
        known = self.bare.young
        return pa.array([known[s] if s else b"" for s in keys], pa.large_binary())

    def _distinct(self, words: pa.LargeStringArray) -> pa.LargeBinaryArray:
        """Ids of distinct words that begin with a space or a line end, null for those that can't be encoded on their own.

        A word is cut into that, a stem and the ASCII marks after it; where the stem isn't of letters alone, the word
        stays whole. First words of texts, which begin otherwise, get none.
        """
        n, (starts, data) = len(words), _buffers(words)
        opens, first = (pc.starts_with(words, s).to_numpy(zero_copy_only=False) for s in ("\n", " "))
        begun = opens | first
        cuts = np.empty(3 * n + 1, dtype="<i8")
        cuts[::3] = starts
        cuts[1::3] = starts[:-1] + begun
        cuts[2::3] = np.maximum(cuts[1::3], starts[:-1] + pc.binary_length(pc.ascii_rtrim(words, string.punctuation)).to_numpy())
        coded = pa.LargeStringArray.from_buffers(3 * n, pa.py_buffer(cuts), data).dictionary_encode()
        _, stems, marks = coded.indices.to_numpy().reshape(n, 3).T
        parts = coded.dictionary.to_numpy(zero_copy_only=False)
        letters = np.fromiter(map(str.isalpha, parts), bool, len(parts))[stems]
        cut, whole = letters & begun, ~letters & begun
        used = np.zeros((2, len(parts)), dtype=bool)
        used[0, stems[letters & first]] = used[1, stems[letters & opens]] = used[1, marks[cut]] = True
        keys = parts[used[0]].tolist()
        n_stems = len(keys)
        keys += [w[1:] if w[0] == " " else "\0" + w for w in _strings(words.filter(pa.array(whole)))]
        known = self.words.young
        ids = list(map(known.get, keys))
        holes = [k for k, i in enumerate(ids) if i is None]
        lacking = {keys[k] for k in holes}
        lacking.discard("")
        if lacking:
            self._learn(lacking)
            for k in holes:
                ids[k] = known.get(keys[k])
        bare = self._bare(pa.array([*parts[used[1]].tolist(), "\n", ""], pa.large_string()))
        pool = pa.concat_arrays([pa.array(ids, pa.large_binary()), bare])
        # Places in the pool: stems, whole words, what stands without a space, the line end, nothing.
        line, nothing = len(pool) - 2, len(pool) - 1
        spaced, later = np.cumsum(used[0]) - 1, len(keys) + np.cumsum(used[1]) - 1
        before, middle, after = np.full((3, n), nothing)
        before[letters & opens] = line
        middle[cut] = np.where(opens, later[stems], spaced[stems])[cut]
        middle[whole] = np.arange(n_stems, len(keys))
        after[cut] = later[marks[cut]]
        return pc.binary_join_element_wise(*(pool.take(pa.array(p)) for p in (before, middle, after)), pa.scalar(b"", pa.large_binary()))

    def _safely(self, text: str) -> bytes:
        """Ids of a text, cut at safe spaces only."""
        first, *rest = _SAFE.split(text)
        strings = list({" " + w for w in rest} | {first})
        own = dict(zip(strings, self.encode_many(strings, ""), strict=True))
        return b"".join([own[first], *(own[" " + w] for w in rest)])


def _buffers(column: pa.LargeStringArray | pa.LargeBinaryArray) -> tuple[np.ndarray, pa.Buffer]:
    """Where the values of a column begin and end, and their bytes."""
    _, ends, data = column.buffers()
    return np.frombuffer(ends, "<i8", len(column) + 1, 8 * column.offset), data or pa.py_buffer(b"")


def _strings(column: pa.Array) -> list[str]:
    """The strings of a column without nulls."""
    return column.to_numpy(zero_copy_only=False).tolist()


def byte_letters() -> str:
    """The letters that byte-level vocabularies write bytes as, but for the line end: printable ones are their own, the others follow 255 in turn."""
    own = {10, *range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in own or b == 10]
    return "".join(chr(b) if b in own else chr(256 + others.index(b)) for b in range(256))


def library_encoder(name: str, spaced: bool) -> WordEncoder:
    """A WordEncoder on the tokenizers library with add_special_tokens=False, all else as the library has it.

    A word of plain letters is one match of the pattern, so the library's model gets it in the byte letters, many words
    in one string; all other strings pass the library's own normalising and splitting.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import public_tokenizers
    from tokenizers import Tokenizer, pre_tokenizers

    tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
    added = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
    letters, plain, model = byte_letters(), _PLAIN.fullmatch, tokenizer.model
    by_spaces = Tokenizer(model)
    by_spaces.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
    # A word begins with the space's token (byte-level) or ends with an end-of-word token.
    marks = np.zeros(tokenizer.get_vocab_size(), dtype=bool)
    for token, i in tokenizer.get_vocab().items():
        marks[i] = token.startswith(letters[32]) if spaced else token.endswith("</w>")
    # Byte-level words may stand in one string of the model if none of its tokens reaches over a space there.
    unsplit = Tokenizer(model)
    over = [t for t in tokenizer.get_vocab() if letters[32] in t[1:]]
    mergeable = spaced and not model.ignore_merges and model.dropout is None

    def in_runs(words: list[str]) -> Iterable[bytes]:
        """Ids of words in byte letters; a run's ids are cut between its words."""
        runs = [words[at : at + RUN] for at in range(0, len(words), RUN)]
        together = "".join(words) if mergeable else ""
        by, between = (unsplit, "") if mergeable and not any(t in together for t in over) else (by_spaces, " ")
        encoded = (e for at in range(0, len(runs), RUNS) for e in by.encode_batch_fast([between.join(r) for r in runs[at : at + RUNS]], add_special_tokens=False))
        for run, e in zip(runs, encoded, strict=True):
            ids = np.frombuffer(array("I", e.ids), "<u4")
            cuts = np.flatnonzero(marks[ids])
            begins, ends = (cuts, np.append(cuts[1:], len(ids))) if spaced else (np.append(0, cuts[:-1] + 1), cuts + 1)
            if len(cuts) != len(run) or begins[0] != 0 or ends[-1] != len(ids):
                yield from (array("I", [t.id for t in model.tokenize(w)]).tobytes() for w in run)
                continue
            data = ids.tobytes()
            yield from [data[b:e] for b, e in zip((begins * 4).tolist(), (ends * 4).tolist(), strict=True)]

    def many(strings: list[str], lead: str) -> list[bytes]:
        out: list[bytes | None] = [None] * len(strings)
        direct = [k for k, s in enumerate(strings) if s.isalpha()]
        words = strings if len(direct) == len(strings) else [strings[k] for k in direct]
        if direct and not plain("\n".join(words)):
            direct = [k for k in direct if plain(strings[k])]
            words = [strings[k] for k in direct]
        if direct:
            lines = lead + ("\n" + lead).join(words)
            lines = codecs.charmap_decode((lines if spaced else lines.lower()).encode(), "strict", letters)[0].split("\n")
            # Words without a space before them have no mark in a byte-level vocabulary.
            ids = in_runs(lines) if lead or not spaced else (array("I", [t.id for t in model.tokenize(w)]).tobytes() for w in lines)
            if len(direct) == len(strings):
                return list(ids)
            for k, i in zip(direct, ids, strict=True):
                out[k] = i
        rest = [k for k, ids in enumerate(out) if ids is None]
        for at in range(0, len(rest), 4096):
            part = rest[at : at + 4096]
            for k, e in zip(part, tokenizer.encode_batch_fast([lead + strings[k] for k in part], add_special_tokens=False), strict=True):
                out[k] = array("I", e.ids).tobytes()
        return out

    return WordEncoder(many, spaced, whole=added)


_ENCODER: dict[str, WordEncoder] = {}


def worker_encoder(name: str, make: Callable[[], WordEncoder]) -> WordEncoder:
    """The encoder of a Python worker, whose memo outlives a task; another one's is dropped first, so a worker holds one."""
    if name not in _ENCODER:
        _ENCODER.clear()
        _ENCODER[name] = make()
    return _ENCODER[name]


def drop_encoder() -> None:
    """Let go of the worker's encoder."""
    _ENCODER.clear()
