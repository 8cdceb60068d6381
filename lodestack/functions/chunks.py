"""Chunks, code fences, headings, breadcrumbs, front matter: what needs a scan of the text in order; and snippets.

Each but the snippet (a column) is a plain function on a string; the table-valued ones run in mapInArrow, a batch of
documents at a time.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestack.sources.shared import short_batches

# Break points by kind, and their scores.
BREAKS = {
    r"\n#(?!#)": 100, r"\n##(?!#)": 90, r"\n###(?!#)": 80, r"\n####(?!#)": 70, r"\n#####(?!#)": 60, r"\n######(?!#)": 50,
    r"\n```": 80, r"\n(?:---|\*\*\*|___)\s*\n": 60, r"\n\n+": 20, r"\n[-*]\s": 5, r"\n\d+\.\s": 5, r"\n": 1,
}
#: Chunk size, overlap and window in characters: at query time and for embedding.
QUERY_SIZES, EMBED_SIZES = (3600, 540, 800), (2700, 405, 600)
#: Characters of chunks that leave a worker together, about.
TOGETHER = 1 << 20
#: Definitions in source files by extension, for chunks that follow the code.
CODE = {
    "py": r"\n(?=(?:async )?def |class |@\w)", "js": r"\n(?=(?:export )?(?:async )?(?:function|class|const) )", "ts": r"\n(?=(?:export )?(?:async )?(?:function|class|const|interface|type|enum) )",
    "tsx": r"\n(?=(?:export )?(?:async )?(?:function|class|const|interface|type|enum) )", "go": r"\n(?=func |type )", "rs": r"\n(?=(?:pub )?(?:fn|struct|enum|impl|trait|mod) )",
}
CODE_SCORE = 95
_COMPILED = [(re.compile(p), s) for p, s in BREAKS.items()]
META_LIMITS = {"bytes": 65536, "keys": 64, "key_bytes": 128, "chars": 1024, "items": 128}


def break_points(text: str, extension: str = "") -> dict[int, int]:
    """Position -> best score."""
    out: dict[int, int] = {}
    found = [*_COMPILED, *([(re.compile(CODE[extension]), CODE_SCORE)] if extension in CODE else [])]
    for pattern, score in found:
        for m in pattern.finditer(text):
            out[m.start()] = max(out.get(m.start(), 0), score)
    return out


class Cuts:
    """Where a text may be cut: its break points outside code fences, sorted, with their scores, and the fences.

    A fence runs from one line of ``` to the next; a last one alone is none. Everything is sorted once, so a cut looks
    at the break points of its own window only.
    """

    def __init__(self, text: str, extension: str = ""):
        marks = [m.start() for m in re.finditer(r"\n```", text)]
        before_all = [-(1 << 60)]
        self.opens = np.array(before_all + marks[: len(marks) // 2 * 2 : 2], "int64")
        self.closes = np.array(before_all + marks[1::2], "int64") + 4
        found = break_points(text, extension)
        at = np.sort(np.fromiter(found, "int64", len(found)))
        self.at = at[self.leave(at) == at]
        self.score = np.array([found[p] for p in self.at.tolist()], "float64")

    def leave(self, place):
        """The places, or the end of the fence that a place lies in."""
        return np.maximum(place, self.closes[np.searchsorted(self.opens, place) - 1])

    def near(self, target: int, window: int) -> int:
        """The break point up to `window` before the target with the best score, less the further off, the first of equals; else the target."""
        lo, hi = np.searchsorted(self.at, (target - window, target + 1))
        here = self.at[lo:hi]
        worth = self.score[lo:hi] * (1 - 0.7 * ((target - here) / window) ** 2)
        return int(here[worth.argmax()]) if len(here) else target


def spans(text: str, sizes: tuple[int, int, int] = EMBED_SIZES, extension: str = "") -> Iterator[tuple[int, int]]:
    """(start, end) of overlapping chunks that cover the text. A fence is never cut, whatever its size."""
    (most, overlap, window), length, start = sizes, len(text), 0
    cuts = Cuts(text, extension) if length > most else None
    while length - start > most:
        cut = cuts.near(start + most, window)
        end = int(cuts.leave(cut if cut > start else start + most))
        yield start, end
        if end >= length:
            return
        again = int(cuts.leave(end - overlap))
        start = again if again > start else max(start + 1, (start + end) // 2)
    yield start, length


def chunks(text: str, sizes: tuple[int, int, int] = EMBED_SIZES, extension: str = "") -> list[tuple[int, str]]:
    """(position, text) of the chunks."""
    return [(a, text[a:b]) for a, b in spans(text, sizes, extension)]


def chunk_table(docs: DataFrame, sizes: tuple[int, int, int] = EMBED_SIZES, empty: bool = False) -> DataFrame:
    """id, seq, pos, text of the chunks of docs (id, body). Null texts have none, empty texts one if `empty` says so. A worker holds a short batch and the chunks of about TOGETHER characters."""

    kind = "string" if dict(docs.dtypes)["id"] == "string" else "bigint"
    short_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.string() if kind == "string" else pa.int64(), pa.int32(), pa.int32(), pa.string())
        made = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["id", "seq", "pos", "text"])
        for batch in batches:
            rows, held = [], 0
            for i, t in zip(batch.column(0), batch.column(1), strict=True):
                t = t.as_py()
                if not (t or (empty and t is not None)):
                    continue
                i = i.as_py()
                for n, (a, b) in enumerate(spans(t, sizes)):
                    rows.append((i, n, a, t[a:b]))
                    held += b - a
                    if held >= TOGETHER:
                        yield made(rows)
                        rows, held = [], 0
            if rows:
                yield made(rows)

    return docs.selectExpr(f"cast(id as {kind}) id", "body").mapInArrow(run, f"id {kind}, seq int, pos int, text string")


def headings(text: str) -> list[tuple[int, int, str]]:
    """(position, level, title) of markdown headings outside fenced code; a fence left open runs to the end."""
    out, fence, at = [], None, 0
    for line in text.split("\n"):
        m = re.match(r" {0,3}(`{3,}|~{3,})(.*)$", line)
        if m and fence is None:
            fence = m[1]
        elif m and m[1][0] == fence[0] and len(m[1]) >= len(fence) and not m[2].strip():
            fence = None
        elif fence is None and (h := re.match(r"(#{1,6})[ \t]+(.*?)[ \t]*#*$", line)):
            out.append((at, len(h[1]), h[2]))
        at += len(line) + 1
    return out


def breadcrumb(title: str, found: list[tuple[int, int, str]], start: int, end: int, most: int = 256) -> str:
    """`title > h2 > h3` of the section that overlaps [start, end) longest, the earlier one on ties."""
    bounds = [(0, -1), *((p, i) for i, (p, _, _) in enumerate(found))]
    best, section = 0, -1
    for k, (p, i) in enumerate(bounds):
        stop = bounds[k + 1][0] if k + 1 < len(bounds) else end
        share = min(end, max(stop, p)) - max(start, p)
        if share > best:
            best, section = share, i
    path: list[tuple[int, str]] = []
    for _, level, name in found[: section + 1]:
        path = [x for x in path if x[0] < level] + [(level, name)]
    names = [n for level, n in path if level > 1]
    if names and names[0] == title:
        names = names[1:]
    parts = [title, *names]
    while len(parts) > 1 and len(" > ".join(parts)) > most:
        parts.pop(0)
    crumb = " > ".join(parts)
    return crumb if len(crumb) <= most else crumb[: most - 1] + "…"


def front_matter(content: str, path: str, namespace: str = "search") -> tuple[dict, str | None]:
    """Typed metadata from a markdown file's leading YAML block, under `namespace: metadata:`, and an error. Never raises.

    Values are strings, numbers, booleans or flat arrays of one of these, without repeats.
    """
    if not re.search(r"\.(md|markdown|mdx)$", path, re.I):
        return {}, None
    m = re.match(r"﻿?---[ \t]*\r?\n(.*?)(?:\r?\n)(?:---|\.\.\.)[ \t]*(?:\r?\n|$)", content, re.S)
    if not m:
        return {}, None
    try:
        import yaml

        if len(m[1].encode()) > META_LIMITS["bytes"]:
            raise ValueError("the block is too long")
        if len(re.findall(r"(?:^|[\s\[,:])\*\w", m[1])) > 100:
            raise ValueError("too many aliases")
        top = yaml.safe_load(m[1])
        found = ((top or {}).get(namespace) or {}).get("metadata") if isinstance(top, dict) else None
        if found is None:
            return {}, None
        if not isinstance(found, dict) or len(found) > META_LIMITS["keys"]:
            raise ValueError("metadata isn't a mapping of at most 64 keys")
        return {_key(k): _value(k, v) for k, v in found.items()}, None
    except Exception as e:  # noqa: BLE001
        return {}, f"{type(e).__name__}: {e}"[:200]


def _key(k: object) -> str:
    if not isinstance(k, str) or not k or len(k.encode()) > META_LIMITS["key_bytes"]:
        raise ValueError(f"bad key {k!r}")
    return k


def _kind(v: object) -> str:
    if isinstance(v, bool):
        return "boolean"
    if isinstance(v, (int, float)):
        return "number"
    if isinstance(v, str) and len(v) <= META_LIMITS["chars"]:
        return "string"
    raise ValueError(f"unsupported value {str(v)[:50]!r}")


def _value(k: str, v: object) -> object:
    if not isinstance(v, list):
        _kind(v)
        return v
    if len(v) > META_LIMITS["items"] or len({_kind(x) for x in v}) > 1:
        raise ValueError(f"{k}: not a short array of one type")
    return list(dict.fromkeys(v))


def metadata_values(found: dict) -> list[tuple[str, int, str, str | None, float | None, bool | None]]:
    """(key, ordinal, value_type, text, number, boolean) of metadata."""
    out = []
    for k, v in found.items():
        for n, x in enumerate(v if isinstance(v, list) else [v]):
            kind = _kind(x)
            out.append((k, n, kind, x if kind == "string" else None, float(x) if kind == "number" else None, x if kind == "boolean" else None))
    return out


STOP = frozenset(
    # Words of an intent that are not looked for.
    (
        "am an as at be by do he if in is it me my no of on or so to up us we "
        "all and any are but can did for get has her him his how its let may not our out the too was who why you "
        "also does find from have into more need show some tell that them this want what when will with your "
        "about looking notes search where which"
    ).split()
)


def intent_terms(intent: str | None) -> list[str]:
    """Lower-case words of an intent, without outer punctuation, short words and stop words; repeats stay."""
    words = [re.sub(r"^\W+|\W+$", "", w) for w in (intent or "").lower().split()]
    return [w for w in words if len(w) > 1 and w not in STOP]


def query_terms(query: str) -> list[str]:
    return [w for w in query.lower().split() if len(w) > 2]


def _let(value: Column, then) -> Column:
    """then(value), with the value worked out once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _view(text: Column, terms: Column, wanted: Column) -> Column:
    """A text's lines, the highest weight of one, and the place (from 1) of the first with it: terms count 1, intent terms 0.3."""
    count = lambda words, line: F.size(F.filter(words, lambda w: F.contains(line, w)))
    weights = lambda lines: F.transform(lines, lambda x: _let(F.lower(x), lambda low: count(terms, low) + 0.3 * count(wanted, low)))
    best = lambda lines, w: F.struct(lines.alias("lines"), F.array_max(w).alias("weight"), F.array_position(w, F.array_max(w)).cast("int").alias("at"))
    return _let(_lines(text), lambda lines: _let(weights(lines), lambda w: best(lines, w)))


def _excerpt(lines: Column, at: Column, above: Column, total: Column, most: int) -> Column:
    """line, text and visible of the lines around one, one before and two after, under a header that says where they stand."""
    first = F.greatest(at - 1, F.lit(1))
    shown = F.slice(lines, first, F.least(F.size(lines), at + 2) - first + 1)

    def row(kept: Column) -> Column:
        text, start = F.array_join(kept, "\n"), above + first
        text = F.when(F.length(text) > most, F.concat(F.left(text, F.lit(most - 3)), F.lit("..."))).otherwise(text)
        head = F.format_string("@@ -%d,%d @@ (%d before, %d after)\n", start, F.size(kept), start - 1, total - start + 1 - F.size(kept))
        return F.struct((above + at).alias("line"), F.concat(head, text).alias("text"), F.exists(kept, lambda x: x.rlike(r"\S")).alias("visible"))

    return _let(shown, row)


def snippet(body: Column, terms: Column, wanted: Column | None = None, pos: Column | None = None, size: int = QUERY_SIZES[0], most: int = 500) -> Column:
    """A struct of line and text: where a document speaks of the query. terms, wanted: lower-case words of query and intent.

    With a chunk's place pos, its neighbourhood is looked at first: the line with most words, or for a chunk after the
    start that has none, its own first line if one can see anything there. Else, and for a pos that is null or negative,
    the best line of the whole text. A null body is as an empty one.
    """
    body = F.coalesce(body, F.lit(""))
    wanted = F.expr("cast(array() as array<string>)") if wanted is None else wanted
    total = F.size(_lines(body))
    whole = _let(_view(body, terms, wanted), lambda v: _excerpt(v["lines"], v["at"], F.lit(0), total, most))
    if pos is not None:
        lo = F.greatest(pos - 100, F.lit(0))
        above, own = F.size(_lines(F.left(body, lo))) - 1, F.size(_lines(F.substring(body, lo + 1, pos - lo)))
        place = lambda v: F.when(v["weight"] > 0, v["at"]).when(pos > 0, own)
        around = lambda v: _let(place(v), lambda at: F.when(at.isNotNull(), _excerpt(v["lines"], at, above, total, most)))
        near = _let(_view(F.substring(body, lo + 1, pos + size + 100 - lo), terms, wanted), around)
        whole = F.when(pos >= 0, _let(near, lambda e: F.when(e["visible"], e).otherwise(whole))).otherwise(whole)
    return _let(whole, lambda e: F.struct(e["line"].alias("line"), e["text"].alias("text")))
