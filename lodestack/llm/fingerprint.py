"""Document fingerprints: invertible Bloom lookup tables of paragraph digests.

A text is cut into lines, and lines after sentence marks or, lacking these, after every word whose hash says so, so
that an edit changes only the paragraphs it touches. Equal paragraphs of a text are numbered, which makes them a set.
A table has three rows of cells; a digest goes to one cell of each. Two tables of a size subtract cell by cell;
peeling cells that hold a single digest recovers which paragraphs differ and on which side. If it gets stuck, both
texts are sketched in larger tables and it is tried again.

The likeness of two texts is the share of common paragraphs, 2 * common / (both counts), from the counts and the
number of recovered differences: 1 for equal texts, 0 for texts without a common paragraph. Null counts as the empty
text, whose table is empty; two empty texts have likeness 1. A very long text has as many paragraphs as it needs; its
table stays as small until a comparison asks for more. Rows of equal doc_id, repeated rows too, follow each other by a
hash of the text; an id with very many rows has several ranges. Null ids come last. Other columns of the table,
whatever their names, are not looked at. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestack.llm.common import NULL_ID, KeyRanges, range_count, trimmed

#: Cells of each row of the table that is stored, and how much larger each further try is.
CELLS, GROW = 16, 4
#: Paragraphs have about this many words where there are no marks.
MEAN_WORDS = 8
#: Characters up to which a sentence is one paragraph; longer ones are cut at words.
LONG = 240
_CUT = re.compile(r"[^\n.!?]*[.!?]+\s*|[^\n.!?]+\n?|\n")
_CHECK, _MASK = 0x9E3779B97F4A7C15, (1 << 64) - 1


def paragraphs(text: str) -> list[str]:
    """The pieces of a text, which together are the text."""
    out = []
    for piece in _CUT.findall(text):
        if len(piece) <= LONG:
            out.append(piece)
            continue
        start, words = 0, piece.split(" ")
        at = 0
        for w in words:
            at += len(w) + 1
            if xxhash.xxh32_intdigest(w) % MEAN_WORDS == 0 or at - start >= 2 * LONG:
                out.append(piece[start:at])
                start = at
        if start < len(piece):
            out.append(piece[start:])
    return out


def digests(text: str) -> list[int]:
    """64-bit digests of a text's paragraphs; a repeated paragraph gets one for each time."""
    counts: Counter[str] = Counter()
    out = []
    for p in paragraphs(text):
        n = counts[p]
        counts[p] += 1
        # A seed would not do: short strings with different seeds collide. What has the mark itself gets its number, 0 too.
        out.append(xxhash.xxh3_64_intdigest(f"{n}\0{p}" if n or "\0" in p else p))
    return out


class Sketch:
    """An invertible Bloom lookup table. A cell adds up signs and xors digest and checksum of what it holds.

    The three cells of a digest are parts of it, so the cells of a row are a power of two, 2**20 at most.
    """

    __slots__ = ("cells", "counts", "sums")

    def __init__(self, cells: int, items: list[int] = ()) -> None:
        self.cells = cells
        counts, sums = [0] * (3 * cells), [0] * (3 * cells)
        mask, two = cells - 1, 2 * cells
        for d in items:
            x = d | (d * _CHECK & _MASK) >> 32 << 64
            i, j, k = d & mask, cells + (d >> 20 & mask), two + (d >> 40 & mask)
            counts[i] += 1
            counts[j] += 1
            counts[k] += 1
            sums[i] ^= x
            sums[j] ^= x
            sums[k] ^= x
        self.counts, self.sums = counts, sums

    def minus(self, other: Sketch) -> Sketch:
        out = Sketch.__new__(Sketch)
        out.cells = self.cells
        out.counts = list(map(int.__sub__, self.counts, other.counts))
        out.sums = list(map(int.__xor__, self.sums, other.sums))
        return out

    def peel(self) -> tuple[list[int], list[int]] | None:
        """The digests that only the first and only the second text has, or None if it gets stuck. Empties the table.

        Several digests whose xor passes the checksum by chance look like one; that would go into its cells and out again
        without end. No digest differs twice, so one that comes again ends it.
        """
        sides: tuple[list[int], list[int]] = ([], [])
        met: set[int] = set()
        counts, sums, cells = self.counts, self.sums, self.cells
        mask, two = cells - 1, 2 * cells
        queue = [i for i, c in enumerate(counts) if c == 1 or c == -1]
        while queue:
            at = queue.pop()
            c = counts[at]
            if c != 1 and c != -1:
                continue
            x = sums[at]
            d = x & _MASK
            if x >> 64 != (d * _CHECK & _MASK) >> 32:
                continue
            if d in met:
                return None
            met.add(d)
            sides[c < 0].append(d)
            for i in (d & mask, cells + (d >> 20 & mask), two + (d >> 40 & mask)):
                sums[i] ^= x
                n = counts[i] = counts[i] - c
                if n == 1 or n == -1:
                    queue.append(i)
        return None if any(counts) or any(sums) else sides

    def text(self, n: int) -> str:
        """A fixed-length string: paragraphs, and a digest of nothing but the cells' content, then the cells."""
        body = b"".join(c.to_bytes(4, "little", signed=True) + s.to_bytes(12, "little") for c, s in zip(self.counts, self.sums, strict=True))
        return f"{n:x}:{self.cells:x}:{body.hex()}"


def parse(fingerprint: str) -> tuple[int, Sketch]:
    """Paragraph count and table of a fingerprint."""
    n, cells, body = fingerprint.split(":")
    out, data = Sketch(int(cells, 16)), bytes.fromhex(body)
    for i in range(3 * out.cells):
        out.counts[i] = int.from_bytes(data[16 * i : 16 * i + 4], "little", signed=True)
        out.sums[i] = int.from_bytes(data[16 * i + 4 : 16 * i + 16], "little")
    return int(n, 16), out


class Document:
    """Digests of a text and its tables by size."""

    def __init__(self, text: str) -> None:
        self.items = digests(text)
        self._tables: dict[int, Sketch] = {}

    def table(self, cells: int = CELLS) -> Sketch:
        if cells not in self._tables:
            self._tables[cells] = Sketch(cells, self.items)
        return self._tables[cells]

    def fingerprint(self) -> str:
        return self.table().text(len(self.items))


def difference(a: Document, b: Document) -> tuple[list[int], list[int]]:
    """The paragraph digests that only a and only b has; larger tables until peeling succeeds."""
    cells = CELLS
    while abs(len(a.items) - len(b.items)) > 2 * cells:  # can't be peeled
        cells *= GROW
    while True:
        found = a.table(cells).minus(b.table(cells)).peel()
        if found is not None:
            return found
        cells *= GROW


def likeness(a: Document, b: Document) -> tuple[float, int]:
    """Share of common paragraphs and the number of those that differ."""
    both = len(a.items) + len(b.items)
    if not both:
        return 1.0, 0
    only_a, only_b = difference(a, b)
    differ = len(only_a) + len(only_b)
    return (both - differ) / both, differ


def edited_text(text: str, following: str) -> str:
    """The last third of the code points replaced by the first as many of the next document."""
    third = len(text) // 3
    return text[: len(text) - third] + following[:third]


_OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_differ_edited long, n_differ_next long"


def compare_documents(docs: DataFrame, text: str = "text") -> DataFrame:
    """Every text against its edited text and the next document, by descending doc_id; after the last comes the first.

    One shuffle puts ranges of doc_id in partitions, each sorted; a range also gets the first document of the next
    range, so a task sees each document beside its next one.
    """
    spark = docs.sparkSession
    cut = KeyRanges(docs.select("doc_id"), range_count(docs))
    mine = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(text, F.lit("")).alias("text"))
    # Spark's own hash of the text orders rows of equal ids; only rows that are equal in both are told apart by nothing.
    placed = mine.withColumn("range", cut.column()).withColumn("tie", F.xxhash64("text"))
    order = F.struct(F.coalesce("doc_id", F.lit(NULL_ID)), F.col("tie"))
    # The first document of each range, by descending id: one row a range, without its text.
    heads = {r["range"]: (r["doc_id"], r["tie"]) for r in placed.groupBy("range").agg(F.max(order).alias("o"), F.max_by("doc_id", order).alias("doc_id")).select("range", "doc_id", "o.tie").collect()}
    filled = sorted(heads, reverse=True)
    # A head also goes to the range that comes before it in descending order; the very first to the last range.
    lent = [(*heads[r], r, filled[i - 1]) for i, r in enumerate(filled)]
    loans = F.broadcast(spark.createDataFrame(lent, "head long, head_tie long, own int, to int"))
    same = (F.col("range") == F.col("own")) & F.col("doc_id").eqNullSafe(F.col("head")) & (F.col("tie") == F.col("head_tie"))
    # Of equal rows one is lent.
    first = placed.join(loans, same).groupBy(F.col("to").alias("range")).agg(F.first("doc_id").alias("doc_id"), F.first("text").alias("text"), F.first("tie").alias("tie"))
    both = placed.withColumn("lent", F.lit(False)).unionByName(first.withColumn("lent", F.lit(True)))
    ordered = both.repartitionById(cut.n, "range").sortWithinPartitions(F.desc("range"), "lent", F.desc_nulls_last("doc_id"), F.desc("tie"), "text").select("doc_id", "text", "range", "lent")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in _OUT.split(", ")]
        kinds = [{"long": pa.int64(), "string": pa.string(), "double": pa.float64()}[f.split()[1]] for f in _OUT.split(", ")]
        held: tuple | None = None
        over = None  # a range whose loan has been used
        for batch in batches:
            rows = []
            for doc_id, content, r, is_lent in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if is_lent and over == r:
                    continue
                now = (doc_id, content, r, Document(content))
                if held is not None and held[2] == r:
                    rows.append(compared(held, now))
                held = None if is_lent else now
                over = r if is_lent else None
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    def compared(one: tuple, following: tuple) -> tuple:
        edited = edited_text(one[1], following[1])
        changed = Document(edited)
        near_edited, differ_edited = likeness(one[3], changed)
        near_next, differ_next = likeness(one[3], following[3])
        sha = hashlib.sha256(edited.encode()).hexdigest()
        return one[0], len(one[1]), sha, one[3].fingerprint(), changed.fingerprint(), near_edited, near_next, differ_edited, differ_next

    return ordered.mapInArrow(trimmed(run), _OUT)
