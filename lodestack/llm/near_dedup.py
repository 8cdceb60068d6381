"""Near-duplicate groups by BagMinHash.

A document is the multiset of its five-word shingles (all its words, if fewer). Each shingle runs Poisson processes
over its weight: one for the unit interval and one for each doubling, of a rate equal to the interval's length; a point
above the shingle's count is ignored. The points of all shingles race for the signature's places, so that two
documents agree in a place with the probability of their weighted Jaccard similarity, sum of minima over sum of
maxima. Points come in order of time and a process ends once it can't win a place any more.

Bands of the signature propose pairs. Texts with equal words are one node from the start. In each bucket the node that
shares the most buckets with others, as a text does from which others were copied, is the hub and every other node is
compared with it: as many pairs as nodes. Where a bucket still holds several components, its nodes meet in blocks; of
the pairs of different components, each in the first band that both share, an exact prefix filter leaves those that can
be near, which are verified at once, so only links leave the task. Every link is verified on the whole texts'
multisets. Components of the links are the classes: no pairs of a component's members are ever listed.

What the threshold means: a replaced word changes five shingles, so of n words about n / 45 can be replaced, each far
from the others, until the similarity falls below 0.8 (a share of 2.2 %); copies that are edited more are no links by
themselves, but join a class through copies between them. The bands miss a pair at the threshold with a chance of 4e-7.

Results: class_id is the smallest doc_id of the class. Rows with equal words, null and empty texts included (both have
no words), share a class. A null doc_id stays null; a class of such rows alone has a null class_id. Of rows that
share the class's smallest doc_id, each is `kept`. Very long texts are compared whole. Other columns, whatever their
names, are not looked at, and kept by representatives. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestack.llm.common import release, staged, trimmed

WORDS, SIMILARITY = 5, 0.8
#: A pair at the similarity is in no common bucket with a chance of (1 - 0.8**4)**28 = 4e-7.
BANDS, ROWS = 28, 4
PLACES = BANDS * ROWS
#: Nodes of a block, and bytes of their texts, on average.
BLOCK, BLOCK_BYTES = 1000, 4 << 20
#: Documents whose processes run together, and their bytes.
TOGETHER, TOGETHER_BYTES = 250, 2 << 20
_MEMO = 300_000
_U = np.uint64
_STEP, _MASK = 0xC2B2AE3D27D4EB4F, (1 << 64) - 1
_ODD = [_U(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class Shingler:
    """Hashes of a text's shingles, with a bounded memo of words."""

    def __init__(self) -> None:
        self.memo: dict[bytes, int] = {}

    def hashes(self, words: list[bytes]) -> np.ndarray:
        if not words:
            return np.empty(0, dtype="uint64")
        memo = self.memo
        if len(memo) > _MEMO:
            memo.clear()
        for w in set(words):
            if w not in memo:
                memo[w] = xxhash.xxh3_64_intdigest(w)
        h = np.fromiter(map(memo.__getitem__, words), dtype="uint64", count=len(words))
        n = min(WORDS, len(words))
        out = np.full(len(words) - n + 1, n, dtype="uint64")
        for i in range(n):
            out = _mix(out + h[i : len(words) - n + 1 + i] * _ODD[i])
        return out

    def bag(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Distinct shingles in order and their counts."""
        return np.unique(self.hashes(words), return_counts=True)


def bag_minhash(bags: list[tuple[np.ndarray, np.ndarray]], places: int = PLACES) -> np.ndarray:
    """Signatures (one row a bag) of bags of (shingle, count); an empty bag's places are infinite."""
    n = len(bags)
    doc = np.repeat(np.arange(n), [len(b[0]) for b in bags])
    shingle = np.concatenate([b[0] for b in bags]) if n else np.empty(0, "uint64")
    weight = np.concatenate([b[1] for b in bags]).astype("float64") if n else np.empty(0)
    # Interval 0 is [0, 1), interval k is [2**(k-1), 2**k); a shingle has all that begin below its weight.
    levels = np.where(weight <= 1, 1, np.ceil(np.log2(np.maximum(weight, 1))).astype("int64") + 1)
    at = np.repeat(np.arange(len(doc)), levels)
    level = np.arange(len(at)) - np.repeat(np.cumsum(levels) - levels, levels)
    doc, weight = doc[at], weight[at]
    seed = _mix(shingle[at] + level.astype("uint64") * _ODD[0])
    low = np.where(level == 0, 0.0, 2.0 ** (level - 1))
    size = np.where(level == 0, 1.0, low)
    time, best, slowest = np.zeros(len(at)), np.full(n * places, np.inf), np.full(n, np.inf)
    step = 0
    while len(doc):
        step += 1
        a = _mix(seed + _U(2 * step * _STEP & _MASK))
        b = _mix(seed + _U((2 * step + 1) * _STEP & _MASK))
        time = time - np.log(((a >> _U(11)).astype("float64") + 1) * 2.0**-53) / size
        on = time < slowest[doc]
        place = ((b >> _U(32)) % _U(places)).astype("int64")
        inside = on & (low + size * ((b & _U(0xFFFFFFFF)).astype("float64") * 2.0**-32) < weight)
        np.minimum.at(best, doc[inside] * places + place[inside], time[inside])
        live = np.unique(doc[inside])
        slowest[live] = best.reshape(n, places)[live].max(axis=1)
        on &= time < slowest[doc]
        doc, weight, seed, low, size, time = (x[on] for x in (doc, weight, seed, low, size, time))
    return best.reshape(n, places)


def band_hashes(signatures: np.ndarray) -> np.ndarray:
    """A hash for each band of each signature; the band's number is part of it."""
    bits = signatures.view("uint64").reshape(len(signatures), BANDS, ROWS)
    out = np.tile(np.arange(1, BANDS + 1, dtype="uint64"), (len(signatures), 1))
    for i in range(ROWS):
        out = _mix(out * _ODD[2] + bits[:, :, i])
    return out.view("int64")


def runs_of(sizes: list[int], most: int, most_bytes: int) -> Iterator[tuple[int, int]]:
    """Places [start, end) of runs of at most so many items and bytes, or of one item."""
    start = total = 0
    for i, size in enumerate(sizes):
        if i > start and (i - start >= most or total + size > most_bytes):
            yield start, i
            start, total = i, 0
        total += size
    if sizes:
        yield start, len(sizes)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().split()


def key_of(words: list[bytes]) -> bytes:
    """What equal word sequences share: 128 bits."""
    return xxhash.xxh3_128_digest(b" ".join(words))


def sketch_documents(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, key and bands of every whole text; a text without words has no bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            sizes = [len(t) if t else 0 for t in texts.to_pylist()]
            for start, end in runs_of(sizes, TOGETHER, TOGETHER_BYTES):
                words = [words_of(t) for t in texts.slice(start, end - start).to_pylist()]
                bands = band_hashes(bag_minhash([shingler.bag(w) for w in words]))
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(start, end - start),
                        pa.array([key_of(w) for w in words], pa.binary()),
                        pa.array([b if w else [] for b, w in zip(bands, words, strict=True)], pa.list_(pa.int64())),
                    ],
                    ["doc_id", "key", "bands"],
                )

    return docs.selectExpr("cast(doc_id as bigint) doc_id", text).mapInArrow(trimmed(run), "doc_id long, key binary, bands array<long>")


def similarity_of(one: tuple[np.ndarray, np.ndarray], two: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two bags; 1 if both are empty."""
    _, i, j = np.intersect1d(one[0], two[0], assume_unique=True, return_indices=True)
    common = int(np.minimum(one[1][i], two[1][j]).sum())
    both = int(one[1].sum() + two[1].sum()) - common
    return common / both if both else 1.0


def prefix_pairs(bags: list[tuple[np.ndarray, np.ndarray]], left: int, similarity: float) -> Iterator[tuple[int, np.ndarray]]:
    """(x, ys) such that every pair of bags with at least the similarity is among them, once: x among the first `left`, ys after x and, if `left` isn't all, not among these.

    Prefix filtering, which loses no pair: the elements of all bags (a shingle's copies are elements of their own) are
    ordered from the rarest. Two bags of the similarity have so many elements in common that one is among the rarest
    of both: of n elements, the first n - ceil(similarity * n) + 1.
    """
    sizes = np.array([b[1].sum() for b in bags], dtype="int64")
    counts = np.concatenate([b[1] for b in bags])
    shingle = np.unique(np.concatenate([b[0] for b in bags]), return_inverse=True)[1]
    doc = np.repeat(np.arange(len(bags)), [len(b[0]) for b in bags])
    at = np.repeat(np.arange(len(counts)), counts)
    copy = np.arange(len(at)) - np.repeat(np.cumsum(counts) - counts, counts)
    element = np.unique(shingle[at] * (int(counts.max()) + 1) + copy, return_inverse=True)[1]
    doc = doc[at]
    often = np.bincount(element)
    order = np.lexsort((element, often[element], doc))
    doc, element = doc[order], element[order]
    ends = np.cumsum(sizes)
    begins = ends - sizes
    length = sizes - np.ceil(similarity * sizes - 1e-9).astype("int64") + 1
    kept = (np.arange(len(doc)) - begins[doc] < length[doc]) & (often[element] > 1)
    doc, element = doc[kept], element[kept]
    # By element, the documents that have it in their prefix, ascending.
    by_element = np.lexsort((doc, element))
    holders, firsts = doc[by_element], np.searchsorted(element[by_element], np.arange(len(often) + 1))
    mine = np.searchsorted(doc, np.arange(len(bags) + 1))
    for x in range(left):
        parts = [holders[firsts[e] : firsts[e + 1]] for e in element[mine[x] : mine[x + 1]].tolist()]
        if not parts:
            continue
        ys = np.unique(np.concatenate(parts))
        ys = ys[ys > x] if left == len(bags) else ys[ys >= left]
        ys = ys[np.minimum(sizes[ys], sizes[x]) >= similarity * np.maximum(sizes[ys], sizes[x]) - 1e-9]
        if len(ys):
            yield x, ys


def node_texts(docs: DataFrame, nodes: DataFrame, keys: DataFrame, text: str = "text") -> DataFrame:
    """key and text of the nodes asked for: that of each one's first document. One shuffle of the texts, kept in the shared folder."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([key_of(words_of(t)) for t in batch.column(1).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), found, batch.column(1)], ["doc_id", "key", "text"])

    firsts = nodes.join(keys, "key", "left_semi").select(F.col("key").alias("k"), F.col("first_doc").alias("f"))
    own = docs.selectExpr("cast(doc_id as bigint) doc_id", f"{text} text").mapInArrow(trimmed(keyed), "doc_id long, key binary, text string")
    found = own.join(firsts, (F.col("key") == F.col("k")) & F.col("doc_id").eqNullSafe(F.col("f")), "left_semi").select("key", "text")
    # The first document's row may be there more than once; rows of a key lie together after the join.
    return staged(found.dropDuplicates(["key"]), "texts")


def verify(pairs: DataFrame, texts: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The pairs (a, b) of keys whose texts' weighted Jaccard similarity is at least `similarity`, with it.

    Pairs are brought to the text of b, then to that of a, in whose order they are compared, so a hub's shingles are
    counted once.
    """

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, last, bag = Shingler(), None, None
        for batch in batches:
            rows = []
            for a, b, text_a, text_b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if a != last:
                    last, bag = a, shingler.bag(words_of(text_a))
                other = shingler.bag(words_of(text_b))
                if (near := similarity_of(bag, other)) >= similarity:
                    rows.append((a, b, near))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.binary(), pa.binary(), pa.float64()), strict=True)], ["a", "b", "similarity"])

    with_b = pairs.join(texts.select(F.col("key").alias("b"), F.col("text").alias("text_b")), "b")
    both = with_b.join(texts.select(F.col("key").alias("a"), F.col("text").alias("text_a")), "a")
    return both.select("a", "b", "text_a", "text_b").mapInArrow(trimmed(compare), "a binary, b binary, similarity double")


def components(links: DataFrame) -> DataFrame:
    """key and label (the smallest key of its component) of every node of the links (a, b).

    Alternating large and small stars: each round is a shuffle or two over the links and is written to the shared
    folder; the number of rounds grows with the logarithm of the longest chain.
    """
    edges = staged(links.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).filter("u <> v").distinct(), "edges")
    mark = None
    while True:
        both = edges.union(edges.select(F.col("u").alias("v"), F.col("v").alias("u")))
        lowest = both.groupBy("v").agg(F.least(F.min("u"), F.col("v")).alias("m"))
        large = both.join(lowest, "v").filter("u > v").select(F.col("u").alias("v"), F.col("m").alias("u"))
        large = staged(large.filter("u <> v").distinct(), "edges")
        release(edges)
        lowest = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(lowest, "v").select(F.col("u").alias("v"), F.col("m").alias("u")).union(lowest.select("v", F.col("m").alias("u")))
        edges = staged(small.filter("u <> v").distinct(), "edges")
        release(large)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    return edges.select(F.col("v").alias("key"), F.col("u").alias("label")).union(edges.select(F.col("u").alias("key"), F.col("u").alias("label")).distinct())


def block_links(members: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Links (a, b, similarity) between nodes of a bucket (h, band, key, label, bands, text) with different labels.

    Buckets are cut into blocks of bounded rows and bytes; a task has two blocks at a time. A pair is looked at in the
    first band whose bucket holds both; those that a prefix filter can't rule out are compared by their texts'
    multisets. No pair of the similarity is lost.
    """
    sizes = members.groupBy("h").agg(F.count(F.lit(1)).alias("rows"), F.sum(F.octet_length("text")).alias("bytes"))
    blocks = sizes.select("h", F.greatest(F.ceil(F.col("rows") / BLOCK), F.ceil(F.col("bytes") / BLOCK_BYTES)).cast("int").alias("n"))
    placed = members.join(blocks, "h").withColumn("own", F.pmod(F.xxhash64("key"), F.col("n")).cast("int"))
    spread = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    spread = spread.select("h", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") <= F.col("other")).alias("left"), "band", "key", "label", "bands", "text")
    partitions = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = spread.repartition(partitions, "h", "i", "j").sortWithinPartitions("h", "i", "j", F.desc("left"))

    def compared(same_block: bool, band: int, rows: list[tuple], shingler: Shingler) -> list[tuple[bytes, bytes, float]]:
        left = len(rows) if same_block else sum(r[0] for r in rows)
        names = {label: i for i, label in enumerate({r[2] for r in rows})}
        if len(names) < 2 or not left or left == len(rows) and not same_block:
            return []
        labels = np.array([names[r[2]] for r in rows])
        bands = np.array([r[3][:band] for r in rows], dtype="int64").reshape(len(rows), band)
        bags = [shingler.bag(words_of(r[4])) for r in rows]
        out = []
        for x, ys in prefix_pairs(bags, left, similarity):
            ys = ys[labels[ys] != labels[x]]
            if band and len(ys):  # pairs that lie in an earlier band's bucket are compared there
                ys = ys[~(bands[ys] == bands[x]).any(axis=1)]
            for y in ys.tolist():
                if (near := similarity_of(bags[x], bags[y])) >= similarity:
                    out.append((rows[x][1], rows[y][1], near))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, rows, out, of_band = None, [], [], 0
        shingler = Shingler()
        for batch in batches:
            for h, i, j, left, band, key, label, bands, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (h, i, j) != at:
                    if at is not None:
                        out += compared(at[1] == at[2], of_band, rows, shingler)
                    at, rows, of_band = (h, i, j), [], band
                rows.append((left, key, label, bands, content))
                if len(out) >= 10_000:
                    yield batch_of(out)
                    out = []
        if at is not None:
            out += compared(at[1] == at[2], of_band, rows, shingler)
        if out:
            yield batch_of(out)

    def batch_of(out: list[tuple[bytes, bytes, float]]) -> pa.RecordBatch:
        kinds = pa.binary(), pa.binary(), pa.float64()
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["a", "b", "similarity"])

    return ordered.mapInArrow(trimmed(run), "a binary, b binary, similarity double")


def label_nodes(docs: DataFrame, similarity: float = SIMILARITY, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """The documents' keys (doc_id, key, ...), and key, first_doc, copies and label of every node; equal labels are a class."""
    sketches = staged(sketch_documents(docs, text), "sketches")
    # One node for each word sequence; copies are gathered before they move.
    nodes = staged(sketches.groupBy("key").agg(F.min("doc_id").alias("first_doc"), F.count(F.lit(1)).alias("copies"), F.first("bands").alias("bands")), "nodes")
    banded = nodes.select("key", F.posexplode("bands").alias("band", "h"))
    shared = banded.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    buckets = staged(banded.join(shared, "h"), "buckets")
    mates = buckets.groupBy("key").agg(F.sum("n").alias("mates"))
    hubs = buckets.join(mates, "key").groupBy("h").agg(F.max_by("key", F.struct("mates", "key")).alias("hub"))
    plain, buckets = buckets, staged(buckets.join(hubs, "h").select("h", "band", "key", "hub"), "buckets")
    release(plain)
    pairs = staged(buckets.filter("key <> hub").select(F.col("hub").alias("a"), F.col("key").alias("b")).distinct(), "pairs")
    texts = node_texts(docs, nodes, buckets.select("key").distinct(), text)
    links = staged(verify(pairs, texts, similarity), "links")
    labels = staged(components(links), "labels")

    # Buckets that still hold more than one component.
    labelled = buckets.select("h", "band", "key").join(labels, "key", "left").withColumn("label", F.coalesce("label", "key"))
    mixed = labelled.groupBy("h").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi").select("h")
    rest = labelled.join(mixed, "h", "left_semi").join(nodes.select("key", "bands"), "key").join(texts, "key").select("h", "band", "key", "label", "bands", "text")
    more = staged(block_links(rest, similarity), "links")
    if not more.isEmpty():
        fewer, links = (links, labels), staged(links.unionByName(more), "links")
        labels = staged(components(links), "labels")
        release(*fewer)
    release(buckets, pairs, texts, more, links)
    return sketches, nodes.select("key", "first_doc", "copies").join(labels, "key", "left").withColumn("label", F.coalesce("label", "key"))


def classes(docs: DataFrame, similarity: float = SIMILARITY, text: str = "text") -> DataFrame:
    """doc_id, class_id, class_size and kept of every document."""
    sketches, nodes = label_nodes(docs, similarity, text)
    of_class = nodes.groupBy("label").agg(F.min("first_doc").alias("class_id"), F.sum("copies").alias("class_size"))
    known = nodes.join(of_class, "label").select("key", "class_id", "class_size")
    out = sketches.select("doc_id", "key").join(known, "key")
    return out.select("doc_id", "class_id", "class_size", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("kept"))


def representatives(docs: DataFrame, similarity: float = SIMILARITY, text: str = "text") -> DataFrame:
    """The documents, with all their columns, but one row of each class only: that of the smallest doc_id, then key."""

    @F.pandas_udf("binary")
    def text_key(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: key_of(words_of(t)))

    _, nodes = label_nodes(docs, similarity, text)
    rank = F.struct(F.coalesce("first_doc", F.lit((1 << 63) - 1)), F.col("key"))
    chosen = nodes.groupBy("label").agg(F.min_by(F.struct("key", "first_doc"), rank).alias("c")).select(F.col("c.key").alias("k"), F.col("c.first_doc").alias("d"))
    mine = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"), text_key(text).alias("key"))
    # Null-safe, though no key is null: else a filter on non-null keys makes each of them twice, by a second Python worker.
    # Equal rows of the chosen document lie in one partition after the join.
    kept = mine.join(chosen, F.col("key").eqNullSafe(F.col("k")) & F.col("id").eqNullSafe(F.col("d")), "left_semi").dropDuplicates(["key"])
    return kept.select("row.*")


def oracle_sql(similarity: float = SIMILARITY) -> str:
    """classes() in DuckDB SQL: all pairs that share a shingle, exactly, and their components. For small tables."""
    return rf"""
WITH RECURSIVE w AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT r, array_to_string(ws[i:i + {WORDS - 1}], ' ') AS s FROM (SELECT r, ws, unnest(range(1, greatest(len(ws) - {WORDS - 1}, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
c AS (SELECT r, s, count(*) AS n FROM s GROUP BY r, s), t AS (SELECT r, sum(n) AS t FROM c GROUP BY r),
p AS (SELECT a.r AS x, b.r AS y, sum(least(a.n, b.n)) AS m FROM c a JOIN c b ON a.s = b.s AND a.r < b.r GROUP BY a.r, b.r),
e AS (SELECT x, y FROM p JOIN t tx ON tx.r = x JOIN t ty ON ty.r = y WHERE m::DOUBLE / (tx.t + ty.t - m) >= {similarity}
      UNION ALL SELECT (SELECT min(r) FROM w WHERE len(ws) = 0), r FROM w WHERE len(ws) = 0),
b AS (SELECT x, y FROM e UNION SELECT y, x FROM e),
reach(r, l) AS (SELECT r, r FROM w UNION SELECT b.y, reach.l FROM reach JOIN b ON b.x = reach.r),
k AS (SELECT r, min(l) AS l FROM reach GROUP BY r),
g AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY l) AS class_id, count(*) OVER (PARTITION BY l) AS class_size FROM k JOIN w USING (r))
SELECT doc_id, class_id, class_size, doc_id IS NOT DISTINCT FROM class_id AS kept FROM g"""
