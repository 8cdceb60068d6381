"""Keyword search: a query language, phrases by position, weighted BM25, for many queries in one plan."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestack.functions.stem import stem
from lodestack.functions.text import fold
from lodestack.operators.postings import document_lengths, matching, postings, statistics, stem_terms

K1, B, TITLE, BODY, LEAST_IDF = 1.2, 0.75, 4.0, 1.0, 1e-6
#: Terms that are written out as a predicate.
PUSHED = 500
# Han with extension A and compatibility forms, kana, Hangul syllables and letters.
_CJK = re.compile("([\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\u3040-\u309f\u30a0-\u30ff\uac00-\ud7a3\u1100-\u11ff])")


@dataclass(frozen=True)
class Phrase:
    tokens: tuple[str, ...]
    prefix: bool = False
    negated: bool = False


def parse(query: str, stemmed: bool = False) -> list[Phrase] | None:
    """Phrases of a query; None if nothing positive is asked for.

    A leading - negates; quotes hold a phrase and an unclosed one runs to the end. Any other word ends at white space or
    a quote: one of several parts, or with CJK characters, is a phrase of them, one part is a prefix. An apostrophe or
    underscore doesn't part a word, but the index splits at both: the tokens then are a phrase whose last is a prefix.
    """
    out = []
    for m in re.finditer(r'(-?)(?:"([^"]*)(?:"|$)|([^\s"]+))', query):
        quoted = m[2] is not None
        raw = m[2] if quoted else m[3]
        words = re.findall(r"[^\W_]+", _CJK.sub(r" \1 ", fold(raw)))
        if not words:
            continue
        if stemmed:
            words = [stem(w) for w in words]
        parts = [x for x in re.split(r"[^\w']+", raw) if x]
        prefix = not quoted and len(parts) == 1 and not _CJK.search(raw)
        out.append(Phrase(tuple(words), prefix, bool(m[1])))
    return out if any(not p.negated for p in out) else None


def phrase_rows(queries: dict[str, str], stemmed: bool = False) -> list[tuple]:
    """The rows of phrase_table."""
    rows = []
    for q, text in queries.items():
        for k, p in enumerate(parse(text, stemmed) or []):
            rows += [(q, k, p.negated, p.prefix and i + 1 == len(p.tokens), len(p.tokens), i, t) for i, t in enumerate(p.tokens)]
    return rows


def asked_terms(rows: list[tuple], term: Column | None = None, cut: int = 0) -> Column | None:
    """The terms that phrases ask for, as a predicate that a stored index prunes by; None if there are too many to write out.

    With `cut`, those that begin as they do but for so many letters at the end.
    """
    term = F.col("term") if term is None else term
    exact, prefixes = {r[6] for r in rows if not r[3]}, {r[6] for r in rows if r[3]}
    if len(exact) + len(prefixes) > PUSHED:
        return None
    if cut:
        exact, prefixes = set(), {t[: max(1, len(t) - cut)] for t in exact | prefixes}
    out = term.isin(*sorted(exact)) if exact else F.lit(False)
    for p in sorted(prefixes):
        out = out | term.startswith(p)
    return out


#: Fixed value: letters at a stem's end, at most, that the word doesn't have in their places: an ending gives way to
#: another of which it has all but two letters (biliti: ble), and nothing that follows adds one.
STEM_END = 2


def asked_postings(docs: DataFrame, rows: list[tuple], stemmed: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Postings of the terms that phrases ask for, lengths and statistics of docs (id, title, body); all postings if these terms are too many to write out."""
    if asked_terms(rows) is None:
        post = postings(docs, stemmed)
        return post, (lengths := document_lengths(post)), statistics(docs, lengths)
    post, lengths, stats = matching(docs, lambda term: asked_terms(rows, term, STEM_END if stemmed else 0))
    return stem_terms(post) if stemmed else post, lengths, stats


def phrase_table(spark: SparkSession, queries: dict[str, str], stemmed: bool = False) -> DataFrame:
    """query_id, phrase, negated, prefix (of the last token only), n (tokens), i (token's place), token. As large as the queries' text."""
    rows = phrase_rows(queries, stemmed)
    return spark.createDataFrame(rows, "query_id string, phrase int, negated boolean, prefix boolean, n int, i int, token string")


def phrase_hits(post: DataFrame, phrases: DataFrame) -> DataFrame:
    """query_id, phrase, negated, id, field, hits: how often a phrase's tokens stand side by side in a field.

    The query's tokens are few (they are its text) and broadcast; each posting is looked up by its term, for prefixes by
    its first letter. Both are map-side hash joins; only matches are shuffled.
    """
    exact = post.join(F.broadcast(phrases.filter("not prefix")), F.col("term") == F.col("token"))
    prefix = post.join(F.broadcast(phrases.filter("prefix")), (F.left("term", F.lit(1)) == F.left("token", F.lit(1))) & F.col("term").startswith(F.col("token")))
    found = exact.unionByName(prefix).select("query_id", "phrase", "negated", "n", "id", "field", (F.col("pos") - F.col("i")).alias("start"), "i")
    whole = found.groupBy("query_id", "phrase", "negated", "n", "id", "field", "start").agg(F.count(F.lit(1)).alias("have")).filter("have = n")
    return whole.groupBy("query_id", "phrase", "negated", "id", "field").agg(F.count(F.lit(1)).alias("hits"))


def scores(post: DataFrame | None, docs: DataFrame, queries: dict[str, str], stemmed: bool = False, lengths: DataFrame | None = None, stats: DataFrame | None = None) -> DataFrame:
    """query_id, id, bm25 (negative, lower is better), score in [0, 1) of the documents that match all positive and no negated phrases.

    Without post, what is asked for is found in the texts of docs (id, title, body), which are read once, by this call.
    lengths and stats: those of a stored index; else they are counted from the postings.
    """
    phrases = phrase_table(docs.sparkSession, queries, stemmed)
    rows = phrase_rows(queries, stemmed)
    if post is None:
        post, lengths, stats = asked_postings(docs, rows, stemmed)
    asked_for = asked_terms(rows)
    hits = phrase_hits(post if asked_for is None else post.filter(asked_for), phrases)
    weighted = hits.groupBy("query_id", "phrase", "negated", "id").agg(F.sum(F.col("hits") * F.when(F.col("field") == "title", TITLE).otherwise(BODY)).alias("f"))
    asked = phrases.filter("not negated").groupBy("query_id").agg(F.countDistinct("phrase").alias("need"))
    lengths = document_lengths(post) if lengths is None else lengths
    stats = statistics(docs, lengths) if stats is None else stats
    matches = weighted.groupBy("query_id", "phrase").agg(F.count(F.lit(1)).alias("n_p"))
    idf = F.log((F.col("n_docs") - F.col("n_p") + 0.5) / (F.col("n_p") + 0.5))
    idfs = matches.crossJoin(F.broadcast(stats)).select("query_id", "phrase", "avgdl", F.when(idf <= 0, LEAST_IDF).otherwise(idf).alias("idf"))
    norm = F.col("f") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl"))
    # One row a phrase of a query.
    each = weighted.join(F.broadcast(idfs), ["query_id", "phrase"]).join(lengths, "id")
    summed = each.groupBy("query_id", "id").agg(
        F.sum(F.when(~F.col("negated"), F.col("idf") * F.col("f") * (K1 + 1) / norm)).alias("s"),
        F.sum(F.when(~F.col("negated"), 1).otherwise(0)).alias("have"),
        F.max("negated").alias("barred"),
    )
    kept = summed.join(F.broadcast(asked), "query_id").filter("have = need and not barred")
    return kept.select("query_id", "id", (-F.col("s")).alias("bm25"), (F.col("s") / (1 + F.col("s"))).alias("score"))


def search(post: DataFrame | None, docs: DataFrame, queries: dict[str, str], limit: int = 20, eligible: DataFrame | None = None, overfetch: int | None = None, stemmed: bool = False, lengths: DataFrame | None = None, stats: DataFrame | None = None) -> DataFrame:
    """query_id, rank (from 1), id, bm25, score: the best `limit` documents of each query.

    docs: the indexed documents (id, ...), which make the statistics. eligible: ids that may be returned; they are
    filtered before the limit. With `overfetch`, only the best so many are looked at before that filter, which can
    leave fewer rows. post, lengths, stats: see scores().
    """
    found = scores(post, docs, queries, stemmed, lengths, stats)
    order = Window.partitionBy("query_id").orderBy(F.round("bm25", 9), "id")
    if eligible is not None:
        if overfetch is not None:
            found = found.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= overfetch).drop("r")
        found = found.join(eligible.select("id"), "id", "left_semi")
    # Spark keeps the best `limit` rows of each partition before it moves them.
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit).select("query_id", "rank", "id", "bm25", "score")


def okapi(post: DataFrame | None, docs: DataFrame, queries: dict[str, list[str]], limit: int = 20) -> DataFrame:
    """OR search by Okapi BM25 with idf ln(1 + (N - n + 0.5) / (n + 0.5)); query_id, rank, id, score. post: see scores()."""
    spark = docs.sparkSession
    terms = spark.createDataFrame([(q, t) for q, ts in queries.items() for t in ts], "query_id string, term string")
    if post is None:
        post, lengths, stats = asked_postings(docs, [(q, 0, False, False, 1, 0, t) for q, ts in queries.items() for t in ts])
    else:
        lengths = document_lengths(post)
        stats = statistics(docs, lengths)
    tf = post.join(F.broadcast(terms), "term").groupBy("query_id", "term", "id").agg(F.count(F.lit(1)).alias("tf"))
    df = tf.groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("n_t"))
    each = tf.join(F.broadcast(df), ["query_id", "term"]).crossJoin(F.broadcast(stats)).join(lengths, "id")
    idf = F.log(1 + (F.col("n_docs") - F.col("n_t") + 0.5) / (F.col("n_t") + 0.5))
    s = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    found = each.groupBy("query_id", "id").agg(F.sum(s).alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit).select("query_id", "rank", "id", "score")
