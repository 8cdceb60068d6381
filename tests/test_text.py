"""Chunks, headings, titles, globs, front matter, files and formats."""

from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestack.functions import chunks, format, text
from lodestack.sources import files
from lodestack.streaming.reindex import stream_postings


@given(st.text(alphabet="ab \n#`", max_size=400), st.sampled_from([(40, 8, 12), (25, 5, 10)]))
@settings(max_examples=200, deadline=None)
def test_chunks_cover_the_text(body, sizes):
    found = chunks.chunks(body, sizes)
    at = 0
    for pos, piece in found:
        assert body[pos : pos + len(piece)] == piece and pos <= at
        at = max(at, pos + len(piece))
    assert at == len(body)


def test_chunks_prefer_headings():
    body = "x" * 70 + "\n# Head\n" + "y" * 60
    assert chunks.chunks(body, (80, 5, 30))[0][1] == "x" * 70


def test_fences_are_not_cut():
    body = "a\n" * 20 + "\n```\n" + "code\n" * 8 + "```\n" + "b\n" * 40
    start = body.index("\n```")
    for pos, piece in chunks.chunks(body, (60, 6, 20)):
        assert not start < pos + len(piece) < body.index("```\nb")


def test_breadcrumbs():
    body = "# T\nintro\n## A\ntext\n### B\nmore\n```\n# no\n```\n## C\nend"
    found = chunks.headings(body)
    assert [h[2] for h in found] == ["T", "A", "B", "C"]
    at = body.index("more")
    assert chunks.breadcrumb("T", found, at, at + 4) == "T > A > B"
    assert chunks.breadcrumb("T", found, 0, 5) == "T"


def test_front_matter():
    doc = "---\nsearch:\n  metadata:\n    status: published\n    tags: [a, b, a]\n    n: 3\n    ok: true\n---\nbody"
    found, error = chunks.front_matter(doc, "x.md")
    assert error is None and found == {"status": "published", "tags": ["a", "b"], "n": 3, "ok": True}
    assert chunks.front_matter(doc, "x.py") == ({}, None)
    assert chunks.front_matter("---\nsearch:\n  metadata:\n    a: null\n---\n", "x.md")[1]
    assert chunks.front_matter("---\nsearch: [\n---\n", "x.md")[1]
    assert len(chunks.metadata_values(found)) == 5


def _snippet(spark, body, terms, pos=None, wanted=(), most=500):
    df = spark.createDataFrame([(body, list(terms), list(wanted), pos)], "body string, terms array<string>, wanted array<string>, pos int")
    return tuple(df.select(chunks.snippet(F.col("body"), F.col("terms"), F.col("wanted"), F.col("pos"), most=most).alias("s")).first()["s"])


def test_snippet(spark):
    """Line and text by the rules of its docstring, worked out by hand."""
    body = "one\ntwo\nthree apples\nfour\nfive\nsix"
    want = (3, "@@ -2,4 @@ (1 before, 1 after)\ntwo\nthree apples\nfour\nfive")
    assert _snippet(spark, body, ["apples"]) == want
    assert _snippet(spark, body, ["apples"], pos=4) == want
    assert _snippet(spark, body, ["none"]) == (1, "@@ -1,3 @@ (0 before, 3 after)\none\ntwo\nthree apples")
    assert _snippet(spark, body, ["two"], wanted=["four"])[0] == 2
    assert _snippet(spark, body, ["none"], wanted=["four"])[0] == 4
    assert _snippet(spark, body, ["apples"], most=10)[1].endswith("\ntwo\nth\u0072...")
    long = "apples\n" + "x\n" * 300 + "tail\n" + "\n" * 200
    assert _snippet(spark, long, ["apples"], pos=0)[0] == 1
    assert _snippet(spark, long, ["apples"], pos=607) == (302, "@@ -301,4 @@ (300 before, 199 after)\nx\ntail\n\n")
    assert _snippet(spark, long, ["apples"], pos=800)[0] == 1, "nothing to see there: the whole text"
    assert _snippet(spark, None, ["apples"], pos=3) == (1, "@@ -1,1 @@ (0 before, 0 after)\n")


def test_chunks_follow_the_definition():
    """Against the rules of a cut read literally: every break point tried, fences walked one by one."""
    import random

    rng = random.Random(5)

    def slow(body, most, overlap, window):
        points = chunks.break_points(body)
        at = [i for i in range(len(body)) if body.startswith("\n```", i)]
        inside = [(at[i], at[i + 1] + 4) for i in range(0, len(at) - 1, 2)]
        out = lambda p: next((b for a, b in inside if a < p < b), p)
        made, start = [], 0
        while len(body) - start > most:
            target = start + most
            worth = {p: s * (1 - 0.7 * ((target - p) / window) ** 2) for p, s in points.items() if target - window <= p <= target and out(p) == p}
            end = out(min(worth, key=lambda p: (-worth[p], p)) if worth else target)
            made.append((start, body[start:end]))
            if end >= len(body):
                return made
            start = out(end - overlap) if out(end - overlap) > start else max(start + 1, (start + end) // 2)
        return [*made, (start, body[start:])]

    for _ in range(300):
        body = "".join(rng.choice(["ab ", "\n", "\n\n", "\n# h", "\n- x", "\n```", "word ", "\n---\n"]) for _ in range(rng.randrange(150)))
        assert chunks.chunks(body, (60, 9, 20)) == slow(body, 60, 9, 20)


@pytest.mark.parametrize(
    ("content", "path", "want"),
    [
        ("# Hello\nx", "a/b.md", "Hello"),
        ("# Notes\n## Real", "b.md", "Real"),
        ("no heading", "a/b.c.md", "b.c"),
        ("#+title: Org\n* Head", "x.org", "Org"),
        ("* Head", "x.org", "Head"),
        ("# Code", "dir/x.py", "x"),
    ],
)
def test_titles(spark, content, path, want):
    df = spark.createDataFrame([(content, path)], "c string, p string")
    assert df.select(text.title(F.col("c"), F.col("p"))).first()[0] == want


@pytest.mark.parametrize(
    ("pattern", "path", "want"),
    [("**/*.md", "a/b/c.md", True), ("**/*.md", "c.md", True), ("*.md", "a/c.md", False), ("a/**", "a/b/c", True), ("[ab]?.md", "ax.md", True), ("*.{md,txt}", "a.md", False)],
)
def test_globs(pattern, path, want):
    import re

    assert bool(re.match(text.glob_regex(pattern), path)) == want


def test_glob_with_braces():
    import re

    assert re.match(text.glob_regex("*.{md,txt}", braces=True, deep=False), "a.txt")
    assert not re.match(text.glob_regex("*.md", braces=True, deep=False), ".a.md")
    assert text.split_masks("*.{a,b}, c , ,[x,y]") == ["*.{a,b}", "c", "[x,y]"]


def test_scan(spark, tmp_path):
    for name, data in {"a.md": b"# One\r\ntext", "sub/b.md": b"plain", "node_modules/c.md": b"x", ".h/d.md": b"x", "blank.md": b" \n", "bad.md": b"\xff\xfe", "draft-e.md": b"x", "f.txt": b"x"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    got = {r["path"]: r for r in files.scan(spark, str(tmp_path), "c", "**/*.md", ["draft-*"]).collect()}
    assert got.keys() == {"a.md", "sub/b.md", "bad.md"}
    assert got["a.md"]["title"] == "One" and got["a.md"]["body"] == "# One\ntext"
    assert got["bad.md"]["skipped"] and got["bad.md"]["body"] is None


def test_formats(spark):
    df = spark.createDataFrame([("abc123", "c/a.md", 'A "b"', 0.123, None, 4, "x <y>", "x <y>\nz")], "docid string, file string, title string, score double, context string, line int, snippet string, body string")
    got = {f: format.rows_as(df, f).first()["out"] for f in format.FORMATS}
    assert '"A ""b"""' in got["csv"] and "x &lt;y&gt;" in got["xml"] and got["files"].startswith("#abc123,0.12,c/a.md")
    assert got["json"].startswith('{"docid":"#abc123"') and "**context" not in got["md"]
    with pytest.raises(ValueError):
        format.rows_as(df, "pdf")


def test_line_ranges(spark):
    df = spark.createDataFrame([("a.md:3:2", "1\n2\n3\n4\n5"), ("b.md", "x\ny")], "i string, d string")
    path, start, count = text.line_range(F.col("i"))
    got = df.select(path.alias("p"), text.line_slice(F.col("d"), start, count, True).alias("l")).collect()
    assert [(r["p"], r["l"]) for r in got] == [("a.md", "3: 3\n4: 4"), ("b.md", "1: x\n2: y")]


def test_streamed_postings(spark, tmp_path):
    spark.createDataFrame([(1, "t", "one two"), (2, "t", "two")], "id long, title string, body string").write.parquet(str(tmp_path / "in"))
    stream_postings(spark, str(tmp_path / "in"), "id long, title string, body string", str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).filter("term = 'two'").count() == 2
