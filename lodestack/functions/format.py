"""Numbers, times and rows as text, in six formats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FORMATS = ("json", "csv", "files", "md", "xml", "cli")


def format_bytes(n: Column, largest: str = "TB") -> Column:
    """Bytes as a whole number, larger sizes with one decimal place, half to even, in units up to the largest."""
    units = ("KB", "MB", "GB", "TB")[: ("KB", "MB", "GB", "TB").index(largest) + 1]
    size = lambda power: F.format_string(f"%.1f {units[power - 1]}", F.bround(n / 1024**power, 1))
    out = size(len(units))
    for power in range(len(units) - 1, 0, -1):
        out = F.when(n < 1024 ** (power + 1), size(power)).otherwise(out)
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).otherwise(out)


def listing_time(then: Column, now: Column) -> Column:
    """Month and day with the time of day, or from 180 days on with the year."""
    old = F.unix_timestamp(now) - F.unix_timestamp(then) >= 180 * 86400
    return F.when(old, F.date_format(then, "MMM dd  yyyy")).otherwise(F.date_format(then, "MMM dd HH:mm"))


def remaining(seconds: Column) -> Column:
    """Seconds as 12s, 2m 3s or 1h 4m."""
    s = F.floor(seconds + 0.5)
    two = lambda a, x, b, y: F.concat(a.cast("string"), F.lit(f"{x} "), b.cast("string"), F.lit(y))
    return F.when(s < 60, F.concat(s.cast("string"), F.lit("s"))).when(s < 3600, two(F.floor(s / 60), "m", s % 60, "s")).otherwise(two(F.floor(s / 3600), "h", F.floor(s % 3600 / 60), "m"))


def time_ago(then: Column, now: Column) -> Column:
    s = F.unix_timestamp(now) - F.unix_timestamp(then)
    unit = lambda size, name: F.concat(F.floor(s / size).cast("string"), F.lit(name))
    return F.when(s < 60, unit(1, "s ago")).when(s < 3600, unit(60, "m ago")).when(s < 86400, unit(3600, "h ago")).otherwise(unit(86400, "d ago"))


def score_text(score: Column) -> Column:
    """Two places, half to even."""
    return F.bround(score * 100) / 100


def half_up_percent(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, F.floor(100 * part / whole + 0.5)).otherwise(F.lit(0)).cast("int")


def csv_field(c: Column) -> Column:
    c = F.coalesce(c.cast("string"), F.lit(""))
    return F.when(c.rlike('[",\n\r]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)


def xml_text(c: Column) -> Column:
    c = F.coalesce(c.cast("string"), F.lit(""))
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(raw), F.lit(safe))
    return c


def rows_as(df: DataFrame, form: str, full: bool = False) -> DataFrame:
    """Search rows (docid, file, title, score, context, line, snippet, body) as one column `out`; each row keeps its order columns out of it.

    A null context is left out of json, md, xml and cli.
    """
    if form not in FORMATS:
        raise ValueError(f"unknown format {form!r}")
    text = F.col("body") if full else F.col("snippet")
    score = score_text(F.col("score"))
    docid = F.concat(F.lit("#"), F.col("docid"))
    if form == "json":
        out = F.to_json(F.struct(docid.alias("docid"), score.alias("score"), "file", "line", "title", "context", text.alias("body" if full else "snippet")))
    elif form == "csv":
        out = F.concat_ws(",", *map(csv_field, (docid, score, F.col("file"), F.col("title"), F.col("context"), F.col("line"), text)))
    elif form == "files":
        out = F.concat_ws(",", docid, score.cast("string"), "file", F.when(F.col("context").isNotNull(), F.concat(F.lit('"'), F.replace("context", F.lit('"'), F.lit('""')), F.lit('"'))))
    elif form == "md":
        out = F.concat_ws("\n", F.concat(F.lit("# "), "title"), F.concat(F.lit("**docid:** `"), docid, F.lit("`")), F.concat(F.lit("**context:** "), "context"), F.lit(""), text)
    elif form == "xml":
        context = F.coalesce(F.concat(F.lit(' context="'), xml_text(F.col("context")), F.lit('"')), F.lit(""))
        if_context = F.when(F.col("context").isNotNull(), context).otherwise(F.lit(""))
        out = F.concat(F.lit('<file docid="'), docid, F.lit('" name="'), xml_text(F.col("file")), F.lit('"'), if_context, F.lit(">\n"), xml_text(text), F.lit("\n</file>"))
    else:
        out = F.concat_ws("\n", F.concat_ws(" ", F.concat_ws(":", "file", F.col("line").cast("string")), docid), F.concat(F.lit("Title: "), "title"), F.concat(F.lit("Context: "), "context"), F.concat(F.lit("Score: "), F.format_string("%d%%", F.round(F.col("score") * 100).cast("int"))), F.lit(""), text)
    return df.select(*[c for c in ("query_id", "rank") if c in df.columns], out.alias("out"))


def documents_as(df: DataFrame, form: str) -> DataFrame:
    """Documents of a multi-get (docid, file, title, context, skipped, reason, body) as one column `out`.

    A null docid and a null or empty context are left out; a skipped document shows its reason and no body. The
    formats' frames (a CSV header, the list's brackets) are the writer's: see FRAMES.
    """
    if form not in FORMATS:
        raise ValueError(f"unknown format {form!r}")
    tag, context = F.concat(F.lit("#"), F.col("docid")), F.nullif(F.col("context"), F.lit(""))
    either = lambda skipped, whole: F.when(F.col("skipped"), skipped).otherwise(whole)
    reason, body = F.coalesce("reason", F.lit("")), F.coalesce("body", F.lit(""))
    if_any = lambda before, c, after: F.coalesce(F.concat(F.lit(before), c, F.lit(after)), F.lit(""))
    if form == "json":
        only_skipped = F.when(F.col("skipped"), F.lit(True))
        out = F.to_json(F.struct("file", tag.alias("docid"), "title", context.alias("context"), only_skipped.alias("skipped"), F.when(F.col("skipped"), F.col("reason")).alias("reason"), F.when(~F.col("skipped"), body).alias("body")))
    elif form == "csv":
        out = F.concat_ws(",", *map(csv_field, (tag, F.col("file"), F.col("title"), context)), F.col("skipped").cast("string"), csv_field(either(reason, body)))
    elif form == "files":
        out = F.concat(if_any("", tag, ","), "file", if_any(',"', F.replace(context, F.lit('"'), F.lit('""')), '"'), either(F.lit(",[SKIPPED]"), F.lit("")))
    elif form == "md":
        title = F.nullif(F.nullif(F.col("title"), F.lit("")), F.col("file"))
        out = F.concat(F.lit("## "), "file", F.lit("\n\n"), if_any("**docid:** `", tag, "`\n\n"), if_any("**Title:** ", title, "\n\n"), if_any("**Context:** ", context, "\n\n"),
                       either(F.concat(F.lit("> "), reason, F.lit("\n")), F.concat(F.lit("```\n"), body, F.lit("\n```\n"))))
    elif form == "xml":
        field = lambda name, c: F.concat(F.lit(f"    <{name}>"), xml_text(c), F.lit(f"</{name}>\n"))
        shown = either(F.concat(F.lit("    <skipped>true</skipped>\n"), field("reason", reason)), field("body", body))
        with_context = F.when(context.isNotNull(), field("context", context)).otherwise(F.lit(""))
        out = F.concat(F.lit("  <document"), if_any(' docid="', tag, '"'), F.lit(">\n"), field("file", F.col("file")), field("title", F.col("title")), with_context, shown, F.lit("  </document>"))
    else:
        bar = F.lit("=" * 60)
        whole = F.concat(if_any("Folder Context: ", context, "\n---\n\n"), body)
        out = F.concat(F.lit("\n"), bar, F.lit("\nFile: "), "file", if_any("  ", tag, ""), F.lit("\n"), bar, F.lit("\n\n"), either(F.concat(F.lit("[SKIPPED: "), reason, F.lit("]")), whole))
    return df.select(*[c for c in ("place",) if c in df.columns], out.alias("out"))


#: What stands before, between and after the rows of a file of documents.
FRAMES = {
    "json": ("[", ",", "]"), "csv": ("docid,file,title,context,skipped,body\n", "\n", ""), "files": ("", "\n", ""), "md": ("", "\n", ""),
    "xml": ('<?xml version="1.0" encoding="UTF-8"?>\n<documents>\n', "\n", "\n</documents>"), "cli": ("", "\n", ""),
}


def framed(rows: list[str], form: str) -> str:
    """A page of formatted documents (what one multi-get returns) as one text."""
    before, between, after = FRAMES[form]
    return before + between.join(rows) + after
