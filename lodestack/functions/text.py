"""Text as columns: normalising, tokens, titles, globs, line ranges."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values, searched character by character: Han with extension A and compatibility forms, kana, Hangul syllables and letters.
CJK = r"\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{3040}-\x{309F}\x{30A0}-\x{30FF}\x{AC00}-\x{D7A3}\x{1100}-\x{11FF}"


@lru_cache(maxsize=1)
def _accents() -> tuple[str, str]:
    """Letters with marks and the letters without; marks of their own come last, so translate() drops them."""
    pairs = []
    for block in (range(0xC0, 0x250), range(0x1E00, 0x1F00)):
        for c in map(chr, block):
            base = unicodedata.normalize("NFD", c)
            if len(base) > 1 and all(unicodedata.combining(x) for x in base[1:]):
                pairs.append((c, base[0]))
    marks = "".join(map(chr, range(0x300, 0x370)))
    return "".join(p[0] for p in pairs) + marks, "".join(p[1] for p in pairs)


def folded(col: Column) -> Column:
    """Lower case without diacritics; CJK runs spaced out."""
    source, target = _accents()
    spaced = F.regexp_replace(col, f"([{CJK}])", " $1 ")
    return F.translate(F.lower(spaced), source, target)


def tokens(col: Column) -> Column:
    """The tokens of a text, in order; none for null. They are what stands between other characters."""
    return F.array_remove(F.split(folded(F.coalesce(col, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def fold(text: str) -> str:
    """folded() on the driver."""
    text = unicodedata.normalize("NFD", unicodedata.normalize("NFC", text).lower())
    text = "".join(c for c in text if not unicodedata.combining(c))
    return unicodedata.normalize("NFC", text)


def title(content: Column, path: Column) -> Column:
    """A document's title by its extension: first heading, or the file name without its extension.

    A markdown heading that is only "Notes" gives way to the first second-level one.
    """
    brk = r"(?:^|[\n\r\x{2028}\x{2029}])"
    line = r"[^\n\r\x{2028}\x{2029}]"
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    stem = F.when(name.rlike(r"^.+\.[^.]*$"), F.regexp_extract(name, r"^(.+)\.[^.]*$", 1)).otherwise(name)
    first = F.trim(F.regexp_extract(content, rf"{brk}##?[ \t]+({line}+)", 1))
    second = F.trim(F.regexp_extract(content, rf"{brk}##[ \t]+({line}+)", 1))
    markdown = F.when(first.isin("Notes", "\U0001f4dd Notes") & (second != ""), second).otherwise(first)
    keyword = F.trim(F.regexp_extract(content, rf"(?i){brk}#\+TITLE:[ \t]*({line}+)", 1))
    star = F.trim(F.regexp_extract(content, rf"{brk}\*+[ \t]+({line}+)", 1))
    ext = F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1))
    found = F.when(ext == ".md", markdown).when(ext == ".org", F.coalesce(F.nullif(keyword, F.lit("")), star)).otherwise(F.lit(""))
    return F.coalesce(F.nullif(found, F.lit("")), stem)


def split_masks(mask: str) -> list[str]:
    """A glob mask cut at commas outside braces and brackets."""
    out, depth, part = [], 0, ""
    for c in mask:
        depth += (c in "{[") - (c in "}]" and depth > 0)
        if c == "," and depth == 0:
            out.append(part)
            part = ""
        else:
            part += c
    return [p.strip() for p in [*out, part] if p.strip()]


def glob_regex(pattern: str, braces: bool = False, deep: bool = True) -> str:
    """An anchored regular expression for a glob on a relative path.

    `*` and `?` stay within a path part and don't match a leading dot; with `deep`, a part `**` spans any number of
    parts; with `braces`, {a,b} are alternatives.
    """
    out, i, n, open_braces, at_start = "^", 0, len(pattern), 0, True
    dot = r"(?!\.)"
    while i < n:
        c = pattern[i]
        guard = dot if at_start and not deep else ""
        now_start = False
        if c == "*":
            j = i
            while j < n and pattern[j] == "*":
                j += 1
            whole = j - i >= 2 and at_start and (j == n or pattern[j] == "/")
            if deep and whole:
                out += r"(?:[^/]+/)*" if j < n else r".*"
                j += j < n
                now_start = True
            else:
                out += guard + r"[^/]*"
            i = j
        else:
            if c == "?":
                out += guard + r"[^/]"
            elif c == "[" and "]" in pattern[i + 2 :]:
                end = pattern.index("]", i + 2)
                body = pattern[i + 1 : end].replace("\\", "\\\\")
                out += "[" + ("^" + body[1:] if body[0] in "!^" else body) + "]"
                i = end
            elif braces and c == "{" and "}" in pattern[i:]:
                out += "(?:"
                open_braces += 1
            elif open_braces and c == "}":
                out += ")"
                open_braces -= 1
            elif open_braces and c == ",":
                out += "|"
            else:
                out += re.escape(c)
                now_start = c == "/"
            i += 1
        at_start = now_start
    return out + "$"


def line_range(ident: Column) -> tuple[Column, Column, Column]:
    """`path:start[:count]` as path, start (1 at least, or null) and count (or null)."""
    found = r"^(.*?):(\d+)(?::(\d+))?$"
    has = ident.rlike(found)
    part = lambda i: F.nullif(F.regexp_extract(ident, found, i), F.lit("")).cast("int")
    return F.when(has, F.regexp_extract(ident, found, 1)).otherwise(ident), F.when(has, F.greatest(part(2), F.lit(1))), F.when(has, part(3))


def line_slice(doc: Column, start: Column, count: Column, numbered: bool = False) -> Column:
    """Lines start to start + count - 1 (null count: to the end), with their numbers if asked."""
    lines = F.split(doc, "\n")
    begin = F.coalesce(start, F.lit(1))
    taken = F.slice(lines, begin, F.coalesce(count, F.size(lines)))
    if numbered:
        taken = F.transform(taken, lambda x, i: F.concat((i + begin).cast("string"), F.lit(": "), x))
    return F.array_join(taken, "\n")


def truncate_lines(doc: Column, most: int) -> Column:
    """The first lines, and a note of how many are left out."""
    lines = F.split(doc, "\n")
    note = F.concat(F.lit("\n[... truncated "), (F.size(lines) - most).cast("string"), F.lit(" more lines]"))
    return F.when(F.size(lines) > most, F.concat(F.array_join(F.slice(lines, 1, most), "\n"), note)).otherwise(doc)


def context_window(page: Column, pos: Column, size: Column, most: int) -> Column:
    """The page, or if it is longer `most` characters of it centred on a chunk."""
    start = F.least(F.greatest(pos + F.floor(size / 2) - most // 2, F.lit(0)), F.length(page) - most)
    return F.when(F.length(page) <= most, page).otherwise(F.substring(page, start.cast("int") + 1, F.lit(most)))


def with_context(context: Column, chunk: Column) -> Column:
    """A chunk below its context, if there is one."""
    return F.concat(F.coalesce(F.concat(F.nullif(context, F.lit("")), F.lit("\n\n")), F.lit("")), chunk)


def char_offset(text: Column, byte: Column) -> Column:
    """How many characters stand before a place given in bytes of UTF-8, which must be a character's border."""
    return F.length(F.decode(F.substring(F.encode(text, "UTF-8"), F.lit(1), byte), "UTF-8"))
