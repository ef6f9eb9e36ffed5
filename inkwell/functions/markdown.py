"""Pieces of GitHub-Flavored Markdown."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import trim_space


def format_url(c: Column) -> Column:
    """A link target: angle brackets, pipes and controls encoded, in angle
    brackets if it holds white space or parentheses."""
    safe = F.replace(F.replace(F.replace(c, F.lit("<"), F.lit("%3C")), F.lit(">"), F.lit("%3E")), F.lit("|"), F.lit("%7C"))
    for code in (9, 10, 13):
        safe = F.replace(safe, F.lit(chr(code)), F.lit(f"%{code:02X}"))
    return F.when(safe.rlike(r"[ ()\x{A0}\x{2000}-\x{200A}\x{3000}]"), F.concat(F.lit("<"), safe, F.lit(">"))).otherwise(safe)


def backtick_fence(c: Column, least: int = 3) -> Column:
    """The shortest run of backticks, ``least`` at least, longer than any in the text."""
    longest = F.array_max(F.transform(F.regexp_extract_all(c, F.lit("`+"), F.lit(0)), F.length))
    return F.repeat(F.lit("`"), F.greatest(F.lit(least), F.coalesce(longest, F.lit(0)) + 1))


def code_span(c: Column) -> Column:
    """An inline code span whose fence outgrows the content's backticks."""
    fence = backtick_fence(c, 1)
    pad = F.when(c.startswith("`") | c.endswith("`"), F.lit(" ")).otherwise(F.lit(""))
    return F.concat(fence, pad, c, pad, fence)


def slug(c: Column) -> Column:
    """The anchor that a heading gets: lower case, spaces as dashes, other marks gone."""
    kept = F.regexp_replace(F.replace(F.lower(trim_space(c)), F.lit(" "), F.lit("-")), r"[^\p{L}\p{N}\p{M}\p{Pc}-]", "")
    return F.when(kept == "", F.lit("section")).otherwise(kept)


def sanitize_id(c: Column) -> Column:
    """An HTML id: lower-case ASCII, other characters as single dashes."""
    low = F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    dashed = F.regexp_replace(F.regexp_replace(F.regexp_replace(low, "[^a-z0-9_-]", "-"), "-+", "-"), "^-|-$", "")
    return F.when(dashed == "", F.lit("anchor")).otherwise(dashed)


def cell_text(c: Column) -> Column:
    """A table cell on one line: lines trimmed, blank ones dropped, pipes escaped."""
    parts = F.filter(F.transform(F.split(c, "\n"), trim_space), lambda x: x != "")
    return F.replace(F.array_join(parts, "<br>"), F.lit("|"), F.lit("\\|"))


def table_row(cells: Column) -> Column:
    return F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))


def alpha_marker(n: Column) -> Column:
    """1 as a, 26 as z, 27 as aa, 703 as aaa: bijective base 26; numbers under 1
    stay decimal."""
    letters = F.lit("abcdefghijklmnopqrstuvwxyz")

    def step(s: Column, _: Column) -> Column:
        left = s["left"] - 1
        one = F.substring(letters, (left % 26 + 1).cast("int"), F.lit(1))
        return F.when(s["left"] > 0, F.struct(F.call_function("div", left, F.lit(26)).alias("left"), F.concat(one, s["out"]).alias("out"))).otherwise(s)

    # 14 letters hold every 64-bit number
    start = F.struct(n.cast("long").alias("left"), F.lit("").alias("out"))
    return F.when(n >= 1, F.aggregate(F.sequence(F.lit(1), F.lit(14)), start, step)["out"]).otherwise(n.cast("string"))


_ROMAN = [
    ["", "i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix"],
    ["", "x", "xx", "xxx", "xl", "l", "lx", "lxx", "lxxx", "xc"],
    ["", "c", "cc", "ccc", "cd", "d", "dc", "dcc", "dccc", "cm"],
    ["", "m", "mm", "mmm"],
]


def roman_marker(n: Column) -> Column:
    """Roman numerals up to 3999; other numbers stay decimal."""
    parts = [F.element_at(F.array(*[F.lit(x) for x in names]), (F.floor(n / 10**i) % 10 + 1).cast("int")) for i, names in enumerate(_ROMAN)]
    return F.when((n >= 1) & (n <= 3999), F.concat(*parts[::-1])).otherwise(n.cast("string"))
