"""Spreadsheet values: serial dates, number formats, cell references."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .markdown import alpha_marker


def serial_text(serial: Column, duration: Column | None = None, date1904: bool = False) -> Column:
    """A serial number as text: a time below one day, else a date with its time
    unless midnight; durations as hours, minutes and seconds."""
    millis = F.round(serial * 86_400_000).cast("long")
    clock = F.format_string("%02d:%02d:%02d", F.floor(millis / 3_600_000), F.floor(millis / 60_000) % 60, F.floor(millis / 1000) % 60)
    days = F.floor(serial) + (1462 if date1904 else 0)
    days = days + F.when(days < 60, 1).otherwise(0)
    inside = millis - F.floor(serial) * 86_400_000
    date = F.date_format(F.date_add(F.lit("1899-12-30").cast("date"), days.cast("int")), "yyyy-MM-dd")
    time = F.format_string("%02d:%02d:%02d", F.floor(inside / 3_600_000), F.floor(inside / 60_000) % 60, F.floor(inside / 1000) % 60)
    full = F.when(time == "00:00:00", date).otherwise(F.concat(date, F.lit(" "), time))
    shown = F.when(F.abs(serial) < 1, clock).otherwise(full)
    long = F.format_string("%d:%02d:%02d", F.floor(millis / 3_600_000), F.floor(millis / 60_000) % 60, F.floor(millis / 1000) % 60)
    return shown if duration is None else F.when(duration, long).otherwise(shown)


def format_class(code: Column) -> Column:
    """``timeDelta``, ``dateTime`` or ``other`` for a number format code."""
    first = F.regexp_replace(F.regexp_replace(code, r'"[^"]*"?', ""), r"[_\\*].", "")
    section = F.lower(F.regexp_extract(first, "^([^;]*)", 1))
    elapsed = section.rlike(r"^[^dmhys]*\[(h+|m+|s+)\]")
    bare = F.regexp_replace(section, r"\[[^\]]*\]", "")
    return F.when(elapsed, "timeDelta").when(bare.rlike(r"[dmhys]|a[pm/]"), "dateTime").otherwise("other")


def column_letters(n: Column) -> Column:
    """Column 1 as A, 27 as AA, 703 as AAA, and so on; no letters under 1."""
    return F.when(n < 1, F.lit("")).otherwise(F.upper(alpha_marker(n)))


def column_number(letters: Column) -> Column:
    codes = F.transform(F.split(F.upper(letters), ""), lambda x: F.when(x != "", F.ascii(x) - 64))
    return F.aggregate(F.array_compact(codes), F.lit(0).cast("long"), lambda s, x: s * 26 + x)
