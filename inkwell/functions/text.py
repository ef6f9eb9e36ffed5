"""Text clean-up, white space, lines and addresses."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode White_Space as a class that Java and RE2 both read.
SPACE = r"[\t\n\x0B\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
CONTROL = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x{9F}]"
FLOAT = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once however often it is used."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def clean_text(c: Column) -> Column:
    """Line breaks and no-break spaces become spaces; soft hyphens, zero-width
    spaces, byte order marks and controls other than tab go."""
    plain = F.translate(c, " ­​﻿", " ")
    return F.regexp_replace(F.regexp_replace(plain, r"\r\n|\r|\n", " "), CONTROL, "")


def collapse_whitespace(c: Column) -> Column:
    return F.regexp_replace(c, SPACE + "+", " ")


def trim_space(c: Column) -> Column:
    """Trims Unicode white space at both ends."""
    return F.regexp_replace(F.regexp_replace(c, f"^{SPACE}+", ""), f"{SPACE}+\\z", "")


def trim_xml_space(c: Column) -> Column:
    """Trims what XML calls white space, which leaves no-break spaces."""
    return F.regexp_replace(F.regexp_replace(c, r"^[ \t\r\n]+", ""), r"[ \t\r\n]+\z", "")


def words(c: Column) -> Column:
    return F.filter(F.split(c, SPACE + "+"), lambda w: w != "")


def lines(c: Column) -> Column:
    """Lines without their breaks; a last empty line is none."""
    parts = F.transform(F.split(c, "\n"), lambda x: F.regexp_replace(x, r"\r\z", ""))
    return let(parts, lambda p: F.when(F.element_at(p, -1) == "", F.slice(p, 1, F.size(p) - 1)).otherwise(p))


def has_scheme(c: Column) -> Column:
    return c.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:")


def is_drive_path(c: Column) -> Column:
    return c.rlike(r"^[A-Za-z]:[\\/]")


def is_absolute_uri(c: Column) -> Column:
    return has_scheme(c) & ~is_drive_path(c)


def parses_as_float(c: Column) -> Column:
    return c.rlike(FLOAT) | F.lower(c).rlike(r"^[+-]?(inf|infinity|nan)$")
