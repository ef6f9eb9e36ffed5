"""Stretches of a text as arrays in the row: matches with their places, groups of
stretches that overlap, and pieces of a text.

A stretch is a struct that begins with a (start) and b (end), in code points.  Sums
and maxima over earlier elements go by blocks, so that nothing is quadratic in the
stretches of a text.  Everything is SQL functions.

An array that is looked up for every element stands twice in its expression: a
column that stands once would be computed inside the lambda, again for each element.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements of a block of running sums or maxima.
BLOCK = 256
#: Characters of a piece of a text.
PIECE = 1000


def quoted(pattern: str) -> str:
    """A SQL string literal."""
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def before(values: str, sums: str) -> str:
    """SQL: the sum of the elements of ``values`` before index i, given ``sums``, the
    sums of all blocks before each block."""
    return f"(coalesce({sums}[cast(i div {BLOCK} as int)], {sums}[0]) + aggregate(slice({values}, cast((i div {BLOCK}) * {BLOCK} + 1 as int), cast(i % {BLOCK} as int)), 0L, (s, n) -> s + n))"


def block_sums(values: str) -> str:
    """SQL: the sum of each block of ``values``."""
    return f"transform(sequence(0, greatest(size({values}) - 1, 0) div {BLOCK}), k -> aggregate(slice({values}, cast(k * {BLOCK} + 1 as int), {BLOCK}), 0L, (s, n) -> s + n))"


def earlier_sums(sums: str) -> str:
    """SQL: for each block the sum of the blocks before it."""
    return f"transform({sums}, (x, k) -> aggregate(slice({sums}, 1, k), 0L, (s, n) -> s + n))"


def with_matches(df: DataFrame, name: str, pattern: str, test: str) -> DataFrame:
    """Adds ``name``: structs (a, b, x) of the matches of ``pattern`` in column text,
    x being what was matched; none where the SQL ``test`` fails."""
    p = quoted(pattern)
    df = df.withColumns({"__g": F.expr(f"CASE WHEN {test} THEN split(text, {p}, -1) END"), "__t": F.expr(f"CASE WHEN {test} THEN regexp_extract_all(text, {p}, 0) END")})
    df = df.withColumn("__l", F.expr("transform(__t, (x, i) -> length(x) + length(__g[i]))"))
    df = df.withColumn("__s", F.expr(block_sums("__l")))
    df = df.withColumn("__p", F.expr(earlier_sums("__s")))
    df = df.withColumn("__a", F.expr(f"transform(__t, (x, i) -> {before('__l', '__p')} + length(__g[i]))"))
    df = df.withColumn(name, F.expr("coalesce(transform(__t, (x, i) -> struct(__a[i] as a, __a[i] + length(x) as b, x as x)), array())"))
    return df.drop("__g", "__t", "__l", "__s", "__p", "__a")


def with_groups(df: DataFrame, spans: str, name: str) -> DataFrame:
    """Adds ``name``: the array ``spans`` in order, cut into arrays of stretches that
    overlap directly or through others of the same array."""
    df = df.withColumn("__o", F.expr(f"sort_array({spans})"))
    df = df.withColumn("__m", F.expr(f"CASE WHEN size(__o) > 0 THEN transform(sequence(0, (size(__o) - 1) div {BLOCK}), k -> array_max(transform(slice(__o, cast(k * {BLOCK} + 1 as int), {BLOCK}), o -> o.b))) END"))
    df = df.withColumn("__m", F.expr("transform(__m, (x, k) -> CASE WHEN k > 0 THEN array_max(slice(__m, 1, k)) END)"))
    met = f"__m[cast(i div {BLOCK} as int)] is not null and __m[cast(i div {BLOCK} as int)] > __o[i].a or exists(slice(__o, cast((i div {BLOCK}) * {BLOCK} + 1 as int), cast(i % {BLOCK} as int)), o -> o.b > __o[i].a)"
    df = df.withColumn("__h", F.expr(f"CASE WHEN size(__o) > 0 THEN filter(sequence(0, size(__o) - 1), i -> not ({met})) END"))
    df = df.withColumn(name, F.expr("coalesce(transform(__h, (h, k) -> slice(__o, h + 1, coalesce(get(__h, k + 1), size(__o)) - h)), array())"))
    return df.drop("__o", "__m", "__h")


def with_pieces(df: DataFrame, name: str, test: str) -> DataFrame:
    """Adds ``name``: column text in pieces of ``PIECE`` characters, or null where the
    SQL ``test`` fails."""
    return df.withColumn(name, F.expr(f"CASE WHEN {test} THEN regexp_extract_all(text, '(?s).{{1,{PIECE}}}', 0) END"))


def cut(pieces: str, a: str, b: str) -> str:
    """SQL: the text from ``a`` to ``b`` or the end, without counting from its beginning."""
    first, last = f"cast({a} div {PIECE} as int)", f"cast({b} div {PIECE} as int)"
    begin = f"coalesce(get({pieces}, {first}), '')"
    head = f"substr({begin}, cast({a} % {PIECE} + 1 as int))"
    within = f"substr({begin}, cast({a} % {PIECE} + 1 as int), cast({b} - {a} as int))"
    tail = f"substr(coalesce(get({pieces}, {last}), ''), 1, cast({b} % {PIECE} as int))"
    middle = f"array_join(slice({pieces}, {first} + 2, {last} - {first} - 1), '')"
    return f"(CASE WHEN {a} >= {b} THEN '' WHEN {first} = {last} THEN {within} WHEN {first} + 1 = {last} THEN concat({head}, {tail}) ELSE concat({head}, {middle}, {tail}) END)"
