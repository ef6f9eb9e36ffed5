"""Connected components of an edge table by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, stored


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def _star(pairs: DataFrame, keep_larger: bool) -> DataFrame:
    """Link each neighbour of a node to the smallest of node and neighbours.

    The minimum is a partially aggregated groupBy and the way back a join, so a
    node with very many neighbours is never gathered in one place.
    """
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = pairs.join(least, "u")
    if keep_larger:
        linked = joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        linked = joined.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return linked.filter("u <> v").distinct()


def components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component) for every node on an edge; component is its least node.

    Self loops, repeated edges and either direction are accepted; edges with a
    null end are ignored; no edges give no rows.  Rounds are logarithmic in
    practice and each one is written to the shared folder.
    """
    pairs = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).filter("u <> v")
    now = stored(pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc")
    state = _state(now)
    while state[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both, True)
        small = stored(_star(large, False), "cc")
        after = _state(small)
        dropped(now)
        now, before, state = small, state, after
        if before == after:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
