"""SimHash near-duplicates found with pivot distance tables.

Fingerprints within ``max_bits`` agree on some ``blocks - max_bits`` of ``blocks``
bit blocks, so every such pair meets in a bucket of equal block combinations.
Each bucket picks reference fingerprints (pivots) by partial aggregation and a
table holds every member's Hamming distance to each of them.

* A member within ``max_bits`` of a pivot links to the pivot itself, one edge a
  member, so large groups of near copies cost linear work.
* What is left are pairs whose components still differ.  They are joined on the
  cells of two pivot coordinates, pairs whose coordinates differ by more than
  ``max_bits`` in any pivot are discarded (the triangle inequality shows that
  they are too far apart), and survivors are verified bit by bit.

No step emits all pairs of a bucket and no bucket is gathered into one task.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from .common import dropped, small_batches, stored, text_bytes, unused
from .components import components

SHINGLE = 4
MAX_BITS = 4
PIVOTS = 8
SEED = 42


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of word shingles; 0 for a text without words."""
    words = text.lower().split() if text else []
    if not words:
        return 0
    joined = memoryview(b" ".join(words))
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate(([0], ends[:-1]))
    n = max(1, len(words) - shingle + 1)
    stops = ends[min(shingle, len(words)) - 1 :][:n] - 1
    h, seed = xxhash.xxh64_intdigest, SEED
    hashes = np.array([h(joined[a:b], seed) for a, b in zip(starts[:n].tolist(), stops.tolist())], dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, n, 8192):
        part = hashes[at : at + 8192].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


@F.pandas_udf(LongType())
def _fingerprints(texts: pd.Series) -> pd.Series:
    return pd.Series([fingerprint(x) for x in texts], dtype="int64")


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b)).cast("int")


def blocks_for(n: int, max_bits: int) -> int:
    """Blocks so that unrelated fingerprints seldom share a bucket: the equal bits
    64 * (blocks - max_bits) / blocks must outgrow log2 of the fingerprints."""
    for blocks in (max_bits + 3, max_bits + 4, max_bits + 5):
        if n < 2 ** (64 * (blocks - max_bits) // blocks + 2):
            return blocks
    return max_bits + 6


def bucket_keys(fp: Column, blocks: int, max_bits: int) -> Column:
    """An array with one key for each choice of ``blocks - max_bits`` blocks."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    masks = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]
    keys = []
    for i, chosen in enumerate(combinations(masks, blocks - max_bits)):
        mask = reduce(lambda x, y: x | y, chosen)
        keys.append(F.xxhash64(F.lit(i), fp.bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask))))
    return F.array(*keys)


def _cells(c: str, width: int, around: bool) -> Column:
    own = F.floor(F.col(c) / width)
    return F.array(own - 1, own, own + 1) if around else own


def linked_fingerprints(fps: DataFrame, max_bits: int = MAX_BITS, pivots: int = PIVOTS) -> DataFrame:
    """(node, component) of the distinct longs in column ``fp`` that have a partner
    within ``max_bits`` bits; component is the least fingerprint as a signed long."""
    blocks = blocks_for(fps.count(), max_bits)
    keyed = fps.select("fp", F.explode(bucket_keys(F.col("fp"), blocks, max_bits)).alias("k"))
    shared = keyed.groupBy("k").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi")).filter("lo <> hi").select("k")
    members = stored(keyed.join(shared, "k", "left_semi"), "simhash-members")
    picks = [F.min_by("fp", F.xxhash64(F.lit(i), "fp")).alias(f"p{i}") for i in range(pivots)]
    chosen = members.groupBy("k").agg(*picks)
    distances = [hamming(F.col("fp"), F.col(f"p{i}")).cast("byte").alias(f"d{i}") for i in range(pivots)]
    table = stored(members.join(chosen, "k").select("k", "fp", *[f"p{i}" for i in range(pivots)], *distances), "simhash-pivots")
    dropped(members)
    near = F.array(*[F.when((F.col(f"d{i}") > 0) & (F.col(f"d{i}") <= max_bits), F.col(f"p{i}")) for i in range(pivots)])
    stars = stored(table.select(F.col("fp").alias("src"), F.explode(F.array_compact(near)).alias("dst")).distinct(), "simhash-stars")
    first = components(stars)
    label = F.coalesce("component", "fp").alias("label")
    coords = [f"d{i}" for i in range(pivots)]
    named = table.select("k", "fp", *coords).join(first.withColumnRenamed("node", "fp"), "fp", "left").select("k", "fp", *coords, label)
    named = stored(named, "simhash-named")
    dropped(table)
    mixed = named.groupBy("k", "label").count().groupBy("k").agg(F.max_by("label", F.struct("count", "label")).alias("major"), F.count("*").alias("n")).filter("n > 1")
    open_rows = named.join(mixed.select("k", "major"), "k")
    width = max_bits + 1
    left = open_rows.filter("label <> major").select("k", F.col("fp").alias("src"), F.col("label").alias("la"), *[F.col(c).alias(f"a{c}") for c in coords], F.explode(_cells("d0", width, True)).alias("c0"), _cells("d1", width, True).alias("c1s"))
    left = left.withColumn("c1", F.explode("c1s")).drop("c1s")
    right = open_rows.select("k", F.col("fp").alias("dst"), F.col("label").alias("lb"), *coords, _cells("d0", width, False).alias("c0"), _cells("d1", width, False).alias("c1"))
    close = reduce(lambda x, y: x & y, [F.abs(F.col(f"a{c}") - F.col(c)) <= max_bits for c in coords])
    met = left.join(right, ["k", "c0", "c1"]).filter((F.col("la") != F.col("lb")) & close & (hamming(F.col("src"), F.col("dst")) <= max_bits))
    rest = met.groupBy("la", "lb").agg(F.lit(1).alias("one")).select(F.col("la").alias("src"), F.col("lb").alias("dst"))
    out = stored(components(stars.unionByName(rest)), "simhash-components")
    for gone in (stars, named):
        dropped(gone)
    return out


def _hashed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    small_batches(docs.sparkSession)
    return stored(docs.select(F.col(id_col).alias("doc_id"), _fingerprints(text_bytes(F.col(text_col))).alias("fp")), "simhash-fp")


def _components_of(hashed: DataFrame, max_bits: int) -> tuple[DataFrame, DataFrame]:
    """((fp, rep, component), (component, component_id)), both written: what follows
    joins them, and a component of very many fingerprints can be split."""
    reps = hashed.groupBy("fp").agg(F.min("doc_id").alias("rep"))
    groups = linked_fingerprints(reps.select("fp"), max_bits)
    placed = reps.join(groups.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "rep", F.coalesce("component", "fp").alias("component"))
    placed = stored(placed, "simhash-placed")
    dropped(groups)
    return placed, stored(placed.groupBy("component").agg(F.min("rep").alias("component_id")), "simhash-least")


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_BITS) -> DataFrame:
    """(doc_id, fingerprint, component_id), one row for each row of ``docs``.

    A null, empty or blank text has fingerprint zero and links like any other.
    Repeated rows and exact copies share a fingerprint and so a component; ties
    cannot arise since component_id is the least id.  Null ids keep their row and
    never name a component unless all its ids are null.  An empty table gives no
    rows; other columns are not read, so their names may clash with ours.
    """
    hashed = _hashed(docs, id_col, text_col)
    placed, least = _components_of(hashed, max_bits)
    by_fp = stored(placed.join(least, "component").select("fp", "component_id"), "simhash-by-fp")
    for gone in (placed, least):
        dropped(gone)
    return hashed.join(by_fp, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_BITS) -> DataFrame:
    """One row of ``docs``, with all its columns, for each component.

    It is the row of the least id (a null id is the largest); of several rows with
    that id the one of the least fingerprint (as a signed number) stays, and of
    those that share it too any one.  Null and blank texts have fingerprint zero
    and so are one component.  An empty table gives an empty one; columns may have
    any names.
    """
    first, print_, row_id = unused(docs, "first"), unused(docs, "print"), F.col(id_col)
    hashed = _hashed(docs, id_col, text_col)
    placed, least = _components_of(hashed, max_bits)
    order = F.struct(F.col("rep").isNull().alias("n"), "rep", "fp")
    best = stored(placed.groupBy("component").agg(F.min(order).alias("b")).select(F.col("b.rep").alias(first), F.col("b.fp").alias(print_)), "simhash-best")
    # ids that one row has need no second look at the texts
    often = stored(hashed.groupBy("doc_id").count().filter("count > 1 or doc_id is null").select(F.col("doc_id").alias(first)), "simhash-ids")
    for gone in (placed, least, hashed):
        dropped(gone)
    once = best.join(often, best[first].eqNullSafe(often[first]), "left_anti")
    kept = docs.join(once, row_id == once[first], "left_semi")
    if often.isEmpty():
        return kept
    again = docs.join(often, row_id.eqNullSafe(often[first]), "left_semi").withColumn(print_, _fingerprints(text_bytes(F.col(text_col))))
    again = again.join(best, again[id_col].eqNullSafe(best[first]) & (again[print_] == best[print_]), "left_semi")
    return kept.unionByName(again.dropDuplicates([id_col, print_]).drop(print_))
