"""Benchmark decontamination with suffix arrays of the training texts.

Each batch of texts is a shard.  Its word suffixes are sorted to the depth of a
window and every suffix of the benchmark is binary-searched in that array, which
gives the places of all verbatim matches; matches on neighbouring places of the
same item join to longest matches.  A suffix that begins with a pair of words
which no benchmark item has cannot match and is left out of the array.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from .common import small_batches, stored, text_bytes, unused
from .words import Words, batched

WINDOW = 10
#: Benchmark bytes that are sent to executors at once; a larger one goes block by block.
BLOCK_BYTES = 32_000_000
PAIR_BITS = 22


def _big_endian(ids: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """Windows of word ids (1 or more) as byte strings that sort like the ids."""
    rows = ids[starts[:, None] + np.arange(width)].astype(">u4")
    return np.ascontiguousarray(rows).view(f"S{4 * width}").ravel()


def _pair_slots(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return ((left.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + right.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(64 - PAIR_BITS)).astype(np.int64)


class Benchmark:
    """The benchmark's windows: for each length its distinct windows in order, and
    for each of them where it stands in which item."""

    def __init__(self, items: list[tuple[str | None, bytes | None]], window: int = WINDOW):
        words = Words([t for _, t in items])
        self.items = [i for i, _ in items]
        self.vocabulary, ids = np.unique(words.hashes, return_inverse=True)
        ids = ids.astype(np.uint32) + 1
        self.pairs = np.zeros(1 << PAIR_BITS, dtype=bool)
        places: dict[int, list[np.ndarray]] = {}
        owners: dict[int, list[np.ndarray]] = {}
        for k, (a, b) in enumerate(zip(words.bounds, words.bounds[1:])):
            if b > a:
                width = min(window, b - a)
                starts = np.arange(a, b - width + 1)
                places.setdefault(int(width), []).append(starts)
                owners.setdefault(int(width), []).append(np.full(len(starts), k))
                self.pairs[_pair_slots(ids[a : b - 1], ids[a + 1 : b])] = True
        self.windows = {}
        for width, parts in places.items():
            at = np.concatenate(parts)
            keys = _big_endian(ids, at, width)
            distinct, inverse = np.unique(keys, return_inverse=True)
            order = np.argsort(inverse, kind="stable")
            offsets = np.concatenate(([0], np.cumsum(np.bincount(inverse, minlength=len(distinct)))))
            self.windows[width] = distinct, at[order], np.concatenate(owners[width])[order], offsets


def search(bench: Benchmark, texts: list[bytes | None]) -> tuple[Words, np.ndarray, np.ndarray, np.ndarray]:
    """(words, places, widths, (window numbers, widths)) of all windows in a shard."""
    words = Words(texts)
    at = np.searchsorted(bench.vocabulary, words.hashes)
    at[at == len(bench.vocabulary)] = 0
    ids = np.where(bench.vocabulary[at] == words.hashes, at + 1, 0).astype(np.uint32) if len(bench.vocabulary) else np.zeros(len(words), dtype=np.uint32)
    n = len(ids)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
    if not n:
        empty = np.zeros(0, dtype=np.int64)
        return words, empty, empty, [empty, empty]
    last = np.zeros(n, dtype=bool)
    last[words.bounds[1:][words.bounds[1:] > 0] - 1] = True
    joined = np.zeros(n, dtype=bool)  # this word and the next may stand together in an item
    live = np.nonzero((ids[:-1] > 0) & (ids[1:] > 0) & ~last[:-1])[0]
    joined[live] = bench.pairs[_pair_slots(ids[live], ids[live + 1])]
    breaks = np.concatenate((np.nonzero(~joined)[0], [n]))
    reach = breaks[np.searchsorted(breaks, np.arange(n))] - np.arange(n) + 1  # words from here on without a break
    for width, (windows, places, owners, offsets) in bench.windows.items():
        suffixes = np.nonzero((reach >= width) & (ids > 0))[0]
        if not len(suffixes):
            continue
        keys = _big_endian(ids, suffixes, width)
        order = np.argsort(keys, kind="stable")
        array = keys[order]
        low, high = np.searchsorted(array, windows, "left"), np.searchsorted(array, windows, "right")
        hit = np.nonzero(high > low)[0]
        counts = high[hit] - low[hit]
        inside = np.repeat(low[hit] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
        found.append((suffixes[order[inside]], np.full(len(inside), width), np.repeat(hit, counts)))
    if not found:
        empty = np.zeros(0, dtype=np.int64)
        return words, empty, empty, [empty, empty]
    place, length = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
    return words, place, length, [np.concatenate([f[2] for f in found]), length]


RESULT = StructType(
    [
        StructField("n_words", LongType()),
        StructField("starts", ArrayType(LongType())),
        StructField("ends", ArrayType(LongType())),
        StructField("items", ArrayType(StringType())),
        StructField("longest_match", LongType()),
    ]
)


def _longest(bench: Benchmark, place: np.ndarray, window: np.ndarray, width: np.ndarray) -> np.ndarray:
    """For each hit the words of the longest verbatim match that it begins."""
    best = np.zeros(len(place), dtype=np.int64)
    for w, (_, places, owners, offsets) in bench.windows.items():
        own = np.nonzero(width == w)[0]
        if not len(own):
            continue
        counts = offsets[window[own] + 1] - offsets[window[own]]
        source = np.repeat(own, counts)
        at = np.repeat(offsets[window[own]] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
        diagonal = place[source] - places[at]
        order = np.lexsort((place[source], owners[at], diagonal))
        p, d, o = place[source][order], diagonal[order], owners[at][order]
        new = np.concatenate(([True], (p[1:] != p[:-1] + 1) | (d[1:] != d[:-1]) | (o[1:] != o[:-1])))
        run = np.nonzero(new)[0]
        sizes = np.diff(np.concatenate((run, [len(p)])))
        np.maximum.at(best, source[order][run], sizes + w - 1)
    return best


def matches(bench: Benchmark, texts: list[bytes | None]) -> list[tuple]:
    """A row of ``RESULT`` for each text: merged stretches of hit words, the items
    with a window in it, and the words of its longest verbatim match."""
    words, place, width, (window, _) = search(bench, texts)
    sizes = np.diff(words.bounds)
    if not len(place):
        return [(int(n), [], [], [], 0) for n in sizes]
    longest = _longest(bench, place, window, width)
    order = np.argsort(place, kind="stable")
    place, width, window, longest = place[order], width[order], window[order], longest[order]
    text = np.searchsorted(words.bounds, place, side="right") - 1
    cuts = np.searchsorted(text, np.arange(len(texts) + 1))
    rows = []
    for i, n in enumerate(sizes.tolist()):
        a, b = cuts[i], cuts[i + 1]
        if a == b:
            rows.append((n, [], [], [], 0))
            continue
        begin, end = place[a:b] - words.bounds[i], place[a:b] - words.bounds[i] + width[a:b]
        far = np.maximum.accumulate(end)
        new = np.nonzero(np.concatenate(([True], begin[1:] > far[:-1])))[0]
        owners: set[str] = set()
        for w in np.unique(width[a:b]).tolist():
            _, _, own, offsets = bench.windows[w]
            for k in np.unique(window[a:b][width[a:b] == w]).tolist():
                owners.update(bench.items[j] for j in own[offsets[k] : offsets[k + 1]].tolist() if bench.items[j] is not None)
        rows.append((n, begin[new].tolist(), np.concatenate((far[new[1:] - 1], far[-1:])).tolist(), sorted(owners), int(longest[a:b].max())))
    return rows


def _blocks(benchmark: DataFrame, item_col: str, text_col: str) -> Iterator[list]:
    """The benchmark's rows in blocks of bounded size, streamed through the driver
    one partition at a time; at least one block, which may be empty."""
    rows = benchmark.select(F.col(item_col).cast("string").alias("i"), text_bytes(F.col(text_col)).alias("t"))
    block, size, given = [], 0, False
    for row in rows.toLocalIterator():
        n = len(row["t"] or b"")
        if block and size + n > BLOCK_BYTES:
            yield block
            block, size, given = [], 0, True
        block.append((row["i"], bytes(row["t"]) if row["t"] is not None else None))
        size += n
    if block or not given:
        yield block


def _finder(sent):
    """A column function from binary text to ``RESULT`` for a broadcast benchmark."""

    @F.pandas_udf(RESULT)
    def found(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for _, part in batched(texts):
            rows += matches(sent.value, part)
        return pd.DataFrame(rows, columns=RESULT.names)

    return found


SUMMARY = StructType(
    [
        StructField("n_words", LongType()),
        StructField("n_hit", LongType()),
        StructField("n_items", LongType()),
        StructField("items_sha256", StringType()),
        StructField("longest_match", LongType()),
    ]
)


def _summed_up(n_words: int, blocks: list) -> tuple:
    """A row of ``SUMMARY`` from what the blocks of a benchmark found in one text."""
    hit, far = 0, 0
    for s, e in sorted((s, e) for b in blocks for s, e in zip(b["starts"], b["ends"])):
        hit += max(0, e - max(s, far))
        far = max(far, e)
    items = sorted({i for b in blocks for i in b["items"]})
    return n_words, hit, len(items), hashlib.sha256(",".join(items).encode()).hexdigest(), max((b["longest_match"] for b in blocks), default=0)


@F.pandas_udf(SUMMARY)
def _summary(found: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame([_summed_up(r["n_words"], [r]) for r in found.to_dict("records")], columns=SUMMARY.names)


@F.pandas_udf(SUMMARY)
def _summary_of_blocks(n_words: pd.Series, found: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([_summed_up(n, list(f) if f is not None else []) for n, f in zip(n_words, found)], columns=SUMMARY.names)


def _by_block(rows: DataFrame, blocks: Iterable[list], row: str, text_col: str, window: int) -> DataFrame:
    """(row, columns of ``RESULT``) of the rows that a block hits, block by block: the
    driver and the executors hold one block at a time and the hits are written."""
    spark, parts = rows.sparkSession, []
    for block in blocks:
        sent = spark.sparkContext.broadcast(Benchmark(block, window))
        found = rows.select(row, _finder(sent)(text_bytes(F.col(text_col))).alias("m")).filter(F.size("m.starts") > 0)
        parts.append(stored(found.select(row, "m.*"), "benchmark-hits"))
        sent.destroy()
    return reduce(DataFrame.unionByName, parts)


def _measured(docs: DataFrame, benchmark: DataFrame, text_col: str, item_col: str, item_text: str, window: int, name: str) -> DataFrame:
    """``docs`` with a column ``name`` of type ``SUMMARY``."""
    small_batches(docs.sparkSession)
    blocks = _blocks(benchmark, item_col, item_text)
    first, second = next(blocks), next(blocks, None)
    if second is None:
        sent = docs.sparkSession.sparkContext.broadcast(Benchmark(first, window))
        return docs.withColumn(name, _summary(_finder(sent)(text_bytes(F.col(text_col)))))
    row = unused(docs, "row")
    rows = stored(docs.withColumn(row, F.monotonically_increasing_id()), "benchmark-docs")
    found = _by_block(rows, chain([first, second], blocks), row, text_col, window)
    # a text's hits: as many as its words and the blocks at most
    grouped = found.groupBy(row).agg(F.collect_list(F.struct("starts", "ends", "items", "longest_match")).alias(name))
    n_words = F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(r"[0-9A-Za-z\x{80}-\x{10FFFF}]+")), F.lit(0)).cast("long")
    return rows.join(grouped, row, "left").withColumn(name, _summary_of_blocks(n_words, F.col(name))).drop(row)


def locate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, starts, ends, items, longest_match): where a text repeats the
    benchmark, in words.

    One row for each row of ``docs`` and block of the benchmark that it meets; rows
    without a match, null and empty texts among them, are left out, and an empty
    table or benchmark gives no rows.  Repeated rows give repeated rows.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return _by_block(rows, _blocks(benchmark, item_col, item_text), "doc_id", "text", window)


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """doc_id, the columns of ``SUMMARY`` and contaminated, a row for each of ``docs``.

    Null and empty texts have no words and no hits; an item without words has no
    window; a null item_id hits but is not counted.  Repeated rows give repeated
    rows; an empty benchmark hits nothing; an empty table gives no rows; other
    columns are not read, so names may clash.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    summed = _measured(rows, benchmark, "text", item_col, item_text, window, "s").select("doc_id", "s.*")
    return summed.withColumn("contaminated", F.col("n_hit") > 0)


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """The rows of ``docs``, all columns, without any window of the benchmark.

    Null and empty texts hold no window and stay; repeated rows stay or go together;
    an empty benchmark removes nothing; an empty table gives an empty one.
    """
    name = unused(docs, "found")
    return _measured(docs, benchmark, text_col, item_col, item_text, window, name).filter(F.col(name)["n_hit"] == 0).drop(name)
