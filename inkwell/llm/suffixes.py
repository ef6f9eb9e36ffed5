"""Repeated passages by sparse suffix arrays.

Of each text only the suffixes at minimisers are kept: words whose 5-gram hash is
the least of some ``spread`` neighbours.  A passage of ``min_words`` words chooses
the same places wherever it stands, and the first of them has at least
``min_words - spread + 1`` words of the passage to its right.  The suffixes of all
texts are sorted by a key of that prefix, so that equal ones stand together, and
neighbours are compared: keys that one text alone has are dropped.  The others
extend to the right (a window of ``min_words`` from the minimiser on) and, where
some member of a group does not, or begins a match, all of the group extend to the
left as well, window by window, up to ``spread`` words.  Windows are sorted and
compared in the same way, told apart by 128 bits.  A word is repeated if a window
over it occurs in another text.

The sorted order also goes by text and place, so a passage that a third of all texts
share is dealt to many tasks and never gathered.  Texts equal in full are one class.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import dropped, small_batches, stored, text_bytes
from .words import Words, batched, mix, rolled, rolled_again

MIN_WORDS = 50
SPREAD = 24
GRAM = 5


def _slide(values: np.ndarray, width: int, best: np.ufunc) -> np.ndarray:
    """``best`` of each ``width`` neighbours, by doubling."""
    out, size, done, power = None, 1, 0, values
    while True:
        if width & size:
            out = power if out is None else best(out[: len(power) - done], power[done : done + len(out)])
            done += size
        if done == width:
            return out
        power = best(power[:-size], power[size:])
        size *= 2


def minimisers(hashes: np.ndarray, spread: int = SPREAD) -> np.ndarray:
    """Places of the words of one text whose 5-gram is a minimum; ties are kept."""
    keys = mix(rolled(hashes, GRAM))
    if len(keys) < spread:
        return np.zeros(0, dtype=np.int64)
    least = _slide(keys, spread, np.minimum)
    # a place is chosen if it equals the largest of the minima of windows over it
    padded = np.concatenate((np.zeros(spread - 1, dtype=np.uint64), least, np.zeros(spread - 1, dtype=np.uint64)))
    return np.nonzero(_slide(padded, spread, np.maximum)[: len(keys)] == keys)[0]


#: k is a key of the prefix, f1 and f2 are the window from the place on (zeros where
#: the text ends before); a place below zero holds the number of words instead.
SUFFIXES = "k long, cls long, pos int, f1 long, f2 long"


def _suffixes(min_words: int, spread: int):
    prefix = min_words - spread + 1

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            classes = batch["cls"].to_numpy()
            for first, texts in batched(batch["text"]):
                words = Words(texts)
                short, full, again = rolled(words.hashes, prefix), rolled(words.hashes, min_words), rolled_again(words.hashes, min_words)
                for i in range(len(texts)):
                    a, b = words.bounds[i], words.bounds[i + 1]
                    if b - a < min_words:
                        continue
                    at = minimisers(words.hashes[a:b], spread)
                    at = at[at + prefix <= b - a]
                    fits = a + at[at + min_words <= b - a]
                    windows = np.zeros((2, len(at) + 1), dtype=np.uint64)
                    windows[:, : len(fits)] = full[fits], again[fits]
                    keys = np.append(short[a + at], np.uint64(0))
                    yield pd.DataFrame({"k": keys.view(np.int64), "cls": classes[first + i], "pos": np.append(at, a - b - 1), "f1": windows[0].view(np.int64), "f2": windows[1].view(np.int64)})

    return run


def _gathered(run):
    """Joins the small frames of ``run`` to larger ones."""

    def joined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for frame in run(batches):
            held.append(frame)
            size += len(frame)
            if size > 50_000:
                yield pd.concat(held, ignore_index=True)
                held, size = [], 0
        if held:
            yield pd.concat(held, ignore_index=True)

    return joined


def _ladder(min_words: int, spread: int):
    """Windows that begin up to ``spread`` - 1 words before the given places."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            classes, places = batch["cls"].to_numpy(), batch["places"].tolist()
            for first, texts in batched(batch["text"]):
                words = Words(texts)
                full, again = rolled(words.hashes, min_words), rolled_again(words.hashes, min_words)
                for i in range(len(texts)):
                    a, b = words.bounds[i], words.bounds[i + 1]
                    begins = np.unique(np.asarray(places[first + i], dtype=np.int64)[:, None] - np.arange(spread))
                    begins = begins[(begins >= 0) & (begins + min_words <= b - a)]
                    if len(begins):
                        yield pd.DataFrame({"cls": classes[first + i], "pos": begins, "f1": full[a + begins].view(np.int64), "f2": again[a + begins].view(np.int64)})

    return run


#: What a sorted row is: of one class alone, of several, not known since its key may
#: go on in another task, or the summary of such a key (classes from cls to hi).
ALONE, SHARED, UNKNOWN, BORDER = range(4)


def _compared(key: list[str], keep_alone: bool):
    """Rows in the order of key, cls and pos with their state; copies are dropped.

    A key's rows are held until a second class is met, so at most those of one text.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: pd.DataFrame | None = None  # rows of the last key, all of one class
        shared: tuple | None = None  # the last key, if it is shared, and its classes
        leading = True  # no key has ended so far

        def marked(frame: pd.DataFrame, state, hi=0) -> pd.DataFrame:
            return frame.assign(hi=hi, state=state)

        def border(row: pd.DataFrame, lo: int, hi: int) -> pd.DataFrame:
            return marked(row.assign(cls=lo, pos=-1), BORDER, hi)

        last: pd.DataFrame | None = None
        for batch in batches:
            frame = batch if held is None else pd.concat([held, batch], ignore_index=True)
            if not len(frame):
                continue
            keys, cls, pos = [frame[c].to_numpy() for c in key], frame["cls"].to_numpy(), frame["pos"].to_numpy()
            same = np.logical_and.reduce([k[1:] == k[:-1] for k in keys])
            new = np.concatenate(([True], ~(same & (cls[1:] == cls[:-1]) & (pos[1:] == pos[:-1]))))
            if shared is not None:  # the last row has gone out already
                new[0] = any(frame[c].iloc[0] != last[c].iloc[0] for c in (*key, "cls", "pos"))
            if not new.any():
                continue
            if not new.all():
                frame = frame[new].reset_index(drop=True)
                keys, cls = [k[new] for k in keys], cls[new]
                same = np.logical_and.reduce([k[1:] == k[:-1] for k in keys])
            first = np.nonzero(np.concatenate(([True], ~same)))[0]
            lo, hi = np.minimum.reduceat(cls, first), np.maximum.reduceat(cls, first)
            if shared is not None:
                if all(k[0] == s for k, s in zip(keys, shared[0])):
                    lo[0], hi[0] = min(lo[0], shared[1]), max(hi[0], shared[2])
                elif leading:
                    yield border(last, shared[1], shared[2])
                    leading = False
            several = lo != hi
            state = several.astype(np.int64)
            if leading and len(first) > 1:
                yield border(frame.iloc[:1], int(lo[0]), int(hi[0]))
                if not several[0]:
                    state[0] = UNKNOWN
                leading = False
            if several[-1]:
                held, shared = None, (tuple(k[-1] for k in keys), int(lo[-1]), int(hi[-1]))
                last = frame.iloc[-1:]
            else:
                held, shared = frame.iloc[first[-1] :], None
                state[-1] = -1
            rows = np.repeat(state, np.diff(np.append(first, len(frame))))
            out = rows >= (ALONE if keep_alone else SHARED)
            if out.any():
                yield marked(frame[out], rows[out])
        if held is not None:
            yield border(held.iloc[:1], int(held["cls"].iloc[0]), int(held["cls"].iloc[0]))
            yield marked(held, UNKNOWN)
        elif shared is not None:
            yield border(last, shared[1], shared[2])

    return run


def neighbours(rows: DataFrame, key: list[str], keep_alone: bool = False) -> DataFrame:
    """``rows`` (with cls and pos) and ``both``, whether another class has the key too,
    by sorting and comparing neighbours; others are left out unless ``keep_alone``.
    Repeated rows count once."""
    order = [*key, "cls", "pos"]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    schema = ", ".join(f"{n} {t}" for n, t in rows.dtypes) + ", hi bigint, state int"
    marked = stored(dealt.mapInPandas(_compared(key, keep_alone), schema), "suffixes-sorted")
    # one or two rows a task: keys that go on in the next one
    ends = marked.filter(F.col("state") == BORDER).groupBy(*key).agg(F.min("cls").alias("lo"), F.max("hi").alias("up")).filter("lo <> up")
    sure = marked.filter(F.col("state") < UNKNOWN).withColumn("both", F.col("state") == SHARED)
    open_ = marked.filter(F.col("state") == UNKNOWN).join(F.broadcast(ends.select(*key, F.lit(True).alias("both"))), key, "left")
    every = sure.select(*rows.columns, "both").unionByName(open_.select(*rows.columns, F.coalesce("both", F.lit(False)).alias("both")))
    every._inkwell_path = marked._inkwell_path
    return every if keep_alone else _like(every.filter("both"), marked)


def _like(df: DataFrame, table: DataFrame) -> DataFrame:
    """``df``, which ``dropped`` removes with the table that it reads."""
    df._inkwell_path = table._inkwell_path
    return df


def repeated_windows(docs: DataFrame, text_col: str, min_words: int, spread: int) -> tuple[DataFrame, DataFrame]:
    """((cls, pos, f1, f2) of windows that another class has too, (cls, n_words))."""
    small_batches(docs.sparkSession)
    texts = docs.filter(F.col(text_col).isNotNull()).select(F.xxhash64(F.col(text_col)).alias("cls"), text_bytes(F.col(text_col)).alias("text"))
    rows = stored(texts.mapInPandas(_gathered(_suffixes(min_words, spread)), SUFFIXES), "suffixes")
    sizes = stored(rows.filter("pos < 0").select("cls", (-1 - F.col("pos")).alias("n_words")).distinct(), "suffixes-sizes")
    met = neighbours(rows.filter("pos >= 0"), ["k"])
    dropped(rows)
    # right: the whole window from the place on
    whole = "f1 <> 0 or f2 <> 0"
    right = neighbours(met.drop("both").filter(whole), ["f1", "f2"], keep_alone=True)
    held = right.unionByName(met.filter(f"not ({whole})").drop("both").withColumn("both", F.lit(False)))
    order = Window.partitionBy("cls").orderBy("pos")
    covered = F.coalesce(F.lag("both").over(order) & (F.lag("pos").over(order) >= F.col("pos") - min_words), F.lit(False))
    marked = stored(held.withColumn("open", ~F.col("both") | ~covered), "suffixes-marked")
    for gone in (met, right):
        dropped(gone)
    # left: one key a group that has an open end; all of the group go up the ladder.
    # What the joins look up is written first, so that they can split a hot key
    ends = stored(marked.filter("open").select("k").distinct(), "suffixes-ends")
    climbers = stored(marked.join(ends, "k", "left_semi").groupBy("cls").agg(F.collect_list("pos").alias("places")), "suffixes-climbers")
    steps = stored(texts.join(climbers, "cls").mapInPandas(_gathered(_ladder(min_words, spread)), "cls long, pos int, f1 long, f2 long"), "suffixes-ladder")
    found = neighbours(steps, ["f1", "f2"])
    windows = found.drop("both").unionByName(marked.filter("both").select("cls", "pos", "f1", "f2"))
    out = stored(windows.distinct(), "suffixes-windows")
    for gone in (marked, ends, climbers, steps, found):
        dropped(gone)
    return out, sizes


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, spread: int = SPREAD) -> DataFrame:
    """One row for each row of ``docs`` that holds a repeated passage:
    (doc_id, class_id, n_words, n_repeated, spans, first_docs).

    class_id is the least id of the texts equal in full; spans are "start:end" in
    words, merged and comma-joined; first_docs lists, for the windows found, the
    least id that has them.  Texts of fewer than ``min_words`` words, null and
    empty ones never appear, nor does a passage that one text alone repeats; a
    text with copies is repeated from end to end.  Repeated rows count as copies.
    An empty table gives no rows; other columns are not read.
    """
    windows, sizes = repeated_windows(docs, text_col, min_words, spread)
    named = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("cls")).filter(F.col(text_col).isNotNull())
    classes = named.groupBy("cls").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("copies"))
    known = stored(sizes.join(classes, "cls"), "suffixes-classes")
    placed = stored(windows.join(known.select("cls", "class_id"), "cls"), "suffixes-placed")
    firsts = stored(placed.groupBy("f1", "f2").agg(F.min("class_id").alias("first_doc")), "suffixes-firsts")
    order = Window.partitionBy("cls").orderBy("pos")
    new = F.coalesce((F.col("pos") > F.lag("pos").over(order) + min_words).cast("int"), F.lit(1))
    spans = windows.withColumn("new", new).select("cls", "pos", F.sum("new").over(order).alias("run"))
    merged = spans.groupBy("cls", "run").agg(F.min("pos").alias("a"), (F.max("pos") + min_words).alias("b"))
    lists = merged.groupBy("cls").agg(F.sum(F.col("b") - F.col("a")).alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("a", "b"))), lambda s: F.concat(s["a"].cast("string"), F.lit(":"), s["b"].cast("string"))), ",").alias("spans"))
    sources = placed.join(firsts, ["f1", "f2"]).select("cls", "first_doc").distinct().groupBy("cls").agg(F.array_sort(F.collect_list("first_doc")).alias("first_docs"))
    by_class = known.join(lists, "cls", "left").join(sources, "cls", "left").filter("copies > 1 or n is not null")
    whole = F.col("copies") > 1
    result = by_class.select(
        "cls",
        "class_id",
        F.col("n_words").cast("long").alias("n_words"),
        F.when(whole, F.col("n_words")).otherwise(F.col("n")).cast("long").alias("n_repeated"),
        F.when(whole, F.concat(F.lit("0:"), F.col("n_words").cast("string"))).otherwise(F.col("spans")).alias("spans"),
        F.coalesce("first_docs", F.array("class_id")).alias("first_docs"),
    )
    result = stored(result, "suffixes-result")
    for gone in (windows, sizes, known, placed, firsts):
        dropped(gone)
    return named.join(result, "cls").drop("cls")
