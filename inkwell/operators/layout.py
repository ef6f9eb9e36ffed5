"""Positioned text: lines, columns, cuts, tiers, table grids.

``items`` is (doc_id, page, idx, text, x, y, width, font_size, bold).  A page is
small, so what has to be folded in order runs a page at a time; everything else is
columns, windows and aggregates.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx

BASELINE, BIN, GUTTER, MARGIN = 3.0, 2.0, 8.0, 0.05
SIDE_ITEMS, NOISE, VERTICAL, WIDE = 10, 0.15, 0.30, 0.60
CUT_GAP, CUT_SIDES = 15.0, (10, 3)
TIER_RATIO, BOLD_RATIO, TIER_WIDTH, TIERS = 1.2, 1.05, 0.5, 4
EDGE_SNAP = 6.0


def _by_page(items: DataFrame, fold, schema: str) -> DataFrame:
    kind = items.schema["doc_id"].dataType.simpleString()
    return items.groupBy("doc_id", "page").applyInPandas(fold, f"doc_id {kind}, page int, {schema}")


def needs_space(gap: Column, size: Column, left: Column, right: Column) -> Column:
    """Whether two runs on a line are two words: by the gap in ems and by what
    stands on either side."""
    em = gap / size
    digits = left.rlike("[0-9]$") & right.rlike("^[0-9.,]")
    closing = right.rlike(r"^[.,;!?)\]}']")
    single = (F.length(left) == 1) | (F.length(right) == 1)
    small = left.rlike("[a-z]$") & right.rlike("^[a-z]")
    limit = F.when(digits, 0.30).when(single, 0.20).when(small, 0.18).otherwise(0.15)
    return ~left.rlike(r"\s$") & ~right.rlike(r"^\s") & F.when(closing, F.lit(False)).when((em > 3) | (em < -1), F.lit(True)).otherwise(em >= limit)


def by_page(items: DataFrame) -> DataFrame:
    """(doc_id, page, items): the items of each page as an array of structs."""
    return items.groupBy("doc_id", "page").agg(F.collect_list(F.struct("idx", "text", "x", "y", "width", "font_size", "bold")).alias("items"))


def _line_numbers(depths: Column) -> Column:
    """For depths in ascending order, the number of the line that each stands on."""
    start = F.struct(F.lit(None).cast("double").alias("first"), F.array().cast("array<int>").alias("lines"))

    def place(seen: Column, depth: Column) -> Column:
        new = seen["first"].isNull() | (depth - seen["first"] >= BASELINE)
        line = F.when(seen["first"].isNull(), 0).otherwise(F.element_at(seen["lines"], -1) + new.cast("int"))
        return F.struct(F.when(new, depth).otherwise(seen["first"]).alias("first"), F.concat(seen["lines"], F.array(line)).alias("lines"))

    return F.aggregate(depths, start, place, lambda seen: seen["lines"])


def _page_lines(items: Column) -> Column:
    """An array of lines from the top, each an array of its items from left to right."""
    depth = lambda i: -i["y"].cast("double")

    def number(depths: Column) -> Column:
        placed = lambda lines: F.transform(items, lambda i: F.struct(F.get(lines, (F.array_position(depths, depth(i)) - 1).cast("int")).alias("line"), i["x"].alias("x"), i["idx"].alias("idx"), i.alias("item")))
        return tx.let(_line_numbers(depths), placed)

    def cut(sorted_items: Column) -> Column:
        begins = lambda k: (k == 0) | ~F.get(sorted_items, k)["line"].eqNullSafe(F.get(sorted_items, k - 1)["line"])
        starts = F.filter(F.sequence(F.lit(0), F.size(sorted_items) - 1), begins)
        line = lambda s: lambda k, j: F.transform(F.slice(sorted_items, k + 1, F.coalesce(F.get(s, j + 1), F.size(sorted_items)) - k), lambda p: p["item"])
        return tx.let(starts, lambda s: F.transform(s, line(s)))

    numbered = tx.let(F.array_sort(F.array_distinct(F.transform(items, depth))), number)
    return F.when(F.size(items) > 0, tx.let(F.array_sort(numbered), cut))


def group_lines(pages: DataFrame, parted: Callable[[Column, Column, Column, Column], Column] = needs_space) -> DataFrame:
    """(doc_id, page, line, y, x, font_size, bold, text): items from top to bottom,
    a line holding those less than 3 points below its first one.

    ``pages`` is as of ``by_page``, a row for each page; ``parted`` tells by gap, size
    and both texts whether a blank stands between two items.
    """
    own = F.col("items")

    def spaced(item: Column, k: Column) -> Column:
        before = F.get(own, k - 1)
        apart = parted(item["x"] - (before["x"] + before["width"]), item["font_size"], before["text"], item["text"])
        return F.when((k > 0) & apart, F.concat(F.lit(" "), item["text"])).otherwise(item["text"])

    letters = lambda array: F.aggregate(array, F.lit(0), lambda n, i: n + F.length(i["text"]))
    lines = pages.select("doc_id", "page", F.posexplode(_page_lines(own)).alias("line", "items"))
    return lines.select(
        "doc_id", "page", "line", F.array_max(F.transform(own, lambda i: i["y"])).alias("y"), F.get(own, F.lit(0))["x"].alias("x"), F.get(own, F.lit(0))["font_size"].alias("font_size"),
        (letters(F.filter(own, lambda i: i["bold"])) * 2 >= letters(own)).alias("bold"), F.array_join(F.transform(own, spaced), "").alias("text"),
    )


def x_histogram(items: DataFrame) -> DataFrame:
    """(doc_id, page, bin, n): how many items cover each 2-point bin of a page."""
    first, last = F.floor(F.col("x") / BIN), F.floor((F.col("x") + F.col("width")) / BIN)
    return items.select("doc_id", "page", F.explode(F.sequence(first, F.greatest(first, last))).alias("bin")).groupBy("doc_id", "page", "bin").agg(F.count("*").alias("n"))


def column_gutters(items: DataFrame) -> DataFrame:
    """(doc_id, page, gutters): middles of the valleys that part a page's columns.

    A valley of the histogram is at least 8 points wide, at most 15 in 100 of the
    peak, off the margins, and has ten items and three tenths of the height on both
    sides.  Items wider than six tenths of the page do not count.
    """

    def fold(frame: pd.DataFrame) -> pd.DataFrame:
        x, right, y = frame["x"].to_numpy(float), (frame["x"] + frame["width"]).to_numpy(float), frame["y"].to_numpy(float)
        low, high = x.min(), right.max()
        found: list[float] = []
        if high - low >= 200 and len(x) >= 20:
            narrow = right - x <= WIDE * (high - low)
            bins = np.zeros(int((high - low) / BIN) + 2, dtype=int)
            for a, b in zip(((x[narrow] - low) / BIN).astype(int), ((right[narrow] - low) / BIN).astype(int)):
                bins[a : b + 1] += 1
            empty = np.concatenate(([False], bins <= int(bins.max() * NOISE), [False]))
            edges = np.nonzero(empty[1:] != empty[:-1])[0]
            height = max(y.max() - y.min(), 1e-9)
            for a, b in zip(edges[::2], edges[1::2]):
                middle = low + (a + b) / 2 * BIN
                if (b - a) * BIN < GUTTER or not low + MARGIN * (high - low) < middle < high - MARGIN * (high - low):
                    continue
                centre = (x + right) / 2
                sides = [narrow & (centre < middle), narrow & (centre >= middle)]
                if all(s.sum() >= SIDE_ITEMS and (y[s].max() - y[s].min()) / height >= VERTICAL for s in sides):
                    found.append(float(middle))
        return pd.DataFrame({"doc_id": [frame["doc_id"].iloc[0]], "page": [int(frame["page"].iloc[0])], "gutters": [found]})

    return _by_page(items.select("doc_id", F.col("page").cast("int").alias("page"), "x", "y", "width"), fold, "gutters array<double>")


def in_columns(items: DataFrame, gutters: DataFrame) -> DataFrame:
    """Adds column: how many gutters lie left of an item's middle."""
    middle = F.col("x") + F.col("width") / 2
    joined = items.join(gutters, ["doc_id", "page"], "left")
    return joined.withColumn("column", F.coalesce(F.size(F.filter("gutters", lambda g: g <= middle)), F.lit(0))).drop("gutters")


def widest_cut(items: DataFrame) -> DataFrame:
    """(doc_id, page, cut): the middle of the widest horizontal gap of 15 points or
    more with ten items on one side and three on the other, if there is one."""
    page = Window.partitionBy("doc_id", "page")
    order = page.orderBy("x", "idx")
    reach = F.max(F.col("x") + F.col("width")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = items.select("doc_id", "page", "x", "idx", (F.col("x") - reach).alias("gap"), ((F.col("x") + reach) / 2).alias("cut"), (F.row_number().over(order) - 1).alias("before"), F.count("*").over(page).alias("n"))
    after = F.col("n") - F.col("before")
    fit = marked.filter((F.col("gap") >= CUT_GAP) & (F.greatest("before", after) >= CUT_SIDES[0]) & (F.least("before", after) >= CUT_SIDES[1]))
    return fit.groupBy("doc_id", "page").agg(F.max_by("cut", "gap").alias("cut"))


def side_by_side(items: DataFrame) -> DataFrame:
    """(doc_id, page, split) of pages that are two pages next to each other: at least
    40 items and one gap of 30 points between sorted starts in the middle."""
    order = Window.partitionBy("doc_id", "page").orderBy("x", "idx")
    page = Window.partitionBy("doc_id", "page")
    seen = items.select("doc_id", "page", "x", "idx", "width", F.lag("x").over(order).alias("last"), F.row_number().over(order).alias("k"), F.count("*").over(page).alias("n"), F.min("x").over(page).alias("low"), F.max("x").over(page).alias("high"))
    span = F.col("high") - F.col("low")
    gaps = seen.filter((F.col("n") >= 40) & (F.col("x") - F.col("last") >= 30) & (F.col("last") >= F.col("low") + span * 0.2) & (F.col("x") <= F.col("high") - span * 0.2) & (F.col("k") - 1 >= 20) & (F.col("n") - F.col("k") + 1 >= 20))
    single = gaps.groupBy("doc_id", "page").agg(F.count("*").alias("gaps"), F.max((F.col("x") + F.col("last")) / 2).alias("split"), F.max("n").alias("n")).filter("gaps = 1")
    crossing = items.join(single, ["doc_id", "page"]).groupBy("doc_id", "page", "split", "n").agg(F.sum(((F.col("x") < F.col("split")) & (F.col("x") + F.col("width") > F.col("split"))).cast("int")).alias("crossings"))
    return crossing.filter(F.col("crossings") <= F.greatest(F.floor(F.col("n") / 20), F.lit(2))).select("doc_id", "page", "split")


def heading_tiers(lines: DataFrame, body: DataFrame) -> DataFrame:
    """(doc_id, tiers): up to four sizes of lettered lines from 1.2 of the body size
    on, largest first, those within half a point as one; bold lines from 1.05 on if
    there are none."""
    sized = lines.filter(F.col("text").rlike(r"\p{L}")).join(body, "doc_id").select("doc_id", "font_size", "bold", (F.col("font_size") / F.col("body")).alias("ratio"))
    large = F.collect_set(F.when(F.col("ratio") >= TIER_RATIO, F.col("font_size")))
    strong = F.collect_set(F.when((F.col("ratio") >= BOLD_RATIO) & F.col("bold"), F.col("font_size")))
    sets = sized.groupBy("doc_id").agg(large.alias("a"), strong.alias("b"))
    chosen = F.sort_array(F.when(F.size("a") > 0, F.col("a")).otherwise(F.col("b")), asc=False)
    kept = F.aggregate(chosen, F.array().cast("array<double>"), lambda acc, s: F.when((F.size(acc) > 0) & (F.element_at(acc, -1) - s <= TIER_WIDTH), acc).otherwise(F.concat(acc, F.array(s.cast("double")))))
    return sets.select("doc_id", F.slice(kept, 1, TIERS).alias("tiers"))


def isolated_lines(lines: DataFrame, gap: Column) -> DataFrame:
    """Lines of one to six words with more than ``gap`` above and below; pages where
    they are over a quarter of at least ten lines have none."""
    order = Window.partitionBy("doc_id", "page").orderBy(F.desc("y"), "line")
    above, below = F.lag("y").over(order) - F.col("y"), F.col("y") - F.lead("y").over(order)
    alone = F.coalesce(above > gap, F.lit(True)) & F.coalesce(below > gap, F.lit(True)) & F.size(F.split(F.trim("text"), r"\s+")).between(1, 6) & (F.octet_length(F.trim("text")) > 3)
    page = Window.partitionBy("doc_id", "page")
    marked = lines.withColumn("__alone", alone).withColumns({"__n": F.count("*").over(page), "__k": F.sum(F.col("__alone").cast("int")).over(page)})
    return marked.filter(F.col("__alone") & ((F.col("__n") < 10) | (F.col("__k") <= F.col("__n") * 0.25))).drop("__alone", "__n", "__k")


def snapped(positions: Column, tolerance: float) -> Column:
    """An array of structs (position, n): values in ascending order, each within the
    tolerance of the last one kept counted with it."""
    start = F.array().cast("array<struct<position:double,n:bigint>>")

    def keep(kept: Column, value: Column) -> Column:
        last = F.element_at(kept, -1)
        joins = (F.size(kept) > 0) & (value - last["position"] <= tolerance)
        grown = F.concat(F.slice(kept, 1, F.size(kept) - 1), F.array(F.struct(last["position"].alias("position"), (last["n"] + 1).alias("n"))))
        return F.when(joins, grown).otherwise(F.concat(kept, F.array(F.struct(value.alias("position"), F.lit(1).cast("long").alias("n")))))

    return F.aggregate(F.array_sort(positions), start, keep)


def snap_edges(edges: DataFrame, tolerance: float = EDGE_SNAP) -> DataFrame:
    """(doc_id, page, axis, position, n): rules' positions in ascending order; those
    within the tolerance of the last position kept count with it.

    The comparison is with the lowest of a group and not with the neighbour, so an
    even chain of close positions keeps several edges.
    """
    positions = edges.groupBy("doc_id", "page", "axis").agg(F.collect_list(F.col("position").cast("double")).alias("p"))
    kept = positions.select("doc_id", "page", "axis", F.explode(snapped(F.col("p"), tolerance)).alias("s"))
    return kept.select("doc_id", "page", "axis", "s.position", "s.n")


def assign_to_grid(items: DataFrame, edges: DataFrame) -> DataFrame:
    """(doc_id, page, row, col, text): items in the cells between snapped edges, rows
    from the top; items outside the grid are left out."""
    xs = edges.filter("axis = 'x'").groupBy("doc_id", "page").agg(F.array_sort(F.collect_list("position")).alias("xs"))
    ys = edges.filter("axis = 'y'").groupBy("doc_id", "page").agg(F.sort_array(F.collect_list("position"), asc=False).alias("ys"))
    middle = F.col("x") + F.col("width") / 2
    placed = items.join(xs, ["doc_id", "page"]).join(ys, ["doc_id", "page"])
    placed = placed.select("doc_id", "page", "text", "x", "idx", (F.size(F.filter("xs", lambda e: e <= middle)) - 1).alias("col"), (F.size(F.filter("ys", lambda e: e >= F.col("y"))) - 1).alias("row"), (F.size("xs") - 1).alias("cols"), (F.size("ys") - 1).alias("rows"))
    inside = placed.filter("col >= 0 and row >= 0 and col < cols and row < rows")
    parts = F.array_sort(F.collect_list(F.struct("x", "idx", "text")))
    return inside.groupBy("doc_id", "page", "row", "col").agg(F.array_join(F.transform(parts, lambda p: p["text"]), " ").alias("text"))


def place_spans(cells: DataFrame) -> DataFrame:
    """Adds col: where each origin stands once the spans before it are laid out.

    ``cells`` is (table_id, row, seq, col_span, row_span), in order of seq within a
    row; spans are cut where an earlier one lies, and every place has one owner.
    """

    def fold(frame: pd.DataFrame) -> pd.DataFrame:
        taken: set[tuple[int, int]] = set()
        out = []
        for row, group in frame.sort_values(["row", "seq"]).groupby("row", sort=True):
            at = 0
            for seq, wide, tall in zip(group["seq"], group["col_span"], group["row_span"]):
                while (row, at) in taken:
                    at += 1
                wide = next((d for d in range(1, max(int(wide), 1)) if (row, at + d) in taken), max(int(wide), 1))
                tall = next((d for d in range(1, max(int(tall), 1)) if any((row + d, at + k) in taken for k in range(wide))), max(int(tall), 1))
                taken.update((row + d, at + k) for d in range(tall) for k in range(wide))
                out.append((frame["table_id"].iloc[0], row, seq, at, wide, tall))
                at += wide
        return pd.DataFrame(out, columns=["table_id", "row", "seq", "col", "col_span", "row_span"])

    kind = cells.schema["table_id"].dataType.simpleString()
    return cells.select("table_id", "row", "seq", "col_span", "row_span").groupBy("table_id").applyInPandas(fold, f"table_id {kind}, row int, seq int, col int, col_span int, row_span int")
