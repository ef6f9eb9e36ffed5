"""Tables on pages: from rules, from rectangles, and their Markdown.

``items`` is (doc_id, page, idx, text, x, y, width), ``segments`` (doc_id, page, x1,
y1, x2, y2) and ``rects`` (doc_id, page, x, y, width, height).  What needs a whole
page is a function over one page that runs in a group of (doc_id, page); the rest is
columns and aggregates.  A table is (doc_id, page, table, row, col, text).
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import trim_space

#: Distances in points; fixed values.
RULE_LEAST, RULE_SLOPE, RULE_Y, RULE_JOIN, RULE_SPAN = 20.0, 0.034920770, 2.0, 6.0, 8.0
RULE_SNAP, GRID_SNAP, SLACK, TOUCH = 3.0, 6.0, 2.0, 3.0
CELL_LEAST, WIDE_FACTOR, MANY_RECTS = 5.0, 10.0, 2000
GRID_COLUMNS, RULED_EDGES, CLUSTER_LEAST = 25, (21, 80), 6


# Columns


def is_numbered_caption(c: Column) -> Column:
    """``Table 3``: the second word holds a number besides other signs."""
    return F.lower(trim_space(c)).rlike(r"^table \s*[^0-9\s]*[0-9][^\s]*")


def is_footnote(c: Column) -> Column:
    """``(1) ...``, ``2) ...``, ``Note:`` and ``Notes:``."""
    t = trim_space(c)
    return t.rlike(r"^\([0-9]*\)") | t.rlike(r"^[0-9]+\)") | F.lower(t).rlike("^notes?:")


def rule_kind(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """h or v for a segment of at least 20 points within two degrees of an axis."""
    dx, dy = F.abs(x2 - x1), F.abs(y2 - y1)
    long = F.sqrt(dx * dx + dy * dy) >= RULE_LEAST
    return F.when(long & (dx > 0.01) & (dy <= RULE_SLOPE * dx), "h").when(long & (dy > 0.01) & (dx <= RULE_SLOPE * dy), "v")


def classify_segments(segments: DataFrame) -> DataFrame:
    """(doc_id, page, kind, at, low, high): rules, their place and what they span."""
    kind = rule_kind(*[F.col(c) for c in ("x1", "y1", "x2", "y2")])
    h = F.col("kind") == "h"
    marked = segments.withColumn("kind", kind).filter("kind is not null")
    return marked.select(
        "doc_id",
        "page",
        "kind",
        F.when(h, (F.col("y1") + F.col("y2")) / 2).otherwise((F.col("x1") + F.col("x2")) / 2).alias("at"),
        F.when(h, F.least("x1", "x2")).otherwise(F.least("y1", "y2")).alias("low"),
        F.when(h, F.greatest("x1", "x2")).otherwise(F.greatest("y1", "y2")).alias("high"),
    )


# One page


@dataclass
class Table:
    columns: list[float]
    rows: list[float]
    cells: list[list[str]]
    members: list[int] = field(default_factory=list)  # indices of items

    def evidence(self) -> int:
        """What speaks for a table: its items, its filled cells and its size."""
        filled = sum(bool(c.strip()) for r in self.cells for c in r)
        total = sum(map(len, self.cells))
        return 100 * len(set(self.members)) + 25 * filled + 60 * max((len(r) for r in self.cells), default=0) + 20 * len(self.cells) - 5 * (total - filled)


def snapped(values: list[float], tolerance: float) -> list[float]:
    """Ascending values, each further than the tolerance from the last one kept."""
    out: list[float] = []
    for v in sorted(values):
        if not out or v - out[-1] > tolerance:
            out.append(v)
    return out


def merged_rules(rules: list[tuple[float, float, float]]) -> list[tuple[float, float, float]]:
    """Rules (y, low, high) that were drawn in pieces, from the top: those within two
    points of the first of their row, joined across gaps of six points, at the mean
    height of the row."""
    rows: list[list[tuple[float, float, float]]] = []
    for rule in sorted(rules, key=lambda r: (-r[0], r[1])):
        if rows and rows[-1][0][0] - rule[0] <= RULE_Y:
            rows[-1].append(rule)
        else:
            rows.append([rule])
    out = []
    for row in rows:
        y = sum(r[0] for r in row) / len(row)
        pieces: list[list[float]] = []
        for _, low, high in sorted(row, key=lambda r: r[1]):
            if pieces and low <= pieces[-1][1] + RULE_JOIN:
                pieces[-1][1] = max(pieces[-1][1], high)
            else:
                pieces.append([low, high])
        out += [(y, a, b) for a, b in pieces]
    return sorted(out, key=lambda r: -r[0])


def spans_of(rules: list[tuple[float, float, float]]) -> list[list[tuple[float, float, float]]]:
    """Rules of about the same span, each with the first group that it fits best."""
    groups: list[list[tuple[float, float, float]]] = []
    for rule in rules:
        fits = [(abs(g[0][1] - rule[1]) + abs(g[0][2] - rule[2]), i) for i, g in enumerate(groups) if abs(g[0][1] - rule[1]) <= RULE_SPAN and abs(g[0][2] - rule[2]) <= RULE_SPAN]
        if fits:
            groups[min(fits)[1]].append(rule)
        else:
            groups.append([rule])
    return [sorted(g, key=lambda r: -r[0]) for g in groups]


def in_grid(items: list[tuple], columns: list[float], rows: list[float]) -> tuple[list[list[str]], list[int]]:
    """Texts of the cells between edges, rows from the top, and the items that are in
    one: by the middle of an item's width and its baseline, with two points of slack."""
    cells: list[list[list[tuple]]] = [[[] for _ in columns[1:]] for _ in rows[1:]]
    members = []
    for i, (text, x, y, width) in enumerate(items):
        middle = x + width / 2
        col = next((k for k in range(len(columns) - 1) if columns[k] - SLACK <= middle <= columns[k + 1] + SLACK), None)
        row = next((k for k in range(len(rows) - 1) if rows[k + 1] - SLACK <= y <= rows[k] + SLACK), None)
        if col is not None and row is not None:
            cells[row][col].append((-y, x, text.strip()))
            members.append(i)
    joined = [[" ".join(t for _, _, t in sorted(cell, key=lambda c: c[:2]) if t) for cell in row] for row in cells]
    return [[re.sub(r"(?<=[(\[]) | (?=[)\]])", "", c) for c in row] for row in joined], members


def ruled_table(items: list[tuple], segments: list[tuple]) -> Table | None:
    """The grid of a page's rules, if they make one: at least three horizontal and
    vertical edges, rules that span it, enough of the cells and of the page's text
    filled, and rows that are not evenly spaced like a chart's lines."""
    horizontal, vertical = [], []
    for x1, y1, x2, y2 in segments:
        dx, dy = abs(x2 - x1), abs(y2 - y1)
        if (dx * dx + dy * dy) ** 0.5 < RULE_LEAST:
            continue
        if dx > 0.01 and dy <= RULE_SLOPE * dx:
            horizontal.append(((y1 + y2) / 2, min(x1, x2), max(x1, x2)))
        elif dy > 0.01 and dx <= RULE_SLOPE * dy:
            vertical.append(((x1 + x2) / 2, min(y1, y2), max(y1, y2)))
    if len(horizontal) < 3 or len(vertical) < 2:
        return None
    rows = snapped([h[0] for h in horizontal], RULE_SNAP)[::-1]
    columns = snapped([v[0] for v in vertical], RULE_SNAP)
    if not (3 <= len(columns) <= RULED_EDGES[0] and 3 <= len(rows) <= RULED_EDGES[1]):
        return None
    width, height = columns[-1] - columns[0], rows[0] - rows[-1]
    if width < 50 or height < 20 or (width > 500 and height > 700 and len(horizontal) <= 4 and len(vertical) <= 4):
        return None

    def crossing(rules: list[tuple], share: float, size: float) -> int:
        return sum(high - low > share * size for _, low, high in rules)

    if crossing(horizontal, 0.5, width) < 3 and crossing(horizontal, 0.15, width) < 6:
        return None
    if crossing(vertical, 0.3, height) < 2 and crossing(vertical, 0.1, height) < 4:
        return None
    cells, members = in_grid(items, columns, rows)
    filled = [[bool(c) for c in row] for row in cells]
    total = sum(map(len, filled))
    if sum(any(r) for r in filled) < 2 or sum(map(sum, filled)) < 0.15 * total or sum(any(c) for c in zip(*filled)) < 2:
        return None
    if items and len(members) < 0.2 * len(items):
        return None
    if len(rows) >= 5:
        steps = np.abs(np.diff(rows))
        if steps.mean() > 0.1 and steps.std() / steps.mean() < 0.02:
            return None
    return Table(columns, rows[:-1], cells, members)


Rect = tuple[float, float, float, float]


def prepared_rects(rects: list[Rect]) -> list[Rect]:
    """Rectangles of a cell's size or more, without those over ten times the middle
    width and without shading inside a cell of about its size."""
    kept = []
    for x, y, w, h in rects:
        x, w = (x + w, -w) if w < 0 else (x, w)
        y, h = (y + h, -h) if h < 0 else (y, h)
        if w >= CELL_LEAST and h >= CELL_LEAST:
            kept.append((x, y, w, h))
    if len(kept) < 6:
        return kept
    limit = sorted(r[2] for r in kept)[len(kept) // 2] * WIDE_FACTOR
    kept = [r for r in kept if r[2] <= limit]
    if len(kept) >= MANY_RECTS:
        return kept
    x, y, w, h = np.array(kept, dtype=float).reshape(-1, 4).T

    def shaded(i: int) -> bool:
        around = (w * h > w[i] * h[i] * 1.2) & (h < h[i] * 4) & ~((x < 5) & (y < 5))
        around &= (x <= x[i] + 2) & (x + w >= x[i] + w[i] - 2) & (y <= y[i] + 2) & (y + h >= y[i] + h[i] - 2)
        return bool(around.any())

    return [r for i, r in enumerate(kept) if not shaded(i)]


def rect_clusters(rects: list[Rect], tolerance: float = TOUCH, least: int = CLUSTER_LEAST) -> list[list[int]]:
    """Rectangles that meet, directly or through others, when each grows by the
    tolerance; clusters of ``least`` or more, by a flood over a sorted sweep."""
    if not rects:
        return []
    x, y, w, h = np.array(rects, dtype=float).T
    left, right, low, high = x - tolerance, x + w + tolerance, y - tolerance, y + h + tolerance
    label = np.full(len(rects), -1)
    for start in range(len(rects)):
        if label[start] >= 0:
            continue
        label[start], todo = start, [start]
        while todo:
            i = todo.pop()
            near = np.nonzero((label < 0) & (left <= right[i]) & (right >= left[i]) & (low <= high[i]) & (high >= low[i]))[0]
            label[near] = start
            todo += near.tolist()
    found = [np.nonzero(label == k)[0].tolist() for k in np.unique(label)]
    return [c for c in found if len(c) >= least]


def split_cluster(rects: list[Rect], gap: float, least: int) -> tuple[list[Rect], list[Rect]] | None:
    """Both sides of the widest empty band, if it is wide and they are large enough."""
    if len(rects) < 2 * least:
        return None
    ends: list[list[float]] = []
    for a, b in sorted((x, x + w) for x, _, w, _ in rects):
        if ends and a <= ends[-1][1] + 1:
            ends[-1][1] = max(ends[-1][1], b)
        else:
            ends.append([a, b])
    gaps = [(b[0] - a[1], (a[1] + b[0]) / 2) for a, b in zip(ends, ends[1:])]
    if not gaps or max(g for g, _ in gaps) < gap:
        return None
    cut = max(gaps, key=lambda g: g[0])[1]
    sides = [r for r in rects if r[0] + r[2] / 2 < cut], [r for r in rects if r[0] + r[2] / 2 >= cut]
    return sides if min(map(len, sides)) >= least else None


def gathered_spans(cells: list[list[str]], columns: list[float], rows: list[float], rects: list[Rect]) -> list[list[str]]:
    """Cells where the text under a rectangle that spans several rows of a column
    stands in the first of them."""
    out = [list(r) for r in cells]
    for col in range(len(columns) - 1):
        for x, y, w, h in rects:
            if x > columns[col] + GRID_SNAP or x + w < columns[col + 1] - GRID_SNAP:
                continue
            over = [r for r in range(len(rows) - 1) if min(rows[r], y + h) - max(rows[r + 1], y) > GRID_SNAP]
            if len(over) > 1:
                first, last = over[0], over[-1]
                out[first][col] = " ".join(t for t in (out[r][col].strip() for r in range(first, last + 1)) if t)
                for r in range(first + 1, last + 1):
                    out[r][col] = ""
    return out


def rect_table(items: list[tuple], rects: list[Rect]) -> Table | None:
    """The grid of a cluster of rectangles, if they cover three tenths of its cells, a
    quarter of them has text, and no column inside is blank."""
    columns = snapped([v for x, _, w, _ in rects for v in (x, x + w)], GRID_SNAP)
    rows = snapped([v for _, y, _, h in rects for v in (y, y + h)], GRID_SNAP)[::-1]
    wide, tall = len(columns) - 1, len(rows) - 1
    if not 2 <= wide <= GRID_COLUMNS or tall < 3:
        return None
    x, y, w, h = np.array(rects, dtype=float).T
    covered = sum(bool(((x <= columns[c] + GRID_SNAP) & (x + w >= columns[c + 1] - GRID_SNAP) & (y <= rows[r] + GRID_SNAP) & (y + h >= rows[r + 1] - GRID_SNAP)).any()) for r in range(tall) for c in range(wide))
    if covered < 0.3 * wide * tall:
        return None
    cells, members = in_grid(items, columns, rows)
    if wide <= 10:
        cells = gathered_spans(cells, columns, rows, rects)
    filled = [[bool(c.strip()) for c in row] for row in cells]
    if not members or sum(map(any, filled)) < 2 or sum(map(sum, filled)) < 0.25 * wide * tall:
        return None
    used = [c for c in range(wide) if any(row[c] for row in filled)]
    if len(used) < 2 or len(used) != used[-1] - used[0] + 1:
        return None
    middles = [(a + b) / 2 for a, b in zip(columns, columns[1:])][used[0] : used[-1] + 1]
    return Table(middles, [(a + b) / 2 for a, b in zip(rows, rows[1:])], [row[used[0] : used[-1] + 1] for row in cells], members)


def best_tables(candidates: list[Table]) -> list[Table]:
    """The tables with most evidence that share no item, in their first order."""
    chosen: list[int] = []
    taken: set[int] = set()
    for i in sorted(range(len(candidates)), key=lambda i: (-candidates[i].evidence(), i)):
        if not taken & set(candidates[i].members):
            chosen.append(i)
            taken |= set(candidates[i].members)
    return [candidates[i] for i in sorted(chosen)]


def page_tables(items: list[tuple], rects: list[Rect], segments: list[tuple]) -> list[Table]:
    """Tables of a page: clusters of rectangles first, then the rules around the items
    that are left."""
    usable = prepared_rects(rects)
    found = []
    for cluster in rect_clusters(usable):
        own = [usable[i] for i in cluster]
        whole = rect_table(items, own)
        halves = None if whole else split_cluster(own, 20.0, CLUSTER_LEAST)
        found += [t for t in ([whole] if whole else [rect_table(items, s) for s in halves or ()]) if t]
    found = best_tables(found)
    taken = {i for t in found for i in t.members}
    rest = [i for i in range(len(items)) if i not in taken]
    ruled = ruled_table([items[i] for i in rest], segments)
    if ruled:
        ruled.members = [rest[i] for i in ruled.members]
        found.append(ruled)
    return found


# Markdown

_LABEL = re.compile(r"^[0-9]{1,3}(\.[0-9]{1,3})*[.):]?\s")


def _capital(text: str) -> bool:
    letter = next((c for c in text if c.isalpha()), "")
    return letter.isupper()


def joined_rows(cells: list[list[str]]) -> tuple[list[list[str]], list[str]]:
    """(rows, footnotes): blank rows left out, footnotes apart, and rows that go on
    from the one before added to its cells.

    A row goes on if its first cell is blank and the others are neither one short
    word nor mostly numbers nor all capitalised, or if it has fewer cells than the
    header and the row before and starts no entry of its own.
    """
    out: list[list[str]] = []
    notes: list[str] = []
    for raw in cells:
        row = [c.strip() for c in raw]
        if not any(row):
            continue
        if re.match(r"\([0-9]*\)|[0-9]+\)", row[0]) or re.match("notes?:", row[0].lower()):
            notes.append(" ".join(c for c in row if c))
            continue
        later = [c for c in row[1:] if c]
        filled = sum(map(bool, row))
        short = len(later) == 1 and len(later[0].encode()) <= 5
        numeric = sum(bool(re.fullmatch("[0-9., -]+", c)) for c in later)
        data = len(later) >= 2 and sum(len(c.encode()) for c in later) <= 10 * len(later) and 2 * numeric > len(later)
        spanning = not row[0] and len(row) >= 4 and len(later) == len(row) - 1 and sum(map(_capital, later)) >= len(later) - 1
        entry = next((c for c in row if c), "")
        own = not row[0] and len(row) > 1 and bool(row[1]) and (_capital(entry) or bool(_LABEL.match(entry + " "))) and len(later) >= 2 and any(map(_capital, later[1:]))
        head = sum(map(bool, out[0])) if out else len(row)
        most = head // 2 if head >= 5 else head - 1
        before = sum(map(bool, out[-1])) if out else 0
        starts = bool(row[0]) and (_capital(row[0]) or bool(_LABEL.match(row[0] + " ")))
        blank_start = not row[0] and later and not short and not data and not spanning and not own
        fewer = bool(row[0]) and filled <= most and before > filled and not data and not starts
        if len(out) > 1 and (blank_start or fewer):
            for i, c in enumerate(row[: len(out[-1])]):
                if c:
                    out[-1][i] = f"{out[-1][i]} {c}".strip()
        else:
            out.append(row)
    return out, notes


def contents_list(cells: list[list[str]]) -> bool:
    """Whether a table is a list of contents: two columns or more, of which the last
    holds rising page numbers in seven of ten rows."""
    rows = [r for r in cells if any(c.strip() for c in r)]
    if len(rows) < 3:
        return False
    pages = [int(r[-1]) for r in rows if re.fullmatch("[0-9]{1,4}", r[-1].strip())]
    titled = sum(any(re.search("[A-Za-z]{2}", c) for c in r[:-1]) for r in rows)
    rising = all(a <= b for a, b in zip(pages, pages[1:]))
    return len(pages) >= 0.7 * len(rows) and titled >= 0.7 * len(rows) and rising and len(pages) >= 3


def table_markdown(cells: list[list[str]]) -> str:
    """``|a|b|`` lines with a rule below the first, footnotes after a blank line; a
    list of contents as its titles and pages."""
    if not cells or not cells[0]:
        return ""
    if contents_list(cells):
        rows = [[c.strip() for c in r if c.strip()] for r in cells]
        return "".join(" ".join(r[:-1]) + ("\t" if re.fullmatch("[0-9]+", r[-1]) and len(r) > 1 else " " if len(r) > 1 else "") + r[-1] + "\n" for r in rows if r)
    rows, notes = joined_rows(cells)
    if not rows:
        return ""
    lines = ["|" + "".join(c + "|" for c in r) for r in rows]
    lines.insert(1, "|" + "---|" * len(rows[0]))
    return "\n".join(lines) + "\n" + ("\n" + "".join(n + "\n" for n in notes) if notes else "")


# Relations


def _pages(items: DataFrame, other: DataFrame, columns: list[str]) -> DataFrame:
    """(doc_id, page, items, others): arrays in order of idx."""
    own = items.groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(F.struct("idx", "text", "x", "y", "width"))).alias("items"))
    there = other.groupBy("doc_id", "page").agg(F.collect_list(F.struct(*[F.col(c).cast("double").alias(c) for c in columns])).alias("others"))
    return own.join(there, ["doc_id", "page"])


def _found(pages: DataFrame, detect: Callable[[list[tuple], list[tuple]], list[Table]], columns: list[str]) -> DataFrame:
    kind = pages.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, page int, table int, columns int, rows int, cells array<array<string>>, members array<long>, markdown string"

    def run(batches):
        for batch in batches:
            rows = []
            for doc, page, items, others in zip(batch["doc_id"], batch["page"], batch["items"], batch["others"]):
                texts = [(i["text"] or "", i["x"], i["y"], i["width"]) for i in items]
                for n, t in enumerate(detect(texts, [tuple(o[c] for c in columns) for o in others])):
                    rows.append((doc, page, n, max(map(len, t.cells), default=0), len(t.cells), t.cells, [int(items[i]["idx"]) for i in t.members], table_markdown(t.cells)))
            yield pd.DataFrame(rows, columns=["doc_id", "page", "table", "columns", "rows", "cells", "members", "markdown"])

    return pages.mapInPandas(run, schema)


def rect_tables(items: DataFrame, rects: DataFrame) -> DataFrame:
    """(doc_id, page, table, columns, rows, cells, members, markdown) from rectangles."""
    sides = ["x", "y", "width", "height"]
    return _found(_pages(items, rects, sides), lambda texts, own: page_tables(texts, own, []), sides)


def ruled_tables(items: DataFrame, segments: DataFrame) -> DataFrame:
    """The same from rules."""
    ends = ["x1", "y1", "x2", "y2"]
    return _found(_pages(items, segments, ends), lambda texts, own: page_tables(texts, [], own), ends)
