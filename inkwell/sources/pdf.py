"""PDF pages: lines, inspection and relations of what pages show."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .model import Block, ConvertError, Run
from .pdfobjects import Document
from .pdftext import Item, Page, distinct_rects, ocr_reasons, read_page

#: An image of so many pixels or more that is alone on its page is the page.
TEMPLATE_PIXELS = 500_000


def items(document: Document, page: int) -> list[Item]:
    """Visible text of a page in content order."""
    return [i for i in read_page(document, page).items if not i.hidden]


def lines(found: list[Item]) -> list[tuple[int, float, float, str]]:
    """(page, y, size, text): items of like baseline joined from left to right."""
    out: list[tuple[int, float, float, str]] = []
    for page in sorted({i.page for i in found}):
        own = sorted((i for i in found if i.page == page), key=lambda i: (-i.y, i.x))
        groups: list[list[Item]] = []
        for i in own:
            if groups and abs(groups[-1][0].y - i.y) <= 0.3 * max(i.size, 1):
                groups[-1].append(i)
            else:
                groups.append([i])
        for g in groups:
            g.sort(key=lambda i: i.x)
            text, end = "", None
            for i in g:
                text += (" " if end is not None and i.x - end > 0.15 * i.size and not text.endswith(" ") else "") + i.text
                end = i.x + i.width
            out.append((page, g[0].y, g[0].size, text.strip()))
    return out


def page_facts(page: Page) -> dict:
    """What is told of a page before anything is extracted."""
    largest = max((i[4] for i in page.images), default=0)
    return {
        "text_operators": page.counts["text"],
        "path_operators": page.counts["path"],
        "images": page.counts["image"],
        "image_pixels": sum(i[4] for i in page.images),
        "template": page.counts["image"] == 1 and largest >= TEMPLATE_PIXELS,
        "characters": sum(len(i.text.replace(" ", "")) for i in page.items if not i.hidden),
        "ocr_reasons": ocr_reasons(page),
    }


def inspect(data: bytes) -> dict:
    """pages, text_pages, image_pages, kind, confidence and pages that need recognition."""
    d = Document(data)
    facts = [page_facts(read_page(d, p)) for p in range(len(d.pages))]
    n, t, i = max(1, len(facts)), sum(f["characters"] > 0 for f in facts), sum(f["images"] > 0 for f in facts)
    if t / n >= 0.6:
        kind, sure = "text", t / n
    elif not t and i:
        kind, sure = "scanned", 0.95
    elif t and i:
        kind, sure = "mixed", 0.7
    elif not t:
        kind, sure = "scanned", 0.9
    else:
        kind, sure = "text", max(t / n, 0.5)
    return {"pages": len(facts), "text_pages": t, "image_pages": i, "kind": kind, "confidence": sure, "ocr_pages": [p + 1 for p, f in enumerate(facts) if f["ocr_reasons"]]}


ITEMS = "doc_id string, page int, idx int, text string, x double, y double, width double, font_size double, font string, bold boolean, italic boolean, rotated boolean, hidden boolean, mcid int, error string"
RECTS = "doc_id string, page int, idx int, x double, y double, width double, height double, kind string"
SEGMENTS = "doc_id string, page int, idx int, x1 double, y1 double, x2 double, y2 double"
PAGES = "doc_id string, page int, text_operators int, path_operators int, images int, image_pixels long, template boolean, characters int, ocr_reasons array<string>, error string"


def _relation(files: DataFrame, rows_of, schema: str, on_error=None) -> DataFrame:
    """A relation from (path, content): ``rows_of`` gives the rows of a page.  A file
    that can't be read is one row with its error where the relation has a place for it."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                rows: list[tuple] = []
                try:
                    document = Document(content or b"")
                    for page in range(len(document.pages)):
                        rows += [(path, page, *r) for r in rows_of(read_page(document, page))]
                except ConvertError as error:
                    rows = [on_error(path, error.code)] if on_error else []
                if rows:
                    yield pd.DataFrame(rows, columns=names).astype(object)

    return files.select(F.col("path").cast("string").alias("path"), F.col("content").cast("binary").alias("content")).mapInPandas(run, schema)


def pdf_items(files: DataFrame) -> DataFrame:
    """Positioned text of PDF files (path, content), in content order on each page."""
    rows = lambda p: [(i, t.text, t.x, t.y, t.width, t.size, t.font, t.bold, t.italic, t.rotated, t.hidden, t.mcid, None) for i, t in enumerate(p.items)]
    return _relation(files, rows, ITEMS, lambda path, code: (path, *[None] * 13, code))


def pdf_rects(files: DataFrame) -> DataFrame:
    """Rectangles that pages draw or clip by, those of a half-point grid once."""
    return _relation(files, lambda p: [(i, *r) for i, r in enumerate(distinct_rects(p.rects))], RECTS)


def pdf_segments(files: DataFrame) -> DataFrame:
    """Straight pieces of the paths that pages draw."""
    return _relation(files, lambda p: [(i, *s) for i, s in enumerate(p.segments)], SEGMENTS)


def pdf_pages(files: DataFrame) -> DataFrame:
    """Facts of each page, and why its text may need recognition."""
    rows = lambda p: [tuple(page_facts(p).values()) + (None,)]
    return _relation(files, rows, PAGES, lambda path, code: (path, *[None] * 8, code))


def read(data: bytes) -> list[Block]:
    d = Document(data)
    every = [line for p in range(len(d.pages)) for line in lines(items(d, p))]
    sizes: dict[int, int] = {}
    for _, _, size, _ in every:
        if size >= 9:
            sizes[int(size * 10)] = sizes.get(int(size * 10), 0) + 1
    body = min((s for s in sizes if sizes[s] == max(sizes.values())), default=120) / 10
    tiers = sorted({round(s, 1) for _, _, s, t in every if s / body >= 1.2 and any(c.isalpha() for c in t)}, reverse=True)[:4]
    out: list[Block] = []
    last: tuple[int, float] | None = None
    for page, y, size, text in every:
        if round(size, 1) in tiers:
            out.append(Block("heading", [Run(text)], tiers.index(round(size, 1)) + 1))
            last = None
        elif m := re.match(r"[•\-*]\s+(.*)", text):
            out.append(Block("item", [Run(m[1])]))
            last = None
        elif last and last[0] == page and 0 < last[1] - y <= 1.8 * body and out and out[-1].kind == "paragraph":
            before = out[-1].runs[-1].text
            joined = before[:-1] + text if before.endswith("-") and text[:1].islower() else f"{before} {text}"
            out[-1] = Block("paragraph", [Run(joined)])
            last = (page, y)
        else:
            out.append(Block("paragraph", [Run(text)]))
            last = (page, y)
    return out
