"""Zip packages: Word, Excel, PowerPoint, OpenDocument and EPUB."""

from __future__ import annotations

import datetime
import io
import posixpath
import re
import zipfile
from urllib.parse import unquote
from xml.etree import ElementTree as ET

from . import html
from .model import Block, ConvertError, Run, clean, header_rows

ENTRY_BYTES, ARCHIVE_BYTES, ENTRIES = 128 << 20, 512 << 20, 100_000
#: Cells that spans and repeats may expand to.
EXPANSION = 4_000_000


class Package:
    """Parts of an archive by name, with limits on what is unpacked."""

    def __init__(self, data: bytes):
        try:
            self.zip = zipfile.ZipFile(io.BytesIO(data))
        except (zipfile.BadZipFile, ValueError, OSError) as e:
            raise ConvertError("malformed", f"not a zip archive: {e}") from e
        if len(self.zip.namelist()) > ENTRIES:
            raise ConvertError("resourceLimit", "too many entries")
        self.names = {n.lower(): n for n in self.zip.namelist()}
        self.read_bytes = 0

    def has(self, name: str) -> bool:
        return name.lower() in self.names

    def get(self, name: str) -> bytes:
        if not self.has(name):
            raise ConvertError("missingPart", name)
        info = self.zip.getinfo(self.names[name.lower()])
        if info.flag_bits & 1:
            raise ConvertError("encrypted", name)
        self.read_bytes += info.file_size
        if info.file_size > ENTRY_BYTES or self.read_bytes > ARCHIVE_BYTES:
            raise ConvertError("resourceLimit", name)
        try:
            return self.zip.read(info)
        except (zipfile.BadZipFile, OSError, EOFError, NotImplementedError) as e:
            raise ConvertError("malformed", f"{name}: {e}") from e

    def xml(self, name: str) -> ET.Element:
        data = self.get(name)
        if b"<!ENTITY" in data:
            raise ConvertError("malformed", f"{name}: entity declaration")
        try:
            return ET.fromstring(data)
        except ET.ParseError as e:
            raise ConvertError("malformed", f"{name}: {e}") from e

    def relations(self, part: str) -> dict[str, str]:
        """Target of each relation id of a part; external ones as they are."""
        folder, name = posixpath.split(part)
        path = f"{folder}/_rels/{name}.rels".lstrip("/")
        if not self.has(path):
            return {}
        out = {}
        for r in self.xml(path):
            target = r.get("Target", "")
            if r.get("TargetMode") != "External":
                target = posixpath.normpath(posixpath.join("/" if target.startswith("/") else folder, target)).lstrip("/")
            out[r.get("Id", "")] = target
        return out


def local(e: ET.Element) -> str:
    return e.tag.rpartition("}")[2] if isinstance(e.tag, str) else ""


def attribute(e: ET.Element | None, name: str) -> str | None:
    if e is None:
        return None
    return next((v for k, v in e.attrib.items() if k.rpartition("}")[2] == name), None)


def child(e: ET.Element | None, *path: str) -> ET.Element | None:
    for name in path:
        e = next((c for c in e if local(c) == name), None) if e is not None else None
    return e


def every(e: ET.Element, name: str) -> list[ET.Element]:
    return [c for c in e.iter() if local(c) == name]


def grid_block(rows: list[list[str]], declared: int = 0) -> list[Block]:
    return [Block("table", rows=rows, header_rows=header_rows(rows, declared))] if any(c.strip() for r in rows for c in r) else []


# Word


def _on(properties: ET.Element | None, name: str) -> bool:
    e = child(properties, name)
    return e is not None and attribute(e, "val") not in ("0", "false", "off", "none")


class Word:
    def __init__(self, package: Package):
        self.package = package
        main = next((t for t in package.relations("").values() if t.endswith("document.xml")), "word/document.xml")
        self.main = main if package.has(main) else "word/document.xml"
        self.links = package.relations(self.main)
        folder = posixpath.dirname(self.main)
        self.styles = self._styles(f"{folder}/styles.xml")
        self.formats = self._numbering(f"{folder}/numbering.xml")
        self.counters: dict[tuple[str, int], int] = {}
        self.notes: list[tuple[str, str]] = []

    def _styles(self, part: str) -> dict[str, dict]:
        out: dict[str, dict] = {}
        for s in every(self.package.xml(part), "style") if self.package.has(part) else []:
            name = (attribute(child(s, "name"), "val") or "").lower()
            level = re.fullmatch(r"heading ([1-9])", name)
            outline = attribute(child(s, "pPr", "outlineLvl"), "val")
            run = child(s, "rPr")
            out[attribute(s, "styleId") or ""] = {
                "level": int(level[1]) if level else 1 if name == "title" else int(outline) + 1 if outline and outline.isdigit() and int(outline) < 9 else 0,
                "based": attribute(child(s, "basedOn"), "val"),
                "bold": _on(run, "b"), "italic": _on(run, "i"), "strike": _on(run, "strike"),
                "num": child(s, "pPr", "numPr"), "quote": "quote" in name,
            }
        return out

    def _style(self, name: str | None, key: str):
        for _ in range(20):
            own = self.styles.get(name or "")
            if not own:
                return None
            if own[key]:
                return own[key]
            name = own["based"]
        return None

    def _numbering(self, part: str) -> dict[str, dict[int, tuple[str, int]]]:
        if not self.package.has(part):
            return {}
        root = self.package.xml(part)
        abstract = {attribute(a, "abstractNumId"): {int(attribute(v, "ilvl") or 0): (attribute(child(v, "numFmt"), "val") or "decimal", int(attribute(child(v, "start"), "val") or 1)) for v in a if local(v) == "lvl"} for a in root if local(a) == "abstractNum"}
        return {attribute(n, "numId") or "": abstract.get(attribute(child(n, "abstractNumId"), "val"), {}) for n in root if local(n) == "num"}

    def runs(self, paragraph: ET.Element, base: str | None, link: str | None = None) -> list[Run]:
        out: list[Run] = []
        for e in paragraph:
            name = local(e)
            if name == "hyperlink":
                target = self.links.get(attribute(e, "id") or "")
                out += self.runs(e, base, target or link)
            elif name in ("ins", "smartTag", "sdt", "sdtContent", "fldSimple", "moveTo"):
                out += self.runs(e, base, link)
            elif name == "r":
                own = child(e, "rPr")
                style = attribute(child(own, "rStyle"), "val")
                on = {k: _on(own, t) if child(own, t) is not None else bool(self._style(style, k)) for k, t in (("bold", "b"), ("italic", "i"), ("strike", "strike"))}
                if _on(own, "vanish"):
                    continue
                for c in e:
                    kind = local(c)
                    if kind == "t":
                        out.append(Run(clean(c.text or ""), **on, link=link))
                    elif kind == "tab":
                        out.append(Run("\t", link=link))
                    elif kind in ("br", "cr") and attribute(c, "type") != "page":
                        out.append(Run("\n"))
                    elif kind == "noBreakHyphen":
                        out.append(Run("-", **on, link=link))
                    elif kind in ("footnoteReference", "endnoteReference"):
                        self.notes.append((kind.removesuffix("Reference") + "s", attribute(c, "id") or ""))
                        out.append(Run(f"[^{len(self.notes)}]"))
        return out

    def blocks(self, body: ET.Element) -> list[Block]:
        out: list[Block] = []
        for e in body:
            name = local(e)
            if name == "p":
                own = child(e, "pPr")
                style = attribute(child(own, "pStyle"), "val")
                runs = self.runs(e, style)
                number = child(own, "numPr")
                number = number if number is not None else self._style(style, "num")
                outline = attribute(child(own, "outlineLvl"), "val")
                level = int(outline) + 1 if outline and outline.isdigit() and int(outline) < 9 else self._style(style, "level") or 0
                num, depth = attribute(child(number, "numId"), "val"), int(attribute(child(number, "ilvl"), "val") or 0)
                if not any(r.text.strip() for r in runs):
                    continue
                if level:
                    out.append(Block("heading", [Run(r.text, False, r.italic, r.strike, r.code, r.link) for r in runs], level))
                elif num and num != "0" and num in self.formats:
                    kind, start = self.formats[num].get(depth, ("bullet", 1))
                    self.counters[num, depth] = self.counters.get((num, depth), start - 1) + 1
                    for deeper in [k for k in self.counters if k[0] == num and k[1] > depth]:
                        del self.counters[deeper]
                    out.append(Block("item", runs, depth, kind == "decimal", self.counters[num, depth]))
                elif self._style(style, "quote"):
                    out.append(Block("quote", children=[Block("paragraph", runs)]))
                else:
                    out.append(Block("paragraph", runs))
            elif name == "tbl":
                rows, declared = [], 0
                for tr in (x for x in e if local(x) == "tr"):
                    row: list[str] = []
                    for tc in (x for x in tr if local(x) == "tc"):
                        props = child(tc, "tcPr")
                        span = int(attribute(child(props, "gridSpan"), "val") or 1)
                        merge = child(props, "vMerge")
                        text = "" if merge is not None and attribute(merge, "val") != "restart" else "\n".join("".join(r.text for r in b.runs) for b in self.blocks(tc))
                        row += [text, *[""] * (min(span, 1000) - 1)]
                    declared += _on(child(tr, "trPr"), "tblHeader") and declared == len(rows)
                    rows.append(row)
                out += grid_block(rows, declared)
            elif name in ("sdt", "sdtContent", "ins", "customXml"):
                out += self.blocks(e)
        return out

    def read(self) -> list[Block]:
        body = child(self.package.xml(self.main), "body")
        if body is None:
            raise ConvertError("malformed", "no body")
        out = self.blocks(body)
        for i, (kind, key) in enumerate(self.notes, 1):
            part = f"{posixpath.dirname(self.main)}/{kind}.xml"
            note = next((n for n in self.package.xml(part) if attribute(n, "id") == key), None) if self.package.has(part) else None
            text = " ".join("".join(r.text for r in b.runs).strip() for b in self.blocks(note)) if note is not None else ""
            out.append(Block("note", [Run(text)], i))
        return out


# Excel

BUILT_IN_DATES = {*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)}


def format_class(code: str) -> str:
    """timeDelta, dateTime or other for a number format; its first section counts."""
    bare = re.sub(r'[_\\*].|"[^"]*"?', "", code).split(";")[0].lower()
    if re.search(r"\A[^dmhys]*\[(?:h+|m+|s+)\]", bare):
        return "timeDelta"
    return "dateTime" if re.search(r"[dmhys]|a[pm/]", re.sub(r"\[[^\]]*\]", "", bare)) else "other"


def serial_text(value: float, kind: str, date1904: bool = False) -> str:
    seconds = round(value * 86400)
    if kind == "timeDelta":
        return f"{seconds // 3600}:{seconds // 60 % 60:02}:{seconds % 60:02}"
    if abs(value) < 1:
        return f"{seconds // 3600 % 24:02}:{seconds // 60 % 60:02}:{seconds % 60:02}"
    days = value + (1462 if date1904 else 0)
    try:
        when = datetime.datetime(1899, 12, 30) + datetime.timedelta(milliseconds=round((days + (1 if days < 60 else 0)) * 86_400_000))
    except OverflowError:
        return number_text(value)
    return when.strftime("%Y-%m-%d %H:%M:%S").removesuffix(" 00:00:00")


def number_text(value: float) -> str:
    """Fifteen significant digits, without an exponent."""
    text = f"{value:.15g}"
    return format(float(text), "f").rstrip("0").rstrip(".") if "e" in text else text


def column_number(reference: str) -> int:
    n = 0
    for c in reference:
        if not c.isalpha():
            break
        n = n * 26 + ord(c.upper()) - 64
    return n


def read_xlsx(package: Package) -> list[Block]:
    book = package.xml("xl/workbook.xml")
    links = package.relations("xl/workbook.xml")
    shared = ["".join(t.text or "" for t in every(s, "t")) for s in package.xml("xl/sharedStrings.xml")] if package.has("xl/sharedStrings.xml") else []
    classes: list[str] = []
    if package.has("xl/styles.xml"):
        styles = package.xml("xl/styles.xml")
        custom = {int(attribute(f, "numFmtId") or 0): attribute(f, "formatCode") or "" for f in every(styles, "numFmt")}
        for xf in child(styles, "cellXfs") if child(styles, "cellXfs") is not None else []:
            n = int(attribute(xf, "numFmtId") or 0)
            classes.append(format_class(custom[n]) if n in custom else "timeDelta" if n == 46 else "dateTime" if n in BUILT_IN_DATES else "other")
    date1904 = attribute(child(book, "workbookPr"), "date1904") in ("1", "true")
    out: list[Block] = []
    sheets = every(book, "sheet")
    for sheet in sheets:
        part = links.get(attribute(sheet, "id") or "")
        if not part or not package.has(part):
            continue
        cells: dict[tuple[int, int], str] = {}
        row_at = 0
        for row in every(package.xml(part), "row"):
            row_at = int(attribute(row, "r") or row_at + 1)
            col = 0
            for c in (x for x in row if local(x) == "c"):
                col = column_number(attribute(c, "r") or "") or col + 1
                kind, v = attribute(c, "t") or "n", child(c, "v")
                raw = v.text if v is not None and v.text else ""
                if kind == "s":
                    text = shared[int(raw)] if raw.isdigit() and int(raw) < len(shared) else ""
                elif kind == "inlineStr":
                    text = "".join(t.text or "" for t in every(c, "t"))
                elif kind == "b":
                    text = "TRUE" if raw == "1" else "FALSE"
                elif kind == "n" and raw:
                    style = int(attribute(c, "s") or 0)
                    shape = classes[style] if style < len(classes) else "other"
                    try:
                        text = number_text(float(raw)) if shape == "other" else serial_text(float(raw), shape, date1904)
                    except ValueError:
                        text = raw
                else:
                    text = raw
                if text.strip():
                    cells[row_at, col] = text.replace("\r\n", "\n")
        if not cells:
            continue
        top, left = min(r for r, _ in cells), min(c for _, c in cells)
        height, width = max(r for r, _ in cells) - top + 1, max(c for _, c in cells) - left + 1
        if height * width > EXPANSION:
            raise ConvertError("resourceLimit", "sheet too large")
        rows = [[cells.get((top + r, left + c), "") for c in range(width)] for r in range(height)]
        if len(sheets) > 1:
            out.append(Block("heading", [Run(attribute(sheet, "name") or "")], 2))
        out += grid_block(rows)
    return out


# PowerPoint


def read_pptx(package: Package) -> list[Block]:
    show = package.xml("ppt/presentation.xml")
    links = package.relations("ppt/presentation.xml")
    out: list[Block] = []
    for slide in every(show, "sldId"):
        part = links.get(next((v for k, v in slide.attrib.items() if k.endswith("}id")), ""))
        if not part or not package.has(part):
            continue
        root, targets = package.xml(part), package.relations(part)
        if attribute(root, "show") == "0":
            continue
        for shape in [e for e in root.iter() if local(e) in ("sp", "graphicFrame")]:
            if local(shape) == "graphicFrame":
                rows = [["\n".join("".join(t.text or "" for t in every(p, "t")) for p in every(tc, "p")).strip() for tc in tr if local(tc) == "tc"] for tr in every(shape, "tr")]
                out += grid_block(rows, 1 if any(attribute(t, "firstRow") == "1" for t in every(shape, "tblPr")) else 0)
                continue
            holder = next(iter(every(shape, "ph")), None)
            kind = attribute(holder, "type") if holder is not None else None
            if kind in ("dt", "ftr", "sldNum"):
                continue
            for p in every(shape, "p"):
                runs = []
                for r in p:
                    props = child(r, "rPr")
                    if local(r) in ("r", "fld"):
                        link = targets.get(attribute(child(props, "hlinkClick"), "id") or "")
                        runs.append(Run(clean("".join(t.text or "" for t in every(r, "t"))), attribute(props, "b") == "1", attribute(props, "i") == "1", attribute(props, "strike") not in (None, "noStrike"), link=link))
                    elif local(r) == "br":
                        runs.append(Run("\n"))
                if not any(r.text.strip() for r in runs):
                    continue
                own = child(p, "pPr")
                level = int(attribute(own, "lvl") or 0)
                if kind in ("title", "ctrTitle"):
                    out.append(Block("heading", [Run(r.text, False, r.italic, r.strike, link=r.link) for r in runs], 2))
                elif child(own, "buAutoNum") is not None:
                    last = out[-1] if out else None
                    out.append(Block("item", runs, level, True, last.number + 1 if last and last.kind == "item" and last.ordered and last.level == level else 1))
                elif child(own, "buNone") is None and (child(own, "buChar") is not None or (holder is not None and kind in (None, "body", "obj"))):
                    out.append(Block("item", runs, level))
                else:
                    out.append(Block("paragraph", runs))
    return out


# OpenDocument


def _odf_text(e: ET.Element, styles: dict[str, dict], base: dict, link: str | None = None) -> list[Run]:
    out = [Run(re.sub(r"[ \t\r\n]+", " ", e.text or ""), **base, link=link)] if e.text else []
    for c in e:
        name = local(c)
        if name == "s":
            out.append(Run(" " * min(int(attribute(c, "c") or 1), 1000), **base, link=link))
        elif name == "tab":
            out.append(Run("\t"))
        elif name == "line-break":
            out.append(Run("\n"))
        elif name == "a":
            out += _odf_text(c, styles, base, attribute(c, "href"))
        elif name == "span":
            own = styles.get(attribute(c, "style-name") or "", {})
            out += _odf_text(c, styles, {k: own.get(k, base[k]) for k in base}, link)
        elif name not in ("note", "annotation", "bookmark", "tracked-changes"):
            out += _odf_text(c, styles, base, link)
        if c.tail:
            out.append(Run(re.sub(r"[ \t\r\n]+", " ", c.tail), **base, link=link))
    return out


def read_odf(package: Package) -> list[Block]:
    root = package.xml("content.xml")
    styles: dict[str, dict] = {}
    ordered: set[str] = set()
    for part in [root, *([package.xml("styles.xml")] if package.has("styles.xml") else [])]:
        for s in every(part, "style"):
            text = child(s, "text-properties")
            own = {}
            if attribute(text, "font-weight"):
                own["bold"] = attribute(text, "font-weight") in ("bold", "600", "700", "800", "900")
            if attribute(text, "font-style"):
                own["italic"] = attribute(text, "font-style") != "normal"
            if attribute(text, "text-line-through-style"):
                own["strike"] = attribute(text, "text-line-through-style") != "none"
            styles[attribute(s, "name") or ""] = own
        for s in every(part, "list-style"):
            first = next(iter(s), None)
            if first is not None and local(first) == "list-level-style-number":
                ordered.add(attribute(s, "name") or "")
    plain = {"bold": False, "italic": False, "strike": False}

    def cell_text(c: ET.Element) -> str:
        return "\n".join("".join(r.text for r in _odf_text(p, styles, plain)) for p in c if local(p) in ("p", "h"))

    def rows_of(t: ET.Element, out: list[tuple[list[str], bool]], head: bool = False, blank: list[int] | None = None) -> list[tuple[list[str], bool]]:
        # blank rows are written when a row with content follows
        blank = [0] if blank is None else blank
        for e in t:
            if local(e) == "table-row":
                row: list[str] = []
                for c in e:
                    if local(c) in ("table-cell", "covered-table-cell"):
                        times = min(int(attribute(c, "number-columns-repeated") or 1), 16384)
                        text = cell_text(c) if local(c) == "table-cell" else ""
                        row += [text] * times
                while row and not row[-1]:  # blank cells up to the sheet's edge
                    row.pop()
                times = int(attribute(e, "number-rows-repeated") or 1)
                if not row:
                    blank[0] += times
                    continue
                if sum(len(r) or 1 for r, _ in out) + len(row) * times + blank[0] > EXPANSION:
                    raise ConvertError("resourceLimit", "repeated rows")
                out += [([], head)] * blank[0] + [(list(row), head)] * times
                blank[0] = 0
            elif local(e) in ("table-header-rows", "table-rows", "table-row-group"):
                rows_of(e, out, head or local(e) == "table-header-rows", blank)
        return out

    def blocks(parent: ET.Element, depth: int = -1, numbered: bool = False) -> list[Block]:
        out: list[Block] = []
        for e in parent:
            name = local(e)
            if name in ("p", "h"):
                own = styles.get(attribute(e, "style-name") or "", {})
                runs = _odf_text(e, styles, plain | own)
                if not any(r.text.strip() for r in runs):
                    continue
                if name == "h":
                    out.append(Block("heading", [Run(r.text, False, r.italic, r.strike, link=r.link) for r in runs], int(attribute(e, "outline-level") or 1)))
                else:
                    out.append(Block("paragraph", runs))
            elif name == "list":
                own_style = attribute(e, "style-name")
                kind = own_style in ordered if own_style else numbered
                number = 0
                for item in (x for x in e if local(x) in ("list-item", "list-header")):
                    first = True
                    for b in blocks(item, depth + 1, kind):
                        if b.kind == "paragraph" and first:
                            number += 1
                            out.append(Block("item", b.runs, depth + 1, kind, number))
                            first = False
                        else:
                            out.append(b)
            elif name == "table":
                rows = rows_of(e, [])
                while rows and not any(rows[-1][0]):
                    rows.pop()
                many = sum(1 for x in parent if local(x) == "table") > 1
                if many and local(parent) == "spreadsheet" and rows:
                    out.append(Block("heading", [Run(attribute(e, "name") or "")], 2))
                width = max((i + 1 for r, _ in rows for i, c in enumerate(r) if c), default=0)
                out += grid_block([(r + [""] * width)[:width] for r, _ in rows], sum(h for _, h in rows))
            elif name in ("section", "frame", "text-box", "page", "custom-shape", "g", "text", "spreadsheet", "presentation", "body", "index-body"):
                out += blocks(e, depth, numbered)
        return out

    body = child(root, "body")
    if body is None:
        raise ConvertError("malformed", "no body")
    return blocks(body)


def read_epub(package: Package) -> list[Block]:
    container = package.xml("META-INF/container.xml")
    book = next((attribute(r, "full-path") for r in every(container, "rootfile")), None)
    if not book:
        raise ConvertError("missingPart", "rootfile")
    root, folder = package.xml(book), posixpath.dirname(book)
    items = {attribute(i, "id"): i for i in every(root, "item")}
    out: list[Block] = []
    for ref in every(root, "itemref"):
        item = items.get(attribute(ref, "idref"))
        path = posixpath.normpath(posixpath.join(folder, unquote(attribute(item, "href") or ""))) if item is not None else ""
        if item is not None and "html" in (attribute(item, "media-type") or "") and package.has(path):
            out += html.read(package.get(path))
    return out
