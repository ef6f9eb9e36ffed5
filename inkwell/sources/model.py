"""A small document model and its GitHub-Flavored Markdown."""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass, field


class ConvertError(Exception):
    """code is unsupported, malformed, encrypted, resourceLimit, missingPart or io."""

    def __init__(self, code: str, message: str = ""):
        super().__init__(message or code)
        self.code = code


@dataclass(frozen=True)
class Run:
    text: str
    bold: bool = False
    italic: bool = False
    strike: bool = False
    code: bool = False
    link: str | None = None

    @property
    def style(self) -> tuple:
        return self.bold, self.italic, self.strike, self.code, self.link


@dataclass
class Block:
    """kind is paragraph, heading, item, table, code, quote or rule."""

    kind: str
    runs: list[Run] = field(default_factory=list)
    level: int = 0
    ordered: bool = False
    number: int = 1
    label: str | None = None
    rows: list[list[str]] = field(default_factory=list)
    header_rows: int = 0
    children: list["Block"] = field(default_factory=list)


def clean(text: str) -> str:
    """The text clean-up that all readers share."""
    text = re.sub(r"\r\n|\r|\n", " ", text.replace(" ", " "))
    return "".join(c for c in text if c not in "­​﻿" and (c == "\t" or unicodedata.category(c) != "Cc"))


_ENTITY = re.compile(r"&(?:#[0-9]+;|#[xX][0-9a-fA-F]+;|[A-Za-z][A-Za-z0-9]*;)")


def escape(text: str, start: bool = False, label: bool = False, cell: bool = False, styled: bool = False, closing: bool = False) -> str:
    """Markdown's signs escaped where they would be read as such.

    start: the text begins a line; label: inside a link's brackets; styled: inside
    delimiters; closing: another styled run follows.
    """
    last = {c: text.rfind(c) for c in "*_~`]"}
    out: list[str] = []
    digits = re.match(r"[0-9]{1,9}(?=[.)](?:\s|$))", text) if start else None
    for i, c in enumerate(text):
        nxt = text[i + 1] if i + 1 < len(text) else ""
        before = text[i - 1] if i else ""
        paired = closing or (c in last and last[c] > i) or (c in "*_~`" and text.find(c) < i)
        begins = start and not text[:i].strip()
        mark = False
        if c == "\\":
            mark = True
        elif c == "]":
            mark = label
        elif c == "`":
            mark = styled or paired
        elif c == "*":
            mark = styled or begins or (bool(nxt.strip()) and paired) or (bool(before.strip()) and text.find("*") < i)
        elif c == "_":
            inner = before.isalnum() and nxt.isalnum()
            mark = styled or (not inner and paired and bool(nxt.strip() or before.strip()))
        elif c == "~":
            mark = styled or (bool(nxt.strip()) and paired)
        elif c == "[":
            mark = label or last["]"] > i
        elif c == "<":
            mark = nxt.isalpha() or nxt in ("/", "!", "?") and nxt != ""
        elif c == "!":
            mark = closing and i + 1 == len(text)
        elif c == "|":
            mark = cell
        elif c == "&" and _ENTITY.match(text, i):
            out.append("&amp;")
            continue
        if begins and not mark:
            mark = (c == "#" and re.match(r"#{1,6}(?:\s|$)", text[i:]) is not None) or (c == "-" and (not nxt.strip() or not text.strip("- "))) or (c == "+" and not nxt.strip()) or c == ">" or (c == "=" and not text.strip("="))
        if digits and i == digits.end():
            mark = True
        out.append("\\" + c if mark else c)
    return "".join(out)


def url(target: str) -> str:
    safe = "".join(f"%{ord(c):02X}" if c in "<>|" or ord(c) < 32 or ord(c) == 127 else c for c in target)
    return f"<{safe}>" if re.search(r"[\s()]", safe) else safe


def fence(text: str, least: int) -> str:
    return "`" * max([least, *[len(r) + 1 for r in re.findall("`+", text)]])


def merged(runs: list[Run]) -> list[Run]:
    """Neighbours of one style joined; blank text between like runs takes theirs."""
    live = [r if r.text.strip() or r.link else Run(r.text) for r in runs if r.text]
    out: list[Run] = []
    for i, r in enumerate(live):
        if not r.text.strip() and out and i + 1 < len(live) and out[-1].style == live[i + 1].style and not r.code and not out[-1].code:
            r = Run(r.text, *out[-1].style)
        if out and out[-1].style == r.style:
            out[-1] = Run(out[-1].text + r.text, *r.style)
        else:
            out.append(r)
    return out


def inline(runs: list[Run], start: bool = True, cell: bool = False) -> str:
    parts: list[str] = []
    joined = merged(runs)
    for i, r in enumerate(joined):
        first = start and not "".join(parts).strip()
        if r.code:
            tick = fence(r.text, 1)
            pad = " " if r.text.startswith("`") or r.text.endswith("`") else ""
            body = f"{tick}{pad}{r.text}{pad}{tick}"
        else:
            core = r.text.strip(" \t")
            styled = r.bold or r.italic or r.strike
            mark = ("~~" if r.strike else "") + ("**" if r.bold else "") + ("*" if r.italic else "")
            inside = escape(core, first and not mark and not r.link, bool(r.link), cell, styled)
            lead, tail = r.text[: len(r.text) - len(r.text.lstrip(" \t"))], r.text[len(r.text.rstrip(" \t")) :] if core else ""
            body = f"{lead}{mark}{inside}{mark[::-1]}{tail}" if core else r.text
        parts.append(f"[{body.strip()}]({url(r.link)})" if r.link and body.strip() else body)
    return "".join(parts)


def _paragraph(text: str) -> str:
    return "\n".join(x.strip() for x in text.split("\n") if x.strip())


def table(rows: list[list[str]], header_rows: int, escaped: bool = False) -> str | None:
    shown = [["<br>".join(p.strip() for p in c.split("\n") if p.strip()) for c in r] for r in rows]
    if not escaped:
        shown = [[escape(c, cell=True) for c in r] for r in shown]
    while shown and not any(shown[-1]):
        shown.pop()
    width = max((i + 1 for r in shown for i, c in enumerate(r) if c), default=0)
    if not width:
        return None
    padded = [(r + [""] * width)[:width] for r in shown]
    head = padded.pop(0) if header_rows else [""] * width
    line = lambda cells: "| " + " | ".join(cells) + " |"
    return "\n".join([line(head), line(["---"] * width), *map(line, padded)])


def _items(blocks: list[Block], at: int, indent: str) -> tuple[str, int]:
    level, out = blocks[at].level, []
    first = blocks[at]
    while at < len(blocks) and blocks[at].kind == "item" and blocks[at].level >= level:
        b = blocks[at]
        if b.level > level:
            inner, at = _items(blocks, at, indent)
            out[-1] = out[-1] + "\n" + inner if out else inner
            continue
        if b.ordered != first.ordered or (b.ordered and out and b.number != blocks[at - 1].number + 1 and blocks[at - 1].level == level):
            break
        marker = f"{b.number}. " if b.ordered else f"- {b.label + ' ' if b.label else ''}"
        text = _paragraph(inline(b.runs))
        body = (marker + text.replace("\n", "\n" + " " * len(marker))).rstrip()
        at += 1
        if at < len(blocks) and blocks[at].kind == "item" and blocks[at].level > level:
            inner, at = _items(blocks, at, "")
            body += "\n" + "\n".join(" " * len(marker if b.ordered else "- ") + x for x in inner.split("\n"))
        out.append(body)
    return "\n".join(out), at


def render(blocks: list[Block]) -> str:
    """Markdown of a document; ends with a line feed unless it is empty."""
    out: list[str] = []
    at = 0
    while at < len(blocks):
        b = blocks[at]
        if b.kind == "item":
            text, at = _items(blocks, at, "")
            out.append(text)
            continue
        at += 1
        if b.kind == "heading":
            text = " ".join(inline(b.runs, start=False).split("\n")).strip()
            text = f"{'#' * min(6, max(1, b.level))} {text}" if text else ""
        elif b.kind == "code":
            raw = "".join(r.text for r in b.runs)
            tick = fence(raw, 3)
            text = f"{tick}\n{raw.rstrip(chr(10))}\n{tick}"
        elif b.kind == "quote":
            text = "\n".join("> " + x if x else ">" for x in render(b.children).rstrip("\n").split("\n")) if b.children else ""
        elif b.kind == "rule":
            text = "---"
        elif b.kind == "table":
            text = table(b.rows, b.header_rows) or ""
        else:
            text = _paragraph(inline(b.runs))
        if text:
            out.append(text)
    return "\n\n".join(out) + "\n" if out else ""


# Header vote over a grid of texts

_NUMBER = re.compile(r"[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?\Z")
_CLOCK = r"\d{1,2}:\d{1,2}(?::\d{1,2}(?:\.\d+)?)?Z?"
_DATE = re.compile(rf"(?:\d{{1,4}}([-/.])\d{{1,4}}\1\d{{1,4}}(?:[T ](?:{_CLOCK})?)?|{_CLOCK})\Z")


def kind_of(value: str) -> str | None:
    t = value.strip()
    bare = re.sub(r"[, _ ]", "", t.removesuffix("%"))
    if not t:
        return None
    if re.search(r"[0-9]", bare) and _NUMBER.match(bare):
        return "number"
    if t.lower() in ("true", "false", "yes", "no"):
        return "bool"
    return "date" if _DATE.match(t) else "text"


def header_rows(rows: list[list[str]], declared: int = 0) -> int:
    """How many rows of a grid are its header; see operators.cells.header_rows."""
    if declared:
        return min(declared, len(rows))
    if len(rows) < 2:
        return 0
    rows = rows[:51]
    widths = [len(r) for r in rows[1:]]
    modal = max(set(widths), key=lambda w: (widths.count(w), w))
    content = max((i + 1 for r in rows for i, c in enumerate(r) if c.strip()), default=0)
    labels = [c.strip() for c in rows[0]]
    wide, labels = len(labels), labels[:content]
    named = [x.lower() for x in labels if x]
    if wide != modal or not content or content > wide or any(not x for x in labels[1:]) or any("\n" in x for x in labels) or len(set(named)) < len(named):
        return 0
    up = down = 0
    for col, label in enumerate(labels):
        values = [r[col] for r in rows[1:] if col < len(r) and r[col].strip()]
        kinds = [kind_of(v) for v in values]
        dominant = next((k for k in ("number", "bool", "date", "text") if values and kinds.count(k) * 10 >= len(values) * 9), None)
        if dominant not in (None, "text"):
            up += kind_of(label) == "text"
            down += kind_of(label) != "text"
        elif any(v.strip().lower() == label.lower() for v in values):
            down += 1
    if up == down == 0:
        return int(all(len(x) <= 64 for x in labels))
    return int(up > down)
