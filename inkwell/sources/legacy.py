"""Compound files: Word 97 text, Excel 97 sheets and PowerPoint 97 slides."""

from __future__ import annotations

import re
import struct

from .model import Block, ConvertError, Run, clean, header_rows
from .packages import BUILT_IN_DATES, EXPANSION, format_class, grid_block, number_text, serial_text

SIGNATURE = bytes.fromhex("d0cf11e0a1b11ae1")
_END = 0xFFFFFFFA


class Compound:
    """Streams of a compound file by name."""

    def __init__(self, data: bytes):
        if data[:8] != SIGNATURE or len(data) < 512:
            raise ConvertError("malformed", "no compound file")
        self.data = data
        shift, mini_shift = struct.unpack_from("<HH", data, 30)
        if not (7 <= shift <= 16 and mini_shift <= shift):
            raise ConvertError("malformed", "sector size")
        self.size, self.mini = 1 << shift, 1 << mini_shift
        first_dir, = struct.unpack_from("<I", data, 48)
        self.cutoff, first_mini, _, first_table, tables = struct.unpack_from("<IIIII", data, 56)
        sectors = [s for s in struct.unpack_from("<109I", data, 76) if s < _END]
        for _ in range(min(tables, len(data) // self.size)):
            if first_table >= _END:
                break
            more = struct.unpack(f"<{self.size // 4}I", self._sector(first_table))
            sectors += [s for s in more[:-1] if s < _END]
            first_table = more[-1]
        self.next = [x for s in sectors for x in struct.unpack(f"<{self.size // 4}I", self._sector(s))]
        directory = self._chain(first_dir)
        self.entries: dict[str, tuple[int, int]] = {}
        root = (_END, 0)
        for at in range(0, len(directory) - 127, 128):
            n, kind = struct.unpack_from("<HB", directory, at + 64)
            start, size = struct.unpack_from("<IQ", directory, at + 116)
            name = directory[at : at + max(0, min(n, 64) - 2)].decode("utf-16-le", "replace")
            if kind == 5:
                root = (start, size & 0xFFFFFFFF)
            elif kind == 2:
                self.entries.setdefault(name, (start, size & 0xFFFFFFFF))
        self.small = self._chain(root[0])[: root[1]] if root[0] < _END else b""
        mini = self._chain(first_mini) if first_mini < _END else b""
        self.mini_next = list(struct.unpack(f"<{len(mini) // 4}I", mini[: len(mini) // 4 * 4]))

    def _sector(self, number: int) -> bytes:
        part = self.data[(number + 1) * self.size : (number + 2) * self.size]
        return part.ljust(self.size, b"\0")

    def _chain(self, at: int) -> bytes:
        parts, seen = [], set()
        while at < len(self.next) and at not in seen:
            seen.add(at)
            parts.append(self._sector(at))
            at = self.next[at]
        return b"".join(parts)

    def stream(self, name: str) -> bytes:
        if name not in self.entries:
            raise ConvertError("missingPart", name)
        at, size = self.entries[name]
        if size >= self.cutoff:
            return self._chain(at)[:size]
        parts, seen = [], set()
        while at < len(self.mini_next) and at not in seen:
            seen.add(at)
            parts.append(self.small[at * self.mini : (at + 1) * self.mini])
            at = self.mini_next[at]
        return b"".join(parts)[:size]


def kind_of(data: bytes) -> str | None:
    """doc, xls or ppt by the streams there are."""
    names = Compound(data).entries
    return next((k for n, k in (("WordDocument", "doc"), ("Workbook", "xls"), ("Book", "xls"), ("PowerPoint Document", "ppt")) if n in names), None)


def read_doc(data: bytes) -> list[Block]:
    """Paragraphs and tables of the main text, by the piece table."""
    file = Compound(data)
    word = file.stream("WordDocument")
    if len(word) < 0x1AA:
        raise ConvertError("malformed", "short header")
    flags, = struct.unpack_from("<H", word, 10)
    if flags & 0x100:
        raise ConvertError("encrypted", "encrypted document")
    table = file.stream("1Table" if flags & 0x200 else "0Table")
    length, = struct.unpack_from("<I", word, 0x4C)
    at, size = struct.unpack_from("<II", word, 0x1A2)
    clx, i, pieces = table[at : at + size], 0, b""
    while i < len(clx):
        if clx[i] == 2:
            n, = struct.unpack_from("<I", clx, i + 1)
            pieces = clx[i + 5 : i + 5 + n]
            break
        i += 3 + struct.unpack_from("<H", clx, i + 1)[0]
    count = (len(pieces) - 4) // 12
    if count < 1:
        raise ConvertError("malformed", "no pieces")
    ends = struct.unpack_from(f"<{count + 1}I", pieces)
    text = ""
    for k in range(count):
        place, = struct.unpack_from("<I", pieces, 4 * (count + 1) + 8 * k + 2)
        n = ends[k + 1] - ends[k]
        if place & 0x40000000:
            start = (place & 0x3FFFFFFF) // 2
            text += word[start : start + n].decode("cp1252", "replace")
        else:
            text += word[place : place + 2 * n].decode("utf-16-le", "replace")
    text = text[:length]
    text = re.sub("\x13[^\x14\x15]*\x14?", "", text).replace("\x15", "")
    out: list[Block] = []
    rows: list[list[str]] = []
    row: list[str] = []
    for part in re.findall("[^\r\x07\x0c]*[\r\x07\x0c]?", text):
        body, mark = clean(part.rstrip("\r\x07\x0c").replace("\x0b", "\n")), part[-1:]
        if mark == "\x07":
            if body or not row:
                row.append(body.strip())
            if not body and row:
                rows.append(row[:-1] if row and not row[-1] and len(row) > 1 else row)
                row = []
            continue
        if rows:
            out.append(Block("table", rows=rows, header_rows=header_rows(rows)))
            rows = []
        if body.strip():
            out.append(Block("paragraph", [Run(body.strip())]))
    if rows:
        out.append(Block("table", rows=rows, header_rows=header_rows(rows)))
    return out


def _strings(parts: list[bytes]) -> list[str]:
    """The shared strings; a string may go on in the next record, which then says
    anew whether its characters are wide."""
    out: list[str] = []
    part, at = 0, 8
    while part < len(parts):
        if at >= len(parts[part]):
            part, at = part + 1, 0
            continue
        if at + 3 > len(parts[part]):
            break
        n, flags = struct.unpack_from("<HB", parts[part], at)
        at += 3
        runs = struct.unpack_from("<H", parts[part], at)[0] if flags & 8 else 0
        at += 2 if flags & 8 else 0
        extra = struct.unpack_from("<I", parts[part], at)[0] if flags & 4 else 0
        at += 4 if flags & 4 else 0
        text, wide = "", flags & 1
        while n:
            here = min(n, (len(parts[part]) - at) // (2 if wide else 1))
            raw = parts[part][at : at + here * (2 if wide else 1)]
            text += raw.decode("utf-16-le" if wide else "latin-1", "replace")
            at += len(raw)
            n -= here
            if n:
                part += 1
                if part >= len(parts):
                    return [*out, text]
                wide, at = parts[part][0] & 1, 1
        rest = 4 * runs + extra
        while rest and part < len(parts):
            here = min(rest, len(parts[part]) - at)
            at, rest = at + here, rest - here
            if rest:
                part, at = part + 1, 0
        out.append(text)
    return out


def _rk(value: int) -> float:
    number = float(value >> 2 if value < 1 << 31 else (value >> 2) - (1 << 30)) if value & 2 else struct.unpack("<d", struct.pack("<Q", (value & 0xFFFFFFFC) << 32))[0]
    return number / 100 if value & 1 else number


def read_xls(data: bytes) -> list[Block]:
    file = Compound(data)
    book = file.stream("Workbook" if "Workbook" in file.entries else "Book")

    def records(at: int):
        while at + 4 <= len(book):
            kind, n = struct.unpack_from("<HH", book, at)
            yield kind, book[at + 4 : at + 4 + n]
            at += 4 + n

    sheets: list[tuple[int, str]] = []
    shared: list[bytes] = []
    formats, classes, date1904, last = {}, [], False, 0
    for kind, body in records(0):
        if kind == 0x2F:
            raise ConvertError("encrypted", "encrypted workbook")
        if kind == 0x85 and len(body) > 8:
            name = body[8:].decode("utf-16-le" if body[7] & 1 else "latin-1", "replace")
            if body[5] == 0:
                sheets.append((struct.unpack_from("<I", body)[0], name))
        elif kind == 0xFC:
            shared = [body]
        elif kind == 0x3C and last in (0xFC, 0x3C) and shared:
            shared.append(body)
        elif kind == 0x22:
            date1904 = body[:1] == b"\1"
        elif kind == 0x41E and len(body) > 5:
            formats[struct.unpack_from("<H", body)[0]] = body[5:].decode("utf-16-le" if body[4] & 1 else "latin-1", "replace")
        elif kind == 0xE0 and len(body) > 3:
            n, = struct.unpack_from("<H", body, 2)
            classes.append(format_class(formats[n]) if n in formats else "timeDelta" if n == 46 else "dateTime" if n in BUILT_IN_DATES else "other")
        elif kind == 0x0A:
            break
        last = kind
    strings = _strings(shared) if shared else []

    def shown(value: float, style: int) -> str:
        shape = classes[style] if style < len(classes) else "other"
        return number_text(value) if shape == "other" else serial_text(value, shape, date1904)

    out: list[Block] = []
    for start, name in sheets:
        cells: dict[tuple[int, int], str] = {}
        waiting: tuple[int, int] | None = None
        for kind, body in records(start):
            if kind == 0x0A:
                break
            if kind in (0xFD, 0x203, 0x27E, 0x06, 0x205, 0x204, 0xBD) and len(body) >= 6:
                row, col, style = struct.unpack_from("<HHH", body)
                if kind == 0xFD:
                    k, = struct.unpack_from("<I", body, 6)
                    cells[row, col] = strings[k] if k < len(strings) else ""
                elif kind == 0x203:
                    cells[row, col] = shown(struct.unpack_from("<d", body, 6)[0], style)
                elif kind == 0x27E:
                    cells[row, col] = shown(_rk(struct.unpack_from("<I", body, 6)[0]), style)
                elif kind == 0xBD:
                    for k in range((len(body) - 6) // 6):
                        style, value = struct.unpack_from("<HI", body, 4 + 6 * k)
                        cells[row, col + k] = shown(_rk(value), style)
                elif kind == 0x205:
                    cells[row, col] = "" if body[7] else "TRUE" if body[6] else "FALSE"
                elif kind == 0x204:
                    n, = struct.unpack_from("<H", body, 6)
                    wide = body[8] & 1
                    cells[row, col] = body[9 : 9 + n * (2 if wide else 1)].decode("utf-16-le" if wide else "latin-1", "replace")
                elif body[12:14] == b"\xff\xff":
                    waiting = (row, col) if body[6] == 0 else None
                    if body[6] == 1:
                        cells[row, col] = "TRUE" if body[8] else "FALSE"
                else:
                    cells[row, col] = shown(struct.unpack_from("<d", body, 6)[0], style)
            elif kind == 0x207 and waiting and len(body) >= 3:
                n, = struct.unpack_from("<H", body)
                cells[waiting] = body[3 : 3 + n * (2 if body[2] & 1 else 1)].decode("utf-16-le" if body[2] & 1 else "latin-1", "replace")
                waiting = None
        cells = {k: v for k, v in cells.items() if v.strip()}
        if not cells:
            continue
        top, left = min(r for r, _ in cells), min(c for _, c in cells)
        height, width = max(r for r, _ in cells) - top + 1, max(c for _, c in cells) - left + 1
        if height * width > EXPANSION:
            raise ConvertError("resourceLimit", "sheet too large")
        if len(sheets) > 1:
            out.append(Block("heading", [Run(name)], 2))
        out += grid_block([[cells.get((top + r, left + c), "") for c in range(width)] for r in range(height)])
    return out


def read_ppt(data: bytes) -> list[Block]:
    """Text atoms of the slides in order; titles become headings."""
    stream = Compound(data).stream("PowerPoint Document")
    out: list[Block] = []
    budget = 16_000_000
    stack = [(0, len(stream), 0)]
    title = False
    while stack:
        at, end, depth = stack.pop()
        while at + 8 <= end:
            budget -= 1
            if budget < 0 or depth > 64:
                raise ConvertError("resourceLimit", "too many records")
            version, kind, n = struct.unpack_from("<HHI", stream, at)
            body_at, body_end = at + 8, min(at + 8 + n, end)
            if kind == 3999 and n >= 4:
                title = struct.unpack_from("<I", stream, body_at)[0] in (0, 6)
            elif kind in (4000, 4008):
                raw = stream[body_at:body_end]
                text = raw.decode("utf-16-le", "replace") if kind == 4000 else raw.decode("latin-1")
                for line in text.split("\r"):
                    shown = clean(line.replace("\x0b", "\n")).strip()
                    if shown:
                        out.append(Block("heading", [Run(shown)], 2) if title else Block("item", [Run(shown)]))
            if version & 15 == 15:
                stack.append((body_end, end, depth))
                at, end, depth = body_at, body_end, depth + 1
            else:
                at = body_end
    return out
