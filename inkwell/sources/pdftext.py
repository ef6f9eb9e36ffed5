"""What a PDF page shows: positioned text, rectangles, line segments and images."""

from __future__ import annotations

import math
import re
import unicodedata
from dataclasses import dataclass, field
from typing import Any

from .pdfobjects import Document, Name, Operator, Reader, Stream, operations

Matrix = tuple[float, float, float, float, float, float]
UNIT: Matrix = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)
#: Forms inside forms, at most.
FORMS = 5
#: A kern of so many thousandths of an em to the left is a space.
KERN_SPACE = 200
#: Width of a glyph, in thousandths of an em, that a font says nothing about.
DEFAULT_WIDTH = 500

#: Standard encoding above ASCII, from code 161 on, - for none; fixed values.
STANDARD_HIGH = """exclamdown cent sterling fraction yen florin section currency quotesingle quotedblleft guillemotleft guilsinglleft
guilsinglright fi fl - endash dagger daggerdbl periodcentered - paragraph bullet quotesinglbase quotedblbase quotedblright
guillemotright ellipsis perthousand - questiondown - grave acute circumflex tilde macron breve dotaccent dieresis - ring
cedilla - hungarumlaut ogonek caron emdash - - - - - - - - - - - - - - - - AE - ordfeminine - - - - Lslash Oslash OE
ordmasculine - - - - - ae - - - dotlessi - - lslash oslash oe germandbls""".split()
#: Glyph names that are not made of a letter and an accent; fixed values.
GLYPHS = {
    "space": " ", "exclam": "!", "quotedbl": '"', "numbersign": "#", "dollar": "$", "percent": "%", "ampersand": "&", "quotesingle": "'",
    "parenleft": "(", "parenright": ")", "asterisk": "*", "plus": "+", "comma": ",", "hyphen": "-", "period": ".", "slash": "/",
    "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "colon": ":", "semicolon": ";", "less": "<", "equal": "=", "greater": ">", "question": "?", "at": "@", "bracketleft": "[",
    "backslash": "\\", "bracketright": "]", "asciicircum": "^", "underscore": "_", "grave": "`", "braceleft": "{", "bar": "|",
    "braceright": "}", "asciitilde": "~", "exclamdown": "¡", "cent": "¢", "sterling": "£", "fraction": "⁄", "yen": "¥", "florin": "ƒ",
    "section": "§", "currency": "¤", "quotedblleft": "“", "quotedblright": "”", "quoteleft": "‘", "quoteright": "’",
    "quotesinglbase": "‚", "quotedblbase": "„", "guillemotleft": "«", "guillemotright": "»", "guilsinglleft": "‹", "guilsinglright": "›",
    "fi": "fi", "fl": "fl", "ff": "ff", "ffi": "ffi", "ffl": "ffl", "endash": "–", "emdash": "—", "dagger": "†", "daggerdbl": "‡",
    "periodcentered": "·", "paragraph": "¶", "bullet": "•", "ellipsis": "…", "perthousand": "‰", "questiondown": "¿", "acute": "´",
    "circumflex": "ˆ", "tilde": "˜", "macron": "¯", "breve": "˘", "dotaccent": "˙", "dieresis": "¨", "ring": "˚", "cedilla": "¸",
    "hungarumlaut": "˝", "ogonek": "˛", "caron": "ˇ", "AE": "Æ", "ae": "æ", "OE": "Œ", "oe": "œ", "Oslash": "Ø", "oslash": "ø",
    "Lslash": "Ł", "lslash": "ł", "germandbls": "ß", "dotlessi": "ı", "ordfeminine": "ª", "ordmasculine": "º", "copyright": "©",
    "registered": "®", "trademark": "™", "degree": "°", "plusminus": "±", "multiply": "×", "divide": "÷", "minus": "−", "mu": "µ",
    "onehalf": "½", "onequarter": "¼", "threequarters": "¾", "onesuperior": "¹", "twosuperior": "²", "threesuperior": "³",
    "brokenbar": "¦", "logicalnot": "¬", "Euro": "€", "eth": "ð", "Eth": "Ð", "thorn": "þ", "Thorn": "Þ", "nbspace": " ",
}
#: Names of accents behind a letter.
ACCENTS = {"grave": "̀", "acute": "́", "circumflex": "̂", "tilde": "̃", "macron": "̄", "breve": "̆", "dotaccent": "̇", "dieresis": "̈", "ring": "̊", "hungarumlaut": "̋", "caron": "̌", "cedilla": "̧", "ogonek": "̨"}
_ACCENTED = re.compile(f"([A-Za-z])({'|'.join(ACCENTS)})$")


def glyph_text(name: str) -> str | None:
    """What a glyph name stands for."""
    base = name.split(".")[0]
    if "_" in base and base not in GLYPHS:
        parts = [glyph_text(p) for p in base.split("_") if p]
        return "".join(p for p in parts if p) or None
    if base in GLYPHS:
        return GLYPHS[base]
    if len(base) == 1:
        return base
    if m := _ACCENTED.match(base):
        return unicodedata.normalize("NFC", m[1] + ACCENTS[m[2]])
    if m := re.fullmatch(r"uni((?:[0-9A-F]{4})+)", base):
        return bytes.fromhex(m[1]).decode("utf-16-be", "replace")
    if m := re.fullmatch(r"u([0-9A-F]{4,6})", base):
        return chr(int(m[1], 16)) if int(m[1], 16) < 0x110000 else None
    return None


def base_encoding(name: str | None) -> dict[int, str]:
    """Text of each byte."""
    if name in ("WinAnsiEncoding", "MacRomanEncoding"):
        codec = "cp1252" if name == "WinAnsiEncoding" else "mac_roman"
        return {b: bytes([b]).decode(codec, "replace").replace("�", "•") for b in range(32, 256)}
    out = {b: chr(b) for b in range(32, 127)} | {0x27: "’", 0x60: "‘"}
    return out | {161 + i: GLYPHS[g] for i, g in enumerate(STANDARD_HIGH) if g != "-"}


class CMap:
    """Codes to text: bfchar, bfrange and the widths of codes."""

    def __init__(self, content: bytes):
        self.text: dict[int, str] = {}
        self.sizes: set[int] = set()
        reader, held = Reader(content), []
        while True:
            v = reader.value()
            if not isinstance(v, Operator):
                held.append(v)
                continue
            if v == b"":
                return
            if v == b"endcodespacerange":
                self.sizes |= {len(x) for x in held if isinstance(x, bytes) and x}
            elif v == b"endbfchar":
                for code, to in zip(held[::2], held[1::2]):
                    self._put(code, 0, to)
            elif v == b"endbfrange":
                for low, high, to in zip(held[::3], held[1::3], held[2::3]):
                    if isinstance(low, bytes) and isinstance(high, bytes):
                        count = min(int.from_bytes(high, "big") - int.from_bytes(low, "big") + 1, 1 << 16)
                        for i in range(count):
                            self._put(low, i, to[i] if isinstance(to, list) and i < len(to) else to, 0 if isinstance(to, list) else i)
            held = []

    def _put(self, code: Any, add: int, to: Any, last: int = 0) -> None:
        if not isinstance(code, bytes) or not isinstance(to, bytes) or not to:
            return
        if last:
            to = (int.from_bytes(to, "big") + last).to_bytes(len(to) + 1, "big")[1:]
        text = to.decode("utf-16-be", "replace") if len(to) > 1 else chr(to[0])
        self.text.setdefault(int.from_bytes(code, "big") + add, text)


@dataclass
class Font:
    name: str = ""
    bold: bool = False
    italic: bool = False
    wide: bool = False  # two bytes a code
    encoding: dict[int, str] = field(default_factory=dict)
    cmap: CMap | None = None
    widths: dict[int, float] = field(default_factory=dict)
    default: float = DEFAULT_WIDTH
    unit: float = 0.001
    kind: str = ""

    def codes(self, raw: bytes) -> list[int]:
        size = 2 if self.wide else 1
        return [int.from_bytes(raw[i : i + size], "big") for i in range(0, len(raw) - size + 1, size)]

    def text_of(self, code: int) -> str:
        if self.cmap and code in self.cmap.text:
            return self.cmap.text[code]
        if self.wide:
            return ""
        return self.encoding.get(code, chr(code) if code >= 32 and not self.encoding else "")

    @property
    def decodable(self) -> bool:
        return bool(self.encoding) or bool(self.cmap and self.cmap.text)


def style_of(name: str) -> tuple[bool, bool]:
    """(bold, italic) from the name of a font."""
    low = name.lower()
    return any(w in low for w in ("bold", "black", "heavy", "semibold", "demi")), any(w in low for w in ("italic", "oblique"))


def read_font(document: Document, value: Any) -> Font:
    get, own = document.get, document.dictionary(value)
    below = get(own.get("DescendantFonts"))
    inner = document.dictionary(below[0]) if isinstance(below, list) and below else {}
    descriptor = document.dictionary((inner or own).get("FontDescriptor"))
    font = Font(name=re.sub(r"^[A-Z]{6}\+", "", str(get(own.get("BaseFont")) or "")), kind=str(get(own.get("Subtype")) or ""))
    flags, weight = get(descriptor.get("Flags")), get(descriptor.get("FontWeight"))
    bold, italic = style_of(font.name)
    font.bold = bold or isinstance(flags, int) and bool(flags >> 18 & 1) or isinstance(weight, (int, float)) and weight >= 600
    font.italic = italic or isinstance(flags, int) and bool(flags >> 6 & 1) or bool(get(descriptor.get("ItalicAngle")) or 0)
    mapped = get(own.get("ToUnicode"))
    if isinstance(mapped, Stream):
        font.cmap = CMap(document.decoded(mapped) or b"")
    if font.kind == "Type0":
        font.wide = not (font.cmap and font.cmap.sizes == {1})
        font.default = float(w) if isinstance(w := get(inner.get("DW")), (int, float)) else 1000.0
        _cid_widths(font, [get(v) for v in get(inner.get("W")) or []])
        return font
    encoding = get(own.get("Encoding"))
    if isinstance(encoding, dict):
        symbolic = isinstance(flags, int) and bool(flags & 4)
        base = get(encoding.get("BaseEncoding"))
        font.encoding = base_encoding(str(base) if base else None) if base or not symbolic else {}
        code = 0
        for entry in get(encoding.get("Differences")) or []:
            entry = get(entry)
            if isinstance(entry, int):
                code = entry
            elif isinstance(entry, Name):
                text = glyph_text(entry)
                if text:
                    font.encoding[code] = text
                code += 1
    else:
        font.encoding = base_encoding(str(encoding)) if encoding else base_encoding("WinAnsiEncoding" if font.kind == "TrueType" else None)
    first, widths = get(own.get("FirstChar")), get(own.get("Widths"))
    if isinstance(first, int) and isinstance(widths, list):
        font.widths = {first + i: float(w) for i, w in enumerate(map(get, widths)) if isinstance(w, (int, float))}
    missing = get(descriptor.get("MissingWidth"))
    font.default = float(missing) if isinstance(missing, (int, float)) else 600.0 if "courier" in font.name.lower() else DEFAULT_WIDTH
    if font.kind == "Type3":
        matrix = get(own.get("FontMatrix"))
        font.unit = abs(float(matrix[0])) if isinstance(matrix, list) and matrix and isinstance(matrix[0], (int, float)) and matrix[0] else 0.001
    return font


def _cid_widths(font: Font, entries: list) -> None:
    at = 0
    while at + 1 < len(entries):
        first, second = entries[at], entries[at + 1]
        if isinstance(first, int) and isinstance(second, list):
            font.widths |= {first + i: float(w) for i, w in enumerate(second) if isinstance(w, (int, float))}
            at += 2
        elif at + 2 < len(entries) and isinstance(first, int) and isinstance(second, int) and isinstance(entries[at + 2], (int, float)):
            font.widths |= dict.fromkeys(range(first, min(second, first + 65535) + 1), float(entries[at + 2]))
            at += 3
        else:
            at += 1


def times(a: Matrix, b: Matrix) -> Matrix:
    """First ``a``, then ``b``."""
    return (
        a[0] * b[0] + a[1] * b[2], a[0] * b[1] + a[1] * b[3],
        a[2] * b[0] + a[3] * b[2], a[2] * b[1] + a[3] * b[3],
        a[4] * b[0] + a[5] * b[2] + b[4], a[4] * b[1] + a[5] * b[3] + b[5],
    )


def moved(m: Matrix, x: float, y: float) -> tuple[float, float]:
    return x * m[0] + y * m[2] + m[4], x * m[1] + y * m[3] + m[5]


@dataclass
class Item:
    page: int
    text: str
    x: float
    y: float
    width: float
    size: float
    font: str = ""
    bold: bool = False
    italic: bool = False
    rotated: bool = False
    hidden: bool = False
    mcid: int | None = None


@dataclass
class Page:
    items: list[Item] = field(default_factory=list)
    rects: list[tuple[float, float, float, float, str]] = field(default_factory=list)  # x, y, width, height, fill or clip
    segments: list[tuple[float, float, float, float]] = field(default_factory=list)
    images: list[tuple[float, float, float, float, int]] = field(default_factory=list)  # box and pixels
    fonts: dict[str, Font] = field(default_factory=dict)
    counts: dict[str, int] = field(default_factory=lambda: dict.fromkeys(("text", "path", "image"), 0))


class _State:
    """What q saves and Q brings back."""

    def __init__(self) -> None:
        self.ctm: Matrix = UNIT
        self.font = Font()
        self.size, self.spacing, self.word, self.scale, self.leading, self.rise, self.mode = 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0

    def copy(self) -> _State:
        out = _State()
        out.__dict__ |= self.__dict__
        return out


class Interpreter:
    """Runs the operations of a page and its forms."""

    def __init__(self, document: Document, number: int):
        self.document, self.number, self.page = document, number, Page()
        self.state, self.saved = _State(), []
        self.text: Matrix = UNIT
        self.line: Matrix = UNIT
        self.path: list[list[tuple[float, float]]] = []
        self.boxes: list[tuple[float, float, float, float]] = []
        self.clipping = False
        self.marks: list[tuple[int | None, str | None]] = []
        self.spoken: set[int] = set()
        self.fonts: dict[int, Font] = {}

    def run(self, content: bytes, resources: dict[str, Any], depth: int = 0) -> None:
        for name, args in operations(content):
            handler = _HANDLERS.get(name)
            if handler:
                try:
                    handler(self, args, resources, depth)
                except (IndexError, TypeError, ValueError, OverflowError):
                    continue  # an operation with wrong operands does nothing

    # text

    def _font(self, args: list, resources: dict, depth: int) -> None:
        fonts = self.document.dictionary(resources.get("Font"))
        value = fonts.get(args[0])
        key = id(value) if not hasattr(value, "number") else value.number
        if key not in self.fonts:
            self.fonts[key] = read_font(self.document, value)
        self.state.font, self.state.size = self.fonts[key], float(args[1])
        self.page.fonts[str(args[0])] = self.state.font

    def _show(self, parts: list) -> None:
        s = self.state
        self.page.counts["text"] += 1
        start, out, advance = self.text, [], 0.0
        for part in parts:
            if isinstance(part, (int, float)):
                step = -part / 1000 * s.size * s.scale
                if -part >= KERN_SPACE and out and not out[-1].endswith(" "):
                    out.append(" ")
                advance += step
            elif isinstance(part, bytes):
                for code in s.font.codes(part):
                    out.append(s.font.text_of(code))
                    width = s.font.widths.get(code, s.font.default) * s.font.unit * s.size + s.spacing
                    if code == 32 and not s.font.wide:
                        width += s.word
                    advance += width * s.scale
        self.text = times((1, 0, 0, 1, advance, 0), self.text)
        text = "".join(out)
        mcid, actual = next(((m, t) for m, t in reversed(self.marks) if m is not None or t is not None), (None, None))
        if actual is not None:
            if len(self.marks) in self.spoken:
                return
            self.spoken.add(len(self.marks))
            text = actual
        if not text.strip():
            return
        whole = times((s.size * s.scale, 0, 0, s.size, 0, s.rise), times(start, s.ctm))
        x, y = whole[4], whole[5]
        end = moved(times(times((1, 0, 0, 1, advance, 0), start), s.ctm), 0, s.rise)
        size = math.hypot(whole[2], whole[3])
        self.page.items.append(Item(self.number, text, x, y, math.hypot(end[0] - x, end[1] - y), size, s.font.name, s.font.bold, s.font.italic, abs(whole[1]) > abs(whole[0]), s.mode == 3, mcid))

    def _next_line(self, x: float, y: float) -> None:
        self.text = self.line = times((1, 0, 0, 1, x, y), self.line)

    # graphics

    def _paint(self, kind: str) -> None:
        self.page.counts["path"] += 1
        if self.clipping:
            self.page.rects += [(*b, "clip") for b in self.boxes]
        if kind:
            self.page.rects += [(*b, kind) for b in self.boxes]
            for points in self.path:
                self.page.segments += [(*a, *b) for a, b in zip(points, points[1:]) if a != b]
        self.path, self.boxes, self.clipping = [], [], False

    def _rectangle(self, args: list) -> None:
        x, y, w, h = map(float, args[:4])
        a, b = moved(self.state.ctm, x, y), moved(self.state.ctm, x + w, y + h)
        self.boxes.append((min(a[0], b[0]), min(a[1], b[1]), abs(b[0] - a[0]), abs(b[1] - a[1])))

    def _object(self, args: list, resources: dict, depth: int) -> None:
        stream = self.document.get(self.document.dictionary(resources.get("XObject")).get(args[0]))
        if not isinstance(stream, Stream):
            return
        get = self.document.get
        if get(stream.entries.get("Subtype")) == "Image":
            corners = [moved(self.state.ctm, x, y) for x in (0, 1) for y in (0, 1)]
            xs, ys = [c[0] for c in corners], [c[1] for c in corners]
            width, height = get(stream.entries.get("Width")), get(stream.entries.get("Height"))
            pixels = width * height if isinstance(width, int) and isinstance(height, int) else 0
            self.page.images.append((min(xs), min(ys), max(xs) - min(xs), max(ys) - min(ys), pixels))
            self.page.counts["image"] += 1
        elif get(stream.entries.get("Subtype")) == "Form" and depth < FORMS:
            held, text, line, saved = self.state.copy(), self.text, self.line, self.saved
            matrix = get(stream.entries.get("Matrix"))
            if isinstance(matrix, list) and len(matrix) == 6 and all(isinstance(get(v), (int, float)) for v in matrix):
                self.state.ctm = times(tuple(float(get(v)) for v in matrix), self.state.ctm)
            own = self.document.dictionary(stream.entries.get("Resources"))
            self.saved = []
            self.run(self.document.decoded(stream) or b"", own or resources, depth + 1)
            self.state, self.text, self.line, self.saved = held, text, line, saved

    def _mark(self, args: list, resources: dict) -> None:
        entries = args[1] if len(args) > 1 else None
        if isinstance(entries, Name):
            entries = self.document.dictionary(self.document.dictionary(resources.get("Properties")).get(entries))
        entries = entries if isinstance(entries, dict) else {}
        mcid, actual = entries.get("MCID"), self.document.get(entries.get("ActualText"))
        from .pdfobjects import text_string

        self.marks.append((mcid if isinstance(mcid, int) else None, text_string(actual) if isinstance(actual, bytes) else None))
        self.spoken.discard(len(self.marks))


def _set(name: str, factor: float = 1.0):
    return lambda i, a, r, d: setattr(i.state, name, float(a[-1]) * factor)


def _begin(i: Interpreter, a: list, r: dict, d: int) -> None:
    i.text = i.line = UNIT


def _matrix(i: Interpreter, a: list, r: dict, d: int) -> None:
    i.text = i.line = tuple(map(float, a[-6:]))  # type: ignore[assignment]


def _line_set(i: Interpreter, a: list, r: dict, d: int) -> None:
    i.state.leading = -float(a[1])
    i._next_line(float(a[0]), float(a[1]))


def _quote(i: Interpreter, a: list, r: dict, d: int) -> None:
    if len(a) == 3:
        i.state.word, i.state.spacing = float(a[0]), float(a[1])
    i._next_line(0, -i.state.leading)
    i._show(a[-1:])


def _restore(i: Interpreter, a: list, r: dict, d: int) -> None:
    if i.saved:
        i.state = i.saved.pop()


def _join(i: Interpreter, a: list, r: dict, d: int) -> None:
    i.state.ctm = times(tuple(map(float, a[-6:])), i.state.ctm)  # type: ignore[arg-type]


def _move(i: Interpreter, a: list, r: dict, d: int) -> None:
    i.path.append([moved(i.state.ctm, float(a[0]), float(a[1]))])


def _draw(i: Interpreter, a: list, r: dict, d: int) -> None:
    if i.path:
        i.path[-1].append(moved(i.state.ctm, float(a[-2]), float(a[-1])))


def _curve(i: Interpreter, a: list, r: dict, d: int) -> None:
    if i.path:  # a curve is no rule: the path goes on from its end
        i.path.append([moved(i.state.ctm, float(a[-2]), float(a[-1]))])


def _close(i: Interpreter, a: list, r: dict, d: int) -> None:
    if i.path and len(i.path[-1]) > 1:
        i.path[-1].append(i.path[-1][0])


def _painted(kind: str, closed: bool = False):
    def paint(i: Interpreter, a: list, r: dict, d: int) -> None:
        if closed:
            _close(i, a, r, d)
        i._paint(kind)

    return paint


_HANDLERS = {
    b"BT": _begin, b"Tm": _matrix, b"Td": lambda i, a, r, d: i._next_line(float(a[0]), float(a[1])), b"TD": _line_set,
    b"T*": lambda i, a, r, d: i._next_line(0, -i.state.leading), b"Tf": lambda i, a, r, d: i._font(a, r, d),
    b"Tj": lambda i, a, r, d: i._show(a[-1:]), b"TJ": lambda i, a, r, d: i._show(a[-1] if isinstance(a[-1], list) else []),
    b"'": _quote, b'"': _quote, b"Tc": _set("spacing"), b"Tw": _set("word"), b"Tz": _set("scale", 0.01), b"TL": _set("leading"),
    b"Ts": _set("rise"), b"Tr": lambda i, a, r, d: setattr(i.state, "mode", int(a[-1])),
    b"q": lambda i, a, r, d: i.saved.append(i.state.copy()), b"Q": _restore, b"cm": _join,
    b"re": lambda i, a, r, d: i._rectangle(a), b"m": _move, b"l": _draw, b"c": _curve, b"v": _curve, b"y": _curve, b"h": _close,
    b"S": _painted("stroke"), b"s": _painted("stroke", True), b"f": _painted("fill"), b"F": _painted("fill"), b"f*": _painted("fill"),
    b"B": _painted("both"), b"B*": _painted("both"), b"b": _painted("both", True), b"b*": _painted("both", True), b"n": _painted(""),
    b"W": lambda i, a, r, d: setattr(i, "clipping", True), b"W*": lambda i, a, r, d: setattr(i, "clipping", True),
    b"Do": lambda i, a, r, d: i._object(a, r, d),
    b"BDC": lambda i, a, r, d: i._mark(a, r), b"BMC": lambda i, a, r, d: i._mark(a, r), b"EMC": lambda i, a, r, d: i.marks and i.marks.pop(),
}


def read_page(document: Document, number: int) -> Page:
    """Everything that page ``number`` shows."""
    page = document.pages[number]
    run = Interpreter(document, number)
    run.run(document.content(page), document.dictionary(page.get("Resources")))
    return run.page


def distinct_rects(rects: list[tuple]) -> list[tuple]:
    """Rectangles that differ on a grid of half points, the first of each."""
    seen: dict[tuple, tuple] = {}
    for r in rects:
        seen.setdefault(tuple(round(v * 2) for v in r[:4]), r)
    return list(seen.values())


def ocr_reasons(page: Page) -> list[str]:
    """Why the text of a page may need recognition, the strongest reason first."""
    fonts = list(page.fonts.values())
    visible = [i for i in page.items if not i.hidden]
    reasons = []
    if page.images and not page.counts["text"]:
        reasons.append("scanned")
    if fonts and all(f.kind == "Type3" and not f.cmap for f in fonts):
        reasons.append("type3_fonts")
    if any(f.wide and not f.decodable for f in fonts) and not visible:
        reasons.append("undecodable_fonts")
    if page.counts["text"] and page.items and not visible:
        reasons.append("hidden_text")
    if not page.counts["text"] and page.counts["path"] > 100:
        reasons.append("vector_text")
    return reasons
