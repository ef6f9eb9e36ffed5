"""Rich Text Format: groups, character formats, headings, lists and tables."""

from __future__ import annotations

import re

from .model import Block, ConvertError, Run, clean, header_rows

_TOKEN = re.compile(rb"\\([a-zA-Z]{1,32})(-?[0-9]{1,10})? ?|\\'([0-9a-fA-F]{2})|\\(.)|([{}])|([^\\{}\r\n]+)|[\r\n]+", re.DOTALL)
SKIPPED = {"fonttbl", "colortbl", "info", "pict", "object", "header", "footer", "headerl", "headerr", "headerf", "footerl", "footerr", "footerf", "listtable", "listoverridetable", "rsidtbl", "themedata", "generator", "xmlnstbl", "latentstyles", "datastore", "fldinst", "listtext", "pntext", "expandedcolortbl"}
SIGNS = {"emdash": "—", "endash": "–", "lquote": "‘", "rquote": "’", "ldblquote": "“", "rdblquote": "”", "bullet": "•", "tab": "\t", "line": "\n", "emspace": " ", "enspace": " "}


class Reader:
    def __init__(self, data: bytes):
        self.data = data
        self.state = {"bold": False, "italic": False, "strike": False, "hidden": False, "skip": False, "uc": 1, "link": None}
        self.stack: list[dict] = []
        self.runs: list[Run] = []
        self.out: list[Block] = []
        self.outline, self.list, self.level, self.cells, self.in_table = 0, None, 0, [], False
        self.rows: list[list[str]] = []
        self.styles: dict[int, int] = {}
        self.codec = "cp1252"
        self.instruction = b""

    def text(self, text: str) -> None:
        s = self.state
        if text and not s["skip"] and not s["hidden"]:
            self.runs.append(Run(clean(text) if text != "\n" else text, s["bold"], s["italic"], s["strike"], link=s["link"]))

    def paragraph(self) -> None:
        runs, self.runs = self.runs, []
        if self.in_table:
            self.cells.append(("p", runs))
            return
        self.table()
        if any(r.text.strip() for r in runs):
            if self.outline:
                self.out.append(Block("heading", [Run(r.text, False, r.italic, r.strike, link=r.link) for r in runs], self.outline))
            elif self.list is not None:
                self.out.append(Block("item", runs, self.level))
            else:
                self.out.append(Block("paragraph", runs))

    def table(self) -> None:
        if self.rows:
            self.out.append(Block("table", rows=self.rows, header_rows=header_rows(self.rows)))
            self.rows = []

    def row(self) -> None:
        row, text = [], ""
        for kind, runs in self.cells:
            text += "".join(r.text for r in runs) + ("\n" if kind == "p" else "")
            if kind == "c":
                row.append(text.strip())
                text = ""
        if row:
            self.rows.append(row)
        self.cells = []

    def word(self, word: str, number: int | None) -> None:
        s = self.state
        if word in ("b", "i", "strike"):
            s[{"b": "bold", "i": "italic", "strike": "strike"}[word]] = number != 0
        elif word == "v":
            s["hidden"] = number != 0
        elif word == "plain":
            s |= {"bold": False, "italic": False, "strike": False, "hidden": False}
        elif word in ("par", "sect", "page"):
            if not s["skip"]:
                self.paragraph()
        elif word == "pard":
            self.outline, self.list, self.level, self.in_table = 0, None, 0, False
        elif word == "intbl":
            self.in_table = True
        elif word == "cell" and not s["skip"]:
            self.cells.append(("c", self.runs))
            self.runs = []
        elif word == "row" and not s["skip"]:
            self.row()
        elif word == "outlinelevel" and number is not None and number < 9:
            self.outline = number + 1
        elif word == "s" and number in self.styles:
            self.outline = self.styles[number]
        elif word == "ls":
            self.list = number
        elif word == "ilvl":
            self.level = number or 0
        elif word == "uc":
            s["uc"] = number or 0
        elif word == "ansicpg" and number:
            try:
                b"".decode(f"cp{number}")
                self.codec = f"cp{number}"
            except LookupError:
                pass
        elif word in SIGNS:
            self.text(SIGNS[word])

    def stylesheet(self, group: bytes) -> None:
        for m in re.finditer(rb"\{\\s([0-9]+)([^{}]*?)([^\\{};]*);\}", group):
            level = re.search(rb"heading ([1-9])", m[0], re.IGNORECASE) or re.search(rb"\\outlinelevel([0-8])", m[0])
            if level:
                self.styles[int(m[1])] = int(level[1]) + (b"outlinelevel" in level[0])

    def read(self) -> list[Block]:
        data, at, skip = self.data, 0, 0
        if not data.lstrip().startswith(b"{\\rtf"):
            raise ConvertError("malformed", "no rtf header")
        sheet = re.search(rb"\{\\stylesheet(?:[^{}]|\{[^{}]*\})*\}", data)
        if sheet:
            self.stylesheet(sheet[0])
        pending = b""
        while at < len(data):
            m = _TOKEN.match(data, at)
            if not m:
                at += 1
                continue
            at = m.end()
            word, number, hexed, sign, brace, plain = m.groups()
            if pending and not hexed:
                self.text(pending.decode(self.codec, "replace"))
                pending = b""
            if brace == b"{":
                self.stack.append(dict(self.state))
                name = re.match(rb"\\\*?\\?([a-z]+)", data[at : at + 40])
                starred = data[at : at + 2] == b"\\*"
                key = name[1].decode() if name else ""
                if key == "fldinst" or (starred and b"fldinst" in data[at : at + 12]):
                    link = re.search(rb'HYPERLINK\s+(?:\\l\s+)?"([^"]*)"', data[at : at + 2000])
                    if link and self.stack:
                        self.stack[-1]["link"] = link[1].decode("latin-1")
                if key in SKIPPED or key == "stylesheet" or (starred and key not in ("shptxt",)):
                    self.state["skip"] = True
            elif brace == b"}":
                if self.stack:
                    closed, self.state = self.state, self.stack.pop()
                    if closed["link"] and not self.state["link"] and closed["skip"]:
                        self.state["link"] = closed["link"]
            elif word == b"bin":
                at += max(0, int(number or 0))
            elif word == b"u" and number is not None:
                self.text(chr(int(number) % 65536) if not 0xD800 <= int(number) % 65536 < 0xE000 else "�")
                skip = self.state["uc"]
            elif word is not None:
                self.word(word.decode(), int(number) if number else None)
            elif hexed is not None:
                if skip:
                    skip -= 1
                elif not self.state["skip"]:
                    pending += bytes.fromhex(hexed.decode())
            elif sign is not None:
                self.text({b"~": " ", b"_": "-", b"\\": "\\", b"{": "{", b"}": "}"}.get(sign, ""))
                if sign in (b"\n", b"\r"):
                    self.word("par", None)
            elif plain is not None:
                taken = min(skip, len(plain))
                skip -= taken
                self.text(plain[taken:].decode(self.codec, "replace"))
        if pending:
            self.text(pending.decode(self.codec, "replace"))
        self.in_table = self.in_table and bool(self.cells)
        if self.cells:
            self.row()
            self.in_table = False
        self.paragraph()
        self.table()
        return self.out


def read(data: bytes) -> list[Block]:
    return Reader(data).read()
