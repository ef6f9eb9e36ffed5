"""Delimited text: encoding, delimiter and records found from the bytes."""

from __future__ import annotations

from .model import Block, header_rows

SNIFFED = 20
DELIMITERS = ",;\t|"


def decode(data: bytes) -> str:
    """UTF-8, UTF-16 by its mark, else Windows-1252 with C1 controls as they are."""
    if data[:3] == b"\xef\xbb\xbf":
        data = data[3:]
    elif data[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return data[2:].decode("utf-16-le" if data[0] == 0xFF else "utf-16-be", "replace")
    try:
        return data.decode("utf-8")
    except UnicodeDecodeError:
        return "".join(bytes([b]).decode("cp1252", "ignore") or chr(b) for b in data)


def records(text: str, delimiter: str, most: int | None = None) -> list[list[str]]:
    """Records; blank lines are none.  A quote opens only an empty field; what
    follows a closing quote belongs to the field; ragged rows stay ragged."""
    out: list[list[str]] = []
    i, n = 0, len(text)
    while i < n and (most is None or len(out) < most):
        while i < n and text[i] in "\r\n":
            i += 1
        if i >= n:
            break
        row, field = [], []
        while True:
            c = text[i] if i < n else ""
            if c == '"' and not field:
                i += 1
                while i < n:
                    if text[i] == '"':
                        if text[i + 1 : i + 2] != '"':
                            break
                        i += 1
                    field.append(text[i])
                    i += 1
                i += 1
                # a quoted field may go on unquoted
                while i < n and text[i] not in delimiter + "\r\n":
                    field.append(text[i])
                    i += 1
            elif c == "" or c in "\r\n":
                row.append("".join(field))
                break
            elif c == delimiter:
                row.append("".join(field))
                field = []
                i += 1
            else:
                field.append(c)
                i += 1
        out.append(row)
    return out


def sniff(text: str) -> str:
    """The delimiter whose first records agree most on a number of fields."""
    best, score = ",", 0
    for d in DELIMITERS:
        counts = [len(r) for r in records(text, d, SNIFFED)]
        if not counts:
            continue
        modal = max(set(counts), key=lambda k: (counts.count(k), k))
        own = counts.count(modal) * 1000 + min(modal, 500)
        if modal >= 2 and own > score:
            best, score = d, own
    return best


def read(data: bytes) -> list[Block]:
    text = decode(data)
    rows = [[c.replace("\r\n", "\n").strip() for c in r] for r in records(text, sniff(text))]
    return [Block("table", rows=rows, header_rows=header_rows(rows))] if rows else []
