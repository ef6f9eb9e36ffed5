"""PDF syntax, ciphers, fonts and tables against small files made here."""

import base64
import hashlib
import random
import struct
import zlib

import pytest

from inkwell.operators import tables
from inkwell.sources import pdf, pdfobjects, pdftext
from inkwell.sources.model import ConvertError

FONT = b"<</Type/Font/Subtype/Type1/BaseFont/Helvetica/FirstChar 32/LastChar 126/Widths[" + b"500 " * 95 + b"]>>"


def file_of(content, extra=b"", font=FONT, filters=b"", resources=b""):
    """A file with a cross reference table."""
    parts = [
        b"<</Type/Catalog/Pages 2 0 R>>", b"<</Type/Pages/Kids[3 0 R]/Count 1/Resources<</Font<</F1 5 0 R>>" + resources + b">>>>", b"<</Type/Page/Parent 2 0 R/Contents 4 0 R>>",
        b"<</Length %d%s>>stream\n" % (len(content), filters) + content + b"\nendstream", font,
    ]
    out, places = b"%PDF-1.4\n", []
    for i, p in enumerate([*parts, *([extra] if extra else [])]):
        places.append(len(out))
        out += b"%d 0 obj" % (i + 1) + p + b"endobj\n"
    at = len(out)
    out += b"xref\n0 %d\n0000000000 65535 f \n" % (len(places) + 1) + b"".join(b"%010d 00000 n \n" % p for p in places)
    return out + b"trailer<</Size %d/Root 1 0 R>>\nstartxref\n%d\n%%%%EOF" % (len(places) + 1, at)


def texts(data):
    d = pdfobjects.Document(data)
    return [i.text for p in range(len(d.pages)) for i in pdf.items(d, p)]


def test_values():
    value = pdfobjects.Reader(b"<< /A [1 -2.5 --3 +.5 4. (a(b)\\)\\101\\\n) <4142 4> /N#20x 5 0 R true null] /B << /C 1 >> >>").value()
    assert value == {"A": [1, -2.5, -3, 0.5, 4.0, b"a(b))A", b"AB@", "N x", pdfobjects.Ref(5, 0), True, None], "B": {"C": 1}}
    assert pdfobjects.Reader(b"[" * 5000).value() is not None
    assert pdfobjects.Reader(b"<<").value() == {}


def test_filters():
    assert pdfobjects.lzw(bytes.fromhex("800B6050220C0C8501")) == b"-----A---B"
    for t in (b"", b"x", b"hello world", b"\0\0\0\0abcd", bytes(range(256)) * 3):
        assert pdfobjects.ascii85(base64.a85encode(t) + b"~>") == t
    assert pdfobjects.run_lengths(b"\x02abc\xfed\x80zz") == b"abcddd"
    rows = [bytes(random.Random(i).randrange(256) for _ in range(12)) for i in range(6)]

    def filtered(kind, row, above):
        left = lambda i: row[i - 3] if i >= 3 else 0
        corner = lambda i: above[i - 3] if i >= 3 else 0

        def paeth(i):
            p = left(i) + above[i] - corner(i)
            return min((left(i), above[i], corner(i)), key=lambda v: abs(p - v))

        guess = [lambda i: 0, left, lambda i: above[i], lambda i: (left(i) + above[i]) // 2, paeth][kind]
        return bytes([kind]) + bytes((row[i] - guess(i)) & 255 for i in range(12))

    coded = b"".join(filtered(i % 5, r, rows[i - 1] if i else bytes(12)) for i, r in enumerate(rows))
    assert pdfobjects.unpredicted(coded, {"Predictor": 15, "Colors": 3, "Columns": 4}) == b"".join(rows)
    broken = zlib.compress(b"some text " * 50)[:-9]
    assert pdfobjects.flate(broken).startswith(b"some text")


def test_ciphers():
    assert pdfobjects.rc4(b"Key", b"Plaintext").hex() == "bbf316e8d940af0ad3"
    block = bytes.fromhex("00112233445566778899aabbccddeeff")
    for size, coded in ((16, "69c4e0d86a7b0430d8cdb78070b4c55a"), (32, "8ea2b7ca516745bfeafc49904b496089")):
        cipher = pdfobjects.AES(bytes(range(size)))
        assert cipher.encrypt(block).hex() == coded and cipher.decrypt(bytes.fromhex(coded)) == block


def locked(method, password=b""):
    """A file whose content stream is encrypted."""
    content, file_id, owner, flags = b"BT /F1 10 Tf 50 700 Td (secret words) Tj ET", b"0123456789abcdef", bytes(32), -4
    padded = (password + pdfobjects.PADDING)[:32]
    if method == "AESV3":
        key, salt = hashlib.sha256(b"file key").digest(), b"saltsalt"
        user = pdfobjects.hardened_hash(password, salt, b"", 6) + salt + b"keysaltk"
        wrapped = pdfobjects._aes_cbc_encrypt(pdfobjects.hardened_hash(password, b"keysaltk", b"", 6), bytes(16), key)
        entries = b"/Filter/Standard/V 5/R 6/Length 256/CF<</StdCF<</CFM/AESV3>>>>/StmF/StdCF/P -4/O<%s>/U<%s>/UE<%s>" % (bytes(48).hex().encode(), user.hex().encode(), wrapped.hex().encode())
        sealed = bytes(16) + pdfobjects._aes_cbc_encrypt(key, bytes(16), content + bytes([16 - len(content) % 16]) * (16 - len(content) % 16))
    else:
        key = hashlib.md5(padded + owner + struct.pack("<i", flags) + file_id).digest()
        for _ in range(50):
            key = hashlib.md5(key).digest()
        user = hashlib.md5(pdfobjects.PADDING + file_id).digest()
        for i in range(20):
            user = pdfobjects.rc4(bytes(b ^ i for b in key), user)
        own = hashlib.md5(key + struct.pack("<I", 4)[:3] + b"\0\0" + (b"sAlT" if method == "AESV2" else b"")).digest()
        if method == "AESV2":
            pad = 16 - len(content) % 16
            sealed = bytes(16) + pdfobjects._aes_cbc_encrypt(own, bytes(16), content + bytes([pad]) * pad)
            entries = b"/Filter/Standard/V 4/R 4/Length 128/CF<</StdCF<</CFM/AESV2>>>>/StmF/StdCF/P -4/O<%s>/U<%s>" % (owner.hex().encode(), (user + bytes(16)).hex().encode())
        else:
            sealed = pdfobjects.rc4(own, content)
            entries = b"/Filter/Standard/V 2/R 3/Length 128/P -4/O<%s>/U<%s>" % (owner.hex().encode(), (user + bytes(16)).hex().encode())
    data = file_of(sealed, extra=b"<<" + entries + b">>")
    return data.replace(b"/Root 1 0 R", b"/Root 1 0 R/Encrypt 6 0 R/ID[<%s><00>]" % file_id.hex().encode())


@pytest.mark.parametrize("method", ["V2", "AESV2", "AESV3"])
def test_encrypted_files_open_with_the_empty_password(method):
    assert texts(locked(method)) == ["secret words"]
    with pytest.raises(ConvertError) as error:
        pdfobjects.Document(locked(method, b"user"))
    assert error.value.code == "encrypted"


def test_cross_references():
    content = b"BT /F1 12 Tf 72 700 Td (table) Tj ET"
    good = file_of(content)
    assert texts(good) == ["table"]
    assert texts(good.replace(b"startxref\n", b"startxref\n9")) == ["table"]  # damaged: objects are found by a scan
    assert texts(good[: good.index(b"xref\n")]) == ["table"]
    newer = good + b"\n4 0 obj<</Length 38>>stream\nBT /F1 12 Tf 72 700 Td (revised) Tj ET\nendstream endobj\n"
    at = newer.index(b"4 0 obj<</Length 38")
    place = len(newer)
    newer += b"xref\n4 1\n%010d 00000 n \ntrailer<</Root 1 0 R/Prev %d>>\nstartxref\n%d\n" % (at, good.index(b"xref\n"), place)
    assert texts(newer) == ["revised"]
    with pytest.raises(ConvertError):
        pdfobjects.Document(b"not a pdf")


def test_reference_and_object_streams():
    inner = [(1, b"<</Type/Catalog/Pages 2 0 R>>"), (2, b"<</Type/Pages/Kids[3 0 R]/Count 1>>"), (3, b"<</Type/Page/Parent 2 0 R/Contents 4 0 R/Resources<</Font<</F1 5 0 R>>>>>>"), (5, FONT)]
    head, body = b"", b""
    for n, o in inner:
        head += b"%d %d " % (n, len(body))
        body += o + b" "
    packed = zlib.compress(head + body)
    out = b"%PDF-1.5\n"
    at4 = len(out)
    content = zlib.compress(b"BT /F1 10 Tf 1 0 0 1 50 700 Tm [(packed) -300 (words)] TJ ET")
    out += b"4 0 obj<</Length %d/Filter/FlateDecode>>stream\n" % len(content) + content + b"\nendstream endobj\n"
    at6 = len(out)
    out += b"6 0 obj<</Type/ObjStm/N 4/First %d/Length %d/Filter/FlateDecode>>stream\n" % (len(head), len(packed)) + packed + b"\nendstream endobj\n"
    at7 = len(out)
    rows = [(0, 0, 65535), (2, 6, 0), (2, 6, 1), (2, 6, 2), (1, at4, 0), (2, 6, 3), (1, at6, 0), (1, at7, 0)]
    raw = [struct.pack(">BHH", *r) for r in rows]
    table = b"".join(b"\x02" + bytes((b - a) & 255 for a, b in zip(raw[i - 1] if i else bytes(5), r)) for i, r in enumerate(raw))
    coded = zlib.compress(table)
    out += b"7 0 obj<</Type/XRef/Size 8/W[1 2 2]/Root 1 0 R/Length %d/Filter/FlateDecode/DecodeParms<</Predictor 12/Columns 5>>>>stream\n" % len(coded) + coded + b"\nendstream endobj\nstartxref\n%d\n" % at7
    assert texts(out) == ["packed words"]
    assert texts(out.replace(b"startxref\n", b"startxref\n1")) == ["packed words"]


def test_text_state():
    content = b"""BT /F1 10 Tf 2 Tc 3 Tw 200 Tz 50 700 Td (a b) Tj ET
    q 2 0 0 2 10 20 cm BT /F1 10 Tf 1 0 0 1 5 5 Tm 4 Ts (up) Tj ET Q
    BT /F1 10 Tf 14 TL 50 600 Td (one) Tj T* (two) Tj (three) ' 1 1 (four) " ET
    BT /F1 10 Tf 0 1 -1 0 300 300 Tm (turned) Tj ET BT 3 Tr /F1 10 Tf 50 100 Td (hidden) Tj ET
    /Span <</ActualText (spoken)/MCID 7>> BDC BT 0 Tr /F1 10 Tf 50 80 Td (sp) Tj (ok) Tj ET EMC
    BI /W 2 /H 2 ID \x00\x01(EI)\x02 EI BT /F1 10 Tf 50 60 Td (last) Tj ET"""
    d = pdfobjects.Document(file_of(content))
    found = {i.text: i for i in pdftext.read_page(d, 0).items}
    assert set(found) == {"a b", "up", "one", "two", "three", "four", "turned", "hidden", "spoken", "last"}
    a = found["a b"]
    assert (a.x, a.y, a.size) == (50, 700, 10) and a.width == pytest.approx(2 * (3 * (5 + 2) + 3))
    assert (found["up"].x, found["up"].y, found["up"].size) == (20, 38, 20)
    assert [found[t].y for t in ("one", "two", "three", "four")] == [600, 586, 572, 558]
    assert found["turned"].rotated and found["hidden"].hidden and found["spoken"].mcid == 7
    assert "hidden" not in texts(file_of(content))


def test_fonts():
    names = b"<</Type/Font/Subtype/Type1/BaseFont/ABCDEF+Times-BoldItalic/Encoding<</BaseEncoding/WinAnsiEncoding/Differences[65/eacute/Scaron/fi/uni20AC/f_l 200/a.alt]>>>>"
    assert texts(file_of(b"BT /F1 10 Tf 50 700 Td (ABCDE\\310\\223) Tj ET", font=names)) == ["éŠfi€fla“"]
    d = pdfobjects.Document(file_of(b"BT /F1 10 Tf 50 700 Td (x) Tj ET", font=names))
    item = pdf.items(d, 0)[0]
    assert item.bold and item.italic and item.font == "Times-BoldItalic"
    cmap = b"1 begincodespacerange <0000> <FFFF> endcodespacerange 1 beginbfchar <0003> <0041> endbfchar 2 beginbfrange <0010> <0012> <0061> <0020> <0021> [<0066006C> <D83DDE00>] endbfrange"
    wide = b"<</Type/Font/Subtype/Type0/BaseFont/X/Encoding/Identity-H/ToUnicode 6 0 R/DescendantFonts[<</Type/Font/Subtype/CIDFontType2/DW 900/W[3[250] 16 18 400]>>]>>"
    data = file_of(b"BT /F1 10 Tf 50 700 Td <0003001000110012002000210099> Tj ET", font=wide, extra=b"<</Length %d>>stream\n" % len(cmap) + cmap + b"\nendstream")
    item = pdf.items(pdfobjects.Document(data), 0)[0]
    assert item.text == "Aabcfl😀" and item.width == pytest.approx(10 * (0.25 + 3 * 0.4 + 3 * 0.9))
    assert pdftext.base_encoding("MacRomanEncoding")[0x8E] == "é" and pdftext.base_encoding(None)[0xAE] == "fi"


def test_forms_and_graphics():
    form = b"<</Type/XObject/Subtype/Form/Matrix[1 0 0 1 100 0]/Resources<</Font<</F1 5 0 R>>>>/Length 58>>stream\nBT /F1 10 Tf 10 20 Td (inside) Tj ET 0 0 30 40 re f /X1 Do \nendstream"
    content = b"q 1 0 0 1 5 5 cm /X1 Do Q 10 10 m 110 10 l 110 60 l h S 0 0 20 20 re W n 50 50 -20 10 re B"
    page = pdftext.read_page(pdfobjects.Document(file_of(content, extra=form, resources=b"/XObject<</X1 6 0 R>>")), 0)
    assert [(i.text, i.x, i.y) for i in page.items] == [("inside", 115, 25)]
    assert page.rects == [(105, 5, 30, 40, "fill"), (0, 0, 20, 20, "clip"), (30, 50, 20, 10, "both")]
    assert page.segments == [(10, 10, 110, 10), (110, 10, 110, 60), (110, 60, 10, 10)]


def test_relations_and_bad_files(spark):
    rows = [("good", file_of(b"BT /F1 10 Tf 50 700 Td (hello) Tj ET")), ("bad", b"nothing"), ("none", None), ("locked", locked("V2", b"x"))]
    files = spark.createDataFrame(rows, "path string, content binary")
    got = {r.doc_id: (r.text, r.error) for r in pdf.pdf_items(files).collect()}
    assert got == {"good": ("hello", None), "bad": (None, "malformed"), "none": (None, "malformed"), "locked": (None, "encrypted")}
    facts = {r.doc_id: r for r in pdf.pdf_pages(files).collect()}
    assert (facts["good"].characters, facts["good"].text_operators, facts["good"].ocr_reasons, facts["bad"].error) == (5, 1, [], "malformed")


def test_rules():
    assert tables.snapped([108, 100, 106, 102, 104], 3) == [100, 104, 108]
    rules = [(100.0, 0, 50), (99.0, 54, 90), (98.2, 200, 220), (97.5, 0, 10)]
    assert tables.merged_rules(rules) == [(pytest.approx(99.0666666), 0, 90), (pytest.approx(99.0666666), 200, 220), (97.5, 0, 10)]
    groups = tables.spans_of([(10, 0, 100), (20, 3, 104), (30, 50, 100), (40, 7, 107)])
    assert [[r[0] for r in g] for g in groups] == [[40, 20, 10], [30]]


def test_rect_grids():
    rects = [(50.0 + 100 * c, 700.0 - 30 * r, 100.0, 30.0) for r in range(4) for c in range(2)]
    items = [(f"r{r}c{c}", 60.0 + 100 * c, 710.0 - 30 * r, 30.0) for r in range(4) for c in range(2)]
    table = tables.rect_table(items, rects)
    assert table.cells == [[f"r{r}c{c}" for c in range(2)] for r in range(4)] and len(table.members) == 8
    spanned = tables.gathered_spans([["a", "b"], ["", "c"], ["d", "e"]], [0, 50, 100], [90, 60, 30, 0], [(0, 0, 50, 60)])
    assert spanned == [["a", "b"], ["d", "c"], ["", "e"]]
    assert tables.rect_table(items, rects[:4]) is None  # two rows only
    assert tables.rect_table([], rects) is None
    far = rects + [(1000.0 + x, y, w, h) for x, y, w, h in rects]
    assert [len(c) for c in tables.rect_clusters(far)] == [8, 8]
    left, right = tables.split_cluster(far, 20, 6)
    assert (len(left), len(right)) == (8, 8)
    assert tables.split_cluster(rects, 20, 6) is None
    shaded = tables.prepared_rects([*rects, (52.0, 702.0, 90.0, 24.0), (60.0, 700.0, 2.0, 2.0), (150.0, 730.0, -100.0, -30.0)])
    assert (52.0, 702.0, 90.0, 24.0) not in shaded and (50.0, 700.0, 100.0, 30.0) in shaded


def test_best_tables_share_no_item():
    small, large, other = tables.Table([], [], [["a", "b"]], [0, 1]), tables.Table([], [], [["a", "b"], ["c", "d"]], [0, 1, 2, 3]), tables.Table([], [], [["x", ""]], [9])
    assert tables.best_tables([small, large, other]) == [large, other]


def test_table_markdown():
    cells = [["Name", "Notes", "Qty"], ["Bolt", "a long piece of", "4"], ["", "descriptive text that goes on", ""], ["", "", ""], ["Nut", "short", "5"], ["(1) a footnote", "", ""]]
    assert tables.table_markdown(cells) == "|Name|Notes|Qty|\n|---|---|---|\n|Bolt|a long piece of descriptive text that goes on|4|\n|Nut|short|5|\n\n(1) a footnote\n"
    assert tables.table_markdown([["Introduction", "1"], ["Methods", "12"], ["Results", "30"]]) == "Introduction\t1\nMethods\t12\nResults\t30\n"
    assert tables.table_markdown([]) == "" and tables.table_markdown([["", ""]]) == ""


def test_line_predicates(spark):
    from pyspark.sql import functions as F

    lines = {"Table 3": True, "table  (4) totals": True, "Tables 3": False, "Table of": False}
    df = spark.createDataFrame([(t,) for t in lines], "t string")
    assert {r.t: r.v for r in df.select("t", tables.is_numbered_caption(F.col("t")).alias("v")).collect()} == lines
    notes = {"(1) x": True, "() x": True, "12) y": True, "Note: z": True, "notes: q": True, "Noted": False, "1. x": False}
    df = spark.createDataFrame([(t,) for t in notes], "t string")
    assert {r.t: r.v for r in df.select("t", tables.is_footnote(F.col("t")).alias("v")).collect()} == notes
