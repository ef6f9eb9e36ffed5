"""Readers on files that the tests make themselves."""

import io
import struct
import zipfile
import zlib

import duckdb
import pytest

from inkwell.plans import queries as plans
from inkwell.sources import convert, delimited, html, legacy, model, pdf
from inkwell.streaming import files

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def package(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


def word(body, **extra):
    return package({"word/document.xml": f"<w:document {W}><w:body>{body}</w:body></w:document>", **extra})


def test_word_document():
    styles = f'<w:styles {W}><w:style w:styleId="H"><w:name w:val="heading 2"/></w:style></w:styles>'
    numbering = f'<w:numbering {W}><w:abstractNum w:abstractNumId="0"><w:lvl w:ilvl="0"><w:start w:val="3"/><w:numFmt w:val="decimal"/></w:lvl></w:abstractNum><w:num w:numId="1"><w:abstractNumId w:val="0"/></w:num></w:numbering>'
    item = '<w:p><w:pPr><w:numPr><w:ilvl w:val="0"/><w:numId w:val="1"/></w:numPr></w:pPr><w:r><w:t>{}</w:t></w:r></w:p>'
    body = (
        '<w:p><w:pPr><w:pStyle w:val="H"/></w:pPr><w:r><w:rPr><w:b/></w:rPr><w:t>Title</w:t></w:r></w:p>'
        '<w:p><w:r><w:t xml:space="preserve">plain </w:t></w:r><w:r><w:rPr><w:b/></w:rPr><w:t>bold</w:t></w:r><w:r><w:t xml:space="preserve"> 1*2*3</w:t></w:r></w:p>'
        + item.format("one") + item.format("two")
        + "<w:tbl><w:tr><w:tc><w:p><w:r><w:t>k</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>v</w:t></w:r></w:p></w:tc></w:tr><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>1</w:t></w:r></w:p></w:tc></w:tr></w:tbl>"
    )
    data = word(body, **{"word/styles.xml": styles, "word/numbering.xml": numbering})
    assert convert.markdown(data) == ("docx", "## Title\n\nplain **bold** 1\\*2\\*3\n\n3. one\n4. two\n\n| k | v |\n| --- | --- |\n| a | 1 |\n")


def test_workbook():
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    data = package({
        "xl/workbook.xml": f'<workbook {ns}><sheets><sheet name="S" sheetId="1" r:id="r1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/sharedStrings.xml": f"<sst {ns}><si><t>day</t></si><si><t>n</t></si></sst>",
        "xl/styles.xml": f'<styleSheet {ns}><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>',
        "xl/worksheets/sheet1.xml": f'<worksheet {ns}><sheetData><row r="2"><c r="B2" t="s"><v>0</v></c><c r="C2" t="s"><v>1</v></c></row><row r="3"><c r="B3" s="1"><v>45000</v></c><c r="C3"><v>0.1</v></c></row></sheetData></worksheet>',
    })
    assert convert.markdown(data) == ("xlsx", "| day | n |\n| --- | --- |\n| 2023-03-15 | 0.1 |\n")


def test_slides():
    ns = 'xmlns:p="p" xmlns:a="a" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    para = "<a:p><a:r><a:t>{}</a:t></a:r></a:p>"
    data = package({
        "ppt/presentation.xml": f'<p:presentation {ns}><p:sldIdLst><p:sldId id="1" r:id="r1"/></p:sldIdLst></p:presentation>',
        "ppt/_rels/presentation.xml.rels": '<Relationships><Relationship Id="r1" Target="slides/slide1.xml"/></Relationships>',
        "ppt/slides/slide1.xml": f'<p:sld {ns}><p:sp><p:nvPr><p:ph type="title"/></p:nvPr>{para.format("Head")}</p:sp><p:sp><p:nvPr><p:ph idx="1"/></p:nvPr>{para.format("x")}{para.format("y")}</p:sp></p:sld>',
    })
    assert convert.markdown(data) == ("pptx", "## Head\n\n- x\n- y\n")


def test_open_document():
    ns = 'xmlns:office="o" xmlns:text="t" xmlns:style="s" xmlns:fo="f" xmlns:table="b"'
    content = f'<office:document-content {ns}><office:automatic-styles><style:style style:name="B"><style:text-properties fo:font-weight="bold"/></style:style></office:automatic-styles><office:body><office:text><text:h text:outline-level="1">T</text:h><text:p>a <text:span text:style-name="B">b</text:span></text:p><text:list><text:list-item><text:p>i</text:p></text:list-item></text:list></office:text></office:body></office:document-content>'
    data = package({"mimetype": "application/vnd.oasis.opendocument.text", "content.xml": content})
    assert convert.markdown(data) == ("odt", "# T\n\na **b**\n\n- i\n")


def test_epub():
    data = package({
        "mimetype": "application/epub+zip",
        "META-INF/container.xml": '<container><rootfiles><rootfile full-path="OEBPS/b.opf"/></rootfiles></container>',
        "OEBPS/b.opf": '<package><manifest><item id="c" href="c.xhtml" media-type="application/xhtml+xml"/></manifest><spine><itemref idref="c"/></spine></package>',
        "OEBPS/c.xhtml": "<html><body><h1>C</h1><p>text</p></body></html>",
    })
    assert convert.markdown(data) == ("epub", "# C\n\ntext\n")


def test_rich_text():
    data = rb"{\rtf1\ansi{\stylesheet{\s1 heading 1;}}\pard\s1 Head\par\pard caf\'e9 {\b bold} \u8212?x\par{\*\generator z;}\trowd\intbl a\cell b\cell\row\trowd\intbl 1\cell 2\cell\row\pard end\par}"
    kind, text = convert.markdown(data)
    assert kind == "rtf"
    assert text == "# Head\n\ncafé **bold** —x\n\n| a | b |\n| --- | --- |\n| 1 | 2 |\n\nend\n"


def page_file(content, compressed=True):
    body = zlib.compress(content) if compressed else content
    extra = b"/Filter /FlateDecode" if compressed else b""
    objects = [b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [3 0 R] /Count 1 >>", b"<< /Type /Page /Contents 4 0 R >>", b"<< /Length %d %s >>\nstream\n%s\nendstream" % (len(body), extra, body)]
    return b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (i + 1, o) for i, o in enumerate(objects)) + b"%%EOF"


@pytest.mark.parametrize("compressed", [True, False])
def test_page_file(compressed):
    lines = b"".join(b"1 0 0 1 72 %d Tm (line %d of the text) Tj " % (680 - 14 * i, i) for i in range(4))
    data = page_file(b"BT /F1 24 Tf 1 0 0 1 72 720 Tm (Title) Tj /F1 12 Tf " + lines + b"ET", compressed)
    assert convert.markdown(data) == ("pdf", "# Title\n\nline 0 of the text line 1 of the text line 2 of the text line 3 of the text\n")
    assert pdf.inspect(data)["kind"] == "text"


def compound(streams):
    """A compound file of large streams (4096 bytes at least, 512-byte sectors)."""
    bodies = [(n, b.ljust(4096, b"\0")) for n, b in streams.items()]
    bodies = [(n, b.ljust(-(-len(b) // 512) * 512, b"\0")) for n, b in bodies]
    entries, chain, sectors = [], [], b""

    def add(data):
        nonlocal sectors
        first = len(chain)
        count = len(data) // 512
        chain.extend([*range(first + 1, first + count), 0xFFFFFFFE])
        sectors += data
        return first

    def entry(name, kind, start, size):
        raw = name.encode("utf-16-le") + b"\0\0"
        return raw.ljust(64, b"\0") + struct.pack("<HBB", len(raw), kind, 1) + struct.pack("<III", *[0xFFFFFFFF] * 3) + b"\0" * 36 + struct.pack("<IQ", start, size)

    for name, body in bodies:
        entries.append(entry(name, 2, add(body), len(body)))
    directory = b"".join([entry("Root Entry", 5, 0xFFFFFFFE, 0), *entries])
    at = add(directory.ljust(-(-len(directory) // 512) * 512, b"\0"))
    table = len(chain)
    chain.append(0xFFFFFFFD)
    sectors += struct.pack("<128I", *chain, *[0xFFFFFFFF] * (128 - len(chain)))
    head = legacy.SIGNATURE + b"\0" * 16 + struct.pack("<HHHHH", 0x3E, 3, 0xFFFE, 9, 6) + b"\0" * 6 + struct.pack("<III", 0, 1, at) + struct.pack("<I", 0) + struct.pack("<IIIII", 4096, 0xFFFFFFFE, 0, 0xFFFFFFFE, 0)
    return head + struct.pack("<109I", table, *[0xFFFFFFFF] * 108) + sectors


def test_word_97():
    text = "First line\rk\x07v\x07\x07a\x071\x07\x07Last é\r"
    word = bytearray(0x400 + 2 * len(text))
    struct.pack_into("<H", word, 10, 0x200)
    struct.pack_into("<I", word, 0x4C, len(text))
    word[0x400:] = text.encode("utf-16-le")
    pieces = struct.pack("<II", 0, len(text)) + struct.pack("<HIH", 0, 0x400, 0)
    clx = b"\x02" + struct.pack("<I", len(pieces)) + pieces
    struct.pack_into("<II", word, 0x1A2, 0, len(clx))
    data = compound({"WordDocument": bytes(word), "1Table": clx})
    assert convert.markdown(data) == ("doc", "First line\n\n| k | v |\n| --- | --- |\n| a | 1 |\n\nLast é\n")


def test_workbook_97():
    def record(kind, body):
        return struct.pack("<HH", kind, len(body)) + body

    def text(x):
        return struct.pack("<HB", len(x), 0) + x.encode()

    strings = record(0xFC, struct.pack("<II", 2, 2) + text("day") + text("n"))
    styles = record(0xE0, struct.pack("<HH", 0, 0)) + record(0xE0, struct.pack("<HH", 0, 14))
    sheet = record(0x809, b"\0" * 16) + record(0xFD, struct.pack("<HHHI", 0, 0, 0, 0)) + record(0xFD, struct.pack("<HHHI", 0, 1, 0, 1)) + record(0x203, struct.pack("<HHHd", 1, 0, 1, 45000.0)) + record(0x27E, struct.pack("<HHHI", 1, 1, 0, (7 << 2) | 2)) + record(0x0A, b"")
    front = len(record(0x809, b"\0" * 16) + record(0x85, b"\0" * 9) + strings + styles + record(0x0A, b""))
    book = record(0x809, b"\0" * 16) + record(0x85, struct.pack("<IBB", front, 0, 0) + b"\x01\0S") + strings + styles + record(0x0A, b"") + sheet
    assert convert.markdown(compound({"Workbook": book})) == ("xls", "| day | n |\n| --- | --- |\n| 2023-03-15 | 7 |\n")


def test_slides_97():
    def record(kind, body, version=0):
        return struct.pack("<HHI", version, kind, len(body)) + body

    inner = record(3999, struct.pack("<I", 0)) + record(4008, b"Head") + record(3999, struct.pack("<I", 1)) + record(4000, "x\ry".encode("utf-16-le"))
    assert convert.markdown(compound({"PowerPoint Document": record(1006, inner, 15)})) == ("ppt", "## Head\n\n- x\n- y\n")


def test_delimited():
    assert delimited.records('a,"b ""c"", d",e\r\n\r\n"x"y,z', ",") == [["a", 'b "c", d', "e"], ["xy", "z"]]
    assert delimited.sniff("a;b;c\n1,5;2;3\n") == ";"
    assert delimited.decode(b"\xff\xfea\x00") == "a" and delimited.decode(b"caf\xe9") == "café"
    assert convert.markdown(b"Kind,Value\nx,1\ny,2\n", "t.csv") == ("csv", "| Kind | Value |\n| --- | --- |\n| x | 1 |\n| y | 2 |\n")


def test_html():
    page = '<!DOCTYPE html><title>no</title><script>var t="</p>";</script><h1>A &amp; B</h1><p>one<br>two <b>x</b><p>three <a href="/u v">l</a><ul><li>a<ul><li>b</li></ul></li><li>c</ul><blockquote>q</blockquote><pre>c`d</pre><table><tr><th>h</th></tr><tr><td>1</td></tr></table>'
    assert convert.markdown(page.encode())[1] == "# A & B\n\none\ntwo **x**\n\nthree [l](</u v>)\n\n- a\n  - b\n- c\n\n> q\n\n```\nc`d\n```\n\n| h |\n| --- |\n| 1 |\n"
    assert html.read_text("") == []


def test_html_references_end_at_a_semicolon():
    first = lambda text: "".join(r.text for r in html.read_text(text)[0].runs)
    assert [first(f"<h1>a{x}</h1>") for x in ("&amp;&amp", "&am", "&", "&ampx;", "&#38", "&#38;&#x27;&quot;", "&amp;lt;", "&eacute;&copy")] == ["a&&amp", "a&am", "a&", "a&ampx;", "a&#38", "a&'\"", "a&lt;", "aé&copy"]
    assert html.read_text('<p><a href="/x?a=1&copy=2&amp;b">l</a>')[0].runs[0].link == "/x?a=1&copy=2&b"


def test_page_blocks_has_a_row_for_every_page(spark, tmp_path):
    texts = ["<h1>a &amp;&amp</h1><ul><li>x</li></ul>", "", None, "<p>no title</p>", "<h1></h1>", "<h1>b</h1><h1>c</h1>"]
    spark.createDataFrame([(i, "u", t) for i, t in enumerate(texts)], "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    got = [tuple(r) for r in plans.QUERIES["page_blocks"](spark, str(tmp_path)).orderBy("page_id").collect()]
    assert got == duckdb.sql(plans.ORACLES["page_blocks"].replace("FROM pages", f"FROM '{tmp_path}/pages.parquet/*.parquet' ORDER BY page_id")).fetchall()
    assert got[:3] == [(0, "a &&amp", 1), (1, "", 0), (2, None, None)]
    blocks = convert.html_blocks(spark.createDataFrame([("p", texts[0]), ("q", None)], "k string, t string"), "k", "t")
    assert [tuple(r) for r in blocks.collect()] == [("p", 0, "heading", 1, "a &&amp", "# a &&amp\n"), ("p", 1, "item", 0, "x", "- x\n")]


def test_escapes():
    assert model.escape("# x", True) == "\\# x" and model.escape("1. x", True) == "1\\. x" and model.escape("a_b_c") == "a_b_c"
    assert model.escape("*a*") == "\\*a\\*" and model.escape("a | b", cell=True) == "a \\| b" and model.escape("[x](y)") == "\\[x](y)"
    assert model.escape("&amp; & &x") == "&amp;amp; & &x" and model.escape("<b> < c") == "\\<b> < c" and model.escape("a\\b") == "a\\\\b"


def test_errors_are_rows(spark):
    bad = [("x.docx", b"PK\x03\x04broken"), ("y.bin", b"??"), ("z.pdf", b"%PDF-1.4 nothing"), ("e.docx", word("").replace(b"document", b"documenx")), (None, None)]
    rows = convert.convert(spark.createDataFrame(bad, "path string, content binary")).collect()
    assert len(rows) == 5 and all(r.markdown is None and r.error_code for r in rows)
    seen = convert.inspect_pdf(spark.createDataFrame([("a", page_file(b"BT (x) Tj ET")), ("b", b"no")], "path string, content binary")).collect()
    assert {r.doc_id: (r.kind, r.error_code) for r in seen} == {"a": ("text", None), "b": (None, "malformed")}


def test_stream_equals_batch(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for i in range(3):
        (folder / f"{i}.csv").write_bytes(b"a,b\n%d,2\n" % i)
    files.write(files.arriving(spark, str(folder)), str(tmp_path / "out"), str(tmp_path / "state"), once=True).awaitTermination(120)
    streamed = {r.markdown for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert streamed == {r.markdown for r in convert.read_files(spark, str(folder)).collect()} and len(streamed) == 3


def test_sql_functions(spark):
    convert.register(spark)
    frame = spark.createDataFrame([(b"a,b\n1,2\n", "t.csv"), (b"PK\x03\x04", "x.docx"), (None, None)], "content binary, name string")
    frame.createOrReplaceTempView("some_files")
    rows = spark.sql("SELECT detect_format(content, name) AS f, to_markdown(content, name) AS m, md_escape(name) AS e FROM some_files").collect()
    assert [r.f for r in rows] == ["csv", "docx", None]
    assert rows[0].m.startswith("| a | b |") and rows[1].m is None and rows[2].m is None and rows[2].e is None
