"""Column functions on single values."""

import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from inkwell.functions import markdown, quality, repair, sheet, text
from inkwell.operators import cells, pages, runs
from inkwell.operators import layout as ly
from inkwell.plans import queries as plans


def one(spark, function, *values):
    frame = spark.createDataFrame([(v,) for v in values], "v string")
    return [r[0] for r in frame.select(function(F.col("v"))).collect()]


def test_page_number_lines(spark):
    yes = ["1", "9999", "page 3", "Page of", "page", "Page 3 of 12", "3 of 12", "- 7 -", "-7-", "PAGE 1"]
    no = ["", "12345", "pages and more", "chapter 1", "3 of x", "--", "1.", "page x"]
    assert one(spark, repair.is_page_number, *yes) == [True] * len(yes)
    assert one(spark, repair.is_page_number, *no) == [False] * len(no)


def test_page_numbers_go_only_where_they_stand_alone(spark):
    assert one(spark, repair.remove_page_numbers, "a\n\n3\n\nb", "a\n3\nb", "7", "a\n4\n---\nb", "a\n4\n\n---", "x\r\n\r\n5\r\n\r\ny\n") == ["a\n\n\nb", "a\n3\nb", "", "a\n---\nb", "a\n\n---", "x\n\n\ny"]


def test_repairs(spark):
    assert one(spark, repair.fix_hyphenation, "a - b - c", "é - ü", "- item") == ["a-b - c", "é - ü", "- item"]
    assert one(spark, repair.close_punctuation, "a . b ,c ;", "x .|", "a ...") == ["a. b ,c;", "x.|", "a ..."]
    assert one(spark, repair.collapse_inner_spaces, "\n\na  b\n  c   d", "x") == ["a b\n  c d", "x"]
    assert one(spark, lambda c: repair.clean_markdown(c, True), "a ...... 5\n\n\n\nb  c .\n\n12\n") == ["a ... 5\n\nb c.\n"]
    assert one(spark, repair.normal_line, " 12 Annual  Report 7 ", "3", "no digits") == ["Annual Report", "", "no digits"]


def test_text(spark):
    assert one(spark, text.clean_text, "a b­c\r\nd\re\tf\x07", "​﻿") == ["a bc d e\tf", ""]
    assert one(spark, text.lines, "a\r\nb\n", "", "\n", "a\n\nb") == [["a", "b"], [], [""], ["a", "", "b"]]
    assert one(spark, text.parses_as_float, "1", "-.5e3", "+1.", "1e", "0x1", "", "inf") == [True, True, True, False, False, False, True]
    assert one(spark, text.is_absolute_uri, "http://x", "C:\\x", "c:/x", "mailto:a", "/x") == [True, False, False, True, False]


def test_markdown(spark):
    assert one(spark, markdown.slug, "Hello, World!", " A_b – c ", "!!!", "Über 2") == ["hello-world", "a_b--c", "section", "über-2"]
    assert one(spark, markdown.sanitize_id, "A b--C!", "??", "x_1") == ["a-b-c", "anchor", "x_1"]
    assert one(spark, markdown.code_span, "a", "`a", "a``b") == ["`a`", "`` `a ``", "```a``b```"]
    assert one(spark, markdown.format_url, "a b", "x<|>", "p(q)", "plain") == ["<a b>", "x%3C%7C%3E", "<p(q)>", "plain"]


def test_quality(spark):
    english = "The quick brown fox jumps over the lazy dog and runs into the woods near the river. " * 6
    shifted = english.translate({**{97 + i: 97 + (i + 3) % 26 for i in range(26)}, **{65 + i: 65 + (i + 3) % 26 for i in range(26)}})
    assert one(spark, quality.looks_garbled, english, shifted, "short") == [False, True, False]
    assert one(spark, quality.dollar_as_space, "a$b$c$d$e$f$g$h$i$j$k$l$m", "$1 $2 $3") == [True, False]
    assert one(spark, quality.has_replacement_run, "a��b", "a�b", "�x�x�") == [True, False, True]
    assert one(spark, quality.has_private_run, "\ue000\ue001\ue002", "a\ue000", "plain") == [True, False, False]
    assert one(spark, quality.is_garbage, "=+" * 40, "words " * 20, "." * 200) == [True, False, False]
    assert one(spark, quality.span_issue, "", "fine text", "��") == [None, None, "replacement"]


def test_sheet(spark):
    assert one(spark, sheet.format_class, "[h]:mm", "yyyy", "0.00", '"day"0', "h AM/PM", "[Red]0;d", "\\d0") == ["timeDelta", "dateTime", "other", "other", "dateTime", "other", "other"]
    frame = spark.createDataFrame([(0.5,), (45000.0,), (45000.75,), (59.0,), (1.0,)], "v double")
    assert [r[0] for r in frame.select(sheet.serial_text(F.col("v"))).collect()] == ["12:00:00", "2023-03-15", "2023-03-15 18:00:00", "1900-02-28", "1900-01-01"]
    frame = spark.createDataFrame([(1,), (26,), (27,), (702,), (703,)], "v long")
    assert [r[0] for r in frame.select(sheet.column_letters(F.col("v"))).collect()] == ["A", "Z", "AA", "ZZ", "AAA"]
    assert one(spark, sheet.column_number, "A", "zz", "AAA") == [1, 702, 703]


@pytest.mark.parametrize("rows,expected", [
    ([["name", "n"], ["x", "1"], ["y", "2"]], 1),
    ([["4", "5"], ["3", "1"], ["2", "2"]], 0),
    ([["a", "b"], ["a", "c"], ["d", "b"]], 0),
    ([["only", "row"]], 0),
    ([["a", ""], ["1", "2"]], 0),
    ([["same", "same"], ["1", "2"]], 0),
])
def test_header_votes_agree_in_both_forms(spark, rows, expected):
    from inkwell.sources.model import header_rows

    frame = spark.createDataFrame([("t", r, c, v) for r, row in enumerate(rows) for c, v in enumerate(row)], "table_id string, row int, col int, text string")
    assert cells.header_rows(frame).first().header_rows == expected == header_rows(rows)


def test_tables_render_ragged_rows(spark):
    rows = [(0, 0, "a|b"), (0, 1, "c"), (1, 0, "x\n\n y "), (2, 0, ""), (2, 1, " "), (0, 2, "")]
    frame = spark.createDataFrame([("t", *r) for r in rows], "table_id string, row int, col int, text string")
    assert cells.render_tables(frame).first().markdown == "|  |  |\n| --- | --- |\n| a\\|b | c |\n| x<br>y |  |".replace("|  |  |\n| ---", "|  |  |\n| ---")


def plain_repeats(lines):
    """Which of (page, line, y, text) are running headers, step by step."""
    norm = lambda t: re.sub("[0-9]+$", "", re.sub("^[0-9]+", "", " ".join(t.split())).strip()).strip()
    by_page = {}
    for p, _, y, _ in lines:
        by_page.setdefault(p, set()).add(y)
    span = max(sum(max(ys) - min(ys) for ys in by_page.values()) / len(by_page), 1)

    def edge(p, y):
        ys = sorted(by_page[p])
        place = next(i for i, v in enumerate(ys) if abs(v - y) < 0.1)
        return len(ys) <= 10 or place < 5 or place >= len(ys) - 5

    def running(found):
        out = {}
        for text, places in found.items():
            heights = [y for _, y in places]
            mean = sum(heights) / len(heights)
            level = len(heights) < 2 or (sum((h - mean) ** 2 for h in heights) / len(heights)) ** 0.5 / span < 0.05
            structural = re.match(r"#|[-*•] ", text) or (re.match("[0-9]", text) and (". " in text or ") " in text))
            if len(text.encode()) >= 10 and len(set(text)) > 1 and not structural and level and len(by_page) >= 3 and len({p for p, _ in places}) >= max(3, len(by_page) * 30 // 100):
                out[text] = min(p for p, _ in places)
        return out

    bands = {}
    for i, (p, _, y, _) in enumerate(lines):
        bands.setdefault((p, round(y * 10)), []).append(i)
    single, joined = {}, {}
    for p, _, y, t in lines:
        if edge(p, y):
            single.setdefault(norm(t), []).append((p, y))
    text_of = lambda members: norm(" ".join(lines[i][3] for i in members))
    for (p, _), members in bands.items():
        if len(members) > 1 and edge(p, lines[members[0]][2]):
            joined.setdefault(text_of(members), []).append((p, lines[members[0]][2]))
    one, many = running(single), running(joined)
    gone = {i for i, (p, _, y, t) in enumerate(lines) if edge(p, y) and p > one.get(norm(t), p)}
    for (p, _), members in bands.items():
        if edge(p, lines[members[0]][2]):
            if (len(members) > 1 and p > many.get(text_of(members), p)) or gone & set(members):
                gone |= set(members)
    return [i in gone for i in range(len(lines))]


def test_running_headers_step_by_step(spark):
    r = random.Random(12)
    rows = []
    for doc in range(12):
        for page in range(1, r.randint(2, 9)):
            texts = [(0, 700.0, r.choice(["Left", "Annual Report"])), (1, 700.02, r.choice(["half of it", "half of it", "other"])), (2, 690.0, "A title that runs on"), (3, 10.0 + r.choice([0, 0, 0.05]), f"{page} of the whole report"), (4, 5.0, "-----------"), (5, 4.0, "# heading runs here")]
            texts += [(6 + i, 600.0 - 13 * i, r.choice(["body text here", f"line {i} of page {page} here"])) for i in range(r.randint(0, 14))]
            rows += [(doc, page, *t) for t in texts if r.random() < 0.9]
    got = {(x.doc_id, x.page, x.line): x.removed for x in pages.repeated_lines(spark.createDataFrame(rows, "doc_id int, page int, line int, y double, text string")).collect()}
    for doc in range(12):
        own = [row[1:] for row in rows if row[0] == doc]
        if own:
            assert [got[doc, p, line] for p, line, _, _ in own] == plain_repeats(own)
    assert 20 < sum(got.values()) < len(got) - 20


def test_snapped_edges_compare_with_the_last_one_kept(spark):
    edges = [("d", 0, "x", p) for p in (100.0, 102.0, 104.0, 106.0, 108.0, 100.0)]
    got = ly.snap_edges(spark.createDataFrame(edges, "doc_id string, page int, axis string, position double"), 3.0).orderBy("position").collect()
    assert [(r.position, r.n) for r in got] == [(100.0, 3), (104.0, 2), (108.0, 1)]


def test_claimed_ids_avoid_taken_ones(spark):
    frame = spark.createDataFrame([("d", i, b) for i, b in enumerate(["a", "a", "a-1", "a", "b"])], "doc_id string, seq long, base string")
    assert [r.id for r in sorted(runs.claim_ids(frame).collect(), key=lambda r: r.seq)] == ["a", "a-1", "a-1-1", "a-2", "b"]


def letters_of(n):
    out = ""
    while n > 0:
        n, rest = divmod(n - 1, 26)
        out = chr(97 + rest) + out
    return out


def roman_of(n):
    out = ""
    for v, x in zip((1000, 900, 500, 400, 100, 90, 50, 40, 10, 9, 5, 4, 1), ("m", "cm", "d", "cd", "c", "xc", "l", "xl", "x", "ix", "v", "iv", "i")):
        out, n = out + x * (n // v), n % v
    return out


def test_markers_of_any_number(spark):
    numbers = [*range(1, 20001), 18278, 18279, 475254, 475255, 2**31, 2**53 + 1, 2**63 - 1]
    frame = spark.createDataFrame([(n,) for n in numbers], "n long")
    n = F.col("n")
    for row in frame.select("n", markdown.alpha_marker(n).alias("alpha"), markdown.roman_marker(n).alias("roman"), sheet.column_letters(n).alias("letters")).collect():
        assert (row.alpha, row.letters) == (letters_of(row.n), letters_of(row.n).upper())
        assert row.roman == (roman_of(row.n) if row.n <= 3999 else str(row.n))
    edge = spark.createDataFrame([(0,), (None,)], "n long")
    assert [tuple(r) for r in edge.select(markdown.alpha_marker(n), markdown.roman_marker(n)).collect()] == [("0", "0"), (None, None)]


def test_marker_queries_without_bound_read_every_part(spark, tmp_path):
    spark.range(1, 5001).selectExpr("id as p_partkey", "cast(id % 50 as int) as p_size").write.parquet(f"{tmp_path}/part.parquet")
    got = {r.k: (r.roman, r.alpha) for r in plans.QUERIES["list_markers"](spark, str(tmp_path)).collect()}
    assert got == {k: (roman_of(k) if k <= 3999 else str(k), letters_of(k)) for k in range(1, 5001)}
    got = {r.p_partkey: (r.letters, r.number) for r in plans.QUERIES["sheet_formats"](spark, str(tmp_path)).collect()}
    assert got == {k: (letters_of(k).upper(), k) for k in range(1, 5001)}


def brute_gutters(words):
    """Gutters of one page of (x, y, width), point by point."""
    low, high = min(x for x, _, _ in words), max(x + w for x, _, w in words)
    if high - low < 200 or len(words) < 20:
        return []
    narrow = [(x, y, w) for x, y, w in words if w <= 0.6 * (high - low)]
    count = [sum(int((x - low) / 2) <= b <= int((x + w - low) / 2) for x, _, w in narrow) for b in range(int((high - low) / 2) + 2)]
    height, found, b = max(y for _, y, _ in words) - min(y for _, y, _ in words) or 1e-9, [], 0
    while b < len(count):
        e = b
        while e < len(count) and count[e] <= int(max(count) * 0.15):
            e += 1
        middle = low + (b + e) / 2 * 2
        if (e - b) * 2 >= 8 and 0.05 * (high - low) < middle - low < 0.95 * (high - low):
            sides = [[y for x, y, w in narrow if (x + w / 2 < middle) == left] for left in (True, False)]
            if all(len(s) >= 10 and (max(s) - min(s)) / height >= 0.3 for s in sides):
                found.append(float(middle))
        b = max(e, b + 1)
    return found


def test_page_gutters_of_every_page(spark, tmp_path):
    sizes = {1: 450, 2: 60, 3: 7, 4: 200, 5: 213}
    rows = [(k, "s", "en", " ".join(f"w{i}" for i in range(n))) for k, n in sizes.items()]
    spark.createDataFrame(rows, "doc_id long, source string, lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    wanted = {}
    for k, n in sizes.items():
        for i in range(n):
            wanted.setdefault((k, i // 200), []).append((50.0 + i % 5 * 50 + (300 if i % 10 >= 5 else 0), 780.0 - i % 200 // 10 * 14, 40.0))
    got = {(r.doc_id, r.page): r.gutters for r in ly.column_gutters(plans._items(spark, str(tmp_path))).collect()}
    assert got == {k: brute_gutters(v) for k, v in wanted.items()}
    assert len(got) == 8 and len(got[2, 0]) > 1


def brute_lines(words):
    """(y, x, text) of the lines of (idx, text, x, y, width), item by item; blanks where a gap is 2 points."""
    lines = []
    for w in sorted(words, key=lambda w: (-w[3], w[2], w[0])):
        if not lines or lines[-1][0][3] - w[3] >= 3:
            lines.append([])
        lines[-1].append(w)
    out = []
    for own in lines:
        own = sorted(own, key=lambda w: (w[2], w[0]))
        text = own[0][1] + "".join((" " if b[2] - a[2] - a[4] >= 2 and b[1][0] not in ".,;" else "") + b[1] for a, b in zip(own, own[1:]))
        out.append((max(w[3] for w in own), own[0][2], text))
    return out


def test_grouped_lines_of_scattered_items(spark):
    random.seed(3)
    given = {(d, p): [(i, random.choice(["Ab", "Cde", ",x", "F9f"]), float(random.randrange(0, 60, 4)), random.randrange(0, 400) / 8, random.choice([2.0, 4.0, 9.0])) for i in range(n)] for d, p, n in [("a", 0, 60), ("a", 1, 1), ("b", 0, 90), (None, 2, 7)]}
    rows = [(d, p, i, t, x, y, w, 10.0, i % 2 == 0) for (d, p), ws in given.items() for i, t, x, y, w in ws]
    random.shuffle(rows)
    items = spark.createDataFrame(rows, "doc_id string, page int, idx int, text string, x double, y double, width double, font_size double, bold boolean")
    wide = lambda gap, size, left, right: (gap >= 2) & ~right.rlike("^[.,;]")
    got = {}
    for r in ly.group_lines(ly.by_page(items), wide).orderBy("doc_id", "page", "line").collect():
        got.setdefault((r.doc_id, r.page), []).append((r.y, r.x, r.text))
    assert got == {k: brute_lines(v) for k, v in given.items()}
    ruled = spark.createDataFrame([(1, 0, i, t, x, 5.0, 10.0, 10.0, i < 2) for i, (t, x) in enumerate([("one", 0.0), ("two", 12.0), (",", 24.0), ("far", 80.0), ("er", 91.0)])], "doc_id int, page int, idx int, text string, x double, y double, width double, font_size double, bold boolean")
    assert [tuple(r) for r in ly.group_lines(ly.by_page(ruled)).collect()] == [(1, 0, 0, 5.0, 0.0, 10.0, True, "one two, farer")]


def test_grouped_lines_equal_their_sql_on_odd_words(spark, tmp_path):
    texts = ["a , b . c ;d 'e )f !", "\ttab x\t\ty\n\n .z", "", None, "  ", " ".join(f".{i}" for i in range(431)), ", " * 200]
    rows = [(i, "s", "en", t) for i, t in enumerate(texts)] + [(5, "s", "en", texts[5]), (None, "s", "en", "n , m")]
    spark.createDataFrame(rows, "doc_id long, source string, lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {tuple(r) for r in plans.QUERIES["grouped_lines"](spark, str(tmp_path)).select("doc_id", "page", "n_lines", "first").collect()}
    sql = plans.ORACLES["grouped_lines"].replace("FROM documents", f"FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert got == set(duckdb.sql(sql).fetchall()) and len(got) == 7
