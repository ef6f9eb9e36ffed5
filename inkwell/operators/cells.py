"""Tables as long relations of cells: value kinds, header votes, Markdown.

A cell is (table_id, row, col, text) with rows and columns from 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.markdown import cell_text, table_row
from ..functions.text import parses_as_float, trim_space

CLOCK = r"[0-9]{1,2}:[0-9]{1,2}(:[0-9]{1,2}([.][0-9]+)?)?Z?"
DATE = r"([0-9]{1,4}-[0-9]{1,4}-[0-9]{1,4}|[0-9]{1,4}/[0-9]{1,4}/[0-9]{1,4}|[0-9]{1,4}\.[0-9]{1,4}\.[0-9]{1,4})"
#: Body rows that are looked at for a header: a label shows in the first ones.
SAMPLE_ROWS = 50


def kind_of(c: Column) -> Column:
    """number, bool, date, text, or null for a blank value."""
    t = trim_space(c)
    bare = F.regexp_replace(F.regexp_replace(t, "%$", ""), r"[, _\x{A0}]", "")
    number = bare.rlike("[0-9]") & parses_as_float(bare)
    date = t.rlike(f"^{DATE}([T ]({CLOCK})?)?$") | t.rlike(f"^{CLOCK}$")
    return F.when(t == "", None).when(number, "number").when(F.lower(t).isin("true", "false", "yes", "no"), "bool").when(date, "date").otherwise("text")


def column_kinds(cells: DataFrame) -> DataFrame:
    """(table_id, col, n_number, n_bool, n_date, n_text, dominant): the kind that
    nine tenths of a column's non-blank values share, in that order, or null."""
    counts = [F.sum((F.col("kind") == k).cast("long")).alias(f"n_{k}") for k in ("number", "bool", "date", "text")]
    # no filter on the kind, which would be worked out for it a second time
    sums = cells.select("table_id", "col", kind_of(F.col("text")).alias("kind")).groupBy("table_id", "col").agg(*[F.coalesce(c, F.lit(0)).alias(n) for c, n in zip(counts, ("n_number", "n_bool", "n_date", "n_text"))])
    sums = sums.filter("n_number + n_bool + n_date + n_text > 0")
    total = sum((F.col(f"n_{k}") for k in ("bool", "date", "text")), F.col("n_number"))
    dominant = F.coalesce(*[F.when(F.col(f"n_{k}") * 10 >= total * 9, F.lit(k)) for k in ("number", "bool", "date", "text")])
    return sums.withColumn("dominant", dominant)


def header_rows(cells: DataFrame) -> DataFrame:
    """(table_id, header_rows): 1 if the first row is a header by vote, else 0.

    The first row and up to ``SAMPLE_ROWS`` body rows are read.  The first row must be
    as wide as most of the others (the wider on a tie) and hold distinct one-line
    labels up to the last column with content, of which only the first may be blank.
    Each column votes: a
    typed column for the header if its label is text and against it otherwise; a
    text column against it if a value repeats the label.  Without any vote short
    labels are a header.
    """
    c = cells.filter(F.col("row") <= SAMPLE_ROWS).select("table_id", "row", "col", F.coalesce("text", F.lit("")).alias("text"))
    widths = c.groupBy("table_id", "row").agg((F.max("col") + 1).alias("width"), F.max(F.when(trim_space(F.col("text")) != "", F.col("col") + 1)).alias("filled"))
    tables = widths.groupBy("table_id").agg(F.count("*").alias("rows"), F.max(F.when(F.col("row") == 0, F.col("width"))).alias("head"), F.max("filled").alias("content"))
    body = widths.filter("row > 0").groupBy("table_id", "width").agg(F.count("*").alias("n"))
    modal = body.groupBy("table_id").agg(F.max(F.struct("n", "width")).alias("m")).select("table_id", F.col("m.width").alias("modal"))
    label = F.lower(trim_space(F.col("text")))
    heads = c.filter("row = 0").join(tables.select("table_id", "content"), "table_id").filter("col < content")
    heads = heads.select("table_id", "col", "text", label.alias("label"), kind_of(F.col("text")).alias("label_kind"))
    fit = heads.groupBy("table_id").agg(
        F.max(((F.col("label") == "") & (F.col("col") > 0)).cast("int")).alias("blank"),
        F.max(trim_space(F.col("text")).contains("\n").cast("int")).alias("tall"),
        F.count(F.when(F.col("label") != "", 1)).alias("labels"),
        F.count_distinct(F.when(F.col("label") != "", F.col("label"))).alias("distinct"),
        F.max(F.length(trim_space(F.col("text")))).alias("longest"),
    )
    values = c.filter("row > 0").join(heads.select("table_id", "col", "label"), ["table_id", "col"])
    same = values.groupBy("table_id", "col").agg(F.max((label == F.col("label")).cast("int")).alias("repeats"), F.max((trim_space(F.col("text")) != "").cast("int")).alias("any"))
    voters = heads.join(same.filter("any = 1"), ["table_id", "col"]).join(column_kinds(c.filter("row > 0")).select("table_id", "col", "dominant"), ["table_id", "col"])
    typed = F.col("dominant").isNotNull() & (F.col("dominant") != "text")
    up = F.sum(F.when(typed & (F.col("label_kind") == "text"), 1).otherwise(0)).alias("up")
    down = F.sum(F.when(typed & ~F.coalesce(F.col("label_kind") == "text", F.lit(False)), 1).when(~typed & (F.col("repeats") == 1), 1).otherwise(0)).alias("down")
    votes = voters.groupBy("table_id").agg(up, down)
    joined = tables.join(modal, "table_id", "left").join(fit, "table_id", "left").join(votes, "table_id", "left")
    plausible = (F.col("rows") >= 2) & (F.col("head") == F.col("modal")) & (F.coalesce("content", F.lit(0)) > 0) & (F.col("content") <= F.col("head")) & (F.col("blank") == 0) & (F.col("tall") == 0) & (F.col("labels") == F.col("distinct"))
    ups, downs = F.coalesce("up", F.lit(0)), F.coalesce("down", F.lit(0))
    voted = F.when((ups == 0) & (downs == 0), (F.col("longest") <= 64).cast("int")).otherwise((ups > downs).cast("int"))
    return joined.select("table_id", F.when(F.coalesce(plausible, F.lit(False)), voted).otherwise(0).alias("header_rows"))


def render_tables(cells: DataFrame, headers: DataFrame | None = None) -> DataFrame:
    """(table_id, markdown), GitHub-Flavored: ragged rows padded, blank rows at the
    end and blank columns at the right dropped, an empty header row without one.

    ``headers`` is (table_id, header_rows); tables without a row in it have none.
    A table without any content gives no row.
    """
    c = cells.select("table_id", "row", "col", cell_text(F.coalesce("text", F.lit(""))).alias("text"))
    extent = c.filter("text <> ''").groupBy("table_id").agg((F.max("col") + 1).alias("width"), F.max("row").alias("last"))
    rows = c.join(extent, "table_id").filter("col < width and row <= last").groupBy("table_id", "row", "width").agg(F.map_from_entries(F.collect_list(F.struct("col", "text"))).alias("m"))
    padded = F.transform(F.sequence(F.lit(0), F.col("width") - 1), lambda i: F.coalesce(F.element_at("m", i), F.lit("")))
    lines = rows.select("table_id", "row", "width", table_row(padded).alias("line"))
    tables = lines.groupBy("table_id", "width").agg(F.array_sort(F.collect_list(F.struct("row", "line"))).alias("rows"))
    known = tables.join(headers.select("table_id", "header_rows"), "table_id", "left") if headers is not None else tables.withColumn("header_rows", F.lit(0))
    every = F.transform("rows", lambda r: r["line"])
    rule = table_row(F.array_repeat(F.lit("---"), F.col("width")))
    blank = table_row(F.array_repeat(F.lit(""), F.col("width")))
    headed = F.concat(F.slice(every, 1, 1), F.array(rule), F.slice(every, 2, F.size(every)))
    whole = F.when(F.coalesce("header_rows", F.lit(0)) > 0, headed).otherwise(F.concat(F.array(blank, rule), every))
    return known.select("table_id", F.array_join(whole, "\n").alias("markdown"))


def to_cells(df: DataFrame, table_id: Column, row: Column, columns: list[str]) -> DataFrame:
    """A frame as cells: row 0 holds the column names, ``row`` counts from 1."""
    texts = F.array(*[F.col(c).cast("string") for c in columns])
    names = F.array(*[F.lit(c) for c in columns])
    body = df.select(table_id.alias("table_id"), row.alias("row"), F.posexplode(texts).alias("col", "text"))
    head = df.select(table_id.alias("table_id")).distinct().select("table_id", F.lit(0).alias("row"), F.posexplode(names).alias("col", "text"))
    return head.unionByName(body)


def merge_continuations(tables: DataFrame) -> DataFrame:
    """Tables of consecutive pages with equally many columns as one.

    (doc_id, page, columns, lines): of each continuation the first two lines, its
    repeated header and rule, are left out.
    """
    order = Window.partitionBy("doc_id").orderBy("page")
    goes_on = (F.lag("page").over(order) == F.col("page") - 1) & (F.lag("columns").over(order) == F.col("columns"))
    marked = tables.withColumn("__new", F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1))
    grouped = marked.withColumn("__run", F.sum("__new").over(order))
    own = F.when(F.col("__new") == 1, F.col("lines")).otherwise(F.slice("lines", 3, F.greatest(F.size("lines"), F.lit(3))))
    merged = grouped.select("doc_id", "__run", "page", "columns", own.alias("lines")).groupBy("doc_id", "__run", "columns").agg(F.min("page").alias("page"), F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("page", "lines"))), lambda s: s["lines"])).alias("lines"))
    return merged.select("doc_id", "page", "columns", "lines")
