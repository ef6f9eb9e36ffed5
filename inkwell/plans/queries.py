"""Queries over the test tables and their SQL in DuckDB's dialect.

Where the tables hold nothing that an operator acts on, both sides put it there
with the same expression.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import lines as ln
from ..functions import markdown as md
from ..functions import quality as ql
from ..functions import repair as rp
from ..functions import sheet as sh
from ..functions import text as tx
from ..operators import cells as cl
from ..operators import layout as ly
from ..operators import pages as pg
from ..operators import runs as rn
from ..operators import tables as tb
from ..sources import convert as cv
from ..sources import pdf

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: White space as RE2 reads it.
WS = tx.SPACE


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _documents(spark: SparkSession, sf_dir: str, noisy=None) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "source", "lang", F.coalesce("text", F.lit("")).alias("text"))
    return docs.withColumn("text", noisy(F.col("text"))) if noisy else docs


def _swap(c, *pairs):
    for a, b in pairs:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def _digest(df: DataFrame) -> DataFrame:
    return df.select("doc_id", F.md5(F.col("out")).alias("digest"), F.length("out").cast("long").alias("n_chars"))


def _digest_sql(expression: str, source: str = "documents") -> str:
    return f"SELECT doc_id, md5(o) AS digest, CAST(length(o) AS BIGINT) AS n_chars FROM (SELECT doc_id, {expression} AS o FROM (SELECT doc_id, coalesce(text, '') AS text FROM {source}))"


# Markdown tables


@query(
    """WITH n AS (SELECT r_name, n_nationkey, replace(n_name, '|', '\\|') AS name FROM nation JOIN region ON n_regionkey = r_regionkey)
    SELECT r_name AS table_id, '| n_nationkey | n_name |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || n_nationkey || ' | ' || name || ' |', chr(10) ORDER BY n_nationkey) AS markdown FROM n GROUP BY r_name"""
)
def md_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = _read(spark, sf_dir, "nation").join(_read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    numbered = joined.withColumn("__row", F.row_number().over(Window.partitionBy("r_name").orderBy("n_nationkey")))
    cells = cl.to_cells(numbered, F.col("r_name"), F.col("__row"), ["n_nationkey", "n_name"])
    return cl.render_tables(cells, cl.header_rows(cells))


_VOTED = """SELECT c_nationkey AS table_id, row, CASE c_nationkey % 5 WHEN 1 THEN '7' WHEN 2 THEN first_name ELSE 'Name' END AS h0, CASE c_nationkey % 5 WHEN 1 THEN '8' WHEN 3 THEN 'name' ELSE 'Key' END AS h1, c_name AS v0, CASE WHEN c_nationkey % 7 = 0 AND row > 50 THEN 'n/a' WHEN c_nationkey % 5 = 4 AND row % 3 = 0 THEN '' WHEN c_nationkey % 5 = 4 THEN 'Key' ELSE CAST(c_custkey AS STRING) END AS v1
    FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS row, min(c_name) OVER (PARTITION BY c_nationkey) AS first_name FROM customer)"""


@query(
    f"""WITH t AS ({_VOTED}), s AS (SELECT * FROM t WHERE row <= 50),
    k AS (SELECT table_id, any_value(h0) AS h0, any_value(h1) AS h1, count(*) AS n, count(nullif(v1, '')) AS n1, count(CASE WHEN regexp_matches(v1, '^[0-9]+$') THEN 1 END) AS digits, bool_or(lower(v0) = lower(h0)) AS again0, bool_or(lower(v1) = lower(h1) AND v1 <> '') AS again1 FROM s GROUP BY table_id),
    v AS (SELECT *, CASE WHEN n1 > 0 AND digits * 10 >= n1 * 9 AND NOT regexp_matches(h1, '^[0-9]+$') THEN 1 ELSE 0 END AS up, CASE WHEN n1 > 0 AND digits * 10 >= n1 * 9 THEN CASE WHEN regexp_matches(h1, '^[0-9]+$') THEN 1 ELSE 0 END WHEN again1 THEN 1 ELSE 0 END + CASE WHEN again0 THEN 1 ELSE 0 END AS down FROM k)
    SELECT table_id, CAST(CASE WHEN lower(h0) = lower(h1) THEN 0 WHEN up = 0 AND down = 0 THEN 1 WHEN up > down THEN 1 ELSE 0 END AS INTEGER) AS header_rows FROM v"""
)
def header_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables of customers by nation, with labels that are names, numbers, a value of
    the column or each other, and a typed column that breaks after the sample."""
    _read(spark, sf_dir, "customer").createOrReplaceTempView("__customer")
    rows = spark.sql(_VOTED.replace("FROM customer", "FROM __customer"))
    body = rows.select("table_id", "row", F.posexplode(F.array("v0", "v1")).alias("col", "text"))
    head = rows.filter("row = 1").select("table_id", F.lit(0).alias("row"), F.posexplode(F.array("h0", "h1")).alias("col", "text"))
    return cl.header_rows(head.unionByName(body))


@query(
    """WITH c AS (SELECT 0 AS col, CAST(o_orderkey AS VARCHAR) AS t FROM orders UNION ALL SELECT 1, o_orderstatus FROM orders UNION ALL SELECT 2, strftime(o_orderdate, '%Y-%m-%d') FROM orders UNION ALL SELECT 3, o_orderpriority FROM orders UNION ALL SELECT 4, CASE WHEN o_orderkey % 2 = 0 THEN 'yes' ELSE 'No' END FROM orders UNION ALL SELECT 5, CASE WHEN o_orderkey % 5 = 0 THEN 'n/a' ELSE CAST(o_orderkey % 100 AS VARCHAR) || '%' END FROM orders),
    k AS (SELECT col, CASE WHEN regexp_matches(regexp_replace(t, '%$', ''), '^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?$') THEN 'number' WHEN lower(t) IN ('true','false','yes','no') THEN 'bool' WHEN regexp_matches(t, '^[0-9]{1,4}-[0-9]{1,4}-[0-9]{1,4}$') THEN 'date' ELSE 'text' END AS kind FROM c),
    s AS (SELECT col, CAST(sum(CASE WHEN kind='number' THEN 1 ELSE 0 END) AS BIGINT) AS n_number, CAST(sum(CASE WHEN kind='bool' THEN 1 ELSE 0 END) AS BIGINT) AS n_bool, CAST(sum(CASE WHEN kind='date' THEN 1 ELSE 0 END) AS BIGINT) AS n_date, CAST(sum(CASE WHEN kind='text' THEN 1 ELSE 0 END) AS BIGINT) AS n_text FROM k GROUP BY col)
    SELECT 'orders' AS table_id, CAST(col AS INTEGER) AS col, n_number, n_bool, n_date, n_text, CASE WHEN n_number*10 >= 9*(n_number+n_bool+n_date+n_text) THEN 'number' WHEN n_bool*10 >= 9*(n_number+n_bool+n_date+n_text) THEN 'bool' WHEN n_date*10 >= 9*(n_number+n_bool+n_date+n_text) THEN 'date' WHEN n_text*10 >= 9*(n_number+n_bool+n_date+n_text) THEN 'text' END AS dominant FROM s"""
)
def column_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _read(spark, sf_dir, "orders")
    texts = F.array(
        F.col("o_orderkey").cast("string"),
        F.col("o_orderstatus"),
        F.date_format("o_orderdate", "yyyy-MM-dd"),
        F.col("o_orderpriority"),
        F.when(F.col("o_orderkey") % 2 == 0, "yes").otherwise("No"),
        F.when(F.col("o_orderkey") % 5 == 0, F.lit("n/a")).otherwise(F.concat((F.col("o_orderkey") % 100).cast("string"), F.lit("%"))),
    )
    cells = o.select(F.lit("orders").alias("table_id"), F.col("o_orderkey").alias("row"), F.posexplode(texts).alias("col", "text"))
    return cl.column_kinds(cells)


@query(
    """WITH d AS (SELECT source AS doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS page, n_chars % 3 AS columns FROM documents),
    m AS (SELECT *, CASE WHEN lag(columns) OVER (PARTITION BY doc_id ORDER BY page) = columns THEN 0 ELSE 1 END AS nw FROM d),
    g AS (SELECT *, sum(nw) OVER (PARTITION BY doc_id ORDER BY page) AS run FROM m)
    SELECT doc_id, CAST(min(page) AS INTEGER) AS page, columns, CAST(2 + count(*) AS BIGINT) AS n_lines FROM g GROUP BY doc_id, run, columns"""
)
def continuation_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    tables = docs.select(F.col("source").alias("doc_id"), F.row_number().over(Window.partitionBy("source").orderBy("doc_id")).alias("page"), (F.col("n_chars") % 3).alias("columns"), F.array(F.lit("h"), F.lit("-"), F.col("doc_id").cast("string")).alias("lines"))
    return cl.merge_continuations(tables).select("doc_id", "page", "columns", F.size("lines").cast("long").alias("n_lines"))


# Text


def _breaks(c):
    return _swap(c, (", ", " ­"), (". ", "\r\n​\t"), ("\n", "\r"))


@query(
    _digest_sql(
        "regexp_replace(regexp_replace(replace(replace(replace(replace(t, chr(160), ' '), chr(173), ''), chr(8203), ''), chr(65279), ''), '\\r\\n|\\r|\\n', ' ', 'g'), '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F-\\x{9F}]', '', 'g')",
        "documents",
    ).replace("coalesce(text, '') AS text", "replace(replace(replace(coalesce(text, ''), ', ', chr(160) || chr(173)), '. ', chr(13) || chr(10) || chr(8203) || chr(9)), chr(10), chr(13)) AS t")
)
def clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digest(_documents(spark, sf_dir, _breaks).withColumn("out", tx.clean_text(F.col("text"))))


@query(_digest_sql(f"regexp_replace(text, '{WS}+', ' ', 'g')"))
def collapse_whitespace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digest(_documents(spark, sf_dir).withColumn("out", tx.collapse_whitespace(F.col("text"))))


@query(
    f"SELECT doc_id, CAST(len(list_filter(regexp_split_to_array(coalesce(text, ''), '{WS}+'), lambda x: x <> '')) AS BIGINT) AS n_words, CAST(CASE WHEN coalesce(text, '') = '' THEN 0 ELSE len(string_split(text, chr(10))) - CASE WHEN text LIKE '%' || chr(10) THEN 1 ELSE 0 END END AS BIGINT) AS n_lines FROM documents"
)
def words_and_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select("doc_id", F.size(tx.words(F.col("text"))).cast("long").alias("n_words"), F.size(tx.lines(F.col("text"))).cast("long").alias("n_lines"))


_ADDRESSES = "CASE page_id % 5 WHEN 0 THEN url WHEN 1 THEN 'C:\\docs\\' || page_id WHEN 2 THEN substr(url, 9) WHEN 3 THEN 'mailto:x' || page_id ELSE 'd:/' || page_id END"


@query(
    f"SELECT page_id, regexp_matches(a, '^[A-Za-z][A-Za-z0-9+.-]*:') AS scheme, regexp_matches(a, '^[A-Za-z]:[\\\\/]') AS drive, regexp_matches(a, '^[A-Za-z][A-Za-z0-9+.-]*:') AND NOT regexp_matches(a, '^[A-Za-z]:[\\\\/]') AS absolute FROM (SELECT page_id, {_ADDRESSES} AS a FROM pages)"
)
def address_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("a")
    addresses = _read(spark, sf_dir, "pages").select("page_id", F.expr(_ADDRESSES.replace("\\", "\\\\")).alias("a"))
    return addresses.select("page_id", tx.has_scheme(c).alias("scheme"), tx.is_drive_path(c).alias("drive"), tx.is_absolute_uri(c).alias("absolute"))


@query(
    "SELECT page_id, CASE WHEN regexp_matches(u, '[ ()]') THEN '<' || u || '>' ELSE u END AS target FROM (SELECT page_id, replace(replace(replace(CASE page_id % 3 WHEN 0 THEN url WHEN 1 THEN url || ' (x)' ELSE url || '|<y>' END, '<', '%3C'), '>', '%3E'), '|', '%7C') AS u FROM pages)"
)
def url_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.expr("CASE page_id % 3 WHEN 0 THEN url WHEN 1 THEN url || ' (x)' ELSE url || '|<y>' END")
    return _read(spark, sf_dir, "pages").select("page_id", md.format_url(raw).alias("target"))


@query(
    "SELECT doc_id, repeat('`', greatest(3, 1 + coalesce(list_max(list_transform(regexp_extract_all(t, '`+'), lambda x: length(x))), 0))) AS fence FROM (SELECT doc_id, coalesce(text, '') || repeat('`', CAST(doc_id % 7 AS INTEGER)) || ' x ' || repeat('`', CAST(doc_id % 4 AS INTEGER)) AS t FROM documents)"
)
def code_fences(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.expr("text || repeat('`', cast(doc_id % 7 as int)) || ' x ' || repeat('`', cast(doc_id % 4 as int))")
    return _documents(spark, sf_dir).select("doc_id", t.alias("t")).select("doc_id", md.backtick_fence(F.col("t")).alias("fence"))


_FIRST_LINE = "regexp_replace(split_part(coalesce(text, ''), chr(10), 1), '[^A-Za-z0-9 _.,-]', '', 'g')"


@query(
    f"SELECT doc_id, CASE WHEN s = '' THEN 'section' ELSE s END AS slug, CASE WHEN i = '' THEN 'anchor' ELSE i END AS html_id FROM (SELECT doc_id, regexp_replace(replace(lower(trim(h)), ' ', '-'), '[^a-z0-9_-]', '', 'g') AS s, regexp_replace(regexp_replace(regexp_replace(lower(h), '[^a-z0-9_-]', '-', 'g'), '-+', '-', 'g'), '^-|-$', '', 'g') AS i FROM (SELECT doc_id, {_FIRST_LINE} AS h FROM documents))"
)
def heading_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = F.regexp_replace(F.split_part("text", F.lit("\n"), F.lit(1)), "[^A-Za-z0-9 _.,-]", "")
    return _documents(spark, sf_dir).select("doc_id", h.alias("h")).select("doc_id", md.slug(F.col("h")).alias("slug"), md.sanitize_id(F.col("h")).alias("html_id"))


@query(
    "SELECT source AS doc_id, doc_id AS seq, b AS base, CASE WHEN n = 1 THEN b ELSE b || '-' || (n - 1) END AS id FROM (SELECT *, row_number() OVER (PARTITION BY source, b ORDER BY doc_id) AS n FROM (SELECT source, doc_id, lang || '_' || CAST(n_chars % 5 AS VARCHAR) AS b FROM documents))"
)
def claimed_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = _read(spark, sf_dir, "documents").select(F.col("source").alias("doc_id"), F.col("doc_id").alias("seq"), F.concat("lang", F.lit("_"), (F.col("n_chars") % 5).cast("string")).alias("base"))
    return rn.claim_ids(names)


# Repair


def _leaders(c):
    return _swap(c, (", ", " ...... "), (". ", "...."))


@query(_digest_sql("regexp_replace(text, '\\.{4,}', ' ... ', 'g')").replace("coalesce(text, '') AS text", "replace(replace(coalesce(text, ''), ', ', ' ...... '), '. ', '....') AS text"))
def dot_leaders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digest(_documents(spark, sf_dir, _leaders).withColumn("out", rp.collapse_dot_leaders(F.col("text"))))


@query(_digest_sql(f"regexp_replace(text, '([{rp.HYPHEN_LETTERS}]) - ([{rp.HYPHEN_LETTERS}])', '\\1-\\2', 'g')").replace("coalesce(text, '') AS text", "replace(replace(coalesce(text, ''), 'e ', 'e - '), ' a', ' - a') AS text"))
def hyphenation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digest(_documents(spark, sf_dir, lambda c: _swap(c, ("e ", "e - "), (" a", " - a"))).withColumn("out", rp.fix_hyphenation(F.col("text"))))


_PAGED = "replace(replace(coalesce(text, ''), '. ', '.' || chr(10) || chr(10) || 'Page ' || CAST(doc_id % 50 AS VARCHAR) || chr(10) || chr(10)), ', ', chr(10) || CAST(doc_id AS VARCHAR) || chr(10) || '---' || chr(10))"


def _paged(c):
    dot = F.concat(F.lit(".\n\nPage "), (F.col("doc_id") % 50).cast("string"), F.lit("\n\n"))
    comma = F.concat(F.lit("\n"), F.col("doc_id").cast("string"), F.lit("\n---\n"))
    return F.replace(F.replace(c, F.lit(". "), dot), F.lit(", "), comma)


_LINES = """WITH t AS (SELECT doc_id, {noise} AS t FROM documents), l AS (SELECT doc_id, CASE WHEN t LIKE '%' || chr(10) THEN list_slice(a, 1, len(a) - 1) ELSE a END AS a FROM (SELECT doc_id, t, string_split(t, chr(10)) AS a FROM t)),
    e AS (SELECT doc_id, unnest(a) AS line, generate_subscripts(a, 1) AS i, len(a) AS n FROM l),
    w AS (SELECT *, trim(line) AS s, lag(trim(line)) OVER d AS p, lead(trim(line)) OVER d AS q, lead(trim(line), 2) OVER d AS r FROM e WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
    k AS (SELECT *, (regexp_matches(s, '^[0-9]{{1,4}}$') OR regexp_matches(lower(s), '^page *([0-9].*|of( .*)?|((of|[0-9]+)( +|$))*)$') OR regexp_matches(s, '^[0-9]+ *  *of *  *[0-9]+$') OR regexp_matches(s, '^- *[0-9]+ *-$')) AND (((p IS NULL OR p IN ('', '---')) AND (q IS NULL OR q IN ('', '---'))) OR coalesce(q = '---', false) OR coalesce(q = '' AND r = '---', false)) AS gone FROM w)"""


@query(_LINES.format(noise=_PAGED) + " SELECT doc_id, md5(o) AS digest, CAST(length(o) AS BIGINT) AS n_chars FROM (SELECT d.doc_id, coalesce(o, '') AS o FROM documents d LEFT JOIN (SELECT doc_id, string_agg(line, chr(10) ORDER BY i) AS o FROM k WHERE NOT gone GROUP BY doc_id) USING (doc_id))")
def page_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digest(_documents(spark, sf_dir, _paged).withColumn("out", rp.remove_page_numbers(F.col("text"))))


@query(_digest_sql("replace(regexp_replace(regexp_replace(replace(text, ' ]', ']'), ' ([.,;])(\\s|\\||$)', '\\1\\2', 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), '~', '')").replace("coalesce(text, '') AS text", "replace(replace(replace(coalesce(text, ''), '. ', ' . '), ', ', ' ]'), 'e', 'e' || chr(10) || chr(10) || chr(10)) AS text"))
def punctuation_and_blanks(spark: SparkSession, sf_dir: str) -> DataFrame:
    noisy = _documents(spark, sf_dir, lambda c: _swap(c, (". ", " . "), (", ", " ]"), ("e", "e\n\n\n")))
    return _digest(noisy.withColumn("out", F.replace(rp.collapse_blank_lines(rp.close_punctuation(rp.close_brackets(F.col("text")))), F.lit("~"), F.lit(""))))


@query(_digest_sql("regexp_replace(array_to_string(list_transform(string_split(text, chr(10)), lambda x: regexp_extract(x, '^ *') || regexp_replace(regexp_replace(x, '^ *', ''), ' {2,}', ' ', 'g')), chr(10)), '^\\n+', '')").replace("coalesce(text, '') AS text", "replace(replace(coalesce(text, ''), ', ', '   '), chr(10), chr(10) || '  ') AS text"))
def inner_spaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    noisy = _documents(spark, sf_dir, lambda c: _swap(c, (", ", "   "), ("\n", "\n  ")))
    return _digest(noisy.withColumn("out", rp.collapse_inner_spaces(F.col("text"))))


@query()
def repaired_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole chain over text with every kind of noise."""
    return _digest(_documents(spark, sf_dir, lambda c: _paged(_leaders(c))).withColumn("out", rp.clean_markdown(F.col("text"), leaders=True)))


@query(
    "SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(sum(CASE WHEN s LIKE '#%' OR regexp_matches(s, '^[-*•] ') OR (regexp_matches(s, '^[0-9]') AND (contains(s, '. ') OR contains(s, ') '))) THEN 1 ELSE 0 END) AS BIGINT) AS n_structural, CAST(sum(CASE WHEN x <> '' AND replace(x, x[1], '') = '' THEN 1 ELSE 0 END) AS BIGINT) AS n_one_sign FROM (SELECT doc_id, x, ltrim(x) AS s FROM (SELECT doc_id, unnest(string_split(replace(coalesce(text, ''), '. ', chr(10) || CASE doc_id % 4 WHEN 0 THEN '# ' WHEN 1 THEN '- ' WHEN 2 THEN '====' || chr(10) ELSE '3) ' END), chr(10))) AS x FROM documents)) GROUP BY doc_id"
)
def line_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    mark = F.expr("CASE doc_id % 4 WHEN 0 THEN '# ' WHEN 1 THEN '- ' WHEN 2 THEN '====\n' ELSE '3) ' END")
    lined = _documents(spark, sf_dir).select("doc_id", F.explode(F.split(F.replace("text", F.lit(". "), F.concat(F.lit("\n"), mark)), "\n")).alias("x"))
    count = lambda c: F.sum(c.cast("long"))
    return lined.groupBy("doc_id").agg(F.count("*").alias("n_lines"), count(rp.is_structural(F.col("x"))).alias("n_structural"), count(rp.is_one_sign(F.col("x"))).alias("n_one_sign"))


# Quality

_CIPHER = "CASE WHEN doc_id % 7 = 0 THEN translate(coalesce(text, ''), 'abcdefghijklmnopqrstuvwxyz', 'defghijklmnopqrstuvwxyzabc') WHEN doc_id % 11 = 0 THEN replace(coalesce(text, ''), 'a', chr(65533)) WHEN doc_id % 13 = 0 THEN replace(coalesce(text, ''), ' ', '$') ELSE coalesce(text, '') END"


def _ciphered(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return docs.select("doc_id", F.expr(_CIPHER.replace("chr(65533)", "'�'")).alias("text"))


_ENGLISH = "[" + ",".join(map(str, ql.ENGLISH)) + "]::DOUBLE[]"


@query(
    f"""WITH d AS (SELECT doc_id, {_CIPHER} AS t FROM documents), c AS (SELECT doc_id, t, list_transform(string_split('abcdefghijklmnopqrstuvwxyz', ''), lambda x: CAST(length(regexp_replace(lower(regexp_replace(t, '[^A-Za-z]', '', 'g')), '[^' || x || ']', '', 'g')) AS DOUBLE)) AS n FROM d)
    SELECT doc_id, CAST(list_sum(n) AS BIGINT) AS letters, CAST(length(regexp_replace(t, '[^aeiouAEIOU]', '', 'g')) AS BIGINT) AS vowels, CAST(coalesce(list_sum(list_transform(regexp_extract_all(t, '[A-Za-z]+'), lambda x: length(x) - 1)), 0) AS BIGINT) AS pairs, round(CASE WHEN list_sum(n) = 0 THEN 1.0 ELSE list_dot_product(n, {_ENGLISH}) / sqrt(list_dot_product(n, n)) / sqrt(list_dot_product({_ENGLISH}, {_ENGLISH})) END, 5) AS cosine, round(CASE WHEN list_sum(n) = 0 THEN 1.0 ELSE list_dot_product(list_reverse_sort(n), list_reverse_sort({_ENGLISH})) / sqrt(list_dot_product(n, n)) / sqrt(list_dot_product({_ENGLISH}, {_ENGLISH})) END, 5) AS shape FROM c"""
)
def letter_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, n = F.col("text"), F.col("n")
    counted = _ciphered(spark, sf_dir).withColumn("n", ql.letter_counts(t))
    return counted.select("doc_id", F.aggregate(n, F.lit(0), lambda s, x: s + x).cast("long").alias("letters"), ql.vowels(t).cast("long").alias("vowels"), ql.letter_pairs(t).cast("long").alias("pairs"), F.round(ql.english_cosine(n), 5).alias("cosine"), F.round(ql.english_shape_cosine(n), 5).alias("shape"))


@query(
    f"""WITH d AS (SELECT doc_id, {_CIPHER} AS t FROM documents), m AS (SELECT doc_id, t, length(t) - length(replace(t, chr(65533), '')) AS bad, coalesce(list_max(list_transform(regexp_extract_all(t, chr(65533) || '+'), lambda x: length(x))), 0) AS run, length(t) - length(replace(t, '$', '')) AS total, list_sum(list_transform(range(2, length(t)), lambda i: CASE WHEN t[i] = '$' AND regexp_matches(t[i-1], '^[A-Za-z]$') AND regexp_matches(t[i+1], '^[A-Za-z]$') THEN 1 ELSE 0 END)) AS between FROM d)
    SELECT doc_id, CAST(bad AS BIGINT) AS replacements, CAST(run AS BIGINT) AS longest_run, run >= 2 OR bad >= 3 AS replacement_run, total > 10 AND (coalesce(between, 0) > 20 OR coalesce(between, 0) * 2 > total) AS dollars FROM m"""
)
def decoding_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return _ciphered(spark, sf_dir).select("doc_id", ql.replacements(t).cast("long").alias("replacements"), ql.longest_run(t, "�").cast("long").alias("longest_run"), ql.has_replacement_run(t).alias("replacement_run"), ql.dollar_as_space(t).alias("dollars"))


@query(
    f"""WITH d AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace({_CIPHER}, CASE doc_id % 3 WHEN 0 THEN '[aeio]' ELSE '~' END, '=', 'g'), '\\.{{3,}}|_{{3,}}|·{{3,}}', '', 'g'), '{WS}|[#*|-]', '', 'g') AS t FROM documents)
    SELECT doc_id, length(t) >= 50 AND length(regexp_replace(t, '[^\\p{{L}}\\p{{N}}]', '', 'g')) * 2 < length(t) AS garbage FROM d"""
)
def garbage_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    noisy = F.when(F.col("doc_id") % 3 == 0, F.regexp_replace("text", "[aeio]", "=")).otherwise(F.regexp_replace("text", "~", "="))
    return _ciphered(spark, sf_dir).select("doc_id", noisy.alias("t")).select("doc_id", ql.is_garbage(F.col("t")).alias("garbage"))


@query()
def garbled_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return _ciphered(spark, sf_dir).select("doc_id", ql.looks_garbled(t).alias("garbled"), ql.has_encoding_issues(t).alias("issues"), ql.span_issue(t).alias("span_issue"))


# Pages


_NORM = f"trim(regexp_replace(trim(regexp_replace(trim(regexp_replace(text, '{WS}+', ' ', 'g')), '^[0-9]+', '')), '[0-9]+$', ''))"
_RUNS = "strlen(norm) >= 10 AND replace(norm, substr(norm, 1, 1), '') <> '' AND NOT (starts_with(norm, '#') OR regexp_matches(norm, '^[-*•] ') OR (regexp_matches(norm, '^[0-9]') AND (contains(norm, '. ') OR contains(norm, ') '))))"
_LEVEL = "k >= 3 AND count(DISTINCT page) >= greatest(3, k * 30 // 100) AND (count(*) < 2 OR stddev_pop(y) / span < 0.05)"


@query(
    f"""WITH p AS (SELECT source AS doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS page, string_split(coalesce(text, ''), chr(10)) AS a FROM documents),
    l AS (SELECT doc_id, page, 0 AS line, 1000.0::DOUBLE AS y, 'Left half' AS text FROM p UNION ALL SELECT doc_id, page, 1, 1000.02, 'of ' || doc_id FROM p UNION ALL SELECT doc_id, page, 2, 990.0, 'Running header of ' || doc_id FROM p UNION ALL SELECT doc_id, page, 3, 985.0 - (page % 4) * 200, 'Moving header of ' || doc_id FROM p UNION ALL SELECT doc_id, page, 4, -1000000.0, page || ' Footer of the document' FROM p
    UNION ALL SELECT doc_id, page, 4 + i, 980.0 - 12 * i, x FROM (SELECT doc_id, page, unnest(a) AS x, generate_subscripts(a, 1) AS i FROM p)),
    d AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY y) - 1 AS r, count(*) OVER (PARTITION BY doc_id, page) AS c FROM (SELECT DISTINCT doc_id, page, y FROM l)),
    e AS (SELECT doc_id, page, y, c <= 10 OR f < 5 OR f >= c - 5 AS edge FROM (SELECT *, min(r) OVER (PARTITION BY doc_id, page ORDER BY y RANGE BETWEEN 0.0999999 PRECEDING AND CURRENT ROW) AS f FROM d)),
    m AS (SELECT l.*, edge, {_NORM} AS norm, CAST(round(y * 10) AS BIGINT) AS b FROM l JOIN e USING (doc_id, page, y)),
    g AS (SELECT doc_id, count(*) AS k, greatest(avg(hi - lo), 1) AS span FROM (SELECT doc_id, page, max(y) AS hi, min(y) AS lo FROM l GROUP BY doc_id, page) GROUP BY doc_id),
    one AS (SELECT doc_id, norm, min(page) AS first FROM m JOIN g USING (doc_id) WHERE edge AND {_RUNS} GROUP BY doc_id, norm, k, span HAVING {_LEVEL}),
    w AS (SELECT *, {_NORM} AS norm FROM (SELECT doc_id, page, b, string_agg(text, ' ' ORDER BY line) AS text, arg_min(y, line) AS y, arg_min(edge, line) AS edge, count(*) AS n FROM m GROUP BY doc_id, page, b) WHERE edge),
    many AS (SELECT doc_id, norm, min(page) AS first FROM w JOIN g USING (doc_id) WHERE n > 1 AND {_RUNS} GROUP BY doc_id, norm, k, span HAVING {_LEVEL}),
    gone AS (SELECT m.doc_id, m.page, m.b FROM m JOIN one USING (doc_id, norm) WHERE m.edge AND m.page > one.first UNION SELECT w.doc_id, w.page, w.b FROM w JOIN many USING (doc_id, norm) WHERE n > 1 AND w.page > many.first)
    SELECT m.doc_id, CAST(m.page AS INTEGER) AS page, count(*) AS n_lines, count(CASE WHEN gone.b IS NULL THEN 1 END) AS n_kept, md5(coalesce(string_agg(CASE WHEN gone.b IS NULL THEN m.text END, chr(10) ORDER BY m.line), '')) AS digest FROM m LEFT JOIN gone ON gone.doc_id = m.doc_id AND gone.page = m.page AND gone.b = m.b GROUP BY m.doc_id, m.page"""
)
def running_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts of a source as pages of one document, under a header, a header in two
    halves, one that moves about, and over a footer: what is kept of every page."""
    docs = _documents(spark, sf_dir)
    paged = docs.select(F.col("source").alias("doc_id"), F.row_number().over(Window.partitionBy("source").orderBy("doc_id")).alias("page"), "text")
    heads = [
        (F.lit(1000.0), F.lit("Left half")),
        (F.lit(1000.02), F.concat(F.lit("of "), F.col("doc_id"))),
        (F.lit(990.0), F.concat(F.lit("Running header of "), F.col("doc_id"))),
        (F.lit(985.0) - (F.col("page") % 4) * 200, F.concat(F.lit("Moving header of "), F.col("doc_id"))),
        (F.lit(-1000000.0), F.concat(F.col("page").cast("string"), F.lit(" Footer of the document"))),
    ]
    given = F.array(*[F.struct(F.lit(i).alias("line"), y.alias("y"), text.alias("text")) for i, (y, text) in enumerate(heads)])
    own = F.transform(F.split("text", "\n", -1), lambda x, i: F.struct((i + 5).alias("line"), (F.lit(968.0) - i * 12).alias("y"), x.alias("text")))
    lined = paged.select("doc_id", "page", F.explode(F.concat(given, own)).alias("l")).select("doc_id", "page", "l.line", "l.y", "l.text")
    marked = pg.repeated_lines(lined)
    kept = F.when(~F.col("removed"), F.struct("line", "text"))
    texts = F.transform(F.array_sort(F.collect_list(kept)), lambda s: s["text"])
    return marked.groupBy("doc_id", "page").agg(F.count("*").alias("n_lines"), F.sum((~F.col("removed")).cast("long")).alias("n_kept"), F.md5(F.array_join(texts, "\n")).alias("digest"))


_ITEMS = "SELECT doc_id % 40 AS doc_id, doc_id AS line, CAST(doc_id % 3 AS INTEGER) AS idx, 8 + (n_chars % 9) * 0.5 AS font_size FROM documents"


@query(
    f"WITH v AS (SELECT doc_id, CAST(floor(font_size * 10) AS BIGINT) AS k, count(*) AS n FROM ({_ITEMS}) WHERE font_size >= 9 GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, k) AS o FROM v) SELECT i.doc_id, coalesce(r.k / 10.0, 12.0)::DOUBLE AS body FROM (SELECT DISTINCT doc_id FROM ({_ITEMS})) i LEFT JOIN r ON i.doc_id = r.doc_id AND r.o = 1"
)
def body_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _read(spark, sf_dir, "documents")
    items = d.select((F.col("doc_id") % 40).alias("doc_id"), F.col("doc_id").alias("line"), (F.col("doc_id") % 3).cast("int").alias("idx"), (8 + (F.col("n_chars") % 9) * 0.5).alias("font_size"))
    return pg.body_size(items)


@query(
    "WITH g AS (SELECT doc_id % 60 AS doc_id, CAST(n_chars % 29 AS DOUBLE) AS gap, 10.0::DOUBLE AS body FROM documents), u AS (SELECT doc_id, list_sort(list(gap)) AS s, count(*) AS n FROM g WHERE gap > 0 AND gap < 10 * body GROUP BY doc_id) SELECT d.doc_id, round(CASE WHEN coalesce(n, 0) < 5 THEN 18.0 ELSE greatest(s[n // 2 + 1] * 1.3, 15.0) END, 6)::DOUBLE AS threshold FROM (SELECT DISTINCT doc_id FROM g) d LEFT JOIN u USING (doc_id)"
)
def paragraph_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    gaps = _read(spark, sf_dir, "documents").select((F.col("doc_id") % 60).alias("doc_id"), (F.col("n_chars") % 29).cast("double").alias("gap"), F.lit(10.0).alias("body"))
    return pg.paragraph_threshold(gaps).select("doc_id", F.round("threshold", 6).alias("threshold"))


@query(
    """WITH e AS (SELECT source, count(*)::DOUBLE AS p, sum(CASE WHEN n_chars % 3 > 0 AND source IN ('src1','src2','src3','src8') THEN 1 ELSE 0 END)::DOUBLE AS t, sum(CASE WHEN source IN ('src4','src5','src8') AND n_chars % 2 = 0 THEN 1 ELSE 0 END)::DOUBLE AS i, sum(CASE WHEN source = 'src6' THEN 1 ELSE 0 END)::DOUBLE AS v, sum(CASE WHEN source = 'src2' AND n_chars % 2 = 0 THEN 1 ELSE 0 END)::DOUBLE AS m, sum(CASE WHEN source NOT IN ('src4','src7') THEN 1 ELSE 0 END)::DOUBLE AS o FROM documents GROUP BY source)
    SELECT source, CASE WHEN m > 0 AND t > 0 THEN 'mixed' WHEN t / p >= 0.6 THEN 'text' WHEN t = 0 AND (i > 0 OR v > 0) AND o = 0 AND v = 0 THEN 'scanned' WHEN t = 0 AND (i > 0 OR v > 0) THEN 'image' WHEN t > 0 AND i > 0 THEN 'mixed' WHEN o = 0 THEN 'scanned' ELSE 'text' END AS kind, round(CASE WHEN m > 0 AND t > 0 THEN 0.5 + (1 - m / p) * 0.3 WHEN t / p >= 0.6 THEN t / p WHEN t = 0 AND (i > 0 OR v > 0) AND o = 0 AND v = 0 THEN 0.95 WHEN t = 0 AND (i > 0 OR v > 0) THEN 0.8 WHEN t > 0 AND i > 0 THEN 0.7 WHEN o = 0 THEN 0.9 ELSE greatest(t / p, 0.5) END, 6)::DOUBLE AS confidence FROM e"""
)
def page_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _read(spark, sf_dir, "documents")
    count = lambda sql: F.sum(F.expr(sql).cast("double"))
    sums = d.groupBy("source").agg(
        F.count("*").cast("double").alias("p"),
        count("n_chars % 3 > 0 and source in ('src1','src2','src3','src8')").alias("t"),
        count("source in ('src4','src5','src8') and n_chars % 2 = 0").alias("i"),
        count("source = 'src6'").alias("v"),
        count("source = 'src2' and n_chars % 2 = 0").alias("m"),
        count("source not in ('src4','src7')").alias("o"),
    )
    verdict = pg.document_kind(*[F.col(c) for c in "ptivmo"])
    return sums.select("source", verdict.alias("k")).select("source", F.col("k.kind").alias("kind"), F.round("k.confidence", 6).alias("confidence"))


# Runs, lists, sheets


@query(
    """WITH k AS (SELECT user_id, event_id, event_type, CASE WHEN event_type IN ('click', 'view') THEN event_type ELSE 'o' END AS style FROM events), r AS (SELECT *, lag(style) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM k), g AS (SELECT *, sum(CASE WHEN p = style THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM r)
    SELECT user_id AS doc_id, min(event_id) AS seq, string_agg('e' || event_id || ' ', '' ORDER BY event_id) AS text, bool_or(event_type = 'click') AS bold, bool_or(event_type = 'view') AS italic FROM g GROUP BY user_id, run, style"""
)
def merged_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _read(spark, sf_dir, "events")
    runs = e.select(F.col("user_id").alias("doc_id"), F.col("event_id").alias("seq"), F.concat(F.lit("e"), F.col("event_id").cast("string"), F.lit(" ")).alias("text"), (F.col("event_type") == "click").alias("bold"), (F.col("event_type") == "view").alias("italic"), F.lit(False).alias("strike"), F.lit(False).alias("code"))
    return rn.merge_runs(runs).select("doc_id", "seq", "text", "bold", "italic")


@query(
    "WITH e AS (SELECT l_orderkey AS doc_id, l_linenumber AS seq, min(l_returnflag) AS instance, l_linenumber % 3 AS number FROM lineitem GROUP BY l_orderkey, l_linenumber), m AS (SELECT *, CASE WHEN lag(instance) OVER w = instance AND lag(number) OVER w + 1 = number THEN 0 ELSE 1 END AS nw FROM e WINDOW w AS (PARTITION BY doc_id ORDER BY seq)) SELECT doc_id, seq, CAST(sum(nw) OVER (PARTITION BY doc_id ORDER BY seq) AS BIGINT) AS list FROM m"
)
def folded_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("seq")).agg(F.min("l_returnflag").alias("instance"))
    entries = lines.select("doc_id", "seq", "instance", F.lit("decimal").alias("marker"), (F.col("seq") % 3).alias("number"))
    return rn.number_lists(entries).select("doc_id", "seq", F.col("list").cast("long").alias("list"))


@query(
    "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') || CASE o_orderkey % 3 WHEN 0 THEN '' WHEN 1 THEN ' 06:00:00' ELSE ' 18:30:00' END AS shown FROM orders"
)
def serial_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1899-12-30").cast("date")).cast("double")
    part = F.when(F.col("o_orderkey") % 3 == 0, 0.0).when(F.col("o_orderkey") % 3 == 1, 0.25).otherwise(18.5 / 24)
    return _read(spark, sf_dir, "orders").select("o_orderkey", sh.serial_text(days + part).alias("shown"))


#: Letters of numbers: A to Z, then AA and so on, with as many letters as it takes.
_LETTERS = "WITH RECURSIVE l(k, n, s) AS (SELECT DISTINCT p_partkey, p_partkey, '' FROM part UNION ALL SELECT k, (n - 1) // 26, chr(CAST({a} + (n - 1) % 26 AS INTEGER)) || s FROM l WHERE n > 0), f AS (SELECT k, s FROM l WHERE n = 0)"


@query(
    _LETTERS.format(a=65) + " SELECT p_partkey, CASE p_size % 6 WHEN 0 THEN 'timeDelta' WHEN 1 THEN 'dateTime' WHEN 3 THEN 'dateTime' ELSE 'other' END AS class, s AS letters, p_partkey AS number FROM part JOIN f ON k = p_partkey"
)
def sheet_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = F.array(*[F.lit(x) for x in ("[h]:mm:ss", "yyyy-mm-dd", '0.00" days"', "h:mm AM/PM", "#,##0;[Red]-d", "_d0")])
    parts = _read(spark, sf_dir, "part")
    letters = sh.column_letters(F.col("p_partkey"))
    return parts.select("p_partkey", sh.format_class(F.element_at(codes, F.col("p_size") % 6 + 1)).alias("class"), letters.alias("letters"), sh.column_number(letters).alias("number"))


@query(
    _LETTERS.format(a=97) + " SELECT k, CASE WHEN k > 3999 OR k < 1 THEN CAST(k AS VARCHAR) ELSE ['','m','mm','mmm'][k // 1000 + 1] || ['','c','cc','ccc','cd','d','dc','dcc','dccc','cm'][k // 100 % 10 + 1] || ['','x','xx','xxx','xl','l','lx','lxx','lxxx','xc'][k // 10 % 10 + 1] || ['','i','ii','iii','iv','v','vi','vii','viii','ix'][k % 10 + 1] END AS roman, CASE WHEN k < 1 THEN CAST(k AS VARCHAR) ELSE s END AS alpha FROM f"
)
def list_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    return _read(spark, sf_dir, "part").select(F.col("p_partkey").alias("k")).select("k", md.roman_marker(k).alias("roman"), md.alpha_marker(k).alias("alpha"))


# Readers


@query(
    "SELECT page_id, replace(replace(replace(replace(replace(trim(regexp_replace(regexp_extract(html, '<h1>(.*?)</h1>', 1), ' +', ' ', 'g')), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#x27;', ''''), '&amp;', '&') AS title, CAST(len(regexp_extract_all(html, '<li>')) AS BIGINT) AS n_items FROM pages"
)
def page_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = F.col("blocks")
    titles = F.filter(blocks, lambda b: (b["kind"] == "heading") & (b["level"] == 1))
    items = F.filter(blocks, lambda b: b["kind"] == "item")
    title = F.when(blocks.isNotNull(), F.coalesce(F.get(titles, F.lit(0))["text"], F.lit("")))
    return cv.html_pages(_read(spark, sf_dir, "pages"), "page_id", "html", rendered=False).select(F.col("doc_id").alias("page_id"), title.alias("title"), F.when(blocks.isNotNull(), F.size(items)).cast("long").alias("n_items"))


@query()
def page_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole pages as Markdown."""
    pages = _read(spark, sf_dir, "pages").select(F.concat(F.col("page_id").cast("string"), F.lit(".html")).alias("path"), F.col("html").cast("binary").alias("content"))
    return cv.convert(pages).select(F.regexp_replace("doc_id", r"\.html$", "").cast("long").alias("page_id"), "format", "markdown", "error_code")


@query(
    "SELECT r_name || '.csv' AS doc_id, 'csv' AS format, '| key | name |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || n_nationkey || ' | ' || n_name || ', \"x\" |', chr(10) ORDER BY n_nationkey) || chr(10) AS markdown FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name"
)
def delimited_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = _read(spark, sf_dir, "nation").join(_read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    line = F.concat(F.col("n_nationkey").cast("string"), F.lit(';"'), F.col("n_name"), F.lit(', ""x"""'))
    files = joined.groupBy("r_name").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", line.alias("l")))), lambda s: s["l"]), "\r\n").alias("body"))
    content = F.concat(F.lit("key;name\r\n"), F.col("body")).cast("binary")
    return cv.convert(files.select(F.concat("r_name", F.lit(".csv")).alias("path"), content.alias("content"))).select("doc_id", "format", "markdown")


# Layout

#: Words of a document as positioned items: column of the word and line of the text.
_ITEMS_SQL = """(SELECT doc_id, (i - 1) // 200 AS page, i AS idx, w AS text, CAST(50 + ((i - 1) % 5) * 50 + CASE WHEN (i - 1) % 10 >= 5 THEN 300 ELSE 0 END AS DOUBLE) AS x, CAST(780 - (((i - 1) % 200) // 10) * 14 AS DOUBLE) AS y, CAST(40 AS DOUBLE) AS width FROM (SELECT doc_id, unnest(a) AS w, generate_subscripts(a, 1) AS i FROM (SELECT doc_id, list_filter(string_split(replace(coalesce(text, ''), chr(10), ' '), ' '), lambda x: x <> '') AS a FROM documents)))"""


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = F.filter(F.split(F.replace("text", F.lit("\n"), F.lit(" ")), " "), lambda w: w != "")
    words = _documents(spark, sf_dir).select("doc_id", F.posexplode(split).alias("i", "text"))
    i = F.col("i")
    return words.select(
        "doc_id", F.floor(i / 200).cast("int").alias("page"), (i + 1).alias("idx"), "text",
        (50 + (i % 5) * 50 + F.when(i % 10 >= 5, 300).otherwise(0)).cast("double").alias("x"), (780 - F.floor((i % 200) / 10) * 14).cast("double").alias("y"),
        F.lit(40.0).alias("width"), F.lit(10.0).alias("font_size"), F.lit(False).alias("bold"),
    )


def _item_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same items as ``by_page`` gives them, without a row for each word."""
    split = lambda t: F.filter(F.split(F.replace(t, F.lit("\n"), F.lit(" ")), " "), lambda w: w != "")
    texts = _documents(spark, sf_dir).groupBy("doc_id").agg(F.collect_list("text").alias("texts"))

    def pages(words):
        n = F.ceil(F.array_max(F.transform(words, F.size)) / 200).cast("int")
        return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda p: F.transform(words, lambda w: F.slice(w, p * 200 + 1, 200))))

    def item(w, i):
        x, y = 50 + (i % 5) * 50 + F.when(i % 10 >= 5, 300).otherwise(0), 780 - F.floor(i / 10) * 14
        return F.struct((F.col("page") * 200 + i + 1).alias("idx"), w.alias("text"), x.cast("double").alias("x"), y.cast("double").alias("y"), F.lit(40.0).alias("width"), F.lit(10.0).alias("font_size"), F.lit(False).alias("bold"))

    cut = texts.select("doc_id", F.posexplode(tx.let(F.transform("texts", split), pages)).alias("page", "words"))
    return cut.select("doc_id", "page", F.flatten(F.transform("words", lambda part: F.transform(part, item))).alias("items"))


@query(f"SELECT doc_id, CAST(page AS INTEGER) AS page, CAST(bin AS BIGINT) AS bin, count(*) AS n FROM (SELECT doc_id, page, unnest(range(CAST(x // 2 AS BIGINT), CAST((x + width) // 2 AS BIGINT) + 1)) AS bin FROM {_ITEMS_SQL}) GROUP BY ALL")
def item_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ly.x_histogram(_items(spark, sf_dir))


@query(
    f"""WITH i AS (SELECT doc_id, page, x, x + width AS r, y FROM {_ITEMS_SQL}),
    p AS (SELECT doc_id, page, count(*) AS n, min(x) AS low, max(r) AS high, min(y) AS bottom, max(y) AS top FROM i GROUP BY doc_id, page),
    s AS (SELECT i.*, low, high, bottom, top FROM i JOIN p USING (doc_id, page) WHERE n >= 20 AND high - low >= 200 AND r - x <= 0.6 * (high - low)),
    h AS (SELECT doc_id, page, bin, count(*) AS c FROM (SELECT doc_id, page, unnest(range(CAST(floor((x - low) / 2) AS BIGINT), CAST(floor((r - low) / 2) AS BIGINT) + 1)) AS bin FROM s) GROUP BY ALL),
    b AS (SELECT doc_id, page, unnest(range(0, CAST(floor((high - low) / 2) AS BIGINT) + 2)) AS bin FROM p WHERE n >= 20 AND high - low >= 200),
    e AS (SELECT b.doc_id, b.page, b.bin, coalesce(c, 0) <= floor(max(coalesce(c, 0)) OVER (PARTITION BY b.doc_id, b.page) * 0.15) AS empty FROM b LEFT JOIN h USING (doc_id, page, bin)),
    g AS (SELECT doc_id, page, min(bin) AS a, max(bin) + 1 AS z FROM (SELECT *, bin - row_number() OVER (PARTITION BY doc_id, page ORDER BY bin) AS k FROM e WHERE empty) GROUP BY doc_id, page, k),
    m AS (SELECT doc_id, page, low + (a + z) / 2 * 2 AS gutter, bottom, top FROM g JOIN p USING (doc_id, page) WHERE (z - a) * 2 >= 8 AND low + (a + z) / 2 * 2 > low + 0.05 * (high - low) AND low + (a + z) / 2 * 2 < high - 0.05 * (high - low)),
    f AS (SELECT m.doc_id, m.page, gutter FROM m JOIN s USING (doc_id, page) GROUP BY m.doc_id, m.page, gutter, m.bottom, m.top HAVING count(CASE WHEN (x + r) / 2 < gutter THEN 1 END) >= 10 AND count(CASE WHEN (x + r) / 2 >= gutter THEN 1 END) >= 10 AND (max(CASE WHEN (x + r) / 2 < gutter THEN y END) - min(CASE WHEN (x + r) / 2 < gutter THEN y END)) / greatest(m.top - m.bottom, 1e-9) >= 0.3 AND (max(CASE WHEN (x + r) / 2 >= gutter THEN y END) - min(CASE WHEN (x + r) / 2 >= gutter THEN y END)) / greatest(m.top - m.bottom, 1e-9) >= 0.3)
    SELECT p.doc_id, CAST(p.page AS INTEGER) AS page, coalesce(string_agg(CAST(CAST(gutter AS INTEGER) AS VARCHAR), ',' ORDER BY gutter), '') AS gutters FROM p LEFT JOIN f ON f.doc_id = p.doc_id AND f.page = p.page GROUP BY p.doc_id, p.page"""
)
def page_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All gutters of every page."""
    found = ly.column_gutters(_items(spark, sf_dir))
    return found.select("doc_id", "page", F.array_join(F.transform("gutters", lambda g: g.cast("int").cast("string")), ",").alias("gutters"))


@query(f"SELECT doc_id, CAST(page AS INTEGER) AS page, CAST(count(DISTINCT y) AS BIGINT) AS n_lines, min(CASE WHEN y = 780 THEN top END) AS first FROM (SELECT *, string_agg(text, ' ') OVER (PARTITION BY doc_id, page, y ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS top FROM (SELECT * FROM {_ITEMS_SQL} ORDER BY idx)) GROUP BY doc_id, page")
def grouped_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages are cut from the texts; the words are whole, so a blank parts any two."""
    found = _item_pages(spark, sf_dir)
    lines = ly.group_lines(found, parted=lambda *_: F.lit(True))
    return lines.groupBy("doc_id", "page").agg(F.count("*").alias("n_lines"), F.min(F.when(F.col("line") == 0, F.col("text"))).alias("first"))


@query(
    f"""WITH g AS (SELECT doc_id, page, x - reach AS gap, (x + reach) / 2 AS cut, k - 1 AS before, n - k + 1 AS after FROM (SELECT doc_id, page, x, max(x + width) OVER (PARTITION BY doc_id, page ORDER BY x, idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach, row_number() OVER (PARTITION BY doc_id, page ORDER BY x, idx) AS k, count(*) OVER (PARTITION BY doc_id, page) AS n FROM {_ITEMS_SQL}))
    SELECT doc_id, CAST(page AS INTEGER) AS page, arg_max(cut, gap) AS cut FROM g WHERE gap >= 15 AND greatest(before, after) >= 10 AND least(before, after) >= 3 GROUP BY doc_id, page"""
)
def page_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ly.widest_cut(_items(spark, sf_dir))


_SHAPES = "CASE doc_id % 8 WHEN 0 THEN 'Figure ' || doc_id || ': x' WHEN 1 THEN '• ' || doc_id WHEN 2 THEN doc_id || '. Item' WHEN 3 THEN 'Chapter .... ' || (doc_id % 900) WHEN 4 THEN '1.' || (doc_id % 30) || '. Section Name' WHEN 5 THEN 'IV) Part' WHEN 6 THEN 'plain words of a line' ELSE 'x = f(y);' END"


@query(
    f"SELECT doc_id, regexp_matches(lower(l), '^(figure|table) *[0-9(#]') AS caption, regexp_matches(l, '^[•○●◦*-] ') OR (regexp_matches(substr(l, 1, 5), '[0-9]') AND regexp_matches(substr(l, 1, 5), '^[0-9]*[.)]')) OR regexp_matches(l, '^[A-Za-z][.)]') AS item, contains(l, '....') AS leaders, regexp_matches(l, '\\.{{3,}} *[0-9]{{1,4}}$') AS toc, CASE WHEN regexp_matches(l, '^[0-9]{{1,3}}(\\.[0-9]{{1,3}})*\\. ') THEN len(regexp_extract_all(split_part(l, ' ', 1), '[0-9]+'))::INTEGER WHEN l LIKE 'IV)%' THEN 1 END AS depth, l LIKE '%;' OR length(regexp_replace(l, '[^{{}}()\\[\\];=<>]', '', 'g')) >= 3 AS code FROM (SELECT doc_id, {_SHAPES} AS l FROM documents)"
)
def line_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("l")
    shaped = _read(spark, sf_dir, "documents").select("doc_id", F.expr(_SHAPES).alias("l")).withColumn("n", ln.numbering(c))
    return shaped.select("doc_id", ln.is_caption(c).alias("caption"), ln.is_list_item(c).alias("item"), ln.has_dot_leaders(c).alias("leaders"), ln.is_toc_entry(c).alias("toc"), F.when(F.col("n").isNotNull(), F.size("n.parts")).alias("depth"), ln.is_code_like(c).alias("code"))


@query(
    """WITH RECURSIVE e AS (SELECT DISTINCT source AS doc_id, doc_id // 7 AS page, CAST(length(coalesce(text, '')) % 97 AS DOUBLE) AS p FROM documents),
    k AS (SELECT doc_id, page, min(p) AS position FROM e GROUP BY doc_id, page UNION ALL SELECT doc_id, page, position FROM (SELECT k.doc_id, k.page, (SELECT min(p) FROM e WHERE e.doc_id = k.doc_id AND e.page = k.page AND e.p > k.position + 6) AS position FROM k) WHERE position IS NOT NULL),
    a AS (SELECT source AS doc_id, doc_id // 7 AS page, CAST(length(coalesce(text, '')) % 97 AS DOUBLE) AS p FROM documents)
    SELECT doc_id, page, position, count(*) AS n FROM (SELECT a.doc_id, a.page, a.p, max(k.position) AS position FROM a JOIN k ON a.doc_id = k.doc_id AND a.page = k.page AND k.position <= a.p GROUP BY a.doc_id, a.page, a.p) JOIN a USING (doc_id, page, p) GROUP BY doc_id, page, position"""
)
def snapped_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = _documents(spark, sf_dir).select(F.col("source").alias("doc_id"), F.floor(F.col("doc_id") / 7).alias("page"), F.lit("x").alias("axis"), (F.length("text") % 97).cast("double").alias("position"))
    return ly.snap_edges(edges).select("doc_id", "page", "position", "n")


# PDF


def _pdf(content):
    """A file of one page that shows ``content``; all glyphs are half an em wide and the
    objects are found by a scan, since there is no cross reference."""
    widths = " ".join(["500"] * 95)
    head = f"%PDF-1.4\n1 0 obj<</Type/Catalog/Pages 2 0 R>>endobj\n2 0 obj<</Type/Pages/Kids[3 0 R]/Count 1>>endobj\n3 0 obj<</Type/Page/Parent 2 0 R/Contents 4 0 R/Resources<</Font<</F1 5 0 R>>>>>>endobj\n5 0 obj<</Type/Font/Subtype/Type1/BaseFont/Helvetica-Bold/FirstChar 32/LastChar 126/Widths[{widths}]>>endobj\n4 0 obj<</Length "
    return F.concat(F.lit(head), F.length(content).cast("string"), F.lit(">>stream\n"), content, F.lit("\nendstream endobj\ntrailer<</Root 1 0 R>>")).cast("binary")


def _numbered_suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "supplier").withColumn("i", F.row_number().over(Window.partitionBy("s_nationkey").orderBy("s_suppkey")) - 1)


_SUPPLIERS = "SELECT *, 'Key ' || s_suppkey AS s_key, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS i FROM supplier"


def _supplier_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page for each nation: name and key of its suppliers inside a ruled grid."""
    y = F.lit(800) - F.col("i") * 20 - F.pmod(F.col("i"), F.lit(2)) * 5
    line = F.concat(F.lit("BT /F1 10 Tf 1 0 0 1 50 "), y.cast("string"), F.lit(" Tm ("), F.col("s_name"), F.lit(") Tj 1 0 0 1 250 "), y.cast("string"), F.lit(" Tm [(Key "), F.col("s_suppkey").cast("string"), F.lit(")] TJ ET 40 "), (y - 5).cast("string"), F.lit(" m 440 "), (y - 5).cast("string"), F.lit(" l S"))
    parts = _numbered_suppliers(spark, sf_dir).select("s_nationkey", "i", line.alias("line"), y.alias("y"))
    pages = parts.groupBy("s_nationkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "line"))), lambda p: p["line"]), "\n").alias("lines"), (F.min("y") - 5).cast("string").alias("low"))
    rules = F.concat(*[x for at in ("40", "240", "440") for x in (F.lit(f"\n{at} 815 m {at} "), F.col("low"), F.lit(" l S"))])
    content = F.concat(F.col("lines"), F.lit("\n40 815 m 440 815 l S"), rules)
    return pages.select(F.col("s_nationkey").cast("string").alias("path"), _pdf(content).alias("content"))


@query(
    f"WITH s AS ({_SUPPLIERS}) SELECT CAST(s_nationkey AS VARCHAR) AS doc_id, CAST(2 * i + c AS INTEGER) AS idx, CASE c WHEN 0 THEN s_name ELSE s_key END AS text, CAST(50 + 200 * c AS DOUBLE) AS x, CAST(800 - 20 * i - 5 * (i % 2) AS DOUBLE) AS y, CAST(5 * length(CASE c WHEN 0 THEN s_name ELSE s_key END) AS DOUBLE) AS width, 10.0::DOUBLE AS font_size, true AS bold FROM s, (VALUES (0), (1)) AS t(c)"
)
def pdf_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pdf.pdf_items(_supplier_files(spark, sf_dir)).select("doc_id", "idx", "text", "x", "y", F.round("width", 6).alias("width"), "font_size", "bold")


@query(
    f"WITH s AS ({_SUPPLIERS}) SELECT CAST(s_nationkey AS VARCHAR) AS doc_id, 'h' AS kind, CAST(795 - 20 * i - 5 * (i % 2) AS DOUBLE) AS at, 40.0::DOUBLE AS low, 440.0::DOUBLE AS high FROM s UNION ALL SELECT DISTINCT CAST(s_nationkey AS VARCHAR), 'h', 815.0, 40.0, 440.0 FROM s UNION ALL SELECT CAST(s_nationkey AS VARCHAR), 'v', CAST(x AS DOUBLE), CAST(min(795 - 20 * i - 5 * (i % 2)) AS DOUBLE), 815.0 FROM s, (VALUES (40), (240), (440)) AS t(x) GROUP BY s_nationkey, x"
)
def pdf_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tb.classify_segments(pdf.pdf_segments(_supplier_files(spark, sf_dir))).select("doc_id", "kind", "at", "low", "high")


@query(
    f"WITH s AS ({_SUPPLIERS}) SELECT CAST(s_nationkey AS VARCHAR) AS doc_id, 2 AS columns, CAST(count(*) AS INTEGER) AS rows, string_agg('|' || s_name || '|' || s_key || '|' || chr(10) || CASE i WHEN 0 THEN '|---|---|' || chr(10) ELSE '' END, '' ORDER BY i) AS markdown FROM s GROUP BY s_nationkey HAVING count(*) BETWEEN 2 AND 79"
)
def pdf_ruled_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _supplier_files(spark, sf_dir)
    return tb.ruled_tables(pdf.pdf_items(files), pdf.pdf_segments(files)).select("doc_id", "columns", "rows", "markdown")


@query(
    "WITH n AS (SELECT n_regionkey, n_nationkey, n_name, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS i, count(*) OVER (PARTITION BY n_regionkey) AS n FROM nation) SELECT CAST(n_regionkey AS VARCHAR) AS doc_id, 2 AS columns, CAST(count(*) AS INTEGER) AS rows, string_agg('|' || n_nationkey || '|' || n_name || '|' || chr(10) || CASE i WHEN 1 THEN '|---|---|' || chr(10) ELSE '' END, '' ORDER BY i) AS markdown FROM n WHERE n >= 3 GROUP BY n_regionkey"
)
def pdf_rect_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells drawn as rectangles, in a form of half the size."""
    n = _read(spark, sf_dir, "nation").withColumn("i", F.row_number().over(Window.partitionBy("n_regionkey").orderBy("n_nationkey")) - 1)
    y = F.lit(1400) - F.col("i") * 60
    line = F.concat(F.lit("q .5 0 0 .5 0 0 cm 100 "), y.cast("string"), F.lit(" 200 60 re 300 "), y.cast("string"), F.lit(" 400 60 re f BT /F1 20 Tf 120 "), (y + 20).cast("string"), F.lit(" Td ("), F.col("n_nationkey").cast("string"), F.lit(") Tj 200 0 Td ("), F.col("n_name"), F.lit(") Tj ET Q"))
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", line.alias("line")))), lambda p: p["line"]), "\n")
    files = n.groupBy("n_regionkey").agg(lines.alias("lines")).select(F.col("n_regionkey").cast("string").alias("path"), _pdf(F.col("lines")).alias("content"))
    return tb.rect_tables(pdf.pdf_items(files), pdf.pdf_rects(files)).select("doc_id", "columns", "rows", "markdown")
