"""License scans by ordered signature rules.

A rule has a label, a priority, a keyword and a regular expression (``signatures``).
Of the rules only those run whose keyword, and all other words that stand in every
match, the text holds.  A detection that another
one contains goes unless its priority is higher (its number smaller) and its label
another one; of equal stretches the better rule stays.  Detections are compared
within groups that overlap, so the work grows with a text, not with its square.

Everything is DataFrame and SQL functions in the row: no join, no Python on executors.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii
from .signatures import ROOTS, SIGNATURES
from .spans import before, block_sums, earlier_sums, quoted, with_groups

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]"
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BASE_PHRASES = {"mit": ["mit", "license"], "apache": ["apache", "license"], "gpl": ["general", "public", "license"]}
#: A text without a root is tried only if this is found.
CC_BY = r"(?<![0-9a-z])cc[^0-9a-z]+by(?![0-9a-z])"


def rules() -> list[tuple[int, str, str, str]]:
    """(priority, label, keyword, expression over lower-case text), best first."""
    found = []
    for i, line in enumerate(SIGNATURES.strip().splitlines()):
        label, keyword, words = line.split(" :: ")
        # no version ends before a further part of its number
        over = rf"(?!{WORD})" + (r"(?!\.[0-9])" if words[-1:].isdigit() or words.endswith(r"(?:\.0)?") else "")
        # a blank before a question mark is a gap that may be missing
        gapped = words.replace(" ?", "\0").replace(" ", GAP).replace("\0", f"(?:{GAP})?")
        found.append((i, label, keyword, rf"(?<!{WORD})(?:{gapped}){over}"))
    return found


def _needed(words: str) -> list[str]:
    """Strings that every match of a signature holds: those outside its groups."""
    plain = re.sub(r"\(\?:[^()]*\)\??", " ", words.replace(" ?", " "))
    return sorted({w for w in re.findall(r"(?<![\\\[])[a-z]{3,}", re.sub(r"\[sc\]e", " ", re.sub(r".\?", "", plain)))})


def _tried() -> str:
    """SQL: the rules whose strings are in low and whose expression matches it.  Rules of
    one keyword stand together, so that a text without it passes over all of them."""
    groups: dict[str, list[str]] = {}
    signatures = [line.split(" :: ")[2] for line in SIGNATURES.strip().splitlines()]
    for (p, label, keyword, expression), words in zip(rules(), signatures):
        needed = ", ".join(quoted(w) for w in [keyword, *_needed(words)])
        groups.setdefault(keyword, []).append(f"struct({p} as p, {quoted(label)} as l, array({needed}) as k, {quoted(expression)} as e)")
    known = ", ".join(f"struct({quoted(k)} as k, array({', '.join(rs)}) as rules)" for k, rs in groups.items())
    return f"flatten(transform(filter(array({known}), g -> contains(low, g.k)), g -> filter(g.rules, r -> forall(r.k, k -> contains(low, k)) and low rlike r.e)))"


def words_of(text: Column) -> Column:
    """Words of a lower-cased text."""
    return F.filter(F.split(lower_ascii(text), GAP), lambda w: w != "")


def _detections(df: DataFrame) -> DataFrame:
    """Adds found (labels) and n_found from column low, the lower-case text, which is
    null for texts that no rule can match."""
    df = df.withColumn("__r", F.expr(f"CASE WHEN low is not null THEN {_tried()} END"))
    df = df.withColumn("__r", F.expr("transform(__r, r -> struct(r.p as p, r.l as l, split(low, r.e, -1) as g, regexp_extract_all(low, r.e, 0) as t))"))
    df = df.withColumn("__r", F.expr("transform(__r, r -> struct(r.p as p, r.l as l, r.g as g, r.t as t, transform(r.t, (x, i) -> length(x) + length(r.g[i])) as n))"))
    df = df.withColumn("__r", F.expr(f"transform(__r, r -> struct(r.p as p, r.l as l, r.g as g, r.t as t, r.n as n, {block_sums('r.n')} as s))"))
    df = df.withColumn("__r", F.expr(f"transform(__r, r -> struct(r.p as p, r.l as l, r.g as g, r.t as t, r.n as n, {earlier_sums('r.s')} as s))"))
    starts = f"transform(r.t, (x, i) -> {before('r.n', 'r.s')} + length(r.g[i]))"
    df = df.withColumn("__r", F.expr(f"transform(__r, r -> struct(r.p as p, r.l as l, r.t as t, {starts} as a))"))
    df = df.withColumn("__r", F.expr("flatten(transform(__r, r -> transform(r.t, (x, i) -> struct(r.a[i] as a, r.a[i] + length(x) as b, r.p as p, r.l as l))))"))
    df = with_groups(df, "__r", "__r")
    held = "o.a <= s.a and o.b >= s.b and (o.b - o.a > s.b - s.a and (o.p < s.p or o.l = s.l) or o.a = s.a and o.b = s.b and o.p < s.p)"
    df = df.withColumn("__r", F.expr(f"flatten(transform(__r, g -> filter(g, s -> not exists(g, o -> {held}))))"))
    return df.withColumns({"found": F.expr("coalesce(array_distinct(transform(__r, s -> s.l)), array())"), "n_found": F.expr("greatest(size(__r), 0)")})


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score),
    one row for each row of ``docs``.

    Null and empty texts have no words, no places and empty labels; without a base
    place first_word and last_word are null.  score is 1 with a base place, else
    1 - 1 / (1 + detections left).  Repeated rows give repeated rows; an empty table
    gives none; ids may be null; other columns are not read; texts of any length are
    read whole.
    """
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    n_words = F.regexp_count("text", F.lit(r"[0-9A-Za-z\x{80}-\x{10FFFF}]+")).cast("long")
    # lower() is fast and finds all that translate() would, which is then left to few texts
    rooted = " or ".join(f"contains(wide, {quoted(r)})" for r in ROOTS)
    hinted = F.expr(f"{rooted} or contains(wide, 'cc') and wide rlike {quoted(CC_BY)}")
    df = texts.select("doc_id", "text", n_words.alias("n_words"), F.lower("text").alias("wide"))
    df = df.select("doc_id", "n_words", F.when(hinted, lower_ascii(F.col("text"))).alias("low"))
    df = df.withColumn("w", F.when(F.col("low").contains("license"), F.filter(F.split("low", GAP), lambda w: w != "")))
    for label, phrase in BASE_PHRASES.items():
        same = " and ".join(f"w[i{f' + {k}' if k else ''}] = '{p}'" for k, p in enumerate(phrase))
        places = f"CASE WHEN size(w) >= {len(phrase)} THEN filter(sequence(0, size(w) - {len(phrase)}), i -> {same}) END"
        df = df.withColumn(label, F.expr(f"coalesce({places}, cast(array() as array<int>))"))
    df = _detections(df.drop("w"))
    df = df.withColumns(
        {
            "every": F.concat(*BASE_PHRASES),
            "bl": F.array_sort(F.array_compact(F.array(*[F.when(F.size(l) > 0, F.lit(l)) for l in BASE_PHRASES]))),
        }
    )
    n_base = F.size("every").cast("long")
    return df.select(
        "doc_id",
        "n_words",
        n_base.alias("n_base"),
        F.array_min("every").cast("long").alias("first_word"),
        F.array_max("every").cast("long").alias("last_word"),
        F.array_join("bl", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("bl", "found")), ",").alias("labels"),
        F.when(n_base > 0, F.lit(1.0)).otherwise(1 - 1 / (1 + F.col("n_found"))).alias("score"),
    )
