"""Ordered runs: styled text, lists, anchors."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

STYLES = ["bold", "italic", "strike", "code"]


def merge_runs(runs: DataFrame) -> DataFrame:
    """Neighbouring runs (doc_id, seq, text, styles) of one style as one; empty
    runs go, and blank text between has no style of its own."""
    live = runs.filter("text <> ''")
    blank = F.trim("text") == ""
    plain = live.withColumns({s: F.col(s) & ~blank for s in STYLES})
    order = Window.partitionBy("doc_id").orderBy("seq")
    style = F.struct(*STYLES)
    new = F.when(F.lag(style).over(order) == style, 0).otherwise(1)
    numbered = plain.withColumn("__new", new).withColumn("__run", F.sum("__new").over(order))
    merged = numbered.groupBy("doc_id", "__run", *STYLES).agg(F.min("seq").alias("seq"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]), "").alias("text"))
    return merged.select("doc_id", "seq", "text", *STYLES)


def styled(runs: DataFrame) -> DataFrame:
    """Adds markdown: the text in its delimiters, edge white space outside."""
    inner, lead, tail = F.trim("text"), F.regexp_extract("text", "^( *)", 1), F.regexp_extract("text", "( *)$", 1)
    marks = F.concat(F.when(F.col("strike"), "~~").otherwise(""), F.when(F.col("bold"), "**").otherwise(""), F.when(F.col("italic"), "*").otherwise(""))
    body = F.when(F.col("code"), F.concat(F.lit("`"), inner, F.lit("`"))).otherwise(inner)
    return runs.withColumn("markdown", F.when(inner == "", F.col("text")).otherwise(F.concat(lead, marks, body, F.reverse(marks), tail)))


def number_lists(entries: DataFrame) -> DataFrame:
    """Adds list: a new one starts where the key (instance, marker) changes or, for
    numbers, where the number is not the last one plus 1.  (doc_id, seq, instance,
    marker, number), one level."""
    order = Window.partitionBy("doc_id").orderBy("seq")
    same = (F.lag("instance").over(order) == F.col("instance")) & (F.lag("marker").over(order) == F.col("marker"))
    next_number = (F.col("marker") == "bullet") | (F.lag("number").over(order) + 1 == F.col("number"))
    new = F.when(F.coalesce(same & next_number, F.lit(False)), 0).otherwise(1)
    return entries.withColumn("__new", new).withColumn("list", F.sum("__new").over(order)).drop("__new")


def claim_ids(names: DataFrame) -> DataFrame:
    """Adds id: each base name as it is the first time, then with -1, -2, ... and
    never one that an earlier row took.  (doc_id, seq, base), in order of seq; the
    names of one document are held at a time."""

    def fold(frame: pd.DataFrame) -> pd.DataFrame:
        taken, following, ids = set(), {}, []
        for base in frame.sort_values("seq")["base"]:
            name, n = base, following.get(base, 0)
            while name in taken:
                n += 1
                name = f"{base}-{n}"
            following[base] = n
            taken.add(name)
            ids.append(name)
        return frame.sort_values("seq").assign(id=ids)[["doc_id", "seq", "base", "id"]]

    kind = names.schema["doc_id"].dataType.simpleString()
    return names.select("doc_id", F.col("seq").cast("long").alias("seq"), "base").groupBy("doc_id").applyInPandas(fold, f"doc_id {kind}, seq long, base string, id string")
