"""The pipeline: order, columns and what each stage keeps."""

import random

import pytest

import corpus_pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, __row string, __first int"


def test_stages_are_the_five_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_dedup", "decontamination", "redaction", "encoding"]


def test_each_stage_keeps_columns_and_only_removes_rows(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = {r.doc_id: r.text for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, sf)
        assert after.columns == docs.columns, name
        rows = {r.doc_id: r.text for r in after.collect()}
        assert rows.keys() <= before.keys()
        if name != "redaction":
            assert all(before[i] == t for i, t in rows.items())
        before, docs = rows, after
    final = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert {r.doc_id for r in final.collect()} == before.keys()


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages_take_empty_tables(spark, sf, name, stage):
    assert stage(spark, spark.createDataFrame([], SCHEMA), sf).collect() == []


def test_stages_take_awkward_rows(spark, sf):
    r = random.Random(3)
    prose = " ".join(f"w{r.randrange(5000)}" for _ in range(200))
    rows = [(1, prose), (1, prose), (2, None), (3, ""), (None, prose + " end"), (None, None), (4, "x " * 20_000), (5, prose + " mail me@example.com")]
    docs = spark.createDataFrame([(i, t, None, "s", 0, "row", 1) for i, t in rows], SCHEMA)
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        kept[name] = sorted((x.doc_id or -1 for x in out.collect()))
        if name != "encoding":
            assert out.columns == docs.columns
    assert kept["quality_rules"] == [-1, 1, 1, 5]
    assert kept["near_dedup"].count(1) == 1 and 2 in kept["near_dedup"]
    assert kept["decontamination"] == kept["redaction"] == kept["encoding"] == [-1, -1, 1, 1, 2, 3, 4, 5]
    redacted = corpus_pipeline.redaction(spark, docs, sf).filter("doc_id = 5").first().text
    assert redacted.endswith("mail [EMAIL]")
