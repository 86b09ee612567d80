import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, seen = docs.columns, {"start": {r.doc_id for r in docs.collect()}}
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.materialise(stage(spark, docs, sf), name)
        seen[name] = {r.doc_id for r in docs.select("doc_id").collect()}
        if name != "packing":
            assert docs.columns == columns
        if name == "secret_scan":
            assert docs.where(F.col("text").rlike("AKIA[A-Z0-9]{14,}|[0-9a-f]{16,}")).count() == 0
            assert docs.where(F.char_length("text") != F.col("n_chars")).count() == 0
    assert seen["start"] >= seen["language"] >= seen["near_duplicates"] == seen["secret_scan"] >= seen["mixture"] == seen["packing"]
    assert set(docs.columns) >= {"doc_id", "piece", "sequence_id", "offset", "length"}


def test_odd_rows(spark, sf, odd, none):
    """Rows, columns and values of each stage over nulls, empty texts, repeats and clashing names."""
    names = ("secret_spans", "spans", "__size", "__reps", "__turn", "gone", "row", "lang_pred", "c0", "a.b")
    docs = odd
    for c in names:
        docs = docs.withColumn(c, F.lit("own"))
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.materialise(stage(spark, docs, sf), name)
        kept[name] = sorted(str(r.doc_id) for r in docs.select("doc_id").collect())
        if name != "packing":
            assert docs.columns == columns
            assert all(docs.where(f"`{c}` <> 'own' or `{c}` is null").isEmpty() for c in names)
    assert kept["language"] == ["1", "1", "2", "6", "7", "None"]
    assert kept["near_duplicates"] == kept["secret_scan"] == ["1", "1", "6", "7", "None"]
    assert set(kept["mixture"]) <= set(kept["secret_scan"]) and set(kept["packing"]) == set(kept["mixture"])
    assert docs.groupBy("row", "piece").count().where("count > 1").isEmpty()  # repetitions are told apart
    docs = none
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.materialise(stage(spark, docs, sf), name)
        assert docs.isEmpty() and (name == "packing" or docs.columns == none.columns)


def test_language_without_labels(spark, sf):
    """Nothing to learn from: documents with a letter stay as they are."""
    docs = spark.createDataFrame([(1, "some words", None, "a", 10), (2, "123 .", None, "a", 5), (3, None, None, "a", 0), (4, "слово", None, "a", 5)], "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.STAGES[0][1](spark, docs, sf)
    assert sorted(r.doc_id for r in out.collect()) == [1, 4] and out.columns == docs.columns and out.where("lang is not null").isEmpty()


def test_run(spark, sf):
    assert corpus_pipeline.run(spark, sf).count() > 0 and corpus_pipeline.ORACLE_SQL is None
