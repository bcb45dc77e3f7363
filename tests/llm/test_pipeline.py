"""The stages one after another on the smallest tables."""

import os

import corpus_pipeline

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def test_stages_keep_columns_and_filter(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").cache()
    before, columns = docs.count(), docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF).cache()
        assert docs.columns == columns, name
        assert 0 < docs.count(), name
        if name in ("quality rules", "near-duplicate removal"):
            assert docs.count() < before
            before = docs.count()
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert pieces.groupBy("sequence_id").sum("length").where("`sum(length)` > 2048").count() == 0
    assert pieces.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
