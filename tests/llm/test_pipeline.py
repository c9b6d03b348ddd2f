"""The pipeline's stages against plain versions on a small input."""

import random

from pyspark.sql import functions as F

import corpus_pipeline
from brute import contamination

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(-1, None, "en", "src0", 0), (-2, "12 34", "en", "src0", 5), (-3, "", None, None, 0)], docs.schema)
    full = docs.unionByName(odd)
    kept = corpus_pipeline.language_id(spark, full, SF)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in full.join(kept, "doc_id", "left_anti").collect()} == {-1, -2, -3}
    unique = corpus_pipeline.near_duplicates(spark, kept, SF)
    from test_joins import brute_components

    rows = [(r.doc_id, r.text) for r in kept.collect()]
    assert {r.doc_id for r in unique.collect()} == {i for i, _, c in brute_components(rows) if i == c}
    clean = corpus_pipeline.decontamination(spark, unique, SF)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    some = random.Random(0).sample(unique.select("doc_id", "text").collect(), 40)
    ids = {r.doc_id for r in clean.collect()}
    assert all((r.doc_id in ids) == (not contamination(r.text, items)[4]) for r in some)
    mixed = corpus_pipeline.source_mix(spark, clean, SF)
    assert mixed.columns == docs.columns and {r.doc_id for r in mixed.collect()} <= ids
    assert mixed.groupBy("doc_id").count().where("count > 2").count() == 0
    out = corpus_pipeline.token_files(spark, mixed, SF)
    assert out.count() == mixed.count()
    assert out.agg(F.max(F.col("start") + F.col("n_tokens"))).first()[0] == out.agg(F.sum("n_tokens")).first()[0]


def test_empty_input_goes_through(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs_next = stage(spark, docs, SF)
        assert docs_next.count() == 0
        docs = docs_next if docs_next.columns == docs.columns else docs
