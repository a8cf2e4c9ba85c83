"""The pipeline's stages one by one, on texts of many kinds and on empty tables."""

import corpus_pipeline
from tickloom.llm import decontaminate, minhash, quality


def test_stages(spark, folder, docs):
    bad = spark.read.parquet(f"{folder}/documents.parquet")
    at = bad
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, at, folder)
        assert out.columns == bad.columns, name
        assert out.count() <= at.count()
        at = out
    last = corpus_pipeline.packed(spark, at, folder)
    assert {r.doc_id for r in last.select("doc_id").collect()} == {r.doc_id for r in at.select("doc_id").collect()}


def test_each_stage_decides(spark, docs, folder):
    bench = spark.read.parquet(f"{folder}/benchmark.parquet")
    hit = {r.doc_id for r in decontaminate.contamination(docs, bench).where("size(hit_spans) > 0").collect()}
    left = {r.doc_id for r in corpus_pipeline.without_benchmark(spark, docs, folder).collect()}
    assert hit and hit.isdisjoint(left)
    groups = minhash.near_groups(docs, 80)
    kept = {r.doc_id for r in groups.where("kept and doc_id is not null").collect()}
    assert {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, folder).where("doc_id is not null").collect()} == kept
    model = quality.train(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    good = {r.doc_id for r in quality.good_documents(docs, model).collect()}
    assert {r.doc_id for r in corpus_pipeline.quality(spark, docs, folder).collect()} == good


def test_empty(spark, empty):
    assert corpus_pipeline.run(spark, empty).count() == 0
