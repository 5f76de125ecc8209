from __future__ import annotations

import os

import pytest

import corpus_pipeline

DATA = "/root/testdata/sf0.001"


def test_stages():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "jaccard", "mixing", "packing"]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_each_stage_works_on_what_the_one_before_kept(spark):
    from assay.llm.common import saved

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, kept = docs.columns, {r.doc_id for r in docs.collect()}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = saved(stage(spark, docs, DATA), name)
        now = {r.doc_id for r in docs.select("doc_id").collect()}
        assert now and now <= kept
        kept = now
        assert i == 3 or docs.columns == columns
    assert {"sequence_id", "offset", "length"} <= set(docs.columns)
