"""The pipeline's stages, each on what the one before kept, against plain Python."""

from __future__ import annotations

import pathlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_simhash_and_bpe import plain_components, plain_fingerprint

FOLDER = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not pathlib.Path(FOLDER).exists(), reason="no test tables here")


def test_stages_keep_the_columns_and_act(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        docs = stage(spark, docs, FOLDER)
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        if name != "byte_bpe":
            assert docs.columns == columns
        kept[name] = (before, docs.collect())
    before, after = kept["language_id"]
    assert len(after) >= 0.97 * len(before)
    before, after = kept["exact_dedup"]
    largest = {}
    for r in before:
        largest[r.text] = max(largest.get(r.text, -1), r.doc_id)
    assert {r.doc_id for r in after} == set(largest.values()) and len(after) == len(largest)
    before, after = kept["simhash_near_dedup"]
    groups = plain_components([plain_fingerprint(r.text) for r in before])
    assert {r.doc_id for r in after} == {min(r.doc_id for r, h in zip(before, groups) if h == g) for g in set(groups)}
    before, after = kept["source_mix"]
    words = Counter()
    for r in before:
        words["in"] += len(r.text.split())
    assert abs(sum(len(r.text.split()) for r in after) - 1.5 * words["in"]) < 0.02 * words["in"] + 200
    before, after = kept["byte_bpe"]
    assert sorted(r.doc_id for r in after) == sorted(r.doc_id for r in before)
    assert all(r.n_tokens == len(r.token_ids) for r in after)


def test_the_whole_run(spark):
    out = corpus_pipeline.run(spark, FOLDER)
    assert out.count() > 100 and "token_ids" in out.columns


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages_on_odd_and_on_no_rows(odd_docs, no_docs, spark, name, stage):
    more = odd_docs.withColumn("row", F.lit("r")).withColumn("digest", F.lit(1)).withColumn("component", F.lit(2)).withColumn("pass", F.lit(3)).withColumn("a.b", F.lit(4))
    out = stage(spark, more, FOLDER)
    if name == "byte_bpe":
        assert "a.b" in out.columns and out.count() == odd_docs.count()
    else:
        assert out.columns == more.columns
        assert out.count() > 0
    assert stage(spark, no_docs, FOLDER).collect() == []
