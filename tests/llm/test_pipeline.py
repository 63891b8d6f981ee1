"""The pipeline: each stage keeps its promise on planted cases; run() applies them all."""

import random

import corpus_pipeline as pipeline
import pytest

from tessera.llm import simhash

SF = "/root/testdata/sf0.001"
COLUMNS = list(pipeline.COLUMNS)


@pytest.fixture(scope="module")
def planted(spark):
    rng = random.Random(4)
    words = [f"{rng.choice('bcdfgklmnprst')}{rng.choice('aeiou')}{rng.choice('lmnrst')}{rng.choice('aeiou')}" for _ in range(400)]
    fresh = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base, passage = fresh(200), fresh(60)
    near = base.split()
    near[50] = "changed"
    texts = {10_001: base, 10_002: base, 10_003: " ".join(near), 10_004: fresh(80) + " " + passage, 10_005: fresh(80) + " " + passage, 10_006: None, 10_007: "", 10_008: "123 !!!"}
    extra = spark.createDataFrame([(i, t, "en", "planted", len(t or "")) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long")
    return spark.read.parquet(f"{SF}/documents.parquet").select(*COLUMNS).union(extra).cache(), passage


def test_stages(spark, planted, tmp_path):
    docs, passage = planted
    names = [n for n, _ in pipeline.STAGES]
    assert names == ["language_id", "toxicity", "simhash_near_dedup", "suffix_array_dedup", "packing"]
    seen = {}
    for name, stage in pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{name}")
        docs = seen[name] = spark.read.parquet(f"{tmp_path}/{name}")
        if name != "packing":
            assert docs.columns == COLUMNS
    ids = {n: {r.doc_id for r in d.select("doc_id").collect()} for n, d in seen.items()}
    assert ids["language_id"] & {10_006, 10_007, 10_008} == set() and len(ids["language_id"]) >= 203
    assert ids["toxicity"] >= {10_001, 10_002, 10_003, 10_004, 10_005}
    assert ids["simhash_near_dedup"] & {10_001, 10_002, 10_003} == {10_001} and ids["simhash_near_dedup"] >= {10_004, 10_005}
    groups = {r.doc_id: r.component_id for r in simhash.similar_groups(seen["toxicity"]).collect()}
    assert ids["simhash_near_dedup"] == {i for i, low in groups.items() if i == low}
    text = {r.doc_id: r.text for r in seen["suffix_array_dedup"].collect()}
    assert text.keys() == ids["simhash_near_dedup"] and passage in text[10_004] and passage[60:-60] not in text[10_005]
    assert ids["packing"] == ids["suffix_array_dedup"]


def test_run(spark):
    found = pipeline.run(spark, SF)
    assert {"doc_id", "start", "length", "sequence_id", "offset"} <= set(found.columns) and found.count() > 100


def test_no_documents(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for name, stage in pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert docs.count() == 0
