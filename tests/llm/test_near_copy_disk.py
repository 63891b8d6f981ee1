"""What the near-copy stage writes: each key of a text once, a part of the ring at a time, and few pairs by chance."""

import random
import time

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from test_similar import variant

from tessera.llm import simhash
from tessera.llm.common import cut


def test_crowded_texts_are_filed_once(spark, monkeypatch):
    made, whole = [], simhash.map_arrow

    def noted(df, fn, schema):
        out = whole(df, fn, schema)
        if schema.startswith("key"):
            made.append(out.count())
        return out

    monkeypatch.setattr(simhash, "map_arrow", noted)
    rng = random.Random(4)
    words = [f"b{i}" for i in range(204)]
    texts = [" ".join(f"o{k}" for k in range(60)), *(variant(rng, words, 2) for _ in range(80))]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = simhash.similar_groups(frame).collect()
    n, segments = len(set(texts)), simhash.ring_segments(8, 0.8)
    assert sum(made) == n * segments * simhash._NEXT and max(made) <= 0.4 * sum(made)
    assert {r.component_id for r in found} == {0, 1}


def test_parts_have_all_keys():
    prints = np.random.default_rng(2).integers(0, 256, (5, 96), dtype=np.uint8)
    cuts = [c * 96 // 32 for c in simhash._CUTS]
    parts = np.concatenate([simhash.ring_keys(prints, 8, 2, p) for p in zip(cuts, cuts[1:], strict=False)], axis=1)
    assert (np.sort(parts, axis=1) == np.sort(simhash.ring_keys(prints, 8, 2), axis=1)).all()


def test_unrelated_texts_of_a_key_are_not_listed():
    """They agree in the 16 bits of the key."""
    rng, n = np.random.default_rng(6), 1000
    words = rng.integers(0, 1 << 64, (simhash._WORDS, n), dtype=np.uint64)
    words[0] &= np.uint64((1 << 48) - 1)
    columns = [np.zeros(n, dtype=np.int64), np.arange(n), np.arange(n), *words.view(np.int64)]
    rows = pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["key", "id", "group", *simhash._WORD_NAMES])
    out = pa.Table.from_batches(list(simhash._meet(n, simhash.words_limit(0.8))([rows])))
    assert out.num_rows < 20  # of 499,500 pairs; 128 bits let some 4,000 through


def test_what_a_group_holds_is_not_compared_again():
    ids = np.arange(40)
    for groups, rows in ((ids, 40), (ids * 0 + 7, 0), (ids // 20, 2)):
        columns = [np.zeros(40, dtype=np.int64), ids, groups, *[np.zeros(40, dtype=np.int64)] * 3]
        batch = pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["key", "id", "group", *simhash._WORD_NAMES])
        out = pa.Table.from_batches(list(simhash._meet(32, 10)([batch.slice(a, 7) for a in range(0, 40, 7)])))
        assert out.num_rows == rows and out.column("dense").null_count == 0


def shuffle_files(spark):
    found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {name for k in range(found.size()) if (name := found.apply(k).getName()).startswith("shuffle_")}


def test_a_checkpoint_leaves_no_shuffle_files(spark):
    before = shuffle_files(spark)
    rows = cut(spark.range(10_000).repartition(4, "id").groupBy((F.col("id") % 7).alias("k")).count())
    for _ in range(100):
        if not (left := shuffle_files(spark) - before):
            break
        time.sleep(0.1)
    assert not left and rows.count() == 7 and spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_a_frame_is_read_again_after_its_checkpoint(spark):
    frame = spark.range(10_000).repartition(4, "id").groupBy((F.col("id") % 7).alias("k")).count()
    first = {tuple(r) for r in frame.collect()}
    assert {tuple(r) for r in cut(frame).collect()} == first == {tuple(r) for r in cut(frame).collect()} == {tuple(r) for r in frame.collect()}
