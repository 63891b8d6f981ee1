"""The near-copy stage on a large family of texts that are alike by degrees: few pairs are listed, none is lost."""

import random

import numpy as np
import pyarrow as pa
import pytest
from test_similar import grouped, variant

from tessera.llm import simhash


def test_a_key_gives_no_more_pairs_than_rows():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 62, 2)
    keys, ids = np.repeat(np.arange(40), 30), np.tile(np.arange(100, 130), 40)  # 435 near pairs a key
    flip = 1 << rng.integers(0, 60, (2, len(keys)))
    whole = pa.RecordBatch.from_arrays([pa.array(c) for c in (keys, ids, base[0] ^ flip[0], base[1] ^ flip[1])], ["key", "id", "one", "two"])
    for step in (7, 1200):
        out = pa.Table.from_batches(list(simhash._meet(32, 40)(whole.slice(a, step) for a in range(0, len(keys), step))))
        assert out.num_rows <= len(keys)
        assert set(out.column(2).drop_null().to_pylist()) == set(range(100, 130))


def test_two_of_a_key_are_listed():
    whole = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in ([1, 1, 2, 2], [8, 5, 6, 7], [3, 2, 0, -1], [0, 0, 0, 0])], ["key", "id", "one", "two"])
    out = pa.Table.from_batches(list(simhash._meet(32, 40)([whole])))
    assert [r for r in out.select(["u", "v"]).to_pylist() if r["u"] is not None] == [{"u": 5, "v": 8}]


@pytest.mark.parametrize("at_once", [200_000, 0])
def test_groups_of_a_graded_family(spark, monkeypatch, at_once):
    """Similarity 1 to 0.4: most texts are linked through others, some with none."""
    monkeypatch.setattr(simhash, "_LINKS", at_once)
    rng = random.Random(12)
    words = [f"b{i}" for i in range(204)]
    texts = {1000 + i: variant(rng, words, i % 13) for i in range(150)} | {5 * i: " ".join(f"o{i}x{k}" for k in range(60)) for i in range(20)}
    found, expected = grouped(spark, texts)
    assert found == expected and 25 < len(set(expected.values())) < 150
