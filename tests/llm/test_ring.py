"""The near-copy stage proposes its pairs by SimHash fingerprints: chains on a ring of segments."""

import os
import random

import numpy as np
import pytest
from test_similar import grouped, variant

from tessera.llm import simhash


def shared(a, b, bits):
    keys = [set(simhash.ring_keys(np.frombuffer(x, dtype=np.uint8)[None], bits, 2)[0].tolist()) for x in (a, b)]
    return keys[0] & keys[1]


@pytest.mark.parametrize("bits", [8, 9, 10])
def test_pairs_within_two_thirds_of_the_segments_meet(bits):
    rng = random.Random(bits)
    segments = simhash.ring_segments(bits, 0.8)
    for n in range(200):
        one = rng.getrandbits(bits * segments)
        most = (2 * segments - 1) // 3
        spread = rng.sample(range(bits * segments), most)
        even = [i * bits * segments // most for i in range(most)]
        other = one
        for b in even if n % 2 else spread:
            other ^= 1 << b
        assert shared(*(x.to_bytes(bits * segments // 8, "big") for x in (one, other)), bits)


def test_pairs_at_the_threshold_meet():
    rng = np.random.default_rng(3)
    size, met = simhash.ring_segments(8, 0.8) // 8, 0
    for _ in range(1000):
        pool = rng.integers(0, 1 << 63, 200, dtype=np.uint64)  # 160 of 200 in both
        met += bool(shared(simhash.ring_print(pool[:180], size), simhash.ring_print(np.concatenate([pool[:160], pool[180:]]), size), 8))
    assert met >= 998


def some_texts():
    rng = random.Random(9)
    words = [f"b{i}" for i in range(204)]
    texts = {1000 + i: variant(rng, words, 3) for i in range(60)} | {5000: " ".join(words)}
    boiler = [f"s{i}" for i in range(174)]
    for i in range(40):
        own = boiler + [f"o{i}x{k}" for k in range(30)]
        texts[10 * i] = " ".join(own)
        texts[10 * i + 1] = variant(rng, own, 2)
        texts[10 * i + 2] = f"short text number {i} of a few words"
        texts[10 * i + 3] = f"short text number {i} of a few words it is"
    return texts


@pytest.mark.parametrize("options", [{}, {"crowd": 3}, {"bits": 9, "crowd": 2}])
def test_groups_with_crowds_and_longer_segments(spark, options, monkeypatch):
    whole = simhash.similar_groups
    monkeypatch.setattr(simhash, "similar_groups", lambda docs: whole(docs, **options))
    found, expected = grouped(spark, some_texts())
    assert found == expected


def test_no_pair_without_fingerprints(spark, monkeypatch):
    """Fingerprints that say nothing leave every text alone: nothing else proposes pairs."""
    monkeypatch.setattr(simhash, "ring_print", lambda own, size: os.urandom(8 * size))
    texts = {i: t for i, t in some_texts().items() if i >= 1000}
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r.doc_id for r in simhash.similar_groups(frame).collect() if r.kept} >= {1000, 5000}
