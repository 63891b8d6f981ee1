"""Groups of near-copies against brute force where leaders, fingerprints or samples of the sets do not suffice."""

import random

import pytest

from tessera.llm import simhash


def grouped(spark, texts):
    """component_id by doc_id as found, and by comparing all pairs."""
    sets = {i: set(simhash.shingle_hashes(t, 5).tolist()) for i, t in texts.items()}
    root = {i: i for i in texts}
    for a in texts:
        for b in texts:
            both = len(sets[a] & sets[b])
            if a < b and root[a] != root[b] and both / (len(sets[a]) + len(sets[b]) - both) >= 0.8:
                low, high = sorted((root[a], root[b]))
                root = {i: low if r == high else r for i, r in root.items()}
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    return {r.doc_id: r.component_id for r in simhash.similar_groups(frame).collect()}, root


def variant(rng, words, edits, apart=10):
    own = list(words)
    for place in rng.sample(range(5, len(own) - 5, apart), edits):
        own[place] = f"e{rng.getrandbits(60)}"
    return " ".join(own)


@pytest.fixture(params=[None, (16, 2000)])
def blocks(request, monkeypatch):
    if request.param:
        monkeypatch.setattr(simhash, "_BLOCK_DOCS", request.param[0])
        monkeypatch.setattr(simhash, "_BLOCK_SHINGLES", request.param[1])


def test_star_of_variants(spark, blocks):
    """Each variant is like the base (0.818) and unlike the others (0.67), and the base leads few bands."""
    rng = random.Random(5)
    words = [f"b{i}" for i in range(204)]
    texts = {1000 + i: variant(rng, words, 4) for i in range(300)} | {5000: " ".join(words)}
    found, expected = grouped(spark, texts)
    assert found == expected and set(expected.values()) == {1000}


def test_shared_boilerplate(spark, blocks):
    """Documents of one boilerplate (0.74) share bands; only copies with an edit are to be linked."""
    rng = random.Random(6)
    boiler = [f"s{i}" for i in range(174)]
    texts = {}
    for i in range(120):
        words = boiler + [f"o{i}x{k}" for k in range(30)]
        texts[rng.getrandbits(40)] = " ".join(words)
        texts[rng.getrandbits(40)] = variant(rng, words, 2)
    found, expected = grouped(spark, texts)
    assert found == expected and len(set(expected.values())) == 120


def test_repeated_lines(spark):
    """Equal sets are copies, however often one of them repeats a line; so are alike sets whatever their fingerprints."""
    rng = random.Random(7)
    texts = {}
    for i in range(30):
        words = [f"r{i}x{k}" for k in range(200)]
        line = words[50:60] * 2  # the repeats add the shingles across their border, at most 10
        texts[10 * i] = " ".join([*words, *line])
        texts[10 * i + 1] = " ".join([*words, *line * 20])
        texts[10 * i + 2] = variant(rng, words, 2)
    found, expected = grouped(spark, texts)
    assert found == expected and set(expected.values()) == {10 * i for i in range(30)}


def test_long_documents_near_the_threshold(spark):
    """Over 512 shingles, similarity 0.79 to 0.81: decided on the whole sets."""
    rng = random.Random(8)
    texts = {}
    for i in range(60):
        words = [f"l{i}x{k}" for k in range(2004)]
        texts[10 * i] = " ".join(words)
        texts[10 * i + 1] = variant(rng, words, 42 + i % 6)  # 2000 shingles, 5 lost for each edit
    found, expected = grouped(spark, texts)
    assert found == expected and 60 < len(set(expected.values())) < 120
