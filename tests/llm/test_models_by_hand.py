"""The models against plain Python, which shares no code with them: buckets, posteriors, terms and margins."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest

from tessera.llm import langid, toxicity

TEXTS = [("The cat sat on the mat", "en"), ("Der Hund läuft über die Straße", "de"), ("le chat est là, où?", "fr"), ("the dog and the cat", "en"), ("die Katze", "de")]


def bucket(gram, bits):
    """A gram of 1 to 3 code points."""
    h = 0
    for n, (c, m) in enumerate(zip(gram, (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D), strict=False)):
        h = (h ^ (ord(c) + n + 1)) * m % (1 << 32)
        h ^= h >> 15
    return h * 0x27D4EB2F % (1 << 32) >> (32 - bits)


def grams(text, bits):
    low = text.lower()
    return Counter(bucket(low[i : i + n], bits) for n in (1, 2, 3) for i in range(len(low) - n + 1))


def test_naive_bayes(spark):
    bits, langs = 10, ["de", "en", "fr"]
    model = langid.train(spark.createDataFrame([(i, t, x) for i, (t, x) in enumerate(TEXTS)], "doc_id long, text string, lang string"), bits=bits)
    assert model.langs == langs
    counts = {x: sum((grams(t, bits) for t, y in TEXTS if y == x), Counter()) for x in langs}
    total = {x: sum(counts[x].values()) + 0.5 * 2**bits for x in langs}
    prior = {x: sum(y == x for _, y in TEXTS) / len(TEXTS) for x in langs}
    some = ["the mat", "Straße", "où est le chat", "x", "Hund " * 300]
    names, scores = langid.score(some, model)
    for text, name, p in zip(some, names, scores, strict=True):
        own = grams(text, bits)
        logs = {x: math.log(prior[x]) + sum(n * math.log((counts[x][b] + 0.5) / total[x]) for b, n in own.items()) for x in langs}
        best = max(langs, key=logs.get)
        temper = min(1, 64 / sum(own.values()))
        assert name == best
        assert p == pytest.approx(1 / sum(math.exp((logs[x] - logs[best]) * temper) for x in langs), abs=1e-3)


def test_terms_and_scores():
    text = "An Insult, insulting the GROUP_x 42 an"
    words = {"an", "insult", "insulting", "the", "group", "x", "42"}
    terms = words | {f"4 {w[:4]}" for w in words if len(w) >= 4} | {f"6 {w[:6]}" for w in words if len(w) >= 6}
    hashed = sorted(zlib.crc32(t.encode()) % (1 << 18) for t in terms)
    assert sorted(toxicity._terms(text, toxicity._Terms(18, None))) == sorted(set(hashed))
    rng = np.random.default_rng(2)
    place = {h: i for i, h in enumerate(hashed[::2])}
    model = toxicity.Model(18, place, 0.3, rng.normal(size=len(place)), rng.normal(size=(len(place), 3)))
    rows = list(place.values())
    margin = 0.3 + sum(model.w[i] for i in rows) + sum(model.v[i] @ model.v[j] for i in rows for j in rows if i < j)
    assert toxicity.score([text], model)[0] == pytest.approx(1 / (1 + math.exp(-margin)))
