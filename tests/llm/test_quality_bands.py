"""The default compression bands reject encoded, random and half-repeated texts that pass the base rule."""

import base64
import random
import textwrap

import pytest

from tessera.llm import quality


def prose(rng, size):
    """Words of a vocabulary, the common ones more often."""
    words = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 9))) for _ in range(2000)]
    return " ".join(rng.choices(words, [1 / (k + 5) for k in range(2000)], k=size // 2))[:size]


def encoded(kind, rng, size):
    if kind == "base64":
        return "\n".join(textwrap.wrap(base64.b64encode(rng.randbytes(size)).decode()[:size], 76))
    if kind == "hex":
        return "\n".join(textwrap.wrap(rng.randbytes(size).hex()[:size], 64))
    return " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(8)) for _ in range(size // 9))


CASES = [("base64", n) for n in (900, 3000, 6000, 20_000, 100_000)] + [("words", n) for n in (3000, 6000, 20_000, 100_000)] + [("hex", n) for n in (6000, 20_000, 100_000)]


@pytest.mark.parametrize(("kind", "size"), CASES)
def test_encoded(kind, size):
    text = encoded(kind, random.Random(size), size)
    assert quality._Judge(quality.Bands()).verdict(text.encode())[2] == "incompressible"


def test_rejects_what_the_base_rule_passes(spark):
    rng = random.Random(2)
    texts = [prose(rng, 9000), encoded("base64", rng, 3000), prose(rng, 6000) + " " + "ab" * 1500]
    found = {r.doc_id: r for r in quality.measure(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert not any(r.base_failed for r in found.values())
    assert [found[i].verdict for i in range(3)] == ["ok", "incompressible", "repetitive"] and found[2].bad_chunk_share < 0.5
