"""Clouds of fingerprints: crowded keys give the same components as all pairs do."""

import itertools
import random

import pytest
from test_dedup import components

from tessera.llm import simhash
from tessera.llm.common import connected_components


def cloud(rng, centre, n, most):
    out = set()
    while len(out) < n:
        x = centre
        for b in rng.sample(range(64), rng.randint(0, most)):
            x ^= 1 << b
        out.add(x)
    return out


@pytest.mark.parametrize("crowd", [0, 5, 40, 1024])
def test_components_of_clouds(spark, crowd):
    rng = random.Random(crowd)
    fps = set().union(*(cloud(rng, rng.getrandbits(64), 60, most) for most in (2, 4, 6, 9)), {rng.getrandbits(64) for _ in range(60)})
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    found = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"), crowd)
    pairs = {tuple(r) for r in found.collect()}
    near = {(a, b) for a, b in itertools.combinations(sorted(signed), 2) if ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 3}
    assert pairs <= near and (crowd < 1024 or pairs == near)
    expected = components(signed, near)
    roots = {r.node: r.root for r in connected_components(found).collect()}
    assert {x: roots.get(x, x) for x in signed} == expected


def test_masks_leave_the_key_alone(spark):
    fp = random.Random(3).getrandbits(63)
    masks = simhash._free_masks()
    assert len(masks) == len(set(masks)) == 24 * 529
    keys = simhash._chain_keys(simhash.F.col("fp")).alias("keys")
    own = spark.createDataFrame([(fp,)], "fp long").select(keys).first()[0]
    rows = spark.createDataFrame([(slot, fp ^ mask) for slot, mask, _ in masks], "slot long, fp long").select("slot", keys).collect()
    assert all(r[1][r.slot] == own[r.slot] for r in rows)
