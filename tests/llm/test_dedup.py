"""SimHash, similarity groups, embeddings, components and suffixes against brute force."""

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tessera.llm import embeddings, simhash, suffix_dedup
from tessera.llm.common import WORD, connected_components


def find(parent, a):
    while parent[a] != a:
        parent[a] = parent[parent[a]]
        a = parent[a]
    return a


def components(nodes, pairs):
    parent = {n: n for n in nodes}
    for a, b in pairs:
        x, y = find(parent, a), find(parent, b)
        parent[max(x, y)] = min(x, y)
    return {n: find(parent, n) for n in nodes}


def test_connected_components(spark):
    rng = random.Random(4)
    chain = [(i, i + 1) for i in range(100, 160)]
    star = [(1, i) for i in range(2, 40)]
    rest = [(rng.randint(200, 300), rng.randint(200, 300)) for _ in range(60)]
    edges = chain + star + [(b, a) for a, b in rest]
    found = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    nodes = {n for a, b in edges if a != b for n in (a, b)}
    expected = components(nodes, [e for e in edges if e[0] != e[1]])
    assert found == {n: r for n, r in expected.items() if n != r}  # the roots themselves are left out
    assert connected_components(spark.createDataFrame([], "u long, v long")).collect() == []


def slow_fingerprint(text, k=3):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(lower)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprint_is_sparks_hash(spark):
    text = "one Two three"
    h = simhash.shingle_hashes(text)
    (row,) = spark.range(1).select(F.xxhash64(F.lit("one two three")).alias("h")).collect()
    assert int(h[0]) == row.h % (1 << 64)
    for t in (None, "", "a", "a b", "A b C d e", "é É b", "x " * 500):
        assert simhash.fingerprint(simhash.shingle_hashes(t)) == slow_fingerprint(t)


def test_links_are_all_within_three_bits(spark):
    rng = random.Random(8)
    base = [rng.getrandbits(64) for _ in range(40)]
    fps = set(base)
    for b in base:
        for n in (1, 2, 3, 4, 5):
            for _ in range(4):
                fps.add(b ^ sum(1 << i for i in rng.sample(range(64), n)))
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    found = {(r.u, r.v) for r in simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long")).collect()}
    expected = {(a, b) for a in signed for b in signed if a < b and ((a ^ b) % (1 << 64)).bit_count() <= 3}
    assert found == expected and len(found) > 100


def test_near_duplicates(docs, no_docs):
    rows = docs.select("doc_id", "text").collect()
    fp = {(r.doc_id, r.text): slow_fingerprint(r.text) for r in rows}
    by = components(sorted(set(fp.values())), [(a, b) for a in fp.values() for b in fp.values() if (a ^ b).bit_count() <= 3])
    low = {}
    for (i, _), f in fp.items():
        if i is not None:
            low[by[f]] = min(low.get(by[f], 1 << 62), i)
    expected = sorted((str(r.doc_id), format(fp[r.doc_id, r.text], "016x"), low[by[fp[r.doc_id, r.text]]]) for r in rows)
    found = sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect())
    assert found == expected
    assert simhash.near_duplicates(no_docs).collect() == []


def test_similar_groups(spark, docs, no_docs):
    rng = random.Random(3)
    rows, sets = [], {}
    for g in range(25):
        words = [f"w{rng.randint(0, 5000)}" for _ in range(rng.choice([60, 150, 700]))]
        for c in range(4):
            own = list(words)
            for _ in range(rng.choice([0, 1, 2])) if len(own) > 100 else range(c % 2):
                own[rng.randrange(len(own))] = f"edit{rng.randint(0, 10**6)}"
            rows.append((g * 10 + c, " ".join(own)))
            sets[g * 10 + c] = {tuple(own[i : i + 5]) for i in range(len(own) - 4)}
    found = {r.doc_id: r.component_id for r in simhash.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    similar = [(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    assert found == components(sorted(sets), similar)
    groups = {r.doc_id: r.component_id for r in simhash.similar_groups(docs).collect() if r.doc_id is not None}
    assert groups[1] == groups[2] == 0 and groups[13] == groups[12] and groups[4] == groups[5] == groups[6] == 4 and groups[15] == 15
    assert simhash.similar_groups(no_docs).collect() == []


def slow_links(rows, threshold=0.98):
    fine = {}
    for i, e, label in rows:
        if i is not None and label is not None and e and all(v is not None and np.isfinite(v) for v in e) and any(e):
            fine[i] = (label, np.array(e, dtype=float))
    pairs = []
    for a, (la, x) in fine.items():
        for b, (lb, y) in fine.items():
            if a < b and la == lb and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= threshold:
                pairs.append((a, b))
    n = {i: 0 for i, _, _ in rows}
    for a, b in pairs:
        n[a] += 1
        n[b] += 1
    roots = components(sorted(n), pairs)
    return {i: (n[i], roots[i], roots[i] == i) for i in n}


@pytest.mark.parametrize("bounds", [{}, {"max_centres": 8, "block_rows": 16}, {"max_centres": 2, "block_rows": 9}])
def test_embeddings(spark, bounds):
    rng = np.random.default_rng(6)
    rows = []
    for i in range(220):
        base = rng.normal(size=4) if i % 3 or not rows else np.array(rows[rng.integers(0, len(rows))][1])
        rows.append((500 - i, [float(v) for v in base + (rng.normal(size=4) * 0.03 if i % 2 else 0)], int(i % 3) if i % 17 else None))
    inf, nan = float("inf"), float("nan")
    rows += [(1001, None, 1), (1002, [], 1), (1003, [0.0] * 4, 1), (1004, [nan, 1.0, 1.0, 1.0], 1), (1005, [inf, 1.0, 1.0, 1.0], 1), (1006, [None, 1.0, 1.0, 1.0], 1), (1007, [1.0, 1.0], 1), (1008, [2.0, 2.0], 1)]
    vectors = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, label int, cell string, n int")
    found = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embeddings.near_duplicates(vectors, **bounds).collect()}
    assert found == slow_links(rows)


def test_repeated_vector_ids(spark):
    rows = [(1, [1.0, 0.0], 0), (1, None, 0), (2, [1.0, 0.0], 0), (2, [0.0, 1.0], 0), (3, [0.0, 1.0], None)]
    found = embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in found) == [(1, 0, 1, True), (1, 1, 1, True), (2, 0, 2, True), (2, 1, 1, False), (3, 0, 3, True)]


def test_blocks_grow_with_their_label():
    assert [embeddings.block_size(n, 64, 4096) for n in (10, 10**5, 10**6, 10**8)] == [4096, 4096, 15625, 32768]
    assert embeddings.block_size(10**8, 4096, 4096) == 1024


def test_no_embeddings(spark):
    assert embeddings.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).collect() == []


def test_dual_traversal_finds_all_pairs():
    rng = np.random.default_rng(1)
    x = embeddings.unit(np.concatenate([rng.normal(size=(300, 6)), rng.normal(size=6) + 0.05 * rng.normal(size=(150, 6))]))
    tree, other = embeddings.CoverTree(x), embeddings.CoverTree(x[:200])
    for r in (0.05, 0.2, 0.7):
        near = np.sqrt(np.maximum(0, 2 - 2 * x @ x.T)) <= r
        for second, expected in ((None, {(i, j) for i, j in zip(*np.nonzero(np.triu(near, 1)), strict=True)}), (other, set(zip(*np.nonzero(near[:, :200]), strict=True)))):
            got = []
            embeddings.dual_traversal(tree, second, r, lambda a, b: got.extend(zip(a.tolist(), b.tolist(), strict=True)))
            pairs = [(min(p), max(p)) for p in got] if second is None else got
            assert len(pairs) == len(set(pairs)) and set(pairs) >= {(int(a), int(b)) for a, b in expected}


def slow_removal(rows, length=50):
    low = {}
    raw = [(i, (t or "").encode()) for i, t in rows]
    for i, b in raw:
        for k in range(len(b) - length + 1):
            s = b[k : k + length]
            low[s] = min(low.get(s, 1 << 62), i)
    out = []
    for i, b in raw:
        gone = np.zeros(len(b), dtype=bool)
        for k in range(len(b) - length + 1):
            if low[b[k : k + length]] < i:
                gone[k : k + length] = True
        edge = np.diff(np.concatenate([[0], gone.astype(int), [0]]))
        spans = list(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True))
        out.append((i, len(b), spans, np.frombuffer(b, dtype=np.uint8)[~gone].tobytes()))
    return sorted(out)


def suffix_rows():
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 7))) for _ in range(60)]
    passages = [" ".join(rng.choice(words) for _ in range(rng.randint(5, 40))) for _ in range(12)] + ["a" * 200, "ab" * 70]
    some = lambda: rng.choice([rng.choice(passages)[rng.randint(0, 30) :], " ".join(rng.choice(words) for _ in range(rng.randint(1, 30)))])
    rows = [(rng.randint(0, 120), "".join(some() for _ in range(rng.randint(0, 6)))) for _ in range(120)]
    return [*rows, (500, None), (501, ""), (502, "x" * 49), (503, "x" * 50), (504, "x" * 50), (505, "y" * 5000 + passages[0])]


@pytest.mark.parametrize("bounds", [{}, {"bucket_bytes": 6000}, {"bucket_bytes": 6000, "hot_contexts": 3}, {"bucket_bytes": 9000, "hot_contexts": 0}])
def test_suffix_removal(spark, bounds):
    rows = suffix_rows()
    table = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, z string, n_bytes int")
    found = suffix_dedup.remove_repeats(table, keep=("z", "text"), **bounds).select("doc_id", "n_bytes", "spans", "kept", "z", "text").collect()
    assert sorted((r.doc_id, r[1], [tuple(s) for s in r.spans], bytes(r.kept)) for r in found) == slow_removal(rows)
    assert all(r.z == "clash" for r in found) and sorted(str(r.text) for r in found) == sorted(str(t) for _, t in rows)


def test_long_texts_are_cut_into_chunks(monkeypatch):
    rng = random.Random(1)
    text = bytes(rng.choice(b"abcd ") for _ in range(3000))
    whole = suffix_dedup._anchors([text], 50)
    monkeypatch.setattr(suffix_dedup, "_CHUNK", 400)
    cut = suffix_dedup._anchors([text], 50)
    assert whole.windows.sum() == cut.windows.sum() == 3000 - 49
    assert set(whole.gram.tolist()) == set(cut.gram.tolist())


def test_no_documents_to_remove_from(no_docs):
    assert suffix_dedup.remove_repeats(no_docs).collect() == []


def test_front_coding_and_loser_tree():
    rng = random.Random(5)
    runs = [sorted({bytes(rng.choice(b"ab\x00") for _ in range(rng.randint(1, 8))) for _ in range(rng.randint(0, 40))}) for _ in range(7)]
    coded = [suffix_dedup.front_decode(suffix_dedup.front_code(r)) for r in runs]
    assert [c[0] for c in coded] == runs
    order, last = [], b""
    for r, i, shared in suffix_dedup.merge_runs(coded):
        assert shared == suffix_dedup.common_prefix(last, runs[r][i])
        order.append(last := runs[r][i])
    assert order == sorted(s for r in runs for s in r)
