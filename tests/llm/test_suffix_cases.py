"""Suffix removal: rows without an id, clashing names, and how even its ranges are."""

import hashlib

import numpy as np
import pytest
from test_dedup import slow_removal

from tessera.llm import suffix_dedup


def test_rows_without_an_id_keep_all(docs):
    found = suffix_dedup.remove_repeats(docs, keep=("lang",), bucket_bytes=50_000).collect()
    given = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert sorted((r.doc_id, r.n_bytes, [tuple(s) for s in r.spans], bytes(r.kept)) for r in found if r.doc_id is not None) == slow_removal([x for x in given if x[0] is not None])
    alone = [r for r in found if r.doc_id is None]
    assert [(bytes(r.kept).decode(), r.spans) for r in alone] == [(t, []) for i, t in given if i is None]


def test_all_ids_null(spark):
    text = "a passage of some words that is long enough to be found again, and again"
    table = spark.createDataFrame([(None, text), (None, text)], "doc_id long, text string")
    assert [bytes(r.kept).decode() for r in suffix_dedup.remove_repeats(table).collect()] == [text] * 2


def test_names_of_outputs_cannot_be_kept(docs):
    with pytest.raises(ValueError, match="spans"):
        suffix_dedup.remove_repeats(docs.withColumnRenamed("score", "spans"), keep=("spans",))


def test_ranges_of_hashes_are_alike():
    rng = np.random.default_rng(4)
    words = [bytes(rng.integers(97, 123, int(n)).astype(np.uint8)) for n in rng.integers(2, 9, 3000)]
    texts = [b" ".join(words[i] for i in rng.integers(0, 3000, 200)) for _ in range(400)]
    gram = suffix_dedup._pairs(suffix_dedup._anchors(texts, 50)).gram
    held = np.bincount((gram >> np.uint64(48 - 6)).astype(int), minlength=64)
    assert held.max() < 2 * held.mean() and held.min() > held.mean() / 2


def test_sizes_grow_less_than_the_text():
    assert suffix_dedup._sizes(0, 4 << 20) == (1, 1)
    assert suffix_dedup._sizes(1 << 30, 4 << 20) == (256, 256)
    buckets, ranges = suffix_dedup._sizes(1 << 40, 4 << 20)
    assert buckets == 1 << 15 and ranges == 1 << 12
    for total in (1 << 33, 1 << 36, 1 << 40):
        more = suffix_dedup._sizes(2 * total, 4 << 20)
        assert more[0] >= suffix_dedup._sizes(total, 4 << 20)[0] and more[1] >= suffix_dedup._sizes(total, 4 << 20)[1]


def test_the_same_bytes_whatever_the_buckets(docs):
    def digest(bucket_bytes):
        rows = suffix_dedup.remove_repeats(docs, bucket_bytes=bucket_bytes).collect()
        return sorted((str(r.doc_id), hashlib.sha256(bytes(r.kept)).hexdigest()) for r in rows)

    assert digest(4 << 20) == digest(20_000)
