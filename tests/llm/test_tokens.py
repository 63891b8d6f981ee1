"""BPE, token counts under edits, and packing, against the tokenizers library."""

import random
import zlib
from array import array

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tessera.llm import bpe, packing, token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def reference():
    return Tokenizer.from_file(PATH)


def ids_of(reference, text):
    return reference.encode(text or "", add_special_tokens=False).ids


def test_random_texts_encode_and_decode_alike(reference):
    own, rng = bpe.encoder(PATH), random.Random(5)
    alphabet = [*"ab e's 'll  \n\t\r\x0b\x1c\x85\xa0²³¼éßøɏɐ1  .,!?-—“”…€漢字かな٣Ⅷ½ªº　😀́A", "<|endoftext|>", "  ", "'re", "\n\n", " the", "tion"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 16))) for _ in range(3000)]
    texts += ["a" * 3000, "ab" * 500 + " x", "é" * 700, "漢" * 300, "0123456789" * 40, "<|endoftext|>" * 3]
    for text, found in zip(texts, own.encode_batch(texts), strict=True):
        expected = ids_of(reference, text)
        assert array("I", found).tolist() == expected
        assert own.decode(found) == reference.decode(expected, skip_special_tokens=False)


def test_small_memo_changes_nothing(reference, monkeypatch):
    monkeypatch.setattr(bpe, "_MEMO", 20)
    own = bpe.Encoder(bpe.Vocabulary(PATH))
    texts = [f"some words number {i} and again {i % 3}" for i in range(50)]
    for _ in range(2):
        for k in range(0, 50, 7):
            some = texts[k : k + 9][::-1]
            assert [array("I", x).tolist() for x in own.encode_batch(some)] == [ids_of(reference, t) for t in some]
            assert sum(own.pre_tokens(some[0] + " new")[1]) == len(ids_of(reference, some[0] + " new"))
        assert [array("I", x).tolist() for x in own.encode_batch(texts)] == [ids_of(reference, t) for t in texts]


def test_encode_documents(docs, no_docs, reference):
    rows = bpe.encode_documents(docs, PATH).collect()
    texts = docs.select("doc_id", "text").collect()
    assert sorted((str(r.doc_id), array("I", bytes(r.ids)).tolist()) for r in rows) == sorted((str(t.doc_id), ids_of(reference, t.text)) for t in texts)
    assert all(r.n_tokens == len(r.ids) // 4 for r in rows)
    assert sorted(r.decoded for r in rows) == sorted(t.text or "" for t in texts)
    assert bpe.encode_documents(no_docs, PATH).collect() == []


def test_tree_follows_edits(reference):
    own, rng = bpe.encoder(PATH), random.Random(9)
    for _ in range(60):
        text = "".join(rng.choice([" ", "  ", "a", "tion", "word", "\n", ".", "é", "'s", "12"]) for _ in range(rng.randint(0, 60)))
        tree = token_counts.TokenTree(text, own)
        for _ in range(8):
            start = rng.randint(0, len(text))
            end = rng.randint(start, min(len(text), start + 6))
            put = rng.choice(["", " ", "x", " new words", "\n\n", "s"])
            tree.edit(start, end, put)
            text = text[:start] + put + text[end:]
            assert tree.text == text
            assert tree.n_tokens == len(ids_of(reference, text))


def test_tree_encodes_little_again():
    text = " ".join(f"word{i}" for i in range(5000))
    tree = token_counts.TokenTree(text, bpe.encoder(PATH))
    before = tree.encoded
    tree.edit(12_000, 12_004, "other")
    assert tree.encoded - before < 60


def test_count_tokens(docs, no_docs, reference):
    texts = {str(r.doc_id): r.text for r in docs.select("doc_id", "text").collect()}
    rows = token_counts.count_tokens(docs, PATH).collect()
    assert len(rows) == docs.count() and sum(r.n_edits for r in rows) >= 2
    for r in rows:
        edited = text = texts[str(r.doc_id)] or ""
        for a, b, put in reversed(token_counts.scrub_edits(text)):
            edited = edited[:a] + put + edited[b:]
        assert (r.n_tokens, r.n_tokens_edited, r.edited) == (len(ids_of(reference, text)), len(ids_of(reference, edited)), edited)
    assert token_counts.count_tokens(no_docs, PATH).collect() == []


def plain_best_fit_decreasing(lengths, window):
    room = []
    for n in sorted(lengths, reverse=True):
        fits = [i for i, r in enumerate(room) if r >= n]
        if fits:
            room[min(fits, key=lambda i: room[i])] -= n
        else:
            room.append(window - n)
    return sorted(room)


def test_plan_is_best_fit_decreasing():
    rng = random.Random(2)
    for window in (16, 64, 100):
        for _ in range(30):
            counts = {rng.randint(1, window - 1): rng.randint(1, 40) for _ in range(rng.randint(1, 12))}
            plan, room, seen = packing.best_fit_decreasing(dict(counts), window), {}, {}
            for n, c in counts.items():
                for rank in range(c):
                    r = plan.ranges[n][np.searchsorted(plan.ranges[n][:, 0], rank, side="right") - 1]
                    sequence, offset = r[1] + (rank - r[0]) // r[2], r[3] + (rank - r[0]) % r[2] * n
                    seen.setdefault(int(sequence), []).append((int(offset), n))
            for s, pieces in seen.items():
                at = 0
                for offset, n in sorted(pieces):
                    assert offset == at
                    at += n
                room[s] = window - at
            assert len(room) == plan.sequences
            assert sorted(room.values()) == plain_best_fit_decreasing([n for n, c in counts.items() for _ in range(c)], window)


@pytest.mark.parametrize("bucket_rows", [500_000, 7])
def test_pack(docs, no_docs, reference, bucket_rows):
    rows = packing.pack(docs, PATH, window=256, with_ids=True, bucket_rows=bucket_rows).cache()
    found = rows.collect()
    by_sequence = {}
    for r in found:
        assert r.ids_crc32 == zlib.crc32(bytes(r.ids)) and len(r.ids) == 4 * r.length <= 4 * 256
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in by_sequence.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= 256
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    expected = sorted((str(t.doc_id), len(ids_of(reference, t.text)) + 1) for t in docs.select("doc_id", "text").collect())
    assert sorted((str(r.doc_id), r.doc_tokens) for r in found if r.start == 0) == expected
    total = sum(n for _, n in expected)
    assert sum(r.length for r in found) == total and len(by_sequence) <= total / 256 * 1.1 + 2
    for r in packing.sequences(rows, window=256).collect():
        assert len(r.tokens) == (r.used if r.used & (r.used - 1) == 0 else 256)
    assert packing.pack(no_docs, PATH).collect() == []
