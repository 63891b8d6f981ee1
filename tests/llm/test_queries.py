"""The ten queries end to end over a small folder of tables: their columns and types, against brute force."""

import hashlib
import zlib
from array import array

import public_tokenizers
import pytest
from common_cases import SCHEMA, awkward
from test_dedup import components, slow_fingerprint, slow_removal
from tokenizers import Tokenizer

from tessera.llm import queries
from tessera.llm.common import WORD


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    base = f"file://{tmp_path_factory.mktemp('tables')}"
    rows = [r for r in awkward() if r[1] is None or len(r[1]) < 20_000]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{base}/documents.parquet")
    spark.createDataFrame([(i, 0, int(i % 3 == 0)) for i in range(30)], "doc_id long, quality int, toxic int").write.parquet(f"{base}/labels.parquet")
    vectors = [(i, [float(i % 4), 1.0, float(i % 3)], i % 2) for i in range(40)] + [(40, None, 1)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").write.parquet(f"{base}/embeddings.parquet")
    spark.createDataFrame([(1, "http://a", "<p>one</p>"), (2, None, None)], "page_id long, url string, html string").write.parquet(f"{base}/pages.parquet")
    return base, rows


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.no_truncation()
    t.no_padding()
    return t


def run(spark, folder, name, kinds):
    df = queries.queries()[name](spark, folder[0])
    given = dict(df.dtypes)
    assert {k: given[k] for k in kinds} == kinds
    return df.collect()


def held(doc_id):
    return None if doc_id is None else zlib.crc32(str(doc_id).encode()) % 4 == 2


def sha(raw):
    return hashlib.sha256(raw).hexdigest()


def key(x):
    return sorted(x, key=str)


def test_op1(spark, folder):
    found = run(spark, folder, "op1_simhash", {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"})
    fp = [(r[0], slow_fingerprint(r[1])) for r in folder[1]]
    by = components(sorted({f for _, f in fp}), [(a, b) for _, a in fp for _, b in fp if (a ^ b).bit_count() <= 3])
    low = {}
    for i, f in fp:
        if i is not None:
            low[by[f]] = min(low.get(by[f], i), i)
    assert key((r.doc_id, r.fingerprint, r.component_id) for r in found) == key((i, format(f, "016x"), low[by[f]]) for i, f in fp)


def test_op2_and_op8(spark, folder, library):
    ids = [(r[0], r[1] or "", library.encode(r[1] or "", add_special_tokens=False).ids) for r in folder[1]]
    found = run(spark, folder, "op2_token_counts", {"doc_id": "bigint", "n_tokens": "bigint", "n_tokens_edited": "bigint", "edited_sha256": "string"})
    assert key((r.doc_id, r.n_tokens) for r in found) == key((i, len(x)) for i, _, x in ids)
    found = run(spark, folder, "op8_bpe", {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"})
    expected = [(i, len(x), sha(array("I", x).tobytes()), sha(library.decode(x, skip_special_tokens=False).encode())) for i, _, x in ids]
    assert key((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in found) == key(expected)


def test_op3(spark, folder):
    found = run(spark, folder, "op3_embedding_dedup", {"vec_id": "bigint", "n_links": "bigint", "component_id": "bigint", "kept": "boolean"})
    assert sorted(r.vec_id for r in found) == list(range(41)) and all(r.kept == (r.vec_id == r.component_id) for r in found)


def test_op4(spark, folder):
    found = run(spark, folder, "op4_warc_derivatives", {"page_id": "bigint", "record_type": "string", "refers_to": "string", "block_sha256": "string"})
    assert {(r.page_id, r.record_type) for r in found} == {(p, k) for p in (1, 2) for k in ("metadata", "conversion")}
    assert next(r.block_sha256 for r in found if r.page_id == 1 and r.record_type == "conversion") == sha(b"one")


def test_op5(spark, folder):
    columns = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    found = run(spark, folder, "op5_quality_bands", {"doc_id": "bigint", **dict.fromkeys(columns, "bigint"), "base_failed": "boolean", "kept": "boolean"})
    expected = []
    for row in folder[1]:
        text = row[1] or ""
        words = WORD.findall(text)
        windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
        again = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(5)}
        lines = text.split("\n")
        twice = sum(1 for i, x in enumerate(lines) if WORD.search(x) and x in lines[:i])
        n = len(words)
        expected.append((row[0], n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), twice, len(again), n < 10 or 100 * len(again) > 20 * n))
    assert key((r.doc_id, *(r[c] for c in columns), r.base_failed) for r in found) == key(expected)
    assert not any(r.kept and r.base_failed for r in found)


def test_op6(spark, folder, library):
    kinds = ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
    found = run(spark, folder, "op6_packing", {"doc_id": "bigint", **dict.fromkeys(kinds, "bigint")})
    expected = []
    for row in folder[1]:
        ids = [*library.encode(row[1] or "", add_special_tokens=False).ids, 1]
        expected += [(row[0], a, len(ids[a : a + 2048]), zlib.crc32(array("I", ids[a : a + 2048]).tobytes()), len(ids)) for a in range(0, len(ids), 2048)]
    assert key((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in found) == key(expected)
    used = {}
    for r in sorted(found, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == used.get(r.sequence_id, 0)
        used[r.sequence_id] = r.offset + r.length
    assert sorted(used) == list(range(len(used))) and max(used.values()) <= 2048


def test_op7(spark, folder):
    found = run(spark, folder, "op7_suffix_dedup", {"doc_id": "bigint", "n_bytes": "bigint", "n_removed": "bigint", "n_spans": "bigint", "kept_sha256": "string"})
    expected = [(i, n, n - len(kept), len(spans), sha(kept)) for i, n, spans, kept in slow_removal([r[:2] for r in folder[1] if r[0] is not None])]
    expected += [(None, len(r[1].encode()), 0, 0, sha(r[1].encode())) for r in folder[1] if r[0] is None]
    assert key(tuple(r) for r in found) == key(expected)


def test_op9_and_op10(spark, folder):
    for name, kinds in (("op9_toxicity", {"score": "double", "predicted": "int"}), ("op10_language_id", {"lang_pred": "string", "score": "double"})):
        found = run(spark, folder, name, {"doc_id": "bigint", "held_out": "boolean", **kinds})
        assert key((r.doc_id, r.held_out) for r in found) == key((r[0], held(r[0])) for r in folder[1])
        assert all(0 <= r.score <= 1 for r in found)
        if name == "op9_toxicity":
            assert all(r.predicted == (r.score >= 0.3) for r in found)
        else:
            assert all(r.lang_pred in ("de", "en", "und") for r in found) and any(r.lang_pred == "und" for r in found)
