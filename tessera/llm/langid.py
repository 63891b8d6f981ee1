"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counts of hashed 1-, 2- and 3-grams of code points are summed in Spark by (language, bucket). The matrix of
log-probabilities (languages x 2**bits, bounded by the two parameters) is broadcast, and whole texts are scored in
numpy: each position of a text gathers the rows of its n-grams, and the sums per document decide.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hash_sample, map_arrow, no_clash, slabs

LETTER = re.compile(r"[^\W\d_]")
UNDETERMINED = "und"
_STEP = 1 << 18
_MULTIPLIERS = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)


@dataclass
class Model:
    langs: list[str]
    log_prob: np.ndarray  # float32, (buckets, languages)
    prior: np.ndarray
    bits: int


def _codes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all the lower-cased texts, each followed by three zeros, and where each text starts."""
    parts = [("" if t is None else t.lower()) + "\0\0\0" for t in texts]
    codes = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    starts = np.cumsum([0, *map(len, parts)])[:-1]
    return codes, starts


def _buckets(codes: np.ndarray, a: int, b: int, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For n = 1, 2, 3: the buckets of the n-grams that start in codes[a:b], and which of them are whole."""
    h = np.zeros(b - a, dtype=np.uint32)
    whole = np.ones(b - a, dtype=bool)
    for n in range(3):
        c = codes[a + n : b + n]
        if len(c) < b - a:
            c = np.concatenate([c, np.zeros(b - a - len(c), dtype=np.uint32)])
        h = (h ^ (c + np.uint32(n + 1))) * np.uint32(_MULTIPLIERS[n])
        h ^= h >> np.uint32(15)
        whole = whole & (c != 0)
        yield (h * np.uint32(0x27D4EB2F)) >> np.uint32(32 - bits), whole


def _counter(bits: int, langs: list[str]):
    """Counts of (language, bucket) over a task: one dense matrix, emitted once as its nonzero cells."""
    place = {x: i for i, x in enumerate(langs)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(langs), 1 << bits), dtype=np.int64)
        for batch in slabs(batches):
            texts, own = batch.column("text").to_pylist(), batch.column("lang").to_pylist()
            for k in set(own):
                codes, _ = _codes([t for t, x in zip(texts, own, strict=True) if x == k])
                for a in range(0, len(codes), _STEP):
                    for bucket, whole in _buckets(codes, a, min(len(codes), a + _STEP), bits):
                        total[place[k]] += np.bincount(bucket[whole], minlength=1 << bits)
        for i in np.flatnonzero(total.any(axis=1)).tolist():
            cells = np.flatnonzero(total[i])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cells), i, np.int32)), pa.array(cells.astype(np.int32)), pa.array(total[i, cells])], ["lang", "bucket", "n"])

    return count


def train(docs: DataFrame, bits: int = 15, max_rows: int = 20_000, max_langs: int = 256, smoothing: float = 0.5) -> Model | None:
    """Fits on whole texts of about `max_rows` of the given (text, lang, doc_id) rows, chosen by a hash of doc_id and text.

    Rows whose text or lang is null teach nothing; with no row left there is no model (None). More than `max_langs`
    languages are an error, as the matrix is broadcast.
    """
    rows = hash_sample(docs.filter("text is not null and lang is not null").select("doc_id", "text", "lang"), ("doc_id", "text"), max_rows)
    docs_of = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).limit(max_langs + 1).collect()}
    if len(docs_of) > max_langs:
        raise ValueError(f"more than {max_langs} languages")
    if not docs_of:
        return None
    langs = sorted(docs_of)
    cells = map_arrow(rows.select("text", "lang"), _counter(bits, langs), "lang int, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    counts = np.full((1 << bits, len(langs)), smoothing)
    counts[cells["bucket"].to_numpy(), cells["lang"].to_numpy()] += cells["n"].to_numpy()
    prior = np.log(np.array([docs_of[x] for x in langs], dtype=float) / sum(docs_of.values()))
    return Model(langs, np.log(counts / counts.sum(axis=0)).astype(np.float32), prior, bits)


def score(texts: list[str | None], model: Model | None) -> tuple[list[str], np.ndarray]:
    """The language of each text and a score in 0..1: the posterior, tempered to the evidence of 64 n-grams."""
    if not texts:
        return [], np.zeros(0)
    if model is None:
        return [UNDETERMINED] * len(texts), np.zeros(len(texts))
    codes, starts = _codes(texts)
    sums, seen = np.zeros((len(texts), len(model.langs))), np.zeros(len(texts))
    for a in range(0, len(codes), _STEP):
        b = min(len(codes), a + _STEP)
        first = int(np.searchsorted(starts, a, side="right")) - 1
        last = int(np.searchsorted(starts, b, side="left"))
        at = np.maximum(starts[first:last], a) - a
        gained, n = None, None
        for bucket, whole in _buckets(codes, a, b, model.bits):
            part = np.take(model.log_prob, bucket, axis=0)
            part[~whole] = 0
            gained = part if gained is None else gained + part
            n = whole.astype(np.int32) if n is None else n + whole
        sums[first:last] += np.add.reduceat(gained, at, axis=0, dtype=np.float64)
        seen[first:last] += np.add.reduceat(n, at)
    sums += model.prior
    best = sums.argmax(axis=1)
    tempered = (sums - sums.max(axis=1, keepdims=True)) * np.minimum(1, 64 / np.maximum(seen, 1))[:, None]
    shares = 1 / np.exp(tempered).sum(axis=1)
    known = np.array([t is not None and LETTER.search(t) is not None for t in texts])
    return [model.langs[i] if k else UNDETERMINED for i, k in zip(best.tolist(), known.tolist(), strict=True)], np.where(known, shares, 0.0)


def identify(docs: DataFrame, model: Model | None, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns in `keep`, lang_pred and score for every row.

    A null text or one without a letter (the empty text too) is `und` with score 0; without a model every text is.
    Ties go to the language that comes first in the alphabet. A very long text is scored whole, in steps. Repeated rows
    each get their own result; columns that are not asked for, whatever their names, are not read, and those in `keep`
    may have any name but that of an output. An empty table gives an empty result.
    """
    no_clash(keep, ("doc_id", "lang_pred", "score"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = list(dict.fromkeys(["doc_id", "text", *keep]))
    out = [c for c in names if c != "text" or "text" in keep]
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in out), "lang_pred string", "score double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slabs(batches):
            lang, p = score(batch.column("text").to_pylist(), shared.value)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in out), pa.array(lang, pa.string()), pa.array(p)], [*out, "lang_pred", "score"])

    return map_arrow(docs.select(*names), run, schema)
