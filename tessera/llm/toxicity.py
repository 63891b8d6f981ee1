"""Toxicity: a factorization machine over hashed terms.

score = sigmoid(w0 + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j), x_i = 1 if the text has term i. Terms are the
words of a text and their first four and six letters, hashed. The second-order part learns that two terms weigh
together (an insult with the mention of a group) what neither weighs alone.

Fitting uses a bounded sample of labelled rows (`max_rows`): Spark counts in how many texts of either label each
hashed term is found, the `max_terms` terms that tell the labels apart best stay, and the rows, reduced to those
terms, are fitted with AdaGrad. Scoring reads whole texts.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hash_sample, map_arrow, no_clash, slabs

TERM = re.compile(r"[^\W_]+")
PREFIXES = (4, 6)
_CACHE = 500_000


@dataclass
class Model:
    bits: int
    place: dict[int, int]  # hashed term -> row of w and v
    w0: float
    w: np.ndarray
    v: np.ndarray  # (terms, rank)


class _Terms(dict):
    """word -> the hashed terms it stands for, through `place` if there is one; bounded in size."""

    def __init__(self, bits: int, place: dict[int, int] | None):
        super().__init__()
        self.mask, self.place, self.prefixes = (1 << bits) - 1, place, {}

    def hashed(self, term: str) -> tuple[int, ...]:
        x = zlib.crc32(term.encode("utf-8", "surrogatepass")) & self.mask
        if self.place is not None:
            return (self.place[x],) if x in self.place else ()
        return (x,)

    def __missing__(self, word: str) -> tuple[int, ...]:
        out = self.hashed(word)
        for n in PREFIXES:
            if len(word) >= n:
                if (part := self.prefixes.get(head := word[:n])) is None:
                    part = self.hashed(f"{n} {head}")
                    if len(self.prefixes) < _CACHE:
                        self.prefixes[head] = part
                out += part
        if len(self) < _CACHE:
            self[word] = out
        return out


def _terms(text: str | None, known: _Terms) -> set[int]:
    out: set[int] = set()
    for word in set(TERM.findall((text or "").lower())):
        if x := known[word]:
            out.update(x)
    return out


def _count_terms(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, n = _Terms(bits, None), np.zeros((2, 1 << bits), dtype=np.int64)
        for batch in slabs(batches):
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                n[toxic, np.fromiter(_terms(text, known), dtype=np.int64)] += 1
        cells = np.flatnonzero(n.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(cells.astype(np.int32)), pa.array(n[0, cells]), pa.array(n[1, cells])], ["term", "n0", "n1"])

    return run


def _reduce_rows(bits: int, place: dict[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Terms(bits, place)
        for batch in slabs(batches):
            rows = [sorted(_terms(t, known)) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), pa.array(rows, pa.list_(pa.int32()))], ["doc_id", "toxic", "terms"])

    return run


def _flat(rows: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.fromiter(map(len, rows), dtype=np.int64, count=len(rows))
    ids = np.fromiter((x for r in rows for x in r), dtype=np.int64, count=int(sizes.sum()))
    return ids, np.repeat(np.arange(len(rows)), sizes)


def _margins(w0: float, w: np.ndarray, v: np.ndarray, ids: np.ndarray, of: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The margin of each of n rows, and its sums of v."""
    own = v[ids]
    s = np.stack([np.bincount(of, own[:, f], n) for f in range(v.shape[1])], axis=1)
    square = np.bincount(of, (own**2).sum(axis=1), n)
    return w0 + np.bincount(of, w[ids], n) + 0.5 * ((s**2).sum(axis=1) - square), s


def _fit(rows: list[list[int]], y: np.ndarray, terms: int, rank: int, epochs: int, rate: float, l2: float) -> tuple[float, np.ndarray, np.ndarray]:
    rng = np.random.default_rng(0)
    w, v = np.zeros(terms), rng.normal(0, 0.02, (terms, rank))
    share = (y.sum() + 1) / (len(y) + 2)
    w0, g0, gw, gv = float(np.log(share / (1 - share))), 1e-8, np.full(terms, 1e-8), np.full((terms, rank), 1e-8)
    for _ in range(max(epochs, -(-300 * 256 // max(1, len(rows))))):  # 300 steps at least
        order = rng.permutation(len(rows))
        for a in range(0, len(order), 256):
            pick = order[a : a + 256]
            ids, of = _flat([rows[i] for i in pick])
            margin, s = _margins(w0, w, v, ids, of, len(pick))
            d = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - y[pick]) / len(pick)
            g = d.sum()
            g0 += g * g
            w0 -= rate * g / np.sqrt(g0)
            used, back = np.unique(ids, return_inverse=True)
            g = np.bincount(back, d[of], len(used)) + l2 * w[used]
            gw[used] += g * g
            w[used] -= rate * g / np.sqrt(gw[used])
            each = d[of][:, None] * (s[of] - v[ids])
            g = np.stack([np.bincount(back, each[:, f], len(used)) for f in range(rank)], axis=1) + l2 * v[used]
            gv[used] += g * g
            v[used] -= 0.3 * rate * g / np.sqrt(gv[used])
    return w0, w, v


def train(
    docs: DataFrame, labels: DataFrame, bits: int = 18, max_rows: int = 20_000, max_terms: int = 8192, least_chi2: float = 15.0, max_common: int = 1024, rank: int = 4, epochs: int = 12, rate: float = 0.1, l2: float = 1e-5
) -> Model | None:
    """Fits on about `max_rows` labelled documents, chosen by a hash of doc_id; their texts are read whole.

    Repeated labels of a document count once, the largest of them; null ids and labels teach nothing. With one
    label only there is no model (None).
    """
    known = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    picked = hash_sample(known, ("doc_id",), max_rows)  # bounded by max_rows, so it may be broadcast
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")
    counts = map_arrow(rows.select("text", "toxic"), _count_terms(bits), "term int, n0 long, n1 long").groupBy("term").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    counts = counts.filter("n0 + n1 >= 3").toPandas()  # 2**bits rows at most
    totals = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(totals) < 2:
        return None
    n0, n1 = counts["n0"].to_numpy(float), counts["n1"].to_numpy(float)
    p0, p1 = n0 / totals[0], n1 / totals[1]
    p = (n0 + n1) / (totals[0] + totals[1])
    worth = (p1 - p0) ** 2 / np.maximum(p * (1 - p), 1e-12)
    worth *= totals[0] * totals[1] / (totals[0] + totals[1])  # chi-square of the term against the label
    terms = counts["term"].to_numpy()
    best = np.lexsort((terms, -worth))[:max_terms]
    best = best[: max(64, int((worth[best] >= least_chi2).sum()))]
    # terms that say nothing alone may do so in pairs: the most common of the rest fill what is left
    rest = np.setdiff1d(np.flatnonzero(p <= 0.9), best)
    best = np.concatenate([best, rest[np.lexsort((terms[rest], -(n0 + n1)[rest]))][: min(max_terms - len(best), max_common)]])
    place = {int(t): i for i, t in enumerate(counts["term"].to_numpy()[best])}
    table = map_arrow(rows, _reduce_rows(bits, place), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, toxic int, terms array<int>")
    found = sorted((r["doc_id"], r["toxic"], r["terms"]) for r in table.collect())
    w0, w, v = _fit([r[2] for r in found], np.array([r[1] for r in found], dtype=float), len(place), rank, epochs, rate, l2)
    return Model(bits, place, w0, w, v)


def score(texts: list[str | None], model: Model | None, known: _Terms | None = None) -> np.ndarray:
    """0..1 per text; a null or empty text has no terms and gets the score of the bias alone, without a model 0."""
    if model is None:
        return np.zeros(len(texts))
    ids, of = _flat([sorted(_terms(t, known if known is not None else _Terms(model.bits, model.place))) for t in texts])
    margin, _ = _margins(model.w0, model.w, model.v, ids, of, len(texts))
    return 1 / (1 + np.exp(-np.clip(margin, -30, 30)))


def rate_documents(docs: DataFrame, model: Model | None, keep: tuple[str, ...] = (), threshold: float = 0.3) -> DataFrame:
    """doc_id, the columns in `keep`, score and predicted (1 if score >= threshold) for every row, repeated rows too.

    A null or an empty text has the score of the bias alone, without a model 0; a very long one is read whole; a score
    at the threshold is toxic. Only doc_id, text and `keep` are read, so columns of other names, whatever they are,
    change nothing; those in `keep` may have any name but that of an output. An empty table gives an empty result.
    """
    no_clash(keep, ("doc_id", "score", "predicted"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = list(dict.fromkeys(["doc_id", "text", *keep]))
    out = [c for c in names if c != "text" or "text" in keep]
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in out), "score double", "predicted int"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Terms(shared.value.bits, shared.value.place) if shared.value else None
        for batch in slabs(batches):
            p = score(batch.column("text").to_pylist(), shared.value, known)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in out), pa.array(p), pa.array((p >= threshold).astype(np.int32))], [*out, "score", "predicted"])

    return map_arrow(docs.select(*names), run, schema)
