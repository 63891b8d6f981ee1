"""Packing of documents into token windows by best-fit decreasing.

Documents are cut into full windows and one remainder. Full windows are sequences of their own; the remainders are
placed longest first, each into the open window with the least room that still takes it, found by a segment tree
indexed by remaining capacity. As only lengths matter, the tree runs over the histogram of lengths (window - 1 numbers,
whatever the size of the corpus): bins that are alike are ranges of sequence ids. Each piece then finds its place from
its rank among the pieces of its length, which Spark numbers by bucket; the plan of ranges is bounded by the window's
size and is broadcast.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import coding_slabs, encoder
from .common import cut, map_arrow

WINDOW = 2048


class CapacityTree:
    """How many ranges of open windows there are for each remaining capacity; finds the least one that is enough."""

    def __init__(self, window: int):
        self.size = 1 << window.bit_length()
        self.sums = [0] * (2 * self.size)

    def add(self, capacity: int, n: int) -> None:
        i = self.size + capacity
        while i:
            self.sums[i] += n
            i //= 2

    def tightest(self, least: int) -> int | None:
        """The smallest capacity >= least that has an open window."""
        i = self.size + least
        if self.sums[i]:
            return least
        while i > 1:
            if i % 2 == 0 and self.sums[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if self.sums[2 * i] else 2 * i + 1
                return i - self.size
            i //= 2
        return None


@dataclass
class Placement:
    """For each length: rows (first rank, sequence of that rank, pieces to a sequence, offset), and the sequences used."""

    ranges: dict[int, np.ndarray]
    sequences: int


def best_fit_decreasing(counts: dict[int, int], window: int = WINDOW) -> Placement:
    """Packs counts[length] pieces of each length (1 .. window - 1)."""
    tree = CapacityTree(window)
    open_: dict[int, list[tuple[int, int]]] = {}
    ranges: dict[int, list[tuple[int, int, int, int]]] = {}
    sequences = 0

    def put(capacity: int, first: int, n: int) -> None:
        if capacity and n:
            open_.setdefault(capacity, []).append((first, n))
            tree.add(capacity, 1)

    for length in sorted(counts, reverse=True):
        left, rank, own = counts[length], 0, ranges.setdefault(length, [])
        while left:
            capacity = tree.tightest(length)
            if capacity is None:
                n = -(-left // (window // length))
                put(window, sequences, n)
                sequences += n
                continue
            first, n = open_[capacity].pop()
            tree.add(capacity, -1)
            each = capacity // length
            full = min(n, left // each)
            if full:
                own.append((rank, first, each, window - capacity))
                put(capacity - each * length, first, full)
                rank, left = rank + full * each, left - full * each
            if full < n and left < each:
                if left:
                    own.append((rank, first + full, each, window - capacity))
                    put(capacity - left * length, first + full, 1)
                    full += 1
                    left = 0
                put(capacity, first + full, n - full)
    return Placement({k: np.array(v, dtype=np.int64) for k, v in ranges.items() if v}, sequences)


def pieces(docs: DataFrame, path: str, end_id: int = 1, window: int = WINDOW, with_ids: bool = False) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens (and ids) of the windows and the remainder of every document."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", *["ids"] * with_ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, end = encoder(path), end_id.to_bytes(4, "little")
        for batch in coding_slabs(batches):
            of, start, length, crc, tokens, held = [], [], [], [], [], []
            for i, ids in enumerate(own.encode_batch([t or "" for t in batch.column("text").to_pylist()])):
                ids += end
                n = len(ids) // 4
                for a in range(0, n, window):
                    piece = ids[4 * a : 4 * (a + window)]
                    of.append(i)
                    start.append(a)
                    length.append(len(piece) // 4)
                    crc.append(zlib.crc32(piece))
                    tokens.append(n)
                    if with_ids:
                        held.append(piece)
            columns = [batch.column("doc_id").take(pa.array(of, pa.int64())), *(pa.array(c, pa.int64()) for c in (start, length, crc, tokens))]
            yield pa.RecordBatch.from_arrays([*columns, *[pa.array(held, pa.binary())] * with_ids], names)

    return map_arrow(docs.select("doc_id", "text"), run, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long" + ", ids binary" * with_ids)


def pack(docs: DataFrame, path: str, end_id: int = 1, window: int = WINDOW, with_ids: bool = False, bucket_rows: int = 50_000) -> DataFrame:
    """The pieces of every document with sequence_id and offset; the used places of a sequence are gapless from 0.

    A null or empty text is the end id alone; a very long one is cut into windows like any other. Repeated rows are
    packed one by one: rows that share a doc_id are told apart by their ids' checksum, and those alike in that too have
    the same tokens, so it does not matter which is first. Columns of other names are not read; an empty table gives
    an empty result. With `with_ids` each row holds its ids as well.
    """
    table = cut(pieces(docs, path, end_id, window, with_ids))
    buckets = max(1, -(-table.count() // bucket_rows))
    dealt = table.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start"), F.lit(buckets)))
    counts = cut(dealt.groupBy("length", "bucket").agg(F.count("*").alias("n")))
    # a row per bucket for each length: the pieces of that length in the buckets before
    before = counts.select("length", "bucket", (F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n")).alias("before"))
    totals = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # `window` rows at most
    totals.pop(window, 0)
    plan = docs.sparkSession.sparkContext.broadcast(best_fit_decreasing(totals, window))
    own = Window.partitionBy("bucket", "length").orderBy("doc_id", "start", "ids_crc32", "doc_tokens")
    ranked = dealt.withColumn("rank", F.row_number().over(own) - 1).join(before, ["bucket", "length"]).withColumn("rank", F.col("rank") + F.col("before"))
    out = table.columns
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in table.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranges, sequences = plan.value.ranges, plan.value.sequences
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            sequence, offset = sequences + rank, np.zeros(len(rank), dtype=np.int64)  # as for full windows
            for n in np.unique(length).tolist():
                if n < window:
                    rows = np.flatnonzero(length == n)
                    r = ranges[n][np.searchsorted(ranges[n][:, 0], rank[rows], side="right") - 1]
                    more = rank[rows] - r[:, 0]
                    sequence[rows], offset[rows] = r[:, 1] + more // r[:, 2], r[:, 3] + more % r[:, 2] * n
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in out), pa.array(sequence), pa.array(offset)], [*out, "sequence_id", "offset"])

    return map_arrow(ranked.select(*out, "rank"), run, kinds + ", sequence_id long, offset long")


def sequences(packed: DataFrame, window: int = WINDOW, pad_id: int = 0) -> DataFrame:
    """sequence_id, used and tokens of each sequence of pack(..., with_ids=True), padded to the window.

    A sequence whose length is a power of two is not padded.
    """
    joined = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("p"), F.sum("length").alias("used"))  # window rows at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for p, used in zip(batch.column("p").to_pylist(), batch.column("used").to_pylist(), strict=True):
                ids = np.frombuffer(b"".join(x["ids"] for x in p), dtype="<u4").astype(np.int64)
                rows.append(ids if used & (used - 1) == 0 else np.concatenate([ids, np.full(window - len(ids), pad_id, dtype=np.int64)]))
            yield pa.RecordBatch.from_arrays([batch.column("sequence_id"), batch.column("used"), pa.array(rows, pa.list_(pa.int64()))], ["sequence_id", "used", "tokens"])

    return map_arrow(joined, run, "sequence_id long, used long, tokens array<bigint>")
