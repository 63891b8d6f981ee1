"""SimHash near-duplicates with pigeonring filtering.

A fingerprint has bit b set if over half of the text's shingle hashes have it. Two 64-bit fingerprints that differ in
at most 3 bits, cut into a ring of 8 segments of 8 bits, have a place on the ring from which every chain of l segments
differs in at most 3 l / 8 bits: the first two segments agree, and the five from there on differ in one bit at most.
So two of the third to fifth segments agree as well: every fingerprint is filed under 8 places x 3 choices of 32 bits,
and pairs that meet there must pass the chain's budgets before all 64 bits are compared. Only distinct fingerprints
are compared; the documents of one fingerprint are a class. Where a key has very many fingerprints (a cloud of near
copies) they are linked through points near them, which connects the same ones without comparing all pairs.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import connected_components, cut, map_arrow, slabs

_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_BITS, _SEGMENT, _DISTANCE = 64, 8, 3


def shingle_hashes(text: str | None, words: int = 3) -> np.ndarray:
    """XXH64 (seed 42) of the shingles of a text, repeats included, A-Z lower-cased; big-endian."""
    found = _WORD.findall((text or "").encode("utf-8", "surrogatepass").lower())
    if not found:
        return np.zeros(0, dtype=">u8")
    joined = b" ".join(found)
    digest = xxhash.xxh64_digest
    if len(found) <= words:
        return np.frombuffer(digest(joined, 42), dtype=">u8")
    ends = np.cumsum(np.fromiter(map(len, found), dtype=np.int64, count=len(found)) + 1) - 1
    starts = [0, *(ends[: len(found) - words] + 1).tolist()]
    return np.frombuffer(b"".join([digest(joined[a:b], 42) for a, b in zip(starts, ends[words - 1 :].tolist(), strict=True)]), dtype=">u8")


def fingerprint(hashes: np.ndarray) -> int:
    """Bits set in over half of the hashes, as an unsigned number; 0 without hashes."""
    if not len(hashes):
        return 0
    n = np.zeros(_BITS, dtype=np.int64)
    for a in range(0, len(hashes), 1 << 16):
        part = hashes[a : a + (1 << 16)]
        n += np.unpackbits(part.view(np.uint8)).reshape(len(part), _BITS).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * n > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """doc_id and fp (the fingerprint's bits as a signed long) for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slabs(batches):
            fp = np.array([fingerprint(shingle_hashes(t, words)) for t in batch.column("text").to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return map_arrow(docs.select("doc_id", "text"), run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fp long")


def _chain_keys(fp: Column) -> Column:
    """The 24 keys of a fingerprint: place on the ring, choice, and 32 bits of the chain that starts there."""
    keys = []
    for place in range(_BITS // _SEGMENT):
        turn = place * _SEGMENT
        ring = fp if not turn else F.shiftleft(fp, turn).bitwiseOR(F.shiftrightunsigned(fp, _BITS - turn))
        first = F.shiftrightunsigned(ring, 32)  # segments 0 to 3 of the chain
        fifth = F.shiftrightunsigned(ring, 24).bitwiseAND(F.lit(0xFF))
        for choice, bits in enumerate(
            (
                first,
                first.bitwiseAND(F.lit(0xFFFFFF00)).bitwiseOR(fifth),
                first.bitwiseAND(F.lit(0xFFFF0000)).bitwiseOR(F.shiftleft(first.bitwiseAND(F.lit(0xFF)), 8)).bitwiseOR(fifth),
            )
        ):
            keys.append(bits.bitwiseOR(F.lit((place * 3 + choice) << 32)))
    return F.array(*keys)


def _chain_passes(key: Column, differ: Column) -> Column:
    """Whether the chain from the key's place stays within its budgets: 1 bit in 5 segments, 2 in 6 and in 7."""
    turn = (F.shiftright(key, 32) / 3).cast("int") * _SEGMENT
    ring = F.call_function("shiftleft", differ, turn).bitwiseOR(F.when(turn > 0, F.call_function("shiftrightunsigned", differ, _BITS - turn)).otherwise(F.lit(0).cast("long")))
    within = [F.bit_count(F.shiftrightunsigned(ring, _BITS - _SEGMENT * n)) <= _DISTANCE * n // 8 for n in (5, 6, 7)]
    return within[0] & within[1] & within[2]


#: Fingerprints under one key that are still compared pair by pair.
CROWD = 1024


def _free_masks() -> list[tuple[int, int, int]]:
    """(place and choice of a key, mask, bits in it): all masks of at most two of the 32 bits that the key leaves free."""
    out = []
    for place in range(_BITS // _SEGMENT):
        for choice, free in enumerate(((4, 5, 6, 7), (3, 5, 6, 7), (2, 5, 6, 7))):
            bits = [1 << (_BITS - 1 - _SEGMENT * ((place + i) % 8) - j) for i in free for j in range(_SEGMENT)]
            masks = [0, *bits, *(x | y for i, x in enumerate(bits) for y in bits[:i])]
            out += [(place * 3 + choice, m - (1 << 64) if m >> 63 else m, m.bit_count()) for m in masks]
    return out


def _crowded_links(filed: DataFrame) -> DataFrame:
    """Links among fingerprints of crowded keys that connect all that differ in 3 bits at most, and no others.

    Two that do are within one bit and within two bits of some point. Each is filed under all points within two bits,
    529 for a key, and all that are filed under a point are linked to the smallest that is within one bit of it, if
    there is one; it is within three bits of them. A point has 529 at most, so the work is linear whatever the crowd.
    """
    masks = F.broadcast(filed.sparkSession.createDataFrame(_free_masks(), "slot long, mask long, radius int"))  # 24 x 529 rows
    near = filed.join(masks, F.shiftright("key", 32) == F.col("slot")).select("key", "fp", "radius", F.col("fp").bitwiseXOR(F.col("mask")).alias("point"))
    met = near.groupBy("key", "point").agg(F.min(F.when(F.col("radius") <= 1, F.col("fp"))).alias("hub"), F.collect_list("fp").alias("fps")).filter("hub is not null and size(fps) > 1")
    return met.select("hub", F.explode("fps").alias("fp")).filter("hub <> fp").select(F.least("hub", "fp").alias("u"), F.greatest("hub", "fp").alias("v"))


def links(fps: DataFrame, crowd: int = CROWD) -> DataFrame:
    """Pairs u < v of distinct fingerprints (column fp) that differ in 3 bits at most, perhaps several times.

    All such pairs that share a key with at most `crowd` fingerprints; for those of larger keys enough of them that the
    components are the same.
    """
    filed = fps.select("fp").withColumn("key", F.explode(_chain_keys(F.col("fp"))))
    crowded = cut(filed.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > crowd).select("key"))
    more = None
    if crowded.count():
        more = _crowded_links(filed.join(crowded, "key", "left_semi"))
        filed = filed.join(crowded, "key", "left_anti")
    a, b = filed.select(F.col("fp").alias("u"), "key"), filed.select(F.col("fp").alias("v"), F.col("key").alias("other"))
    differ = F.col("u").bitwiseXOR(F.col("v"))
    met = a.join(b, (F.col("key") == F.col("other")) & (F.col("u") < F.col("v")) & _chain_passes(F.col("key"), differ) & (F.bit_count(differ) <= _DISTANCE)).select("u", "v")
    return met if more is None else met.union(more)


def near_duplicates(docs: DataFrame, words: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id (smallest doc_id reachable) for every row.

    A null, an empty text and one without words has fingerprint zero, linked like any other. Repeated rows are in one
    component by their equal fingerprint, a null doc_id is smaller than none; a very long text is a slab of its own;
    columns of other names are not read; an empty table gives an empty result.
    """
    table = cut(fingerprints(docs, words))
    classes = cut(table.groupBy("fp").agg(F.min("doc_id").alias("low")))
    roots = connected_components(links(classes))
    rooted = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    component = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    named = rooted.select("fp", "root").join(component, "root").select("fp", "component_id")
    return table.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# --- similarity of sets of shingles: documents that are alike, not only of one fingerprint --------------------------

#: Documents and shingles of one block; two blocks are compared at a time, a longer document is a block's only one.
_BLOCK_DOCS, _BLOCK_SHINGLES = 1024, 250_000
#: Bits of a segment by the rows up to which a key, two segments long, has 64 fingerprints at most on average.
_SEGMENT_BITS = ((8, 1 << 22), (9, 1 << 24), (10, 1 << 26), (11, 1 << 28), (12, 1 << 62))
#: Segments after the first that a key may take as its second; more for sets of few shingles, whose bits differ more.
_NEXT, _NEXT_OF_FEW, _FEW = 2, 6, 24
#: Words of a fingerprint that go with every key.
_WORDS = 3
#: Where the ring is cut, in 32nds of it: the keys of one part are filed at a time, those of a short one first.
_CUTS = (0, 1, 8, 20, 32)
#: Links whose components one task may find; more of them take rounds over all tasks.
_LINKS = 200_000
#: Rows whose keys are made at once.
_FILED = 256


def bits_apart(similarity: float) -> float:
    """Share of SimHash bits that differ for two sets of one size and of this Jaccard similarity."""
    return math.acos(min(1.0, 2 * similarity / (1 + similarity))) / math.pi


def ring_segments(bits: int, similarity: float) -> int:
    """Segments of a ring on which all but 1 in 10,000 pairs of a similarity agree in two segments that a key holds.

    Without such two, an agreeing segment is followed by two that don't agree: the number of those rings grows with the
    largest root of x^3 = (1 - q) x^2 + q (1 - q)^2. The bits are whole words of 64.
    """
    q = (1 - max(bits_apart(similarity), 0.02)) ** bits
    root = max(r.real for r in np.roots([1, q - 1, 0, -q * (1 - q) ** 2]) if abs(r.imag) < 1e-9)
    whole = 64 // math.gcd(bits, 64)
    return whole * math.ceil(math.log(1e-4) / math.log(root) / whole)


def ring_print(own: np.ndarray, size: int) -> bytes:
    """SimHash of a set of hashes with `size` words of 64 bits; each word takes a mix of its own of every hash."""
    n, steps = np.zeros(64 * size, dtype=np.int64), np.arange(1, size + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for a in range(0, len(own), 255):  # the sums of 255 bits fit in a byte, eight are added at once
        mixed = own[a : a + 255, None].astype(np.uint64) + steps
        mixed ^= mixed >> np.uint64(30)
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(27)
        mixed *= np.uint64(0x94D049BB133111EB)
        mixed ^= mixed >> np.uint64(31)
        n += np.unpackbits(mixed.view(np.uint8), axis=1).view(np.uint64).sum(axis=0).view(np.uint8)
    return np.packbits(2 * n > len(own)).tobytes()


def ring_keys(prints: np.ndarray, bits: int, following: int, part: tuple[int, int] | None = None) -> np.ndarray:
    """Keys of each fingerprint (a row of bytes): a place on the ring, its segment and one of the `following` ones. With
    `part` those of the places from one to another."""
    own = np.unpackbits(prints, axis=1).reshape(len(prints), -1, bits)
    start, end = part or (0, own.shape[1])
    own = own[:, np.arange(start, end + following) % own.shape[1]] @ (1 << np.arange(bits))
    place, n = np.arange(start, end) * (_NEXT_OF_FEW + 1), end - start
    return np.concatenate([((place + c) << (2 * bits)) | (own[:, :n] << bits) | own[:, c : c + n] for c in range(1, following + 1)], axis=1)


def distinct_hashes(text: str | None, words: int = 5) -> np.ndarray:
    """The set of a text's shingle hashes, in order."""
    return np.unique(shingle_hashes(text, words).astype("<u8"))


def _signatures(words: int, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slabs(batches):
            sets = [distinct_hashes(t, words) for t in batch.column("text").to_pylist()]
            same = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
            ids = np.frombuffer(b"".join(s[:8] for s in same), dtype="<i8")
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_hash"), pa.array(same, pa.binary()), pa.array(ids), pa.array([len(s) for s in sets], pa.int64()), pa.array([ring_print(s, size) for s in sets], pa.binary())],
                ["doc_id", "text_hash", "same", "id", "size", "print"],
            )

    return run


def _prints(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(len(column), -1)


def _file(bits: int, part: tuple[int, int]):
    """Rows (key, id, group, words of the fingerprint) for every key of a class in a part of the ring; none for sets
    without shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, _FILED):
                rows = batch.slice(a, _FILED)
                prints, size, ids, groups = _prints(rows.column("print")), *(rows.column(c).to_numpy() for c in ("size", "id", "group"))
                words = np.ascontiguousarray(prints[:, : 8 * _WORDS]).view("<i8")
                for chosen, following in ((size > _FEW, _NEXT), ((size > 0) & (size <= _FEW), _NEXT_OF_FEW)):
                    if not chosen.any():
                        continue
                    keys = ring_keys(prints[chosen], bits, following, part)
                    row = np.repeat(np.flatnonzero(chosen), keys.shape[1])
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in (keys.ravel(), ids[row], groups[row], *words[row].T)], ["key", "id", "group", *_WORD_NAMES])

    return run


_WORD_NAMES = tuple(f"word_{k}" for k in range(_WORDS))


def words_limit(similarity: float) -> int:
    """Bits in which the words that go with a key may differ: 5.5 standard deviations over the mean."""
    n, p = 64 * _WORDS, bits_apart(similarity)
    return int(n * p + 5.5 * math.sqrt(n * max(p, 0.02)))


def _apart(words: list[np.ndarray], i, j) -> np.ndarray:
    """Bits that differ between rows i and rows j."""
    return sum(np.bitwise_count((c[i] ^ c[j]).view("u8")).astype(np.int64) for c in words)  # of signed ones the absolute value counts


def crowd_links(groups: np.ndarray, words: list[np.ndarray], limit: int) -> list[tuple[int, int]]:
    """Rows i, j, near each other, that connect what the near rows of different groups connect."""
    names, component, n = np.unique(groups, return_inverse=True, return_counts=True)
    out: list[tuple[int, int]] = []
    if len(names) < 2:
        return out
    for i in np.flatnonzero(component != n.argmax()).tolist():  # pairs with the largest one are seen from their other side
        todo = np.flatnonzero(component != component[i])
        if not len(todo):
            break
        near = todo[_apart(words, todo, i) <= limit]
        if len(near):
            others, first = np.unique(component[near], return_index=True)
            out += [(i, int(j)) for j in near[first]]
            component[np.isin(component, others)] = component[i]
    return out


def _meet(crowd: int, limit: int):
    """Of the rows under one key, as they come sorted, those of different groups whose words differ in `limit` bits at
    most: pairs u < v, no more of them than a key has rows. Of a key with more, or with over `crowd` rows, only as many
    as connect all: each id (dense) with the one that it is near (hub), and once those with themselves.

    What a task has connected in a crowd it doesn't connect again under another key. Rows without a group are one each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        above: dict[int, int] = {}
        hubs: set[int] = set()
        held = None

        def top(g: int) -> int:
            way = []
            while (up := above.get(g, g)) != g:
                way.append(g)
                g = up
            above.update((w, g) for w in way)
            return g

        def tied(ids: np.ndarray, groups: np.ndarray, words: list[np.ndarray]) -> list[tuple[int, int]]:
            if (groups == groups[0]).all():
                return []
            groups = np.array([top(g) for g in groups.tolist()], dtype=np.int64)
            out = []
            for i, j in crowd_links(groups, words, limit):
                above[top(int(groups[j]))] = top(int(groups[i]))
                i, j = int(ids[i]), int(ids[j])
                out += [(j, i)] if i in hubs else [(j, i), (i, i)]
                hubs.add(i)
            return out

        def found(rows: list[np.ndarray]) -> pa.RecordBatch:
            key, ids, groups, *words = rows
            starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            n = np.diff(np.concatenate([starts, [len(key)]]))
            of, end = np.repeat(np.arange(len(n)), n), np.repeat(starts + n, n)
            left = np.flatnonzero(n[of] <= crowd)
            i, j = [left[:0]], [left[:0]]
            for step in range(1, crowd):
                left = left[left + step < end[left]]
                if not len(left):
                    break
                fine = left[(_apart(words, left, left + step) <= limit) & (groups[left] != groups[left + step])]
                i.append(fine)
                j.append(fine + step)
            i, j = np.concatenate(i), np.concatenate(j)
            many = np.bincount(of[i], minlength=len(n)) > n
            ties = []
            for k in np.flatnonzero(many | (n > crowd)).tolist():
                of_key = slice(starts[k], starts[k] + n[k])
                ties += tied(ids[of_key], groups[of_key], [c[of_key] for c in words])
            u, v = ids[i[~many[of[i]]]], ids[j[~many[of[i]]]]
            dense, hub = np.array(ties, dtype=np.int64).reshape(-1, 2).T
            none = [pa.nulls(len(c), pa.int64()) for c in (u, dense)]
            columns = [[pa.array(np.minimum(u, v)), none[1]], [pa.array(np.maximum(u, v)), none[1]], [none[0], pa.array(dense)], [none[0], pa.array(hub)]]
            return pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in columns], ["u", "v", "dense", "hub"])

        for batch in batches:
            rows = [batch.column(c).to_numpy() for c in ("key", "id", "group" if "group" in batch.schema.names else "id")]
            rows += [batch.column(k).to_numpy() for k, c in enumerate(batch.schema.names) if c not in ("key", "id", "group")]
            held = [*(held or []), rows] if len(rows[0]) else held
            if not len(rows[0]) or rows[0][0] == rows[0][-1] == held[0][0][-1]:  # one key so far
                continue
            rows = [np.concatenate(c) for c in zip(*held, strict=True)]
            last = int(np.searchsorted(rows[0], rows[0][-1]))
            held = [[c[last:].copy() for c in rows]]
            if last:
                yield found([c[:last] for c in rows])
        if held:
            yield found([np.concatenate(c) for c in zip(*held, strict=True)])

    return run


def _alike_prints(a: np.ndarray, b: np.ndarray, size: np.ndarray, similarity: float) -> np.ndarray:
    """Whether whole fingerprints can be of similar sets, the smaller of them of `size`: 4.5 standard deviations over
    the mean, and some more for sets of few shingles."""
    n, p = 8 * a.shape[-1], bits_apart(similarity)
    apart = np.bitwise_count(np.ascontiguousarray(a).view("<u8") ^ np.ascontiguousarray(b).view("<u8")).sum(axis=-1, dtype=np.int64)
    return apart <= n * (p + 4.5 * math.sqrt(max(p, 0.02) / n) + 0.4 / np.maximum(size, 1))


def _pass_whole(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                fine = _alike_prints(_prints(batch.column("a")), _prints(batch.column("b")), batch.column("size").to_numpy(), similarity)
                yield batch.select(["u", "v"]).filter(pa.array(fine))

    return run


def _runs(names: tuple[str, ...], links, kind: pa.DataType = pa.binary()):  # noqa: B008
    """Maps each run of rows with equal `names`, as they come sorted, to pairs by a function of their table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key = [], None
        for batch in batches:
            found, start = [], 0
            for i, k in enumerate(zip(*(batch.column(c).to_pylist() for c in names), strict=True)):
                if k != key:
                    if i > start:
                        held.append(batch.slice(start, i - start))
                    if held:
                        found += links(pa.Table.from_batches(held))
                    held, key, start = [], k, i
            if batch.num_rows > start:
                held.append(batch.slice(start))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c in zip(*found, strict=True)], ["u", "v"])
        if held and (found := links(pa.Table.from_batches(held))):
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c in zip(*found, strict=True)], ["u", "v"])

    return run


_KEPT_BYTES = 6


def pack_set(hashes: np.ndarray) -> bytes:
    """A set of hashes to be sent: the upper 48 bits of each, in order. Two sets of a thousand take a hash that they
    don't share for a common one with a chance of 1 in 10^8."""
    kept = np.unique(hashes.astype("<u8") >> np.uint64(64 - 8 * _KEPT_BYTES))
    return kept.view(np.uint8).reshape(-1, 8)[:, :_KEPT_BYTES].tobytes()


def unpack_set(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // _KEPT_BYTES, 8), dtype=np.uint8)
    out[:, :_KEPT_BYTES] = np.frombuffer(raw, dtype=np.uint8).reshape(-1, _KEPT_BYTES)
    return out.reshape(-1).view("<u8")


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slabs(batches):
            sets = [distinct_hashes(t, words) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()), pa.array([pack_set(s) for s in sets], pa.binary())], ["same", "hashes"])

    return run


def set_similarity(a: bytes, b: bytes) -> float:
    """Jaccard similarity of two whole sets of shingle hashes, as pack_set gives them."""
    x, y = unpack_set(a), unpack_set(b)
    if not len(x) or not len(y):
        return float(len(x) == len(y))
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both)


def block_links(roots: list[bytes], blocks: list[int], sets: list[bytes], similarity: float) -> list[tuple[bytes, bytes]]:
    """Roots to link so that every alike pair of one block, or of two different ones, is connected.

    Pairs that are connected by then are not compared.
    """
    of: dict[bytes, int] = {}
    component = np.array([of.setdefault(r, len(of)) for r in roots])
    if len(of) < 2:
        return []
    sizes = np.array([len(s) // _KEPT_BYTES for s in sets])
    found, ids, n = np.unique(unpack_set(b"".join(sets)), return_inverse=True, return_counts=True)
    several = n[ids] > 1
    ends = np.concatenate([[0], np.cumsum(several)])[np.concatenate([[0], np.cumsum(sizes)])]
    ids, mark, block = ids[several], np.zeros(len(found), dtype=bool), np.array(blocks)
    two, links = block.min() != block.max(), []
    largest = component == np.bincount(component).argmax()  # pairs with these are seen from their other side
    for i in np.flatnonzero(~largest).tolist():
        todo = component != component[i]
        todo[: i + 1] &= largest[: i + 1]
        if two:
            todo &= block != block[i]
        todo &= np.minimum(sizes, sizes[i]) / np.maximum(sizes, sizes[i]) >= similarity
        if not todo.any():
            continue
        own = ids[ends[i] : ends[i + 1]]
        mark[own] = True
        both = np.diff(np.concatenate([[0], np.cumsum(mark[ids])])[ends])
        mark[own] = False
        for j in np.flatnonzero(todo & (both / (sizes + sizes[i] - both) >= similarity)).tolist():
            if component[j] != component[i]:
                links.append((roots[i], roots[j]))
                component[component == component[j]] = component[i]
    return links


def _meetings(whole: DataFrame, bits: int, segments: int, crowd: int, limit: int) -> tuple[DataFrame, DataFrame]:
    """Pairs u, v of ids that meet under a key, and ties u, v of ids that connect those that meet in a crowd.

    A part of the ring at a time: its keys are gone before the next ones are filed, and what the crowds have connected by
    then is a group, within which nothing is compared again.
    """
    cuts, met, ties, group = [c * segments // 32 for c in _CUTS], [], [], None
    for part in zip(cuts, cuts[1:], strict=False):
        rows = whole.withColumn("group", F.col("id")) if group is None else whole.join(group, F.col("id") == F.col("node"), "left").withColumn("group", F.coalesce("root", "id"))
        filed = map_arrow(rows.select("id", "group", "size", "print"), _file(bits, part), f"key long, id long, group long, {', '.join(f'{w} long' for w in _WORD_NAMES)}")
        found = cut(map_arrow(filed.repartition("key").sortWithinPartitions("key", "id"), _meet(crowd, limit), "u long, v long, dense long, hub long"))
        met.append(found.filter("dense is null").select("u", "v"))
        ties.append(found.filter("dense <> hub").select(F.col("dense").alias("u"), F.col("hub").alias("v")))
        if part[1] < segments and not ties[-1].isEmpty():
            group = cut(connected_components(reduce(DataFrame.union, ties), at_once=_LINKS))
    return reduce(DataFrame.union, met), reduce(DataFrame.union, ties)


def similar_groups(docs: DataFrame, words: int = 5, similarity: float = 0.8, crowd: int = 32, bits: int | None = None) -> DataFrame:
    """doc_id, text_hash (XXH64 of the text), component_id (smallest doc_id of its group) and kept for every row.

    Documents whose sets of shingles have a Jaccard similarity of `similarity` or more are linked. SimHash fingerprints
    of the distinct shingles propose the pairs, by pigeonring chains on a ring of segments of `bits` bits (8 for up to
    4 million rows, then more; ring_segments of them): those that agree in a segment and in one of the two after it.
    Where less than two thirds as many bits differ as there are segments, some chain of three has one wrong bit at most
    and starts with an agreeing segment, so such pairs always meet; of those at `similarity` all but 1 in 10,000 do.
    192 bits, then all bits, reject what cannot be alike, and every pair is decided on the two whole sets: first each
    document with two of the others that it met, then in blocks all of those that met and that these links don't
    connect. A key gives no more pairs than it has rows: where it would, or has over `crowd` fingerprints (and four
    times the average), only as many pairs within 192 bits' bound are listed as connect all; what these connect is
    compared in blocks. Texts with the same set of shingles are one class from the start. A null, an empty text and one
    without words are alike. `kept` holds for one row of each group (and rows that are wholly like it): the smallest by
    (doc_id, text_hash), null ids last. A group without ids has a null component_id. A very long text is read whole and
    is a block's only one; columns of other names are not read; an empty table gives an empty result.
    """
    kind, n_rows = docs.schema["doc_id"].dataType.simpleString(), docs.count()
    bits = bits or next(b for b, most in _SEGMENT_BITS if n_rows <= most)
    crowd = crowd + 4 * (n_rows >> (2 * bits))
    given = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    segments = ring_segments(bits, similarity)
    table = cut(map_arrow(given, _signatures(words, bits * segments // 64), f"doc_id {kind}, text_hash long, same binary, id long, size long, print binary"))
    row = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")
    classes = cut(table.groupBy("same").agg(F.min("doc_id").alias("low"), F.min(row).alias("first_row"), *(F.first(c).alias(c) for c in ("id", "size", "print"))))
    whole = classes.select("id", "same", "size", "print")
    met, ties = _meetings(whole.select("id", "size", "print"), bits, segments, crowd, words_limit(similarity))
    a, b = (whole.select(F.col("id").alias(i), F.col("same").alias(f"{i}_same"), F.col("size").alias(f"{i}_size"), F.col("print").alias(c)) for i, c in (("u", "a"), ("v", "b")))
    both = met.distinct().join(a, "u").join(b, "v")
    single = cut(map_arrow(both.select(F.col("u_same").alias("u"), F.col("v_same").alias("v"), F.least("u_size", "v_size").alias("size"), "a", "b"), _pass_whole(similarity), "u binary, v binary"))
    ties = cut(ties.join(a.select("u", "u_same"), "u").join(b.select("v", "v_same"), "v").select(F.col("u_same").alias("u"), F.col("v_same").alias("v")))
    pairs = single.union(ties)

    told = pairs.select(F.explode(F.array("u", "v")).alias("same"))
    speakers = classes.join(told.distinct(), "same", "left_semi").select(F.col("first_row.doc_id").alias("speaker"), F.col("first_row.text_hash").alias("speaks")).distinct()
    texts = given.join(speakers, F.col("doc_id").eqNullSafe(F.col("speaker")) & (F.col("text_hash").eqNullSafe(F.col("speaks"))), "left_semi").select("text")
    sets = map_arrow(texts, _sets(words), "same binary, hashes binary")
    if not table.groupBy("doc_id", "text_hash").count().filter("count > 1").isEmpty():  # else each class has one speaker
        sets = sets.dropDuplicates(["same"])
    sets = cut(sets)

    around = pairs.union(pairs.select("v", "u")).groupBy("u").agg(F.min("v").alias("low"), F.max("v").alias("high"))
    first = around.select("u", F.explode(F.array("low", "high")).alias("v")).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    both = first.join(sets.select(F.col("same").alias("u"), F.col("hashes").alias("a")), "u").join(sets.select(F.col("same").alias("v"), F.col("hashes").alias("b")), "v")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            alike = [set_similarity(a, b) >= similarity for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True)]
            yield batch.select(["u", "v"]).filter(pa.array(alike, pa.bool_()))

    near = connected_components(map_arrow(both.select("u", "v", "a", "b"), verify, "u binary, v binary"), at_once=_LINKS)
    rooted = cut(classes.join(near, F.col("same") == F.col("node"), "left").select("same", "low", "first_row", "size", F.coalesce("root", "same").alias("root")))
    roots = rooted.select("same", "root")
    open_pairs = single.join(roots.select(F.col("same").alias("u"), F.col("root").alias("a")), "u").join(roots.select(F.col("same").alias("v"), F.col("root").alias("b")), "v").filter("a <> b").select("u", "v")
    open_pairs = open_pairs.union(ties)  # all of them: they connect pairs that they don't list
    clusters = connected_components(open_pairs, at_once=_LINKS).select(F.col("node").alias("same"), F.col("root").alias("cluster"))
    clusters = cut(clusters.union(clusters.select(F.col("cluster").alias("same"), "cluster").distinct()))
    members = clusters.join(rooted.select("same", "root", "size"), "same")
    n_blocks = F.greatest(F.ceil(F.count("*") / _BLOCK_DOCS), F.ceil(F.sum("size") / _BLOCK_SHINGLES))
    split = members.groupBy("cluster").agg(n_blocks.alias("n"), (F.min("root") < F.max("root")).alias("several")).filter("several")
    dealt = members.drop("size").join(split, "cluster").withColumn("block", F.pmod(F.xxhash64("same"), F.col("n")))
    cells = sets.join(dealt, "same").withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    cells = cells.select("cluster", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"), "block", "root", "hashes")
    cells = cells.repartition("cluster", "one", "two").sortWithinPartitions("cluster", "one", "two")

    def compare_sets(rows: pa.Table) -> list[tuple[bytes, bytes]]:
        return block_links(rows.column("root").to_pylist(), rows.column("block").to_pylist(), rows.column("hashes").to_pylist(), similarity)

    last = connected_components(map_arrow(cells, _runs(("cluster", "one", "two"), compare_sets), "u binary, v binary"), at_once=_LINKS).withColumnRenamed("root", "top")
    named = rooted.join(last, F.col("root") == F.col("node"), "left").select("same", "low", "first_row", F.coalesce("top", "root").alias("root"))
    lows = named.groupBy("root").agg(F.min("low").alias("component_id"), F.min("first_row").alias("kept_row"))
    named = named.join(lows, "root").select("same", "component_id", "kept_row")
    return table.select("doc_id", "text_hash", "same").join(named, "same").select("doc_id", "text_hash", "component_id", (row == F.col("kept_row")).alias("kept"))
