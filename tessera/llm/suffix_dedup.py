"""Removal of byte strings that a document with a smaller id has too, by a distributed merge sort of suffixes.

Documents are dealt into buckets. Three rounds over them decide, for every place of every text, whether the `length`
bytes from there also start in a document with a smaller id:

1. Sampling. In each window of `length` bytes the k-gram with the smallest hash (leftmost, if several are) is its
   anchor, so equal windows have equal anchors at the same distance; the windows of one anchor are one stretch of
   text, its context. Per bucket the distinct anchor hashes go to the range of hashes that owns them. The reply says
   which anchors are in one document only: none of their windows is anywhere else, and they are done with.
2. Suffixes. Each bucket sorts the suffixes that start at the anchors that are left (cut to their contexts, what
   stands before the anchor following in reverse), drops repeats, keeps the smallest doc_id with each, and sends
   front-coded runs to the ranges of the suffix order. There a loser tree merges the runs. It compares the lengths of
   known common prefixes first and reads bytes only beyond them, so no known prefix is compared again. Suffixes with
   the same anchor come out side by side; where they differ further on, their windows are compared one by one. The
   smallest doc_id of each window goes back to each run. An anchor with very many contexts (the first of a passage
   that many documents hold, each after text of its own) is not gathered: the suffixes that start at each of its
   windows are sent instead, spread over the whole order, and equal ones meet in the same way.
3. Removal. Each bucket marks the bytes of the windows whose suffix has a smaller doc_id than their own document.

Sampling loses nothing: a window found in two documents has its anchor in both. What is sent grows with the distinct
text of a bucket, not with copies: a passage that a third of all documents hold is sent once by each bucket.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hash_sample, map_arrow, no_clash, slabs, tidied

_CHUNK = 1 << 16
_GRAM = 24
_U = np.uint64
#: Fixed, arbitrary odd multipliers of the rolling hash, one for each doubling, and of the final mix.
_DOUBLE = (_U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F), _U(0x165667B19E3779F9), _U(0xD6E8FEB86659FD93), _U(0xA0761D6478BD642F))
_MIX = _U(0xFF51AFD7ED558CCD)
_BYTE = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(33))) * _MIX
    return x ^ (x >> _U(29))


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the _GRAM bytes from each place."""
    one = _BYTE[data]
    two = one[:-1] * _DOUBLE[0] + one[1:]
    four = two[:-2] * _DOUBLE[1] + two[2:]
    eight = four[:-4] * _DOUBLE[2] + four[4:]
    sixteen = eight[:-8] * _DOUBLE[3] + eight[8:]
    return _mix(sixteen[:-8] * _DOUBLE[4] + eight[16:])


_PLACE = _U(20)


def _leftmost_minima(h: np.ndarray, width: int) -> np.ndarray:
    """For each window of `width` hashes (their upper 44 bits), the place of its smallest, the leftmost if several are."""
    low, span = (h >> _PLACE << _PLACE) | np.arange(len(h), dtype=np.uint64), 1
    while span < width:
        step = min(span, width - span)
        low = np.minimum(low[step:], low[: len(low) - step])
        span += step
    return (low & _U((1 << 20) - 1)).view(np.int64)


@dataclass
class Anchors:
    """Of each anchor: its document (index), its first window and how many there are, how far it is, and two hashes."""

    doc: np.ndarray
    first: np.ndarray
    windows: np.ndarray
    left: np.ndarray
    gram: np.ndarray
    context: np.ndarray


def _anchors(texts: list[bytes], length: int) -> Anchors:
    parts: list[tuple[np.ndarray, ...]] = []

    def add(joined: bytes, docs: list[int], starts: list[int], shift: int) -> None:
        h = _gram_hashes(np.frombuffer(joined, dtype=np.uint8))
        at = _leftmost_minima(h, length - _GRAM + 1)  # of the window from each place
        whole = np.zeros(len(at), dtype=bool)
        for a, b in zip(starts, [*starts[1:], len(joined)], strict=True):
            whole[a : b - length + 1] = True
        j = np.flatnonzero(whole)
        if not len(j):
            return
        at = at[j]
        head = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))  # windows of two documents have different places
        n = np.diff(np.concatenate([head, [len(j)]]))
        first, place = j[head], at[head]
        end = first + n - 1 + length - _GRAM
        context = h[first] * _DOUBLE[0]
        for skip, m in ((_GRAM, _DOUBLE[1]), (2 * _GRAM, _DOUBLE[2])):
            context = _mix(context + h[np.minimum(first + skip, end)]) * m
        context = _mix(context + h[end] + n.astype(np.uint64) * _DOUBLE[3] + (place - first).astype(np.uint64) * _DOUBLE[4])
        which = np.searchsorted(starts, first, side="right") - 1
        # mixed once more: the smallest hashes of windows are small, and ranges of hashes are to be alike
        parts.append((np.array(docs)[which], first - np.array(starts)[which] + shift, n, place - first, _mix(h[place] * _DOUBLE[2]), context))

    held: list[bytes] = []
    docs: list[int] = []
    starts: list[int] = []
    size = 0
    for i, text in enumerate(texts):
        if len(text) < length:
            continue
        if len(text) > _CHUNK:
            for a in range(0, len(text) - length + 1, _CHUNK):
                add(text[a : a + _CHUNK + length - 1], [i], [0], a)
            continue
        if size + len(text) > _CHUNK:
            add(b"".join(held), docs, starts, 0)
            held, docs, starts, size = [], [], [], 0
        held.append(text)
        docs.append(i)
        starts.append(size)
        size += len(text)
    if held:
        add(b"".join(held), docs, starts, 0)
    if not parts:
        return Anchors(*(np.zeros(0, dtype=t) for t in (np.int64, np.int64, np.int64, np.int64, np.uint64, np.uint64)))
    return Anchors(*(np.concatenate(c) for c in zip(*parts, strict=True)))


def _pack(x: np.ndarray, width: int) -> bytes:
    """The low `width` bytes of each number, a plane for each byte, compressed."""
    planes = np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _unpack(raw: bytes, n: int, width: int) -> np.ndarray:
    out = np.zeros((n, 8), dtype=np.uint8)
    out[:, :width] = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), dtype=np.uint8).reshape(width, n).T
    return out.reshape(-1).view("<u8").astype(np.uint64)


# --- round 1: which anchors are shared ---------------------------------------------------------------------------------

_ALONE, _SHARED, _HOT = 0, 1, 2
_BITS = _U(48)


@dataclass
class _Pairs:
    """The distinct anchors (48 bits of their hashes) of a bucket and their distinct contexts, in order."""

    gram: np.ndarray
    contexts: np.ndarray  # of each gram: how many
    several: np.ndarray  # ... and whether several documents of the bucket have it
    gram_of: np.ndarray  # of each pair of gram and context
    of: np.ndarray  # the pair of each anchor


def _pairs(a: Anchors) -> _Pairs:
    gram = a.gram >> (_U(64) - _BITS)
    order = np.argsort(gram)
    g = gram[order]
    twin = np.zeros(len(g) + 1, dtype=bool)
    twin[1:-1] = g[1:] == g[:-1]
    several = np.flatnonzero(twin[1:] | twin[:-1])  # only equal grams need their contexts in order
    some = order[several]
    order[several] = some[np.lexsort((some, a.context[some], gram[some]))]
    g, c, d = gram[order], a.context[order], a.doc[order]
    of = np.zeros(len(g), dtype=np.int64)
    if not len(g):
        return _Pairs(g, of, np.zeros(0, dtype=bool), of, of)
    new_gram = np.concatenate([[True], g[1:] != g[:-1]])
    new = new_gram | np.concatenate([[True], c[1:] != c[:-1]])
    head = np.flatnonzero(new_gram)
    several = np.minimum.reduceat(d, head) != np.maximum.reduceat(d, head)
    of[order] = np.cumsum(new) - 1
    return _Pairs(g[head], np.add.reduceat(new.astype(np.int64), head), several, (np.cumsum(new_gram) - 1)[new], of)


def _judge(blocks: list[tuple[np.ndarray, np.ndarray, np.ndarray]], hot_contexts: int) -> list[np.ndarray]:
    """For the grams of every block of a range of hashes: _ALONE, _SHARED or _HOT. A block: grams, contexts, several."""
    gram, contexts, several = (np.concatenate(c) for c in zip(*blocks, strict=True))
    block = np.repeat(np.arange(len(blocks)), [len(b[0]) for b in blocks])
    out = np.zeros(len(gram), dtype=np.uint8)
    if len(gram):
        order = np.argsort(gram, kind="stable")
        g, b = gram[order], block[order]
        head = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
        shared = (np.minimum.reduceat(b, head) != np.maximum.reduceat(b, head)) | np.maximum.reduceat(several[order], head)
        hot = np.add.reduceat(contexts[order].astype(np.int64), head) > hot_contexts
        state = np.where(shared, np.where(hot, _HOT, _SHARED), _ALONE).astype(np.uint8)
        out[order] = np.repeat(state, np.diff(np.concatenate([head, [len(g)]])))
    return np.split(out, np.cumsum([len(x[0]) for x in blocks])[:-1])


# --- round 2: the suffixes that are left -----------------------------------------------------------------------------


def _expand(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For counts n: to whom each of n.sum() items belongs, and its number there."""
    return np.repeat(np.arange(len(n)), n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


@dataclass
class _Run:
    """The sorted distinct suffixes of a bucket, and what they stand for.

    A pair of anchor and context is one text wherever it is, so its first place speaks for all; a unit is a window of
    a pair, base[pair] + its number there.
    """

    base: np.ndarray
    windows: np.ndarray  # of each pair, 0 if its anchor is alone
    suffix: list[bytes]  # from anchors: what follows, then in reverse what stands before
    left: np.ndarray  # ... how much that is
    pair: np.ndarray  # ... whose it is
    low: np.ndarray  # ... its smallest document
    hot: list[bytes]  # from windows of hot anchors
    hot_unit: np.ndarray  # units
    hot_of: np.ndarray  # ... their suffix
    hot_low: np.ndarray  # of each suffix


def _run(texts: list[bytes], ids: np.ndarray, a: Anchors, p: _Pairs, state: np.ndarray, length: int) -> _Run:
    """`state` is that of each pair."""
    n = len(state)
    speaker = np.zeros(n, dtype=np.int64)
    speaker[p.of[::-1]] = np.arange(len(p.of))[::-1]
    low = np.full(n, np.iinfo(np.int64).max)
    np.minimum.at(low, p.of, ids[a.doc])
    windows = np.where(state == _ALONE, 0, a.windows[speaker]) if n else np.zeros(0, dtype=np.int64)
    base = np.cumsum(windows) - windows

    shared = np.flatnonzero(state == _SHARED)
    who = speaker[shared]
    found = []
    for d, f, left, m in zip(a.doc[who].tolist(), a.first[who].tolist(), a.left[who].tolist(), (a.windows[who] + length - 1).tolist(), strict=True):
        text = texts[d]
        found.append(text[f + left : f + m] + text[f : f + left][::-1])
    order = np.array(sorted(range(len(found)), key=found.__getitem__), dtype=np.int64)
    suffix = [found[i] for i in order.tolist()]
    pair = shared[order]

    owner, step = _expand(np.where(state == _HOT, windows, 0))
    starts = (a.first[speaker[owner]] + step).tolist()
    each = [texts[d][f : f + length] for d, f in zip(a.doc[speaker[owner]].tolist(), starts, strict=True)]
    hot = sorted(set(each))
    place = {w: i for i, w in enumerate(hot)}
    hot_of = np.array([place[w] for w in each], dtype=np.int64)
    hot_low = np.full(len(hot), np.iinfo(np.int64).max)
    np.minimum.at(hot_low, hot_of, low[owner])
    return _Run(base, windows, suffix, a.left[speaker[pair]], pair, low[pair], hot, base[owner] + step, hot_of, hot_low)


def common_prefix(a: bytes, b: bytes, known: int = 0) -> int:
    """How many bytes agree, when the first `known` are known to."""
    if a == b:
        return len(a)
    n = min(len(a), len(b))
    while known < n and a[known] == b[known]:
        known += 1
    return known


def front_code(suffix: list[bytes]) -> bytes:
    """A sorted run: for each suffix the bytes it shares with the one before, its length, and its other bytes."""
    sizes = np.fromiter(map(len, suffix), dtype=np.int64, count=len(suffix))
    shared = np.zeros(len(suffix), dtype=np.int64)
    width = int(sizes.max(initial=1))
    for a in range(1, len(suffix), 1 << 17):
        some = np.array(suffix[a - 1 : a + (1 << 17)], dtype=f"S{width}").view(np.uint8).reshape(-1, width)
        differ = some[1:] != some[:-1]
        first = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
        own = sizes[a - 1 : a + (1 << 17)]
        shared[a : a + len(first)] = np.minimum(first, np.minimum(own[1:], own[:-1]))
    head = np.array([len(suffix)], dtype="<u4").tobytes() + shared.astype("<u2").tobytes() + sizes.astype("<u2").tobytes()
    return zstandard.ZstdCompressor(level=3).compress(head + b"".join([s[k:] for s, k in zip(suffix, shared.tolist(), strict=True)]))


def front_decode(raw: bytes) -> tuple[list[bytes], list[int]]:
    """The suffixes of a run, and what each shares with the one before."""
    data = zstandard.ZstdDecompressor().decompress(raw)
    n = int.from_bytes(data[:4], "little")
    shared = np.frombuffer(data, dtype="<u2", count=n, offset=4).tolist()
    sizes = np.frombuffer(data, dtype="<u2", count=n, offset=4 + 2 * n).tolist()
    out, last, at = [], b"", 4 + 4 * n
    for k, size in zip(shared, sizes, strict=True):
        last = last[:k] + data[at : at + size - k]
        at += size - k
        out.append(last)
    return out, shared


def merge_runs(runs: list[tuple[list[bytes], list[int]]]) -> Iterator[tuple[int, int, int]]:
    """(run, index, bytes shared with the suffix before) over sorted runs, in order, by a loser tree.

    `known[r]` is what the head of run r shares with the suffix that beat it last (with the last output, for the
    contenders on its path): of two contenders the one that shares more with the same earlier suffix is smaller, and
    the other shares with it what it shared before; only at a tie are bytes read, beyond those known to agree.
    """
    size = 1
    while size < len(runs):
        size *= 2
    heads: list[bytes | None] = [r[0][0] if r[0] else None for r in runs] + [None] * (size - len(runs))
    known = [0 if h is not None else -1 for h in heads]
    at = [0] * size
    loser = [0] * size

    def play(a: int, b: int) -> tuple[int, int]:
        if known[a] != known[b]:
            return (a, b) if known[a] > known[b] else (b, a)
        x, y = heads[a], heads[b]
        if x is None or y is None:
            return a, b
        h = common_prefix(x, y, known[a])
        if h == len(x) or (h < len(y) and x[h] < y[h]):
            known[b] = h
            return a, b
        known[a] = h
        return b, a

    winners = list(range(size))
    level = size
    while level > 1:
        level //= 2
        nxt = []
        for i in range(level):
            win, lose = play(winners[2 * i], winners[2 * i + 1])
            loser[level + i] = lose
            nxt.append(win)
        winners = nxt
    win = winners[0]
    while heads[win] is not None:
        yield win, at[win], known[win]
        at[win] += 1
        suffixes, shared = runs[win]
        if at[win] < len(suffixes):
            heads[win], known[win] = suffixes[at[win]], shared[at[win]]
        else:
            heads[win], known[win] = None, -1
        node = (size + win) // 2
        while node:
            other = loser[node]
            if known[win] > known[other]:
                pass
            elif known[win] < known[other]:
                loser[node], win = win, other
            else:
                w, lose = play(win, other)
                if w != win:
                    loser[node], win = lose, w
            node //= 2


def _lowest(runs: list[tuple[list[bytes], list[int]]], lows: list[np.ndarray]) -> list[np.ndarray]:
    """For each suffix of each run the smallest document that has it, in any run."""
    out = [x.copy() for x in lows]
    group: list[tuple[int, int]] = []

    def close() -> None:
        if len(group) > 1:
            low = min(int(lows[r][i]) for r, i in group)
            for r, i in group:
                out[r][i] = low

    for r, i, shared in merge_runs(runs):
        if group:
            own, last = runs[r][0][i], runs[group[-1][0]][0][group[-1][1]]
            if not shared == len(own) == len(last):
                close()
                group.clear()
        group.append((r, i))
    close()
    return out


def _lowest_windows(runs: list[tuple[list[bytes], list[int]]], lefts: list[np.ndarray], lows: list[np.ndarray], length: int) -> list[np.ndarray]:
    """For each window of each context (suffixes from anchors) of each run, in order: the smallest document that has it."""
    sizes = [np.array([len(s) - length + 1 for s in r[0]], dtype=np.int64) for r in runs]
    ends = [np.cumsum(n) for n in sizes]
    uniform = [x.copy() for x in lows]
    special: list[tuple[int, int, list[int]]] = []
    group: list[tuple[int, int]] = []
    plain = True  # all of the group are one context

    def close() -> None:
        if len(group) < 2:
            return
        if plain:
            low = min(int(lows[r][i]) for r, i in group)
            for r, i in group:
                uniform[r][i] = low
            return
        lowest: dict[bytes, int] = {}
        keys = []
        for r, i in group:
            s, left, low = runs[r][0][i], int(lefts[r][i]), int(lows[r][i])
            context = (s[len(s) - left :][::-1] + s[: len(s) - left]) if left else s
            own = [context[w : w + length] for w in range(len(s) - length + 1)]
            keys.append(own)
            for k in own:
                if lowest.setdefault(k, low) > low:
                    lowest[k] = low
        for (r, i), own in zip(group, keys, strict=True):
            special.append((r, i, [lowest[k] for k in own]))

    for r, i, shared in merge_runs(runs):
        if group:
            q, j = group[-1]
            if shared < _GRAM:
                close()
                group.clear()
                plain = True
            elif plain and not (shared == len(runs[r][0][i]) == len(runs[q][0][j]) and lefts[r][i] == lefts[q][j]):
                plain = False
        group.append((r, i))
    close()
    out = [np.repeat(u, n) for u, n in zip(uniform, sizes, strict=True)]
    for r, i, values in special:
        out[r][ends[r][i] - len(values) : ends[r][i]] = values
    return out


# --- the rounds over the table ---------------------------------------------------------------------------------------


def _texts(table: pa.Table) -> tuple[list[bytes], list[bytes], np.ndarray, np.ndarray]:
    """The texts of a bucket in an order that does not depend on how its rows arrive, the same with nothing in place of
    those without an id (they match nothing), their ids, and that order."""
    known = table.column("doc_id").is_valid().to_numpy(zero_copy_only=False)
    ids, z = table.column("doc_id").fill_null(0).to_numpy(), table.column("z").to_pylist()
    order = np.lexsort((np.array([xxhash.xxh64_intdigest(x) for x in z], dtype=np.uint64), ids, ~known)) if len(ids) else np.zeros(0, dtype=np.int64)
    un = zstandard.ZstdDecompressor()
    texts = [un.decompress(z[i]) if z[i] else b"" for i in order.tolist()]
    return texts, [t if k else b"" for t, k in zip(texts, known[order].tolist(), strict=True)], ids[order], order


def _compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    press = zstandard.ZstdCompressor(level=2)
    for batch in slabs(batches):
        z = [press.compress(t.encode("utf-8", "surrogatepass")) if t else b"" for t in batch.column("text").to_pylist()]
        names = [c for c in batch.schema.names if c != "text"]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(z, pa.binary())], [*names, "z"])


#: Grams of the sample for each range of suffixes, and how many a document of it gives at most.
_RANGE_GRAMS, _DOC_GRAMS = 128, 16


def _splitters(docs: DataFrame, length: int, ranges: int) -> list[bytes]:
    """Bounds that cut the order of suffixes into ranges, from a sample of places that grows with their number alone.

    They only balance the work.
    """
    if ranges == 1:
        return []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slabs(batches):
            some = []
            for t in batch.column("text").to_pylist():
                raw = t.encode("utf-8", "surrogatepass")
                last = len(raw) - length
                some += [raw[i : i + _GRAM] for i in range(last % (last // _DOC_GRAMS + 1) // 2, last + 1, last // _DOC_GRAMS + 1)]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.binary())], ["s"])

    long = docs.filter(F.octet_length("text") >= length)
    picked = hash_sample(long, ("doc_id", "text"), ranges * _RANGE_GRAMS // _DOC_GRAMS + 400)
    found = sorted(bytes(r["s"]) for r in map_arrow(picked.select("text"), run, "s binary").collect())  # bounded by the number of ranges
    return sorted({found[i * len(found) // ranges] for i in range(1, ranges)}) if found else []


def _sizes(total: int, bucket_bytes: int) -> tuple[int, int]:
    """Buckets and ranges for so many bytes of text.

    Up to 1024 buckets each has `bucket_bytes`. Beyond, buckets grow with the root of the total, up to eight times as large,
    and there are fewer ranges than buckets (an eighth at least), so that the blocks between them grow less than with the square.
    """
    buckets = -(-total // bucket_bytes)
    if buckets > 1024:
        buckets = -(-total // int(bucket_bytes * min(8.0, (buckets / 1024) ** 0.5)))
    return max(1, buckets), max(1, min(buckets, max(1024, buckets // 8)))


def remove_repeats(docs: DataFrame, length: int = 50, bucket_bytes: int = 4 << 20, hot_contexts: int = 20_000, keep: tuple[str, ...] = (), as_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, spans (start, end of each removed stretch, in bytes), kept (the bytes left) and the columns in
    `keep` for every row.

    A byte is removed if `length` bytes that cover it also start in a document with a smaller doc_id; all is judged on
    the input. A null text is empty; texts shorter than `length` keep all. A row without a doc_id is smaller than none
    and has none smaller: it keeps all and removes from none. Rows that repeat a doc_id are one document in this: none
    of them removes from the others. Columns of other names are not read, and those in `keep` may have any name but
    that of an output; an empty table gives an empty result. With `as_text` kept is a string, without the bytes of
    characters that were cut in two. `bucket_bytes` is about the text that one task holds (see _sizes), but for a
    single longer document; anchors with more than `hot_contexts` contexts are compared window by window from the start.
    """
    if not _GRAM < length or 2 * length - _GRAM > 4 * _GRAM:  # four grams cover a context
        raise ValueError("length is out of range")
    keep = tuple(c for c in dict.fromkeys(keep) if c != "doc_id")
    no_clash(keep, _KEPT.names)
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets, ranges = _sizes(total, bucket_bytes)
    bounds = _splitters(docs, length, ranges)
    others = [F.col(c).alias(f"keep_{i}") for i, c in enumerate(keep)]
    other_kinds = "".join(f", keep_{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(keep))
    dealt = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *others, F.pmod(F.xxhash64("doc_id", "text"), F.lit(buckets)).cast("int").alias("bucket"))
    # one exchange of the texts serves all three rounds: the plan reuses it, as it does those of the shares
    held = map_arrow(dealt, _compress, f"doc_id long{other_kinds}, bucket int, z binary").repartition(buckets, "bucket")
    kept_schema = _KEPT.set(3, pa.field("kept", pa.string())) if as_text else _KEPT
    arrow = pa.schema([("to", pa.int32()), ("bucket", pa.int32()), ("n", pa.int32()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary())])
    schema = "to int, bucket int, n int, a binary, b binary, c binary"

    def rows(found: list[tuple]) -> pa.Table:
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), arrow.types, strict=True)], schema=arrow) if found else arrow.empty_table()

    def hash_cuts(gram: np.ndarray) -> np.ndarray:
        edges = np.array([(i << 48) // ranges for i in range(1, ranges)], dtype=np.uint64)
        return np.concatenate([[0], np.searchsorted(gram, edges), [len(gram)]])

    def range_cuts(suffix: list[bytes]) -> list[int]:
        return [0, *(bisect.bisect_left(suffix, b) for b in bounds), len(suffix)]

    def sample(table: pa.Table) -> pa.Table:
        p = _pairs(_anchors(_texts(table)[1], length))
        at, bucket, out = hash_cuts(p.gram), table.column("bucket")[0].as_py(), []
        for r, (a, b) in enumerate(zip(at, at[1:], strict=False)):
            if b > a:
                step = np.diff(p.gram[a:b], prepend=_U(0)) << _U(1) | p.several[a:b].astype(np.uint64)
                out.append((r, bucket, int(b - a), _pack(step, 7), _pack(p.contexts[a:b], 4), None))
        return rows(out)

    def judge(table: pa.Table) -> pa.Table:
        blocks = table.to_pylist()
        read = []
        for x in blocks:
            step = _unpack(x["a"], x["n"], 7)
            read.append((np.cumsum(step >> _U(1)), _unpack(x["b"], x["n"], 4), (step & _U(1)).astype(bool)))
        press = zstandard.ZstdCompressor(level=3)
        return rows([(x["bucket"], x["to"], x["n"], press.compress(s.tobytes()), None, None) for x, s in zip(blocks, _judge(read, hot_contexts), strict=True)])

    def run_of(texts: list[bytes], ids: np.ndarray, reply: pa.Table) -> tuple[Anchors, _Pairs, _Run]:
        anchors = _anchors(texts, length)
        p = _pairs(anchors)
        at, state = hash_cuts(p.gram), np.zeros(len(p.gram), dtype=np.uint8)
        for x in reply.to_pylist():
            state[at[x["bucket"]] : at[x["bucket"] + 1]] = np.frombuffer(zstandard.ZstdDecompressor().decompress(x["a"]), dtype=np.uint8)
        return anchors, p, _run(texts, ids, anchors, p, state[p.gram_of], length)

    def send(table: pa.Table, reply: pa.Table) -> pa.Table:
        if not table.num_rows:
            return rows([])
        _, texts, ids, _ = _texts(table)
        _, _, run = run_of(texts, ids, reply)
        bucket, out = table.column("bucket")[0].as_py(), []
        at = range_cuts(run.suffix)
        for q, (a, b) in enumerate(zip(at, at[1:], strict=False)):
            if b > a:
                out.append((q, bucket, b - a, front_code(run.suffix[a:b]), _pack(run.low[a:b].view(np.uint64), 8), _pack(run.left[a:b], 2)))
        at = range_cuts(run.hot)
        for q, (a, b) in enumerate(zip(at, at[1:], strict=False)):
            if b > a:
                out.append((ranges + q, bucket, b - a, front_code(run.hot[a:b]), _pack(run.hot_low[a:b].view(np.uint64), 8), None))
        return rows(out)

    def merge(table: pa.Table) -> pa.Table:
        blocks = sorted(table.to_pylist(), key=lambda x: x["bucket"])
        lows = [_unpack(x["b"], x["n"], 8).view(np.int64) for x in blocks]
        runs = [front_decode(x["a"]) for x in blocks]
        if blocks[0]["to"] < ranges:
            found = _lowest_windows(runs, [_unpack(x["c"], x["n"], 2).astype(np.int64) for x in blocks], lows, length)
        else:
            found = _lowest(runs, lows)
        return rows([(x["bucket"], x["to"], len(f), _pack(f.view(np.uint64), 8), None, None) for x, f in zip(blocks, found, strict=True)])

    def remove(table: pa.Table, replies: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.Table.from_arrays([*kept_schema.empty_table().columns, *(table.column(f"keep_{i}") for i in range(len(keep)))], [*_KEPT.names, *(f"keep_{i}" for i in range(len(keep)))])
        texts, known, ids, order = _texts(table)
        anchors, p, run = run_of(known, ids, replies.filter(pc.equal(replies.column("round"), 1)))
        low = np.full(int(run.windows.sum()), np.iinfo(np.int64).max)
        owner, step = _expand(run.windows[run.pair])
        unit = run.base[run.pair[owner]] + step  # of the windows of the suffixes, in order
        until = np.concatenate([[0], np.cumsum(run.windows[run.pair])])
        at, hot_at, hot_low = range_cuts(run.suffix), range_cuts(run.hot), run.hot_low.copy()
        for x in replies.filter(pc.equal(replies.column("round"), 2)).to_pylist():
            q, values = x["bucket"], _unpack(x["a"], x["n"], 8).view(np.int64)
            if q < ranges:
                low[unit[until[at[q]] : until[at[q + 1]]]] = values
            else:
                hot_low[hot_at[q - ranges] : hot_at[q - ranges + 1]] = values
        low[run.hot_unit] = hot_low[run.hot_of]
        left = np.flatnonzero(run.windows[p.of] > 0)
        owner, step = _expand(run.windows[p.of[left]])
        anchor = left[owner]
        doc, first = anchors.doc[anchor], anchors.first[anchor] + step
        gone = low[run.base[p.of[anchor]] + step] < ids[doc]
        doc, first = doc[gone], first[gone]
        by = np.lexsort((first, doc))
        doc, first = doc[by], first[by]
        spans: dict[int, list[tuple[int, int]]] = {}
        if len(doc):
            apart = np.concatenate([[True], (doc[1:] != doc[:-1]) | (first[1:] > first[:-1] + length)])
            head = np.flatnonzero(apart)
            last = np.concatenate([head[1:], [len(doc)]]) - 1
            for d, x, y in zip(doc[head].tolist(), first[head].tolist(), (first[last] + length).tolist(), strict=True):
                spans.setdefault(d, []).append((x, y))
        kept = []
        for i, text in enumerate(texts):
            last_end, parts = 0, []
            for x, y in spans.get(i, ()):
                parts.append(text[last_end:x])
                last_end = y
            kept.append(b"".join([*parts, text[last_end:]]) if parts else text)
        found = [[{"start": x, "end": y} for x, y in spans.get(i, ())] for i in range(len(texts))]
        rest = [table.column(f"keep_{i}").take(pa.array(order)) for i in range(len(keep))]
        own = [table.column("doc_id").take(pa.array(order)).combine_chunks(), pa.array([len(t) for t in texts], pa.int64()), pa.array(found, _KEPT.field("spans").type), pa.array([k.decode("utf-8", "ignore") for k in kept] if as_text else kept, kept_schema.field("kept").type)]
        return pa.Table.from_arrays([*own, *rest], [*_KEPT.names, *(f"keep_{i}" for i in range(len(keep)))])

    shares = held.groupBy("bucket").applyInArrow(tidied(sample), schema)
    states = shares.repartition(ranges, "to").groupBy("to").applyInArrow(tidied(judge), schema)
    runs = held.groupBy("bucket").cogroup(states.groupBy("to")).applyInArrow(tidied(send), schema)
    lows = runs.repartition(2 * ranges, "to").groupBy("to").applyInArrow(tidied(merge), schema)
    replies = states.withColumn("round", F.lit(1)).union(lows.withColumn("round", F.lit(2)))
    done = held.groupBy("bucket").cogroup(replies.groupBy("to")).applyInArrow(tidied(remove), "doc_id long, n_bytes long, spans array<struct<start: long, end: long>>, kept " + ("string" if as_text else "binary") + other_kinds)
    return done.withColumnsRenamed({f"keep_{i}": c for i, c in enumerate(keep)})


_KEPT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept", pa.binary())])
