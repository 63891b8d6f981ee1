"""Byte-level BPE encoding and decoding with a public vocabulary.

A word (pre-token) is merged in a contiguous rank array: its parts, and beside each the rank of the pair that starts
there. The array is scanned for its minimum, the boundary inside that pair is deleted, and the two ranks beside it are
refreshed, until no pair has a rank. The arrays of many short words are the rows of one matrix, stepped together.
Words longer than LONG bytes, where repeated scans would be quadratic, take the same merges from a heap over linked
parts.

A text is cut where a single space stands before a character that is no white space. No pre-token spans such a cut
and no rule looks across it, so each distinct piece between cuts is encoded once for many texts, its words by a
bounded memo, and the ids of the texts are gathered from those of their pieces.
"""

from __future__ import annotations

import heapq
import json
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

from .common import map_arrow, slabs

LONG = 96
#: What the memo holds at most between two calls (words; ids), the longest word that it keeps, and rows of a matrix. Places
#: of ids that are worked out at once.
_MEMO, _MEMO_IDS, _MEMO_LENGTH, _ROWS = 300_000, 3_000_000, 40, 8192
_STEP = 1 << 18
#: Bits of a place within a word, and the rank of a pair that has none; a rank and a place are one 32-bit number.
_PLACES, _NONE = 7, 1 << 22

# Fixed value: the pre-token pattern of the vocabulary's byte-level pre-tokenizer.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_GENERAL = regex.compile(PATTERN)
# The same over characters below U+0250 and general punctuation, with the classes spelled out for the faster library.
_L, _N, _S = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼½¾", "\t-\r \x85\xa0"
_LATIN = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")
_NOT_LATIN = re.compile("[^\x00-ɏ‐-‧‰-⁞€]")
_NOT_SINGLE = re.compile(r" (?!\S)")
_CUT = re.compile(r" (?=\S)")


def _byte_letters() -> dict[str, int]:
    """Letters that stand for bytes in the vocabulary: printable Latin-1 is itself, the others follow from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Ids of byte strings, ranks of their merges, and special tokens, read from a tokenizer's JSON file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = _byte_letters()
        raw = {token: bytes(letters[c] for c in token) for token in spec["model"]["vocab"]}
        self.ids = {raw[token]: i for token, i in spec["model"]["vocab"].items()}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.rank = {(self.ids[raw[a]], self.ids[raw[b]]): (i, self.ids[raw[a] + raw[b]]) for i, (a, b) in reversed(list(enumerate(pairs)))}
        self.byte_id = [self.ids[bytes([b])] for b in range(256)]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.bytes_of: list[bytes] = [b""] * (1 + max([*self.ids.values(), *self.special.values()]))
        for token, i in self.ids.items():
            self.bytes_of[i] = token
        for token, i in self.special.items():
            self.bytes_of[i] = token.encode()
        self.special_pattern = re.compile("|".join(re.escape(t) for t in sorted(self.special, key=len, reverse=True))) if self.special else None


def merge_long(parts: list[int], rank: dict[tuple[int, int], tuple[int, int]]) -> list[int]:
    """The same merges in the same order (lowest rank, then leftmost) in n log n, for very long words."""
    n = len(parts)
    after, before = [*range(1, n), -1], list(range(-1, n - 1))
    heap = [(rank[p][0], i, *p) for i, p in enumerate(zip(parts, parts[1:], strict=False)) if p in rank]
    heapq.heapify(heap)
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = after[i]
        if parts[i] != a or j < 0 or parts[j] != b:
            continue
        parts[i], parts[j] = rank[a, b][1], -1
        after[i] = after[j]
        if after[j] >= 0:
            before[after[j]] = i
        for x, y in ((before[i], i), (i, after[i])):
            if x >= 0 and y >= 0 and (found := rank.get((parts[x], parts[y]))):
                heapq.heappush(heap, (found[0], x, parts[x], parts[y]))
    return [p for p in parts if p >= 0]


def _gather(x: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Many stretches of x, one after another; a bounded number of places is worked out at a time."""
    ends = np.cumsum(sizes)
    out = np.empty(int(ends[-1]) if len(ends) else 0, dtype=x.dtype)
    a = at = 0
    while a < len(sizes):
        b = max(a + 1, int(np.searchsorted(ends, at + _STEP, side="right")))
        end = int(ends[b - 1])
        out[at:end] = x[np.repeat(starts[a:b] - (ends[a:b] - sizes[a:b] - at), sizes[a:b]) + np.arange(end - at)]
        a, at = b, end
    return out


def _strings(found: pa.Array) -> list[str]:
    """As to_pylist, which makes an object of its own for each string on the way."""
    return found.to_numpy(zero_copy_only=False).tolist()


class _PairTable:
    """Ranks of pairs of ids: a hash table in two arrays, probed by many pairs at once."""

    def __init__(self, keys: np.ndarray, ranks: np.ndarray):
        bits = max(4, (4 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.ranks = np.full(1 << bits, -1, dtype=np.int64), np.full(1 << bits, _NONE, dtype=np.int32)
        left, slot = np.arange(len(keys)), self._slot(keys)
        while len(left):
            free = self.keys[slot] < 0
            self.keys[slot[free]] = keys[left[free]]  # of those that want one slot the last gets it
            got = self.keys[slot] == keys[left]
            self.ranks[slot[got]] = ranks[left[got]]
            left, slot = left[~got], (slot[~got] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).view(np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair; _NONE for pairs without one and where there is no id (-1)."""
        wanted = left.astype(np.int64) << 32 | right.astype(np.int64)
        slot = self._slot(wanted)
        held = self.keys[slot]
        out = np.where(held == wanted, self.ranks[slot], _NONE)
        rows = np.flatnonzero((held != wanted) & (held >= 0))
        slot = slot[rows]
        while len(rows):
            slot = (slot + 1) & self.mask
            held = self.keys[slot]
            hit = held == wanted[rows]
            out[rows[hit]] = self.ranks[slot[hit]]
            more = ~hit & (held >= 0)
            rows, slot = rows[more], slot[more]
        return out


class Merger:
    """The contiguous rank arrays of many short words at once: a row per word, a scan and a deletion per step."""

    def __init__(self, vocabulary: Vocabulary):
        found = np.array(list(vocabulary.rank.values()), dtype=np.int64).reshape(-1, 2)
        if len(found) >= _NONE:
            raise ValueError("too many merges")
        self.rank = _PairTable(np.array([a << 32 | b for a, b in vocabulary.rank], dtype=np.int64), found[:, 0].astype(np.int32))
        self.merged = np.zeros(1 + int(found[:, 0].max(initial=0)), dtype=np.int32)
        self.merged[found[:, 0]] = found[:, 1]
        self.byte_id = np.array(vocabulary.byte_id, dtype=np.int32)
        self.byte_rank = self.rank(np.repeat(self.byte_id, 256), np.tile(self.byte_id, 256))

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the words, one after another, and how many each has. The words are short and of similar length.

        A word is a column here, so that a step runs along all words at once. What stands beside a part is its pair's
        rank and the place, in one number: the smallest is the leftmost pair of the lowest rank.
        """
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        width = int(sizes.max())
        raw, held = np.zeros((len(words), width + 1), dtype=np.uint8), np.arange(width + 1) < sizes[:, None]
        raw[held] = np.frombuffer(b"".join(words), dtype=np.uint8)
        raw, held = np.ascontiguousarray(raw.T), np.ascontiguousarray(held.T)
        place = np.arange(width + 1, dtype=np.int32)[:, None]
        parts = np.where(held, self.byte_id[raw], np.int32(-1))
        ranks = (np.where(held[1:], self.byte_rank[raw[:-1].astype(np.int32) << 8 | raw[1:]], np.int32(_NONE)) << _PLACES) + place[:-1]
        own = np.arange(len(words))
        ended: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(own):
            low = ranks.min(axis=0)
            done = low >= _NONE << _PLACES
            if done.any():
                columns = parts[:, done].T
                whole = columns >= 0
                ended.append((own[done], whole.sum(axis=1), columns[whole]))
                more = ~done
                parts, ranks, own, low = parts[:, more], ranks[:, more], own[more], low[more]
                if not len(own):
                    break
            at, new = low & (1 << _PLACES) - 1, self.merged[low >> _PLACES]
            every, kept = np.arange(len(own)), place[: len(ranks)] <= at
            parts = np.where(kept, parts[:-1], parts[1:])
            parts[at, every] = new
            last = len(ranks) - 1
            ranks = np.where(kept[:last], ranks[:last], ranks[1:] - np.int32(1))
            some = np.flatnonzero(at < last)
            here = at[some]
            ranks[here, some] = (self.rank(new[some], parts[here + 1, some]) << _PLACES) + here
            some = np.flatnonzero(at > 0)
            here = at[some] - 1
            ranks[here, some] = (self.rank(parts[here, some], new[some]) << _PLACES) + here
            if not last:
                ranks = np.full((1, len(own)), _NONE << _PLACES, dtype=np.int32)
        own, sizes, ids = (np.concatenate(c) for c in zip(*ended, strict=True))
        order = np.empty(len(own), dtype=np.int64)
        order[own] = np.arange(len(own))
        return _gather(ids, (np.cumsum(sizes) - sizes)[order], sizes[order]), sizes[order]


class _Memo:
    """Ids of words: a word's row says where its ids start and how many there are."""

    def __init__(self):
        self.row: dict[str, int] = {}
        self.n = self.used = 0
        self.starts, self.sizes = np.zeros(1 << 16, dtype=np.int64), np.zeros(1 << 16, dtype=np.int64)
        self.ids = np.zeros(1 << 18, dtype=np.uint32)

    @staticmethod
    def _room(x: np.ndarray, n: int) -> np.ndarray:
        return x if n <= len(x) else np.concatenate([x, np.zeros(max(n, 2 * len(x)) - len(x), dtype=x.dtype)])

    def add(self, words: list[str], ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Rows for words with their ids; long words have a row, but are not found again."""
        n, used = self.n + len(sizes), self.used + len(ids)
        self.starts, self.sizes, self.ids = self._room(self.starts, n), self._room(self.sizes, n), self._room(self.ids, used)
        self.ids[self.used : used] = ids
        self.sizes[self.n : n] = sizes
        self.starts[self.n : n] = self.used + np.cumsum(sizes) - sizes
        self.row.update((w, i) for i, w in enumerate(words, self.n) if len(w) <= _MEMO_LENGTH)
        rows = np.arange(self.n, n)
        self.n, self.used = n, used
        return rows

    def take(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of rows, one after another, and how many each has."""
        sizes = self.sizes[rows]
        return _gather(self.ids, self.starts[rows], sizes), sizes

    def reduced(self, words: list[str]) -> _Memo:
        """A memo of those of the words that it has."""
        out, held = _Memo(), [w for w in words if w in self.row]
        out.add(held, *self.take(np.array([self.row[w] for w in held], dtype=np.int64)))
        return out


class Encoder:
    """Encodes and decodes as the tokenizers library does with the same file, special tokens in texts included."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary, self.merger, self.memo = vocabulary, Merger(vocabulary), _Memo()

    @staticmethod
    def words(text: str) -> list[str]:
        """The pre-tokens of a text without special tokens."""
        return (_GENERAL if _NOT_LATIN.search(text) else _LATIN).findall(text)

    def _merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the words, one after another, and how many each has; short ones by many at once."""
        raw = [w.encode() for w in words]
        length = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
        order = np.argsort(length, kind="stable")
        ordered = length[order]
        short = int(np.searchsorted(ordered, LONG, side="right"))
        parts, a = [], 0
        while a < short:  # rows of one matrix are at most twice as long as its first
            b = min(a + _ROWS, short, int(np.searchsorted(ordered, max(8, 2 * ordered[a]), side="right")))
            parts.append(self.merger.merge([raw[i] for i in order[a:b].tolist()]))
            a = b
        for i in order[short:].tolist():
            ids = np.array(merge_long([self.vocabulary.byte_id[b] for b in raw[i]], self.vocabulary.rank), dtype=np.int64)
            parts.append((ids, np.array([len(ids)])))
        ids, sizes = (np.concatenate(c) for c in zip(*parts, strict=True))
        back = np.empty(len(order), dtype=np.int64)
        back[order] = np.arange(len(order))
        return _gather(ids, (np.cumsum(sizes) - sizes)[back], sizes[back]), sizes[back]

    def _rows(self, words: list[str]) -> np.ndarray:
        """Rows of the memo for distinct words. A memo that is full gives up what these don't use."""
        if self.memo.n > _MEMO or self.memo.used > _MEMO_IDS:
            self.memo = self.memo.reduced(words)
        rows = np.fromiter(map(self.memo.row.get, words, repeat(-1)), dtype=np.int64, count=len(words))
        missing = np.flatnonzero(rows < 0)
        if len(missing):
            new = [words[i] for i in missing.tolist()]
            rows[missing] = self.memo.add(new, *self._merge(new))
        return rows

    def _sizes(self, words: list[str]) -> np.ndarray:
        """The number of ids of each word."""
        if not words:
            return np.zeros(0, dtype=np.int64)
        coded = pa.array(words, pa.large_string()).dictionary_encode()
        rows = self._rows(_strings(coded.dictionary))  # may put another memo in place
        return self.memo.sizes[rows[coded.indices.to_numpy()]]

    def _split(self, pieces: list[str]) -> tuple[list[str], np.ndarray]:
        """The words of pieces that a space leads, and how many each piece has."""
        joined = " " + " ".join(pieces)  # no rule looks across the cuts
        found = self.words(joined)
        starts = np.cumsum(np.fromiter(map(len, found), dtype=np.int64, count=len(found)))
        ends = np.cumsum(np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces)) + 1)
        return found, np.diff(np.searchsorted(starts, ends), prepend=-1)

    def _pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct pieces, one after another, and how many each has.

        A piece that a space leads never starts with white space; what no space leads has a line feed before it here,
        and a special token a tab.
        """
        led = [i for i, p in enumerate(pieces) if p[0] not in "\n\t"]
        latin = np.ones(len(led), dtype=bool)
        if _NOT_LATIN.search("".join(pieces)):
            latin = np.array([p.isascii() or not _NOT_LATIN.search(p) for p in map(pieces.__getitem__, led)], dtype=bool)
        place, words, counts = [], [], []
        for some in (np.array(led, dtype=np.int64)[latin], np.array(led, dtype=np.int64)[~latin]):
            if len(some):
                found, n = self._split([pieces[i] for i in some.tolist()])
                words += found
                place.append(some)
                counts.append(n)
        rest = [i for i, p in enumerate(pieces) if p[0] == "\n"]
        own = [self.words(pieces[i][1:]) for i in rest]
        words += [w for x in own for w in x]
        special = [i for i, p in enumerate(pieces) if p[0] == "\t"]
        order = np.concatenate([*place, np.array(rest + special, dtype=np.int64)])
        n = np.concatenate([*counts, np.array([len(x) for x in own], dtype=np.int64)])
        if words:
            coded = pa.array(words, pa.large_string()).dictionary_encode()
            rows = self._rows(_strings(coded.dictionary))  # may put another memo in place
            ids, sizes = self.memo.take(rows[coded.indices.to_numpy()])
        else:
            ids, sizes = np.zeros(0, dtype=np.uint32), np.zeros(0, dtype=np.int64)
        ends = np.concatenate([[0], np.cumsum(sizes)])[np.cumsum(n)]
        if special:
            ids = np.concatenate([ids, np.array([self.vocabulary.special[pieces[i][1:]] for i in special], dtype=np.uint32)])
            ends = np.concatenate([ends, len(ids) - len(special) + np.arange(1, len(special) + 1)])
        sizes = np.diff(ends, prepend=0)
        back = np.empty(len(order), dtype=np.int64)
        back[order] = np.arange(len(order))
        return _gather(ids, (ends - sizes)[back], sizes[back]), sizes[back]

    def _cut(self, text: str) -> list[str]:
        """The pieces and special tokens of a text, marked as _pieces takes them."""
        found: list[str] = []
        at = 0
        for m in self.vocabulary.special_pattern.finditer(text) if self.vocabulary.special_pattern else ():
            head, *pieces = _CUT.split(text[at : m.start()])
            found += ["\n" + head, *pieces, "\t" + m.group()]
            at = m.end()
        head, *pieces = _CUT.split(text[at:])
        return [*found, "\n" + head, *pieces]

    def encode_flat(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of whole texts, one after another (unsigned 32-bit), and where each text's begin, with the last end."""
        special = list(self.vocabulary.special)
        kind = pa.string() if sum(map(len, texts)) < 1 << 28 else pa.large_string()  # of 2 GB at most
        plain = [not (any([t in text for t in special]) or _NOT_SINGLE.search(text)) for text in texts]
        split = pc.split_pattern(pa.array(["\n" + t for t, p in zip(texts, plain, strict=True) if p], kind), " ")
        values, counts = [split.values], [np.diff(split.offsets.to_numpy())]
        order = None
        if not all(plain):
            others = [self._cut(t) for t, p in zip(texts, plain, strict=True) if not p]
            values.append(pa.array([x for pieces in others for x in pieces], kind))
            counts.append(np.array([len(pieces) for pieces in others], dtype=np.int64))
            order = np.empty(len(texts), dtype=np.int64)
            order[np.concatenate([np.flatnonzero(plain), np.flatnonzero(~np.array(plain))])] = np.arange(len(texts))
        coded = pa.concat_arrays(values).dictionary_encode()
        del split, values
        ids, sizes = self._pieces(_strings(coded.dictionary)) if len(coded) else (np.zeros(0, dtype=np.uint32), np.zeros(0, dtype=np.int64))
        starts, of, ends = np.cumsum(sizes) - sizes, coded.indices.to_numpy(), np.concatenate([[0], np.cumsum(np.concatenate(counts))])
        if order is not None:
            of = _gather(of, ends[order], np.diff(ends)[order])
            ends = np.concatenate([[0], np.cumsum(np.diff(ends)[order])])
        sizes = sizes[of]
        return _gather(ids, starts[of], sizes), np.concatenate([[0], np.cumsum(sizes)])[ends]

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """The ids of whole texts, as little-endian unsigned 32-bit integers."""
        ids, until = self.encode_flat(texts)
        data = ids.astype("<u4", copy=False).tobytes()
        return [data[4 * a : 4 * b] for a, b in zip(until.tolist(), until[1:].tolist(), strict=False)]

    def encode(self, text: str) -> bytes:
        return self.encode_batch([text])[0]

    def pre_tokens(self, text: str) -> tuple[list[str], list[int]]:
        """The pre-tokens and special tokens of a text, and the number of tokens of each."""
        found, special, at = [], [], 0
        for m in self.vocabulary.special_pattern.finditer(text) if self.vocabulary.special_pattern else ():
            found += [*self.words(text[at : m.start()]), m.group()]
            special.append(len(found) - 1)
            at = m.end()
        found += self.words(text[at:])
        sizes = self._sizes(found)
        sizes[special] = 1
        return found, sizes.tolist()

    def decode(self, ids: bytes) -> str:
        """The text of ids: their bytes, read as UTF-8 with replacement characters where they are none."""
        numbers = array("I")
        numbers.frombytes(ids)
        return b"".join(map(self.vocabulary.bytes_of.__getitem__, numbers)).decode("utf-8", "replace")


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """One encoder per file and Python worker, kept between tasks with its memo, which is bounded."""
    return Encoder(Vocabulary(path))


def coding_slabs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slabs for the encoder: the more text at once, the fewer distinct pieces there are for it."""
    return slabs(batches, rows=8192, chars=5_000_000)


def encode_documents(docs, path: str):
    """doc_id, n_tokens, ids (binary: little-endian unsigned 32-bit integers) and decoded for every row.

    A null or empty text has no ids and decodes to an empty text; a very long one is encoded whole, in a slab of its
    own. Repeated rows are encoded one by one; columns of other names are not read; an empty table gives an empty
    result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in coding_slabs(batches):
            ids = own.encode_batch([t or "" for t in batch.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array([own.decode(x) for x in ids], pa.string())],
                ["doc_id", "n_tokens", "ids", "decoded"],
            )

    return map_arrow(docs.select("doc_id", "text"), run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids binary, decoded string")
