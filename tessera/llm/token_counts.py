"""Token counts under edits: a segment tree over the pre-tokens of a document.

The leaves are the pre-tokens, each with its characters and tokens; inner nodes hold the sums. An edit descends to the
leaves it touches and takes the leaves on either side as context until the region begins and ends at a cut of the
encoder (a space before a character that is no white space; no pre-token spans a cut and no rule looks across one).
That region alone is encoded again, its pre-tokens take the leaves' places, and the sums are updated on the way up. Free
leaves left behind serve later edits; where a region needs more leaves than it has, the tree is laid out anew with
spare ones, from the counts it has.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .bpe import Encoder, coding_slabs, encoder
from .common import map_arrow

_STARTS = re.compile(r" \S")
#: A tree that is laid out anew has one spare leaf for so many.
_SPARE = 4

#: What the scrubbing rules replace: mail addresses, card- and telephone-like numbers, long hexadecimal secrets.
SCRUB: tuple[tuple[str, str], ...] = (
    (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "[email]"),
    (r"\+?\d(?:[ .-]?\d){8,18}", "[number]"),
    (r"\b(?=[A-Za-z_]*\d)[A-Za-z0-9_]{24,}\b", "[secret]"),
)


class TokenTree:
    """Tokens of one text under edits. `encoded` counts the characters given to the encoder so far."""

    def __init__(self, text: str, own: Encoder):
        self.own, self.encoded = own, len(text)
        self._lay(*own.pre_tokens(text))

    def _lay(self, leaf: list[str], tokens: list[int]) -> None:
        self.leaf = leaf
        self.levels: list[tuple[list[int], list[int]]] = [(list(map(len, leaf)) or [0], tokens or [0])]  # characters, tokens
        while len(self.levels[-1][0]) > 1:
            self.levels.append(tuple([a + b for a, b in zip(x[::2], x[1::2], strict=False)] + x[len(x) & ~1 :] for x in self.levels[-1]))

    @property
    def n_chars(self) -> int:
        return self.levels[-1][0][0]

    @property
    def n_tokens(self) -> int:
        return self.levels[-1][1][0]

    @property
    def text(self) -> str:
        return "".join(self.leaf)

    def _find(self, place: int) -> tuple[int, int]:
        """The leaf that holds the character at `place` (the last one with characters, for the end), and where it starts."""
        place = min(place, max(0, self.n_chars - 1))
        i, start = 0, 0
        for chars, _ in reversed(self.levels[:-1]):
            i *= 2
            if place - start >= chars[i] and i + 1 < len(chars):
                start += chars[i]
                i += 1
        return i, start

    def _set(self, i: int, word: str, tokens: int) -> None:
        chars, more = len(word) - len(self.leaf[i]), tokens - self.levels[0][1][i]
        self.leaf[i] = word
        for level in self.levels:
            level[0][i] += chars
            level[1][i] += more
            i //= 2

    def edit(self, start: int, end: int, replacement: str) -> None:
        """Replaces the characters start:end of the text as it is now."""
        start, end = max(0, min(start, self.n_chars)), max(start, min(end, self.n_chars))
        if not self.leaf:
            first, last, region = 0, -1, replacement
        else:
            first, at = self._find(start)
            last, last_at = (first, at) if end <= start else self._find(end - 1)
            region = self.leaf[first][: start - at] + replacement + self.leaf[last][end - last_at :]
        while first > 0 and not (_STARTS.match(self.leaf[first]) and _STARTS.match(region)):  # context before, back to a cut that was and is one
            first -= 1
            region = self.leaf[first] + region
        while last + 1 < len(self.leaf) and not _STARTS.match(self.leaf[last + 1]):  # ... and after, up to one
            last += 1
            region += self.leaf[last]
        self.encoded += len(region)
        words, tokens = self.own.pre_tokens(region)
        if len(words) > last + 1 - first:
            leaf, counts = self.leaf, self.levels[0][1]
            words = leaf[:first] + words + leaf[last + 1 :]
            tokens = counts[:first] + tokens + (counts[last + 1 :] if leaf else [])
            leaves, sizes = [], []
            for a in range(0, len(words), _SPARE):
                leaves += [*words[a : a + _SPARE], ""]
                sizes += [*tokens[a : a + _SPARE], 0]
            self._lay(leaves, sizes)
            return
        for i in range(first, last + 1):
            j = i - first
            word, n = (words[j], tokens[j]) if j < len(words) else ("", 0)
            if word != self.leaf[i] or n != self.levels[0][1][i]:
                self._set(i, word, n)


def scrub_edits(text: str, rules: tuple[tuple[str, str], ...] = SCRUB) -> list[tuple[int, int, str]]:
    """Edits (start, end, replacement) in order, none overlapping; where rules overlap the leftmost match stays."""
    found = sorted((m.start(), m.end(), put) for pattern, put in rules for m in re.finditer(pattern, text))
    ends = [0, *accumulate((e for _, e, _ in found), max)]
    return [x for x, end in zip(found, ends, strict=False) if x[0] >= end]


def count_tokens(docs: DataFrame, path: str, rules: tuple[tuple[str, str], ...] = SCRUB) -> DataFrame:
    """doc_id, n_tokens, n_edits, n_tokens_edited, n_chars_again, edited (the text after the edits) for every row.

    A null or empty text has no tokens and no edits. A text without edits keeps its count without a tree. Repeated
    rows are counted one by one, a very long text whole; columns of other names are not read; an empty table gives an
    empty result. Where rules match at one place, the shorter match stays.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in coding_slabs(batches):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            before = np.diff(own.encode_flat(texts)[1]).tolist()
            edits, after, again, edited = [], [], [], []
            for text, n in zip(texts, before, strict=True):
                todo = scrub_edits(text, rules)
                edits.append(len(todo))
                if not todo:
                    after.append(n)
                    again.append(0)
                    edited.append(text)
                    continue
                tree = TokenTree(text, own)
                for start, end, put in reversed(todo):
                    tree.edit(start, end, put)
                after.append(tree.n_tokens)
                again.append(tree.encoded - len(text))
                edited.append(tree.text)
            columns = [pa.array(c, pa.int64()) for c in (before, edits, after, again)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns, pa.array(edited, pa.string())], ["doc_id", "n_tokens", "n_edits", "n_tokens_edited", "n_chars_again", "edited"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_arrow(docs.select("doc_id", "text"), run, f"doc_id {kind}, n_tokens long, n_edits long, n_tokens_edited long, n_chars_again long, edited string")
