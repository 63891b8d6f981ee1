"""Quality rules: base counts of a text, and compression bands.

A whole text and each of its fixed chunks are compressed with zstandard; compressed bytes / bytes must lie within
limits that depend on the length, as short texts compress less. Below the band a text is repetitive, above it
incompressible. A text fails if the whole lies outside its band, or if chunks outside theirs make up more than
`chunk_share` of the bytes in chunks.

The default limits lie just outside what prose that passes the base rule has (about its quantiles 0.001 and 0.999). Base64
is above them from 256 bytes on, random words from 2 kB and hexadecimal digits from 4 kB; shorter ones have ratios that
prose has as well.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from .common import WORD, map_arrow, no_clash, slabs

SYMBOLS = "#*$%&|<>"
_MARKED = re.compile("[#*$%&|<>]")
WINDOW = 5


@dataclass(frozen=True)
class Bands:
    """whole: (bytes below which it holds, lowest ratio, highest ratio), in order; chunk: the same for a chunk."""

    whole: tuple[tuple[float, float, float], ...] = (
        (64, 0.0, 9.0),
        (128, 0.60, 1.16),
        (256, 0.45, 0.96),
        (512, 0.45, 0.79),
        (1024, 0.42, 0.72),
        (2048, 0.36, 0.64),
        (4096, 0.34, 0.59),
        (8192, 0.32, 0.512),
        (32768, 0.31, 0.495),
        (float("inf"), 0.30, 0.48),
    )
    chunk: tuple[tuple[float, float, float], ...] = ((1024, 0.42, 0.71), (float("inf"), 0.36, 0.62))
    chunk_bytes: int = 2048
    least_chunk: int = 512
    chunk_share: float = 0.25
    level: int = 3


@dataclass
class _Judge:
    bands: Bands
    press: zstandard.ZstdCompressor = field(init=False)

    def __post_init__(self) -> None:
        self.press = zstandard.ZstdCompressor(level=self.bands.level)

    @staticmethod
    def side(limits: tuple[tuple[float, float, float], ...], n: int, ratio: float) -> int:
        low, high = next((a, b) for below, a, b in limits if n < below)
        return -1 if ratio < low else 1 if ratio > high else 0

    def verdict(self, raw: bytes) -> tuple[float, float, str]:
        """The ratio of the whole, the share of bytes in bad chunks, and ok, repetitive or incompressible."""
        n = len(raw)
        if not n:
            return 0.0, 0.0, "ok"
        ratio = len(self.press.compress(raw)) / n
        if side := self.side(self.bands.whole, n, ratio):
            return ratio, 0.0, "repetitive" if side < 0 else "incompressible"
        seen, bad = 0, {-1: 0, 1: 0}
        if n > self.bands.chunk_bytes:
            view = memoryview(raw)
            for a in range(0, n, self.bands.chunk_bytes):
                piece = view[a : a + self.bands.chunk_bytes]
                if len(piece) >= self.bands.least_chunk:
                    seen += len(piece)
                    if side := self.side(self.bands.chunk, len(piece), len(self.press.compress(piece)) / len(piece)):
                        bad[side] += len(piece)
        share = (bad[-1] + bad[1]) / seen if seen else 0.0
        if share > self.bands.chunk_share:
            return ratio, share, "repetitive" if bad[-1] >= bad[1] else "incompressible"
        return ratio, share, "ok"


def repeated_words(words: list[str]) -> int:
    """Words that lie in a window of WINDOW words found twice or more in the list."""
    if len(words) <= WINDOW:
        return 0
    windows = list(zip(*(words[i:] for i in range(WINDOW)), strict=False))
    if len(set(windows)) == len(windows):
        return 0
    n, end, total = Counter(windows), 0, 0
    for i, w in enumerate(windows):
        if n[w] > 1:
            total += i + WINDOW - max(i, end)
            end = i + WINDOW
    return total


def repeated_lines(text: str) -> int:
    if "\n" not in text:
        return 0
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(lines) - len(set(lines))


def measure(docs: DataFrame, bands: Bands = Bands(), min_words: int = 10, max_repeat_percent: int = 20, keep: tuple[str, ...] = ()) -> DataFrame:  # noqa: B008
    """doc_id, the columns in `keep`, the base counts, base_failed, the compression figures, verdict and kept.

    A null text and an empty one have no words: they fail the base rule. A very long text is judged whole, chunk by
    chunk; a ratio on a limit is within it. Repeated rows are judged one by one; columns of other names are not read,
    and those in `keep` may have any name but that of an output. An empty table gives an empty result.
    """
    names = list(dict.fromkeys(["doc_id", "text", *keep]))
    out = [c for c in names if c != "text" or "text" in keep]
    found = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "ratio", "bad_chunk_share", "verdict"]
    no_clash(keep, ("doc_id", *found))
    kinds = [*["long"] * 5, "boolean", "boolean", "double", "double", "string"]
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in out), *(f"{a} {b}" for a, b in zip(found, kinds, strict=True))])
    types = {"long": pa.int64(), "boolean": pa.bool_(), "double": pa.float64(), "string": pa.string()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = _Judge(bands)
        for batch in slabs(batches):
            rows = []
            for text in batch.column("text").to_pylist():
                text = text or ""
                words = WORD.findall(text)
                n = len(words)
                again = repeated_words(words)
                failed = n < min_words or 100 * again > max_repeat_percent * n
                ratio, share, verdict = judge.verdict(text.encode("utf-8", "surrogatepass"))
                symbols = len(_MARKED.findall(text)) if _MARKED.search(text) else 0
                rows.append((n, sum(map(len, words)), symbols, repeated_lines(text), again, failed, not failed and verdict == "ok", ratio, share, verdict))
            columns = [pa.array(c, types[k]) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in out), *columns], [*out, *found])

    return map_arrow(docs.select(*names), run, schema)
