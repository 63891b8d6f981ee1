"""What the operators of this subpackage share: table access, Arrow mapping, sampling, checkpoints, components."""

from __future__ import annotations

import ctypes
import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Rows and text characters that one slab of a Python worker holds at once; a longer text is a slab of its own.
SLAB_ROWS, SLAB_CHARS = 4096, 4_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def held_out(doc_id: str = "doc_id"):
    """True for the rows that no model may learn from: crc32 of the id as text, mod 4, is 2."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2


def tidy() -> None:
    """Gives what a task has freed back to the system: Python workers live on, and their tasks differ."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow; Spark bounds its batches by bytes (spark.sql.execution.arrow.maxBytesPerBatch)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from fn(batches)
        finally:
            tidy()

    return df.mapInArrow(run, schema)


def tidied(fn: Callable) -> Callable:
    """A function for applyInArrow that tidies up after itself."""

    def two(table: pa.Table, other: pa.Table) -> pa.Table:
        try:
            return fn(table, other)
        finally:
            tidy()

    def one(table: pa.Table) -> pa.Table:
        try:
            return fn(table)
        finally:
            tidy()

    return one if fn.__code__.co_argcount == 1 else two


def slabs(batches: Iterator[pa.RecordBatch], column: str = "text", rows: int = SLAB_ROWS, chars: int = SLAB_CHARS) -> Iterator[pa.RecordBatch]:
    """Cuts record batches so that the texts of each piece stay within a bound, one row at least."""
    import pyarrow.compute as pc

    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        start, held = 0, 0
        for i, n in enumerate(sizes.tolist()):
            if i > start and (held + n > chars or i - start >= rows):
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        if batch.num_rows > start:
            yield batch.slice(start)


def no_clash(keep: Iterable[str], outputs: Iterable[str]) -> None:
    """Columns to keep must not have the names of outputs (doc_id may be among them: it is kept anyway)."""
    if found := (set(keep) & set(outputs)) - {"doc_id"}:
        raise ValueError(f"columns to keep have names of outputs: {sorted(found)}")


def hash_sample(df: DataFrame, keys: tuple[str, ...], rows: int) -> DataFrame:
    """About `rows` rows (all, if there are no more), chosen by a hash of the keys: the same rows on every run.

    The keys should tell rows apart: those that are alike in all of them come together or not at all.
    """
    n = df.count()
    if n <= rows:
        return df
    return df.filter(F.pmod(F.xxhash64(F.lit("sample"), *keys), F.lit(1 << 30)) < int((1 << 30) * rows / n))


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names; a temporary one only where none is set, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            return held.get()
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set; it must be a folder that the driver and all executors share")
        import tempfile

        found = tempfile.mkdtemp(prefix="checkpoints-")
    return found


_DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame) -> DataFrame:
    """An eager checkpoint in the shared folder: cuts lineage, and is read back by every executor.

    The shuffle files of its plan go once it is written; else they stay until the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    sc, before = spark.sparkContext, spark.conf.get(_DROP_SHUFFLES, "false")
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(checkpoint_dir(spark))
    spark.conf.set(_DROP_SHUFFLES, "true")
    try:
        return df.select("*").checkpoint(eager=True)  # the setting holds for frames that are made under it
    finally:
        spark.conf.set(_DROP_SHUFFLES, before)


def dealt_anew(df: DataFrame, key: str) -> DataFrame:
    """The rows by a hash of the hash of their key. A join by the key then has an exchange of its own on this side, as
    Spark's splitting of skewed partitions needs: it leaves alone what is joined straight to an aggregate."""
    return df.repartition(F.xxhash64(F.xxhash64(key)))


def star_round(e: DataFrame) -> DataFrame:
    """A large-star and a small-star step over links u > v: two pre-aggregated minima, and two joins back to them."""
    both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = dealt_anew(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "u")
    large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
    down = dealt_anew(large.groupBy("u").agg(F.min("v").alias("m")), "u")
    small = large.join(down, "u")
    return small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()


def _roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, root) of all links of a table, in one task."""
    above, kind = {}, None

    def top(x):
        way = []
        while (up := above.get(x, x)) != x:
            way.append(x)
            x = up
        above.update((w, x) for w in way)
        return x

    for batch in batches:
        kind = batch.column("u").type
        for u, v in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist(), strict=True):
            low, high = sorted((top(u), top(v)))
            above[high] = low
    if nodes := [x for x in above if top(x) != x]:
        yield pa.RecordBatch.from_arrays([pa.array(nodes, kind), pa.array([top(x) for x in nodes], kind)], ["node", "root"])


def connected_components(edges: DataFrame, rounds: int = 64, at_once: int = 0) -> DataFrame:
    """(u, v) links to (node, root): the smallest node that each linked node reaches, for all but those smallest ones.

    Up to `at_once` links (of numbers or binaries) are joined in one task, more of them by rounds over all tasks.

    Alternating large-star and small-star rounds. The star of a large component is never gathered in one task: its
    minimum is aggregated before the shuffle, and the joins back are split where they are skewed. The edges never grow
    in number. Null nodes and nodes without a link are not in the result; without links it is empty.
    """
    e = cut(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct())

    def state() -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    seen = state()
    if 0 < seen[0] <= at_once:
        kind = e.schema["u"].dataType.simpleString()
        return cut(map_arrow(e.coalesce(1), _roots, f"node {kind}, root {kind}"))
    for _ in range(rounds if seen[0] else 0):
        e = cut(star_round(e))
        if (now := state()) == seen:
            break
        seen = now
    else:
        if seen[0]:
            raise RuntimeError("the components did not settle")
    return e.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))


__all__ = ["WORD", "StorageLevel", "checkpoint_dir", "connected_components", "cut", "dealt_anew", "hash_sample", "held_out", "map_arrow", "no_clash", "slabs", "star_round", "table", "tidied", "tidy"]
