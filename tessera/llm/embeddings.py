"""Embedding near-duplicates by cover-tree dual traversal: exact threshold pairs within a label.

Unit vectors are within cosine t of each other if their distance is at most r = sqrt(2 - 2 t). Equal vectors are one
class first. The top of the tree is shared by all tasks: centres from a bounded sample, every class with the nearest
centre of its label; a cell's covering radius is the largest distance in it. Cells are dealt into blocks of bounded
size by a hash (larger ones for larger labels), and two blocks meet in a task only if their cells' centres are no farther apart than both radii and r,
with those of their vectors that are near enough to the other cell. In a task a cover tree is built over either block
(each level's nodes cover their points within half the radius of the level above) and the two are traversed together:
node pairs farther apart than r and both covering radii are pruned, what is left of single points is compared exactly.
A task sends the number of links of each vector and its component among those it saw, never the pairs themselves.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, cut, dealt_anew, hash_sample, map_arrow, tidied

_LEAF, _TRIES, _ROWS = 32, 64, 512
_SLACK = 1e-7


def unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


class CoverTree:
    """Nodes over unit vectors. A node's children are nodes, or points (nodes of radius 0 without children)."""

    def __init__(self, x: np.ndarray):
        self.x = x
        self.centre: list[np.ndarray] = []  # of each node: its children's centres (rows of x)
        self.radius: list[np.ndarray] = []  # ... their covering radii
        self.child: list[np.ndarray] = []  # ... their nodes, or -1 for a point
        if len(x):
            rows = np.arange(len(x))
            self._build(rows, self._far(0, rows))

    def _far(self, centre: int, rows: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (self.x[rows] @ self.x[centre])))

    def _node(self) -> int:
        self.centre.append(np.zeros(0, dtype=np.int64))
        self.radius.append(np.zeros(0))
        self.child.append(np.zeros(0, dtype=np.int64))
        return len(self.centre) - 1

    def _build(self, rows: np.ndarray, far: np.ndarray) -> None:
        stack = [(self._node(), rows, far)]
        while stack:
            node, rows, far = stack.pop()
            if len(rows) <= _LEAF or not far.max() > 0:
                self.centre[node], self.radius[node], self.child[node] = rows, np.zeros(len(rows)), np.full(len(rows), -1)
                continue
            half, centres, radii, children = far.max() / 2, [], [], []
            covered, pick = 0, int(far.argmin())
            while len(rows):
                if len(centres) >= _TRIES and covered < 2 * len(centres):  # hardly anything shares a ball of this size
                    centres += rows.tolist()
                    radii += [0.0] * len(rows)
                    children += [-1] * len(rows)
                    break
                own = self._far(rows[pick], rows)
                near = own <= half
                near[pick] = True
                inside, apart = rows[near], own[near]
                covered += len(inside)
                centres.append(int(rows[pick]))
                radii.append(float(apart.max()) if len(inside) > 1 else 0.0)
                children.append(self._node() if len(inside) > 1 else -1)
                if len(inside) > 1:
                    stack.append((children[-1], inside, apart))
                rows, pick = rows[~near], 0
            self.centre[node], self.radius[node], self.child[node] = np.array(centres), np.array(radii), np.array(children)


def dual_traversal(a: CoverTree, b: CoverTree | None, r: float, take: Callable[[np.ndarray, np.ndarray], None]) -> None:
    """Gives `take` the rows (i of a, j of b) of all pairs of points that may be within r; with b None each pair i < j of a once."""
    own = b is None
    b = a if b is None else b
    if not len(a.x) or not len(b.x):
        return
    stack: list[tuple[int, int]] = [(0, 0)]
    while stack:
        p, q = stack.pop()
        for s in range(0, len(a.centre[p]), _ROWS):
            rows, radius, child = a.centre[p][s : s + _ROWS], a.radius[p][s : s + _ROWS], a.child[p][s : s + _ROWS]
            apart = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (a.x[rows] @ b.x[b.centre[q]].T)))
            near = apart <= r + _SLACK + radius[:, None] + b.radius[q][None, :]
            if own and p == q:
                near &= np.arange(s, s + len(rows))[:, None] <= np.arange(len(b.centre[q]))[None, :]
            i, j = np.nonzero(near)
            ci, cj = child[i], b.child[q][j]
            points = (ci < 0) & (cj < 0)
            left, right = rows[i[points]], b.centre[q][j[points]]
            if own:
                differ = left != right
                left, right = left[differ], right[differ]
            if len(left):
                take(left, right)
            for k in np.flatnonzero(~points).tolist():
                x, y = int(ci[k]), int(cj[k])
                if x >= 0 and y >= 0:
                    stack.append((x, y))
                elif x >= 0:
                    _against(a, x, b, int(b.centre[q][j[k]]), r, take, False)
                else:
                    _against(b, y, a, int(rows[i[k]]), r, take, True)


def _against(tree: CoverTree, node: int, other: CoverTree, row: int, r: float, take: Callable[[np.ndarray, np.ndarray], None], swap: bool) -> None:
    """A point of the other tree against what is below a node."""
    stack = [node]
    while stack:
        p = stack.pop()
        apart = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (tree.x[tree.centre[p]] @ other.x[row])))
        near = apart <= r + _SLACK + tree.radius[p]
        stack += tree.child[p][near & (tree.child[p] >= 0)].tolist()
        found = tree.centre[p][near & (tree.child[p] < 0)]
        if len(found):
            same = np.full(len(found), row)
            take(*((same, found) if swap else (found, same)))


class _Links:
    """Number of links of each vector, weighted by copies, and components, over the pairs that pass the exact test."""

    def __init__(self, a: np.ndarray, b: np.ndarray, copies: np.ndarray, at: int, threshold: float):
        self.a, self.b, self.at, self.threshold, self.copies = a, b, at, threshold, copies
        self.na, self.nb = np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1)
        self.n = np.zeros(len(copies), dtype=np.int64)
        self.root = np.arange(len(copies))

    def __call__(self, i: np.ndarray, j: np.ndarray) -> None:
        for s in range(0, len(i), 1 << 17):
            x, y = i[s : s + (1 << 17)], j[s : s + (1 << 17)]
            linked = np.einsum("nd,nd->n", self.a[x], self.b[y]) / (self.na[x] * self.nb[y]) >= self.threshold
            u, v = x[linked], y[linked] + self.at
            np.add.at(self.n, u, self.copies[v])
            np.add.at(self.n, v, self.copies[u])
            while True:
                low = np.minimum(self.root[u], self.root[v])
                if (low == self.root[u]).all() and (low == self.root[v]).all():
                    break
                for side in (u, v):
                    np.minimum.at(self.root, self.root[side], low)
                    np.minimum.at(self.root, side, low)
                self.root = self.root[self.root]


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _meet(threshold: float):
    r = float(np.sqrt(2.0 - 2.0 * threshold))

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        side = table.column("side").to_numpy()
        order = np.argsort(side, kind="stable")
        table, at = table.take(pa.array(order)), int((side == 0).sum())
        x, ids, copies = _matrix(table.column("embedding")), table.column("vec_id").to_numpy(), table.column("copies").to_numpy()
        if table.column("block_a")[0].as_py() == table.column("block_b")[0].as_py():
            found = _Links(x, x, copies, 0, threshold)
            dual_traversal(CoverTree(unit(x)), None, r, found)
        else:
            found = _Links(x[:at], x[at:], copies, at, threshold)
            dual_traversal(CoverTree(unit(x[:at])), CoverTree(unit(x[at:])), r, found)
        has = found.n > 0
        low = np.full(len(ids), np.iinfo(np.int64).max)
        np.minimum.at(low, found.root, ids)
        return pa.Table.from_arrays([pa.array(ids[has]), pa.array(found.n[has]), pa.array(low[found.root][has])], ["vec_id", "n", "other"])

    return run


#: Rows and bytes of a block at most, and how many blocks a large label is cut into before they grow.
_BLOCK_ROWS, _BLOCK_BYTES, _BLOCKS = 32_768, 32 << 20, 64


def block_size(n: int, width: int, least: int) -> int:
    """Rows of a block for a label of n vectors: a vector is sent to every block that it may meet, so the blocks of
    large labels are larger, as far as the memory of a task allows."""
    return max(1, min(max(least, min(n // _BLOCKS, _BLOCK_ROWS)), _BLOCK_BYTES // (8 * max(1, width))))


def near_duplicates(vectors: DataFrame, threshold: float = 0.98, max_centres: int = 256, block_rows: int = 4096) -> DataFrame:
    """vec_id, n_links, component_id, kept and copies for every row of (vec_id, embedding, label).

    Null, empty and zero vectors, those with null or non-finite components, and rows without a label link with
    nothing; vectors of different length don't either. Equal vectors of a label are linked with each other. vec_id is
    taken to be a key; a null one links with nothing. Rows that repeat a vec_id are vectors of their own. Columns of
    other names are not read; an empty table gives an empty result. `max_centres` bounds the sample at the top of the
    tree, `block_rows` is about what one task holds of either side, for all but large labels (see block_size).
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), F.col("label").cast("long").alias("label"))
    large = F.lit(float("inf"))
    fine = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < large)) & F.exists("embedding", lambda v: v != 0)
    usable = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & F.coalesce(fine, F.lit(False))
    keyed = rows.filter(usable).withColumn("of", F.col("label") * 65536 + F.size("embedding"))  # compared within a label and a length
    classes = cut(keyed.groupBy("of", "embedding").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("copies")))

    centres: dict[int, list] = {}
    wanted = min(max_centres, 2 * max(1, -(-classes.count() // block_rows)))  # more cells than blocks would only send more
    for row in hash_sample(classes.select("vec_id", "of", "embedding"), ("vec_id",), wanted).orderBy("vec_id").limit(2 * max_centres).collect():
        centres.setdefault(row["of"], []).append(row["embedding"])
    shared = spark.sparkContext.broadcast({k: unit(np.array(v, dtype=np.float64)) for k, v in centres.items()})
    kind = "vec_id long, of long, copies long, embedding array<double>"

    def home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of = batch.column("of").to_numpy()
            cell, far = np.zeros(len(of), dtype=np.int64), np.full(len(of), 2.0)
            for key in np.unique(of).tolist():
                if key in shared.value:
                    own = np.flatnonzero(of == key)
                    x = unit(_matrix(batch.column("embedding").take(pa.array(own))))
                    apart = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (x @ shared.value[key].T)))
                    cell[own], far[own] = apart.argmin(axis=1), apart.min(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(far)], [*batch.schema.names, "cell", "far"])

    homed = cut(map_arrow(classes.select("vec_id", "of", "copies", "embedding"), home, f"{kind}, cell long, far double"))
    cells = homed.groupBy("of", "cell").agg(F.count("*").alias("n"), F.max("far").alias("radius"))
    bounded = [c for c in cells.join(F.broadcast(spark.createDataFrame([(int(k),) for k in centres] or [(0,)], "of long")), "of").collect()]  # a row per centre at most
    total: dict[int, int] = {}
    for c in bounded:
        total[c["of"]] = total.get(c["of"], 0) + c["n"]
    known: dict[int, dict[int, tuple[int, float]]] = {}
    for c in bounded:
        rows_of = block_size(total[c["of"]], c["of"] % 65536, block_rows)
        known.setdefault(c["of"], {})[c["cell"]] = (max(1, -(-c["n"] // rows_of)), c["radius"])
    plan = spark.sparkContext.broadcast(known)
    # a label that is not in the sample is one cell without a centre; it is as rare as the sample is small, but has blocks too
    many = cells.filter(F.col("n") > block_rows).filter(~F.col("of").isin(list(centres) or [0])).select("of", F.ceil(F.col("n") / block_rows).alias("parts"))
    homed = homed.join(dealt_anew(many, "of"), "of", "left").select("vec_id", "of", "copies", "embedding", "cell", "far", F.coalesce("parts", F.lit(1)).alias("parts"))
    r = float(np.sqrt(2.0 - 2.0 * threshold)) + _SLACK

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Every class once for each pair of blocks in which it may have a partner; a block is (cell, part)."""
        known = plan.value
        for batch in batches:
            of, cell, ids = (batch.column(c).to_numpy() for c in ("of", "cell", "vec_id"))
            mixed = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20)
            row, a, b, side = [], [], [], []

            def add(rows: np.ndarray, own: np.ndarray, block: int) -> None:
                row.append(rows)
                a.append(np.minimum(own, block))
                b.append(np.maximum(own, block))
                side.append((own > block).astype(np.int32))

            for key in np.unique(of).tolist():
                mine = np.flatnonzero(of == key)
                if key not in known:
                    parts = int(batch.column("parts")[int(mine[0])].as_py())
                    own = (mixed[mine] % np.uint64(parts)).astype(np.int64)
                    for p in range(parts):
                        add(mine, own, p)
                    continue
                table = known[key]
                points = shared.value[key]
                x = unit(_matrix(batch.column("embedding").take(pa.array(mine))))
                apart = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (x @ points.T)))
                between = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (points @ points.T)))
                home_of = cell[mine]
                parts_of = np.array([table[c][0] if c in table else 1 for c in range(len(points))])
                own = home_of * (1 << 20) + (mixed[mine] % parts_of[home_of].astype(np.uint64)).astype(np.int64)
                nearest = apart[np.arange(len(mine)), home_of]
                radius_of = np.array([table[c][1] if c in table else 0.0 for c in range(len(points))])
                for c, (parts, radius) in table.items():
                    meets = (home_of == c) | ((apart[:, c] <= radius + r) & (apart[:, c] <= nearest + 2 * r) & (between[home_of, c] <= radius_of[home_of] + radius + r))
                    for p in range(parts):
                        add(mine[meets], own[meets], c * (1 << 20) + p)
            if row:
                rows = pa.array(np.concatenate(row))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("of").take(rows), pa.array(np.concatenate(a)), pa.array(np.concatenate(b)), pa.array(np.concatenate(side)), *(batch.column(c).take(rows) for c in ("vec_id", "copies", "embedding"))],
                    ["of", "block_a", "block_b", "side", "vec_id", "copies", "embedding"],
                )

    dealt = map_arrow(homed, spread, "of long, block_a long, block_b long, side int, vec_id long, copies long, embedding array<double>")
    met = cut(dealt.groupBy("of", "block_a", "block_b").applyInArrow(tidied(_meet(threshold)), "vec_id long, n long, other long"))
    roots = connected_components(met.select(F.col("vec_id").alias("u"), F.col("other").alias("v")))
    counted = met.groupBy("vec_id").agg(F.sum("n").alias("n"))
    named = (
        classes.join(counted, "vec_id", "left")
        .join(roots.withColumnRenamed("node", "vec_id"), "vec_id", "left")
        .select("of", "embedding", "copies", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "vec_id").alias("component_id"))
    )
    linked = keyed.join(named, ["of", "embedding"]).select("vec_id", "n_links", "component_id", "copies")
    rest = rows.filter(~usable).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(1).cast("long").alias("copies"))
    return linked.union(rest).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
