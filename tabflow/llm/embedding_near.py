"""Embedding near-duplicates by a subspace pigeonhole join.

Unit vectors with cosine c are at squared distance 2 - 2c. Vectors are rotated (random signs and a
Hadamard transform, twice), so that a distance is spread over all coordinates, and cut into blocks
of a few dimensions. Two vectors within the whole budget are, in one block at least, within the
budget's share of that block: each block is range-joined under its share, and what any block
finds is verified by the cosine of the given vectors in double precision. Nothing is approximate.

Range join of a block: a kd-tree fitted on a sample of at most ``SAMPLE`` vectors cuts the block's
space into cells (where the cuts lie changes the work, never the result); a cell of many vectors
is dealt into pieces of about ``PIECE`` rows, and every pair of pieces whose cells are near enough
is a task of its own, however many vectors share a place. A task sorts its rows into leaves and
compares only leaves whose boxes are near enough. A pair counts in the first block whose share it
keeps, so the union over the blocks counts it once. What leaves a task is a number of links and a
star for each row, never pairs.

Equal vectors are one row with a multiplicity from the start. Vectors of different lengths are
never compared. Components come from the stars (``components``).

Defined cases: null, empty and zero vectors, and vectors with a null, NaN or infinite component,
have no link and are components of their own; equal vectors are linked to each other; repeated
rows are vectors of their own with one id; a null id is never the component's id unless all its
ids are null, and such a row is not kept; an empty table has no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabflow.llm.common import table
from tabflow.llm.components import star_labels
from tabflow.operators.lookup import BROADCAST_BYTES, lookup_join
from tabflow.scratch import materialize

COSINE = 0.9
# Least dimensions of a block; vectors of many dimensions have MOST_BLOCKS larger ones.
BLOCK_DIMS = 8
MOST_BLOCKS = 8
SAMPLE = 8192
PIECE = 32_768
MOST_DEPTH = 10
LEAF = 128
SEED = 17
# Rounding: of distances of rotated vectors, and of the matrix products that come first.
SLACK, PRODUCT_SLACK = 1e-5, 1e-4
# Columns of one matrix product, pairs verified together, and links held before they are reduced to stars.
WIDE = 4096
STRIP = 1 << 16
HELD = 1 << 19


# ---------------------------------------------------------------- rotation and blocks

def padded(d: int) -> int:
    return 1 << max(0, (d - 1).bit_length())


@lru_cache(maxsize=16)
def blocks_of(d: int) -> tuple[tuple[int, int], ...]:
    """(first, end) coordinates of the blocks of rotated vectors of length ``d``."""
    size = padded(d)
    width = min(size, max(BLOCK_DIMS, size // MOST_BLOCKS))
    return tuple((k, k + width) for k in range(0, size, width))


def units(vectors: np.ndarray) -> np.ndarray:
    """Rows of length one, in double precision; scaled first, so that no square overflows."""
    x = vectors.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def rotate(unit: np.ndarray) -> np.ndarray:
    """Rotated rows in single precision. Only element-wise steps: a row comes out the same in whatever batch it is."""
    d = unit.shape[1]
    size = padded(d)
    x = np.zeros((len(unit), size), dtype=np.float32)
    x[:, :d] = unit
    signs = np.random.default_rng(SEED).choice([-1.0, 1.0], size=(2, size)).astype(np.float32)
    for s in signs:
        x = x * s
        step = 1
        while step < size:
            y = x.reshape(len(x), -1, 2, step)
            x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(len(x), size)
            step *= 2
        x = x * np.float32(1 / np.sqrt(size))
    return x


def _distance(x: np.ndarray, y: np.ndarray, block: tuple[int, int]) -> np.ndarray:
    """Squared distances of rows in a block, summed in a fixed order."""
    out = np.zeros(len(x), dtype=np.float32)
    for c in range(*block):
        out += (x[:, c] - y[:, c]) ** 2
    return out


# ---------------------------------------------------------------- cells

@dataclass(frozen=True)
class Cells:
    """A kd-tree over one block: cuts in heap order, and the cells' lower and upper corners."""

    depth: int
    axis: np.ndarray
    cut: np.ndarray
    low: np.ndarray
    high: np.ndarray

    def of(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), dtype=np.int64)
        for _ in range(self.depth):
            at = 2 * at + 1 + (x[np.arange(len(x)), self.axis[at]] > self.cut[at])
        return at - (2 ** self.depth - 1)

    def near(self, budget: float) -> list[np.ndarray]:
        """For every cell the cells within the budget of it, itself included."""
        out = []
        for k in range(len(self.low)):
            gap = np.maximum(np.maximum(self.low - self.high[k], self.low[k] - self.high), 0)
            out.append(np.flatnonzero((gap * gap).sum(axis=1) <= budget + SLACK))
        return out


def fit_cells(sample: np.ndarray, depth: int) -> Cells:
    n, k = 2 ** depth, sample.shape[1]
    axis, cut = np.zeros(n - 1, dtype=np.int64), np.zeros(n - 1)
    low, high = np.full((2 * n - 1, k), -np.inf), np.full((2 * n - 1, k), np.inf)
    rows: list = [sample] + [None] * (2 * n - 2)
    for at in range(n - 1):
        own = rows[at]
        axis[at] = int(np.argmax(own.max(axis=0) - own.min(axis=0))) if len(own) else at % k
        cut[at] = np.median(own[:, axis[at]]) if len(own) else 0.0
        right = own[:, axis[at]] > cut[at]
        for child, inside in ((2 * at + 1, ~right), (2 * at + 2, right)):
            rows[child], low[child], high[child] = own[inside], low[at], high[at]
        high[2 * at + 1, axis[at]] = min(high[at, axis[at]], cut[at])
        low[2 * at + 2, axis[at]] = max(low[at, axis[at]], cut[at])
    return Cells(depth, axis, cut, low[n - 1:], high[n - 1:])


# ---------------------------------------------------------------- comparing

def _leaves(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, edges): rows in an order in which leaves of at most ``LEAF`` stand together, and where
    they begin; cut at medians of the widest side."""
    out, todo = [], [np.arange(len(x))]
    while todo:
        rows = todo.pop()
        if len(rows) <= LEAF:
            out.append(rows)
            continue
        own = x[rows]
        axis = int(np.argmax(own.max(axis=0) - own.min(axis=0)))
        half = len(rows) // 2
        order = rows[np.argpartition(own[:, axis], half)]
        todo += [order[:half], order[half:]]
    return np.concatenate(out), np.concatenate([[0], np.cumsum([len(r) for r in out])])


def least_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For nodes 0..n-1 the least node of each one's component."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


class Side:
    """Some rows of a task in leaf order."""

    def __init__(self, rows: np.ndarray, own: np.ndarray):
        order, self.edges = _leaves(own[rows])
        self.rows = rows[order]
        x = own[self.rows]
        self.low, self.high = (f.reduceat(x, self.edges[:-1], axis=0) for f in (np.minimum, np.maximum))
        norms = (x * x).sum(axis=1, keepdims=True)
        one = np.ones_like(norms)
        # the product of a row of the one and a row of the other is their squared distance
        self.left, self.right = np.hstack([-2 * x, norms, one]), np.hstack([x, one, norms])


class Task:
    """Rows of one task and the links found among them in one block."""

    def __init__(self, vectors: np.ndarray, times: np.ndarray, nth: int, cosine: float):
        self.unit, self.times, self.cosine = units(vectors), times.astype(np.float64), cosine
        self.rotated = rotate(self.unit)
        self.blocks, self.nth = blocks_of(vectors.shape[1]), nth
        size = padded(vectors.shape[1])
        self.budgets = [np.float32((2 - 2 * cosine) * (end - first) / size + SLACK) for first, end in self.blocks]
        self.n_links = np.zeros(len(vectors))
        self.found: list[tuple[np.ndarray, np.ndarray]] = []
        self.waiting = 0
        self.left: list[np.ndarray] = []
        self.right: list[np.ndarray] = []
        self.held = 0

    def compare(self, a: np.ndarray, b: np.ndarray | None) -> None:
        """All rows ``a`` with all rows ``b``; each two of ``a`` if there are no others."""
        own = np.ascontiguousarray(self.rotated[:, slice(*self.blocks[self.nth])])
        one = Side(a, own)
        other = one if b is None else Side(b, own)
        for k in range(len(one.edges) - 1):
            gap = np.maximum(np.maximum(other.low - one.high[k], one.low[k] - other.high), 0)
            near = (gap * gap).sum(axis=1) <= self.budgets[self.nth]
            if b is None:
                near[:k] = False
            # neighbouring leaves stand side by side and are one matrix product
            edge = np.flatnonzero(np.diff(np.concatenate([[0], near.astype(np.int8), [0]])))
            for low, high in zip(other.edges[edge[::2]].tolist(), other.edges[edge[1::2]].tolist()):
                for at in range(low, high, WIDE):
                    self.tile(one, int(one.edges[k]), int(one.edges[k + 1]), other, at, min(high, at + WIDE), b is None)
        self.verify()

    def tile(self, one: Side, start: int, stop: int, other: Side, low: int, high: int, same: bool) -> None:
        near = one.left[start:stop] @ other.right[low:high].T <= self.budgets[self.nth] + np.float32(PRODUCT_SLACK)
        at = np.flatnonzero(near)
        if same and low < stop and len(at):
            # rows of a leaf with themselves: each pair once
            at = at[low + at % near.shape[1] > start + at // near.shape[1]]
        if not len(at):
            return
        i, j = one.rows[start + at // near.shape[1]], other.rows[low + at % near.shape[1]]
        if len(at) > near.size // 8:
            # very many pairs are near: one more matrix product leaves the links
            linked = (self.unit[one.rows[start:stop]] @ self.unit[other.rows[low:high]].T).ravel()[at] >= self.cosine
            self.count(i[linked], j[linked])
            return
        self.found.append((i, j))
        self.waiting += len(at)
        if self.waiting > STRIP:
            self.verify()

    def verify(self) -> None:
        """Exact cosines of the pairs that wait."""
        if not self.found:
            return
        i, j = (np.concatenate(v) for v in zip(*self.found))
        self.found, self.waiting = [], 0
        for at in range(0, len(i), STRIP):
            p, q = i[at:at + STRIP], j[at:at + STRIP]
            linked = np.einsum("ij,ij->i", self.unit[p], self.unit[q]) >= self.cosine
            self.count(p[linked], q[linked])

    def count(self, i: np.ndarray, j: np.ndarray) -> None:
        """Links, of which those count here whose first block with its share kept is this one."""
        for block, budget in zip(self.blocks[:self.nth], self.budgets):
            if not len(i):
                return
            later = _distance(self.rotated[i], self.rotated[j], block) > budget
            i, j = i[later], j[later]
        here = _distance(self.rotated[i], self.rotated[j], self.blocks[self.nth]) <= self.budgets[self.nth]
        i, j = i[here], j[here]
        if not len(i):
            return
        n = len(self.n_links)
        self.n_links += np.bincount(i, self.times[j], n) + np.bincount(j, self.times[i], n)
        self.left.append(i)
        self.right.append(j)
        self.held += len(i)
        if self.held > HELD:
            self.reduce()

    def reduce(self) -> np.ndarray:
        """Links held so far as stars; the label of every row."""
        label = least_labels(len(self.n_links), np.concatenate([*self.left, np.zeros(0, np.int64)]), np.concatenate([*self.right, np.zeros(0, np.int64)]))
        off = np.flatnonzero(label != np.arange(len(label)))
        self.left, self.right, self.held = [off], [label[off]], 0
        return label


_FOUND = "node long, n_links long, root long"


def _vectors(column: pa.ChunkedArray | pa.Array, d: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _compare(cosine: float):
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        d, nth, one, other = (int(k.as_py()) for k in key)
        node, side = rows.column("node").to_numpy(), rows.column("side").to_numpy()
        task = Task(_vectors(rows.column("vector"), d), rows.column("times").to_numpy(), nth, cosine)
        mine = np.flatnonzero(side == 0)
        if one == other:
            task.compare(mine, None)
        elif len(mine) and len(mine) < len(side):
            task.compare(mine, np.flatnonzero(side == 1))
        label = task.reduce()
        got = np.flatnonzero(task.n_links > 0)
        return pa.table({"node": node[got], "n_links": task.n_links[got].astype(np.int64), "root": node[label[got]]})

    return run


# ---------------------------------------------------------------- dealing

@dataclass(frozen=True)
class Dealing:
    """Where rows of one vector length go: cells, pieces and partners of every block."""

    cells: list[Cells]
    pieces: list[np.ndarray]  # pieces of each cell, by block
    partners: list[list[np.ndarray]]  # pieces that each cell's rows meet, by block

    def first(self, block: int) -> np.ndarray:
        return np.cumsum(self.pieces[block]) - self.pieces[block]


def _deal(dealings):
    """Every row once for each pair of pieces that it belongs to."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch.column("d").to_numpy()
            for d in np.unique(lengths):
                rows = batch.take(pa.array(np.flatnonzero(lengths == d)))
                dealing, node = dealings.value[int(d)], rows.column("node").to_numpy()
                turned = rotate(units(_vectors(rows.column("vector"), int(d))))
                for nth, (first, end) in enumerate(blocks_of(int(d))):
                    cell = dealing.cells[nth].of(turned[:, first:end])
                    # rows of a cell are dealt over its pieces by their number
                    mixed = (node.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64)
                    own = dealing.first(nth)[cell] + mixed % dealing.pieces[nth][cell]
                    for c in np.unique(cell):
                        inside, others = np.flatnonzero(cell == c), dealing.partners[nth][c]
                        # a few thousand copies at a time
                        for part in np.array_split(inside, max(1, len(inside) * len(others) // 20_000)):
                            at, met = np.repeat(part, len(others)), np.tile(others, len(part))
                            mine = own[at]
                            one, other = np.minimum(mine, met), np.maximum(mine, met)
                            copies = rows.take(pa.array(at))
                            fill = lambda v, t: pa.array(np.broadcast_to(np.asarray(v), len(at)), type=t)
                            yield pa.RecordBatch.from_arrays(
                                [fill(d, pa.int32()), fill(nth, pa.int32()), fill(one, pa.int64()), fill(other, pa.int64()), fill(mine > met, pa.int32()), copies.column("node"), copies.column("times"), copies.column("vector")],
                                names=["d", "block", "one", "other", "side", "node", "times", "vector"],
                            )

    return run


def _plan(distinct: DataFrame, cosine: float, piece: int, sample: int) -> dict[int, Dealing]:
    """A dealing for every vector length; cells' counts and the sample come to the driver, both bounded."""
    spark, sizes = distinct.sparkSession, {r["d"]: r["n"] for r in distinct.groupBy("d").agg(F.count(F.lit(1)).alias("n")).collect()}
    out = {}
    for d, n in sizes.items():
        own = distinct.filter(F.col("d") == d)
        share = min(1.0, 2.0 * sample / n)
        drawn = own.filter(F.pmod(F.xxhash64("node"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).select("vector").limit(sample).toArrow()
        turned = rotate(units(_vectors(drawn.column("vector"), d)))
        depth = min(MOST_DEPTH, max(0, (-(-n // piece) - 1).bit_length()))
        cells = [fit_cells(turned[:, first:end], depth) for first, end in blocks_of(d)]
        shared = spark.sparkContext.broadcast(cells)

        def count(batches: Iterator[pa.RecordBatch], d=d, shared=shared) -> Iterator[pa.RecordBatch]:
            total = np.zeros((len(shared.value), 2 ** shared.value[0].depth), dtype=np.int64)
            for batch in batches:
                x = rotate(units(_vectors(batch.column(0), d)))
                for nth, (first, end) in enumerate(blocks_of(d)):
                    total[nth] += np.bincount(shared.value[nth].of(x[:, first:end]), minlength=total.shape[1])
            nth, cell = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(nth), pa.array(cell), pa.array(total[nth, cell])], names=["block", "cell", "n"])

        counts = np.zeros((len(cells), 2 ** depth), dtype=np.int64)
        if depth:
            for r in own.select("vector").mapInArrow(count, "block long, cell long, n long").groupBy("block", "cell").agg(F.sum("n").alias("n")).collect():
                counts[r["block"], r["cell"]] = r["n"]
        else:
            counts[:] = n
        pieces = [np.maximum(1, -(-c // piece)) for c in counts]
        partners = []
        for nth, (first, end) in enumerate(blocks_of(d)):
            start = np.cumsum(pieces[nth]) - pieces[nth]
            near = cells[nth].near((2 - 2 * cosine) * (end - first) / padded(d))
            partners.append([np.concatenate([np.arange(start[c], start[c] + pieces[nth][c]) for c in own_near]) for own_near in near])
        out[d] = Dealing(cells, pieces, partners)
    return out


def near_links(distinct: DataFrame, *, cosine: float = COSINE, piece: int = PIECE, sample: int = SAMPLE) -> DataFrame:
    """(node, n_links, root): for every task and row with links in it, how many, and a row of its component there.

    ``distinct`` is a written table of (node, times, d, vector), one row a vector.
    """
    dealings = distinct.sparkSession.sparkContext.broadcast(_plan(distinct, cosine, piece, sample))
    kind = distinct.schema["vector"].dataType.simpleString()
    dealt = distinct.mapInArrow(_deal(dealings), f"d int, block int, one long, other long, side int, node long, times long, vector {kind}")
    return materialize(dealt.groupBy("d", "block", "one", "other").applyInArrow(_compare(cosine), _FOUND), "vector-links")


def _valid(vector) -> F.Column:
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & good & F.exists(vector, lambda x: x != 0), F.lit(False))


def components(rows: DataFrame, *, vec_id: str = "vec_id", vector: str = "embedding", cosine: float = COSINE, piece: int = PIECE, sample: int = SAMPLE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row."""
    column = F.col(f"`{vector}`")
    single = rows.select(column).dtypes[0][1] == "array<float>"
    own = rows.select(F.col(f"`{vec_id}`").alias("vec_id"), (column if single else column.cast("array<double>")).alias("vector"))
    valid = own.filter(_valid(F.col("vector")))
    groups = valid.groupBy("vector").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("times"))
    distinct = materialize(groups.select(F.monotonically_increasing_id().alias("node"), "least", "times", F.size("vector").alias("d"), "vector"), "vectors")
    found = near_links(distinct.select("node", "times", "d", "vector"), cosine=cosine, piece=piece, sample=sample)
    counts = found.groupBy("node").agg(F.sum("n_links").alias("links"))
    roots = star_labels(found.filter("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")))
    facts = distinct.select("node", "least", "times").join(counts, "node", "left").join(roots, "node", "left")
    facts = facts.select("node", "least", "times", (F.coalesce("links", F.lit(0)) + F.col("times") - 1).alias("n_links"), F.coalesce("root", "node").alias("root"))
    facts = materialize(facts, "vector-facts")
    named = facts.join(facts.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("node", "n_links", "component_id")
    table_of = materialize(distinct.select("node", "vector", F.col("times").alias("weight")).join(named, "node").drop("node"), "vector-components")
    # a broadcast of vectors is bounded by their bytes
    longest = distinct.agg(F.max("d")).first()[0] or 1
    linked = lookup_join(own.filter(_valid(F.col("vector"))), table_of, ["vector"], weight="weight", broadcast_rows=BROADCAST_BYTES // (8 * longest + 32))
    linked = linked.select("vec_id", "n_links", "component_id")
    alone = own.filter(~_valid(F.col("vector"))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op13(spark, folder: str) -> DataFrame:
    return components(table(spark, folder, "embeddings"))
