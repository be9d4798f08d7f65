"""Pivot index for exact neighbour work on vectors.

Rows are assigned to the nearest of at most ``MAX_PIVOTS`` pivots, chosen from a bounded
hash-ordered sample by distance-weighted draws; every row is indexed. A cell (the rows of
one pivot) is known by its smallest and largest distance to the pivot. By the triangle
inequality a row x has no row of cell q nearer than max(d(x, q) - largest, smallest - d(x, q)),
and two cells no pair nearer than d(p, q) - largest_p - largest_q, so whole block pairs are
dropped without looking at their rows, and nothing is lost. The metric is the angle between
rows for cosine similarity, or the Euclidean distance.

A cell of more than ``block_rows`` rows is split by key hash into blocks, so one hot region is
many blocks. Blocks are what is compared; what is shipped are groups of blocks of neighbouring cells
(``GROUPS`` of them, or as many as hold ``GROUP_BYTES`` of vectors each). Two groups meet in one
task, so a row is copied once per group that its own group meets, not once per block: about
``GROUPS`` times, however many blocks there are, until ``GROUP_BYTES`` bounds the group. Only the
table of cells (one row per pivot) and the pairs of groups reach the driver.

Zero vectors have cosine 0 with everything; they form a cell of their own whose angle to
every row counts as a right angle.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import BROADCAST_ROW_LIMIT, broadcast_if_small, materialize

MAX_PIVOTS = 512
SAMPLE_PER_PIVOT = 8
CELLS_PER_BLOCK = 8
GROUPS = 6                                                       # 21 pairs of groups; a row is copied to six of them
GROUP_BYTES = 64 << 20
_BUFFER = 100_000                                                # rows of an output batch
_SUB = 1_000_000                                                 # block id = cell * _SUB + part
ZERO_CELL = MAX_PIVOTS                                           # the cell of zero vectors (cosine)
_SLACK = 1e-7


def matrix(column) -> np.ndarray:
    """A list column of a pandas frame as a float matrix."""
    return np.vstack([np.asarray(v, dtype=np.float64) for v in column.to_numpy()]) if len(column) else np.zeros((0, 0))


def unit_rows(m: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(m, axis=1, keepdims=True)
    length[length == 0] = 1.0
    return m / length


def euclidean(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d2 = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2.0 * a @ b.T
    return np.sqrt(np.maximum(d2, 0.0))


def distances(metric: str, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All distances of two sets of rows; cosine rows are unit (or zero) vectors."""
    if metric == "cosine":
        return np.arccos(np.clip(a @ b.T, -1.0, 1.0))
    return euclidean(a, b)


def choose_pivots(sample: np.ndarray, n: int, metric: str, seed: int = 42) -> np.ndarray:
    """``n`` rows of the sample, each drawn with the squared distance to those before it as weight."""
    rng = np.random.default_rng(seed)
    chosen = [int(rng.integers(len(sample)))]
    near = distances(metric, sample, sample[chosen])[:, 0] ** 2
    while len(chosen) < n and near.max() > 1e-12:
        pick = int(rng.choice(len(sample), p=near / near.sum()))
        chosen.append(pick)
        near = np.minimum(near, distances(metric, sample, sample[[pick]])[:, 0] ** 2)
    return sample[chosen]


class PivotIndex:
    """Rows with their cell and block, and the cells' radii."""

    def __init__(self, points: DataFrame, key: str = "sample_key", vec: str = "vec", metric: str = "cosine",
                 block_rows: int = 2000, extra: tuple = (), pivots: np.ndarray | None = None):
        if metric not in ("cosine", "euclidean"):
            raise ValueError(f"unknown metric {metric}")
        self.key, self.metric, self.block_rows, self.extra = key, metric, block_rows, tuple(extra)
        self.spark = points.sparkSession
        base = points.select(F.col(key).cast("long").alias(key), F.col(vec).cast("array<double>").alias("vec"), *extra)
        base = base.where(F.col("vec").isNotNull())
        if pivots is None:
            want = min(MAX_PIVOTS, max(1, math.ceil(base.count() / max(1, block_rows // CELLS_PER_BLOCK))))
            rows = base.orderBy(F.xxhash64(key), key).limit(want * SAMPLE_PER_PIVOT).select("vec").toPandas()
            sample = matrix(rows["vec"])
            if metric == "cosine" and len(sample):
                sample = unit_rows(sample)
                sample = sample[(sample * sample).sum(1) > 0]
            pivots = choose_pivots(sample, want, metric) if len(sample) else np.zeros((0, 0))
        self.pivots = pivots
        assigned = materialize(base.mapInPandas(self._assign(), self._schema(base)), "pivot-rows")
        cells = (assigned.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("to_pivot").alias("lo"), F.max("to_pivot").alias("hi"))
                 .orderBy("cell").collect())                     # one row per pivot
        self.cells = pd.DataFrame([r.asDict() for r in cells], columns=["cell", "n", "lo", "hi"])
        self.cells["parts"] = np.ceil(self.cells["n"].astype(float) / block_rows).astype(int)
        self._group_cells()
        dealt = self.spark.createDataFrame([(int(r.cell), int(r.parts), float(r.first), float(r.n / r.parts)) for r in self.cells.itertuples()],
                                           "cell int, _parts int, _first double, _size double")       # one row per pivot
        part = F.pmod(F.xxhash64(key), F.col("_parts"))
        group = F.floor((F.col("_first") + (part + 0.5) * F.col("_size")) / self.group_rows).cast("int")
        self.rows = assigned.join(F.broadcast(dealt), "cell").select(*assigned.columns, (F.col("cell").cast("long") * _SUB + part).alias("block"), group.alias("grp"))

    def _schema(self, base: DataFrame) -> str:
        kinds = dict(base.dtypes)
        return ", ".join([f"`{self.key}` long", "vec array<double>", *[f"`{c}` {kinds[c]}" for c in self.extra], "cell int", "to_pivot double"])

    def _assign(self):
        pivots, metric = self.pivots, self.metric

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in frames:
                if not len(pdf):
                    continue
                v = matrix(pdf["vec"])
                zero = np.zeros(len(v), dtype=bool)
                if metric == "cosine":
                    v = unit_rows(v)
                    zero = (v * v).sum(1) == 0
                cell, to = np.full(len(v), ZERO_CELL), np.zeros(len(v))
                if len(pivots) and not zero.all():
                    d = distances(metric, v[~zero], pivots)
                    cell[~zero] = d.argmin(axis=1)
                    to[~zero] = d.min(axis=1)
                yield pdf.assign(vec=list(v), cell=cell.astype(np.int32), to_pivot=to)
        return run

    # -- groups ------------------------------------------------------------

    def _group_cells(self) -> None:
        """Cells in a chain of near pivots, and the groups that their blocks fall into."""
        c = self.cells
        n, dims = float(c["n"].sum()), self.pivots.shape[1] if self.pivots.ndim == 2 else 0
        self.group_rows = max(self.block_rows, min(math.ceil(n / GROUPS), GROUP_BYTES // (8 * max(1, dims))))
        left = [i for i, cell in enumerate(c["cell"]) if cell != ZERO_CELL]
        chain = []
        while left:
            at = self.pivots[c["cell"].to_numpy()[left]]
            near = 0 if not chain else int(distances(self.metric, self.pivots[[c["cell"].iloc[chain[-1]]]], at)[0].argmin())
            chain.append(left.pop(near))
        chain += [i for i, cell in enumerate(c["cell"]) if cell == ZERO_CELL]
        first = np.zeros(len(c))
        first[chain] = np.concatenate([[0.0], np.cumsum(c["n"].to_numpy(dtype=float)[chain])])[:-1]
        c["first"] = first
        half = c["n"] / c["parts"] / 2
        c["group_lo"] = np.floor((c["first"] + half) / self.group_rows).astype(int)
        c["group_hi"] = np.floor((c["first"] + c["n"] - half) / self.group_rows).astype(int)
        self.n_groups = int(c["group_hi"].max()) + 1 if len(c) else 0

    def in_groups(self) -> np.ndarray:
        """Which groups (columns) can hold rows of each cell."""
        g = np.arange(self.n_groups)
        return (g >= self.cells["group_lo"].to_numpy()[:, None]) & (g <= self.cells["group_hi"].to_numpy()[:, None])

    def group_pairs(self, reach: float) -> list[tuple[int, int]]:
        """Pairs a <= b of groups with cells that can hold rows within ``reach`` of each other."""
        near = (self.cell_distances() <= reach + self.slack()).astype(np.float32)
        held = self.in_groups().astype(np.float32)
        a, b = np.nonzero(np.triu(held.T @ near @ held > 0))
        return [(int(x), int(y)) for x, y in zip(a, b)]

    # -- bounds ------------------------------------------------------------

    def cell_distances(self) -> np.ndarray:
        """Lower bound of the distance between any rows of two cells, for all pairs of cells."""
        c = self.cells
        pivot = c["cell"].to_numpy()
        out = np.full((len(c), len(c)), math.pi / 2)
        real = pivot != ZERO_CELL
        if real.any():
            at = self.pivots[pivot[real]]
            hi = c["hi"].to_numpy()[real]
            gap = distances(self.metric, at, at) - hi[:, None] - hi[None, :]
            np.fill_diagonal(gap, 0.0)
            out[np.ix_(real, real)] = np.maximum(gap, 0.0)
        return out

    def slack(self) -> float:
        """Room for rounding in the bounds."""
        top = float(self.cells["hi"].max()) if len(self.cells) else 0.0
        return _SLACK * (1.0 + top)

    def block_pairs(self, reach: float, rows: DataFrame | None = None) -> DataFrame:
        """(a, b, p, q), a <= b: pairs of blocks (of cells p and q) that can hold rows within ``reach`` of each other.

        ``rows`` may deal the rows of a cell to other blocks than the index does.
        """
        c = self.cells["cell"].to_numpy().astype(np.int64)
        i, j = np.nonzero(np.triu(self.cell_distances() <= reach + self.slack()))
        near = self.spark.createDataFrame(pd.DataFrame({"p": c[i], "q": c[j]}), "p long, q long")
        blocks = (self.rows if rows is None else rows).select(F.col("cell").cast("long").alias("cell"), "block").distinct()
        left = blocks.select(F.col("cell").alias("p"), F.col("block").alias("a"))
        right = blocks.select(F.col("cell").alias("q"), F.col("block").alias("b"))
        return (near.join(left, "p").join(right, "q").where((F.col("p") < F.col("q")) | (F.col("a") <= F.col("b")))
                .select("a", "b", "p", "q"))

    def compared(self, pairs: DataFrame) -> DataFrame:
        """One row: rows, blocks, all row pairs, and the row pairs that the given block pairs compare."""
        sizes = self.rows.groupBy("block").agg(F.count(F.lit(1)).alias("n"))
        left = sizes.select(F.col("block").alias("a"), F.col("n").alias("na"))
        right = sizes.select(F.col("block").alias("b"), F.col("n").alias("nb"))
        both = pairs.select("a", "b").join(left, "a").join(right, "b")
        one = F.when(F.col("a") == F.col("b"), F.col("na") * (F.col("na") - 1) / 2).otherwise(F.col("na") * F.col("nb"))
        total = sizes.agg(F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_blocks"))
        return (both.agg(F.sum(one).cast("long").alias("compared_pairs")).crossJoin(total)       # two one-row tables
                .select("n_rows", "n_blocks", (F.col("n_rows") * (F.col("n_rows") - 1) / 2).cast("long").alias("all_pairs"), "compared_pairs"))

    def row_bound(self):
        """Function of rows (cosine: unit or zero) and positions in ``cells``: the smallest distance that a row of each cell can have to each row."""
        metric, pivots = self.metric, self.pivots
        cell, lo, hi = (self.cells[c].to_numpy() for c in ("cell", "lo", "hi"))

        def bound(v: np.ndarray, at: np.ndarray) -> np.ndarray:
            out = np.full((len(v), len(at)), math.pi / 2)
            real = cell[at] != ZERO_CELL
            if real.any():
                d = distances(metric, v, pivots[cell[at][real]])
                near = np.maximum(np.maximum(d - hi[at][real], lo[at][real] - d), 0.0)
                if metric == "cosine":                           # a zero row is at a right angle to all
                    near[(v * v).sum(1) == 0] = math.pi / 2
                out[:, real] = near
            return out
        return bound


def read_group(batches, dims: int) -> dict[str, np.ndarray]:
    """Columns of the Arrow batches of a group as arrays, ``vec`` as a matrix."""
    t = pa.Table.from_batches(list(batches)).combine_chunks()
    out = {}
    for c in t.column_names:
        col = t.column(c)
        if c == "vec":
            col = col.combine_chunks()
            flat = (pa.concat_arrays(col.chunks) if isinstance(col, pa.ChunkedArray) else col).flatten() if len(t) else pa.array([], pa.float64())
            out[c] = flat.to_numpy(zero_copy_only=False).reshape(len(t), -1) if len(t) else np.zeros((0, dims))
        else:
            out[c] = col.to_numpy()
    return out


def take(cols: dict, rows) -> dict:
    return {c: v[rows] for c, v in cols.items()}


def by_block(cols: dict, name: str = "block") -> list[tuple[int, dict]]:
    """(block, its rows) for all blocks, in order."""
    order = np.argsort(cols[name], kind="stable")
    cols = take(cols, order)
    ids, starts = np.unique(cols[name], return_index=True)
    return [(int(b), take(cols, slice(x, y))) for b, x, y in zip(ids, starts, [*starts[1:], len(order)])]


def ship(rows: DataFrame, pairs: list[tuple[int, int]], side: int, end: int) -> DataFrame:
    """``rows`` (with their group ``grp``) once for every pair of groups in which theirs is at place ``end``, marked ``_side``."""
    sides = rows.sparkSession.createDataFrame([(p[end], *p) for p in pairs], "grp int, _a int, _b int")
    sides = broadcast_if_small(sides, BROADCAST_ROW_LIMIT, len(pairs))
    out = rows.join(sides, "grp")
    return out.select("_a", "_b", F.lit(side).cast("byte").alias("_side"), *[F.col(c).alias(c) for c in rows.columns])


def by_pair(rows: DataFrame, n_pairs: int):
    """Shipped rows grouped by pair of groups. The work of a pair is far above its bytes, so pairs are dealt by number, not by size."""
    return rows.repartition(2 * max(1, n_pairs), "_a", "_b").groupBy("_a", "_b")


def meet(index: PivotIndex, rows: DataFrame, reach: float, fn, schema: str) -> DataFrame:
    """``fn(a, b, columns of a, columns of b)`` for every pair of blocks that can hold rows within ``reach`` of each other.

    ``rows`` have grp, cell, block and the columns that ``fn`` wants; they may deal the rows of a cell to other
    blocks than the index does. Every pair comes once, a block also with itself; ``fn`` returns a dict of arrays
    with the names of ``schema``, or None. A task holds two groups of rows, and its results leave in batches.
    """
    names, dims = [c.split()[0] for c in schema.split(", ")], index.pivots.shape[1] if index.pivots.ndim == 2 else 0
    pairs = index.group_pairs(reach)
    where = {int(c): i for i, c in enumerate(index.cells["cell"])}
    near = index.cell_distances() <= reach + index.slack()
    kinds = {"long": pa.int64(), "double": pa.float64()}
    out = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in schema.split(", ")])

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = read_group(batches, dims)
        sides = [by_block(take({c: v for c, v in got.items() if c not in ("_a", "_b", "_side", "grp")}, got["_side"] == s)) for s in (0, 1)]
        one = key[0].as_py() == key[1].as_py()
        held, n = [], 0
        for x, (a, own) in enumerate(sides[0]):
            for b, other in (sides[0][x:] if one else sides[1]):
                if not near[where[a // _SUB], where[b // _SUB]]:
                    continue
                found = fn(a, b, own, other)
                if found is None or not len(found[names[0]]):
                    continue
                held.append(found)
                n += len(found[names[0]])
                if n >= _BUFFER:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([h[c] for h in held]), out.field(c).type) for c in names], schema=out)
                    held, n = [], 0
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([h[c] for h in held]), out.field(c).type) for c in names], schema=out)

    both = ship(rows, pairs, 0, 0).unionByName(ship(rows, [p for p in pairs if p[0] < p[1]], 1, 1))
    return by_pair(both, len(pairs)).applyInArrow(run, schema)
