"""Hard negatives by exact inner-product search in cover trees.

Every vector becomes whole numbers, floor(256 * x). With the largest norm M of all rows, a row x
is augmented by sqrt(M^2 - |x|^2): all rows lie on one sphere, and the inner product with a
query q is |q| M cos(angle). So a node of a cover tree with centre c and covering angle r bounds
the scores of all its rows: |q| M cos(angle(q, c) - r) from above, cos(angle(q, c) + r) from below.

1. Rows go to the nearest of ``CELLS`` pivots at most (a hash-chosen sample of rows; only the pivots
   come from the sample, every row is indexed). A cell of more than ``BLOCK_ROWS`` rows is split by
   row hash, so a hot region is many blocks.
2. A cover tree is built over each block: farthest-first centres; those whose distance from the earlier
   ones exceeds half of the last level's radius form the next level; a node's covering angle is the
   largest angle to any row below it. Block and tree are one stored row.
3. Queries (anchors) are broadcast in chunks of ``CHUNK_BYTES``. A task streams its blocks: levels are
   descended with all nodes outside the query's score window skipped, the leaves that stay are visited
   best first in growing waves, verified exactly, and the window's floor rises to its k-th score. What
   a task found goes on to its next block as the floor. Tasks emit k rows per query and window.
4. The tasks' finds are merged by rank. The first search has no window and wants rows of the anchor's
   label (positives); the second has one window per positive, and wants rows of other labels.

Scores are whole numbers, computed in doubles where dimension * max^2 stays below 2^53, else in 64-bit
integers (exact while a score fits in them). Bounds carry a slack of a millionth of |q| M.

Edge cases: rows with a null vec_id, label or vector, or a null or non-finite component, take no part; a
shorter vector counts as padded with zeros; equal vec_ids are rows of their own (an anchor excludes only
itself); equal scores are ordered by vec_id; all vectors may be equal or zero; a label of one row has no
positives; a negative positive score has an empty window; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_batches, materialize, with_row_id

SCALE = 256.0
K = 5
LOW_PERCENT = 80
CELLS = 256
BLOCK_ROWS = 4096
LEAVES = 64
CHUNK_BYTES = 16 << 20
_QUERIES = 256                                                   # queries verified at once, to bound memory
_SLACK = 1e-6

_BLOCK_SPARK = "vec_ids binary, rids binary, labels binary, vectors binary, levels binary, parents binary, angles binary, leaf_of binary"
_BLOCK = pa.schema([(f.split()[0], pa.binary()) for f in _BLOCK_SPARK.split(", ")])
_FOUND_SPARK = "query long, slot int, score long, vec_id long, rid long"
_FOUND = pa.schema([("query", pa.int64()), ("slot", pa.int32()), ("score", pa.int64()), ("vec_id", pa.int64()), ("rid", pa.int64())])


def whole_vectors(embeddings: DataFrame) -> DataFrame:
    """(rid, vec_id, label, v) of the rows that take part; v holds floor(SCALE * x)."""
    x = F.col("embedding")
    ok = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < F.lit(float("inf"))))
    rows = with_row_id(embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "embedding"), "rid")
    return (rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & x.isNotNull() & ok)
            .select("rid", "vec_id", "label", F.transform(x, lambda c: F.floor(c.cast("double") * SCALE).cast("long")).alias("v")))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of a list column as a matrix, shorter ones padded with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), dim), dtype=np.int64)
    out[np.arange(dim)[None, :] < sizes[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def augmented(v: np.ndarray, norm2: float) -> np.ndarray:
    """Unit vectors on the sphere of the largest norm."""
    v = v.astype(np.float64)
    rest = np.sqrt(np.maximum(norm2 - (v * v).sum(axis=1), 0.0))
    return np.hstack([v, rest[:, None]]) / np.sqrt(norm2) if norm2 > 0 else np.hstack([v, np.ones((len(v), 1))])


def _angle(cosine: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosine, -1.0, 1.0))


def build_tree(u: np.ndarray, leaves: int = LEAVES) -> dict[str, np.ndarray]:
    """Cover tree over unit vectors: centres by level, parents and covering angles of nodes, leaf of each row.

    Level k has the first ``levels[k]`` centres as nodes. ``parents`` and ``angles`` list the levels' nodes
    one level after the other; a parent is a node of the level above.
    """
    m = min(leaves, len(u))
    centres, reach = [0], np.full(m, np.inf)
    near = u @ u[0]                                              # cosine to the nearest centre
    home = np.zeros(len(u), dtype=np.int32)
    for i in range(1, m):
        far = int(np.argmin(near))
        if near[far] >= 1.0 - 1e-15:                             # every row is some centre's copy
            break
        reach[i] = _angle(near[far:far + 1])[0]
        centres.append(far)
        to = u @ u[far]
        closer = to > near
        home[closer], near = i, np.maximum(near, to)
    m = len(centres)
    sizes, radius = [1], float(_angle((u @ u[0]).min()[None])[0])
    while sizes[-1] < m:                                         # halve the radius until every centre is in
        radius /= 2
        n = int(np.searchsorted(-reach[:m], -radius, side="left"))
        sizes.append(min(m, max(n, sizes[-1] + 1)))
    at = u[centres]
    parents = [np.zeros(1, dtype=np.int32)]
    for small, large in zip(sizes, sizes[1:]):
        up = np.argmax(at[:large] @ at[:small].T, axis=1).astype(np.int32)
        up[:small] = np.arange(small)                            # a centre stays below itself
        parents.append(up)
    owner, angles = home, []
    for k in range(len(sizes) - 1, -1, -1):                      # from the leaves up
        own = _angle(np.einsum("ij,ij->i", u, at[owner]))
        top = np.zeros(sizes[k])
        np.maximum.at(top, owner, own)
        angles.append(top)
        if k:
            owner = parents[k][owner]
    angles.reverse()
    return {"levels": np.array(sizes, dtype=np.int32), "centres": np.array(centres, dtype=np.int32),
            "parents": np.concatenate(parents), "angles": np.concatenate(angles), "leaf_of": home}


def _build_block(dim: int, norm2: float, wide: bool):
    def run(table: pa.Table) -> pa.Table:
        v = _matrix(table.column("v"), dim)
        tree = build_tree(augmented(v, norm2))
        order = np.argsort(tree["leaf_of"], kind="stable")       # rows of a leaf lie together
        place = np.empty(len(order), dtype=np.int64)
        place[order] = np.arange(len(order))
        cells = [table.column("vec_id").to_numpy()[order], table.column("rid").to_numpy()[order], table.column("label").to_numpy()[order],
                 v[order].astype(np.int64 if wide else np.int32), np.concatenate([tree["levels"], place[tree["centres"]]]).astype(np.int32),
                 tree["parents"], tree["angles"], tree["leaf_of"][order]]
        return pa.table([pa.array([c.tobytes()], pa.binary()) for c in cells], schema=_BLOCK)
    return run


class Block:
    """A stored block: rows in leaf order, and the tree over them."""

    def __init__(self, row: dict, dim: int, norm2: float, exact: bool):
        self.vec_ids, self.rids, self.labels = (np.frombuffer(row[c], dtype=np.int64) for c in ("vec_ids", "rids", "labels"))
        raw = np.frombuffer(row["vectors"], dtype=np.int32 if len(row["vectors"]) == 4 * dim * len(self.rids) else np.int64)
        self.v = raw.reshape(-1, dim).astype(np.float64 if exact else np.int64)
        self.leaf_of = np.frombuffer(row["leaf_of"], dtype=np.int32)
        angles, parents = np.frombuffer(row["angles"], dtype=np.float64), np.frombuffer(row["parents"], dtype=np.int32)
        packed, sizes = np.frombuffer(row["levels"], dtype=np.int32), []
        while not sizes or sum(sizes) < len(angles):
            sizes.append(int(packed[len(sizes)]))
        self.centres = self.v[packed[len(sizes):]].astype(np.float64)
        cut = np.cumsum(sizes)[:-1]
        self.parents, self.angles = np.split(parents, cut), np.split(angles, cut)
        self.bounds = np.searchsorted(self.leaf_of, np.arange(sizes[-1] + 1))
        self.norm = float(np.sqrt(norm2))

    def leaves(self, q: np.ndarray, floor: np.ndarray, ceiling: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Upper bounds of all leaves for each query (-inf: outside its windows), and lower bounds."""
        length = np.sqrt((q * q).sum(axis=1)) * self.norm
        safe = np.where(length > 0, length, 1.0)
        theta = _angle(q @ self.centres.T / safe[:, None])       # the augmented part of a query is zero
        slack = length * _SLACK + 0.5
        inside = np.ones((len(q), 1), dtype=bool)
        for parents, angles in zip(self.parents, self.angles):
            t = theta[:, :len(angles)]
            top = length[:, None] * np.cos(np.maximum(t - angles, 0.0)) + slack[:, None]
            low = length[:, None] * np.cos(np.minimum(t + angles, np.pi)) - slack[:, None]
            inside = inside[:, parents] & ((top[:, None, :] >= floor[:, :, None]) & (low[:, None, :] <= ceiling[:, :, None])).any(axis=1)
        return np.where(inside, top, -np.inf), low


class Finds:
    """The best ``k`` rows of every (query, window) slot so far."""

    def __init__(self, n_slots: int, k: int):
        self.k, self.kth = k, np.full(n_slots, -np.inf)
        none = np.zeros(0, dtype=np.int64)
        self.rows = (none, none, none, none)                     # slot, score, vec_id, rid; in order

    def add(self, parts: list[tuple[np.ndarray, ...]]) -> None:
        if not parts:
            return
        new = [np.concatenate([p[i] for p in parts]) for i in range(4)]
        touched = np.zeros(len(self.kth), dtype=bool)
        touched[new[0]] = True
        mine = touched[self.rows[0]]
        both = [np.concatenate([old[mine], x]) for old, x in zip(self.rows, new)]
        slot, score, vec_id, rid = both
        order = np.lexsort((rid, vec_id, -score, slot))
        by = slot[order]
        first = np.flatnonzero(np.concatenate([[True], by[1:] != by[:-1]]))
        rank = np.arange(len(by)) - np.repeat(first, np.diff(np.append(first, len(by))))
        last = order[rank == self.k - 1]
        self.kth[slot[last]] = score[last]
        keep = order[rank < self.k]
        self.rows = tuple(np.concatenate([old[~mine], x[keep]]) for old, x in zip(self.rows, both))


def search_block(block: Block, queries: dict, finds: Finds, same_label: bool) -> None:
    """Adds what ``block`` holds for every query's windows to ``finds``.

    queries: v (matrix), label, rid, and the windows' lowest and highest scores lo, hi (query x window).
    """
    width = queries["lo"].shape[1]
    for start in range(0, len(queries["rid"]), _QUERIES):
        some = slice(start, min(start + _QUERIES, len(queries["rid"])))
        q, lo, hi = queries["v"][some], queries["lo"][some], queries["hi"][some]
        slots = np.arange(start * width, start * width + lo.size).reshape(lo.shape)
        top, low = block.leaves(q.astype(np.float64), np.maximum(lo, finds.kth[slots]), hi)
        best = np.argsort(-top, axis=1, kind="stable")
        seen, wave = 0, 1
        while seen < top.shape[1]:
            leaves = best[:, seen:seen + wave]
            ahead = np.take_along_axis(top, leaves, axis=1)
            floor = np.maximum(lo, finds.kth[slots])
            below = np.take_along_axis(low, leaves, axis=1)
            open_ = ((ahead[:, None, :] >= floor[:, :, None]) & (below[:, None, :] <= hi[:, :, None])).any(axis=1)
            if not open_.any():
                if not (ahead > -np.inf).any():
                    break
                seen, wave = seen + wave, wave * 2
                continue
            who, where = np.nonzero(open_)
            leaf = leaves[who, where]
            order = np.argsort(leaf, kind="stable")
            who, leaf = who[order], leaf[order]
            cuts = np.flatnonzero(np.concatenate([[True], leaf[1:] != leaf[:-1], [True]]))
            parts = []
            for a, b in zip(cuts, cuts[1:]):
                rows = slice(block.bounds[leaf[a]], block.bounds[leaf[a] + 1])
                own = who[a:b]
                score = q[own] @ block.v[rows].T                 # exact: whole numbers
                fits = (block.labels[rows][None, :] == queries["label"][some][own][:, None]) == same_label
                if same_label:
                    fits &= block.rids[rows][None, :] != queries["rid"][some][own][:, None]
                for w in range(width):
                    at, col = np.nonzero(fits & (score >= floor[own, w][:, None]) & (score <= hi[own, w][:, None]))
                    if len(at):
                        parts.append((slots[own[at], w], score[at, col].astype(np.int64), block.vec_ids[rows][col], block.rids[rows][col]))
            finds.add(parts)
            seen, wave = seen + wave, wave * 2


class Index:
    """The blocks of all rows, and what every search needs to know of them."""

    def __init__(self, rows: DataFrame):
        self.spark = rows.sparkSession
        self.rows = materialize(rows, "vectors")
        s = self.rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("dim"),
                          F.max(F.aggregate("v", F.lit(0.0), lambda a, c: a + c.cast("double") * c.cast("double"))).alias("norm2"),
                          F.max(F.greatest(F.abs(F.array_max("v")), F.abs(F.array_min("v")))).alias("most")).first()
        self.n, self.dim, self.norm2 = s.n, max(s.dim or 0, 1), float(s.norm2 or 0.0)
        most = int(s.most or 0)
        self.wide, self.exact = most >= 1 << 31, self.dim * most * most < 1 << 53
        with arrow_batches(self.spark):
            self.blocks = materialize(self._blocks(), "cover-trees")

    def _blocks(self) -> DataFrame:
        dim, norm2 = self.dim, self.norm2
        n_cells = min(CELLS, max(1, -(-self.n // BLOCK_ROWS)))
        chosen = self.rows.orderBy(F.xxhash64("rid"), "rid").limit(n_cells).select("v").toArrow()
        pivots = augmented(_matrix(chosen.column("v"), dim), norm2)

        def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                u = augmented(_matrix(b.column("v"), dim), norm2)
                cell = np.argmax(u @ pivots.T, axis=1) if len(u) else np.zeros(0)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell.astype(np.int32))], names=[*b.schema.names, "cell"])

        kind = "long" if self.wide else "int"
        rows = self.rows.select("rid", "vec_id", "label", F.col("v").cast(f"array<{kind}>").alias("v"))
        rows = materialize(rows.mapInArrow(nearest, f"rid long, vec_id long, label long, v array<{kind}>, cell int"), "cells")
        sizes = {r.cell: -(-r["count"] // BLOCK_ROWS) for r in rows.groupBy("cell").count().collect()}   # CELLS rows at most
        parts = F.element_at(F.create_map(*[F.lit(x) for kv in sizes.items() for x in kv]), F.col("cell")) if sizes else F.lit(1)
        n_tasks = max(1, min(sum(sizes.values()), 4 * self.spark.sparkContext.defaultParallelism))
        blocked = rows.withColumn("part", F.pmod(F.xxhash64("rid"), parts)).repartition(n_tasks, "cell", "part")
        return blocked.groupBy("cell", "part").applyInArrow(_build_block(dim, norm2, self.wide), _BLOCK_SPARK)

    def search(self, queries: DataFrame, same_label: bool, k: int = K) -> DataFrame:
        """(query, slot, score, vec_id, rid, rank): the first ``k`` rows in each window of each query.

        queries: rid, label, v, lo and hi (arrays of window bounds, as long as each other; null: none).
        """
        queries = materialize(queries, "queries")
        n = queries.count()
        chunks = max(1, -(-n * (8 * self.dim + 64) // CHUNK_BYTES))
        found = []
        for c in range(chunks):
            own = queries.where(F.pmod(F.xxhash64("rid"), F.lit(chunks)) == c) if chunks > 1 else queries
            with arrow_batches(self.spark):
                found.append(materialize(self._search(own.toArrow(), same_label, k), "finds"))
        out = found[0]
        for f in found[1:]:
            out = out.unionByName(f)
        order = Window.partitionBy("query", "slot").orderBy(F.desc("score"), F.asc("vec_id"), F.asc("rid"))
        return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    def _search(self, table: pa.Table, same_label: bool, k: int) -> DataFrame:
        dim, norm2, exact = self.dim, self.norm2, self.exact
        width = max([1, *(len(x) for x in table.column("lo").to_pylist() if x is not None)])
        lo, hi = np.full((len(table), width), np.inf), np.full((len(table), width), -np.inf)   # no window
        for name, out in (("lo", lo), ("hi", hi)):
            for i, bounds in enumerate(table.column(name).to_pylist()):
                if bounds is None:
                    out[i, 0] = -np.inf if name == "lo" else np.inf
                else:
                    out[i, :len(bounds)] = bounds
        queries = {"v": _matrix(table.column("v"), dim).astype(np.float64 if exact else np.int64), "lo": lo, "hi": hi,
                   "label": table.column("label").to_numpy(), "rid": table.column("rid").to_numpy()}

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            finds = Finds(lo.size, k)
            for batch in batches:
                for row in batch.to_pylist():
                    search_block(Block(row, dim, norm2, exact), queries, finds, same_label)
            slot, score, vec_id, rid = finds.rows
            for a in range(0, len(slot), 1 << 16):
                b = slice(a, a + (1 << 16))
                yield pa.RecordBatch.from_arrays([pa.array(queries["rid"][slot[b] // width]), pa.array((slot[b] % width).astype(np.int32)),
                                                  pa.array(score[b]), pa.array(vec_id[b]), pa.array(rid[b])], schema=_FOUND)

        return self.blocks.mapInArrow(run, _FOUND_SPARK)


def mine(rows: DataFrame, is_anchor: Column, k_positive: int = K, k_negative: int = K, low_percent: int = LOW_PERCENT) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for the anchors among ``rows`` (``whole_vectors``)."""
    index = Index(rows)
    anchors = index.rows.where(is_anchor)
    none = F.lit(None).cast("array<long>")
    positives = index.search(anchors.select("rid", "label", "v", none.alias("lo"), none.alias("hi")), True, k_positive)
    positives = materialize(positives.select(F.col("query").alias("anchor"), F.col("vec_id").alias("positive_id"),
                                             F.col("score").alias("positive_score"), "rank"), "positives")
    big = F.col("positive_score").cast("decimal(30,0)")
    lowest = F.ceil(big * low_percent / 100).cast("long")
    # positive scores below zero have no window; k_positive at most per anchor
    windows = (positives.where("positive_score >= 0").groupBy("anchor")
               .agg(F.array_sort(F.collect_list(F.struct("rank", lowest.alias("lo"), F.col("positive_score").alias("hi")))).alias("w"))
               .select(F.col("anchor").alias("rid"), F.col("w.rank").alias("ranks"), F.col("w.lo").alias("lo"), F.col("w.hi").alias("hi")))
    asked = materialize(anchors.select("rid", "label", "v", "vec_id").join(windows, "rid"), "windows")
    negatives = index.search(asked.select("rid", "label", "v", "lo", "hi"), False, k_negative)
    slots = asked.select(F.col("rid").alias("query"), F.col("vec_id").alias("anchor_id"), F.posexplode("ranks").alias("slot", "p_rank"))
    return (negatives.select("query", "slot", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
            .join(slots, ["query", "slot"])
            .join(positives.select(F.col("anchor").alias("query"), F.col("rank").alias("p_rank"), "positive_id", "positive_score"), ["query", "p_rank"])
            .select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score"))
