"""Exact all-pairs work on vectors (C10, C11, H10 exact).

Nearest neighbours and threshold edges run over a pivot index (``pivots.PivotIndex``):
what the triangle inequality rules out is never compared. Rows are shipped by group
(``pivots.GROUPS``), two of which meet in one task, where NumPy matrix products compare chunks of
rows. Distance sums (exact silhouette) need every pair: rows are dealt to as many groups by their cluster.
Pair keys are produced by an equi-join with the pairs of groups, never by a cross join of rows; only
reduced results leave a task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import broadcast_if_small, materialize
from .pivots import _SUB, GROUP_BYTES, GROUPS, ZERO_CELL, PivotIndex, by_pair, distances, euclidean, meet, read_group, ship, take


_ROUTES = ("key long, vec array<double>, cell int, grp int, least double, neighbor_key array<long>, neg array<double>, "
           "away array<int>, asked long, left long")
_FOUND = "key long, neighbor_key array<long>, neg array<double>"
_ROWS, _COLS = 512, 8192                                         # sides of a matrix product
_TILE = 512                                                      # side of one whose distances are summed both ways
_ROUND = 1e-9                                                    # room for rounding in a product of unit rows
_ROUND32 = 2.0 ** -24                                            # rounding of single precision


def n_blocks(n_rows: int, block_rows: int) -> int:
    return max(1, math.ceil(n_rows / max(1, block_rows)))


def _lists(values: np.ndarray, starts: np.ndarray, kind) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(values, kind))


def _best(rows: np.ndarray, cols: np.ndarray, score: np.ndarray, keys: np.ndarray, k: int) -> np.ndarray:
    """Positions of each row's k highest scores, in order; ties to the smaller key."""
    order = np.lexsort((keys[cols], -score, rows))
    r = rows[order]
    return order[np.arange(len(r)) - np.searchsorted(r, r) < k]


def _searcher(refs: PivotIndex, k: int, exclude_self: bool):
    """Search of rows ``q`` (key, vec, cell, least) in rows ``r`` (key, vec, cell) of some cells of ``refs``.

    Returns (row of q, row of r, score), the rows' best k that are not below ``least`` each, and the number of pairs
    compared. Nearest cells come first; the k-th score found so far leaves out the cells that
    cannot hold a higher one. Products only choose the candidates: their scores are computed anew row by row, so
    that equal vectors get equal scores wherever they lie.
    """
    metric, slack, bound = refs.metric, refs.slack(), refs.row_bound()
    where = {int(c): i for i, c in enumerate(refs.cells["cell"])}

    def angle(score: np.ndarray) -> np.ndarray:
        """The distance that belongs to a score (-inf: any)."""
        if metric == "cosine":
            return np.where(np.isfinite(score), np.arccos(np.clip(score, -1.0, 1.0)), np.inf)
        return -score

    def search(q: dict, r: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        out, asked = [], 0
        if len(q["key"]) and len(r["key"]):
            if metric == "cosine":
                r = r | {"single": r["vec"].astype(np.float32)}
            by_cell = np.argsort(r["cell"], kind="stable")
            ids, starts = np.unique(r["cell"][by_cell], return_index=True)
            ends = np.append(starts[1:], len(by_cell))
            at = np.array([where[int(c)] for c in ids])
            order = np.argsort(q["cell"], kind="stable")
            cuts = np.flatnonzero(np.diff(q["cell"][order], prepend=-1))
            for x, y in zip(cuts, np.append(cuts[1:], len(order))):
                for z in range(x, y, _ROWS):
                    mine = order[z:min(z + _ROWS, y)]
                    rows, cols, score, n = chunk(take(q, mine), r, by_cell, starts, ends, bound(q["vec"][mine], at))
                    out.append((mine[rows], cols, score))
                    asked += n
        if not out:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0), asked
        return *(np.concatenate(v) for v in zip(*out)), asked

    def chunk(q: dict, r: dict, by_cell, starts, ends, low):
        v, least = q["vec"], q["least"].astype(float).copy()
        single = v.astype(np.float32) if metric == "cosine" else None
        # products of unit rows in single precision choose the candidates: d + 2 roundings of at most the sum of |a_i b_i| <= 1
        room = _ROUND + 1.01 * (v.shape[1] + 8) * _ROUND32 if metric == "cosine" else slack + 1e-7 * np.sqrt(max((v * v).sum(1).max(), (r["vec"][by_cell[starts]] ** 2).sum(1).max()))
        nearest = np.lexsort((low.mean(axis=0), low.min(axis=0)))
        best = (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0))
        asked, i = 0, 0
        while i < len(nearest):
            want = 4 * (k + 1) if i == 0 and not np.isfinite(least).all() else _COLS
            wide, part = 0, []
            reach = (angle(least) + slack)[:, None]
            while i < len(nearest) and wide < want:
                c = nearest[i]
                i += 1
                if (low[:, [c]] <= reach).any():
                    part.append(by_cell[starts[c]:ends[c]])
                    wide += len(part[-1])
            every = np.concatenate(part) if part else np.zeros(0, dtype=np.int64)
            for s in range(0, len(every), _COLS):
                cols = every[s:s + _COLS]
                asked += len(v) * len(cols)
                m = single @ r["single"][cols].T if metric == "cosine" else -euclidean(v, r["vec"][cols])
                hit = m >= np.nextafter((least - room).astype(m.dtype), -np.inf)[:, None]
                if np.count_nonzero(hit) > 4 * (k + 1) * len(v) and len(cols) > k + 1:
                    kth = -np.partition(-np.where(np.isfinite(m), m, -np.inf), k, axis=1)[:, k]     # one more than k: the row itself
                    hit &= m >= np.nextafter((kth - 2 * room).astype(m.dtype), -np.inf)[:, None]      # both sides are rounded
                rows, c = np.nonzero(hit)
                if exclude_self:
                    others = q["key"][rows] != r["key"][cols[c]]
                    rows, c = rows[others], c[others]
                if not len(rows):
                    continue
                exact = np.concatenate([_scored(v[rows[t:t + 65536]], r["vec"][cols[c[t:t + 65536]]]) for t in range(0, len(rows), 65536)])
                keep = np.isfinite(exact) & (exact >= least[rows])
                rows, c, score = (np.concatenate(p) for p in zip(best, (rows[keep], cols[c[keep]], exact[keep])))
                top = _best(rows, c, score, r["key"], k)
                best = rows[top], c[top], score[top]
                edge = np.searchsorted(best[0], np.arange(len(v) + 1))
                full = np.flatnonzero(np.diff(edge) == k)
                least[full] = np.maximum(least[full], best[2][edge[full + 1] - 1])
        return *best, asked

    def _scored(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (a * b).sum(axis=1) if metric == "cosine" else -np.sqrt(((a - b) ** 2).sum(axis=1))

    return search, angle


def _found(q: dict, r: dict, rows: np.ndarray, cols: np.ndarray, score: np.ndarray, k: int, every: bool) -> tuple:
    """Keys of the rows (all of them, or those with a find), and their finds as lists."""
    top = _best(rows, cols, score, r["key"], k) if len(rows) else np.zeros(0, dtype=np.int64)
    rows, cols, score = rows[top], cols[top], score[top]
    ours = np.arange(len(q["key"])) if every else np.unique(rows)
    starts = np.append(np.searchsorted(rows, ours), len(rows))
    return ours, starts, r["key"][cols] if len(cols) else np.zeros(0, dtype=np.int64), 0.0 - score


def _home_pairs(queries: PivotIndex, refs: PivotIndex) -> list[tuple[int, int]]:
    """The group of the references that each group of queries is compared with first."""
    if queries is refs:
        return [(g, g) for g in range(refs.n_groups)]
    cells, held = queries.cells["cell"].to_numpy(), queries.in_groups()
    theirs = refs.cells["cell"].to_numpy()
    real = np.flatnonzero(theirs != ZERO_CELL)
    out = []
    for g in range(queries.n_groups):
        own = cells[held[:, g]]
        own = own[own != ZERO_CELL]
        near = 0
        if len(own) and len(real):
            near = real[distances(refs.metric, refs.pivots[own[[len(own) // 2]]], refs.pivots[theirs[real]])[0].argmin()]
        out.append((g, int(refs.cells["group_lo"].iloc[near])))
    return out


def knn_routes(queries: PivotIndex, refs: PivotIndex, k: int, exclude_self: bool) -> DataFrame:
    """Every query row with its best rows of its home group, and the other groups that can hold nearer ones.

    The k-th score of the home group is a bound; a group is left out when the triangle
    inequality leaves no room for a row within it. Without k rows at home no group is. ``asked`` and ``left`` count
    the pairs compared at home and the row's pairs with the cells left in other groups.
    """
    same, dims = queries is refs, refs.pivots.shape[1] if refs.pivots.ndim == 2 else 0
    search, angle = _searcher(refs, k, exclude_self)
    bound, slack = refs.row_bound(), refs.slack()
    at, held = np.arange(len(refs.cells)), refs.in_groups()
    sizes = refs.cells["n"].to_numpy(dtype=float)
    share = held / np.maximum(held.sum(axis=1, keepdims=True), 1) * sizes[:, None]        # rows of a cell in a group, evenly dealt
    home = _home_pairs(queries, refs) if len(refs.cells) else []

    def route(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = read_group(batches, dims)
        got["least"] = np.full(len(got["key"]), -np.inf)
        q = take(got, got["_side"] == 0)
        if not len(q["key"]):
            return
        r, b = q if same else take(got, got["_side"] == 1), key[1].as_py()
        rows, cols, score, asked = search(q, r)
        ours, starts, keys, neg = _found(q, r, rows, cols, score, k, True)
        full = np.flatnonzero(np.diff(starts) == k)
        least = q["least"]
        least[full] = -neg[starts[full + 1] - 1]
        for s in range(0, len(ours), 4096):
            e = min(s + 4096, len(ours))
            v = q["vec"][s:e]
            near = bound(v, at) <= (angle(least[s:e]) + slack)[:, None]
            groups = near.astype(np.float32) @ held.astype(np.float32) > 0
            groups[:, b] = False
            left = near @ share
            left[:, b] = 0.0
            row, group = np.nonzero(groups)
            cut = slice(starts[s], starts[e])
            yield pa.RecordBatch.from_arrays([
                pa.array(q["key"][s:e]), _lists(v.ravel(), np.arange(len(v) + 1) * v.shape[1], pa.float64()), pa.array(q["cell"][s:e], pa.int32()),
                pa.array(np.full(e - s, key[0].as_py()), pa.int32()), pa.array(least[s:e]), _lists(keys[cut], starts[s:e + 1] - starts[s], pa.int64()),
                _lists(neg[cut], starts[s:e + 1] - starts[s], pa.float64()), _lists(group, np.searchsorted(row, np.arange(len(v) + 1)), pa.int32()),
                pa.array(np.where(np.arange(s, e) == 0, asked, 0), pa.int64()), pa.array(left.sum(axis=1).astype(np.int64))],
                names=[c.split()[0] for c in _ROUTES.split(", ")])

    cols = ["grp", "cell", "vec"]
    both = ship(queries.rows.select(F.col(queries.key).alias("key"), *cols), home, 0, 0)
    if not same:
        both = both.unionByName(ship(refs.rows.select(F.col(refs.key).alias("key"), *cols), home, 1, 1))
    return materialize(by_pair(both, len(home)).applyInArrow(route, _ROUTES), "knn-routes")


def knn_compared(routes: DataFrame, refs: PivotIndex) -> int:
    """Row pairs that the routes compare: those of the home groups and those left."""
    return int(routes.agg(F.sum(F.col("asked") + F.col("left"))).first()[0] or 0)


def _nearest(queries: PivotIndex, refs: PivotIndex, k: int, exclude_self: bool) -> DataFrame:
    """(sample_key, neighbor_key, score, rank), exact; ties to the smaller neighbour key.

    Two groups meet in one task, each way at once when the queries are the references.
    """
    same, dims = queries is refs, refs.pivots.shape[1] if refs.pivots.ndim == 2 else 0
    routes = knn_routes(queries, refs, k, exclude_self)
    far = {(r[0], r[1]) for r in routes.select("grp", F.explode("away")).distinct().collect()}      # pairs of groups
    pairs = sorted({(min(p), max(p)) for p in far}) if same else sorted(far)
    search, _ = _searcher(refs, k, exclude_self)

    def nearer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = read_group(batches, dims)
        sides = [take(got, got["_side"] == s) for s in (0, 1)]
        for q, r in (sides, sides[::-1])[:2 if same else 1]:
            rows, cols, score, _ = search(q, r)
            ours, starts, keys, neg = _found(q, r, rows, cols, score, k, False)
            yield pa.RecordBatch.from_arrays([pa.array(q["key"][ours]), _lists(keys, starts, pa.int64()), _lists(neg, starts, pa.float64())],
                                             names=[c.split()[0] for c in _FOUND.split(", ")])

    cols = ["key", "grp", "cell", "vec", "least"]
    if same:
        both = ship(routes.select(cols), pairs, 0, 0).unionByName(ship(routes.select(cols), pairs, 1, 1))
    else:
        left = routes.select(F.col("grp").alias("_a"), F.explode("away").alias("_b"), F.lit(0).cast("byte").alias("_side"), *cols)
        own = refs.rows.select(F.col(refs.key).alias("key"), "grp", "cell", "vec", F.lit(0.0).alias("least"))
        both = left.unionByName(ship(own, pairs, 1, 1))
    found = routes.select("key", "neighbor_key", "neg")
    if pairs:
        found = found.unionByName(by_pair(both, len(pairs)).applyInArrow(nearer, _FOUND))
    merged = found.groupBy("key").agg(F.flatten(F.collect_list(F.arrays_zip("neg", "neighbor_key"))).alias("f"))
    return (merged.select(F.col("key").alias("sample_key"), F.posexplode(F.slice(F.array_sort("f"), 1, k)).alias("rank", "f"))
            .select("sample_key", F.col("f.neighbor_key").alias("neighbor_key"), (-F.col("f.neg")).alias("score"), (F.col("rank") + 1).alias("rank")))


def knn_candidates(points: DataFrame, k: int, key: str = "sample_key", vec: str = "vec",
                   block_rows: int = 2000, metric: str = "cosine") -> DataFrame:
    """(sample_key, neighbor_key, cosine | distance, rank): the k nearest other rows, exact.

    ``metric="cosine"``: highest cosine similarity; ``"euclidean"``: lowest distance. Every
    row is compared with its own block first; its k-th score there rules out the blocks
    that cannot hold a nearer row (ties: lower neighbour key). Rows with a NULL vector take no part.
    """
    index = PivotIndex(points, key, vec, metric, block_rows)
    out = _nearest(index, index, k, True)
    if metric == "cosine":
        return out.withColumnRenamed("score", "cosine")
    return out.withColumn("distance", -F.col("score")).drop("score")


def threshold_edges(points: DataFrame, threshold: float, key: str = "sample_key",
                    vec: str = "vec", block_rows: int = 2000, index: PivotIndex | None = None) -> DataFrame:
    """(source, target, weight): every pair with cosine ≥ threshold, source < target, exact."""
    index = index or PivotIndex(points, key, vec, "cosine", block_rows)
    reach = math.acos(max(-1.0, min(1.0, threshold)))
    pivots, slack, key = index.pivots, index.slack(), index.key
    radius = dict(zip(index.cells["cell"], index.cells["hi"]))

    def close(v: np.ndarray, block: int) -> np.ndarray:
        """Rows of v that can be within reach of some row of the block."""
        cell = block // _SUB
        if cell == ZERO_CELL:
            return np.ones(len(v), dtype=bool)
        return (distances("cosine", v, pivots[[cell]])[:, 0] - radius[cell] <= reach + slack) | ((v * v).sum(1) == 0)

    def edges(block_a: int, block_b: int, own: dict, other: dict) -> dict:
        a, b, lk, rk = own["vec"], other["vec"], own[key], other[key]
        if block_a != block_b:
            ka, kb = close(a, block_b), close(b, block_a)
            a, b, lk, rk = a[ka], b[kb], lk[ka], rk[kb]
        s = a @ b.T
        hit = s >= threshold
        # inside a block the key order keeps each pair once
        hit &= lk[:, None] < rk[None, :] if block_a == block_b else lk[:, None] != rk[None, :]
        i, j = np.nonzero(hit)
        return {"source": np.minimum(lk[i], rk[j]), "target": np.maximum(lk[i], rk[j]), "weight": s[i, j]}

    return meet(index, index.rows.select("grp", "cell", "block", key, "vec"), reach, edges, "source long, target long, weight double")


def _cells(side: dict, labels: list[str]) -> dict:
    """The rows of a group ordered by their labels, and the runs of equal labels: ``starts``, ``ends`` and the labels of each."""
    own = np.stack([side[c] for c in labels], axis=1)
    order = np.lexsort(own.T)
    side, own = take(side, order), own[order]
    starts = np.flatnonzero(np.append(True, (own[1:] != own[:-1]).any(axis=1))) if len(own) else np.zeros(0, dtype=np.int64)
    return {"key": side["key"], "vec": side["vec"], "asked": side["asked"], "own": own, "starts": starts,
            "ends": np.append(starts[1:], len(own)) if len(own) else starts, "labels": own[starts], "square": (side["vec"] ** 2).sum(axis=1)}


def _most_runs(first: np.ndarray, held: np.ndarray, group_rows: int) -> int:
    """The most clusters that a group has rows of, when clusters of ``held`` rows from place ``first`` on are cut into groups."""
    if not len(held):
        return 0
    lo, hi = first // group_rows, (first + held - 1) // group_rows
    steps = np.zeros(hi.max() + 2, dtype=np.int64)
    np.add.at(steps, lo, 1)
    np.subtract.at(steps, hi + 1, 1)
    return int(np.cumsum(steps).max())


def _add_runs(total: np.ndarray, d: np.ndarray, side: dict, lo: int, hi: int) -> None:
    """Add the sums of ``d`` over the runs of its columns, the rows lo to hi of ``side``, to the runs' columns of ``total``."""
    first, last = np.searchsorted(side["ends"], lo, side="right"), np.searchsorted(side["starts"], hi)
    if last - first > 64:
        total[:, first:last] += np.add.reduceat(d, np.maximum(side["starts"][first:last] - lo, 0), axis=1)
        return
    for c in range(first, last):
        total[:, c] += d[:, max(side["starts"][c] - lo, 0):side["ends"][c] - lo].sum(axis=1)


def _tiles(p: dict, q: dict, mirror: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distance sums of the rows of ``p`` over the runs of ``q`` and, with ``mirror``, of those of ``q`` over the runs of ``p``
    from the same distances; then the (row, run) pairs in which a row met its own key. With ``p`` twice a pair of tiles is computed once."""
    same = p is q
    there = np.zeros((len(p["key"]), len(q["starts"])))
    back = there if same else np.zeros((len(q["key"]), len(p["starts"]))) if mirror else None
    met = [np.zeros((2, 0), dtype=np.int64)]
    # |a|² + |b|² - 2 a·b as one product
    ours = np.hstack([-2.0 * p["vec"], p["square"][:, None], np.ones((len(p["key"]), 1))])
    theirs = np.hstack([q["vec"], np.ones((len(q["key"]), 1)), q["square"][:, None]])
    for x in range(0, len(p["key"]), _TILE):
        u = min(x + _TILE, len(p["key"]))
        for y in range(x if same and mirror else 0, len(q["key"]), _TILE):
            v = min(y + _TILE, len(q["key"]))
            d = np.matmul(ours[x:u], theirs[y:v].T)                   # the squared distances
            np.sqrt(np.maximum(d, 0.0, out=d), out=d)
            if q["group"] == p["group"]:                              # a row is not its own partner
                i, j = np.nonzero(p["key"][x:u, None] == q["key"][None, y:v])
                d[i, j] = 0.0
                met.append(np.stack([i + x, np.searchsorted(q["ends"], j + y, side="right")]))
                if mirror and x != y:
                    met.append(np.stack([j + y, np.searchsorted(p["ends"], i + x, side="right")]))
            _add_runs(there[x:u], d, q, y, v)
            if mirror and not (same and x == y):
                _add_runs(back[y:v], d.T, p, x, u)
    return there, back, *np.concatenate(met, axis=1)


def cluster_distance_sums(points: DataFrame, key: str = "sample_key", vec: str = "vec",
                          block_rows: int = 2000, rows: F.Column | None = None, labels: tuple = ("cluster_id",),
                          nearest_only: bool = False) -> DataFrame:
    """(labelling, sample_key, cluster_id, other_cluster, dist_sum, n_other): Σ Euclidean distance
    from each row to the rows of every cluster (noise excluded), exact.

    Rows are dealt to groups by the clusters of the first labelling, so that all but a few clusters (one a boundary) lie whole in a
    group. ``nearest_only`` leaves out sums that cannot be the lowest mean of a row: of the whole clusters of a group, other than
    the row's own, only the one of lowest mean distance leaves the task. So its rows do not grow with the number of clusters.

    ``labels``: the columns of the labellings, numbered from 0; a distance is computed once for all of them
    and for both of its rows. ``rows``: optional predicate choosing the rows whose sums are wanted (the
    distances still go to all rows); the other rows are only partners.
    """
    names = [f"c{i}" for i in range(len(labels))]
    some = F.lit(False)
    for c in labels:
        some = some | (F.col(c) >= 0)
    base = points.where(some).select(F.col(key).cast("long").alias("key"), F.col(vec).cast("array<double>").alias("vec"),
                                     *[F.coalesce(F.col(c).cast("int"), F.lit(-1)).alias(n) for c, n in zip(labels, names)],
                                     (F.lit(True) if rows is None else F.coalesce(rows, F.lit(False))).alias("asked"))
    size = base.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vec")).alias("d"), F.count_distinct(*names).alias("c")).first()
    spark = points.sparkSession
    clusters = base.groupBy("c0").agg(F.count(F.lit(1)).alias("n")).orderBy("c0").collect()         # one row per cluster
    held = np.array([r["n"] for r in clusters], dtype=np.int64)
    first = np.cumsum(held) - held
    # a task holds its rows' vectors and their sums over the other rows' runs of equal labels
    group_rows = max(block_rows, min(math.ceil(size["n"] / GROUPS), GROUP_BYTES // (8 * max(1, size["d"] or 1))))
    if len(labels) > 1:
        group_rows = max(block_rows, min(group_rows, GROUP_BYTES // (8 * max(1, size["c"]))))
    while group_rows > block_rows and 8 * group_rows * _most_runs(first, held, group_rows) > GROUP_BYTES and len(labels) == 1:
        group_rows = max(block_rows, group_rows // 2)
    nb, dims = n_blocks(size["n"], group_rows), size["d"] or 0
    complete = np.array([r["c0"] for r, lo, n in zip(clusters, first, held) if lo // group_rows == (lo + n - 1) // group_rows], dtype=np.int64)
    dealt = broadcast_if_small(spark.createDataFrame([(int(r["c0"]), int(lo), int(r["n"])) for r, lo in zip(clusters, first)], "c0 int, _first long, _n long"),
                               known_rows=len(clusters))
    at = F.col("_first") + F.floor(F.pmod(F.xxhash64("key"), F.lit(1 << 30)) / F.lit(float(1 << 30)) * F.col("_n"))
    base = base.join(dealt, "c0").withColumn("grp", F.floor(at / F.lit(group_rows)).cast("int")).drop("_first", "_n")
    pairs = [(a, b) for a in range(nb) for b in range(a, nb)]
    every = rows is None

    def told(own: dict, other: dict, total: np.ndarray, met_row: np.ndarray, met_run: np.ndarray) -> Iterator[pa.RecordBatch]:
        many = other["ends"] - other["starts"]
        for x in range(0, len(own["key"]), 8 * _ROWS):
            part = slice(x, x + 8 * _ROWS)
            n = np.tile(many, (len(own["key"][part]), 1))
            here = (met_row >= x) & (met_row < x + len(n))
            np.subtract.at(n, (met_row[here] - x, met_run[here]), 1)
            for i in range(len(names)):
                clusters = np.unique(other["labels"][:, i])
                clusters = clusters[clusters >= 0]
                if not len(clusters):
                    continue
                member = (other["labels"][:, [i]] == clusters).astype(float)
                at = np.flatnonzero(own["own"][part][:, i] >= 0)
                mine, keys = own["own"][part][at, i], own["key"][part][at]
                dist, n_other = total[part][at] @ member, (n[at] @ member).round().astype(np.int64)
                keep = np.ones(dist.shape, dtype=bool)
                if nearest_only and i == 0:
                    own_cluster, whole = clusters == mine[:, None], np.isin(clusters, complete)
                    mean = np.where(whole & ~own_cluster & (n_other > 0), dist / np.maximum(n_other, 1), np.inf)
                    keep = own_cluster | ~whole
                    keep[np.arange(len(at)), mean.argmin(axis=1)] = True
                r, c = np.nonzero(keep)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(r), i), pa.int32()), pa.array(keys[r]), pa.array(mine[r], pa.int32()), pa.array(clusters[c], pa.int32()),
                    pa.array(dist[r, c]), pa.array(n_other[r, c])],
                    names=["labelling", "sample_key", "cluster_id", "other_cluster", "dist_sum", "n_other"])

    def sums(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = read_group(batches, dims)
        left, right = (_cells(take(got, got["_side"] == s), names) | {"group": g.as_py()} for s, g in zip((0, 1), key))
        if key[0].as_py() == key[1].as_py():
            right = left
        if every:
            there, back, row, run = _tiles(left, right, True)
            yield from told(left, right, there, row, run)
            if right is not left:
                yield from told(right, left, back, row, run)
            return
        for own, other in [(left, right), (right, left)][:1 if right is left else 2]:
            asked = own["asked"].astype(bool)
            mine = {c: own[c][asked] for c in ("key", "vec", "own", "square")} | {"group": own["group"], "starts": own["starts"], "ends": own["ends"]}
            there, _, row, run = _tiles(mine, other, False)
            yield from told(mine, other, there, row, run)

    both = ship(base, pairs, 0, 0).unionByName(ship(base, [p for p in pairs if p[0] < p[1]], 1, 1))
    parts = by_pair(both, len(pairs)).applyInArrow(
        sums, "labelling int, sample_key long, cluster_id int, other_cluster int, dist_sum double, n_other long")
    return (parts.groupBy("labelling", "sample_key", "cluster_id", "other_cluster")
                 .agg(F.sum("dist_sum").alias("dist_sum"), F.sum("n_other").alias("n_other")))


def knn_between(queries: DataFrame, refs: DataFrame, k: int, key: str = "sample_key",
                vec: str = "vec", block_rows: int = 2000) -> DataFrame:
    """(sample_key, neighbor_key, cosine, rank): the k most cosine-similar reference rows
    of every query row, exact; queries are routed over the references' pivots."""
    ref_index = PivotIndex(refs, key, vec, "cosine", block_rows)
    query_index = PivotIndex(queries, key, vec, "cosine", block_rows, pivots=ref_index.pivots)
    return _nearest(query_index, ref_index, k, False).withColumnRenamed("score", "cosine")
