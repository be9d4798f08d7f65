"""Pivot index: exact neighbours and edges, pruning on clustered rows, hot and degenerate cells."""

import numpy as np
import pytest

from lineagelab.operators.pairs import knn_between, knn_candidates, knn_compared, knn_routes, threshold_edges
from lineagelab.operators.pivots import PivotIndex


def frame(spark, X, first=0):
    return spark.createDataFrame([(first + i, [float(x) for x in row]) for i, row in enumerate(X)], "sample_key long, vec array<double>")


def clustered(n=600, d=12, k=20, noise=0.05, seed=1):
    rng = np.random.default_rng(seed)
    return rng.normal(size=(k, d))[rng.integers(0, k, n)] + rng.normal(0, noise, (n, d))


def cosines(a, b):
    unit = [m / np.where((s := np.linalg.norm(m, axis=1, keepdims=True)) == 0, 1, s) for m in (a, b)]
    return unit[0] @ unit[1].T


def hard_rows():
    X = clustered(150, 6, 5)
    X[20:90] = X[20]                     # one vector for many rows
    X[100] = X[101] = 0.0                # zero vectors
    return X


@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
@pytest.mark.parametrize("block_rows", [48, 5000])
def test_neighbours_match_brute_force(spark, metric, block_rows):
    X = hard_rows()
    s = cosines(X, X) if metric == "cosine" else -np.sqrt(((X[:, None] - X[None]) ** 2).sum(-1))
    np.fill_diagonal(s, -np.inf)
    name = "cosine" if metric == "cosine" else "distance"
    got = {}
    for r in knn_candidates(frame(spark, X), 4, block_rows=block_rows, metric=metric).collect():
        got.setdefault(r.sample_key, []).append((r["rank"], r[name]))
    assert len(got) == len(X)
    for i in range(len(X)):
        want = np.sort(s[i])[::-1][:4] * (1 if metric == "cosine" else -1)
        assert np.allclose([v for _, v in sorted(got[i])], want, atol=1e-6)


@pytest.mark.parametrize("threshold", [0.9, 0.0, -1.0])
def test_edges_match_brute_force(spark, threshold):
    X = hard_rows()
    s = cosines(X, X)
    near = np.abs(s - threshold) < 1e-9  # equal to the threshold up to rounding: either answer
    got = {(r.source, r.target): r.weight for r in threshold_edges(frame(spark, X), threshold, block_rows=48).collect()}
    for i in range(len(X)):
        for j in range(i + 1, len(X)):
            if not near[i, j]:
                assert ((i, j) in got) == (s[i, j] >= threshold)
    assert all(i < j for i, j in got)


def test_queries_against_references(spark):
    refs, queries = hard_rows(), np.vstack([clustered(60, 6, 5, seed=4), np.zeros((1, 6))])
    s = cosines(queries, refs)
    got = {}
    for r in knn_between(frame(spark, queries, 1000), frame(spark, refs), 5, block_rows=48).collect():
        got.setdefault(r.sample_key - 1000, []).append((r["rank"], r.cosine))
    assert len(got) == len(queries)
    for i in range(len(queries)):
        assert np.allclose([v for _, v in sorted(got[i])], np.sort(s[i])[::-1][:5], atol=1e-9)


def test_clustered_rows_compare_a_tenth_of_all_pairs_at_most(spark):
    X = clustered(1200, 16, 30, 0.03)
    index = PivotIndex(frame(spark, X), block_rows=160)
    work = index.compared(index.block_pairs(np.arccos(0.9))).first()
    assert work.all_pairs == 1200 * 1199 // 2 and work.compared_pairs <= work.all_pairs / 10
    routes = knn_routes(index, index, 5, True)
    assert knn_compared(routes, index) <= 1200 * 1199 / 10


def test_no_rows_and_one_row(spark):
    none = spark.createDataFrame([], "sample_key long, vec array<double>")
    assert knn_candidates(none, 3).count() == 0 and threshold_edges(none, 0.5).count() == 0
    one = spark.createDataFrame([(1, [1.0, 2.0]), (2, None)], "sample_key long, vec array<double>")
    assert knn_candidates(one, 3).count() == 0 and threshold_edges(one, 0.5).count() == 0


def test_rows_are_copied_once_per_group_however_many_blocks(spark):
    from lineagelab.operators.pivots import GROUPS, ship
    X = np.random.default_rng(5).normal(size=(1500, 16))         # nothing can be pruned
    index = PivotIndex(frame(spark, X), block_rows=20)
    pairs = index.group_pairs(np.pi)
    copies = ship(index.rows.select("grp", "cell"), pairs, 0, 0).count() + ship(index.rows.select("grp", "cell"), pairs, 1, 1).count()
    assert index.rows.select("block").distinct().count() >= 75 and copies <= (GROUPS + 3) * 1500
    assert copies <= 9 * 1500                                    # what all pairs cost in shuffled bytes


def test_equal_rows_in_many_groups_give_the_smallest_keys(spark):
    rng = np.random.default_rng(6)
    X = np.tile(rng.normal(size=(30, 9)), (20, 1))               # 20 copies of 30 rows
    got = {}
    for r in knn_candidates(frame(spark, X), 3, block_rows=25).collect():
        got.setdefault(r.sample_key, []).append((r["rank"], r.neighbor_key))
    for i in range(len(X)):
        same = [j for j in range(i % 30, len(X), 30) if j != i][:3]
        assert [k for _, k in sorted(got[i])] == same


def test_neighbours_that_single_precision_cannot_tell_apart(spark):
    """Scores that differ by less than a rounding of single precision: candidates come from rounded products, the order does not."""
    from lineagelab.operators.pairs import knn_candidates
    rng = np.random.default_rng(11)
    base = rng.normal(size=(4, 40))
    v = np.concatenate([b + 1e-5 * rng.normal(size=(60, 40)) for b in base])
    pts = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "sample_key long, vec array<double>")
    got = {}
    for r in knn_candidates(pts, 3, block_rows=40).collect():
        got.setdefault(r.sample_key, {})[r.rank] = r.neighbor_key
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    for i in range(len(u)):
        score = (u[i] * u).sum(axis=1)
        score[i] = -np.inf
        want = sorted(range(len(u)), key=lambda j: (-score[j], j))[:3]
        assert [got[i][r] for r in (1, 2, 3)] == want
