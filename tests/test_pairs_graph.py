"""Block-pair kNN / edges and connected components against brute force."""

import numpy as np
import pytest

from lineagelab.operators.graph import connected_components
from lineagelab.operators.pairs import knn_candidates, threshold_edges


def _pts(spark, n=90, d=5, seed=3):
    rng = np.random.default_rng(seed)
    X = rng.normal(size=(n, d))
    df = spark.createDataFrame([(i, X[i].tolist()) for i in range(n)], "sample_key long, vec array<double>")
    return X, df


def test_knn_exact_over_blocks(spark):
    X, df = _pts(spark)
    U = X / np.linalg.norm(X, axis=1, keepdims=True)
    S = U @ U.T
    np.fill_diagonal(S, -np.inf)
    got = {}
    for r in knn_candidates(df, 4, block_rows=20).collect():
        got.setdefault(r["sample_key"], []).append((r["rank"], r["neighbor_key"]))
    for i in range(len(X)):
        want = list(np.argsort(-S[i], kind="stable")[:4])
        assert [k for _, k in sorted(got[i])] == want


def test_edges_exact_over_blocks(spark):
    X, df = _pts(spark)
    U = X / np.linalg.norm(X, axis=1, keepdims=True)
    S = U @ U.T
    want = {(i, j) for i in range(len(X)) for j in range(i + 1, len(X)) if S[i, j] >= 0.5}
    got = [(r["source"], r["target"]) for r in threshold_edges(df, 0.5, block_rows=20).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_connected_components(spark):
    rng = np.random.default_rng(7)
    n = 200
    edges = {(int(a), int(b)) for a, b in rng.integers(0, n, size=(150, 2)) if a != b}
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x
    for a, b in edges:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    comp_min = {}
    for v in range(n):
        comp_min.setdefault(find(v), []).append(v)
    want = {v: min(comp_min[find(v)]) for v in range(n)}
    e = spark.createDataFrame([(min(a, b), max(a, b), 1.0) for a, b in edges], "source long, target long, weight double")
    nodes = spark.createDataFrame([(v,) for v in range(n)], "id long")
    got = {r["node"]: r["component"] for r in connected_components(e, nodes).collect()}
    assert got == want


def test_more_blocks_than_rows(spark):
    rows = [(i, [float(i % 5) + 0.1, float(i % 3), 1.0 + i]) for i in range(12)]
    pts = spark.createDataFrame(rows, "sample_key long, vec array<double>")
    few = {(r.sample_key, r.neighbor_key) for r in knn_candidates(pts, 3, block_rows=1).collect()}
    one = {(r.sample_key, r.neighbor_key) for r in knn_candidates(pts, 3, block_rows=100).collect()}
    assert few == one and len(one) == 36


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1, 1.0) for i in range(80)], "source long, target long, weight double")
    got = connected_components(edges).collect()
    assert len(got) == 81 and {r.component for r in got} == {0}
    with pytest.raises(RuntimeError):
        connected_components(edges, max_rounds=2)
