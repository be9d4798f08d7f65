"""The model checks accept right fits and count planted faults."""

import numpy as np
import pytest

from lineagelab.operators import model_checks as C
from lineagelab.operators import models as M
from lineagelab.params import ClusterParams


@pytest.fixture(scope="module")
def blobs(spark):
    rng = np.random.default_rng(7)
    x = np.concatenate([rng.normal(c, 0.5, (40, 3)) for c in ((0, 0, 0), (6, 0, 0), (0, 6, 6))])
    return x, spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "sample_key long, pca array<double>")


def test_kmeans_checks_count_a_moved_label(spark, blobs):
    x, points = blobs
    centers = [x[i * 40:(i + 1) * 40].mean(axis=0).tolist() for i in range(3)]
    cost = sum(((x[i * 40:(i + 1) * 40] - centers[i]) ** 2).sum() for i in range(3))
    right = spark.createDataFrame([(i, i // 40) for i in range(120)], "sample_key long, cluster_id int")
    r = C.kmeans_checks(points, right, centers, cost).first()
    assert (r.n_rows, r.n_clusters, r.n_misplaced) == (120, 3, 0) and r.inertia_ratio == pytest.approx(1.0)
    wrong = spark.createDataFrame([(i, 1 if i == 0 else i // 40) for i in range(120)], "sample_key long, cluster_id int")
    r = C.kmeans_checks(points, wrong, centers, cost).first()
    assert r.n_misplaced == 1 and r.inertia_ratio > 1.05


def test_pca_checks_see_correlated_scores_and_wrong_shares(spark, blobs):
    x, points = blobs
    x = x - x.mean(axis=0)
    values, vectors = np.linalg.eigh(np.cov(x.T))
    scores, share = (x @ vectors)[:, ::-1], (values / values.sum())[::-1]
    frame = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(scores)], "sample_key long, pca array<double>")
    rows = C.pca_checks(frame, [float(s) for s in share]).collect()
    assert all(r.centre < 1e-9 and r.against_other < 1e-9 and r.total_variance == pytest.approx(values.sum()) for r in rows)
    raw = C.pca_checks(points, [float(s) for s in share]).collect()
    assert max(r.against_other for r in raw) > 0.3 and max(r.centre for r in raw) > 0.1
    assert len({round(r.total_variance, 3) for r in raw}) > 1
    assert C.pca_checks(frame.limit(0), [1.0]).count() == 0


def test_mixture_checks_hold_of_a_fit_and_not_of_shifted_means(blobs):
    _, points = blobs
    _, info = M.fit_gmm(points, "pca", ClusterParams(gmm_n_init=1, gmm_max_iter=20), k=3)
    r = C.mixture_checks(points, info).first()
    assert r.n_rows == 120 and r.weight_total == pytest.approx(1.0)
    assert r.mean_gap < 1e-9 and r.spread_ratio == pytest.approx(1.0)
    assert r.penalty == pytest.approx((3 * 3 + 3 * 6 + 2) * (np.log(120) - 2))
    moved = {**info, "means": [[m[0] + 1.0, *m[1:]] for m in info["means"]]}
    assert C.mixture_checks(points, moved).first().mean_gap > 0.1


def test_mixture_separates_in_many_dimensions(spark):
    rng = np.random.default_rng(3)
    spread = (1.0, 2.0, 1.5)
    x = np.concatenate([rng.normal(0.0, s, (300, 40)) + m * np.eye(40)[0] for s, m in zip(spread, (-14.0, 0.0, 16.0))])
    points = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "sample_key long, pca array<double>").repartition(3)
    labels, info = M.fit_gmm(points, "pca", ClusterParams(gmm_n_init=3), k=3)
    got = {r.sample_key: r.cluster_id for r in labels.collect()}
    assert len(got) == 900
    for part in range(3):
        own = [got[i] for i in range(part * 300, part * 300 + 300)]
        assert max(own.count(c) for c in range(3)) >= 297
    assert len({got[0], got[300], got[600]}) == 3
    # the log-likelihood of the returned mixture, computed apart
    w, mu, cov = (np.array(info[c]) for c in ("weights", "means", "covs"))
    joint = np.stack([np.log(w[j]) - 0.5 * (40 * np.log(2 * np.pi) + np.linalg.slogdet(cov[j])[1]
                                            + np.einsum("ij,jk,ik->i", x - mu[j], np.linalg.inv(cov[j]), x - mu[j])) for j in range(3)], axis=1)
    assert info["log_likelihood"] == pytest.approx(np.logaddexp.reduce(joint, axis=1).sum(), rel=1e-4)
    assert info["log_likelihood"] == max(info["log_likelihood_by_restart"])


def test_importance_checks_count_gaps_and_disorder(spark):
    table = spark.createDataFrame(
        [(0, 1, 5, 0.5), (0, 2, 6, 0.4), (1, 1, 5, 0.1), (1, 3, 6, 0.05), (2, 1, 5, 0.1), (2, 2, 5, 0.2), (-99, 1, 5, 0.6), (-99, 2, 6, 0.4)],
        "cluster_id int, rank int, feature_idx int, importance_score double")
    every = spark.createDataFrame([(0.6, 60.0), (0.4, 40.0)], "importance_score double, importance_pct double")
    got = {r.cluster_id: r for r in C.importance_checks(every, table).collect()}
    assert (got[0].rank_gaps, got[0].out_of_order, got[0].score_total) == (0, 0, None)
    assert got[1].rank_gaps == 1                               # rank 2 is missing
    assert (got[2].rank_gaps, got[2].out_of_order) == (1, 1)   # one feature twice, and rising
    assert got[-99].score_total == pytest.approx(1.0) and got[-99].pct_total == pytest.approx(100.0)


def test_forest_tasks_do_not_grow_with_the_partitions(spark, blobs):
    x, points = blobs
    labels = spark.createDataFrame([(i, i // 40 - (1 if i < 40 else 0)) for i in range(120)], "sample_key long, cluster_id int").repartition(30)
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        rows = M.training_rows(points.withColumnRenamed("pca", "features").repartition(30), labels)
        assert rows.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism
        assert {(r._y, r.w) for r in rows.collect()} == {(1.0, 1.0), (2.0, 1.0)} and rows.count() == 80
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
