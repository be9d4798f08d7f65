"""Stable moments (D23, G6, G7), split quantiles (D4, D19) and the Gramian PCA (H2, E5) against NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lineagelab.operators.abundance import column_moments
from lineagelab.operators.gramian import correlation, variance_spectrum
from lineagelab.operators.profile import feature_means, numeric_summary, split_quantiles, variance_profile


def cells_of(spark, X):
    return spark.createDataFrame([(int(i), int(j), float(X[i, j])) for i, j in zip(*np.nonzero(X))], "sample_key long, feature_idx int, value double")


def test_moments_near_a_million_with_a_thousandth_of_spread(spark):
    rng = np.random.default_rng(0)
    X = np.zeros((400, 4))
    X[:, 0] = 1e6 + rng.normal(0, 1e-3, 400)
    X[:, 1] = np.where(rng.random(400) < 0.3, 1e6 + rng.normal(0, 1e-3, 400), 0)
    X[:, 2] = 1 / 3
    cells = cells_of(spark, X)
    samples = spark.range(400).select(F.col("id").alias("sample_key"), F.lit(0.0).alias("c"))
    features = spark.createDataFrame([(j,) for j in range(4)], "feature_idx int")
    got = sorted(column_moments(cells.withColumnRenamed("value", "s"), samples, features, 400).collect(), key=lambda r: r.feature_idx)
    exact = X.astype(np.longdouble)
    for j in range(4):
        assert got[j]["mean"] == pytest.approx(float(exact[:, j].mean()), rel=1e-14)
        assert got[j]["std"] == pytest.approx(float(exact[:, j].std()), rel=1e-6, abs=1e-12)
    assert [r.constant for r in got] == [False, False, True, True]
    by_feature = {r.feature_idx: r["std"] for r in feature_means(cells, 400).collect()}
    assert by_feature[0] == pytest.approx(float(exact[:, 0].std(ddof=1)), rel=1e-6)


def test_centred_moments_with_a_row_term(spark):
    rng = np.random.default_rng(1)
    X = np.where(rng.random((60, 5)) < 0.5, rng.gamma(2, 3, (60, 5)), 0)
    c = rng.normal(size=60)
    samples = spark.createDataFrame([(i, float(c[i])) for i in range(60)], "sample_key long, c double")
    features = spark.createDataFrame([(j,) for j in range(5)], "feature_idx int")
    got = sorted(column_moments(cells_of(spark, X).withColumnRenamed("value", "s"), samples, features, 60).collect(), key=lambda r: r.feature_idx)
    dense = X + c[:, None]
    assert np.allclose([r["mean"] for r in got], dense.mean(0)) and np.allclose([r["std"] for r in got], dense.std(0))


def test_quantiles_of_a_hot_group_and_small_ones(spark):
    rng = np.random.default_rng(2)
    rows = [(0, float(x)) for x in rng.integers(0, 700, 5000)] + [(1, 2.5), (2, 1.0), (2, 4.0), (3, None)] + [(None, 5.0), (None, 6.0), (None, 9.0)]
    df = spark.createDataFrame(rows, "g int, x double").repartition(7)
    probs = [0.0, 0.25, 0.5, 0.999, 1.0]
    got = {(r.g, r.prob): r.value for r in split_quantiles(df, "x", probs, ("g",)).collect()}
    for g in (0, 1, 2, None):
        own = [x for k, x in rows if k == g]
        for q in probs:
            assert got[(g, q)] == pytest.approx(np.quantile(own, q), abs=1e-9)
    assert len(got) == 4 * len(probs)                            # a group of NULLs has none
    text = spark.createDataFrame([("3",), ("na",), ("1.5",), (None,), ("x",), ("10",)], "age string")
    assert tuple(numeric_summary(text, "age").first()) == (3, 3.0, pytest.approx(14.5 / 3), 1.5, 10.0)
    assert tuple(numeric_summary(text.limit(0), "age").first()) == (0, None, None, None, None)


def test_no_range_of_a_hot_group_holds_twice_the_median(spark):
    df = spark.range(40_000).select(F.lit(1).alias("g"), (F.col("id") * 7919 % 40_000).cast("double").alias("x"))
    ranges = df.groupBy("g", "x").count().repartitionByRange(4, "g", "x").groupBy(F.spark_partition_id()).count()
    sizes = sorted(r["count"] for r in ranges.collect())
    assert len(sizes) == 4 and sizes[-1] < 2 * sizes[len(sizes) // 2]


def test_gramian_pca_equals_dense_pca(spark):
    rng = np.random.default_rng(3)
    X = np.where(rng.random((90, 12)) < 0.4, rng.gamma(2, 3, (90, 12)), 0)
    X[:, 5] = X[:, 2] * 2 + 0.1 * X[:, 7]
    X[:, 9] = 4.0                                                # constant
    X[70:] = 0                                                   # samples without any cell
    X[70:, 9] = 4.0
    X[80:, 9] = 4.0
    cells, samples = cells_of(spark, X), spark.range(90).select(F.col("id").alias("sample_key"))
    features = spark.createDataFrame([(j,) for j in range(12)], "feature_idx int")
    s = variance_spectrum(cells, samples, features, n_components=6)
    sd = X.std(0)
    Z = (X - X.mean(0)) / np.where(sd > 1e-12, sd, 1.0)
    want = np.linalg.eigvalsh(Z.T @ Z / 90)[::-1]
    assert np.allclose(s.eigenvalues, want, atol=1e-9) and np.allclose(s.ratios, (want / want.sum())[:6], atol=1e-9)
    assert np.allclose(s.components @ s.components.T, np.eye(6), atol=1e-9)
    assert np.allclose(((Z @ s.components.T) ** 2).mean(0), want[:6], atol=1e-8)
    assert all(c[np.abs(c).argmax()] > 0 for c in s.components)


def test_empty_samples_enter_the_gramian(spark):
    X = np.array([[1.0, 2.0], [3.0, 1.0], [0.0, 0.0], [0.0, 0.0]])
    got = correlation(cells_of(spark, X), 4, X.mean(0), X.std(0))
    assert np.allclose(got, np.corrcoef(X.T), atol=1e-12)
    with pytest.raises(ValueError):
        correlation(cells_of(spark, X), 4, np.zeros(5000), np.ones(5000))


def test_variance_thresholds(spark):
    ratios = spark.createDataFrame([(1, 0.4), (2, 0.2), (3, 0.15), (4, 0.05)], "component int, ratio double")
    cum, reach = variance_profile(ratios)
    assert [round(r.cumulative, 9) for r in cum.orderBy("component").collect()] == [0.4, 0.6, 0.75, 0.8]
    assert {r.target: r.component for r in reach.collect()} == {0.5: 2, 0.7: 3, 0.9: None}
