"""What must hold of fitted models, measured on their stored results.

Seeded fits cannot be recomputed in SQL, but each has identities that any right fit keeps and most
wrong ones break. Every check is an aggregation over the rows; only k- or D-sized numbers reach the
driver. With fewer than two rows the PCA and mixture checks give no rows; a number without meaning
is null.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Correlation, Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..params import GLOBAL_IMPORTANCE_CLUSTER
from .clusters import nearest_centroid


def _moments(vectors: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """Rows, mean and sample variance of the vector column ``_v`` (no rows: 0 and empty arrays)."""
    if vectors.isEmpty():                                      # the summarizer raises on nothing
        return 0, np.zeros(0), np.zeros(0)
    s = vectors.agg(Summarizer.metrics("count", "mean", "variance").summary(F.col("_v")).alias("s")).first().s
    return int(s["count"]), s["mean"].toArray(), s["variance"].toArray()


def pca_checks(reduced: DataFrame, explained: list[float], col: str = "pca") -> DataFrame:
    """component, centre, against_other, total_variance of the stored scores.

    The scores of a PCA have mean 0 (``centre``: mean over spread), are uncorrelated (``against_other``:
    largest absolute correlation with another component), and each one's variance over its stated share is
    the same number: the total variance of the input.
    """
    spark = reduced.sparkSession
    v = reduced.select(array_to_vector(col).alias("_v"))
    n, mean, var = _moments(v)
    if n < 2:
        return spark.createDataFrame([], "component int, centre double, against_other double, total_variance double")
    corr = np.abs(Correlation.corr(v, "_v").first()[0].toArray())
    np.fill_diagonal(corr, 0.0)
    rows = [(i + 1, float(abs(mean[i]) / np.sqrt(var[i])) if var[i] > 0 else None, float(corr[i].max()),
             float(var[i] / explained[i]) if explained[i] > 0 else None) for i in range(len(explained))]
    return spark.createDataFrame(rows, "component int, centre double, against_other double, total_variance double")


def kmeans_checks(points: DataFrame, labels: DataFrame, centers: list[list[float]], cost: float, col: str = "pca") -> DataFrame:
    """n_rows, n_clusters, n_misplaced, inertia_ratio in one row.

    ``n_misplaced`` counts rows whose label is not a nearest centre (ties within rounding are no fault);
    ``inertia_ratio`` is the summed squared distance to the labelled centre over the reported cost.
    """
    spark = points.sparkSession
    cents = spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(centers)], "cluster_id int, centroid array<double>")
    near = nearest_centroid(points, cents, col)
    own = (points.join(labels, "sample_key").join(F.broadcast(cents), "cluster_id")                # k rows
           .select("sample_key", "cluster_id", F.aggregate(
               F.zip_with(col, "centroid", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda acc, x: acc + x).alias("d2")))
    off = F.col("d2") > F.col("assigned_distance") * F.col("assigned_distance") * (1 + 1e-9) + 1e-9
    return own.join(near, "sample_key").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct("cluster_id").alias("n_clusters"),
        F.count(F.when(off, 1)).alias("n_misplaced"),
        (F.sum("d2") / F.lit(float(cost))).alias("inertia_ratio"))


def mixture_checks(points: DataFrame, info: dict, col: str = "pca") -> DataFrame:
    """n_rows, weight_total, mean_gap, spread_ratio, penalty in one row.

    Whatever the responsibilities, a maximisation step leaves a mixture whose mean is the data's
    (``mean_gap``: largest difference over the data's spread) and whose second moments add up to the
    data's (``spread_ratio`` of the traces). ``penalty`` is BIC − AIC, a function of n, k and d alone.
    """
    shape = "n_rows long, weight_total double, mean_gap double, spread_ratio double, penalty double"
    n, mean, var = _moments(points.select(array_to_vector(col).alias("_v")))
    if n < 2:
        return points.sparkSession.createDataFrame([], shape)
    w, mu, cov = np.array(info["weights"]), np.array(info["means"]), np.array(info["covs"])
    mixed = w @ mu
    spread = var * (n - 1) / n
    second = float((w * (np.trace(cov, axis1=1, axis2=2) + (mu * mu).sum(axis=1))).sum())
    row = (n, float(w.sum()), float(np.abs(mixed - mean).max() / np.sqrt(spread.max())),
           second / float(spread.sum() + (mean * mean).sum()), float(info["bic"] - info["aic"]))
    return points.sparkSession.createDataFrame([row], shape)


def importance_checks(everything: DataFrame, table: DataFrame) -> DataFrame:
    """cluster_id, n_rows, rank_gaps, out_of_order, score_total, pct_total for every list of ``table``.

    Ranks run from 1 without gaps and scores never rise with the rank; the shares of all features
    (``everything``, uncut) add up to 1 and 100, given with the global list.
    """
    # lists are short (the operator's top counts), so the rank before each row is an equi-join
    before = table.select("cluster_id", (F.col("rank") + 1).alias("rank"), F.col("importance_score").alias("_above"))
    lists = table.join(before, ["cluster_id", "rank"], "left").groupBy("cluster_id").agg(
        F.count(F.lit(1)).alias("n_rows"),
        (F.max("rank") - F.count_distinct("rank") + F.count(F.lit(1)) - F.count_distinct("feature_idx")).cast("long").alias("rank_gaps"),
        F.count(F.when(F.col("importance_score") > F.col("_above"), 1)).alias("out_of_order"))
    sums = everything.agg(F.sum("importance_score").alias("score_total"), F.sum("importance_pct").alias("pct_total"))
    return lists.join(F.broadcast(sums.withColumn("cluster_id", F.lit(GLOBAL_IMPORTANCE_CLUSTER))), "cluster_id", "left")   # one row
