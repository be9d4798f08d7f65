"""Cluster geometry: sizes, centroids, distances, novelty, nearest centroid.

Every per-cluster statistic is a ``groupBy(cluster_id)`` with map-side
partial aggregation, never a window partitioned by cluster: one cluster may
hold a third of all rows. The resulting tables have one row per cluster and
are broadcast back (size checked).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scores import euclidean, novelty_class, rnd
from ..params import NOISE_LABEL
from ..session import broadcast_if_small


def cluster_sizes(assignments: DataFrame) -> DataFrame:
    """(cluster_id, size, is_noise, share)."""
    total = assignments.count()
    return (assignments.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("size"))
                       .select("cluster_id", "size",
                               (F.col("cluster_id") == NOISE_LABEL).alias("is_noise"),
                               rnd(F.col("size") / F.lit(float(max(total, 1)))).alias("share")))


def centroids(points: DataFrame, vec_col: str = "vec") -> DataFrame:
    """(cluster_id, centroid array<double>, size) over non-noise rows.

    The vectors are exploded to (cluster, position, value) inside each task and
    averaged with partial aggregation, so only k·d partial sums are shuffled.
    """
    members = points.where(F.col("cluster_id") >= 0)
    cells = members.select("cluster_id", F.posexplode(vec_col).alias("pos", "x"))
    means = cells.groupBy("cluster_id", "pos").agg(F.avg("x").alias("m"))
    sizes = members.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("size"))
    vecs = (means.groupBy("cluster_id")
                 .agg(F.sort_array(F.collect_list(F.struct("pos", "m"))).alias("lst"))
                 .select("cluster_id", F.transform("lst", lambda e: e["m"]).alias("centroid")))
    return vecs.join(sizes, "cluster_id")


def member_distances(points: DataFrame, cents: DataFrame, vec_col: str = "vec") -> DataFrame:
    """(sample_key, cluster_id, distance) to the row's own centroid (noise rows: NULL)."""
    c = broadcast_if_small(cents.select("cluster_id", "centroid"))
    return (points.join(c, "cluster_id", "left")
                  .select("sample_key", "cluster_id",
                          euclidean(F.col(vec_col), F.col("centroid")).alias("distance")))


def distance_ranges(dist: DataFrame) -> DataFrame:
    """(cluster_id, d_min, d_max) per non-noise cluster."""
    return (dist.where(F.col("cluster_id") >= 0)
                .groupBy("cluster_id")
                .agg(F.min("distance").alias("d_min"), F.max("distance").alias("d_max")))


def novelty(points: DataFrame, vec_col: str = "vec", cents: DataFrame | None = None) -> DataFrame:
    """(sample_key, cluster_id, distance, novelty_score, novelty_class).

    Distance to the own centroid scaled min–max within the cluster; noise → 1;
    a cluster whose members are all equally far → 0.
    """
    cents = cents if cents is not None else centroids(points, vec_col)
    dist = member_distances(points, cents, vec_col)
    rng = broadcast_if_small(distance_ranges(dist))
    j = dist.join(rng, "cluster_id", "left")
    score = (F.when(F.col("cluster_id") == NOISE_LABEL, F.lit(1.0))
              .when(F.col("d_max") > F.col("d_min"),
                    (F.col("distance") - F.col("d_min")) / (F.col("d_max") - F.col("d_min")))
              .otherwise(F.lit(0.0)))
    return j.select("sample_key", "cluster_id", "distance", score.alias("novelty_score"),
                    novelty_class(score).alias("novelty_class"))


def nearest_centroid(points: DataFrame, cents: DataFrame, vec_col: str = "vec") -> DataFrame:
    """(sample_key, assigned_cluster, assigned_distance): nearest centroid.

    Each row is compared with every centroid inside its own task: the centroid
    array (k × d) is broadcast as a literal-sized column, not joined row by
    row. Ties go to the lower cluster id; no centroid → (−1, NULL).
    """
    rows = cents.select("cluster_id", "centroid").collect()
    if not rows:
        return points.select("sample_key", F.lit(NOISE_LABEL).alias("assigned_cluster"),
                             F.lit(None).cast("double").alias("assigned_distance"))
    ids = [int(r["cluster_id"]) for r in rows]
    vecs = [[float(x) for x in r["centroid"]] for r in rows]
    table = F.array(*[F.struct(F.lit(i).alias("cid"), F.lit(v).alias("c")) for i, v in zip(ids, vecs)])
    cand = F.transform(table, lambda e: F.struct(euclidean(F.col(vec_col), e["c"]).alias("d"),
                                                 e["cid"].alias("cid")))
    best = F.array_min(cand)
    return points.select("sample_key", best["cid"].alias("assigned_cluster"),
                         best["d"].alias("assigned_distance"))


def novelty_from_distance(assigned: DataFrame, ranges: DataFrame) -> DataFrame:
    """Novelty of new points from stored per-cluster (d_min, d_max).

    (d − d_min)/(d_max − d_min) clamped to [0, 1]; noise or unknown cluster → 1;
    a flat cluster → 0.
    """
    r = broadcast_if_small(ranges.select(F.col("cluster_id").alias("assigned_cluster"),
                                         "d_min", "d_max"))
    j = assigned.join(r, "assigned_cluster", "left")
    score = (F.when((F.col("assigned_cluster") < 0) | F.col("d_max").isNull(), F.lit(1.0))
              .when(F.col("d_max") <= F.col("d_min"), F.lit(0.0))
              .otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0),
                  (F.col("assigned_distance") - F.col("d_min")) / (F.col("d_max") - F.col("d_min"))))))
    return j.withColumn("novelty_score", score).withColumn("novelty_class", novelty_class(score)) \
            .drop("d_min", "d_max")
