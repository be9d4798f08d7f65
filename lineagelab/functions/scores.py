"""Scalar column expressions: classes, rounding, vector maths, labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..params import FingerprintParams

_FP = FingerprintParams()


def rnd(c: Column | str, digits: int = 6) -> Column:
    """Half-up rounding; ``+ 0.0`` turns -0.0 into 0.0 so hashes agree."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c, digits) + F.lit(0.0)


def diversity_class(score: Column, low: float = _FP.diversity_low,
                    high: float = _FP.diversity_high) -> Column:
    return (F.when(score < low, F.lit("Low"))
             .when(score < high, F.lit("Medium"))
             .otherwise(F.lit("High")))


def novelty_class(score: Column, common: float = _FP.novelty_common,
                  moderate: float = _FP.novelty_moderate) -> Column:
    return (F.when(score <= common, F.lit("Common"))
             .when(score <= moderate, F.lit("Moderately Unique"))
             .otherwise(F.lit("Highly Unique")))


def cluster_label(cluster_id: Column) -> Column:
    return (F.when(cluster_id == -1, F.lit("Noise"))
             .otherwise(F.concat(F.lit("Cluster "), cluster_id.cast("string"))))


def squared_distance(a: Column, b: Column) -> Column:
    """Σ (a_i − b_i)² of two equal-length double arrays."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0),
                       lambda acc, v: acc + v)


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(squared_distance(a, b))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, v: acc + v)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, v: acc + v * v))


def unit(a: Column) -> Column:
    """a / ‖a‖ (a zero vector stays zero)."""
    n = norm(a)
    return F.transform(a, lambda v: F.when(n > 0, v / n).otherwise(F.lit(0.0)))


def cosine(a: Column, b: Column) -> Column:
    na, nb = norm(a), norm(b)
    return F.when((na > 0) & (nb > 0), dot(a, b) / (na * nb)).otherwise(F.lit(0.0))


def map_get(m: Column, key: Column | str, default) -> Column:
    """Map lookup with a default."""
    k = F.lit(key) if isinstance(key, str) else key
    return F.coalesce(F.try_element_at(m, k), F.lit(default))
