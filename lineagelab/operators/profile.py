"""Dataset profiling tables.

Everything is one aggregation pass over the sparse fact or the metadata; the
figures of a plotting front end would be drawn from these tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.cleaning import is_missing, normalise_gender, to_number
from ..functions.scores import rnd
from ..params import NULL_SENTINELS, ProfileParams
from ..session import materialize

_P = ProfileParams()


def dataset_overview(indexed: DataFrame, n_samples: int, n_features: int,
                     raw_meta: DataFrame, meta_cols: list[str]) -> DataFrame:
    """One row: samples, features, metadata columns, sparsity, distinct diseases / countries.

    Sparsity = share of zero cells of the n × D matrix = 1 − nnz/(n·D).
    """
    nnz = indexed.where(F.col("value") != 0).count()
    m = raw_meta.agg(F.count_distinct("disease").alias("unique_diseases"),
                     F.count_distinct("country").alias("unique_countries"))
    cells = float(n_samples) * float(n_features)
    spars = (cells - nnz) / cells if cells else 0.0
    return m.select(F.lit(n_samples).cast("long").alias("samples"),
                    F.lit(n_features).cast("long").alias("features"),
                    F.lit(len(meta_cols)).cast("long").alias("metadata_columns"),
                    F.round(F.lit(spars), 4).alias("feature_sparsity"),
                    F.col("unique_diseases").cast("long"), F.col("unique_countries").cast("long"))


def value_counts(df: DataFrame, col: str, top: int | None = None,
                 drop_sentinels: bool = True) -> DataFrame:
    """(value, count) without NULLs (and untrimmed sentinels), count desc then value asc."""
    c = F.col(col)
    keep = c.isNotNull() & (~c.isin(NULL_SENTINELS) if drop_sentinels else F.lit(True))
    counts = df.where(keep).groupBy(c.alias("value")).agg(F.count(F.lit(1)).alias("count"))
    ordered = counts.orderBy(F.desc("count"), F.asc("value"))
    return ordered.limit(top) if top else ordered


def histogram(df: DataFrame, col: str, bins: int = _P.age_bins) -> DataFrame:
    """(bin, lo, hi, count): equal-width bins over [min, max], the last bin closed."""
    x = to_number(F.when(~F.col(col).isin(NULL_SENTINELS), F.col(col)))
    vals = df.select(x.alias("x")).where(F.col("x").isNotNull())
    r = vals.agg(F.min("x").alias("lo"), F.max("x").alias("hi")).first()
    if r["lo"] is None:
        return vals.sparkSession.createDataFrame([], "bin int, lo double, hi double, count long")
    lo, hi = float(r["lo"]), float(r["hi"])
    width = (hi - lo) / bins if hi > lo else 1.0
    b = F.least(F.floor((F.col("x") - F.lit(lo)) / F.lit(width)), F.lit(bins - 1)).cast("int")
    return (vals.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
                .select("bin", rnd(F.lit(lo) + F.col("bin") * F.lit(width)).alias("lo"),
                        rnd(F.lit(lo) + (F.col("bin") + 1) * F.lit(width)).alias("hi"), "count"))


def split_quantiles(df: DataFrame, col: str, probs: list, by: tuple = ()) -> DataFrame:
    """(*by, prob, value): exact quantiles (linear between neighbours) per group, NULLs left out.

    Values are counted first (map-side), the distinct ones dealt to ranges of
    (group, value), and running counts taken within each range; only one count per
    range and group is added up, so neither a group nor the whole is held by one task.
    """
    by = list(by)
    counts = df.where(F.col(col).isNotNull()).groupBy(*by, F.col(col).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    counts = materialize(counts, "value-counts")
    ranged = materialize(counts.repartitionByRange(*by, "_v").withColumn("_range", F.spark_partition_id()), "value-ranges")
    names = [f"_g{i}" for i in range(len(by))]                   # fresh names: both sides come from one plan
    sums = ranged.groupBy(*[F.col(c).alias(x) for c, x in zip(by, names)], F.col("_range").alias("_r")).agg(F.sum("_n").alias("_s"))
    group = Window.partitionBy(*names)                           # one row per range and group
    earlier = Window.partitionBy(*names).orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*names, "_r", F.coalesce(F.sum("_s").over(earlier), F.lit(0)).alias("_skip"), F.sum("_s").over(group).alias("_all"))
    own = Window.partitionBy(*by, "_range").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    cond = F.col("_range") == F.col("_r")
    for c, x in zip(by, names):
        cond = cond & F.col(c).eqNullSafe(F.col(x))
    placed = (ranged.withColumn("_upto", F.sum("_n").over(own)).join(starts, cond)
              .select(*by, "_v", "_all", (F.col("_skip") + F.col("_upto") - F.col("_n")).alias("_lo"),
                      (F.col("_skip") + F.col("_upto") - 1).alias("_hi")))
    at = F.col("prob") * (F.col("_all") - 1)                     # position of the quantile, counted from 0
    hits = (placed.select("*", F.explode(F.array(*[F.lit(float(q)) for q in probs])).alias("prob"))
            .select("*", F.floor(at).alias("_f"), F.ceil(at).alias("_c"), (at - F.floor(at)).alias("_w"))
            .where(F.col("_f").between(F.col("_lo"), F.col("_hi")) | F.col("_c").between(F.col("_lo"), F.col("_hi"))))
    below = F.max(F.when(F.col("_f").between(F.col("_lo"), F.col("_hi")), F.col("_v")))
    above = F.max(F.when(F.col("_c").between(F.col("_lo"), F.col("_hi")), F.col("_v")))
    return hits.groupBy(*by, "prob").agg((below + (above - below) * F.max("_w")).alias("value"))


def numeric_summary(df: DataFrame, col: str) -> DataFrame:
    """(n, median, mean, min, max) of a numeric text column; exact median (``split_quantiles``)."""
    x = to_number(F.when(~F.col(col).isin(NULL_SENTINELS), F.col(col)))
    vals = df.select(x.alias("x"))
    stats = vals.agg(F.count("x").alias("n"), F.avg("x").alias("mean"), F.min("x").alias("min"), F.max("x").alias("max"))
    median = split_quantiles(vals, "x", [0.5]).select(F.col("value").alias("median"))
    return stats.join(F.broadcast(median), how="left").select("n", "median", "mean", "min", "max")       # one row each


def gender_shares(df: DataFrame, col: str = "gender") -> DataFrame:
    """(gender, count, share) over known values (female / male)."""
    g = normalise_gender(F.col(col))
    counts = (df.select(g.alias("gender")).where(F.col("gender").isNotNull())
                .groupBy("gender").agg(F.count(F.lit(1)).alias("count")))
    return counts.select("gender", "count",
                         rnd(F.col("count") / F.sum("count").over(Window.partitionBy()), 6).alias("share"))


def missing_profile(df: DataFrame, meta_cols: list[str],
                    high: float = _P.missing_high, medium: float = _P.missing_medium) -> DataFrame:
    """(column, missing_pct, band): % NULL-or-sentinel per column in one pass, sorted desc."""
    n = F.count(F.lit(1))
    aggs = [(100.0 * F.count_if(is_missing(F.col(f"`{c}`"))) / n).alias(c) for c in meta_cols]
    wide = df.agg(*aggs)
    long = wide.unpivot([], meta_cols, "column", "pct")
    pct = F.round(F.col("pct"), 2)
    band = F.when(pct > high, F.lit("high")).when(pct > medium, F.lit("medium")).otherwise(F.lit("low"))
    return long.select("column", (pct + F.lit(0.0)).alias("missing_pct"), band.alias("band")) \
               .orderBy(F.desc("missing_pct"), F.asc("column"))


def feature_means(indexed: DataFrame, n_samples: int) -> DataFrame:
    """(feature_idx, mean, std) with zeros included; sample std (ddof 1) from merged centred sums."""
    agg = indexed.groupBy("feature_idx").agg(F.count("value").alias("k"), F.avg("value").alias("m"), F.var_pop("value").alias("v"))
    n, k, m = float(n_samples), F.col("k"), F.col("m")
    # the k non-zero cells merged with n - k zero cells: no difference of large squares
    m2 = F.col("v") * k + m * m * k * (F.lit(n) - k) / F.lit(n)
    return agg.select("feature_idx", (m * k / F.lit(n)).alias("mean"), F.sqrt(m2 / F.lit(max(n - 1.0, 1.0))).alias("std"))


def top_features_by_mean(indexed: DataFrame, features: DataFrame, n_samples: int,
                         top: int = _P.top_features) -> DataFrame:
    """(rank, feature_idx, label, mean_abundance): highest means; ties by feature index."""
    m = feature_means(indexed, n_samples).join(features.select("feature_idx", "leaf_name"),
                                               "feature_idx")
    return (m.orderBy(F.desc("mean"), F.asc("feature_idx")).limit(top)
             .select("feature_idx", F.col("leaf_name").alias("label"),
                     rnd("mean").alias("mean_abundance")))


def top_features_by_cv(indexed: DataFrame, features: DataFrame, n_samples: int,
                       top: int = _P.top_variable) -> DataFrame:
    """(feature_idx, label, cv): std (ddof 1) / mean, mean 0 dropped."""
    m = feature_means(indexed, n_samples).where(F.col("mean") != 0)
    m = m.join(features.select("feature_idx", "leaf_name"), "feature_idx")
    cv = F.col("std") / F.col("mean")
    return (m.select("feature_idx", F.col("leaf_name").alias("label"), cv.alias("cv"))
             .orderBy(F.desc("cv"), F.asc("feature_idx")).limit(top)
             .select("feature_idx", "label", rnd("cv").alias("cv")))


def variance_profile(ratios: DataFrame, targets=_P.variance_targets) -> tuple[DataFrame, DataFrame]:
    """Cumulative explained variance and the first component reaching each target (E5).

    ``ratios`` is (component int 1-based, ratio double); it has one row per
    component (≤ 50), so a global running sum is fine.
    """
    w = Window.orderBy("component").rowsBetween(Window.unboundedPreceding, 0)
    cum = ratios.withColumn("cumulative", F.sum("ratio").over(w))
    reach = [cum.where(F.col("cumulative") >= t).agg(F.min("component").alias("component"))
                .select(F.lit(t).alias("target"), "component") for t in targets]
    out = reach[0]
    for r in reach[1:]:
        out = out.unionByName(r)
    return cum, out

