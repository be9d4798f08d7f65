"""Feature dimension, prevalence filter, sparse CLR and z-scoring.

Data model: a sparse long fact ``(sample_key, feature_idx, value)`` holding
only non-zero cells plus a ``features`` dimension. CLR and the column moments
of the standardised matrix are computed exactly from the non-zero cells; the
dense vector of a sample is only assembled at the end, from per-sample
aggregates and the D-sized moment arrays.

Sparse CLR (D retained features, ε the pseudocount, s = ln((x+ε)/ε), which is
0 where x = 0):
    c_i     = −(Σ_j s_ij)/D
    clr_ij  = s_ij + c_i

Moments are merged from centred parts (count, mean, M2), never as mean square minus
squared mean. The non-zero cells of a column have x = s + c. Its zero cells have
x = c_i of the other samples: their part is that of all c less that of the non-zero
cells' c, and is exactly empty or exactly zero where the column is full or c is 0.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.taxonomy import taxonomy_columns
from ..params import PreprocessParams
from ..session import broadcast_if_small


def dense_index(df: DataFrame, order_col: str, idx_col: str, n_ranges: int = 16) -> DataFrame:
    """Contiguous 0-based index in ``order_col`` order without a single-task sort.

    Range-partitions the rows, numbers them inside each range, and adds the
    running count of the earlier ranges (a table with one row per range).
    """
    ranged = (df.repartitionByRange(n_ranges, order_col)
                .withColumn("_pid", F.spark_partition_id()))
    local = ranged.withColumn(
        "_local", F.row_number().over(Window.partitionBy("_pid").orderBy(order_col)) - 1)
    counts = ranged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select(
        "_pid",
        (F.sum("_n").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, 0))
         - F.col("_n")).alias("_off"))
    return (local.join(F.broadcast(offsets), "_pid")
                 .withColumn(idx_col, (F.col("_local") + F.col("_off")).cast("int"))
                 .drop("_pid", "_local", "_off"))


def feature_dimension(lineages: DataFrame, lineage_col: str = "lineage") -> DataFrame:
    """features(feature_idx, lineage, kingdom … strain, display_name, leaf_name, phylum_any).

    ``feature_idx`` follows the lexical order of the lineage strings.
    """
    distinct = lineages.select(F.col(lineage_col).alias("lineage")).distinct()
    indexed = dense_index(distinct, "lineage", "feature_idx")
    tax = indexed.select("feature_idx", "lineage", F.struct(*taxonomy_columns("lineage")).alias("_t"))
    return tax.select("feature_idx", "lineage", "_t.*")


def index_abundance(abundance: DataFrame, features: DataFrame,
                    n_features: int | None = None) -> DataFrame:
    """(sample_key, feature_idx, value) for the features in the dimension; value > 0 only."""
    dim = broadcast_if_small(features.select("lineage", "feature_idx"), known_rows=n_features)
    return (abundance.where(F.col("value") > 0)
                     .join(dim, "lineage")
                     .select("sample_key", "feature_idx", "value"))


def prevalence(abundance: DataFrame, n_samples: int) -> DataFrame:
    """(lineage, n_present, prevalence): share of all samples with value > 0."""
    return (abundance.groupBy("lineage")
                     .agg(F.count_if(F.col("value") > 0).alias("n_present"))
                     .withColumn("prevalence", F.col("n_present") / F.lit(float(n_samples))))


def prevalence_filter(abundance: DataFrame, n_samples: int, min_prevalence: float) -> DataFrame:
    """Features whose prevalence ≥ ``min_prevalence`` (inclusive)."""
    return prevalence(abundance, n_samples).where(F.col("prevalence") >= F.lit(min_prevalence))


@dataclass
class Standardised:
    features: DataFrame      # retained features, feature_idx 0..D-1
    moments: DataFrame       # feature_idx, mean, std (population)
    vectors: DataFrame       # sample_key, features array<double> (length D)
    sample_stats: DataFrame  # sample_key, c (CLR centring term, 0 in standard mode)
    n_samples: int
    n_features: int
    mean: list
    std: list


def log_ratio(indexed: DataFrame, params: PreprocessParams) -> DataFrame:
    """(sample_key, feature_idx, s) with s = ln((x+ε)/ε) (CLR) or s = x (standard)."""
    if params.scaler == "clr":
        s = F.log((F.col("value") + F.lit(params.pseudocount)) / F.lit(params.pseudocount))
    else:
        s = F.col("value")
    return indexed.select("sample_key", "feature_idx", s.alias("s"))


def column_moments(s_long: DataFrame, sample_stats: DataFrame, features: DataFrame, n: int) -> DataFrame:
    """(feature_idx, mean, std, constant) over all ``n`` samples, zero cells included (population std).

    ``constant``: the variance is within the rounding of its own sum, n·ε·var + (n·ε·mean)²,
    the bound a standard scaler uses; there is no other threshold.
    """
    nn = F.lit(float(n))
    part = (s_long.join(sample_stats.select("sample_key", "c"), "sample_key").groupBy("feature_idx")
            .agg(F.count("s").alias("k"), F.avg(F.col("s") + F.col("c")).alias("m"), F.var_pop(F.col("s") + F.col("c")).alias("v"),
                 F.avg("c").alias("cm"), F.var_pop("c").alias("cv")))
    g = sample_stats.agg(F.avg("c").alias("m"), F.var_pop("c").alias("v")).first()
    all_m, all_v = F.lit(float(g["m"] or 0.0)), F.lit(float(g["v"] or 0.0))
    part = features.select("feature_idx").join(part, "feature_idx", "left").fillna(0.0, ["m", "v", "cm", "cv"]).fillna(0, ["k"])
    k, z = F.col("k").cast("double"), nn - F.col("k")
    # the zero cells' c: mean from the totals, M2 of all less that of the others and of the gap between both
    zm = F.when(z > 0, (all_m * nn - F.col("cm") * k) / z).otherwise(0.0)
    gap = F.col("cm") - F.col("zm")
    zm2 = F.when(F.col("z") > 0, F.greatest(all_v * nn - F.col("cv") * k - gap * gap * k * F.col("z") / nn, F.lit(0.0))).otherwise(0.0)
    part = part.withColumn("z", z).withColumn("zm", zm).withColumn("zm2", zm2)
    step = F.col("m") - F.col("zm")
    m2 = F.col("v") * k + F.col("zm2") + step * step * k * F.col("z") / nn
    part = part.select("feature_idx", ((F.col("m") * k + F.col("zm") * F.col("z")) / nn).alias("mean"), (m2 / nn).alias("var"))
    eps = F.lit(2.0 ** -52)
    rounding = nn * eps * F.col("var") + F.pow(nn * eps * F.col("mean"), 2)
    return part.select("feature_idx", "mean", F.sqrt("var").alias("std"), (F.col("var") <= rounding).alias("constant"))


def standardise(abundance: DataFrame, samples: DataFrame,
                params: PreprocessParams = PreprocessParams(),
                features: DataFrame | None = None, persist=None,
                n_samples: int | None = None, n_features: int | None = None) -> Standardised:
    """Prevalence filter → CLR (optional) → z-score, all in sparse form.

    ``samples`` lists every sample (those without any abundance count with
    all-zero rows, as in a wide table). ``persist(df, name)``, when given,
    materialises the feature dimension and the vectors (see ``session.materialize``).
    """
    samples = samples.select("sample_key").distinct()
    n = n_samples if n_samples is not None else samples.count()
    if features is None:
        kept = prevalence_filter(abundance, n, params.min_prevalence)
        features = feature_dimension(kept)
        features = persist(features, "features") if persist else features.cache()
        n_features = None
    d = n_features if n_features is not None else features.count()
    if d == 0:
        raise ValueError("no feature passes the prevalence filter")

    s_long = log_ratio(index_abundance(abundance, features, d), params)
    per_sample = s_long.groupBy("sample_key").agg(F.sum("s").alias("sum_s"))
    if params.scaler == "clr":
        c_expr = -F.coalesce(F.col("sum_s"), F.lit(0.0)) / F.lit(float(d))
    else:
        c_expr = F.lit(0.0)
    sample_stats = (samples.join(per_sample, "sample_key", "left")
                           .select("sample_key", c_expr.alias("c"), "sum_s"))

    moments = column_moments(s_long, sample_stats, features, n)
    rows = sorted(moments.collect(), key=lambda r: r["feature_idx"])
    mean_arr = [float(r["mean"]) for r in rows]
    std_arr = [0.0 if r["constant"] else float(r["std"]) for r in rows]
    moments = moments.drop("constant")

    vectors = assemble_vectors(s_long, sample_stats, mean_arr, std_arr)
    if persist:
        vectors = persist(vectors, "vectors")
    return Standardised(features, moments, vectors, sample_stats.select("sample_key", "c"),
                        n, d, mean_arr, std_arr)


def assemble_vectors(s_long: DataFrame, sample_stats: DataFrame,
                     mean_arr: list, std_arr: list) -> DataFrame:
    """(sample_key, features array<double>): dense z-scores from the sparse s and c."""
    d = len(mean_arr)
    sparse = (s_long.groupBy("sample_key")
                    .agg(F.map_from_entries(F.collect_list(F.struct("feature_idx", "s"))).alias("m")))
    mean_lit = F.lit(mean_arr)
    std_lit = F.lit(std_arr)

    def z(j):
        sd = F.element_at(std_lit, j + 1)
        x = F.coalesce(F.try_element_at(F.col("m"), j), F.lit(0.0)) + F.col("c")
        # a constant column keeps scale 1 (x − mean), as a standard scaler does
        return (x - F.element_at(mean_lit, j + 1)) / F.when(sd == 0, F.lit(1.0)).otherwise(sd)

    return (sample_stats.join(sparse, "sample_key", "left")
                        .select("sample_key",
                                F.transform(F.sequence(F.lit(0), F.lit(d - 1)), z).alias("features")))
