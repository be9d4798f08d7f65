"""Per-sample aggregates: Shannon diversity, phylum profile, dominant features.

All three group by ``sample_key`` only. A sample holds at most one row per
feature, so no group is larger than the feature count, whatever the skew of
the data between samples.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scores import diversity_class, rnd
from ..params import FingerprintParams
from ..session import broadcast_if_small


def shannon(indexed: DataFrame, samples: DataFrame | None = None,
            eps: float = FingerprintParams().shannon_eps) -> DataFrame:
    """(sample_key, diversity_score, diversity_class, n_present).

    H = −Σ p·ln(p + ε) over positive values, p = a/T. One aggregation pass
    with map-side combine: Σa = T, Σ a·ln a = S, m = count, and
    −Σ p ln(p+ε) = ln T − S/T − m·ε + O(ε²/p) (the dropped term is below
    1e-18 for any p ≥ 1e-6). Samples without positive values score 0.
    """
    pos = indexed.where(F.col("value") > 0)
    agg = pos.groupBy("sample_key").agg(
        F.sum("value").alias("t"),
        F.sum(F.col("value") * F.log(F.col("value"))).alias("s"),
        F.count(F.lit(1)).alias("n_present"))
    h = F.log(F.col("t")) - F.col("s") / F.col("t") - F.col("n_present") * F.lit(eps)
    out = agg.select("sample_key", h.alias("h"), "n_present")
    if samples is not None:
        out = samples.select("sample_key").join(out, "sample_key", "left")
    score = F.coalesce(F.col("h"), F.lit(0.0))
    return out.select("sample_key", rnd(score).alias("diversity_score"),
                      diversity_class(score).alias("diversity_class"),
                      F.coalesce(F.col("n_present"), F.lit(0)).cast("long").alias("n_present"))


def phylum_sums(indexed: DataFrame, features: DataFrame, phylum_col: str = "phylum") -> DataFrame:
    """(sample_key, phylum, amount): Σ value per sample and phylum (features with a phylum)."""
    dim = broadcast_if_small(features.where(F.col(phylum_col).isNotNull())
                                     .select("feature_idx", F.col(phylum_col).alias("phylum")))
    return (indexed.join(dim, "feature_idx")
                   .groupBy("sample_key", "phylum")
                   .agg(F.sum("value").alias("amount")))


def phylum_profile(indexed: DataFrame, features: DataFrame, phylum_col: str = "phylum",
                   digits: int = 6) -> DataFrame:
    """(sample_key, phylum_profile map<string,double>).

    Shares of each phylum in the sample's total over features with a phylum;
    every phylum of the feature dimension is a key (0 when absent); the map is
    empty when that total is 0.
    """
    phyla = sorted(r[0] for r in features.where(F.col(phylum_col).isNotNull())
                   .select(phylum_col).distinct().collect())
    sums = phylum_sums(indexed, features, phylum_col)
    per = (sums.groupBy("sample_key")
               .agg(F.map_from_entries(F.collect_list(F.struct("phylum", "amount"))).alias("m"),
                    F.sum("amount").alias("total")))
    keys = F.lit(phyla) if phyla else F.array().cast("array<string>")
    shares = F.transform(keys, lambda k: rnd(
        F.coalesce(F.try_element_at(F.col("m"), k), F.lit(0.0)) / F.col("total"), digits))
    profile = F.when(F.col("total") > 0, F.map_from_arrays(keys, shares)) \
               .otherwise(F.create_map().cast("map<string,double>"))
    return per.select("sample_key", profile.alias("phylum_profile"))


def ranked_features(indexed: DataFrame, top_n: int, min_abundance: float) -> DataFrame:
    """(sample_key, feature_idx, value, rank): top ``top_n`` values ≥ threshold per sample.

    Ties go to the higher feature index (reverse of a stable ascending sort).
    Spark plans a partial per-partition top-k before the shuffle.
    """
    w = Window.partitionBy("sample_key").orderBy(F.desc("value"), F.desc("feature_idx"))
    return (indexed.where(F.col("value") >= F.lit(min_abundance))
                   .withColumn("rank", F.row_number().over(w))
                   .where(F.col("rank") <= top_n))


def dominant_features(indexed: DataFrame, features: DataFrame,
                      top_n: int = FingerprintParams().top_n,
                      min_abundance: float = FingerprintParams().min_abundance,
                      name_col: str = "display_name", phylum_col: str = "phylum") -> DataFrame:
    """(sample_key, dominant_microbes array<struct>, n_dominant)."""
    dim = broadcast_if_small(features.select(
        "feature_idx", "lineage", F.col(name_col).alias("name"),
        F.coalesce(F.col(phylum_col), F.lit("Unknown")).alias("phylum"),
        F.coalesce("genus", F.lit("Unknown")).alias("genus"),
        F.coalesce("species", F.lit("Unknown")).alias("species")))
    top = ranked_features(indexed, top_n, min_abundance).join(dim, "feature_idx")
    entry = F.struct("rank", "name", rnd("value").alias("abundance"), "phylum", "genus",
                     "species", F.col("lineage").alias("full_lineage"))
    per = top.groupBy("sample_key").agg(F.sort_array(F.collect_list(entry)).alias("lst"))
    return per.select(
        "sample_key",
        F.transform("lst", lambda e: e.dropFields("rank")).alias("dominant_microbes"),
        F.size("lst").alias("n_dominant"))
