"""Per-sample fingerprint table (I4), the flagship query.

Inputs are keyed DataFrames, never positional arrays:
  indexed      (sample_key, feature_idx, value)  raw abundances, retained features
  features     the feature dimension
  points       (sample_key, vec array<double>, cluster_id)  embedding + labels
  coords       optional (sample_key, atlas_x, atlas_y)

Output: sample_key, cluster_id, [atlas_x, atlas_y], diversity_score,
diversity_class, novelty_score, novelty_class, dominant_microbes
array<struct<name, abundance, phylum, genus, species, full_lineage>>,
phylum_profile map<string,double>, n_dominant.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scores import rnd
from ..operators.clusters import novelty
from ..operators.diversity import dominant_features, phylum_profile, shannon
from ..params import FingerprintParams


def fingerprints(indexed: DataFrame, features: DataFrame, points: DataFrame,
                 coords: DataFrame | None = None,
                 params: FingerprintParams = FingerprintParams()) -> DataFrame:
    base = points.select("sample_key", "cluster_id")
    div = shannon(indexed, base, params.shannon_eps)
    prof = phylum_profile(indexed, features)
    dom = dominant_features(indexed, features, params.top_n, params.min_abundance)
    nov = novelty(points).select("sample_key", "novelty_score", "novelty_class")

    out = (base.join(div, "sample_key", "left")
               .join(nov, "sample_key", "left")
               .join(dom, "sample_key", "left")
               .join(prof, "sample_key", "left"))
    cols = ["sample_key", "cluster_id"]
    if coords is not None:
        out = out.join(coords, "sample_key", "left")
        cols += [rnd("atlas_x").alias("atlas_x"), rnd("atlas_y").alias("atlas_y")]
    empty_dom = F.array().cast(dom.schema["dominant_microbes"].dataType)
    return out.select(
        *cols,
        "diversity_score", "diversity_class",
        rnd("novelty_score").alias("novelty_score"), "novelty_class",
        F.coalesce("dominant_microbes", empty_dom).alias("dominant_microbes"),
        F.coalesce("phylum_profile", F.create_map().cast("map<string,double>")).alias("phylum_profile"),
        F.coalesce("n_dominant", F.lit(0)).alias("n_dominant"),
    )
