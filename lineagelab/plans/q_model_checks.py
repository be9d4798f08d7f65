"""Queries: identities of the fitted models, with twins that state them from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scores import rnd
from ..operators import model_checks as C
from ..operators import models as M
from ..params import GLOBAL_IMPORTANCE_CLUSTER, ClusterParams, ImportanceParams, ReduceParams
from . import sql_twins as S
from .q_models import _pca, importance_lists, q_atlas_table
from .q_profile import CLEAN_SQL, _clean
from .registry import register

CP, IP = ClusterParams(), ImportanceParams()
# components that a fit on n rows and D features returns
DIMS = f"(SELECT least({ReduceParams().n_components}, (SELECT n FROM nsmp) - 1, (SELECT count(*) FROM feat) - 1) AS d)"


@register("pca_checks", S.with_(S.PREP, "tv AS (SELECT sum(v) AS total FROM (SELECT var_samp(z) AS v FROM z GROUP BY feature_idx))") + f"""
SELECT CAST(i AS INTEGER) AS component, 0.0 AS centre, 0.0 AS against_other, {S.r6('total', 4)} AS total_variance
FROM tv, {DIMS}, unnest(range(1, d + 1)) AS t(i)""")
def q_pca_checks(spark, sf_dir):
    """Scores of the PCA: centred, uncorrelated, and their variances over the stated shares give the total variance of the z-scores."""
    p = _pca(spark, sf_dir)
    return C.pca_checks(p.reduced, p.explained).select(
        "component", rnd("centre").alias("centre"), rnd("against_other").alias("against_other"), rnd("total_variance", 4).alias("total_variance"))


@register("kmeans_checks", f"""
SELECT count(*) AS n_rows, CAST({CP.kmeans_k} AS BIGINT) AS n_clusters, CAST(0 AS BIGINT) AS n_misplaced, 1.0 AS inertia_ratio
FROM ({S.SAMPLES_SQL})""")
def q_kmeans_checks(spark, sf_dir):
    """Every sample has a nearest centre as its label, all clusters are used, the reported inertia is the rows'."""
    p = _pca(spark, sf_dir)
    labels, info = M.fit_kmeans(p.reduced, "pca")
    return C.kmeans_checks(p.reduced, labels, info["centers"], info["cost"]).select(
        "n_rows", "n_clusters", "n_misplaced", rnd("inertia_ratio").alias("inertia_ratio"))


@register("gmm_checks", S.with_(S.PREP) + f"""
SELECT n AS n_rows, 1.0 AS weight_total, 0.0 AS mean_gap, 1.0 AS spread_ratio,
       {S.r6(f'({CP.gmm_k} * d + {CP.gmm_k} * d * (d + 1) / 2 + {CP.gmm_k} - 1) * (ln(n) - 2)', 4)} AS penalty
FROM nsmp, {DIMS}""")
def q_gmm_checks(spark, sf_dir):
    """The mixture's weights, mean, second moments and the distance between its BIC and AIC."""
    p = _pca(spark, sf_dir)
    _, info = M.fit_gmm(p.reduced, "pca")
    return C.mixture_checks(p.reduced, info).select(
        "n_rows", rnd("weight_total").alias("weight_total"), rnd("mean_gap").alias("mean_gap"),
        rnd("spread_ratio").alias("spread_ratio"), rnd("penalty", 4).alias("penalty"))


@register("importance_checks", S.with_(S.PREP, S.LABELS, "nf AS (SELECT count(*) AS d FROM feat)") + f"""
SELECT cluster_id, least({IP.top_per_cluster}, d) AS n_rows, CAST(0 AS BIGINT) AS rank_gaps, CAST(0 AS BIGINT) AS out_of_order,
       CAST(NULL AS DOUBLE) AS score_total, CAST(NULL AS DOUBLE) AS pct_total
FROM (SELECT DISTINCT cluster_id FROM lab WHERE cluster_id >= 0), nf
UNION ALL SELECT {GLOBAL_IMPORTANCE_CLUSTER}, least({IP.top_global}, d), 0, 0, 1.0, 100.0 FROM nf""")
def q_importance_checks(spark, sf_dir):
    """The importance table: list lengths, ranks, order, and the shares of all features."""
    everything, table = importance_lists(spark, sf_dir)
    out = C.importance_checks(everything, table)
    # stored scores are rounded to 8 decimals, percentages to 4
    return out.select("cluster_id", "n_rows", "rank_gaps", "out_of_order",
                      rnd("score_total", 4).alias("score_total"), rnd("pct_total", 0).alias("pct_total"))


@register("atlas_rows", S.with_(S.LABELS, f"raw AS ({S.METADATA_RAW_SQL})", f"meta AS ({CLEAN_SQL} WHERE {_clean('sampleID')} IS NOT NULL)") + """
SELECT l.sample_key, m.sample_id, l.cluster_id, true AS placed, m.disease, m.country, m.gender, m.age
FROM lab l LEFT JOIN meta m USING (sample_key)""")
def q_atlas_rows(spark, sf_dir):
    """The atlas table without its fitted coordinates (I8): one row a sample, all placed."""
    t = q_atlas_table(spark, sf_dir)
    placed = F.col("atlas_x").isNotNull() & F.col("atlas_y").isNotNull()
    return t.select("sample_key", "sample_id", "cluster_id", placed.alias("placed"), "disease", "country", "gender", "age")
