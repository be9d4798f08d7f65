"""Queries: models and density clustering.

Seeded models (PCA up to sign, k-means, mixtures, forests) have no SQL twin:
their queries get the rows-only check, and ``q_model_checks`` holds their identities
against SQL. The density clustering at a fixed ε has an exact twin (recursive CTE).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scores import rnd
from ..operators import atlas as A
from ..operators import models as M
from ..operators.density import density_cluster
from ..operators.gramian import variance_spectrum
from ..operators.metadata import clean_metadata
from ..operators.profile import variance_profile
from ..params import ImportanceParams
from ..session import materialize
from ..sources import fixtures
from . import sql_twins as S
from .context import prepare
from .registry import register

TOP_GLOBAL = ImportanceParams().top_global

DENSITY_EPS = 1.15
DENSITY_MIN_SAMPLES = 5
DENSITY_MIN_SIZE = 3

_MEMO: dict = {}


def _pca(spark, sf_dir):
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _MEMO:
        prep = prepare(spark, sf_dir)
        _MEMO[key] = M.fit_pca(prep.std.vectors, n_rows=prep.n_samples, n_dims=prep.n_features)
    return _MEMO[key]


def clear_cache():
    _MEMO.clear()


@register("pca_variance")
def q_pca_variance(spark, sf_dir):
    p = _pca(spark, sf_dir)
    t = M.variance_table(spark, p.explained)
    return t.select("component", rnd("ratio").alias("ratio"), rnd("cumulative").alias("cumulative"))


@register("atlas_table")
def q_atlas_table(spark, sf_dir):
    """Atlas rows (I8): ids, cluster, 2-D map (first two PCs), first two PCs, metadata."""
    p = _pca(spark, sf_dir)
    labels = fixtures.segment_labels(spark, sf_dir)
    meta = clean_metadata(fixtures.metadata_raw(spark, sf_dir))
    atlas = M.atlas_from_pca(p.reduced)
    return (atlas.join(labels, "sample_key")
                 .join(meta.select("sample_key", "sample_id", "disease", "country", "gender", "age"),
                       "sample_key", "left")
                 .select("sample_key", "sample_id", "cluster_id", rnd("atlas_x").alias("atlas_x"),
                         rnd("atlas_y").alias("atlas_y"), rnd("atlas_x").alias("pca_x"),
                         rnd("atlas_y").alias("pca_y"), "disease", "country", "gender", "age"))


@register("kmeans_fit")
def q_kmeans(spark, sf_dir):
    p = _pca(spark, sf_dir)
    labels, _ = M.fit_kmeans(p.reduced, "pca")
    return labels


@register("gmm_fit")
def q_gmm(spark, sf_dir):
    p = _pca(spark, sf_dir)
    labels, info = M.fit_gmm(p.reduced, "pca")
    return labels.withColumn("bic", F.lit(round(info["bic"], 4))).withColumn("aic", F.lit(round(info["aic"], 4)))


def _importance(spark, sf_dir):
    prep = prepare(spark, sf_dir)
    labels = fixtures.segment_labels(spark, sf_dir)
    model = M.fit_importance_model(prep.std.vectors, labels)
    return prep, labels, M.global_importance(model, prep.features, top=None)


@register("importance_global")
def q_importance_global(spark, sf_dir):
    return _importance(spark, sf_dir)[2].where(F.col("rank") <= TOP_GLOBAL)


def importance_lists(spark, sf_dir):
    """Global importance of all features, and the table of the per-cluster and global lists."""
    prep, labels, glob = _importance(spark, sf_dir)
    per = M.cluster_importance(glob, labels.where("cluster_id >= 0"), mode="enrichment",
                               vectors=prep.std.vectors, labels=labels)
    return glob, M.importance_table(glob.where(F.col("rank") <= TOP_GLOBAL), per)


@register("importance_per_cluster")
def q_importance_per_cluster(spark, sf_dir):
    return importance_lists(spark, sf_dir)[1]


@register("method_evaluation")
def q_method_evaluation(spark, sf_dir):
    """Three clusterings (k-means, mixture on PCs; density on the 2-D map), scored and ranked."""
    from ..operators.evaluate import evaluate_methods
    p = _pca(spark, sf_dir)
    reduced = p.reduced
    km, _ = M.fit_kmeans(reduced, "pca")
    gm, _ = M.fit_gmm(reduced, "pca")
    atlas = M.atlas_from_pca(reduced).select("sample_key", F.array("atlas_x", "atlas_y").alias("vec"))
    dc = density_cluster(atlas, "vec", 10, 30)
    pts = reduced.withColumnRenamed("pca", "vec")
    return evaluate_methods({
        "pca_kmeans": pts.join(km, "sample_key"),
        "pca_gmm": pts.join(gm, "sample_key"),
        "map_density": atlas.join(dc.select("sample_key", "cluster_id"), "sample_key"),
    }, together=("pca_kmeans", "pca_gmm"))


DENSITY_SQL = f"""
WITH RECURSIVE pts AS ({S.POINTS_SQL}),
nb AS (SELECT a.sample_key AS a, b.sample_key AS b FROM pts a JOIN pts b ON list_distance(a.vec, b.vec) <= CAST({DENSITY_EPS} AS DOUBLE)),
core AS (SELECT a FROM nb GROUP BY a HAVING count(*) >= {DENSITY_MIN_SAMPLES}),
ce AS (SELECT nb.a, nb.b FROM nb WHERE a IN (SELECT a FROM core) AND b IN (SELECT a FROM core)),
reach(node, r) AS (SELECT a, a FROM core UNION SELECT reach.node, ce.b FROM reach JOIN ce ON reach.r = ce.a),
comp AS (SELECT node, min(r) AS c FROM reach GROUP BY node),
sz AS (SELECT c, min(node) AS first FROM comp GROUP BY c HAVING count(*) >= {DENSITY_MIN_SIZE}),
num AS (SELECT c, row_number() OVER (ORDER BY first) - 1 AS cluster_id FROM sz)
SELECT p.sample_key, CAST(coalesce(num.cluster_id, -1) AS INTEGER) AS cluster_id, core.a IS NOT NULL AS is_core
FROM pts p LEFT JOIN comp ON comp.node = p.sample_key LEFT JOIN num ON num.c = comp.c
LEFT JOIN core ON core.a = p.sample_key"""


@register("density_clusters", DENSITY_SQL)
def q_density(spark, sf_dir):
    """All 64 dimensions of the embeddings."""
    return density_cluster(fixtures.points(spark, sf_dir), "vec", DENSITY_MIN_SAMPLES, DENSITY_MIN_SIZE, eps=DENSITY_EPS, block_rows=256)


def _spectrum(spark, sf_dir):
    prep = prepare(spark, sf_dir)
    return variance_spectrum(prep.indexed, prep.samples, prep.features)


@register("variance_thresholds")
def q_variance_thresholds(spark, sf_dir):
    """First component of the PCA on plain z-scores that reaches 50, 70 and 90 % of the variance (E5)."""
    s = _spectrum(spark, sf_dir)
    ratios = spark.createDataFrame(list(enumerate(s.ratios, start=1)), "component int, ratio double")
    return variance_profile(ratios)[1]


# The power sums of the eigenvalues are the traces of the correlation matrix's powers.
@register("variance_spectrum", S.with_(S.PREP, """
sc AS (SELECT sample_key, feature_idx, (x - avg(x) OVER w) / nullif(stddev_pop(x) OVER w, 0) AS v
       FROM cells WINDOW w AS (PARTITION BY feature_idx)),
co AS (SELECT a.feature_idx AS i, b.feature_idx AS j, sum(a.v * b.v) / (SELECT n FROM nsmp) AS c
       FROM sc a JOIN sc b USING (sample_key) GROUP BY 1, 2),
sq AS (SELECT a.i, b.j, sum(a.c * b.c) AS c FROM co a JOIN co b ON a.j = b.i GROUP BY 1, 2)""") + f"""
SELECT 1 AS moment, {S.r6('sum(c)', 5)} AS trace FROM co WHERE i = j
UNION ALL SELECT 2, {S.r6('sum(c * c)', 5)} FROM co
UNION ALL SELECT 3, {S.r6('sum(sq.c * co.c)', 5)} FROM sq JOIN co USING (i, j)
UNION ALL SELECT 4, {S.r6('sum(c * c)', 5)} FROM sq""")
def q_variance_spectrum(spark, sf_dir):
    """Power sums 1 to 4 of all eigenvalues of the PCA on plain z-scores (H2)."""
    values = _spectrum(spark, sf_dir).eigenvalues
    return spark.createDataFrame([(m, float((values ** m).sum())) for m in range(1, 5)], "moment int, trace double").select("moment", rnd("trace", 5).alias("trace"))


FUZZY_K = 30

FUZZY_SQL = f"""
pts AS ({S.POINTS_SQL}),
rk AS (SELECT a.sample_key AS i, b.sample_key AS j, list_cosine_similarity(a.vec, b.vec) AS c,
              row_number() OVER (PARTITION BY a.sample_key ORDER BY list_cosine_similarity(a.vec, b.vec) DESC, b.sample_key) AS rank
       FROM pts a JOIN pts b ON a.sample_key <> b.sample_key),
d AS (SELECT i, list(greatest(1 - c, 0.0)) AS ds, coalesce(min(greatest(1 - c, 0.0)) FILTER (WHERE 1 - c > 0), 0.0) AS rho
      FROM rk WHERE rank <= {FUZZY_K} GROUP BY i),
bis(i, step, lo, hi, mid) AS (
  SELECT i, 0, 0.0::DOUBLE, -1.0::DOUBLE, 1.0::DOUBLE FROM d
  UNION ALL
  SELECT i, step + 1, lo, hi, CASE WHEN hi < 0 THEN mid * 2 ELSE (lo + hi) / 2 END
  FROM (SELECT b.i, step, mid, CASE WHEN p > log2({FUZZY_K}) THEN lo ELSE mid END AS lo, CASE WHEN p > log2({FUZZY_K}) THEN mid ELSE hi END AS hi
        FROM (SELECT b.*, list_sum(list_transform(ds, lambda x: exp(-greatest(x - rho, 0.0) / mid))) AS p FROM bis b JOIN d USING (i)) b)
  WHERE step < 64),
w AS (SELECT rk.i, rk.j, exp(-greatest(greatest(1 - c, 0.0) - rho, 0.0) / mid) AS w
      FROM rk JOIN d USING (i) JOIN bis ON bis.i = rk.i AND step = 64 WHERE rank <= {FUZZY_K}),
fz AS (SELECT least(i, j) AS source, greatest(i, j) AS target, sum(w) - CASE WHEN count(*) = 2 THEN min(w) * max(w) ELSE 0 END AS weight
       FROM w GROUP BY 1, 2)"""


@register("fuzzy_graph", "WITH RECURSIVE " + FUZZY_SQL + f" SELECT source, target, {S.r6('weight')} AS weight FROM fz")
def q_fuzzy_graph(spark, sf_dir):
    """Fuzzy 30-nearest-neighbour graph of the embeddings (cosine), symmetrised (H4)."""
    g = A.fuzzy_neighbor_graph(fixtures.points(spark, sf_dir), k=FUZZY_K)
    return g.select("source", "target", rnd("weight").alias("weight"))


# What must hold of the stored vectors: unit length, Av = λv, no share of the trivial vector or of each other.
@register("spectral_map", "WITH n AS (SELECT count(*) AS n FROM embeddings) " + " UNION ALL ".join(
    f"SELECT {i} AS axis, n AS n_placed, 1.0 AS norm, 0.0 AS residual, 0.0 AS against_trivial, 0.0 AS against_other FROM n" for i in (1, 2)))
def q_spectral_map(spark, sf_dir):
    """Laplacian eigenmap of the fuzzy graph (H3), checked from its stored vectors to 4 decimals."""
    points = fixtures.points(spark, sf_dir)
    graph = materialize(A.fuzzy_neighbor_graph(points, k=FUZZY_K), "fuzzy-graph")
    vectors, values = A.spectral_vectors(graph, points)
    placed = vectors.where("s > 0").count()
    check = A.check_spectral(graph, points, vectors, values)
    return check.select("axis", F.lit(placed).cast("long").alias("n_placed"), *[rnd(c, 4).alias(c) for c in ("norm", "residual", "against_trivial", "against_other")])


PLACED_SQL = f"""
pts AS ({S.POINTS_SQL}),
rk AS (SELECT a.sample_key, b.vec[1] AS x, b.vec[2] AS y, greatest(list_cosine_similarity(a.vec, b.vec), 0.0) AS w,
              row_number() OVER (PARTITION BY a.sample_key ORDER BY list_cosine_similarity(a.vec, b.vec) DESC, b.sample_key) AS rank
       FROM pts a JOIN pts b ON a.sample_key % 5 = 0 AND b.sample_key % 5 <> 0)"""


@register("placed_points", S.with_(PLACED_SQL) + f"""
SELECT sample_key, {S.r6('CASE WHEN sum(w) > 0 THEN sum(w * x) / sum(w) ELSE avg(x) END')} AS atlas_x,
       {S.r6('CASE WHEN sum(w) > 0 THEN sum(w * y) / sum(w) ELSE avg(y) END')} AS atlas_y
FROM rk WHERE rank <= {FUZZY_K} GROUP BY sample_key""")
def q_placed_points(spark, sf_dir):
    """Every fifth embedding placed among the others (H5); the map to place on is the first two dimensions."""
    points = fixtures.points(spark, sf_dir)
    train = points.where("sample_key % 5 <> 0")
    atlas = train.select("sample_key", F.element_at("vec", 1).alias("atlas_x"), F.element_at("vec", 2).alias("atlas_y"))
    out = A.place_on_atlas(points.where("sample_key % 5 = 0"), train, atlas, k=FUZZY_K, block_rows=512)
    return out.select("sample_key", rnd("atlas_x").alias("atlas_x"), rnd("atlas_y").alias("atlas_y"))
