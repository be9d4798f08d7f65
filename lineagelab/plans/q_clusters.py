"""Queries: cluster geometry, quality metrics, kNN, similarity graph (embeddings table)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scores import rnd
from ..operators import clusters as C
from ..operators import evaluate as EV
from ..operators import graph as G
from ..operators.pairs import knn_candidates, threshold_edges
from ..sources import fixtures
from . import sql_twins as S
from .registry import register

EDGE_THRESHOLD = 0.35
PTS = f"pts AS ({S.POINTS_SQL})"


@register("cluster_sizes", S.with_(PTS) + """
SELECT cluster_id, count(*) AS size, cluster_id = -1 AS is_noise,
       round(count(*) / sum(count(*)) OVER (), 6) + 0.0 AS share
FROM pts GROUP BY cluster_id""")
def q_cluster_sizes(spark, sf_dir):
    return C.cluster_sizes(fixtures.points(spark, sf_dir))


CENT_SQL = """
cells AS (SELECT cluster_id, sample_key, unnest(vec) AS x, unnest(generate_series(1, len(vec))) AS pos
          FROM pts WHERE cluster_id >= 0),
cent AS (SELECT cluster_id, pos, avg(x) AS c FROM cells GROUP BY cluster_id, pos)"""


@register("centroids", S.with_(PTS, CENT_SQL) + """
SELECT cluster_id, CAST(pos - 1 AS INTEGER) AS dim, round(c, 6) + 0.0 AS value FROM cent""")
def q_centroids(spark, sf_dir):
    c = C.centroids(fixtures.points(spark, sf_dir))
    return c.select("cluster_id", F.posexplode("centroid").alias("dim", "value")).select(
        "cluster_id", F.col("dim").cast("int"), rnd("value").alias("value"))


DIST_SQL = """
dist AS (SELECT c.sample_key, c.cluster_id, sqrt(sum((c.x - ce.c) * (c.x - ce.c))) AS d
         FROM cells c JOIN cent ce USING (cluster_id, pos) GROUP BY 1, 2),
rng AS (SELECT cluster_id, min(d) AS dmin, max(d) AS dmax FROM dist GROUP BY 1)"""


@register("novelty_scores", S.with_(PTS, CENT_SQL, DIST_SQL) + f"""
SELECT p.sample_key, p.cluster_id, {S.r6('d.d')} AS distance,
       {S.r6("CASE WHEN p.cluster_id = -1 THEN 1.0 WHEN r.dmax > r.dmin THEN (d.d - r.dmin) / (r.dmax - r.dmin) ELSE 0.0 END")} AS novelty_score,
       {S.nov_class("CASE WHEN p.cluster_id = -1 THEN 1.0 WHEN r.dmax > r.dmin THEN (d.d - r.dmin) / (r.dmax - r.dmin) ELSE 0.0 END")} AS novelty_class
FROM pts p LEFT JOIN dist d USING (sample_key) LEFT JOIN rng r ON r.cluster_id = p.cluster_id""")
def q_novelty(spark, sf_dir):
    n = C.novelty(fixtures.points(spark, sf_dir))
    return n.select("sample_key", "cluster_id", rnd("distance").alias("distance"),
                    rnd("novelty_score").alias("novelty_score"), "novelty_class")


@register("distance_ranges", S.with_(PTS, CENT_SQL, DIST_SQL) +
          f"SELECT cluster_id, {S.r6('dmin')} AS d_min, {S.r6('dmax')} AS d_max FROM rng")
def q_distance_ranges(spark, sf_dir):
    pts = fixtures.points(spark, sf_dir)
    r = C.distance_ranges(C.member_distances(pts, C.centroids(pts)))
    return r.select("cluster_id", rnd("d_min").alias("d_min"), rnd("d_max").alias("d_max"))


@register("nearest_centroid", S.with_(PTS, CENT_SQL, """
cv AS (SELECT cluster_id, list(c ORDER BY pos) AS cvec FROM cent GROUP BY cluster_id),
nd AS (SELECT p.sample_key, cv.cluster_id, list_distance(p.vec, cv.cvec) AS d,
              row_number() OVER (PARTITION BY p.sample_key ORDER BY list_distance(p.vec, cv.cvec), cv.cluster_id) AS rn
       FROM pts p CROSS JOIN cv)""") + f"""
SELECT sample_key, cluster_id AS assigned_cluster, {S.r6('d')} AS assigned_distance FROM nd WHERE rn = 1""")
def q_nearest_centroid(spark, sf_dir):
    pts = fixtures.points(spark, sf_dir)
    a = C.nearest_centroid(pts, C.centroids(pts))
    return a.select("sample_key", "assigned_cluster", rnd("assigned_distance").alias("assigned_distance"))


SIL_SQL = """
v AS (SELECT * FROM pts WHERE cluster_id >= 0),
pd AS (SELECT a.sample_key, a.cluster_id, b.cluster_id AS oc, sum(list_distance(a.vec, b.vec)) AS ds,
              count(*) AS n
       FROM v a JOIN v b ON a.sample_key <> b.sample_key GROUP BY 1, 2, 3),
per AS (SELECT sample_key, cluster_id, max(CASE WHEN oc = cluster_id THEN ds / n END) AS a,
               min(CASE WHEN oc <> cluster_id THEN ds / n END) AS b FROM pd GROUP BY 1, 2),
sil AS (SELECT sample_key, cluster_id,
               CASE WHEN a IS NULL THEN 0.0 WHEN greatest(a, b) > 0 THEN (b - a) / greatest(a, b)
                    ELSE 0.0 END AS s FROM per)"""


@register("silhouette_values", S.with_(PTS, SIL_SQL) +
          f"SELECT sample_key, cluster_id, {S.r6('s')} AS silhouette FROM sil")
def q_silhouette_values(spark, sf_dir):
    s = EV.silhouette_values(fixtures.points(spark, sf_dir).where("cluster_id >= 0"), block_rows=128)
    return s.select("sample_key", "cluster_id", rnd("silhouette").alias("silhouette"))


def _labellings(spark, sf_dir):
    pts = fixtures.points(spark, sf_dir)
    return {
        "given": pts,
        "coarse": pts.withColumn("cluster_id", F.when(F.col("cluster_id") < 0, F.lit(-1))
                                 .otherwise(F.col("cluster_id") % 3).cast("int")),
        "single": pts.withColumn("cluster_id", F.lit(0)),
    }


_QUALITY_SQL = """
base AS (SELECT sample_key, vec, cluster_id FROM (""" + S.POINTS_SQL + """)),
lab AS (SELECT 'given' AS method, sample_key, vec, cluster_id FROM base
        UNION ALL SELECT 'coarse', sample_key, vec, CASE WHEN cluster_id < 0 THEN -1 ELSE cluster_id % 3 END FROM base
        UNION ALL SELECT 'single', sample_key, vec, 0 FROM base),
v AS (SELECT * FROM lab WHERE cluster_id >= 0),
k AS (SELECT m.method, count(DISTINCT v.cluster_id) AS k,
             (SELECT count(*) FROM lab l WHERE l.method = m.method AND l.cluster_id = -1) AS noise
      FROM (SELECT DISTINCT method FROM lab) m LEFT JOIN v USING (method) GROUP BY m.method),
pd AS (SELECT a.method, a.sample_key, a.cluster_id, b.cluster_id AS oc,
              sum(list_distance(a.vec, b.vec)) AS ds, count(*) AS n
       FROM v a JOIN v b ON a.method = b.method AND a.sample_key <> b.sample_key GROUP BY 1, 2, 3, 4),
per AS (SELECT method, sample_key, cluster_id, max(CASE WHEN oc = cluster_id THEN ds / n END) AS a,
               min(CASE WHEN oc <> cluster_id THEN ds / n END) AS b FROM pd GROUP BY 1, 2, 3),
sil AS (SELECT method, avg(CASE WHEN a IS NULL THEN 0.0 WHEN greatest(a, b) > 0 THEN (b - a) / greatest(a, b)
                                ELSE 0.0 END) AS s FROM per GROUP BY 1),
cells AS (SELECT method, cluster_id, sample_key, unnest(vec) AS x, unnest(generate_series(1, len(vec))) AS pos FROM v),
cent AS (SELECT method, cluster_id, pos, avg(x) AS c FROM cells GROUP BY 1, 2, 3),
dist AS (SELECT c.method, c.sample_key, c.cluster_id, sqrt(sum((c.x - ce.c) * (c.x - ce.c))) AS d
         FROM cells c JOIN cent ce USING (method, cluster_id, pos) GROUP BY 1, 2, 3),
spread AS (SELECT method, cluster_id, avg(d) AS s FROM dist GROUP BY 1, 2),
cd AS (SELECT a.method, a.cluster_id AS ca, b.cluster_id AS cb, sqrt(sum((a.c - b.c) * (a.c - b.c))) AS m
       FROM cent a JOIN cent b ON a.method = b.method AND a.pos = b.pos AND a.cluster_id <> b.cluster_id
       GROUP BY 1, 2, 3),
r AS (SELECT cd.method, cd.ca, max(CASE WHEN cd.m > 0 THEN (sa.s + sb.s) / cd.m ELSE 0.0 END) AS rmax
      FROM cd JOIN spread sa ON sa.method = cd.method AND sa.cluster_id = cd.ca
      JOIN spread sb ON sb.method = cd.method AND sb.cluster_id = cd.cb GROUP BY 1, 2),
db AS (SELECT method, avg(rmax) AS db FROM r GROUP BY 1),
ev AS (SELECT k.method, CAST(k.k AS INTEGER) AS n_clusters, CAST(k.noise AS INTEGER) AS n_noise,
              CASE WHEN k.k >= 2 THEN round(sil.s, 6) END AS silhouette,
              CASE WHEN k.k >= 2 THEN round(db.db, 6) END AS davies_bouldin
       FROM k LEFT JOIN sil USING (method) LEFT JOIN db USING (method)),
rk AS (SELECT *, CAST(rank() OVER (ORDER BY silhouette DESC NULLS LAST) + (count(*) OVER (PARTITION BY silhouette) - 1) / 2.0 AS DOUBLE) AS rank_sil,
              CAST(rank() OVER (ORDER BY davies_bouldin ASC NULLS LAST) + (count(*) OVER (PARTITION BY davies_bouldin) - 1) / 2.0 AS DOUBLE) AS rank_db
       FROM ev)"""


@register("cluster_quality", S.with_(_QUALITY_SQL) + """
SELECT method, n_clusters, n_noise, silhouette, davies_bouldin, 'exact' AS silhouette_mode,
       rank_sil, rank_db, rank_sil + rank_db AS combined_rank,
       row_number() OVER (ORDER BY rank_sil + rank_db ASC, silhouette DESC NULLS LAST, method ASC) = 1 AS selected
FROM rk""")
def q_cluster_quality(spark, sf_dir):
    return EV.evaluate_methods(_labellings(spark, sf_dir), block_rows=128)


KNN_SQL = """
sims AS (SELECT a.sample_key, b.sample_key AS neighbor_key, list_cosine_similarity(a.vec, b.vec) AS cosine
         FROM pts a JOIN pts b ON a.sample_key <> b.sample_key),
rk AS (SELECT *, row_number() OVER (PARTITION BY sample_key ORDER BY cosine DESC, neighbor_key ASC) AS rank
       FROM sims)"""


@register("knn_neighbors", S.with_(PTS, KNN_SQL) + f"""
SELECT sample_key,
       max(CASE WHEN rank = 1 THEN neighbor_key END) AS neighbor_1_key,
       {S.r6('max(CASE WHEN rank = 1 THEN greatest(cosine, 0.0) END)')} AS neighbor_1_cosine,
       max(CASE WHEN rank = 2 THEN neighbor_key END) AS neighbor_2_key,
       {S.r6('max(CASE WHEN rank = 2 THEN greatest(cosine, 0.0) END)')} AS neighbor_2_cosine,
       max(CASE WHEN rank = 3 THEN neighbor_key END) AS neighbor_3_key,
       {S.r6('max(CASE WHEN rank = 3 THEN greatest(cosine, 0.0) END)')} AS neighbor_3_cosine
FROM rk WHERE rank <= 3 GROUP BY sample_key""")
def q_knn(spark, sf_dir):
    knn = knn_candidates(fixtures.points(spark, sf_dir), 3, block_rows=512)
    knn = knn.withColumn("cosine", F.greatest("cosine", F.lit(0.0)))
    w = G.neighbors_wide(knn, 3)
    return w.select("sample_key", *[c if c.endswith("key") else rnd(c).alias(c)
                                    for c in w.columns[1:]])


EDGES_SQL = f"""
edges AS (SELECT a.sample_key AS source, b.sample_key AS target,
                 list_cosine_similarity(a.vec, b.vec) AS weight
          FROM pts a JOIN pts b ON a.sample_key < b.sample_key
          WHERE list_cosine_similarity(a.vec, b.vec) >= {EDGE_THRESHOLD})"""


@register("similarity_edges", S.with_(PTS, EDGES_SQL) +
          f"SELECT source, target, {S.r6('weight')} AS weight FROM edges")
def q_edges(spark, sf_dir):
    e = threshold_edges(fixtures.points(spark, sf_dir), EDGE_THRESHOLD, block_rows=512)
    return e.select("source", "target", rnd("weight").alias("weight"))


NODES_SQL = "nodes AS (SELECT * FROM pts ORDER BY md5('42:' || CAST(sample_key AS VARCHAR)) LIMIT 200)"


@register("network_stats", S.with_(PTS, EDGES_SQL) + f"""
SELECT (SELECT count(DISTINCT sample_key) FROM pts) AS n_nodes,
       count(*) AS n_edges, CAST({EDGE_THRESHOLD} AS DOUBLE) AS threshold FROM edges""")
def q_network_stats(spark, sf_dir):
    pts = fixtures.points(spark, sf_dir)
    return G.network_stats(pts, threshold_edges(pts, EDGE_THRESHOLD, block_rows=512), EDGE_THRESHOLD)


@register("sampled_nodes", S.with_(PTS, NODES_SQL) + "SELECT sample_key, cluster_id FROM nodes")
def q_sampled_nodes(spark, sf_dir):
    return G.sample_nodes(fixtures.points(spark, sf_dir), 200).select("sample_key", "cluster_id")


CC_SQL = ("WITH RECURSIVE " + S.with_(PTS, EDGES_SQL, """
und AS (SELECT source AS a, target AS b FROM edges UNION SELECT target, source FROM edges),
reach(node, r) AS (SELECT sample_key, sample_key FROM pts
                   UNION SELECT reach.node, und.b FROM reach JOIN und ON reach.r = und.a)""")[5:] +
          "SELECT node AS sample_key, min(r) AS component FROM reach GROUP BY node")


@register("connected_components", CC_SQL)
def q_components(spark, sf_dir):
    pts = fixtures.points(spark, sf_dir)
    e = threshold_edges(pts, EDGE_THRESHOLD, block_rows=512)
    return G.connected_components(e, pts.select("sample_key")).select(
        F.col("node").alias("sample_key"), "component")
