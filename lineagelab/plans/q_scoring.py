"""Queries: scoring every order as a new sample, batch and streaming."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions.scores import rnd
from ..operators.models import project
from ..session import materialize, scratch_path
from ..sources import fixtures
from . import sql_twins as S
from .context import prepare
from .registry import register
from .scoring import build_scoring_model, score_samples

# Components of the projection of the registered model: a cosine basis over the features. It is
# orthonormal and known in closed form, so that the twin can project too; a fitted PCA takes the same path.
COMPONENTS = 8


def cosine_basis(d: int, k: int = COMPONENTS) -> list[list[float]]:
    return [[math.sqrt(2.0 / d) * math.cos(math.pi * (j + 0.5) * c / d) for j in range(d)] for c in range(1, k + 1)]


def customer_model(spark, sf_dir):
    """Scaler of the customers, projection, and centroids and ranges of their segments in the projected space."""
    prep = prepare(spark, sf_dir)
    basis = cosine_basis(prep.n_features)
    pts = project(prep.std.vectors, basis, "features", "vec").select("sample_key", "vec")
    pts = materialize(pts.join(fixtures.segment_labels(spark, sf_dir), "sample_key"), "scoring-points")
    return build_scoring_model(prep.features, prep.std.mean, prep.std.std, pts, projection=basis, method="segments")


def _flat(scores):
    """The nested columns as text and numbers that a twin can compare."""
    best = F.array_sort(F.transform(F.map_entries("phylum_profile"), lambda e: F.struct((-e["value"]).alias("share"), e["key"].alias("key"))))
    return scores.select(
        "sample_id", "cluster_id", "cluster_label", "atlas_x", "atlas_y", "diversity_score", "diversity_class", "novelty_score", "novelty_class",
        "n_features_used", "n_features_total", F.size("top_microbes").alias("n_top"), "centroid_distance",
        F.array_join(F.transform("top_microbes", lambda t: F.concat_ws("/", t["name"], t["phylum"])), ";").alias("top_names"),
        rnd(F.aggregate("top_microbes", F.lit(0.0), lambda a, t: a + t["abundance"])).alias("top_total"),
        F.size("phylum_profile").alias("n_phyla"), F.try_element_at(best, F.lit(1))["key"].alias("main_phylum"),
        rnd(-F.try_element_at(best, F.lit(1))["share"]).alias("main_share"), "method")


BASIS = "sqrt(2.0 / (SELECT count(*) FROM feat)) * cos(pi() * (feature_idx + 0.5) * c / (SELECT count(*) FROM feat))"

SCORE_SQL = S.with_(S.PREP, S.LABELS, f"""
comps AS (SELECT unnest(range(1, {COMPONENTS + 1})) AS c),
tp AS (SELECT sample_key, c, sum(z * {BASIS}) AS v FROM z, comps GROUP BY 1, 2),
pcent AS (SELECT l.cluster_id, c, avg(v) AS v FROM tp JOIN lab l USING (sample_key) WHERE l.cluster_id >= 0 GROUP BY 1, 2),
tdist AS (SELECT tp.sample_key, l.cluster_id, sqrt(sum((tp.v - p.v) * (tp.v - p.v))) AS d
          FROM tp JOIN lab l USING (sample_key) JOIN pcent p ON p.cluster_id = l.cluster_id AND p.c = tp.c GROUP BY 1, 2),
rng AS (SELECT cluster_id, min(d) AS dmin, max(d) AS dmax FROM tdist GROUP BY 1),
req AS ({S.ORDER_REQUEST_LONG_SQL}),
rids AS (SELECT DISTINCT sample_id FROM req),
rx AS (SELECT r.sample_id, f.feature_idx, greatest(coalesce(q.value, 0.0), 0.0) AS x
       FROM rids r CROSS JOIN feat f LEFT JOIN req q ON q.sample_id = r.sample_id AND q.lineage = f.lineage),
rs AS (SELECT sample_id, feature_idx, x, CASE WHEN x > 0 THEN ln((x + 1e-6) / 1e-6) ELSE 0.0 END AS s FROM rx),
rc AS (SELECT sample_id, feature_idx, x, s - avg(s) OVER (PARTITION BY sample_id) AS clr FROM rs),
mom AS (SELECT DISTINCT feature_idx, mu, sd FROM zst),
rz AS (SELECT rc.sample_id, rc.feature_idx,
              CASE WHEN m.sd = 0 THEN rc.clr - m.mu ELSE (rc.clr - m.mu) / m.sd END AS z
       FROM rc JOIN mom m USING (feature_idx)),
rp AS (SELECT sample_id, c, sum(z * {BASIS}) AS v FROM rz, comps GROUP BY 1, 2),
rd AS (SELECT rp.sample_id, pc.cluster_id, sqrt(sum((rp.v - pc.v) * (rp.v - pc.v))) AS d
       FROM rp JOIN pcent pc USING (c) GROUP BY 1, 2),
rn AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY d, cluster_id) AS k FROM rd),
asg AS (SELECT sample_id, cluster_id, d FROM rn WHERE k = 1),
rt AS (SELECT sample_id, sum(x) AS t, count(*) FILTER (WHERE x > 0) AS used,
              least(count(*) FILTER (WHERE x >= 1e-6), 10) AS n_top FROM rx GROUP BY 1),
rh AS (SELECT rx.sample_id, sum(CASE WHEN x > 0 THEN -(x / t) * ln(x / t + 1e-12) ELSE 0.0 END) AS h
       FROM rx JOIN rt USING (sample_id) GROUP BY 1),
rl AS (SELECT rx.sample_id, rx.feature_idx, rx.x, coalesce((list_filter(f.ps, lambda q: q.level = 'phylum'))[-1].name, 'Unknown') AS phylum,
              coalesce(f.ps[-1].name, f.lineage) AS leaf,
              row_number() OVER (PARTITION BY rx.sample_id ORDER BY x DESC, rx.feature_idx DESC) AS k
       FROM rx JOIN (SELECT feature_idx, lineage, {S.parts_sql()} AS ps FROM feat) f USING (feature_idx)),
tops AS (SELECT sample_id, string_agg(leaf || '/' || phylum, ';' ORDER BY k) AS names, sum(round(x, 6)) AS total
         FROM rl WHERE k <= 10 AND x >= 1e-6 GROUP BY 1),
ph AS (SELECT sample_id, phylum, sum(x) AS a FROM rl GROUP BY 1, 2),
pp AS (SELECT sample_id, phylum, round(a / sum(a) OVER (PARTITION BY sample_id), 6) + 0.0 AS share, count(*) OVER (PARTITION BY sample_id) AS n,
              sum(a) OVER (PARTITION BY sample_id) AS t FROM ph),
mp AS (SELECT sample_id, CAST(max(n) AS INTEGER) AS n, first(phylum ORDER BY share DESC, phylum) AS phylum, max(share) AS share FROM pp WHERE t > 0 GROUP BY 1),
sc AS (SELECT a.sample_id, a.cluster_id, a.d, rh.h, rt.used, rt.n_top,
              CASE WHEN r.dmax IS NULL THEN 1.0 WHEN r.dmax <= r.dmin THEN 0.0
                   ELSE least(1.0, greatest(0.0, (a.d - r.dmin) / (r.dmax - r.dmin))) END AS nv
       FROM asg a JOIN rh USING (sample_id) JOIN rt USING (sample_id)
       LEFT JOIN rng r ON r.cluster_id = a.cluster_id)""") + f"""
SELECT sc.sample_id, cluster_id, 'Cluster ' || CAST(cluster_id AS VARCHAR) AS cluster_label,
       {S.r6('p1.v')} AS atlas_x, {S.r6('p2.v')} AS atlas_y,
       {S.r6('h')} AS diversity_score, {S.div_class('h')} AS diversity_class,
       {S.r6('nv')} AS novelty_score, {S.nov_class('nv')} AS novelty_class,
       CAST(used AS INTEGER) AS n_features_used, (SELECT CAST(count(*) AS INTEGER) FROM feat) AS n_features_total,
       CAST(n_top AS INTEGER) AS n_top, {S.r6('d')} AS centroid_distance,
       coalesce(tops.names, '') AS top_names, {S.r6('coalesce(tops.total, 0.0)')} AS top_total,
       coalesce(mp.n, 0) AS n_phyla, mp.phylum AS main_phylum, mp.share AS main_share, 'segments' AS method
FROM sc JOIN rp p1 ON p1.sample_id = sc.sample_id AND p1.c = 1 JOIN rp p2 ON p2.sample_id = sc.sample_id AND p2.c = 2
LEFT JOIN tops ON tops.sample_id = sc.sample_id LEFT JOIN mp ON mp.sample_id = sc.sample_id"""


@register("score_orders", SCORE_SQL)
def q_score_orders(spark, sf_dir):
    m = customer_model(spark, sf_dir)
    return _flat(score_samples(fixtures.order_requests(spark, sf_dir), m))


@register("score_orders_stream", SCORE_SQL)
def q_score_orders_stream(spark, sf_dir):
    """The same scores through Structured Streaming: orders are written as request
    files (event time = order date) to a folder under the checkpoint directory,
    read with ``readStream``, de-duplicated within the watermark and scored."""
    from ..streaming.scoring_stream import run_scoring_stream
    m = customer_model(spark, sf_dir)
    req = fixtures.order_requests(spark, sf_dir, event_time=True)
    src = scratch_path(spark, "requests")
    req.write.mode("overwrite").parquet(src)
    sink = run_scoring_stream(spark, src, m, watermark="3650 days")
    return _flat(spark.read.parquet(sink))


LATE_DAYS = 2
_ARRIVALS = f"""
SELECT event_id, 'u' || CAST(user_id AS VARCHAR) || '-' || event_type AS sample_id, CAST(ts AS TIMESTAMP) AS arrival_time,
       CASE WHEN event_id % 9 = 0 THEN CAST(ts AS TIMESTAMP) - INTERVAL {LATE_DAYS + 1} DAY ELSE CAST(ts AS TIMESTAMP) END AS event_time
FROM events"""


@register("first_arrivals_stream", f"""
WITH a AS ({_ARRIVALS}),
v AS (SELECT *, arrival_time - event_time > INTERVAL {LATE_DAYS} DAY AS late FROM a)
SELECT event_id, sample_id, CASE WHEN late THEN 'late'
       WHEN row_number() OVER (PARTITION BY sample_id, late ORDER BY arrival_time, event_id) = 1 THEN 'first' ELSE 'repeat' END AS verdict
FROM v""")
def q_first_arrivals_stream(spark, sf_dir):
    """Every event as an arrival of its user and type, in four micro-batches: first, repeat or late."""
    from ..streaming.first_arrival import run_first_arrivals
    e = fixtures.table(spark, sf_dir, "events")
    at = F.col("ts").cast("timestamp")
    rows = e.select("event_id", F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit("-"), "event_type").alias("sample_id"), at.alias("arrival_time"),
                    F.when(F.col("event_id") % 9 == 0, at - F.expr(f"INTERVAL {LATE_DAYS + 1} DAY")).otherwise(at).alias("event_time"))
    src, sink, checkpoint = (scratch_path(spark, name) for name in ("arrivals", "verdicts", "arrivals-checkpoint"))
    # a quarter of the month arrives, in as many files as it has, and is one micro-batch; the next run goes on from its checkpoint
    for part in range(4):
        rows.where(F.least(F.floor((F.dayofmonth("arrival_time") - 1) / 8), F.lit(3)) == part).write.mode("append").parquet(src)
        run_first_arrivals(spark, src, rows.schema, allowed_lateness=LATE_DAYS * 86_400.0, remember=3650 * 86_400.0, sink_dir=sink, checkpoint=checkpoint)
    return spark.read.parquet(sink).select("event_id", "sample_id", "verdict")
