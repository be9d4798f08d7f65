"""Query: the assignments table (customers' fingerprints and metadata; neighbours of the embedding with the same key)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scores import rnd
from ..operators.metadata import clean_metadata
from ..operators.pairs import knn_candidates
from ..sources import fixtures
from . import sql_twins as S
from .assignments import cluster_assignments
from .q_clusters import KNN_SQL, PTS
from .q_fingerprint import fingerprint_frame
from .q_profile import CLEAN_SQL, _clean
from .registry import register


@register("cluster_assignments", S.with_(S.PREP, S.LABELS, S.SHANNON, S.NOVELTY, f"raw AS ({S.METADATA_RAW_SQL})",
                                         f"meta AS ({CLEAN_SQL} WHERE {_clean('sampleID')} IS NOT NULL)",
                                         f"nn AS ({S.with_(PTS, KNN_SQL)} SELECT * FROM rk WHERE rank <= 3)") + f"""
SELECT l.sample_key, l.cluster_id, {S.r6('coalesce(sh0.h, 0.0)')} AS diversity_score,
       {S.div_class('coalesce(sh0.h, 0.0)')} AS diversity_class,
       {S.r6('nov.ns')} AS novelty_score, {S.nov_class('nov.ns')} AS novelty_class,
       m.disease, m.age, m.gender, m.country, m.bmi,
       n1.neighbor_key AS neighbor_1_key, {S.r6('CASE WHEN n1.cosine < 0 THEN 0.0 ELSE n1.cosine END')} AS neighbor_1_cosine,
       n2.neighbor_key AS neighbor_2_key, {S.r6('CASE WHEN n2.cosine < 0 THEN 0.0 ELSE n2.cosine END')} AS neighbor_2_cosine,
       n3.neighbor_key AS neighbor_3_key, {S.r6('CASE WHEN n3.cosine < 0 THEN 0.0 ELSE n3.cosine END')} AS neighbor_3_cosine
FROM lab l LEFT JOIN sh0 USING (sample_key) LEFT JOIN nov USING (sample_key)
LEFT JOIN meta m ON m.sample_key = l.sample_key
LEFT JOIN nn n1 ON n1.sample_key = l.sample_key AND n1.rank = 1
LEFT JOIN nn n2 ON n2.sample_key = l.sample_key AND n2.rank = 2
LEFT JOIN nn n3 ON n3.sample_key = l.sample_key AND n3.rank = 3""")
def q_cluster_assignments(spark, sf_dir):
    knn = knn_candidates(fixtures.points(spark, sf_dir), 3, block_rows=512)
    out = cluster_assignments(fingerprint_frame(spark, sf_dir), clean_metadata(fixtures.metadata_raw(spark, sf_dir)), knn)
    return out.select(*[rnd(c).alias(c) if c.endswith("_cosine") else F.col(c) for c in out.columns])
