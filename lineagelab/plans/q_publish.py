"""Queries: constraints with planted violations, and serving tables published and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.constraints import InRange, NotNull, References, Unique, check_counts, observed_write
from ..operators.metadata import clean_metadata
from ..session import scratch_path
from ..sources import fixtures
from . import sql_twins as S
from .publish import open_published, publish
from .q_profile import CLEAN_SQL, _clean
from .registry import register

RULES = [NotNull("facts", "score"), InRange("facts", "score", 0.0, 9000.0), Unique("facts", ("fact_key",)),
         References("facts", "order_key", "orders", "o_orderkey", (-99,)), References("facts", "customer", "customers", "c_custkey")]

_FACTS = """
SELECT o_orderkey % 14000 AS fact_key, CASE WHEN o_orderkey % 101 = 0 THEN -99 WHEN o_orderkey % 53 = 0 THEN -1 ELSE o_orderkey END AS order_key,
       CASE WHEN o_orderkey % 47 = 0 THEN -5 ELSE o_custkey END AS customer,
       CASE WHEN o_orderkey % 37 = 0 THEN NULL ELSE o_totalprice - 100000.0 END AS score
FROM orders"""


@register("constraint_checks", f"""
WITH f AS ({_FACTS})
SELECT 'facts.score not null' AS "check", 'not_null' AS kind, count(*) FILTER (WHERE score IS NULL) AS violations FROM f
UNION ALL SELECT 'facts.score in [0.0, 9000.0]', 'range', count(*) FILTER (WHERE score < 0 OR score > 9000) FROM f
UNION ALL SELECT 'facts(fact_key) unique', 'unique', count(*) FROM (SELECT fact_key FROM f GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT 'facts.order_key -> orders.o_orderkey', 'reference', count(*) FROM f WHERE order_key <> -99 AND order_key NOT IN (SELECT o_orderkey FROM orders)
UNION ALL SELECT 'facts.customer -> customers.c_custkey', 'reference', count(*) FROM f WHERE customer NOT IN (SELECT c_custkey FROM customer)""")
def q_constraint_checks(spark, sf_dir):
    """Planted violations of every kind, the row rules counted by the write itself."""
    o = fixtures.table(spark, sf_dir, "orders")
    o.createOrReplaceTempView("lineagelab_orders")
    facts = spark.sql(_FACTS.replace("FROM orders", "FROM lineagelab_orders"))
    path = scratch_path(spark, "facts")
    observed = observed_write(facts, path, RULES, "facts")
    tables = {"facts": spark.read.parquet(path), "orders": o, "customers": fixtures.table(spark, sf_dir, "customer")}
    return check_counts(tables, RULES, observed)


PAGE, LIMIT = 3, 40
_SERVED = f"raw AS ({S.METADATA_RAW_SQL}), s AS (SELECT sample_key AS id, * EXCLUDE (sample_key) FROM ({CLEAN_SQL} WHERE {_clean('sampleID')} IS NOT NULL) WHERE sample_key % 23 <> 0)"


@register("published_page", S.with_(_SERVED, S.LABELS) + f"""
SELECT q.id, q.sample_id, q.disease, lab.cluster_id, (SELECT count(*) FROM s) AS total,
       (SELECT count(*) FROM lab WHERE sample_key % 23 = 0) AS n_unmatched
FROM (SELECT * FROM s ORDER BY id LIMIT {LIMIT} OFFSET {(PAGE - 1) * LIMIT}) q LEFT JOIN lab ON lab.sample_key = q.id""")
def q_published_page(spark, sf_dir):
    """Samples and labels published (labels by the natural id, some without a sample), and page 3 read back by range."""
    meta = clean_metadata(fixtures.metadata_raw(spark, sf_dir)).withColumnRenamed("sample_key", "id")
    names = meta.select(F.col("id").alias("sample_key"), "sample_id")
    labels = fixtures.segment_labels(spark, sf_dir).join(names, "sample_key").select("sample_id", "cluster_id")
    root = scratch_path(spark, "published")
    rules = [Unique("samples", ("id",)), Unique("labels", ("sample_pk",)), References("labels", "sample_pk", "samples", "id")]
    _, checks = publish(spark, root, meta.where("id % 23 <> 0"), {"labels": labels}, rules, rows_per_range=100, natural={"labels": "sample_id"})
    lost = checks.where("kind = 'unmatched'").first()["violations"]
    pub = open_published(spark, root)
    page = pub.page(PAGE, LIMIT)
    return (page.join(pub.table("labels").select(F.col("sample_pk").alias("id"), "cluster_id"), "id", "left")
            .select("id", "sample_id", "disease", "cluster_id", "total", F.lit(lost).cast("long").alias("n_unmatched")))
