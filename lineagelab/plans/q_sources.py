"""Queries: wide CSV ingest round trip (A1–A4) and JSON document round trip."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch_path
from ..sources import fixtures
from ..sources import wide as W
from . import sql_twins as S
from .registry import register


@register("wide_csv_ingest", S.with_(f"ab AS ({S.ABUNDANCE_SQL})") + """
SELECT c.c_name AS sampleID, ab.lineage, ab.value
FROM ab JOIN customer c ON c.c_custkey = ab.sample_key WHERE ab.value > 0""")
def q_wide_csv_ingest(spark, sf_dir):
    """The abundance fact is pivoted to the wide layout (metadata + one column per lineage),
    written as CSV, read back with an explicit schema and unpivoted to the long fact."""
    raw = fixtures.metadata_raw(spark, sf_dir)
    keys = raw.select("sample_key", "sampleID")
    long = fixtures.abundance_long(spark, sf_dir).join(keys, "sample_key").select("sampleID", "lineage", "value")
    path = scratch_path(spark, "wide-csv")
    W.write_wide_csv(long, raw.drop("sample_key"), path)
    wide = W.read_abundance_wide(spark, path)
    return W.to_long(wide)


@register("summary_json_roundtrip", S.with_(S.LABELS) + """
SELECT cluster_id, count(*) AS size, CAST(count(*) AS BIGINT) AS doc_size
FROM lab GROUP BY cluster_id""")
def q_summary_json(spark, sf_dir):
    """Per-cluster documents written as JSON records, read back with a schema; a text
    column holding the same document encoded twice is repaired with ``repair_json``."""
    lab = fixtures.segment_labels(spark, sf_dir)
    docs = lab.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("size"))
    inner = F.to_json(F.struct("cluster_id", "size"))
    docs = docs.withColumn("doc", F.to_json(F.array(inner)).substr(F.lit(2), F.length(F.to_json(F.array(inner))) - 2))
    path = scratch_path(spark, "summary-json")
    W.write_json(docs, path)
    back = spark.read.schema("cluster_id int, size long, doc string").json(path)
    doc_schema = T.StructType([T.StructField("cluster_id", T.IntegerType()), T.StructField("size", T.LongType())])
    fixed = back.withColumn("d", W.repair_json(F.col("doc"), doc_schema))
    return fixed.select("cluster_id", "size", F.col("d.size").alias("doc_size"))

