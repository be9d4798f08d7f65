"""Logical inputs derived from the driver's TPC-H-like tables.

Each builder reads the parquet tables of one scale-factor folder and derives
the abundance-profile inputs described in FIXTURES.md. The SQL twin of every
builder (DuckDB dialect, same columns) sits next to it so oracle queries can
be composed from the same definitions.

Fixed values (from FIXTURES.md): lineage = 'k__Goods|p__' || p_type || '|g__'
|| replace(p_brand, '#', '_'); metadata sentinels injected by c_custkey
modulo 7 / 11 / 13 / 17 / 19 and gender by c_custkey modulo 4.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def _lineage(p_type: F.Column, p_brand: F.Column) -> F.Column:
    return F.concat(F.lit("k__Goods|p__"), p_type, F.lit("|g__"),
                    F.replace(p_brand, F.lit("#"), F.lit("_")))


# ---------------------------------------------------------------------------
# abundance_long(sample_key, lineage, value): customer × (type, brand) quantity
# ---------------------------------------------------------------------------

def abundance_long(spark: SparkSession, sf_dir: str, partitions: int | None = None) -> DataFrame:
    """(sample_key, lineage, value). With ``partitions`` the rows are dealt by sample before they are summed
    (few of them combine earlier), so the fact comes out partitioned by sample."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    p = table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_brand")
    cells = (li.join(o, li.l_orderkey == o.o_orderkey)
               .join(p, li.l_partkey == p.p_partkey)
               .select(F.col("o_custkey").alias("sample_key"), _lineage(F.col("p_type"), F.col("p_brand")).alias("lineage"), "l_quantity"))
    if partitions:
        cells = cells.repartition(partitions, "sample_key")
    return cells.groupBy("sample_key", "lineage").agg(F.sum("l_quantity").alias("value"))


ABUNDANCE_SQL = """
SELECT o.o_custkey AS sample_key,
       'k__Goods|p__' || p.p_type || '|g__' || replace(p.p_brand, '#', '_') AS lineage,
       sum(l.l_quantity) AS value
FROM lineitem l
JOIN orders o ON l.l_orderkey = o.o_orderkey
JOIN part p ON l.l_partkey = p.p_partkey
GROUP BY 1, 2
"""


def abundance_by_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rare-feature variant: one feature per part key (lineage k__Goods|s__part_<key>)."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return (li.join(o, li.l_orderkey == o.o_orderkey)
              .groupBy(F.col("o_custkey").alias("sample_key"),
                       F.concat(F.lit("k__Goods|s__part_"),
                                F.col("l_partkey").cast("string")).alias("lineage"))
              .agg(F.sum("l_quantity").alias("value")))


ABUNDANCE_BY_PART_SQL = """
SELECT o.o_custkey AS sample_key,
       'k__Goods|s__part_' || CAST(l.l_partkey AS VARCHAR) AS lineage,
       sum(l.l_quantity) AS value
FROM lineitem l
JOIN orders o ON l.l_orderkey = o.o_orderkey
GROUP BY 1, 2
"""


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All samples (customers), including those without any abundance row."""
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("sample_key"))


SAMPLES_SQL = "SELECT c_custkey AS sample_key FROM customer"


# ---------------------------------------------------------------------------
# metadata_raw: the wide table's metadata half, with sentinels injected
# ---------------------------------------------------------------------------

def metadata_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    n = table(spark, sf_dir, "nation")
    r = table(spark, sf_dir, "region")
    k = F.col("c_custkey")
    return (c.join(F.broadcast(n), c.c_nationkey == n.n_nationkey)
             .join(F.broadcast(r), F.col("n_regionkey") == r.r_regionkey)
             .select(
                 k.alias("sample_key"),
                 F.col("c_name").alias("sampleID"),
                 F.concat(F.lit("S"), (k % 500).cast("string")).alias("subjectID"),
                 F.when(k % 7 == 0, F.lit(" nd ")).when(k % 11 == 0, F.lit(""))
                  .otherwise(F.col("c_mktsegment")).alias("disease"),
                 F.when(k % 13 == 0, F.lit("na"))
                  .otherwise(F.col("c_acctbal").cast("string")).alias("age"),
                 F.when(k % 4 == 0, F.lit(" Female")).when(k % 4 == 1, F.lit("male"))
                  .when(k % 4 == 2, F.lit("-")).otherwise(F.lit("nd")).alias("gender"),
                 F.when(k % 17 == 0, F.lit("N/A")).otherwise(F.col("n_name")).alias("country"),
                 F.when(k % 19 == 0, F.lit("none"))
                  .otherwise((F.col("c_nationkey") + 18).cast("string")).alias("bmi"),
                 F.lit("stool").alias("bodysite"),
                 F.col("r_name").alias("dataset_name"),
             ))


METADATA_RAW_SQL = """
SELECT c.c_custkey AS sample_key,
       c.c_name AS sampleID,
       'S' || CAST(c.c_custkey % 500 AS VARCHAR) AS subjectID,
       CASE WHEN c.c_custkey % 7 = 0 THEN ' nd ' WHEN c.c_custkey % 11 = 0 THEN ''
            ELSE c.c_mktsegment END AS disease,
       CASE WHEN c.c_custkey % 13 = 0 THEN 'na' ELSE CAST(c.c_acctbal AS VARCHAR) END AS age,
       CASE c.c_custkey % 4 WHEN 0 THEN ' Female' WHEN 1 THEN 'male' WHEN 2 THEN '-'
            ELSE 'nd' END AS gender,
       CASE WHEN c.c_custkey % 17 = 0 THEN 'N/A' ELSE n.n_name END AS country,
       CASE WHEN c.c_custkey % 19 = 0 THEN 'none' ELSE CAST(c.c_nationkey + 18 AS VARCHAR) END AS bmi,
       'stool' AS bodysite,
       r.r_name AS dataset_name
FROM customer c
JOIN nation n ON c.c_nationkey = n.n_nationkey
JOIN region r ON n.n_regionkey = r.r_regionkey
"""


# ---------------------------------------------------------------------------
# labels: deterministic cluster assignment of customers (segment rank, some noise)
# ---------------------------------------------------------------------------

def segment_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sample_key, cluster_id): the market-segment rank, -1 when c_custkey % 10 = 0."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    seg = (c.select("c_mktsegment").distinct()
            .withColumn("seg_rank", F.dense_rank().over(Window.orderBy("c_mktsegment")) - 1))
    return (c.join(F.broadcast(seg), "c_mktsegment")
             .select(F.col("c_custkey").alias("sample_key"),
                     F.when(F.col("c_custkey") % 10 == 0, F.lit(-1))
                      .otherwise(F.col("seg_rank")).cast("int").alias("cluster_id")))


SEGMENT_LABELS_SQL = """
SELECT c.c_custkey AS sample_key,
       CAST(CASE WHEN c.c_custkey % 10 = 0 THEN -1 ELSE s.seg_rank END AS INTEGER) AS cluster_id
FROM customer c
JOIN (SELECT c_mktsegment, dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS seg_rank
      FROM (SELECT DISTINCT c_mktsegment FROM customer)) s USING (c_mktsegment)
"""


# ---------------------------------------------------------------------------
# points: 64-d embedding vectors with labels (label 9 = noise)
# ---------------------------------------------------------------------------

def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(
        F.col("vec_id").alias("sample_key"),
        F.transform("embedding", lambda x: x.cast("double")).alias("vec"),
        F.when(F.col("label") == 9, F.lit(-1)).otherwise(F.col("label")).cast("int")
         .alias("cluster_id"))


POINTS_SQL = """
SELECT vec_id AS sample_key, CAST(embedding AS DOUBLE[]) AS vec,
       CAST(CASE WHEN label = 9 THEN -1 ELSE label END AS INTEGER) AS cluster_id
FROM embeddings
"""


# ---------------------------------------------------------------------------
# scoring requests: one per order, map(lineage -> quantity)
# ---------------------------------------------------------------------------

def order_requests(spark: SparkSession, sf_dir: str, event_time: bool = False) -> DataFrame:
    """(sample_id, abundances map<string,double>): each order scored as a new sample; with ``event_time`` its date too.

    The items are dealt by order once; sums, maps and dates of an order are made where they lie.
    """
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    p = table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_brand")
    cells = (li.join(p, li.l_partkey == p.p_partkey)
             .select("l_orderkey", _lineage(F.col("p_type"), F.col("p_brand")).alias("lineage"), "l_quantity").repartition("l_orderkey"))
    out = (cells.groupBy("l_orderkey", "lineage").agg(F.sum("l_quantity").alias("value"))
           .groupBy("l_orderkey").agg(F.map_from_entries(F.collect_list(F.struct("lineage", "value"))).alias("abundances")))
    sample = F.col("l_orderkey").cast("string").alias("sample_id")
    if not event_time:
        return out.select(sample, "abundances")
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").alias("event_time"))
    return out.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(sample, "event_time", "abundances")


ORDER_REQUEST_LONG_SQL = """
SELECT CAST(l.l_orderkey AS VARCHAR) AS sample_id,
       'k__Goods|p__' || p.p_type || '|g__' || replace(p.p_brand, '#', '_') AS lineage,
       sum(l.l_quantity) AS value
FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey
GROUP BY 1, 2
"""


def event_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sample_id, day, abundances): events per user and day; event type as phylum."""
    e = table(spark, sf_dir, "events").select("user_id", "ts", "event_type", "value")
    per = (e.groupBy("user_id", F.to_date("ts").alias("day"),
                     F.concat(F.lit("k__Goods|p__"), F.upper("event_type")).alias("lineage"))
            .agg(F.sum("value").alias("value")))
    return (per.groupBy(F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit("-"),
                                 F.date_format("day", "yyyyMMdd")).alias("sample_id"),
                        F.col("day").cast("timestamp").alias("event_time"))
               .agg(F.map_from_entries(F.collect_list(F.struct("lineage", "value")))
                    .alias("abundances")))


REQUEST_SCHEMA = T.StructType([
    T.StructField("sample_id", T.StringType()),
    T.StructField("event_time", T.TimestampType()),
    T.StructField("abundances", T.MapType(T.StringType(), T.DoubleType())),
])
