"""The abundance fact and the vectors lie in buckets of the sample: what is grouped or joined by sample moves none of their rows."""

import os
import re

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from lineagelab.operators.diversity import dominant_features, phylum_sums, shannon
from lineagelab.plans import context
from lineagelab.session import discard, materialize
from lineagelab.sources import wide as W


def exchanges(df):
    return len(re.findall(r"Exchange hashpartitioning", df._jdf.queryExecution().executedPlan().toString()))


def test_statistics_by_sample_shuffle_nothing(spark):
    prep = context.prepare(spark, SF_SMALL, reuse=False)
    for df in (shannon(prep.indexed), phylum_sums(prep.indexed, prep.features), dominant_features(prep.indexed, prep.features),
               prep.std.vectors.join(prep.abundance.groupBy("sample_key").agg(F.sum("value").alias("v")).hint("merge"), "sample_key")):
        assert exchanges(df) == 0
    assert prep.abundance.groupBy("sample_key", "lineage").count().where("count > 1").count() == 0


def test_assignments_move_neither_fact_nor_vectors(spark):
    from lineagelab.plans.q_assignments import q_cluster_assignments
    context.clear_cache()
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = q_cluster_assignments(spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString().splitlines()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    scans = [i for i, line in enumerate(plan) if "FileScan" in line and ("default.vectors" in line or "default.abundance" in line)]
    assert scans
    for i in scans:
        # what stands over a scan up to the first join or aggregation by sample
        above, at = [], depth(plan[i])
        for line in reversed(plan[:i]):
            if depth(line) < at:
                at = depth(line)
                above.append(line)
                if "Join" in line or "Aggregate" in line:
                    break
        assert not any("Exchange" in line for line in above)


def test_buckets_grow_with_the_samples(spark):
    # at least one per shuffle partition once there are several, so that joins keep them
    assert context.sample_buckets(spark, 3) == 3 and context.sample_buckets(spark, 15_000) == spark.sparkContext.defaultParallelism
    assert context.sample_buckets(spark, 5_400_000) == 270


def test_a_bucketed_table_has_all_rows(spark):
    df = materialize(spark.range(1000).select((F.col("id") % 90).alias("k"), "id"), "bucket-test", "k", 7)
    assert df.count() == 1000 and exchanges(df.groupBy("k").count()) == 0


def test_the_wide_table_is_pivoted_where_the_cells_lie(spark, tmp_path, monkeypatch):
    long = spark.range(4000).select((F.col("id") % 500).cast("string").alias("sampleID"),
                                    F.concat(F.lit("k__A|p__"), (F.col("id") % 8).cast("string")).alias("lineage"), F.lit(1.0).alias("value"))
    meta = long.select("sampleID").distinct()
    seen = []
    writer = type(meta.write)
    csv = writer.csv
    monkeypatch.setattr(writer, "csv", lambda self, *a, **k: (seen.append(self._df), csv(self, *a, **k))[1])
    path = W.write_wide_csv(long, meta, str(tmp_path / "wide"))
    plan = seen[0]._jdf.queryExecution().executedPlan().toString()
    # every aggregation that makes wide rows reads dealt cells; none feeds an exchange
    assert not re.search(r"Exchange hashpartitioning[^\n]*\n[^\n]*HashAggregate[^\n]*pivotfirst", plan)
    assert spark.read.option("header", True).csv(path).count() == 500


def test_a_discarded_table_is_gone(spark):
    df = materialize(spark.range(10).withColumn("k", F.col("id")), "discard-test", "k", 2)
    folder = os.path.dirname(df.inputFiles()[0]).replace("file://", "")
    assert os.path.exists(folder)
    discard(df)
    assert not os.path.exists(folder)
    with pytest.raises(ValueError):
        discard(spark.read.parquet(SF_SMALL + "/nation.parquet"))
