"""Scoring (I15, B13) and its streaming twin."""

import os
import tempfile

from pyspark.sql import functions as F

from lineagelab.plans.q_scoring import customer_model
from lineagelab.plans.scoring import score_samples
from lineagelab.sources import fixtures
from lineagelab.streaming.scoring_stream import run_scoring_stream

from conftest import SF_SMALL


def test_alignment_rules(spark):
    m = customer_model(spark, SF_SMALL)
    lin = m.lineages
    req = spark.createDataFrame(
        [("a", {lin[0]: 5.0, lin[1]: -3.0, "k__Nope|p__X": 9.0}), ("b", {"k__Nope|p__X": 1.0})],
        "sample_id string, abundances map<string,double>")
    got = {r["sample_id"]: r for r in score_samples(req, m).collect()}
    # negative clamped, unknown ignored, counts only positive known entries
    assert got["a"]["n_features_used"] == 1 and got["a"]["diversity_score"] == 0.0
    assert [t["name"] for t in got["a"]["top_microbes"]] == [m.leaf_names[0]]
    assert got["b"]["n_features_used"] == 0 and got["b"]["phylum_profile"] == {}
    assert got["a"]["n_features_total"] == len(lin)
    assert abs(sum(got["a"]["phylum_profile"].values()) - 1.0) < 1e-6


def test_training_samples_reproduce_diversity(spark):
    from lineagelab.plans.q_fingerprint import fingerprint_frame
    m = customer_model(spark, SF_SMALL)
    ab = fixtures.abundance_long(spark, SF_SMALL)
    req = (ab.groupBy(F.col("sample_key").cast("string").alias("sample_id"))
             .agg(F.map_from_entries(F.collect_list(F.struct("lineage", "value"))).alias("abundances")))
    sc = {r["sample_id"]: r["diversity_score"] for r in score_samples(req, m).collect()}
    fp = {str(r["sample_key"]): r["diversity_score"] for r in fingerprint_frame(spark, SF_SMALL).collect()}
    common = set(sc) & set(fp)
    assert common and all(abs(sc[k] - fp[k]) < 2e-6 for k in common)


def test_stream_equals_batch(spark):
    m = customer_model(spark, SF_SMALL)
    o = fixtures.table(spark, SF_SMALL, "orders").select(
        F.col("o_orderkey").cast("string").alias("sample_id"), F.col("o_orderdate").alias("event_time"))
    req = fixtures.order_requests(spark, SF_SMALL).join(o, "sample_id")
    base = tempfile.mkdtemp(prefix="lineagelab-stream-")
    src = os.path.join(base, "src")
    # the same order twice: the first arrival is kept
    req.unionByName(req).write.parquet(src)
    sink = run_scoring_stream(spark, src, m, os.path.join(base, "sink"), os.path.join(base, "ckpt"),
                              watermark="3650 days")
    stream = {r["sample_id"]: (r["cluster_id"], r["diversity_score"], r["novelty_score"])
              for r in spark.read.parquet(sink).collect()}
    batch = {r["sample_id"]: (r["cluster_id"], r["diversity_score"], r["novelty_score"])
             for r in score_samples(req, m).collect()}
    assert spark.read.parquet(sink).count() == len(batch)
    assert stream == batch


def test_requests_are_dealt_by_order_once(spark):
    o = fixtures.table(spark, SF_SMALL, "orders").select(F.col("o_orderkey").cast("string").alias("sample_id"), F.col("o_orderdate").alias("event_time"))
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        req = fixtures.order_requests(spark, SF_SMALL, event_time=True)
        # two for the join with the parts, one by order, one of the orders
        assert req._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 4
        want = {r["sample_id"]: (r["event_time"], r["abundances"]) for r in fixtures.order_requests(spark, SF_SMALL).join(o, "sample_id").collect()}
        assert {r["sample_id"]: (r["event_time"], r["abundances"]) for r in req.collect()} == want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_seen_ids_are_kept_on_disk(spark, tmp_path):
    m = customer_model(spark, SF_SMALL)
    src, sink, ckpt = (str(tmp_path / x) for x in ("src", "sink", "ckpt"))
    req = fixtures.order_requests(spark, SF_SMALL, event_time=True)
    req.unionByName(req).write.parquet(src)
    setting = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(setting)
    run_scoring_stream(spark, src, m, sink, ckpt, watermark="3650 days")
    assert spark.conf.get(setting) == before
    assert spark.read.parquet(sink).count() == req.count()
    kept = [f for _, _, files in os.walk(os.path.join(ckpt, "state")) for f in files]
    assert any(f.endswith(".zip") for f in kept) and not any(f.endswith(".delta") for f in kept)
