"""Metadata cleaning (B1–B5) and serving queries."""

import pytest
from pyspark.sql import Observation

from lineagelab.operators.metadata import clean_metadata, first_per_key, require_columns, split_columns
from lineagelab.plans import serving as SV


def _raw(spark):
    rows = [(1, "S1", " nd ", "41.5", " Female", "NL", "none"), (2, " ", "CRC", "na", "male", "N/A", "22"),
            (3, "S3", "", "x", "-", " DE ", "23.5"), (4, "S1", "IBD", " 30 ", "MALE", "US", " - ")]
    return spark.createDataFrame(rows, "sample_key long, sampleID string, disease string, age string, "
                                       "gender string, country string, bmi string")


def test_clean(spark):
    obs = Observation("dropped")
    got = {r["sample_key"]: r for r in clean_metadata(_raw(spark), observation=obs).collect()}
    assert set(got) == {1, 3, 4} and obs.get["dropped"] == 1
    assert got[1]["disease"] is None and got[1]["gender"] == "female" and got[1]["age"] == 41.5
    assert got[1]["bmi"] is None and got[3]["age"] is None and got[3]["country"] == "DE"
    assert got[4]["age"] == 30.0 and got[4]["gender"] == "male" and got[4]["bmi"] is None


def test_required_and_split():
    with pytest.raises(ValueError):
        require_columns_list(["sampleID", "disease"])
    feats, meta = split_columns(["sampleID", "k__A|p__B", "disease"])
    assert feats == ["k__A|p__B"] and meta == ["sampleID", "disease"]
    with pytest.raises(ValueError):
        split_columns(["sampleID"])


def require_columns_list(cols):
    class Fake:
        columns = cols
    require_columns(Fake())


def test_first_per_key(spark):
    df = spark.createDataFrame([("a", 3, "x"), ("a", 1, "y"), ("b", 2, "z")], "k string, id int, v string")
    got = {r["k"]: r["v"] for r in first_per_key(df, "k", "id").collect()}
    assert got == {"a": "y", "b": "z"}


def test_list_samples_paging(spark):
    meta = clean_metadata(_raw(spark))
    fp = spark.createDataFrame([(1, 0), (3, 1), (4, 0)], "sample_key long, cluster_id int")
    t = SV.build_serving_tables(meta, fp)
    page = SV.list_samples(t, page=1, limit=2).collect()
    assert [r["id"] for r in page] == [1, 3] and page[0]["total"] == 3 and page[0]["pages"] == 2
    assert [r["id"] for r in SV.list_samples(t, cluster=0).collect()] == [1, 4]
    assert SV.list_samples(t, disease="%").count() == 0  # wildcards are literal
    with pytest.raises(ValueError):
        SV.list_samples(t, limit=501)
    d = SV.sample_detail(t, "S1").collect()
    assert len(d) == 1 and d[0]["id"] == 1 and d[0]["fingerprint"]["cluster_id"] == 0
    checks = {r["check"]: r["violations"] for r in SV.check_serving_tables(t).collect()}
    assert checks["samples.id unique"] == 0 and checks["fingerprints.sample_pk -> samples"] == 0


def test_wide_to_long_and_json_repair(spark, tmp_path):
    from pyspark.sql import functions as F
    from pyspark.sql import types as T

    from lineagelab.sources import wide as W
    p = tmp_path / "wide.csv"
    p.write_text("sampleID,disease,country,gender,k__A|p__B,k__A|p__C\n"
                 "s1,CRC,NL,male,1.5,0\ns2,,DE,female,NaN,-2\ns3,IBD,US,nd,,4\n")
    wide = W.read_abundance_wide(spark, str(p))
    assert dict(wide.dtypes)["k__A|p__B"] == "double" and dict(wide.dtypes)["disease"] == "string"
    obs = Observation("neg")
    got = sorted(tuple(r) for r in W.to_long(wide, observation=obs).collect())
    assert got == [("s1", "k__A|p__B", 1.5), ("s3", "k__A|p__C", 4.0)] and obs.get["negative"] == 1
    with pytest.raises(FileNotFoundError):
        W.read_abundance_wide(spark, str(tmp_path / "missing.csv"))
    schema = T.StructType([T.StructField("a", T.IntegerType())])
    df = spark.createDataFrame([('{"a": 1}',), ('"{\\"a\\": 2}"',), ("junk",)], "doc string")
    vals = [r["a"] for r in df.select(W.repair_json(F.col("doc"), schema).alias("d")).select("d.a").collect()]
    assert vals == [1, 2, None]
