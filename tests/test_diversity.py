"""Shannon, phylum profile, dominant features."""

import math

from lineagelab.operators.abundance import feature_dimension
from lineagelab.operators.diversity import dominant_features, phylum_profile, shannon


def _setup(spark, rows):
    ab = spark.createDataFrame(rows, "sample_key long, lineage string, value double")
    feats = feature_dimension(ab)
    idx = ab.join(feats.select("lineage", "feature_idx"), "lineage").select("sample_key", "feature_idx", "value")
    return ab, feats, idx


def test_shannon_uniform_and_empty(spark):
    rows = [(1, f"k__A|p__P|g__g{i}", 2.0) for i in range(7)] + [(2, "k__A|p__P|g__g0", 5.0)]
    _, _, idx = _setup(spark, rows)
    smp = spark.createDataFrame([(1,), (2,), (3,)], "sample_key long")
    got = {r["sample_key"]: r for r in shannon(idx, smp).collect()}
    assert abs(got[1]["diversity_score"] - round(math.log(7) - 7e-12, 6)) < 1e-9
    assert got[2]["diversity_score"] == 0.0 and got[3]["diversity_score"] == 0.0
    assert got[3]["diversity_class"] == "Low" and got[1]["diversity_class"] == "Medium"


def test_profile_and_top(spark):
    rows = [(1, "k__A|p__P|g__a", 3.0), (1, "k__A|p__Q|g__b", 1.0), (1, "k__A|g__c", 4.0),
            (1, "k__A|p__P|g__d", 3.0), (2, "k__A|g__c", 1.0)]
    _, feats, idx = _setup(spark, rows)
    prof = {r["sample_key"]: r["phylum_profile"] for r in phylum_profile(idx, feats).collect()}
    assert prof[1] == {"P": round(6 / 7, 6), "Q": round(1 / 7, 6)}
    assert prof.get(2, {}) == {}  # nothing with a phylum: empty profile
    top = {r["sample_key"]: r for r in dominant_features(idx, feats, top_n=3).collect()}
    names = [m["name"] for m in top[1]["dominant_microbes"]]
    # 4.0 first; the two 3.0 ties go to the higher feature index (g__d after g__a)
    assert names == ["c", "d", "a"] and top[1]["n_dominant"] == 3
    assert top[1]["dominant_microbes"][0]["phylum"] == "Unknown"
