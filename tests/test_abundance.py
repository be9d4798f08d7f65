"""Sparse CLR + z-scores equal the dense computation."""

import numpy as np
import pytest

from lineagelab.operators.abundance import prevalence_filter, standardise
from lineagelab.params import PreprocessParams

ROWS = [  # sample, lineage, value
    (1, "k__A|p__X|g__a", 5.0), (1, "k__A|p__X|g__b", 1.0), (1, "k__A|p__Y|g__c", 0.5),
    (2, "k__A|p__X|g__a", 2.0), (2, "k__A|p__Y|g__c", 7.0),
    (3, "k__A|p__X|g__b", 3.0), (3, "k__A|p__Y|g__c", 3.0), (3, "k__A|p__Y|g__d", 1.0),
    (4, "k__A|p__X|g__a", 1.0), (4, "k__A|p__X|g__b", 1.0), (4, "k__A|p__Y|g__c", 1.0),
]
SAMPLES = [1, 2, 3, 4, 5]  # sample 5 has no abundance at all


def dense(scaler):
    lin = sorted({r[1] for r in ROWS})
    x = np.zeros((len(SAMPLES), len(lin)))
    for s, l, v in ROWS:
        x[SAMPLES.index(s), lin.index(l)] = v
    if scaler == "clr":
        lx = np.log(x + 1e-6)
        x = lx - lx.mean(1, keepdims=True)
    mu, sd = x.mean(0), x.std(0)
    sd[sd == 0] = 1.0
    return (x - mu) / sd


@pytest.mark.parametrize("scaler", ["clr", "standard"])
def test_sparse_equals_dense(spark, scaler):
    ab = spark.createDataFrame(ROWS, "sample_key long, lineage string, value double")
    smp = spark.createDataFrame([(s,) for s in SAMPLES], "sample_key long")
    st = standardise(ab, smp, PreprocessParams(min_prevalence=0.0, scaler=scaler))
    got = {r["sample_key"]: r["features"] for r in st.vectors.collect()}
    want = dense(scaler)
    for i, s in enumerate(SAMPLES):
        assert np.allclose(got[s], want[i], atol=1e-9)
    z = np.array([got[s] for s in SAMPLES])
    assert np.allclose(z.mean(0), 0, atol=1e-9)
    if scaler == "clr":
        # CLR rows of the log-ratio part sum to zero before scaling
        assert st.n_features == 4


def test_prevalence_inclusive(spark):
    ab = spark.createDataFrame(ROWS, "sample_key long, lineage string, value double")
    # g__d is in 1 of 5 samples: prevalence 0.2 is kept at 0.2 and dropped above
    kept = {r["lineage"] for r in prevalence_filter(ab, 5, 0.2).collect()}
    assert "k__A|p__Y|g__d" in kept
    kept = {r["lineage"] for r in prevalence_filter(ab, 5, 0.21).collect()}
    assert "k__A|p__Y|g__d" not in kept
