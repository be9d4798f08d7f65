"""The registered fingerprint query gives every column of the table, the nested ones as JSON."""

import json

import __spark_entry__ as E

from conftest import SF_SMALL


def test_fingerprints_keep_the_nested_columns(spark):
    whole = {r.sample_key: r for r in E.entry(spark).collect()}
    rows = E.queries()["fingerprints"](spark, SF_SMALL).collect()
    assert len(rows) == len(whole) > 0
    for r in rows:
        nested = whole[r.sample_key]
        assert json.loads(r.dominant_microbes) == [m.asDict() for m in nested.dominant_microbes] and len(nested.dominant_microbes) == r.n_dominant
        assert json.loads(r.phylum_profile) == nested.phylum_profile
    assert any(r.n_dominant for r in rows) and any(r.phylum_profile != "{}" for r in rows)
