"""Every registered query with a DuckDB twin matches it (small scale factor)."""

import re

import pytest

import __spark_entry__ as E
from oracle_check import compare

from conftest import SF_SMALL

# the twins of the optional subpackage are compared in its own tests
NAMES = sorted(n for n in E.oracle_sql() if not re.match(r"op\d+_", n))


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert "dominant_microbes" in df.columns and "phylum_profile" in df.columns


@pytest.mark.parametrize("name", NAMES)
def test_matches_oracle(spark, name):
    res = compare(spark, SF_SMALL, [name], verbose=False)[name]
    assert res.get("ok") is True, res
