"""Metadata cleaning column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..params import GENDER_VALUES, NULL_SENTINELS


def strip(c: Column) -> Column:
    """Trim all leading/trailing whitespace (not only spaces)."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def null_sentinels(c: Column, trim: bool = True) -> Column:
    """Trimmed value, or NULL when it is one of the sentinel strings (case-sensitive)."""
    v = strip(c) if trim else c
    return F.when(~v.isin(NULL_SENTINELS), v)


def is_missing(c: Column) -> Column:
    """NULL or an untrimmed sentinel (the profiling rule)."""
    return c.isNull() | c.isin(NULL_SENTINELS)


def to_number(c: Column) -> Column:
    """String → double, unparsable → NULL, NaN → NULL."""
    d = strip(c.cast("string")).try_cast("double")
    return F.when(~F.isnan(d), d)


def normalise_gender(c: Column) -> Column:
    g = F.lower(strip(c))
    return F.when(g.isin(GENDER_VALUES), g)


def nan_to_null(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def unknown_if_null(c: Column, text: str = "unknown") -> Column:
    return F.coalesce(c, F.lit(text))
