"""Metadata cleaning and key handling."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.cleaning import normalise_gender, null_sentinels, to_number
from ..params import CORE_META_COLS, FEATURE_PREFIX, REQUIRED_COLS

RENAMES = {"sampleID": "sample_id", "subjectID": "subject_id", "dataset_name": "dataset"}


def require_columns(df: DataFrame, required=REQUIRED_COLS) -> None:
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise ValueError(f"missing required columns: {missing}")


def split_columns(columns: list[str], prefix: str = FEATURE_PREFIX) -> tuple[list[str], list[str]]:
    """(feature columns, metadata columns) by name prefix; error when no feature."""
    feats = [c for c in columns if c.startswith(prefix)]
    if not feats:
        raise ValueError(f"no feature columns starting with {prefix!r}")
    return feats, [c for c in columns if not c.startswith(prefix)]


def clean_metadata(raw: DataFrame, key_cols=("sample_key",), drop_null_ids: bool = True,
                   observation: Observation | None = None) -> DataFrame:
    """Core columns only; trimmed; sentinels → NULL; age/bmi numeric; gender normalised.

    Rows without a sample id are dropped; their count is reported through
    ``observation`` (metric ``dropped``) without an extra pass.
    """
    keep = [c for c in CORE_META_COLS if c in raw.columns]
    types = dict(raw.dtypes)
    cols = [F.col(k) for k in key_cols if k in raw.columns]
    for c in keep:
        col = F.col(f"`{c}`")
        if c in ("age", "bmi"):
            e = to_number(null_sentinels(col.cast("string")) if types[c] == "string" else col)
        elif c == "gender":
            e = normalise_gender(null_sentinels(col))
        elif types[c] == "string":
            e = null_sentinels(col)
        else:
            e = col
        cols.append(e.alias(RENAMES.get(c, c)))
    out = raw.select(*cols)
    if drop_null_ids and "sample_id" in out.columns:
        if observation is not None:
            out = out.observe(observation, F.count_if(F.col("sample_id").isNull()).alias("dropped"))
        out = out.where(F.col("sample_id").isNotNull())
    return out


def first_per_key(df: DataFrame, key: str, order_col: str) -> DataFrame:
    """One row per ``key``: the row with the lowest ``order_col``.

    ``min_by`` over a struct is an aggregate with partial aggregation, so a
    key repeated millions of times never gathers in one task.
    """
    others = [c for c in df.columns if c != key]
    picked = df.groupBy(key).agg(F.min_by(F.struct(*others), F.col(order_col)).alias("_r"))
    return picked.select(key, *[F.col(f"_r.`{c}`").alias(c) for c in others])


def resolve_keys(facts: DataFrame, natural_key: str, dim: DataFrame, surrogate: str) -> tuple:
    """(resolved facts, unmatched facts): natural key → first surrogate key.

    The first surrogate per natural key is taken with ``min``; facts without a
    match are returned separately (left anti join) for counting.
    """
    first = dim.groupBy(natural_key).agg(F.min(surrogate).alias(surrogate))
    return (facts.join(first, natural_key, "inner"),
            facts.join(first, natural_key, "left_anti"))

