"""Sharding along a Hilbert curve over metadata dimensions.

Every document gets a cell in a grid of three quantised dimensions (source, lang,
size) and that cell's index on the Hilbert curve. The documents, sorted by curve
index, text digest, doc_id and size, are cut into ``shards`` runs of equal row
count (law ``rows``: counts at most one apart). Neighbours on the curve are near in
all dimensions, so a file of a run has narrow ranges in each and predicates on any
of them skip files. Equal texts of one cell stay adjacent.

Strings are quantised by rank of equal-depth bins over their distinct values in name
order, sizes by binary logarithm, both to ``2**BITS`` levels.

The order is total up to fully equal rows, so the result does not depend on
partitioning. Positions come from one range shuffle with per-range counts; a cell
with a third of all rows is split among ranges by the further keys.

Edge cases: a null text has size 16 and the crc32 of the empty string; null source
or lang sort first as a category of their own; equal rows are neighbours; fewer
rows than shards leave the last shards empty; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import global_rank, small_side

BITS = 4
DIMENSIONS = ("source", "lang", "size")
SHARDS = 40


def hilbert_index(x: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Curve index of integer points ``x[dimension, point]`` with ``bits`` bits a dimension."""
    x = x.astype(np.int64).copy()
    n = len(x)
    for b in range(bits - 1, 0, -1):                             # undo the excess of each level
        q = 1 << b
        p = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            t = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(high, p, t)
            if i:
                x[i] ^= t
    for i in range(1, n):                                        # Gray code
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        t ^= np.where(x[n - 1] & (1 << b), (1 << b) - 1, 0)
    x ^= t
    out = np.zeros_like(t)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            out = (out << 1) | ((x[i] >> b) & 1)
    return out


@F.pandas_udf(T.LongType())
def _hilbert(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for a, b, c in batches:
        yield pd.Series(hilbert_index(np.stack([a.to_numpy(), b.to_numpy(), c.to_numpy()])))


def size_of(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("long")


def size_level(size: Column, bits: int = BITS) -> Column:
    """Binary logarithm of the size (16 is 0), at most 2**bits - 1."""
    return F.least(F.length(F.bin(F.floor(size / 16).cast("long"))) - 1, F.lit((1 << bits) - 1)).cast("int")


def _levels(rows: DataFrame, column: str, bits: int = BITS) -> DataFrame:
    """(value, level): equal-depth bins of the distinct values in name order, by their row counts."""
    counts = rows.groupBy(F.col(column).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy(F.col("v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    # one row per distinct value, not per document
    return counts.select("v", F.least(
        F.floor(F.coalesce(F.sum("n").over(before), F.lit(0)) * (1 << bits) / F.sum("n").over(every)),
        F.lit((1 << bits) - 1)).cast("int").alias("level"))


def placed(rows: DataFrame, shards: int = SHARDS) -> DataFrame:
    """``rows`` (with source, lang, size, text_crc32, doc_id) plus hilbert, shard and slot."""
    out = rows
    for d in ("source", "lang"):
        levels = small_side(_levels(rows, d), 64).select(F.col("v").alias(f"_v_{d}"), F.col("level").alias(f"_q_{d}"))
        out = out.join(levels, out[d].eqNullSafe(levels[f"_v_{d}"])).drop(f"_v_{d}")
    out = (out.withColumn("hilbert", _hilbert(F.col("_q_source"), F.col("_q_lang"), size_level(F.col("size"))))
           .drop("_q_source", "_q_lang"))
    ranked = global_rank(out, ["hilbert", "text_crc32", "doc_id", "size"], "_rank", "shards")
    n = ranked.count()
    short, extra = divmod(n, shards)
    wide = extra * (short + 1)                                   # rows in the shards that have one more
    rank = F.col("_rank")
    shard = F.when(rank < wide, F.floor(rank / (short + 1))).otherwise(extra + F.floor((rank - wide) / max(short, 1)))
    start = F.when(F.col("shard") < extra, F.col("shard") * (short + 1)).otherwise(wide + (F.col("shard") - extra) * short)
    return (ranked.withColumn("shard", shard.cast("int"))
            .withColumn("slot", (rank - start).cast("long")).drop("_rank"))


def shard_rows(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard (null) and hilbert per document."""
    rows = docs.select("doc_id", F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"),
                       size_of(F.col("text")).alias("size"),
                       F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"))
    return placed(rows, shards).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "hilbert")


def write_order(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """The documents in curve order with their ``shard`` and ``slot`` (same-named columns are replaced).

    The files that are written follow the ranges of the curve.
    """
    own = [c for c in docs.columns if c not in ("shard", "slot")]
    packed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in own]).alias("_row"), F.col("doc_id"),
        F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"),
        size_of(F.col("text")).alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"))
    return placed(packed, shards).select("_row.*", "shard", "slot")


def summary(sharded: DataFrame) -> DataFrame:
    """Rows, bytes and curve range of each shard, as written to a manifest."""
    return sharded.groupBy("shard").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("size").alias("bytes"),
        F.min("hilbert").alias("first_index"), F.max("hilbert").alias("last_index"))
