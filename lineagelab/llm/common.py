"""Helpers shared by the operators: table reading, row ids, exact global ranks."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import scratch_path

# Largest estimated size of a side that may be broadcast.
BROADCAST_BYTES = 16 << 20

# Words of every text operator: runs of digits, letters and non-ASCII characters.
WORD_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once under the shared checkpoint folder and read back; zstd, as whole texts pass through it."""
    path = scratch_path(df.sparkSession, name)
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def words_line(text: Column) -> Column:
    """The words of ``text`` (A-Z lower-cased) joined by single blanks; '' for null or none."""
    low = F.translate(F.coalesce(text, F.lit("")), UPPER, UPPER.lower())
    return F.trim(F.regexp_replace(low, WORD_GAP, " "))


def blank_count(line: Column) -> Column:
    return F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit("")))


def with_row_id(df: DataFrame, name: str) -> DataFrame:
    """Adds a unique long per row, in the order of the scan.

    Stable between runs and task retries as long as ``df`` is a scan of files
    (or a projection of one); derived inputs are written first (``materialize``).
    """
    return df.withColumn(name, F.monotonically_increasing_id())


def fits_broadcast(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> bool:
    """True when ``df`` has so few rows that it stays below ``limit`` bytes."""
    most = max(1, limit // row_bytes)
    return df.limit(most + 1).count() <= most


def small_side(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if its counted size allows it, else as it is."""
    return F.broadcast(df) if fits_broadcast(df, row_bytes, limit) else df


def global_rank(df: DataFrame, keys: list, name: str, label: str) -> DataFrame:
    """``df`` with its exact 0-based position ``name`` in the order of ``keys``.

    One range shuffle; each range is sorted in its own task and written, so that
    the count per range and the position within it come from the same files. Only
    the offsets (one row per range) are joined back. No task sees all rows.
    """
    pid, at = f"{name}__pid", f"{name}__at"
    ranged = (df.repartitionByRange(*keys).sortWithinPartitions(*keys)
              .withColumn(pid, F.spark_partition_id())
              .withColumn(at, F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))))
    ranged = materialize(ranged, label)
    sizes = ranged.groupBy(pid).agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy(pid).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(F.col(pid), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("skip"))
    return (ranged.join(F.broadcast(offsets), pid)          # one row per range
            .withColumn(name, (F.col("skip") + F.col(at)).cast("long"))
            .drop(pid, at, "skip"))


def bound_batches(df: DataFrame, size: int = 4 << 20) -> DataFrame:
    """``df``, after setting its session to Arrow batches of at most ``size`` bytes.

    Rows of whole texts vary from a few bytes to megabytes; the default bound of rows
    alone would let a batch of long documents fill a task's memory.
    """
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))
    return df


@contextmanager
def arrow_batches(spark: SparkSession, size: int = 4 << 20) -> Iterator[None]:
    """Arrow batches of at most ``size`` bytes for the jobs that run inside the block; the session's own setting comes back after it."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(size))
    try:
        yield
    finally:
        spark.conf.set(key, before)
