"""Continuous scoring of arriving samples (J1) with first-arrival de-duplication.

Source: a folder of Parquet files (or any streaming source with the request
schema). The scoring step is the row-local ``score_samples``; the only state
is the de-duplication of repeated sample ids within the watermark. Sink:
Parquet with a checkpoint in the session's checkpoint folder; exactly-once
through the file sink's commit log.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..plans.scoring import ScoringModel, score_samples
from ..session import checkpoint_dir, scratch_path
from .first_arrival import STATE_STORE

REQUEST_SCHEMA = T.StructType([
    T.StructField("sample_id", T.StringType()),
    T.StructField("event_time", T.TimestampType()),
    T.StructField("abundances", T.MapType(T.StringType(), T.DoubleType())),
])


def scored_stream(stream: DataFrame, model: ScoringModel, watermark: str = "1 day",
                  dedup: bool = True) -> DataFrame:
    """Streaming DataFrame of scores; the first arrival of a sample id wins (within the watermark)."""
    s = stream
    if dedup:
        s = s.withWatermark("event_time", watermark).dropDuplicatesWithinWatermark(["sample_id"])
    return score_samples(s, model, keep=["event_time"])


def run_scoring_stream(spark: SparkSession, source_dir: str, model: ScoringModel,
                       sink_dir: str | None = None, checkpoint: str | None = None,
                       available_now: bool = True, watermark: str = "1 day",
                       max_files_per_trigger: int | None = None) -> str:
    """Start (and with ``available_now`` finish) the scoring stream; returns the sink path.

    The ids seen lie in a state store on disk, not in the executors' heaps. It is set for the start of the query
    only; the session's own setting comes back after it.
    """
    reader = spark.readStream.schema(REQUEST_SCHEMA).format("parquet")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    scores = scored_stream(reader.load(source_dir), model, watermark)
    sink_dir = sink_dir or scratch_path(spark, "scores")
    checkpoint = checkpoint or os.path.join(checkpoint_dir(spark), "stream-" + os.path.basename(sink_dir))
    w = (scores.writeStream.format("parquet").outputMode("append")
               .option("path", sink_dir).option("checkpointLocation", checkpoint))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    setting = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(setting)
    spark.conf.set(setting, STATE_STORE)
    try:
        q = w.start()
        if available_now:
            q.awaitTermination()
    finally:
        spark.conf.set(setting, before)
    return sink_dir
