"""First arrival of every sample id, with a table of late and repeated rows.

Keyed state with event-time timeouts (``applyInPandasWithState``). A call of the state function costs
milliseconds, so the ids of a hash bucket share one: its state is the bucket's ids with their last
arrivals, and all its rows of a micro-batch are judged in a few array steps. Time runs on ``arrival_time``,
the moment a row was received; ``event_time`` is what the row says. A row is

* ``late`` when its event time lies more than ``allowed_lateness`` before its arrival,
* ``first`` when it is the earliest arrival of its id that is not late, and
* ``repeat`` otherwise.

Within a micro-batch the rows of an id are taken by (arrival time, event time, payload), so
their order in the source does not matter; across batches the arrival watermark keeps time in
order. An id is remembered for ``remember`` after its last arrival; its bucket's timeout then forgets it, which
bounds it (a later row counts as first again). Every input row leaves with its verdict, so
nothing is lost: the sink is partitioned by it, ``verdict=first`` being the main table.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..session import checkpoint_dir, scratch_path

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
BUCKETS = 1024


def _verdicts(key: str, lateness_ms: int, remember_ms: int, columns: list[str]):
    def judge(bucket: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known, last = (list(state.get[0]), np.array(state.get[1], dtype=np.int64)) if state.exists else ([], np.zeros(0, dtype=np.int64))
        frames = [] if state.hasTimedOut else list(frames)       # the bucket's rows of one micro-batch
        if frames:
            frame = frames[0] if len(frames) == 1 else pd.concat(frames, ignore_index=True)
            arrival, event, payload = (frame[c].to_numpy() for c in ("_arrival_ms", "_event_ms", "_payload"))
            codes, names = pd.factorize(np.array([*known, *frame[key]], dtype=object), use_na_sentinel=False)
            codes = codes[len(known):]                           # known ids are distinct, so their codes are their positions
            late = arrival - event > lateness_ms
            verdict = np.where(late, "late", "repeat").astype(object)
            fresh = np.flatnonzero(~late)
            fresh = fresh[np.lexsort((payload[fresh], event[fresh], arrival[fresh], codes[fresh]))]
            lead = fresh[np.diff(codes[fresh], prepend=-1) != 0]
            verdict[lead[codes[lead] >= len(known)]] = "first"
            seen = np.full(len(names), np.iinfo(np.int64).min)
            seen[:len(known)] = last
            np.maximum.at(seen, codes[fresh], arrival[fresh])
            held = seen > np.iinfo(np.int64).min                 # an id with late rows only is not known yet
            known, last = [None if pd.isna(x) else x for x in names[held]], seen[held]
            out = frame[columns]
            out = out.assign(verdict=verdict)
        stays = last + remember_ms > state.getCurrentWatermarkMs()
        if stays.any():
            state.update(([x for x, s in zip(known, stays) if s], [int(x) for x in last[stays]]))
            state.setTimeoutTimestamp(int(last[stays].min()) + remember_ms)
        elif state.exists:
            state.remove()
        if frames:
            yield out
    return judge


def first_arrivals(stream: DataFrame, key: str = "sample_id", allowed_lateness: float = 86_400.0, remember: float = 30 * 86_400.0,
                   buckets: int = BUCKETS) -> DataFrame:
    """``stream`` (streaming; with ``arrival_time`` and ``event_time``) and the ``verdict`` of each row; spans in seconds.

    ``buckets`` is the number of states; more of them hold fewer ids each. It stays what it was for the life of a checkpoint.
    A NULL id is an id like any other; a row without an arrival or event time gets the verdict ``invalid``.
    """
    columns = stream.columns
    timed = F.col("arrival_time").isNotNull() & F.col("event_time").isNotNull()
    invalid = stream.where(~timed).withColumn("verdict", F.lit("invalid"))
    work = (stream.where(timed).withWatermark("arrival_time", "0 seconds")
            .withColumn("_arrival_ms", F.unix_millis("arrival_time")).withColumn("_event_ms", F.unix_millis("event_time"))
            .withColumn("_payload", F.xxhash64(*[F.to_json(F.struct(c)) if isinstance(stream.schema[c].dataType, T.MapType) else F.col(c) for c in columns])))
    out = T.StructType([*stream.schema.fields, T.StructField("verdict", T.StringType())])
    state = T.StructType([T.StructField("ids", T.ArrayType(stream.schema[key].dataType)), T.StructField("last_ms", T.ArrayType(T.LongType()))])
    judged = work.withColumn("_bucket", F.pmod(F.xxhash64(key), F.lit(buckets))).groupBy("_bucket").applyInPandasWithState(
        _verdicts(key, int(allowed_lateness * 1000), int(remember * 1000), columns), outputStructType=out, stateStructType=state,
        outputMode="Append", timeoutConf=GroupStateTimeout.EventTimeTimeout)
    return judged.unionByName(invalid)


def run_first_arrivals(spark: SparkSession, source_dir: str, schema: T.StructType, key: str = "sample_id", allowed_lateness: float = 86_400.0,
                       remember: float = 30 * 86_400.0, sink_dir: str | None = None, checkpoint: str | None = None,
                       max_files_per_trigger: int | None = None) -> str:
    """Read what lies in ``source_dir`` as a stream, write it with its verdicts (partitioned by them); returns the sink path.

    A restart with the same checkpoint goes on where the last run ended. The state store is set
    for the run only; the session's own setting comes back after it.
    """
    reader = spark.readStream.schema(schema).format("parquet")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    setting = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(setting)
    spark.conf.set(setting, STATE_STORE)
    try:
        sink_dir = sink_dir or scratch_path(spark, "arrivals")
        checkpoint = checkpoint or os.path.join(checkpoint_dir(spark), "stream-" + os.path.basename(sink_dir))
        rows = first_arrivals(reader.load(source_dir), key, allowed_lateness, remember)
        query = (rows.writeStream.format("parquet").outputMode("append").partitionBy("verdict").option("path", sink_dir)
                 .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
        query.awaitTermination()
    finally:
        spark.conf.set(setting, before)
    return sink_dir
