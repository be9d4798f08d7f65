"""First arrivals (J2): repeats in and across batches, late rows, forgetting, restart."""

import datetime as dt
import os

from pyspark.sql import types as T

from lineagelab.streaming.first_arrival import run_first_arrivals

SCHEMA = T.StructType([T.StructField("sample_id", T.StringType()), T.StructField("arrival_time", T.TimestampType()),
                       T.StructField("event_time", T.TimestampType()), T.StructField("abundances", T.MapType(T.StringType(), T.DoubleType())),
                       T.StructField("n", T.IntegerType())])


def row(sample, minute, n, age=0):
    at = dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minute)
    return (sample, at, at - dt.timedelta(minutes=age), {"a": float(n)}, n)


def test_first_repeat_late_and_restart(spark, tmp_path):
    src, sink, ckpt = (str(tmp_path / x) for x in ("src", "sink", "ckpt"))

    def batch(rows):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(src)
        run_first_arrivals(spark, src, SCHEMA, allowed_lateness=600, remember=3600 * 5, sink_dir=sink, checkpoint=ckpt)

    # out of order in the batch; "b" has only a late row so far
    batch([row("a", 9, 1), row("a", 3, 2), row("b", 5, 3, age=60), row("c", 1, 4), ("q", None, dt.datetime(2024, 1, 1), {}, 14)])
    batch([row("a", 20, 5), row("b", 21, 6), row("b", 22, 7), row("d", 23, 8, age=10)])
    batch([row("c", 30, 9, age=11), row("z", 600, 10)])
    batch([row("z", 700, 11)])
    # "a" was last seen at minute 20 and forgotten five hours later; "z" is still known
    batch([row("a", 701, 12), row("z", 702, 13)])
    got = {r.n: r.verdict for r in spark.read.parquet(sink).collect()}
    assert got == {1: "repeat", 2: "first", 3: "late", 4: "first", 5: "repeat", 6: "first", 7: "repeat", 8: "first", 9: "late", 10: "first",
                   11: "repeat", 12: "first", 13: "repeat", 14: "invalid"}
    assert os.path.isdir(os.path.join(sink, "verdict=first"))
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass").endswith("HDFSBackedStateStoreProvider")


def test_many_ids_share_a_call_and_are_forgotten_one_by_one():
    from lineagelab.streaming import first_arrival as FA
    judge = FA._verdicts("sample_id", 0, 1000, ["sample_id"])

    class State:
        exists, hasTimedOut, value, timeout = False, False, None, None
        mark = 0
        get = property(lambda self: self.value)
        getCurrentWatermarkMs = lambda self: self.mark           # noqa: E731

        def update(self, v):
            self.value, self.exists = v, True

        def remove(self):
            self.value, self.exists = None, False

        def setTimeoutTimestamp(self, ms):
            assert ms > self.mark
            self.timeout = ms

    import pandas as pd

    def frame(*rows):
        return pd.DataFrame([(i, a, e, 0) for i, a, e in rows], columns=["sample_id", "_arrival_ms", "_event_ms", "_payload"])

    state = State()
    out = list(judge((0,), iter([frame(("a", 5, 5), ("b", 7, 7), (None, 9, 9)), frame(("a", 3, 3), ("c", 8, 1))]), state))[0]
    assert list(out["verdict"]) == ["repeat", "first", "first", "first", "late"]
    assert dict(zip(*state.value)) == {"a": 5, "b": 7, None: 9} and state.timeout == 1005
    state.mark, state.hasTimedOut = 1006, True
    assert list(judge((0,), iter([]), state)) == [] and dict(zip(*state.value)) == {"b": 7, None: 9}
    state.hasTimedOut = False
    out = list(judge((0,), iter([frame((None, 1007, 1007), ("a", 1007, 1007), ("b", 1007, 1007))]), state))[0]
    assert list(out["verdict"]) == ["repeat", "first", "repeat"]
    state.mark, state.hasTimedOut = 9000, True
    list(judge((0,), iter([]), state))
    assert not state.exists
