"""Alert life cycle on a stream of evaluations: pending, firing, repeated, resolved."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructField, StructType

STATE = StructType([
    StructField("status", StringType()), StructField("since", LongType()),
    StructField("sent", LongType()), StructField("seen", LongType()),
])
OUTPUT = "series string, ts timestamp, since timestamp, event string"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class AlertLifecycle(StatefulProcessor):
    """Keeps one small record per series; rows of a series are handled in time order within a batch.

    A timer resolves alerts whose series has sent nothing for ``stale_seconds``.
    """

    def __init__(self, for_seconds: int, repeat_seconds: int, stale_seconds: int) -> None:
        self.wait, self.repeat, self.stale = (s * 1_000_000 for s in (for_seconds, repeat_seconds, stale_seconds))

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.record = handle.getValueState("alert", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # one evaluation per series and step arrives here, see ``alert_events``
        batch = pd.concat(rows).sort_values("ts")
        status, since, sent, seen = self.record.get() if self.record.exists() else ("inactive", 0, 0, 0)
        out = []
        for ts, active in zip(batch["ts"].to_numpy("datetime64[us]").astype("int64"), batch["active"]):
            ts = int(ts)
            if status != "inactive" and ts - seen > self.stale:
                if status == "firing":
                    out.append((seen + self.stale, since, "resolved"))
                status = "inactive"
            if active and status == "inactive":
                status, since = "pending", ts
                if self.wait > 0:
                    out.append((ts, since, "pending"))
            if active and status == "pending" and ts - since >= self.wait:
                status, sent = "firing", ts
                out.append((ts, since, "firing"))
            elif active and status == "firing" and ts - sent >= self.repeat:
                sent = ts
                out.append((ts, since, "repeated"))
            elif not active and status != "inactive":
                if status == "firing":
                    out.append((ts, since, "resolved"))
                status = "inactive"
            seen = ts
        self.record.update((status, since, sent, seen))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if status != "inactive":
            self.handle.registerTimer((seen + self.stale) // 1000)
        yield self._frame(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        status, since, sent, seen = self.record.get()
        out = [(seen + self.stale, since, "resolved")] if status == "firing" else []
        self.record.update(("inactive", 0, 0, seen))
        yield self._frame(key, out)

    @staticmethod
    def _frame(key, out: list[tuple[int, int, str]]) -> pd.DataFrame:
        frame = pd.DataFrame(out, columns=["ts", "since", "event"])
        frame.insert(0, "series", key[0])
        for name in ("ts", "since"):
            frame[name] = pd.to_datetime(frame[name], unit="us")
        return frame

    def close(self) -> None:
        pass


@contextmanager
def rocksdb(spark: SparkSession):
    """The state provider stateful processors need, for queries started inside."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)


def alert_events(
    evaluations: DataFrame, for_seconds: int, repeat_seconds: int = 4 * 3600, stale_seconds: int = 24 * 3600
) -> DataFrame:
    """Life-cycle events of a stream of (series, ts, active).

    Feed it one row per series and evaluation step (a closed window of ``rollups.tumbling``), so that a busy series
    has been reduced before its rows meet.
    """
    return evaluations.select("series", "ts", "active").groupBy("series").transformWithStateInPandas(
        statefulProcessor=AlertLifecycle(for_seconds, repeat_seconds, stale_seconds),
        outputStructType=OUTPUT, outputMode="Append", timeMode="EventTime",
    )


def hourly_evaluations(stream: DataFrame, ts: str, series: str, value: str, limit: float) -> DataFrame:
    """Whether a series' hourly mean is above a limit; the stream has a watermark on ``ts``."""
    return (
        stream.groupBy(F.window(ts, "1 hour").alias("w"), F.col(series).alias("series"))
        .agg((F.avg(value) > limit).alias("active"))
        .select("series", F.window_time("w").alias("ts"), "active", F.col("w.start").alias("start"))
    )
