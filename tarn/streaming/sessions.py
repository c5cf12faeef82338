"""Sessions of users over an event stream: keyed state with timers, so a session ends by time, not by a next event.

A user's open sessions are kept as intervals. New events, in any order, open intervals or widen and join those nearer than
the gap; a timer at the first interval's end plus the gap hands on all whose ends the watermark is past, and is set again for the first
of the others: one timer a user, however many sessions. What is kept for a user is bounded by how far the watermark lags behind.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUTPUT = "user_id long, first_ms long, last_ms long, n long, total double"


def joined(intervals: list[tuple], gap: int) -> list[tuple]:
    """``(first, last, n, total)`` in order, with those nearer than ``gap`` made one."""
    out: list[tuple] = []
    for first, last, n, total in sorted(intervals):
        if out and first - out[-1][1] <= gap:
            a, b, m, s = out[-1]
            out[-1] = (a, max(b, last), m + n, s + total)
        else:
            out.append((first, last, n, total))
    return out


class Sessions(StatefulProcessor):
    def __init__(self, gap: int) -> None:
        self.gap = gap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", "first_ms long, last_ms long, n long, total double")

    def _held(self) -> list[tuple]:
        return [tuple(r) for r in self.open.get()]

    def _keep(self, intervals: list[tuple]) -> None:
        if intervals:
            self.open.put(intervals)
        else:
            self.open.clear()

    def _wake(self, held: list[tuple], known: list[tuple]) -> None:
        """A timer for the first of ``held`` to end, unless one of ``known`` has set it."""
        if held:
            first = min(s[1] for s in held)
            if not known or min(s[1] for s in known) != first:
                self.handle.registerTimer(first + self.gap + 1)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = self._held()
        held = list(known)
        for x in rows:
            held += [(t, t, 1, v) for t, v in zip(x["ms"].tolist(), x["value"].fillna(0.0).astype(float).tolist(), strict=True)]
        held = joined(held, self.gap)
        self._keep(held)
        self._wake(held, known)
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        held = self._held()
        over = [s for s in held if s[1] + self.gap + 1 < now or s[1] + self.gap + 1 == expiredTimerInfo.getExpiryTimeInMs()]
        if over:
            left = [s for s in held if s not in over]
            self._keep(left)
            self._wake(left, over)
        yield pd.DataFrame([(key[0], *s) for s in over], columns=["user_id", "first_ms", "last_ms", "n", "total"])

    def close(self) -> None:
        pass


def sessions(events: DataFrame, gap_ms: int, late: str = "0 seconds") -> DataFrame:
    """``user_id, first_ms, last_ms, n, total`` of each session of a stream with ``user_id, ts, value``, once it is over."""
    x = events.select(F.col("user_id").cast("long").alias("user_id"), F.col("ts").cast("timestamp").alias("ts"), "value").dropna(subset=["user_id", "ts"])
    x = x.withColumn("ms", F.unix_millis("ts")).withWatermark("ts", late)
    return x.groupBy("user_id").transformWithStateInPandas(Sessions(gap_ms), OUTPUT, "append", "eventTime")


def write_sessions(stream: DataFrame, path: str, checkpoint: str):
    """Append finished sessions to Parquet, exactly once; state lives in RocksDB, which the operator needs."""
    spark = stream.sparkSession
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        return stream.writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).format("parquet").start(path)
    finally:
        if before is None:
            spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
        else:
            spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
