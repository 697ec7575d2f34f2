"""Streaming forms of the panel operators: windows, sessions, deduplication and stateful smoothing."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def windowed(stream: DataFrame, width: str = "1 hour", slide: str | None = None, late: str = "2 hours", by: str = "series_id") -> DataFrame:
    """Count, sum and mean of y by tumbling or sliding window; rows later than ``late`` are dropped with their state."""
    s = stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    out = s.groupBy(F.window("ts", width, slide) if slide else F.window("ts", width), by).agg(F.count("y").alias("n"), F.sum("y").alias("total"), F.avg("y").alias("mean"))
    return out.select(by, F.col("window.start").alias("start"), F.col("window.end").alias("end"), "n", "total", "mean")


def sessions(stream: DataFrame, gap: str = "30 minutes", late: str = "2 hours", by: str = "series_id") -> DataFrame:
    s = stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return s.groupBy(F.session_window("ts", gap), by).agg(F.count("y").alias("n")).select(by, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def distinct_rows(stream: DataFrame, keys: list[str], late: str = "2 hours") -> DataFrame:
    return stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def smoothed(stream: DataFrame, alpha: float = 0.5, by: str = "series_id", late: str = "2 hours", idle: int = 7 * 24 * 3600) -> DataFrame:
    """Simple exponential smoothing with the level as state: (series_id, ts, y, level) of each row, in order within a batch.

    Rows later than ``late`` are dropped; a series without rows for ``idle`` seconds of event time loses its state and starts anew.
    """

    def step(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        level = state.get[0] if state.exists else None
        rows = pd.concat(list(frames)).sort_values("ts")
        out = []
        for y in rows["y"]:
            level = y if level is None else alpha * y + (1 - alpha) * level
            out.append(level)
        if level is not None:
            state.update((float(level),))
            state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs(), int(rows["ts"].max().timestamp() * 1000)) + idle * 1000)
        yield pd.DataFrame({by: key[0], "ts": rows["ts"], "y": rows["y"], "level": out})

    timed = stream.dropna(subset=["y"]).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(by).applyInPandasWithState(
        step, f"{by} string, ts timestamp, y double, level double", "level double", "append", GroupStateTimeout.EventTimeTimeout
    )


def tracked(stream: DataFrame, dt: float = 0.1, q: float = 0.1, r: float = 1.0, by: str = "series_id", late: str = "2 hours", idle: int = 7 * 24 * 3600) -> DataFrame:
    """The constant-velocity filter of recurrences.kalman() on a stream: (series_id, ts, y, position, velocity) of each row.

    A series' state is its estimate, its covariance and its last time. Rows of a batch are taken in order of time; rows later than ``late``
    are dropped by the watermark, and a row that comes after one with a later time has gone by has no place in the filter's path and
    is dropped too. A timer of event time forgets a series that has had no rows for ``idle`` seconds; it then starts anew.
    Needs the RocksDB state store (spark.sql.streaming.stateStore.providerClass).
    """
    from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

    class Filter(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.track = handle.getValueState("track", "x double, v double, xx double, xv double, vv double, last timestamp")

        def handleInputRows(self, key, rows, timers) -> Iterator[pd.DataFrame]:
            x, v, xx, xv, vv, last = self.track.get() if self.track.exists() else (0.0, 0.0, 1.0, 0.0, 1.0, None)
            new = pd.concat(list(rows)).sort_values("ts", kind="stable")
            new = new if last is None else new[new["ts"] >= pd.Timestamp(last)]
            out = []
            for z in new["y"]:
                x, xx, xv, vv = x + dt * v, xx + 2 * dt * xv + dt * dt * vv + q, xv + dt * vv, vv + q
                gain, along, miss = xx / (xx + r), xv / (xx + r), z - x
                x, v = x + gain * miss, v + along * miss
                xx, xv, vv = xx - gain * xx, xv - gain * xv, vv - along * xv
                out.append((x, v))
            if out:
                last = new["ts"].iloc[-1]
                self.track.update((x, v, xx, xv, vv, last.to_pydatetime()))
                for timer in list(self.handle.listTimers()):
                    self.handle.deleteTimer(timer)
                self.handle.registerTimer(max(timers.getCurrentWatermarkInMs(), int(last.timestamp() * 1000)) + idle * 1000)
            yield pd.DataFrame({by: key[0], "ts": new["ts"], "y": new["y"], "position": [p for p, _ in out], "velocity": [s for _, s in out]})

        def handleExpiredTimer(self, key, timers, expired) -> Iterator[pd.DataFrame]:
            self.track.clear()
            yield from ()

        def close(self) -> None:
            pass

    timed = stream.dropna(subset=["y"]).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).select(by, "ts", "y")
    return timed.groupBy(by).transformWithStateInPandas(Filter(), f"{by} string, ts timestamp, y double, position double, velocity double", "append", "eventTime")


def out_of_control(stream: DataFrame, limits: DataFrame, by: str = "series_id") -> DataFrame:
    """Rows outside fixed limits (series_id, lcl, ucl), a static frame."""
    return stream.join(limits, by).where((F.col("y") > F.col("ucl")) | (F.col("y") < F.col("lcl")))
