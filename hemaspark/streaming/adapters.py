"""Streams of measurements. Row-local stages (masks, flags, marks, alignment, gates, transport, corrections) take streaming
DataFrames as they are; what compares rows is here."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from ..functions.columns import c, num


def drop_duplicates(df: DataFrame, time_col: str, delay: str = "1 day", keys: list[str] | None = None) -> DataFrame:
    """Rows that repeat within the watermark go; state older than that is forgotten."""
    return df.withWatermark(time_col, delay).dropDuplicatesWithinWatermark(keys or df.columns)


def windowed_counts(df: DataFrame, time_col: str, key: str, width: str = "1 hour", delay: str = "1 day") -> DataFrame:
    return df.withWatermark(time_col, delay).groupBy(F.window(time_col, width), c(key).alias("key")).agg(F.count(F.lit(1)).alias("n"))


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Consolidator(StatefulProcessor):
    """A sample's two earliest measurements as list state, and a timer in event time that ends its wait."""

    def __init__(self, measures: list[str], spread: dict[str, float], threshold: float, wait_ms: int) -> None:
        self.measures, self.spread, self.threshold, self.wait_ms = measures, spread, threshold, wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getListState("rows", "at long, measured array<double>")

    def _take(self, frames: Iterable[pd.DataFrame], timers: TimerValues) -> None:
        """Adds rows (at, measures...), keeps the two earliest, and moves the timer to the end of the earliest one's wait."""
        rows = [(int(at), [None if v is None else float(v) for v in measured]) for at, measured in self.rows.get()]
        for pdf in frames:
            for r in pdf.itertuples(index=False):
                rows.append((pd.Timestamp(r.at).value // 1000, [None if pd.isna(v) else float(v) for v in r[-len(self.measures) :]]))
            rows = sorted(rows, key=lambda r: (r[0], [(v is not None, v or 0.0) for v in r[1]]))[:2]
        if not rows:
            return
        self.rows.put(rows)
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old[0] if isinstance(old, (tuple, list)) else old)
        self.handle.registerTimer(max(rows[0][0] // 1000 + self.wait_ms, timers.getCurrentWatermarkInMs() + 1))

    def handleInitialState(self, key: tuple, initialState: pd.DataFrame, timerValues: TimerValues) -> None:  # noqa: N803 - Spark passes by name
        self._take([initialState], timerValues)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:  # noqa: N803
        self._take(rows, timerValues)
        yield from ()

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N803
        rows = [(at, list(measured)) for at, measured in self.rows.get()]
        self.rows.clear()
        at, first = rows[0]
        verdict = "single"
        if len(rows) > 1:
            agree = sum(not (a is not None and b is not None and abs(a - b) > self.threshold * self.spread[m]) for m, a, b in zip(self.measures, first, rows[1][1], strict=True))
            verdict = "agree" if agree == len(self.measures) else "one_different" if agree == len(self.measures) - 1 else "odd"
        yield pd.DataFrame([[key[0], verdict, pd.Timestamp(at * 1000), *first]], columns=["id", "verdict", "at", *self.measures])

    def close(self) -> None:
        pass


def consolidate(df: DataFrame, id_col: str, time_col: str, measures: list[str], spread: dict[str, float], threshold: float = 1.0, wait_ms: int = 86_400_000, delay: str = "1 day", initial: DataFrame | None = None) -> DataFrame:
    """(id, verdict, at, measures...): for each sample, once its wait is over, its two earliest measurements compared as in batch:
    single, agree, one_different (the earliest row's values) or odd. `spread` are the measures' deviations, from a batch.

    State holds two rows a sample, whatever the number of measurements; event time and the watermark end the wait. `initial` is a
    batch table of the same columns whose samples the stream begins with: rows that came before the stream count as if it had seen
    them. Rows without a number or time are left out. Sets the session's state store to RocksDB, which such state needs.
    """
    df.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    out = T.StructType([T.StructField("id", T.StringType()), T.StructField("verdict", T.StringType()), T.StructField("at", T.TimestampType()), *[T.StructField(m, T.DoubleType()) for m in measures]])
    slim = lambda d: d.select(c(id_col).cast("string").alias("id"), c(time_col).cast("timestamp").alias("at"), *[num(d, m).alias(m) for m in measures]).where("id is not null and at is not null")
    processor = Consolidator(measures, spread, threshold, wait_ms)
    start = slim(initial).groupBy("id") if initial is not None else None
    return slim(df).withWatermark("at", delay).groupBy("id").transformWithStateInPandas(processor, out, "append", "eventTime", start)
