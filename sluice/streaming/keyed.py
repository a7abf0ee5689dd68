"""Keyed state on streams: the first row of each key, and windows that rows leave by themselves.

Both need the RocksDB state store (``use_state``), which keeps state on disk and its
changes in the checkpoint folder.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import IntegerType, StructField, StructType

from ..operators.rows import ARRIVAL, time_of
from ..plans.spec import TimeWindow

# processors go to executors by value, so these need no package of their own
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Groups of rows that leave a window at the same time, so that no task holds them all.
GROUPS = 64


def use_state(spark: SparkSession) -> None:
    """Keep the state of new streaming queries in RocksDB."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class FirstRow(StatefulProcessor):
    """Remembers a key, for expiry milliseconds after it came if that is given; passes on its first row."""

    def __init__(self, place: str, expiry: int | None):
        self.place, self.expiry = place, expiry

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "seen boolean", self.expiry) if self.expiry else handle.getValueState("seen", "seen boolean")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        first = min(rows, key=lambda r: r[self.place])
        if not self.seen.exists():
            self.seen.update((True,))
            yield first

    def close(self) -> None:
        pass


def first_per_key(df: DataFrame, keys: list[str], place: str, expiry: float | None = None) -> DataFrame:
    """The first row of each key, as it comes; of a batch's rows the one of the smallest place.

    Keys are kept for good, or forgotten expiry seconds after they came, whereupon
    their next row counts as a first one.  Keys that aren't there don't count.
    """
    keys = [k for k in keys if k in df.columns]
    if not keys:
        return df
    use_state(df.sparkSession)
    processor = FirstRow(place, round(1000 * expiry) if expiry else None)
    return df.groupBy(*[f"`{k}`" for k in keys]).transformWithState(processor, df.schema, "Append", "ProcessingTime" if expiry else "None")


class Leaving(StatefulProcessor):
    """Passes rows on with op 1, holds them until their slot's time, and takes them back with op -1."""

    def __init__(self, names: list[str], kinds: StructType, step: int):
        self.names, self.kinds, self.step = names, kinds, step

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", self.kinds)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        slot = key[0]
        if slot is None:  # without a time they stay
            for r in rows:
                yield Row(op=1, **{n: r[n] for n in self.names})
            return
        end = slot * self.step
        if end <= timerValues.getCurrentProcessingTimeInMs():
            return
        came = [tuple(r[n] for n in self.names) for r in rows]
        if not self.held.exists():
            self.handle.registerTimer(end)
        self.held.appendList(came)
        for x in came:
            yield Row(op=1, **dict(zip(self.names, x)))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        for x in self.held.get():
            yield Row(op=-1, **dict(zip(self.names, x)))
        self.held.clear()

    def close(self) -> None:
        pass


def follow_interval(seconds: float) -> float:
    """How often a rolling window of so many seconds is looked at."""
    return min(5.0, max(1.0, seconds / 10))


def rolling(df: DataFrame, w: TimeWindow, hint: str | None = None, step: float | None = None) -> DataFrame:
    """A rolling window over a stream as changes: each row with op 1 when it comes in, and with op -1 when it leaves.

    Rows leave on timers, whether or not others come, at most step seconds late.  Time
    is that of the window's column, or of arrival where there is none; rows without a
    time stay, rows that are too old never come in.
    """
    use_state(df.sparkSession)
    step = round(1000 * (step or follow_interval(w.seconds)))
    ts: Column = time_of(df, w.column, hint) if w.column in df.columns else F.col(ARRIVAL)
    slot = F.ceil((F.unix_millis(ts) + F.lit(round(1000 * w.seconds))) / F.lit(step)).cast("long")
    keyed = df.withColumns({"_slot": slot, "_group": F.pmod(F.xxhash64(*[c for c in df.columns]), F.lit(GROUPS))})
    out = StructType([StructField("op", IntegerType()), *df.schema.fields])
    return keyed.groupBy("_slot", "_group").transformWithState(Leaving(df.columns, df.schema, step), out, "Append", "ProcessingTime")
