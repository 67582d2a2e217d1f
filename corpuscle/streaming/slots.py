"""A stream's slot state: who started a check within the hour may not start another."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StructField, StructType

#: Milliseconds for which a started check holds its user's slot.
HOLD = 3_600_000
SLOTS = "user string, at timestamp, accepted boolean, wait_s long"
#: Spark keeps state of this kind in RocksDB alone.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Slot(StatefulProcessor):
    """One number for each user, the start that holds the slot; a timer clears it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.start = handle.getValueState("start", StructType([StructField("at", LongType())]))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        held = self.start.get()[0] if self.start.exists() else None
        before, out = held, []
        events = pd.concat(list(rows)).sort_values(["at", "kind"], kind="stable")
        for at, kind in zip(events["at"], events["kind"]):
            now = at.value // 1_000_000
            if kind == "clear":
                held = None
                continue
            free = held is None or now - held >= HOLD
            if free:
                held = now
            out.append((key[0], at, free, 0 if free else (HOLD - (now - held)) // 1000))
        if held != before:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            if held is None:
                self.start.clear()
            else:
                self.start.update((held,))
                self.handle.registerTimer(held + HOLD)
        yield pd.DataFrame(out, columns=["user", "at", "accepted", "wait_s"]).astype({"at": "datetime64[ns]", "accepted": bool, "wait_s": "int64"})

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        self.start.clear()
        yield pd.DataFrame({"user": pd.Series([], dtype=str), "at": pd.Series([], dtype="datetime64[ns]"), "accepted": pd.Series([], dtype=bool), "wait_s": pd.Series([], dtype="int64")})

    def close(self) -> None:
        pass


def hourly_slots(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """``user, at, accepted, wait_s``: every start, whether its user's slot was free, else the seconds until it is.

    ``events``: user, at, kind (``start``, or ``clear``, which frees the slot). A start is
    accepted if none of its user was accepted within the hour before. State is one number
    for each user who holds a slot; it goes an hour of event time after the start. The
    session needs the state store of :data:`STORE`.
    """
    rows = events.select("user", "at", "kind").withWatermark("at", late)
    return rows.groupBy("user").transformWithStateInPandas(Slot(), SLOTS, "Append", "EventTime")
