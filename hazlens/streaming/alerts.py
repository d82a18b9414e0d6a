"""Alerts that expire: so many events of a key within so many days, with state that is let go."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from hazlens import session

DAY = 86_400_000_000


class WithinDays(StatefulProcessor):
    """Counts each event with those of its key in the ``days`` up to it; keeps an event only while one to come can count it.

    An event that comes late, but not after the watermark, adds to the counts of those after it, which are told again.
    """

    def __init__(self, span: int, least: int) -> None:
        self.span, self.least = span, least

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.recent = handle.getListState("recent", "at long, id long")

    def _held(self) -> list[tuple[int, int]]:
        return [tuple(x) for x in self.recent.get()] if self.recent.exists() else []

    def _keep(self, events: list[tuple[int, int]], watermark: int) -> None:
        """The events that one at the watermark or later still counts, and a timer for when the last of them is of no use."""
        kept = [e for e in events if e[0] >= watermark - self.span]
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if kept:
            self.recent.put(kept)
            self.handle.registerTimer((kept[-1][0] + self.span) // 1000 + 1)
        else:
            self.recent.clear()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = [e for d in rows for e in zip(d["at__"].tolist(), d["id__"].tolist(), strict=True)]
        events = sorted([*self._held(), *new])
        first, low, high, told = min(new)[0], 0, 0, []
        for at, name in events:
            # those of the same time count each other
            while high < len(events) and events[high][0] <= at:
                high += 1
            while events[low][0] < at - self.span:
                low += 1
            if at >= first and high - low >= self.least:
                told.append((key[0], name, at, high - low))
        self._keep(events, timerValues.getCurrentWatermarkInMs() * 1000)
        if told:
            yield pd.DataFrame(told, columns=["key", "id", "at", "n"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self._keep(sorted(self._held()), timerValues.getCurrentWatermarkInMs() * 1000)
        return iter(())

    def close(self) -> None:
        """Nothing is held."""


def within_days(stream: DataFrame, by: str, ts: str, name: str, days: int, least: int, late: str = "1 day") -> DataFrame:
    """(key, id, at, n) of each event that is the ``least``-th or later of its key within ``days``, ends included.

    ``name`` is a whole number that names an event. An event is told again when one that came late raises its
    count, so the largest ``n`` of an id holds. The state of a key is its events of ``days`` before the watermark and after it.
    """
    conf = stream.sparkSession.conf
    if conf.get("spark.sql.streaming.stateStore.providerClass") != session.ROCKSDB:
        conf.set("spark.sql.streaming.stateStore.providerClass", session.ROCKSDB)
    # names that begin with an underscore don't reach Python
    timed = stream.where(F.col(by).isNotNull() & F.col(ts).isNotNull()).withWatermark(ts, late).select(F.col(by), ts, F.unix_micros(ts).alias("at__"), F.col(name).cast("long").alias("id__"))
    kind = dict(stream.dtypes)[by]
    return timed.groupBy(by).transformWithStateInPandas(WithinDays(days * DAY, least), outputStructType=f"key {kind}, id long, at long, n long", outputMode="Update", timeMode="EventTime")


def settled(told: DataFrame) -> DataFrame:
    """One row an event: its last count."""
    return told.groupBy("key", "id").agg(F.timestamp_micros(F.max("at")).alias("at"), F.max("n").alias("n"))
