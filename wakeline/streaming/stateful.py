"""Per-vessel state in streams: reports put in order, open silences told by timers, runs of a condition that close late.

What arrives within the watermark's delay is held in a list until the watermark has passed it, and then goes through
the state in order of time. So the rows that come out are those of the batch operators on all reports up to the
watermark, in whatever order they arrived. Reports older than the watermark are dropped by Spark.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
GAPS = "mmsi string, gap_start timestamp, gap_end timestamp, open boolean"
RUNS = "mmsi string, start timestamp, end timestamp, n long"
STATE = {"last": "last long, told boolean", "run": "start long, end long, n long"}


def use_rocks(spark: SparkSession) -> None:
    """Timers and lists need the state store on disk."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


class InOrder(StatefulProcessor):
    """Holds rows (time in ms, whether the condition holds) until the watermark has passed them; subclasses fold them."""

    state = ""
    columns: tuple[str, ...] = ()

    def init(self, handle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "t long, hit boolean")
        self.own = handle.getValueState(self.state, STATE[self.state])

    def step(self, own, t: int, hit: bool, out: list):
        """The state after a row."""
        raise TypeError("a subclass tells what a row does")

    def due(self, own, now: int, out: list):
        """The state after time has passed up to `now`, and when to look again (ms, or none)."""
        return own, None

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = [(int(t.timestamp() * 1000), bool(h)) for b in rows for t, h in zip(b["ts"], b["hit"])]
        if new:
            self.held.appendList(new)
            self.handle.registerTimer(min(t for t, _ in new))
        yield self.frame(key, [])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, out = timerValues.getCurrentWatermarkInMs(), []
        rows = sorted(tuple(r) for r in self.held.get()) if self.held.exists() else []
        own = tuple(self.own.get()) if self.own.exists() else None
        later = [r for r in rows if r[0] > now]
        for t, hit in rows[: len(rows) - len(later)]:
            own = self.step(own, t, hit, out)
        if len(later) < len(rows):
            self.held.put(later) if later else self.held.clear()
        own, again = self.due(own, now, out)
        if own is None:
            self.own.clear()
        else:
            self.own.update(own)
        for t in {again, min((r[0] for r in later), default=None)} - {None}:
            self.handle.registerTimer(max(t, now + 1))
        yield self.frame(key, out)

    def frame(self, key, out: list) -> pd.DataFrame:
        rows = pd.DataFrame([(key[0], *r) for r in out], columns=["mmsi", *self.columns])
        for c in self.columns:
            if c in ("gap_start", "gap_end", "start", "end"):
                rows[c] = pd.to_datetime(rows[c], unit="ms")
        return rows

    def close(self) -> None:
        pass


class Silences(InOrder):
    """A silence is told as open once the watermark is past the limit, and again with its end when the vessel reports."""

    state, columns = "last", ("gap_start", "gap_end", "open")

    def __init__(self, limit_ms: int):
        self.limit = limit_ms

    def step(self, own, t, hit, out):
        if own is not None and t - own[0] >= self.limit:
            if not own[1]:
                out.append((own[0], None, True))
            out.append((own[0], t, False))
        return t, False

    def due(self, own, now, out):
        if own is None or own[1]:
            return own, None
        if now >= own[0] + self.limit:
            out.append((own[0], None, True))
            return (own[0], True), None
        return own, own[0] + self.limit


class Runs(InOrder):
    """A run of reports that meet the condition closes with the first report that does not."""

    state, columns = "run", ("start", "end", "n")

    def __init__(self, least: int):
        self.least = least

    def step(self, own, t, hit, out):
        if hit:
            return (t, t, 1) if own is None else (own[0], t, own[2] + 1)
        if own is not None and own[2] >= self.least:
            out.append(own)
        return None


def _stateful(reports: DataFrame, hit: Column, late: str, processor: StatefulProcessor, schema: str) -> DataFrame:
    use_rocks(reports.sparkSession)
    rows = reports.withWatermark("ts", late).select("mmsi", "ts", F.coalesce(hit, F.lit(False)).alias("hit"))
    return rows.groupBy("mmsi").transformWithStateInPandas(processor, schema, "append", "EventTime")


def silences(reports: DataFrame, least_hours: float = 2.0, late: str = "2 hours") -> DataFrame:
    """mmsi, gap_start, gap_end, open: each silence once as open (no end) and, when the vessel reports again, with its end."""
    return _stateful(reports, F.lit(True), late, Silences(int(least_hours * 3_600_000)), GAPS)


def condition_runs(reports: DataFrame, condition: Column, least: int = 2, late: str = "2 hours") -> DataFrame:
    """mmsi, start, end, n: stretches of `least` reports or more that meet a condition, once a report that does not has closed them."""
    return _stateful(reports, condition, late, Runs(least), RUNS)
