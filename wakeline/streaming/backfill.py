"""Backfill by a ledger of covered days, oldest missing first, and the health of sources and workers."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql.streaming import StreamingQueryListener

LEDGER = "source string, first_day int, last_day int, rows long, status string"
HEALTH = "worker string, at double, status string, records long, message string"
STALE_AFTER = 300  # seconds


def missing_ranges(covered: DataFrame, sources: DataFrame, first_day: int, last_day: int) -> DataFrame:
    """source, first_day, last_day of each stretch of days in first_day..last_day that no range of `covered` (completed ones) holds."""
    done = covered.filter("status = 'completed' and first_day <= last_day").select("source", "first_day", "last_day")
    edges = sources.select("source").distinct().withColumn("r", F.explode(F.array(*(F.struct(F.lit(d).alias("first_day"), F.lit(d).alias("last_day")) for d in (first_day - 1, last_day + 1))))).select("source", "r.*")
    w = Window.partitionBy("source").orderBy("first_day", "last_day").rowsBetween(Window.unboundedPreceding, -1)
    upto = done.join(sources.select("source").distinct(), "source", "left_semi").unionAll(edges).withColumn("seen", F.max("last_day").over(w))
    gaps = upto.filter(F.col("first_day") > F.col("seen") + 1).select("source", F.greatest(F.col("seen") + 1, F.lit(first_day)).alias("first_day"), F.least(F.col("first_day") - 1, F.lit(last_day)).alias("last_day"))
    return gaps.filter("first_day <= last_day")


def backfill_plan(covered: DataFrame, sources: DataFrame, first_day: int, last_day: int) -> DataFrame:
    """source, first_day, last_day: what the next run of each source (source, max_days) takes, oldest missing days first, max_days in all.

    A source that misses nothing takes its last max_days again, as feeds are amended.
    """
    gaps = missing_ranges(covered, sources, first_day, last_day).join(sources, "source")
    days = F.col("last_day") - F.col("first_day") + 1
    before = F.coalesce(F.sum(days).over(Window.partitionBy("source").orderBy("first_day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cut = gaps.withColumn("_left", F.col("max_days") - before).filter("_left > 0").select("source", "first_day", F.least("last_day", F.col("first_day") + F.col("_left") - 1).cast("int").alias("last_day"))
    fresh = sources.join(gaps.select("source").distinct(), "source", "left_anti")
    return cut.unionAll(fresh.select("source", F.greatest(F.lit(first_day), last_day - F.col("max_days") + 1).cast("int").alias("first_day"), F.lit(last_day).alias("last_day")))


def read_ledger(spark: SparkSession, folder: str) -> DataFrame:
    """What has been recorded; an empty table where nothing has."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    there = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    return spark.read.schema(LEDGER).json(folder) if there else spark.createDataFrame([], LEDGER)


def run_backfill(spark: SparkSession, plan: DataFrame, read: Callable[[str, int, int], DataFrame], archive: str, ledger: str) -> list[tuple[str, int, int, str]]:
    """Takes each range of the plan, oldest first: read(source, first_day, last_day) with a column day goes to the archive, then the ledger says so.

    The archive is cut by source and day and a range overwrites its own days, so a range that failed before it was
    recorded runs again without doubling rows. A source that fails is recorded as failed and the others go on. The
    plan has a few ranges a source; their rows never come to the driver.
    """
    out = []
    for r in plan.orderBy("first_day", "source").collect():
        rows, status = 0, "completed"
        try:
            got = read(r.source, r.first_day, r.last_day).withColumn("source", F.lit(r.source)).filter(F.col("day").between(r.first_day, r.last_day))
            got.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("source", "day").parquet(archive)
            rows = got.count()
        except Exception as e:  # one source's trouble must not stop the others
            status = f"failed: {type(e).__name__}"
        spark.createDataFrame([(r.source, r.first_day, r.last_day, rows, status)], LEDGER).coalesce(1).write.mode("append").json(ledger)
        out.append((r.source, r.first_day, r.last_day, status))
    return out


class HealthListener(StreamingQueryListener):
    """Writes a row of HEALTH for each start, batch and end of the streaming queries of a session, named by query."""

    def __init__(self, spark: SparkSession, folder: str, clock: Callable[[], float] = time.time):
        self.spark, self.folder, self.clock, self.names = spark, folder, clock, {}

    def note(self, run: str, status: str, records: int = 0, message: str | None = None) -> None:
        row = self.spark.createDataFrame([(self.names.get(run, run), float(self.clock()), status, records, message)], HEALTH)
        row.coalesce(1).write.json(f"{self.folder}/{uuid.uuid4().hex}")

    def onQueryStarted(self, event) -> None:
        self.names[str(event.runId)] = event.name or str(event.id)
        self.note(str(event.runId), "running")

    def onQueryProgress(self, event) -> None:
        self.note(str(event.progress.runId), "running", event.progress.numInputRows)

    def onQueryIdle(self, event) -> None:
        self.note(str(event.runId), "running")

    def onQueryTerminated(self, event) -> None:
        self.note(str(event.runId), "error" if event.exception else "stopped", message=event.exception)


def read_health(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(HEALTH).option("recursiveFileLookup", "true").json(folder)


def worker_health(heartbeats: DataFrame, now: float, limits: dict[str, int] | None = None) -> DataFrame:
    """worker, status, age (seconds since its last row), stale, records, message, healthy, by its last row; limits: seconds by worker."""
    last = heartbeats.groupBy("worker").agg(F.max_by(F.struct("at", "status", "message"), F.struct("at", "status")).alias("h"), F.sum("records").alias("records"))
    limit: Column = F.lit(STALE_AFTER)
    for worker, seconds in (limits or {}).items():
        limit = F.when(F.col("worker") == worker, seconds).otherwise(limit)
    age = F.lit(now) - F.col("h.at")
    stale = F.coalesce(age > limit, F.lit(True))
    return last.select("worker", "h.status", F.floor(age).cast("long").alias("age"), stale.alias("stale"), "records", "h.message", (~stale & (F.col("h.status") != "error")).alias("healthy"))


def overall_state(workers: DataFrame, expected: list[str]) -> DataFrame:
    """One row: state (unconfigured, degraded, healthy), workers, missing."""
    got = workers.agg(F.count("*").alias("workers"), F.coalesce(F.min("healthy"), F.lit(False)).alias("_all"), F.collect_set(F.when(F.col("worker").isin(expected), F.col("worker"))).alias("_seen"))
    missing = F.array_sort(F.array_except(F.array(*map(F.lit, expected)).cast("array<string>"), F.col("_seen")))
    state = F.when(F.col("workers") == 0, "unconfigured").when(F.col("_all") & (F.size(missing) == 0), "healthy").otherwise("degraded")
    return got.select(state.alias("state"), "workers", missing.alias("missing"))


def breaker_states(calls: DataFrame, now: float, failures: int = 5, wait: float = 60.0) -> DataFrame:
    """source, failed, state of calls (source, at, ok): open after `failures` failures in a row, half open `wait` seconds after the last, else closed."""
    good = calls.filter("ok").groupBy("source").agg(F.max("at").alias("_good"))
    row = calls.join(good, "source", "left").filter("not ok and (_good is null or at > _good)").groupBy("source").agg(F.count("*").alias("failed"), F.max("at").alias("_last"))
    every = calls.select("source").distinct().join(row, "source", "left").withColumn("failed", F.coalesce("failed", F.lit(0)))
    state = F.when(F.col("failed") < failures, "closed").when(F.lit(now) - F.col("_last") >= wait, "half_open").otherwise("open")
    return every.select("source", "failed", state.alias("state"))
