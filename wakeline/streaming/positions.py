"""Position reports as a stream: reading, repeats, windows, latest rows and open gaps."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from wakeline.sources.csv_positions import parse_time

MESSAGE = "MessageType string, MetaData struct<MMSI:long,ShipName:string,latitude:double,longitude:double,time_utc:string>, Message map<string,struct<Sog:double,Cog:double,TrueHeading:double,NavigationalStatus:int>>"
GAP = "mmsi string, gap_start timestamp, gap_end timestamp, open boolean"
LATE = "2 hours"


def from_messages(messages: DataFrame) -> DataFrame:
    """mmsi, ts, lat, lon, sog, cog, heading, nav_status of MESSAGE rows; sentinels are null, rows without id, time or place go."""
    m, body = F.col("MetaData"), F.element_at("Message", F.col("MessageType"))
    kept = lambda c, top: F.when(c < top, c)
    rows = messages.select(
        F.lpad(m["MMSI"].cast("string"), 9, "0").alias("mmsi"), parse_time(m["time_utc"]).alias("ts"), m["latitude"].alias("lat"), m["longitude"].alias("lon"),
        kept(body["Sog"], 102.2).alias("sog"), kept(body["Cog"], 360).alias("cog"), kept(body["TrueHeading"], 360).alias("heading"), body["NavigationalStatus"].alias("nav_status"),
    )
    return rows.filter("mmsi is not null and ts is not null and lat between -90 and 90 and lon between -180 and 180")


def read_messages(spark: SparkSession, folder: str, files_a_batch: int = 1000) -> DataFrame:
    """A stream of the JSON messages that land in a folder."""
    return from_messages(spark.readStream.schema(MESSAGE).option("maxFilesPerTrigger", files_a_batch).json(folder))


def without_repeats(reports: DataFrame, late: str = LATE) -> DataFrame:
    """The first of the reports of one vessel and time that arrive within the watermark."""
    return reports.withWatermark("ts", late).dropDuplicatesWithinWatermark(["mmsi", "ts"])


def tumbling(reports: DataFrame, length: str = "15 minutes", late: str = LATE) -> DataFrame:
    """Reports and vessels (approximately, as streams cannot count distinct values) per window."""
    w = reports.withWatermark("ts", late).groupBy(F.window("ts", length).alias("w"))
    return w.agg(F.count("*").alias("reports"), F.approx_count_distinct("mmsi").alias("vessels")).select("w.start", "w.end", "reports", "vessels")


def gaps(reports: DataFrame, least_hours: float = 2.0, late: str = LATE) -> DataFrame:
    """Silences of each vessel: open once the watermark is past the limit, closed when it reports again.

    Reports that come in older than the vessel's last one change nothing. A vessel's state is one time.
    """
    limit_ms = int(least_hours * 3_600_000)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = []
        last = state.get[0] if state.exists else None
        if state.hasTimedOut:
            rows.append((key[0], pd.Timestamp(last, unit="ms"), pd.NaT, True))
        for t in sorted(int(x.timestamp() * 1000) for b in batches for x in b["ts"]):
            if last is not None and t - last >= limit_ms:
                rows.append((key[0], pd.Timestamp(last, unit="ms"), pd.Timestamp(t, unit="ms"), False))
            last = t if last is None else max(last, t)
        state.update((last,))
        if not state.hasTimedOut and last + limit_ms > state.getCurrentWatermarkMs():
            state.setTimeoutTimestamp(last + limit_ms)
        yield pd.DataFrame(rows, columns=["mmsi", "gap_start", "gap_end", "open"]).astype({"gap_start": "datetime64[ns]", "gap_end": "datetime64[ns]"})

    seen = reports.withWatermark("ts", late).select("mmsi", "ts").groupBy("mmsi")
    return seen.applyInPandasWithState(step, GAP, "last long", "append", GroupStateTimeout.EventTimeTimeout)


def latest(reports: DataFrame) -> DataFrame:
    """The newest report of each vessel of a batch; ties to the smaller position."""
    newest = F.max_by(F.struct("ts", "lat", "lon", "sog"), F.struct("ts", -F.col("lat"), -F.col("lon")))
    return reports.groupBy("mmsi").agg(newest.alias("r")).select("mmsi", "r.*")


COMPACT = 20  # batches between two whole tables


def write_latest(reports: DataFrame, folder: str, checkpoint: str, compact: int = COMPACT):
    """Keeps each vessel's newest report: a batch writes its own newest rows, every `compact` batches the whole table is written.

    A batch that runs again overwrites its own folders, so a lost driver or executor leaves the table whole; `read_latest`
    reads the last whole table and the batches after it. What lies before that table may be removed at any time.
    """

    def merge(batch: DataFrame, number: int) -> None:
        latest(batch).write.mode("overwrite").parquet(f"{folder}/delta/batch={number}")
        if number % compact == compact - 1:
            read_latest(batch.sparkSession, folder, compact, number - compact).write.mode("overwrite").parquet(f"{folder}/whole/batch={number}")

    return reports.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_latest(spark: SparkSession, folder: str, compact: int = COMPACT, whole: int | None = None) -> DataFrame:
    """Each vessel's newest report of what write_latest wrote; `whole` names the whole table to start from (negative: none)."""
    delta = spark.read.parquet(f"{folder}/delta")
    if whole is None:
        last = delta.agg(F.max("batch")).first()[0]
        whole = (last + 1) // compact * compact - 1
    rows = delta.filter(F.col("batch") > whole).drop("batch")
    return latest(rows if whole < 0 else rows.unionByName(spark.read.schema(rows.schema).parquet(f"{folder}/whole/batch={whole}")))
