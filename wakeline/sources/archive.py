"""Writing and keeping positions: archive and restore, retention, exports, observations beside points."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession

FORMATS = ("csv", "json", "parquet")


def archive(points: DataFrame, gaps: DataFrame, before: int, path: str, codec: str = "zstd") -> DataFrame:
    """Writes the points older than `before` (epoch seconds) that no gap begins or ends with; returns what stays.

    Each call has a folder of its own, batch=<before>, in year and month folders, and overwrites it, so running it again stores nothing twice.
    """
    held = gaps.select(F.col("gap_id").alias("point_id")).union(gaps.select("end_point_id")).distinct() if "end_point_id" in gaps.columns else gaps.select(F.col("gap_id").alias("point_id")).distinct()
    old = points.filter(F.col("t") < before).join(held, "point_id", "left_anti")
    day = F.timestamp_seconds("t")
    dated = old.withColumns({"year": F.year(day), "month": F.month(day)})
    batch = f"{path.rstrip('/')}/batch={before}"
    dated.repartition("year", "month", F.pmod(F.xxhash64("vessel_id"), F.lit(64))).write.mode("overwrite").option("compression", codec).partitionBy("year", "month").parquet(batch)
    return points.filter(F.coalesce(F.col("t") >= before, F.lit(True))).unionByName(points.filter(F.col("t") < before).join(held, "point_id", "left_semi"))


def restore(spark: SparkSession, path: str, points: DataFrame) -> DataFrame:
    """The points with those archived ones that are missing."""
    stored = spark.read.parquet(path).select(*points.columns).dropDuplicates(["point_id"])
    return points.unionByName(stored.join(points.select("point_id"), "point_id", "left_anti"))


def retained(points: DataFrame, now: int, days: dict[str, int], default: int = 90, source: str = "source") -> DataFrame:
    """The points younger than their source's days."""
    limit = F.lit(default)
    for name, n in days.items():
        limit = F.when(F.col(source) == name, n).otherwise(limit)
    return points.filter(F.col("t") >= now - limit * 86_400)


def export(df: DataFrame, path: str, fmt: str, columns: list[str] | None = None, where: str | None = None, order: list[str] | None = None, limit: int | None = None) -> None:
    """Writes a dataset's chosen columns and rows as CSV (with a header), JSON lines or Parquet."""
    if fmt not in FORMATS:
        raise ValueError(f"unknown format {fmt}: {', '.join(FORMATS)}")
    out = df.filter(where) if where else df
    out = out.orderBy(*order) if order else out
    out = out.limit(limit) if limit is not None else out
    out = out.select(*columns) if columns else out
    out.write.mode("overwrite").options(**({"header": True} if fmt == "csv" else {})).format(fmt).save(path)


def write_both(reports: DataFrame, points_path: str, observations_path: str) -> None:
    """One row per vessel and time to the points, every report to the observations."""
    reports.write.mode("append").parquet(observations_path)
    reports.dropDuplicates(["mmsi", "ts"]).write.mode("append").parquet(points_path)
