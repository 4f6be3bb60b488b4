"""Queries on backfill and the health of sources."""

from __future__ import annotations

import pyspark.sql.functions as F

from wakeline.plans.base import query
from wakeline.plans.oracle import sql
from wakeline.sources.adapter import EPOCH, positions
from wakeline.streaming import backfill as B

DAY0 = EPOCH // 86_400
SOURCES = (("feed0", 4), ("feed1", 6), ("feed2", 30), ("feed3", 5), ("feed4", 3))
NOW = EPOCH + 29 * 86_400


def ledger(spark, d):
    """Covered ranges, as if a report of status 5 told of some days of its feed."""
    p = positions(spark, d).filter("nav_status = 5 and k % 17 = 0")
    day = F.floor(F.col("t") / 86_400).cast("int")
    return p.select(F.concat(F.lit("feed"), (F.col("vessel_id") % 5).cast("string")).alias("source"), day.alias("first_day"), (day + F.col("k") % 3).cast("int").alias("last_day"), F.when(F.col("point_id") % 4 > 0, "completed").otherwise("failed").alias("status"))


@query("m5_backfill_plan", sql(f"""SELECT source, CAST(min(day) AS INT) AS first_day, CAST(max(day) AS INT) AS last_day FROM (
  SELECT source, day, day - row_number() OVER (PARTITION BY source ORDER BY day) AS island FROM (
    SELECT source, day, max_days, row_number() OVER (PARTITION BY source ORDER BY day) AS r FROM (VALUES {', '.join(map(str, SOURCES))}) s(source, max_days), range({DAY0}, {DAY0 + 30}) x(day)
    WHERE NOT EXISTS (SELECT 1 FROM pos WHERE nav_status = 5 AND k % 17 = 0 AND point_id % 4 > 0 AND 'feed' || vessel_id % 5 = source AND day BETWEEN t // 86400 AND t // 86400 + k % 3)) WHERE r <= max_days) GROUP BY source, island
  UNION ALL SELECT source, {DAY0 + 30} - max_days, {DAY0 + 29} FROM (VALUES {', '.join(map(str, SOURCES))}) s(source, max_days) WHERE NOT EXISTS (SELECT 1 FROM range({DAY0}, {DAY0 + 30}) x(day)
    WHERE NOT EXISTS (SELECT 1 FROM pos WHERE nav_status = 5 AND k % 17 = 0 AND point_id % 4 > 0 AND 'feed' || vessel_id % 5 = source AND day BETWEEN t // 86400 AND t // 86400 + k % 3))""", "pos"))
def m5(spark, d):
    return B.backfill_plan(ledger(spark, d), spark.createDataFrame(list(SOURCES), "source string, max_days int"), DAY0, DAY0 + 29)


@query("m6_worker_health", sql(f"""SELECT worker, status, age, age_exact > 7200 AS stale, records, age_exact <= 7200 AND status <> 'error' AS healthy FROM (SELECT worker, struct_extract(h, 'status') AS status, CAST({NOW} - struct_extract(h, 'at') AS BIGINT) AS age, {NOW} - struct_extract(h, 'at') AS age_exact, records FROM (
  SELECT 'worker' || vessel_id % 40 AS worker, max({{'at': t, 'status': CASE WHEN nav_status = 5 THEN 'error' ELSE 'running' END}}) AS h, count(*) AS records FROM pos WHERE t <= {NOW} GROUP BY 1))""", "pos"))
def m6(spark, d):
    p = positions(spark, d).filter(F.col("t") <= NOW)
    beats = p.select(F.concat(F.lit("worker"), (F.col("vessel_id") % 40).cast("string")).alias("worker"), F.col("t").cast("double").alias("at"), F.when(F.col("nav_status") == 5, "error").otherwise("running").alias("status"), F.lit(1).cast("long").alias("records"), F.lit(None).cast("string").alias("message"))
    return B.worker_health(beats, float(NOW), {f"worker{i}": 7_200 for i in range(40)}).select("worker", "status", "age", "stale", "records", "healthy")
