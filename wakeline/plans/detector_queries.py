"""Detectors over positions: gaps, speeds, runs, windows, meetings, zones."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import Window

from wakeline.functions.geo import bearing_difference, haversine_nm, initial_bearing
from wakeline.operators import pairs, sequence
from wakeline.operators.scoring import FREQUENCY, duration_points, frequency_points
from wakeline.plans.base import alert_frame, gap_frame, query, zoned_frame
from wakeline.plans.oracle import distance, sql
from wakeline.sources.adapter import corridors, ports, positions, vessels


@query("w1_gap_detection", sql("SELECT gap_id, vessel_id, gap_start, gap_end, duration_minutes, CAST(floor(nm) AS BIGINT) AS nm, impossible FROM gaps", "gaps"))
def w1(spark, d):
    return gap_frame(spark, d).select("gap_id", "vessel_id", "gap_start", "gap_end", "duration_minutes", F.floor("nm").alias("nm"), "impossible")


@query("r2_gap_bands", sql("""SELECT CASE WHEN duration_minutes >= 1440 THEN 55 WHEN duration_minutes >= 720 THEN 40 WHEN duration_minutes >= 480 THEN 25 WHEN duration_minutes >= 240 THEN 12 ELSE 5 END AS points,
  count(*) AS gaps, count(DISTINCT vessel_id) AS vessels, count(*) FILTER (impossible) AS impossible FROM gaps GROUP BY 1""", "gaps"))
def r2(spark, d):
    return gap_frame(spark, d).groupBy(duration_points(F.col("duration_minutes")).alias("points")).agg(F.count("*").alias("gaps"), F.countDistinct("vessel_id").alias("vessels"), F.count_if("impossible").alias("impossible"))


@query("w2_implied_speed_reuse", sql("SELECT vessel_id, point_id, point2, CASE WHEN nm / hours > 100 THEN 55 ELSE 40 END AS score FROM steps WHERE d_s > 0 AND nm / hours > 30", "steps"))
def w2(spark, d):
    found = sequence.implied_speed(positions(spark, d), 30.0)
    return found.select("vessel_id", "point_id", "point2", F.when(F.col("knots") > 100, 55).otherwise(40).alias("score"))


@query("w3_dual_transmission", sql(f"""SELECT vessel_id, anchor, point_id FROM (SELECT a.vessel_id, a.point_id AS anchor, b.point_id, row_number() OVER (PARTITION BY a.point_id ORDER BY b.t, b.point_id) AS r
  FROM pos a JOIN pos b ON a.vessel_id = b.vessel_id AND b.t > a.t AND b.t - a.t <= 1800 WHERE {distance('a.lat', 'a.lon', 'b.lat', 'b.lon')} / ((b.t - a.t) / 3600.0::DOUBLE) > 30) WHERE r = 1""", "pos"))
def w3(spark, d):
    return sequence.first_follower(positions(spark, d), 1800, 30.0).select("vessel_id", "anchor", "point_id")


@query("w4_clone_jump", sql("SELECT vessel_id, point_id, point2, CAST(floor(nm) AS BIGINT) AS nm FROM steps WHERE d_s > 0 AND d_s <= 3600 AND nm / hours > 50", "steps"))
def w4(spark, d):
    return sequence.implied_speed(positions(spark, d), 50.0, most_hours=1.0).select("vessel_id", "point_id", "point2", F.floor("nm").alias("nm"))


@query("w5_impossible_position", sql("SELECT vessel_id, point_id, point2, 40 AS score FROM steps WHERE d_s > 0 AND nm >= 1 AND hours >= 0.01 AND nm / hours > 25", "steps"))
def w5(spark, d):
    return sequence.implied_speed(positions(spark, d), 25.0, least_nm=1.0, least_hours=0.01).select("vessel_id", "point_id", "point2", F.lit(40).alias("score"))


@query("w6_status_mismatch", sql("SELECT vessel_id, point_id, t FROM pos WHERE nav_status = 1 AND sog > 2", "pos"))
def w6(spark, d):
    return positions(spark, d).filter("nav_status = 1 and sog > 2").select("vessel_id", "point_id", "t")


def run_sql(condition: str, having: str, key: str = "0", drop_open: bool = True) -> str:
    return sql(f"""SELECT vessel_id, min(t) AS run_start, max(t) AS run_end, count(*) AS n FROM (
      SELECT *, sum(CASE WHEN hit AND NOT (coalesce(before_hit, false) AND before_key IS NOT DISTINCT FROM ky) THEN 1 ELSE 0 END) OVER (PARTITION BY vessel_id ORDER BY t, point_id ROWS UNBOUNDED PRECEDING) AS run
      FROM (SELECT *, lag(hit) OVER w AS before_hit, lag(ky) OVER w AS before_key, lead(t) OVER w IS NULL AS is_last
            FROM (SELECT *, coalesce({condition}, false) AS hit, {key} AS ky FROM pos) WINDOW w AS (PARTITION BY vessel_id ORDER BY t, point_id)))
      WHERE hit GROUP BY vessel_id, run HAVING {having} {"AND NOT bool_or(is_last)" if drop_open else ""}""", "pos")


def runs(spark, d, condition, least_hours, key=None, drop_open=True, least_n=1):
    found = sequence.runs(positions(spark, d), condition, key, drop_open)
    return found.filter((F.col("end") - F.col("start") >= least_hours * 3600) & (F.col("n") >= least_n)).select("vessel_id", F.col("start").alias("run_start"), F.col("end").alias("run_end"), "n")


@query("w7_anchor_runs", run_sql("nav_status IN (1, 5) AND sog < 3", "max(t) - min(t) >= 6 * 3600"))
def w7(spark, d):
    return runs(spark, d, F.col("nav_status").isin(1, 5) & (F.col("sog") < 3), 6)


@query("w8_slow_roll", run_sql("sog BETWEEN 0.5 AND 2.0", "max(t) - min(t) >= 12 * 3600"))
def w8(spark, d):
    return runs(spark, d, F.col("sog").between(0.5, 2.0), 12)


@query("w9_restricted_manoeuvre", run_sql("nav_status = 3", "max(t) - min(t) >= 6 * 3600"))
def w9(spark, d):
    return runs(spark, d, F.col("nav_status") == 3, 6)


@query("w14_stale_values", run_sql("sog > 0.5", "max(t) - min(t) >= 7200 AND count(*) >= 2", "cog % 4", False))
def w14(spark, d):
    return runs(spark, d, F.col("sog") > 0.5, 2, F.col("cog") % 4, False, 2)


@query("w10_circle_window", sql("""SELECT vessel_id, point_id, n, span FROM (SELECT *, count(*) OVER w AS n, max(t) OVER w - t AS span, stddev_samp(lat) OVER w AS sd FROM pos
  WINDOW w AS (PARTITION BY vessel_id ORDER BY t RANGE BETWEEN CURRENT ROW AND 172800 FOLLOWING)) WHERE n >= 6 AND span >= 14400 AND sd < 0.4""", "pos"))
def w10(spark, d):
    found = sequence.forward_window(positions(spark, d), 172_800, n=F.count("*"), last=F.max("t"), lats=F.collect_list("lat"))
    found = found.withColumn("span", F.col("last") - F.col("t")).filter("n >= 6 and span >= 14400")
    return found.filter(sequence.deviation(F.col("lats")) < 0.4).select("vessel_id", "point_id", "n", "span")


@query("w24_sparse_transmission", sql("""SELECT vessel_id, min(n) AS least, CASE WHEN min(n) < 2 THEN 25 ELSE 15 END AS score FROM (SELECT vessel_id, sog, count(*) OVER (PARTITION BY vessel_id ORDER BY t RANGE BETWEEN CURRENT ROW AND 86400 FOLLOWING) AS n FROM pos)
  WHERE sog > 3 GROUP BY vessel_id HAVING min(n) <= 3""", "pos"))
def w24(spark, d):
    found = sequence.forward_window(positions(spark, d), 86_400, n=F.count("*")).filter("sog > 3").groupBy("vessel_id").agg(F.min("n").alias("least"))
    return found.filter("least <= 3").select("vessel_id", "least", F.when(F.col("least") < 2, 25).otherwise(15).alias("score"))


@query("w25_reporting_rate", sql("""SELECT vessel_id, n, CAST(floor(sd / mean * 100) AS BIGINT) AS cv_percent FROM (SELECT vessel_id, count(d) AS n, avg(d) AS mean, stddev_pop(d) AS sd FROM
  (SELECT vessel_id, t - lag(t) OVER (PARTITION BY vessel_id ORDER BY t, point_id) AS d FROM pos) GROUP BY 1) WHERE n >= 50 AND mean > 0""", "pos"))
def w25(spark, d):
    return sequence.rate_of_change(positions(spark, d), "cv", 50).select("vessel_id", "n", F.floor(F.col("cv") * 100).alias("cv_percent"))


@query("w15_loitering", sql("""SELECT vessel_id, min(bucket) AS first_bucket, max(bucket) AS last_bucket, count(*) AS n, CASE WHEN count(*) >= 4 THEN 20 ELSE 8 END AS score FROM (
  SELECT *, i - row_number() OVER (PARTITION BY vessel_id ORDER BY bucket) AS run FROM (SELECT *, row_number() OVER (PARTITION BY vessel_id ORDER BY bucket) AS i FROM
    (SELECT vessel_id, t // 86400 AS bucket, median(sog) AS sog FROM pos GROUP BY 1, 2)) WHERE sog < 4) GROUP BY vessel_id, run HAVING count(*) >= 2""", "pos"))
def w15(spark, d):
    w = Window.partitionBy("vessel_id").orderBy("bucket")
    daily = positions(spark, d).groupBy("vessel_id", F.floor(F.col("t") / 86400).alias("bucket")).agg(F.median("sog").alias("sog"))
    low = daily.withColumn("i", F.row_number().over(w)).filter("sog < 4").withColumn("run", F.col("i") - F.row_number().over(w))
    found = low.groupBy("vessel_id", "run").agg(F.min("bucket").alias("first_bucket"), F.max("bucket").alias("last_bucket"), F.count("*").alias("n")).filter("n >= 2")
    return found.select("vessel_id", "first_bucket", "last_bucket", "n", F.when(F.col("n") >= 4, 20).otherwise(8).alias("score"))


@query("w17_port_calls", sql(f"""SELECT vessel_id, port_id, count(*) AS calls FROM (SELECT vessel_id, point_id, arg_min(port_id, {{}}) AS port_id FROM (SELECT p.*, q.port_id, {distance('p.lat', 'p.lon', 'q.lat', 'q.lon')} AS nm
  FROM pos p JOIN ports q ON {distance('p.lat', 'p.lon', 'q.lat', 'q.lon')} <= 3 WHERE sog < 1) GROUP BY 1, 2) GROUP BY 1, 2""".replace("{}", "(nm, port_id)"), "pos", "ports"))
def w17(spark, d):
    slow = positions(spark, d).filter("sog < 1")
    at = pairs.near_port(slow, ports(spark, d), 3.0)
    return slow.select("vessel_id", "point_id").join(at, "point_id").groupBy("vessel_id", "port_id").agg(F.count("*").alias("calls"))


@query("w36_class_inference", sql("""SELECT vessel_id, CAST(floor(quantile_disc(d, 0.5)) AS BIGINT) AS median_s FROM (SELECT vessel_id, t - lag(t) OVER (PARTITION BY vessel_id ORDER BY t, point_id) AS d FROM pos)
  WHERE d BETWEEN 0 AND 20000 GROUP BY 1""", "pos"))
def w36(spark, d):
    steps = positions(spark, d).withColumn("d", F.col("t") - F.lag("t").over(sequence.by_vessel())).filter("d between 0 and 20000")
    return steps.groupBy("vessel_id").agg(F.expr("percentile_disc(0.5) within group (order by d)").cast("long").alias("median_s"))


def met(seconds: int, nm: float, apart: int, body: str, where: str = "TRUE", *names: str) -> str:
    near = distance("a.lat", "a.lon", "b.lat", "b.lon")
    pairs_sql = f"""met AS (SELECT a.t // {seconds} AS bucket, a.vessel_id AS vessel_id_1, b.vessel_id AS vessel_id_2, a.t AS t_1, b.t AS t_2, a.lat AS lat_1, a.lon AS lon_1 FROM pos a JOIN pos b ON b.t BETWEEN a.t - {apart} AND a.t + {apart} AND a.vessel_id < b.vessel_id
      WHERE a.t // {seconds} = b.t // {seconds} AND {near} <= {nm} AND {where})"""
    return sql("", "pos", *names).rstrip() + ",\n" + pairs_sql + "\n" + body


@query("j3_cell_meetings", met(86_400, 10, 21_600, "SELECT DISTINCT bucket, vessel_id_1, vessel_id_2 FROM met"))
def j3(spark, d):
    return pairs.meetings(positions(spark, d), 86_400, 10.0, 21_600).select("bucket", "vessel_id_1", "vessel_id_2").distinct()


@query("j4_first_meeting", met(3_600, 30, 3_600, "SELECT vessel_id_1, vessel_id_2, min(bucket) AS first_bucket FROM met GROUP BY 1, 2"))
def j4(spark, d):
    return pairs.meetings(positions(spark, d), 3_600, 30.0, 3_600).groupBy("vessel_id_1", "vessel_id_2").agg(F.min("bucket").alias("first_bucket"))


SIDE_BY_SIDE = "least(abs(a.cog - b.cog), 360 - abs(a.cog - b.cog))"
ISLANDS = "SELECT *, bucket - row_number() OVER (PARTITION BY vessel_id_1, vessel_id_2 ORDER BY bucket) AS i FROM (SELECT bucket, vessel_id_1, vessel_id_2, avg(lat_1) AS la, avg(lon_1) AS lo FROM met GROUP BY 1, 2, 3)"


@query("w18_transfer_runs", met(172_800, 25, 43_200, f"""SELECT vessel_id_1, vessel_id_2, first_bucket, last_bucket, n, CASE WHEN in_zone THEN 35 ELSE 25 END AS score FROM (
  SELECT vessel_id_1, vessel_id_2, min(bucket) AS first_bucket, max(bucket) AS last_bucket, count(*) AS n, bool_or(EXISTS (SELECT 1 FROM corridors c WHERE c.kind = 'sts_zone' AND la BETWEEN c.min_lat AND c.max_lat AND lo BETWEEN c.min_lon AND c.max_lon)) AS in_zone,
    bool_or(EXISTS (SELECT 1 FROM ports q WHERE {distance('la', 'lo', 'q.lat', 'q.lon')} <= 3)) AS in_port FROM ({ISLANDS}) GROUP BY vessel_id_1, vessel_id_2, i HAVING count(*) >= 2) WHERE NOT in_port""",
  f"a.sog < 8 AND b.sog < 8 AND ({SIDE_BY_SIDE} <= 30 OR {SIDE_BY_SIDE} >= 150)", "corridors", "ports"))
def w18(spark, d):
    p = positions(spark, d)
    return pairs.transfers_by_run(p, corridors(spark).filter("kind = 'sts_zone'"), ports(spark, d), seconds=172_800, nm=25.0, apart=43_200, knots=8.0, least=2)


@query("w21_convoy_runs", met(172_800, 60, 21_600, """SELECT vessel_id_1, vessel_id_2, n, CASE WHEN n >= 4 THEN 35 WHEN n = 3 THEN 25 ELSE 15 END AS score FROM (SELECT vessel_id_1, vessel_id_2, count(*) AS n FROM (
  """ + ISLANDS + """) GROUP BY vessel_id_1, vessel_id_2, i HAVING count(*) >= 2)""", f"a.sog >= 3 AND b.sog >= 3 AND {SIDE_BY_SIDE} <= 60"))  # fmt: skip
def w21(spark, d):
    return pairs.convoys(positions(spark, d), seconds=172_800, nm=60.0, apart=21_600, knots=3.0, degrees=60.0, least=2)


@query("w20_dark_dark", sql("""SELECT a.gap_id AS gap_1, b.gap_id AS gap_2, least(a.gap_end, b.gap_end) - greatest(a.gap_start, b.gap_start) AS overlap_s FROM zoned a JOIN zoned b ON a.corridor_id = b.corridor_id AND a.vessel_id < b.vessel_id
  AND a.gap_start <= b.gap_end AND b.gap_start <= a.gap_end WHERE least(a.gap_end, b.gap_end) - greatest(a.gap_start, b.gap_start) >= 14400 AND a.corridor_kind = 'sts_zone' AND a.duration_minutes >= 1440 AND b.duration_minutes >= 1440""", "zoned"))
def w20(spark, d):
    z = zoned_frame(spark, d).filter("corridor_kind = 'sts_zone' and duration_minutes >= 1440")
    side = lambda k: z.select("corridor_id", F.col("gap_id").alias(f"gap_{k}"), F.col("vessel_id").alias(f"vessel_{k}"), F.col("gap_start").alias(f"start_{k}"), F.col("gap_end").alias(f"end_{k}"))
    both = pairs.overlapping(side(1), side(2), ["corridor_id"]).filter("vessel_1 < vessel_2")
    return both.withColumn("overlap_s", F.least("end_1", "end_2") - F.greatest("start_1", "start_2")).filter("overlap_s >= 14400").select("gap_1", "gap_2", "overlap_s")


@query("j5_interval_overlap", sql("""SELECT p.point_id, arg_min(g.gap_id, (g.gap_start, g.gap_id)) AS gap_id FROM pos p JOIN gaps g ON p.vessel_id = g.vessel_id AND g.gap_start BETWEEN p.t - 21600 AND p.t + 21600
  WHERE p.nav_status = 15 GROUP BY 1""", "gaps"))
def j5(spark, d):
    odd = positions(spark, d).filter("nav_status = 15").select("point_id", "vessel_id", "t")
    near = sequence.near_times(odd, gap_frame(spark, d).select("vessel_id", "gap_id", "gap_start"), "t", "gap_start", 21_600, 21_600)
    return near.groupBy("point_id").agg(F.min_by("gap_id", F.struct("gap_start", "gap_id")).alias("gap_id"))


@query("j7_as_of", sql("""SELECT gap_id, (SELECT arg_max(point_id, (t, point_id)) FROM pos p WHERE p.vessel_id = g.vessel_id AND p.t <= g.gap_start AND p.nav_status = 15) AS last_point_id FROM gaps g""", "gaps"))
def j7(spark, d):
    odd = positions(spark, d).filter("nav_status = 15")
    return sequence.as_of(gap_frame(spark, d).select("gap_id", "vessel_id", "gap_start"), odd, "gap_start", "t", "point_id").select("gap_id", "last_point_id")


@query("j8_zone_of_gap", sql("SELECT gap_id, corridor_id FROM zoned", "zoned"))
def j8(spark, d):
    return zoned_frame(spark, d).select("gap_id", "corridor_id")


@query("j13_nearest_port", sql(f"SELECT point_id, arg_min(port_id, (nm, port_id)) AS port_id FROM (SELECT p.point_id, q.port_id, {distance('p.lat', 'p.lon', 'q.lat', 'q.lon')} AS nm FROM pos p CROSS JOIN ports q) WHERE nm <= 10 GROUP BY 1", "pos", "ports"))
def j13(spark, d):
    return pairs.near_port(positions(spark, d), ports(spark, d), 10.0).select("point_id", "port_id")


@query("j15_latest_row", sql("SELECT vessel_id, arg_max(point_id, (t, point_id)) AS point_id, max(t) AS t FROM pos GROUP BY 1", "pos"))
def j15(spark, d):
    return positions(spark, d).groupBy("vessel_id").agg(F.max_by("point_id", F.struct("t", "point_id")).alias("point_id"), F.max("t").alias("t"))


@query("f1_step_distance", sql("SELECT vessel_id, count(*) AS steps, CAST(floor(sum(nm)) AS BIGINT) // 10 AS tens_nm FROM steps GROUP BY 1", "steps"))
def f1(spark, d):
    return sequence.steps(positions(spark, d)).groupBy("vessel_id").agg(F.count("*").alias("steps"), F.floor(F.floor(F.sum("nm")) / 10).alias("tens_nm"))


BEARING = "((degrees(atan2(sin(radians(lon2 - lon)) * cos(radians(lat2)), cos(radians(lat)) * sin(radians(lat2)) - sin(radians(lat)) * cos(radians(lat2)) * cos(radians(lon2 - lon)))) + 360) % 360)"


@query("f2_bearing_turn", sql(f"SELECT point_id, CAST(floor(least(abs({BEARING} - cog), 360 - abs({BEARING} - cog)) / 10) AS BIGINT) AS tens FROM steps WHERE nm > 1", "steps"))
def f2(spark, d):
    s = sequence.steps(positions(spark, d)).filter("nm > 1")
    turn = bearing_difference(initial_bearing("lat", "lon", "lat2", "lon2"), F.col("cog"))
    return s.select("point_id", F.floor(turn / 10).alias("tens"))


@query("m7_tumbling_windows", sql("SELECT t // 900 AS quarter, count(*) AS reports, count(DISTINCT vessel_id) AS vessels FROM pos GROUP BY 1", "pos"))
def m7(spark, d):
    return positions(spark, d).groupBy(F.floor(F.col("t") / 900).alias("quarter")).agg(F.count("*").alias("reports"), F.countDistinct("vessel_id").alias("vessels"))


@query("m8_sliding_windows", sql("SELECT point_id, count(*) OVER (PARTITION BY vessel_id ORDER BY t RANGE BETWEEN CURRENT ROW AND 172800 FOLLOWING) AS ahead FROM pos", "pos"))
def m8(spark, d):
    return sequence.forward_window(positions(spark, d), 172_800, ahead=F.count("*")).select("point_id", "ahead")


@query("r4_gap_frequency", sql("SELECT gap_id, greatest(0" + "".join(f", CASE WHEN count(*) OVER (PARTITION BY vessel_id ORDER BY gap_start RANGE BETWEEN {days * 86400} PRECEDING AND CURRENT ROW) >= {n} THEN {p} ELSE 0 END" for days, n, p in FREQUENCY) + ") AS points FROM gaps", "gaps"))
def r4(spark, d):
    return frequency_points(gap_frame(spark, d))


@query("r37_own_history", sql("""SELECT gap_id, CASE WHEN z >= 3 THEN 40 ELSE 25 END AS points FROM (SELECT gap_id, n, sd, (hours - mean) / nullif(sd, 0) AS z FROM (SELECT gap_id, hours, count(*) OVER w AS n, avg(hours) OVER w AS mean, stddev_samp(hours) OVER w AS sd FROM gaps
  WINDOW w AS (PARTITION BY vessel_id ORDER BY gap_start RANGE BETWEEN 2592000 PRECEDING AND 1 PRECEDING))) WHERE n >= 3 AND sd > 0.5 AND z >= 2""", "gaps"))
def r37(spark, d):
    w = Window.partitionBy("vessel_id").orderBy("gap_start").rangeBetween(-2_592_000, -1)
    g = gap_frame(spark, d).select("gap_id", "hours", F.count("*").over(w).alias("n"), F.avg("hours").over(w).alias("mean"), F.stddev_samp("hours").over(w).alias("sd"))
    z = (F.col("hours") - F.col("mean")) / F.nullif("sd", F.lit(0.0))
    return g.withColumn("z", z).filter("n >= 3 and sd > 0.5 and z >= 2").select("gap_id", F.when(F.col("z") >= 3, 40).otherwise(25).alias("points"))


@query("h1_gap_midpoint_detections", sql(f"""SELECT g.gap_id, count(*) AS detections FROM gaps g JOIN pos p ON p.vessel_id <> g.vessel_id AND p.t BETWEEN (g.gap_start + g.gap_end) // 2 - 3600 AND (g.gap_start + g.gap_end) // 2 + 3600 AND p.nav_status = 5
  WHERE g.impossible AND {distance('(g.lat + g.lat2) / 2', '(g.lon + g.lon2) / 2', 'p.lat', 'p.lon')} <= 30 GROUP BY 1""", "gaps"))
def h1(spark, d):
    g = gap_frame(spark, d).filter("impossible").select("gap_id", "vessel_id", F.floor((F.col("gap_start") + F.col("gap_end")) / 2).alias("t_1"), ((F.col("lat") + F.col("lat2")) / 2).alias("lat_1"), ((F.col("lon") + F.col("lon2")) / 2).alias("lon_1"))
    seen = positions(spark, d).filter("nav_status = 5").select(F.col("vessel_id").alias("other"), F.col("t").alias("t_2"), F.col("lat").alias("lat_2"), F.col("lon").alias("lon_2"))
    return pairs.near_in_space_and_time(g, seen, 30.0, 3_600).filter("other <> vessel_id").groupBy("gap_id").agg(F.count("*").alias("detections"))


@query("a9_daily_buckets", sql("SELECT vessel_id, t // 86400 AS day, count(*) AS n, CAST(floor(median(sog) * 10) AS BIGINT) AS tenth_knots FROM pos GROUP BY 1, 2", "pos"))
def a9(spark, d):
    return positions(spark, d).groupBy("vessel_id", F.floor(F.col("t") / 86400).alias("day")).agg(F.count("*").alias("n"), F.floor(F.median("sog") * 10).alias("tenth_knots"))


@query("a15_coverage_gaps", sql("""SELECT vessel_id, min(day) AS first_day, max(day) AS last_day FROM (SELECT *, day - row_number() OVER (PARTITION BY vessel_id ORDER BY day) AS i FROM (
  SELECT v.vessel_id, d.day FROM (SELECT vessel_id, min(t // 86400) AS a, max(t // 86400) AS b FROM pos GROUP BY 1) v, LATERAL (SELECT unnest(range(a, b + 1)) AS day) d
  WHERE NOT EXISTS (SELECT 1 FROM pos p WHERE p.vessel_id = v.vessel_id AND p.t // 86400 = d.day))) GROUP BY vessel_id, i""", "pos"))
def a15(spark, d):
    p = positions(spark, d).select("vessel_id", F.floor(F.col("t") / 86400).alias("day"))
    every = p.groupBy("vessel_id").agg(F.explode(F.sequence(F.min("day"), F.max("day"))).alias("day"))
    missing = every.join(p.distinct(), ["vessel_id", "day"], "left_anti")
    island = missing.withColumn("i", F.col("day") - F.row_number().over(Window.partitionBy("vessel_id").orderBy("day")))
    return island.groupBy("vessel_id", "i").agg(F.min("day").alias("first_day"), F.max("day").alias("last_day")).drop("i")


@query("w22_zone_touch", sql("SELECT corridor_id, count(*) AS points, count(DISTINCT vessel_id) AS vessels FROM pos p JOIN corridors c ON p.lat BETWEEN c.min_lat - 0.1 AND c.max_lat + 0.1 AND p.lon BETWEEN c.min_lon - 0.1 AND c.max_lon + 0.1 GROUP BY 1", "pos", "corridors"))
def w22(spark, d):
    z = pairs.small(corridors(spark))
    la, lo = (F.sequence(F.floor(F.col(f"min_{c}") - 0.1), F.floor(F.col(f"max_{c}") + 0.1)) for c in ("lat", "lon"))
    z = z.withColumn("la", F.explode(la)).withColumn("lo", F.explode(lo))
    p = positions(spark, d).withColumns({"la": F.floor("lat"), "lo": F.floor("lon")})
    hit = p.join(z, ["la", "lo"]).filter("lat between min_lat - 0.1 and max_lat + 0.1 and lon between min_lon - 0.1 and max_lon + 0.1")
    return hit.groupBy("corridor_id").agg(F.count("*").alias("points"), F.countDistinct("vessel_id").alias("vessels"))


@query("a13_feed_outage", sql("""SELECT corridor_id, gap_start // 7200 AS slot, count(DISTINCT vessel_id) AS vessels FROM alerts GROUP BY 1, 2 HAVING count(DISTINCT vessel_id) >= 3 AND 100 * count(*) FILTER (score >= 51) <= 50 * count(*)""", "alerts"))
def a13(spark, d):
    slots = alert_frame(spark, d).groupBy("corridor_id", F.floor(F.col("gap_start") / 7200).alias("slot")).agg(F.countDistinct("vessel_id").alias("vessels"), F.count_if(F.col("score") >= 51).alias("high"), F.count("*").alias("n"))
    return slots.filter("vessels >= 3 and 100 * high <= 50 * n").select("corridor_id", "slot", "vessels")


@query("p12_speed_class", sql("SELECT vessel_id, CASE WHEN dwt >= 200000 THEN 18 WHEN dwt >= 120000 THEN 19 WHEN dwt >= 60000 THEN 20 ELSE 17 END AS knots FROM vessels", "vessels"))
def p12(spark, d):
    from wakeline.functions.vessels import max_speed

    return vessels(spark, d).select("vessel_id", max_speed(F.col("dwt")).cast("int").alias("knots"))
