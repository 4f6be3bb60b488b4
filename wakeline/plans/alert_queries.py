"""Queries over alerts: lists, counts, trends, groups, accuracy and scores."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import Window

from wakeline.operators import alerts as A
from wakeline.operators.scoring import FAMILY_CAPS, final_scores, frequency_points, long_signals
from wakeline.plans.base import alert_frame, gap_frame, query
from wakeline.plans.detector_queries import FREQUENCY
from wakeline.plans.oracle import sql
from wakeline.sources.adapter import corridors, positions, read, vessels

BAND_COUNTS = ", ".join(f"count(*) FILTER (band = '{b}') AS {b}" for b in ("critical", "high", "medium", "low"))


@query("p1_alert_list", sql("SELECT gap_id, vessel_id, name, score, status FROM alerts WHERE score >= 40 AND status <> 'dismissed' AND name LIKE '%1%' ORDER BY score DESC, gap_id LIMIT 50 OFFSET 20", "alerts"))
def p1(spark, d):
    found = A.listed(alert_frame(spark, d), min_score=40, name_part="1", statuses=("new", "under_review", "confirmed"))
    return A.page(found, "score", skip=20, limit=50).select("gap_id", "vessel_id", "name", "score", "status")


@query("p2_alert_detail", sql("""SELECT gap_id, count(p.point_id) AS near_points, min(p.point_id) AS first_point, max(p.point_id) AS last_point FROM alerts a LEFT JOIN pos p ON p.vessel_id = a.vessel_id AND p.t BETWEEN a.gap_start - 86400 AND a.gap_start
  WHERE score >= 51 GROUP BY 1""", "alerts"))
def p2(spark, d):
    from wakeline.operators.sequence import near_times

    top = alert_frame(spark, d).filter("score >= 51").select("gap_id", "vessel_id", "gap_start")
    near = near_times(top, positions(spark, d).select("vessel_id", "point_id", "t"), "gap_start", "t", 86_400, 0)
    counted = near.groupBy("gap_id").agg(F.count("*").alias("near_points"), F.min("point_id").alias("first_point"), F.max("point_id").alias("last_point"))
    return top.select("gap_id").join(counted, "gap_id", "left").select("gap_id", F.coalesce("near_points", F.lit(0)).alias("near_points"), "first_point", "last_point")


@query("p3_alert_map", sql("SELECT gap_id, CAST(floor(lat * 100) AS BIGINT) AS lat100, CAST(floor(lon * 100) AS BIGINT) AS lon100, score FROM alerts WHERE status IN ('new', 'under_review') AND score >= 51", "alerts"))
def p3(spark, d):
    return alert_frame(spark, d).filter("status in ('new', 'under_review') and score >= 51").select("gap_id", F.floor(F.col("lat") * 100).alias("lat100"), F.floor(F.col("lon") * 100).alias("lon100"), "score")


@query("p4_vessel_search", sql("SELECT vessel_id, name, flag FROM vessels WHERE (lower(name) LIKE '%00012%' OR imo = '00012') AND dwt >= 50000 AND year_built >= 1990", "vessels"))
def p4(spark, d):
    return A.search_vessels(vessels(spark, d), "00012", least_dwt=50_000, least_year=1990).select("vessel_id", "name", "flag")


@query("p5_vessel_profile", sql("""SELECT v.vessel_id, coalesce(p.reports, 0) AS reports, coalesce(g.gaps, 0) AS gaps, g.last_gap, coalesce(g.worst, 0) AS worst FROM vessels v LEFT JOIN (SELECT vessel_id, count(*) AS reports FROM pos GROUP BY 1) p USING (vessel_id)
  LEFT JOIN (SELECT vessel_id, count(*) AS gaps, max(gap_start) AS last_gap, max(score) AS worst FROM alerts GROUP BY 1) g USING (vessel_id)""", "alerts"))
def p5(spark, d):
    reports = positions(spark, d).groupBy("vessel_id").agg(F.count("*").alias("reports"))
    gaps = alert_frame(spark, d).groupBy("vessel_id").agg(F.count("*").alias("gaps"), F.max("gap_start").alias("last_gap"), F.max("score").alias("worst"))
    return vessels(spark, d).select("vessel_id").join(reports, "vessel_id", "left").join(gaps, "vessel_id", "left").fillna(0, ["reports", "gaps", "worst"])


@query("p6_timeline", sql("""SELECT vessel_id, t, event, event_id FROM (SELECT *, row_number() OVER (PARTITION BY vessel_id ORDER BY t DESC, event, event_id) AS r FROM (SELECT vessel_id, gap_start AS t, 'gap' AS event, gap_id AS event_id FROM gaps UNION ALL SELECT vessel_id, t, 'mismatch', point_id FROM pos WHERE nav_status = 1 AND sog > 2
  UNION ALL SELECT vessel_id, t, 'undefined', point_id FROM pos WHERE nav_status = 15)) WHERE r <= 100""", "gaps"))
def p6(spark, d):
    p = positions(spark, d)
    parts = [
        gap_frame(spark, d).select("vessel_id", F.col("gap_start").alias("t"), F.lit("gap").alias("event"), F.col("gap_id").alias("event_id")),
        p.filter("nav_status = 1 and sog > 2").select("vessel_id", "t", F.lit("mismatch").alias("event"), F.col("point_id").alias("event_id")),
        p.filter("nav_status = 15").select("vessel_id", "t", F.lit("undefined").alias("event"), F.col("point_id").alias("event_id")),
    ]
    newest = Window.partitionBy("vessel_id").orderBy(F.desc("t"), "event", "event_id")
    return A.timeline(parts).withColumn("r", F.row_number().over(newest)).filter("r <= 100").drop("r")


@query("p8_event_list", sql("SELECT vessel_id, point_id, t FROM pos WHERE nav_status = 15 AND sog >= 10 ORDER BY t DESC, point_id LIMIT 200", "pos"))
def p8(spark, d):
    return positions(spark, d).filter("nav_status = 15 and sog >= 10").orderBy(F.desc("t"), "point_id").limit(200).select("vessel_id", "point_id", "t")


@query("p11_tanker_predicate", sql("SELECT vessel_id, (lower(kind) LIKE '%machinery%' OR dwt >= 20000) AND vessel_id <> 7 OR vessel_id = 11 AS tanker FROM vessels", "vessels"))
def p11(spark, d):
    from wakeline.functions.vessels import is_tanker

    return vessels(spark, d).select("vessel_id", is_tanker(F.col("vessel_id"), F.col("kind"), F.col("dwt"), ("machinery",), 20_000, (11,), (7,)).alias("tanker"))


@query("a1_band_counts", sql(f"SELECT count(*) AS total, {BAND_COUNTS} FROM alerts", "alerts"))
def a1(spark, d):
    return A.band_counts(alert_frame(spark, d))


@query("a2_group_counts", sql("SELECT status, corridor_id, count(*) AS n FROM alerts GROUP BY 1, 2", "alerts"))
def a2(spark, d):
    return alert_frame(spark, d).groupBy("status", "corridor_id").agg(F.count("*").alias("n"))


@query("a3_repeat_vessels", sql("SELECT vessel_id, count(*) AS n FROM gaps WHERE gap_start >= (SELECT max(gap_start) FROM gaps) - 7 * 86400 GROUP BY 1 HAVING count(*) >= 2", "gaps"))
def a3(spark, d):
    g = gap_frame(spark, d)
    last = g.agg(F.max("gap_start").alias("last"))
    return g.join(F.broadcast(last), g.gap_start >= F.col("last") - 7 * 86400).groupBy("vessel_id").agg(F.count("*").alias("n")).filter("n >= 2")  # `last` is one row


@query("a4_distinct_vessels", sql("SELECT corridor_id, count(DISTINCT vessel_id) AS vessels FROM alerts GROUP BY 1", "alerts"))
def a4(spark, d):
    return alert_frame(spark, d).groupBy("corridor_id").agg(F.countDistinct("vessel_id").alias("vessels"))


@query("a5_corridor_activity", sql("SELECT corridor_id, CAST(date_trunc('week', make_timestamp(gap_start * 1000000)) AS DATE)::VARCHAR AS week, count(*) AS gaps, count(DISTINCT vessel_id) AS vessels, CAST(sum(score) AS BIGINT) AS total FROM alerts GROUP BY 1, 2", "alerts"))
def a5(spark, d):
    week = F.date_trunc("week", F.date_add(F.lit("1970-01-01").cast("date"), F.col("day").cast("int"))).cast("date").cast("string")
    return alert_frame(spark, d).groupBy("corridor_id", week.alias("week")).agg(F.count("*").alias("gaps"), F.countDistinct("vessel_id").alias("vessels"), F.sum("score").alias("total"))


@query("a6_daily_trend", sql(f"SELECT day, count(*) AS total, {BAND_COUNTS}, count(*) FILTER (status IN ('confirmed', 'dismissed')) AS reviewed FROM alerts GROUP BY 1", "alerts"))
def a6(spark, d):
    return A.band_counts(alert_frame(spark, d), "day", reviewed=F.count_if(F.col("status").isin("confirmed", "dismissed")))


@query("a7_public_dashboard", sql("SELECT gap_id, right('000' || vessel_id, 4) AS masked, score FROM alerts ORDER BY gap_start DESC, gap_id LIMIT 10", "alerts"))
def a7(spark, d):
    return alert_frame(spark, d).orderBy(F.desc("gap_start"), "gap_id").limit(10).select("gap_id", F.right(F.concat(F.lit("000"), F.col("vessel_id").cast("string")), F.lit(4)).alias("masked"), "score")


@query("a8_corridor_summary", sql("SELECT c.corridor_id, c.corridor, count(a.gap_id) AS alerts, CAST(coalesce(sum(a.score), 0) AS BIGINT) AS total FROM corridors c LEFT JOIN alerts a USING (corridor_id) GROUP BY 1, 2", "alerts", "corridors"))
def a8(spark, d):
    by = alert_frame(spark, d).groupBy("corridor_id").agg(F.count("*").alias("alerts"), F.sum("score").alias("total"))
    return corridors(spark).select("corridor_id", "corridor").join(by, "corridor_id", "left").fillna(0, ["alerts", "total"])


@query("a10_dedup_groups", sql("SELECT vessel_id, corridor_id, day // 7 AS slot, count(*) AS n, min(gap_start) AS first, max(gap_start) AS last, max(score) AS worst, arg_min(gap_id, (-score, gap_start, gap_id)) AS main FROM alerts GROUP BY 1, 2, 3", "alerts"))
def a10(spark, d):
    return A.dedup_groups(alert_frame(spark, d), 7)


@query("a11_merged_groups", sql("SELECT vessel_id, count(*) AS slots, CAST(sum(n) AS BIGINT) AS n, max(worst) AS worst FROM (SELECT vessel_id, corridor_id, day // 7 AS slot, count(*) AS n, max(score) AS worst FROM alerts GROUP BY 1, 2, 3) GROUP BY 1", "alerts"))
def a11(spark, d):
    return A.dedup_groups(alert_frame(spark, d), 7).groupBy("vessel_id").agg(F.count("*").alias("slots"), F.sum("n").alias("n"), F.max("worst").alias("worst"))


@query("a12_gap_rate_baseline", sql("""SELECT corridor_id, count(*) AS windows, CAST(sum(n) AS BIGINT) AS gaps, CAST(floor(quantile_cont(n, 0.95) * 10) AS BIGINT) AS p95_tenths FROM (
  SELECT corridor_id, (gap_start - (SELECT min(gap_start) FROM gaps)) // 604800 AS w, count(*) AS n FROM zoned GROUP BY 1, 2) GROUP BY 1""", "zoned"))
def a12(spark, d):
    return A.rate_baseline(alert_frame(spark, d))


@query("a14_coverage_tagging", sql("SELECT corridor_id, CASE WHEN corridor LIKE '%lane%' OR corridor LIKE '%route%' THEN 'good' WHEN corridor LIKE '%strait%' THEN 'partial' ELSE 'poor' END AS quality FROM corridors", "corridors"))
def a14(spark, d):
    name = F.col("corridor")
    return corridors(spark).select("corridor_id", F.when(name.contains("lane") | name.contains("route"), "good").when(name.contains("strait"), "partial").otherwise("poor").alias("quality"))


@query("a16_fp_rates", sql("SELECT corridor_id, day // 7 AS week, count(*) AS reviewed, count(*) FILTER (status = 'dismissed') AS fp, CAST(100 * count(*) FILTER (status = 'dismissed') // count(*) AS BIGINT) AS fp_percent FROM alerts WHERE status IN ('confirmed', 'dismissed') GROUP BY 1, 2 HAVING count(*) >= 5", "alerts"))
def a16(spark, d):
    return A.fp_rates(alert_frame(spark, d), ["corridor_id", F.floor(F.col("day") / 7).alias("week")], 5)


@query("a17_rate_snapshots", sql("""WITH r AS (SELECT * FROM alerts WHERE status IN ('confirmed', 'dismissed'))
SELECT kind, key, count(*) AS reviewed, count(*) FILTER (status = 'dismissed') AS fp, CAST(100 * count(*) FILTER (status = 'dismissed') // count(*) AS BIGINT) AS fp_percent FROM (SELECT 'corridor' AS kind, CAST(corridor_id AS VARCHAR) AS key, status FROM r
  UNION ALL SELECT 'flag', flag, status FROM r UNION ALL SELECT 'band', band, status FROM r) GROUP BY 1, 2""".replace("WITH r AS", ", r AS"), "alerts"))
def a17(spark, d):
    return A.rate_snapshots(alert_frame(spark, d), {"corridor": F.col("corridor_id").cast("string"), "flag": F.col("flag"), "band": F.col("band")})


@query("a18_calibration", sql("""SELECT corridor_id, CASE WHEN 100 * fp // n >= 60 THEN 80 WHEN 100 * fp // n <= 30 THEN 110 ELSE 100 END AS percent FROM (SELECT corridor_id, count(*) AS n, count(*) FILTER (status = 'dismissed') AS fp FROM alerts
  WHERE status IN ('confirmed', 'dismissed') GROUP BY 1) WHERE n >= 20""", "alerts"))
def a18(spark, d):
    rate = A.fp_rates(alert_frame(spark, d), ["corridor_id"], 20)
    return rate.select("corridor_id", F.when(F.col("fp_percent") >= 60, 80).when(F.col("fp_percent") <= 30, 110).otherwise(100).alias("percent"))


SIGNALS = """, sig AS (SELECT gap_id, corridor_id, corridor_weight, dwt, status, s.signal, s.family, s.points FROM (SELECT a.*, unnest([
  {'signal': 'duration', 'family': 'gap_and_speed', 'points': CASE WHEN duration_minutes >= 1440 THEN 55 WHEN duration_minutes >= 720 THEN 40 WHEN duration_minutes >= 480 THEN 25 WHEN duration_minutes >= 240 THEN 12 ELSE 5 END},
  {'signal': 'envelope', 'family': 'gap_and_speed', 'points': CASE WHEN impossible THEN 40 WHEN ratio > 0.8 THEN 15 ELSE 0 END},
  {'signal': 'frequency', 'family': 'gap_and_speed', 'points': f.points},
  {'signal': 'zone', 'family': 'voyage_and_sts', 'points': CASE WHEN corridor_kind = 'sts_zone' THEN 20 ELSE 0 END},
  {'signal': 'dark_zone', 'family': 'satellite_and_dark', 'points': CASE WHEN corridor_kind = 'dark_zone' THEN -10 ELSE 0 END},
  {'signal': 'flag', 'family': 'identity_and_ownership', 'points': CASE WHEN flag_id % 5 = 0 THEN 20 WHEN flag_id % 5 = 1 THEN -10 ELSE 0 END},
  {'signal': 'age', 'family': 'behavioral', 'points': CASE WHEN 44 - vessel_id % 45 >= 25 THEN 20 WHEN 44 - vessel_id % 45 >= 20 THEN 10 WHEN 44 - vessel_id % 45 >= 15 THEN 12 WHEN 44 - vessel_id % 45 >= 10 THEN 0 ELSE -5 END}]) AS s
  FROM alerts a JOIN freq f USING (gap_id)) WHERE s.points <> 0)"""
FREQ = ", freq AS (SELECT gap_id, greatest(0" + "".join(f", CASE WHEN count(*) OVER (PARTITION BY vessel_id ORDER BY gap_start RANGE BETWEEN {days * 86400} PRECEDING AND CURRENT ROW) >= {n} THEN {p} ELSE 0 END" for days, n, p in FREQUENCY) + ") AS points FROM gaps)"
CAPS = "CASE family " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in FAMILY_CAPS.items()) + " END"


def signals(spark, d):
    a = alert_frame(spark, d)
    a = a.join(frequency_points(a).withColumnRenamed("points", "frequency"), "gap_id").withColumn("year_built", (1980 + F.col("vessel_id") % 45).cast("int"))
    return long_signals(a), a


@query("r1_final_score", sql(FREQ + SIGNALS + f"""SELECT gap_id, families, CAST(greatest(0, least(200, (plus * CASE WHEN plus >= 25 AND families >= 2 THEN CAST(round(coalesce(w, 1) * 10) AS INT) * CASE WHEN dwt >= 200000 THEN 13 WHEN dwt >= 120000 THEN 12 WHEN dwt >= 80000 THEN 10 WHEN dwt >= 60000 THEN 8 ELSE 10 END ELSE 100 END) // 100
  + minus + CASE WHEN families >= 4 THEN 30 WHEN families = 3 THEN 20 WHEN families = 2 THEN 10 ELSE 0 END)) AS INT) AS score FROM (SELECT gap_id, CAST(sum(plus) AS BIGINT) AS plus, CAST(sum(minus) AS BIGINT) AS minus, count(*) FILTER (plus >= 10) AS families, any_value(w) AS w, any_value(dwt) AS dwt FROM (
  SELECT gap_id, family, least(sum(greatest(points, 0)), {CAPS}) AS plus, sum(least(points, 0)) AS minus, any_value(corridor_weight) AS w, any_value(dwt) AS dwt FROM sig GROUP BY 1, 2) GROUP BY 1)""", "alerts"))
def r1(spark, d):
    return final_scores(signals(spark, d)[0])


@query("r10_family_caps", sql(FREQ + SIGNALS + f"SELECT family, count(*) AS gaps, CAST(sum(plus) AS BIGINT) AS points FROM (SELECT gap_id, family, least(sum(greatest(points, 0)), {CAPS}) AS plus FROM sig GROUP BY 1, 2) GROUP BY 1", "alerts"))
def r10(spark, d):
    cap = F.create_map(*(F.lit(x) for p in FAMILY_CAPS.items() for x in p))
    by = signals(spark, d)[0].groupBy("gap_id", "family").agg(F.sum(F.greatest("points", F.lit(0))).alias("plus"))
    return by.withColumn("plus", F.least("plus", F.element_at(cap, F.col("family")))).groupBy("family").agg(F.count("*").alias("gaps"), F.sum("plus").alias("points"))


@query("a19_signal_corridor_matrix", sql(FREQ + SIGNALS + "SELECT signal, corridor_id, count(*) FILTER (status = 'confirmed') AS tp, count(*) FILTER (status = 'dismissed') AS fp FROM sig WHERE status IN ('confirmed', 'dismissed') GROUP BY 1, 2 HAVING count(*) >= 3", "alerts"))
def a19(spark, d):
    s, a = signals(spark, d)
    return A.signal_matrix(s, a, 3)


@query("a22_signal_pairs", sql(FREQ + SIGNALS + "SELECT a.signal AS one, b.signal AS two, count(*) AS n, count(*) FILTER (a.status = 'confirmed') AS tp FROM sig a JOIN sig b ON a.gap_id = b.gap_id AND a.signal < b.signal GROUP BY 1, 2", "alerts"))
def a22(spark, d):
    s, a = signals(spark, d)
    s = s.select("gap_id", "signal").join(a.select("gap_id", "status"), "gap_id")
    return s.withColumnRenamed("signal", "one").join(s.select("gap_id", F.col("signal").alias("two")), "gap_id").filter("one < two").groupBy("one", "two").agg(F.count("*").alias("n"), F.count_if(F.col("status") == "confirmed").alias("tp"))


@query("a20_accuracy", sql("""SELECT count(*) FILTER (p AND y) AS tp, count(*) FILTER (p AND NOT y) AS fp, count(*) FILTER (NOT p AND y) AS fn, count(*) FILTER (NOT p AND NOT y) AS tn FROM (
  SELECT vessel_id, quantile_disc(score, 0.75) >= 51 AS p, vessel_id % 3 = 0 AS y FROM alerts GROUP BY 1)""", "alerts"))
def a20(spark, d):
    return A.confusion(A.vessel_scores(alert_frame(spark, d)), 51)


@query("a21_threshold_sweep", sql("""SELECT threshold, count(*) FILTER (s >= threshold AND y) AS tp, count(*) FILTER (s >= threshold AND NOT y) AS fp, count(*) FILTER (s < threshold AND y) AS fn FROM (SELECT quantile_disc(score, 0.75) AS s, vessel_id % 3 = 0 AS y FROM alerts GROUP BY vessel_id),
  (SELECT unnest(range(0, 201, 5)) AS threshold) GROUP BY 1""", "alerts"))
def a21(spark, d):
    return A.sweep(A.vessel_scores(alert_frame(spark, d)), 0, 200, 5)


@query("a24_behaviour_baseline", sql("""SELECT vessel_id, before_n, now_n, CAST(floor(now_m * 10) AS BIGINT) AS now_tenths, CASE WHEN abs(now_m - before_m) > before_sd THEN 'high' WHEN abs(now_m - before_m) > before_sd / 2 THEN 'medium' ELSE 'low' END AS tier FROM (SELECT vessel_id, count(*) FILTER (NOT recent) AS before_n, count(*) FILTER (recent) AS now_n,
  median(sog) FILTER (recent) AS now_m, median(sog) FILTER (NOT recent) AS before_m, stddev_samp(sog) FILTER (NOT recent) AS before_sd FROM (SELECT *, t >= (SELECT max(t) FROM pos) - 604800 AS recent FROM pos) GROUP BY 1) WHERE before_n >= 3 AND now_n >= 3""", "pos"))
def a24(spark, d):
    return A.behaviour(positions(spark, d), 604_800)


@query("a26_top_alerts", sql("SELECT gap_id, score FROM alerts ORDER BY score DESC, gap_id LIMIT 20", "alerts"))
def a26(spark, d):
    return alert_frame(spark, d).orderBy(F.desc("score"), "gap_id").limit(20).select("gap_id", "score")


@query("a28_workload", sql("SELECT gap_id % 7 AS analyst, CAST(sum(CASE band WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END) AS BIGINT) AS load, row_number() OVER (ORDER BY sum(CASE band WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END), gap_id % 7) AS place FROM alerts WHERE status IN ('new', 'under_review') GROUP BY 1", "alerts"))
def a28(spark, d):
    weight = F.when(F.col("band") == "critical", 4).when(F.col("band") == "high", 3).when(F.col("band") == "medium", 2).otherwise(1)
    by = alert_frame(spark, d).filter("status in ('new', 'under_review')").groupBy((F.col("gap_id") % 7).alias("analyst")).agg(F.sum(weight).alias("load"))
    return by.withColumn("place", F.row_number().over(Window.orderBy("load", "analyst")).cast("long"))  # one row per analyst


@query("a30_freshness", sql("SELECT max(t) AS newest, count(*) FILTER (t >= (SELECT max(t) FROM pos) - 3600) AS last_hour, count(*) FILTER (t >= (SELECT max(t) FROM pos) - 86400) AS last_day FROM pos", "pos"))
def a30(spark, d):
    p = positions(spark, d)
    hours = p.groupBy(F.col("t")).agg(F.count("*").alias("n"))
    newest = p.agg(F.max("t").alias("newest"))
    return hours.join(F.broadcast(newest), hours.t >= F.col("newest") - 86400).groupBy("newest").agg(F.coalesce(F.sum(F.when(F.col("t") >= F.col("newest") - 3600, F.col("n"))), F.lit(0)).alias("last_hour"), F.sum("n").alias("last_day"))


@query("t1_order_offset_limit", sql("SELECT gap_id, score FROM alerts ORDER BY score DESC, gap_id LIMIT 100 OFFSET 500", "alerts"))
def t1(spark, d):
    return A.page(alert_frame(spark, d), "score", skip=500, limit=100).select("gap_id", "score")


@query("t2_top_k_per_group", sql("SELECT vessel_id, gap_id, CAST(r AS INT) AS r FROM (SELECT *, row_number() OVER (PARTITION BY vessel_id ORDER BY score DESC, gap_id) AS r FROM alerts) WHERE r <= 3", "alerts"))
def t2(spark, d):
    w = Window.partitionBy("vessel_id").orderBy(F.desc("score"), "gap_id")
    return alert_frame(spark, d).withColumn("r", F.row_number().over(w)).filter("r <= 3").select("vessel_id", "gap_id", "r")


@query("t3_quartile_bands", sql("SELECT vessel_id, CASE WHEN r <= n // 4 THEN 'CLOSE' WHEN r <= n // 2 THEN 'SIMILAR' ELSE 'DIFFERENT' END AS band FROM (SELECT vessel_id, row_number() OVER (PARTITION BY flag ORDER BY abs(dwt - 100000), vessel_id) AS r, count(*) OVER (PARTITION BY flag) AS n FROM vessels)", "vessels"))
def t3(spark, d):
    w = Window.partitionBy("flag").orderBy(F.abs(F.col("dwt") - 100_000), "vessel_id")
    v = vessels(spark, d).select("vessel_id", F.row_number().over(w).alias("r"), F.count("*").over(Window.partitionBy("flag")).alias("n"))
    return v.select("vessel_id", F.when(F.col("r") <= F.floor(F.col("n") / 4), "CLOSE").when(F.col("r") <= F.floor(F.col("n") / 2), "SIMILAR").otherwise("DIFFERENT").alias("band"))


@query("t4_percentile_rank", sql("SELECT vessel_id, CAST(floor(CASE WHEN n = 1 THEN 0.5 ELSE p END * 1000) AS BIGINT) AS permille FROM (SELECT vessel_id, percent_rank() OVER (PARTITION BY flag ORDER BY dwt) AS p, count(*) OVER (PARTITION BY flag) AS n FROM vessels)", "vessels"))
def t4(spark, d):
    v = vessels(spark, d).select("vessel_id", F.percent_rank().over(Window.partitionBy("flag").orderBy("dwt")).alias("p"), F.count("*").over(Window.partitionBy("flag")).alias("n"))
    return v.select("vessel_id", F.floor(F.when(F.col("n") == 1, 0.5).otherwise(F.col("p")) * 1000).alias("permille"))


@query("t5_waterfall", sql(FREQ + SIGNALS + "SELECT gap_id, string_agg(signal || ':' || points, ',' ORDER BY abs(points) DESC, signal) AS waterfall FROM sig GROUP BY 1", "alerts"))
def t5(spark, d):
    parts = F.array_sort(F.collect_list(F.struct((-F.abs("points")).alias("o"), "signal", "points")))
    return signals(spark, d)[0].groupBy("gap_id").agg(F.array_join(F.transform(parts, lambda s: F.concat_ws(":", s["signal"], s["points"])), ",").alias("waterfall"))


@query("u2_intersect_days", sql("SELECT t // 86400 AS day FROM pos WHERE vessel_id % 5 = 0 INTERSECT SELECT t // 86400 FROM pos WHERE vessel_id % 5 = 1 AND nav_status = 15", "pos"))
def u2(spark, d):
    p = positions(spark, d).withColumn("day", F.floor(F.col("t") / 86400))
    return p.filter("vessel_id % 5 = 0").select("day").intersect(p.filter("vessel_id % 5 = 1 and nav_status = 15").select("day"))


@query("u3_list_delta", sql("SELECT coalesce(a.vessel_id, b.vessel_id) AS vessel_id, CASE WHEN a.vessel_id IS NULL THEN 'added' WHEN b.vessel_id IS NULL THEN 'removed' ELSE 'unchanged' END AS delta FROM (SELECT vessel_id FROM vessels WHERE vessel_id % 3 <> 0) a FULL JOIN (SELECT vessel_id FROM vessels WHERE vessel_id % 4 <> 0) b USING (vessel_id)", "vessels"))
def u3(spark, d):
    v = vessels(spark, d).select("vessel_id")
    return A.delta(v.filter("vessel_id % 3 <> 0"), v.filter("vessel_id % 4 <> 0"), "vessel_id")


@query("k7_bulk_export", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_quantity >= 45 AND l_returnflag = 'R'")
def k7(spark, d):
    return read(spark, d, "lineitem").filter("l_quantity >= 45 and l_returnflag = 'R'").select("l_orderkey", "l_linenumber", "l_partkey")


@query("k11_track_line", sql("SELECT vessel_id, string_agg(CAST(floor(lon * 100) AS BIGINT) || ' ' || CAST(floor(lat * 100) AS BIGINT), ',' ORDER BY t, point_id) AS line FROM pos GROUP BY 1", "pos"))
def k11(spark, d):
    return A.track_lines(positions(spark, d))


@query("k1_source_ranked_upsert", sql("SELECT vessel_id, t // 3600 AS slot, arg_min(point_id, (CASE nav_status WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2 END, t, point_id)) AS point_id FROM pos GROUP BY 1, 2", "pos"))
def k1(spark, d):
    rank = F.when(F.col("nav_status") == 0, 0).when(F.col("nav_status") == 1, 1).otherwise(2)
    return positions(spark, d).groupBy("vessel_id", F.floor(F.col("t") / 3600).alias("slot")).agg(F.min_by("point_id", F.struct(rank, F.col("t"), F.col("point_id"))).alias("point_id"))


@query("k2_first_seen", sql("SELECT vessel_id, min(t) AS first_seen, max(t) AS last_seen, arg_max(nav_status, (t, point_id)) AS nav_status FROM pos GROUP BY 1", "pos"))
def k2(spark, d):
    return positions(spark, d).groupBy("vessel_id").agg(F.min("t").alias("first_seen"), F.max("t").alias("last_seen"), F.max_by("nav_status", F.struct("t", "point_id")).alias("nav_status"))


@query("k3_change_log", sql("SELECT vessel_id, point_id, old, nav_status AS new FROM (SELECT *, lag(nav_status) OVER w AS old, t - lag(t) OVER w AS d FROM pos WINDOW w AS (PARTITION BY vessel_id ORDER BY t, point_id)) WHERE old <> nav_status AND d >= 86400", "pos"))
def k3(spark, d):
    w = Window.partitionBy("vessel_id").orderBy("t", "point_id")
    p = positions(spark, d).withColumns({"old": F.lag("nav_status").over(w), "d": F.col("t") - F.lag("t").over(w)})
    return p.filter("old <> nav_status and d >= 86400").select("vessel_id", "point_id", "old", F.col("nav_status").alias("new"))


@query("k15_notification_rules", sql("""SELECT r.rule, count(*) AS hits FROM alerts a JOIN (VALUES (1, 76, NULL, NULL), (2, NULL, 3, NULL), (3, 51, 1, 'new')) r(rule, least_score, corridor, want) ON (least_score IS NULL OR score >= least_score) AND (corridor IS NULL OR a.corridor_id = corridor) AND (want IS NULL OR status = want) GROUP BY 1""", "alerts"))
def k15(spark, d):
    rules = [(1, 76, None, None), (2, None, 3, None), (3, 51, 1, "new")]
    return A.notify(alert_frame(spark, d), rules).groupBy("rule").agg(F.count("*").alias("hits"))
