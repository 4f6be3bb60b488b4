"""Geometry of tracks and zones, event unions, profiles, clusters, rescoring and feature collections."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import Window

from wakeline.functions import geo
from wakeline.functions import vessels as V
from wakeline.operators import alerts, pairs, sequence
from wakeline.operators.scoring import score_band
from wakeline.plans.base import alert_frame, gap_frame, query, zoned_frame
from wakeline.plans.oracle import distance, sql
from wakeline.sources.adapter import corridors, ports, positions, vessels


@query("f3_destination_point", sql("""SELECT point_id, CAST(round(degrees(asin(sin(radians(lat)) * cos(d) + cos(radians(lat)) * sin(d) * cos(radians(cog)))) * 1000) AS BIGINT) AS lat_milli FROM
  (SELECT *, 60 / CAST(3440.065 AS DOUBLE) AS d FROM pos)""", "pos"))
def f3(spark, d):
    lat, _ = geo.destination("lat", "lon", "cog", F.lit(60.0))
    return positions(spark, d).select("point_id", F.round(lat * 1000).cast("long").alias("lat_milli"))


@query("f5_box_test", sql("SELECT point_id, corridor_id FROM pos p JOIN corridors c ON p.lat BETWEEN c.min_lat AND c.max_lat AND p.lon BETWEEN c.min_lon AND c.max_lon WHERE c.kind = 'sts_zone'", "pos", "corridors"))
def f5(spark, d):
    z = corridors(spark).filter("kind = 'sts_zone'")
    return pairs.in_zone(positions(spark, d), z, "point_id").filter("corridor_id is not null").select("point_id", "corridor_id")


@query("f8_gap_interpolation", sql("SELECT gap_id, i AS step, CAST(round((lat + (lat2 - lat) * i / 14.0::DOUBLE) * 1000) AS BIGINT) AS lat_milli FROM gaps, range(0, 15) r(i) WHERE impossible", "gaps"))
def f8(spark, d):
    line = gap_frame(spark, d).filter("impossible").select("gap_id", F.posexplode(geo.track("lat", "lon", "lat2", "lon2")).alias("step", "at"))
    return line.select("gap_id", F.col("step").cast("long").alias("step"), F.round(F.col("at.lat") * 1000).cast("long").alias("lat_milli"))


@query("f10_drift_circle", sql("""SELECT gap_id, count(*) AS vertices, CAST(round(min(lat_v) * 1000) AS BIGINT) AS south_milli FROM (SELECT gap_id,
  degrees(asin(sin(radians(lat)) * cos(r) + cos(radians(lat)) * sin(r) * cos(radians(i * 10.0::DOUBLE)))) AS lat_v FROM (SELECT *, 17 * least(hours, 24) / CAST(3440.065 AS DOUBLE) AS r FROM gaps WHERE duration_minutes >= 1440), range(0, 36) t(i)) GROUP BY 1""", "gaps"))
def f10(spark, d):
    g = gap_frame(spark, d).filter("duration_minutes >= 1440")
    ring = geo.circle("lat", "lon", 17 * F.least("hours", F.lit(24.0)))
    south = F.array_min(F.transform(ring, lambda p: p["lat"]))
    return g.select("gap_id", F.size(ring).cast("long").alias("vertices"), F.round(south * 1000).cast("long").alias("south_milli"))


@query("f12_one_digit_apart", sql("SELECT a.vessel_id, b.vessel_id AS other FROM vessels a JOIN vessels b ON b.vessel_id = a.vessel_id + 1 WHERE length(a.name) = length(b.name) AND hamming(a.name, b.name) = 1", "vessels"))
def f12(spark, d):
    a = vessels(spark, d).select("vessel_id", "name", (F.col("vessel_id") + 1).alias("other"))
    b = vessels(spark, d).select(F.col("vessel_id").alias("other"), F.col("name").alias("name2"))
    return a.join(b, "other").filter(V.one_digit_apart(F.col("name"), F.col("name2"))).select("vessel_id", "other")


@query("f7_segment_meets_zone", sql("""SELECT point_id, bool_or(least(lat, lat2) <= max_lat AND greatest(lat, lat2) >= min_lat) AS same_band FROM steps s JOIN corridors c ON c.corridor_id = 3
  WHERE lon BETWEEN min_lon AND max_lon AND lon2 BETWEEN min_lon AND max_lon GROUP BY 1""", "steps", "corridors"))
def f7(spark, d):
    z = corridors(spark).filter("corridor_id = 3").first()  # one zone
    s = sequence.steps(positions(spark, d)).filter(F.col("lon").between(z.min_lon, z.max_lon) & F.col("lon2").between(z.min_lon, z.max_lon))
    return s.select("point_id", geo.segment_meets_box("lat", "lon", "lat2", "lon2", z.min_lat, z.max_lat, z.min_lon, z.max_lon).alias("same_band"))


@query("a23_flag_profile", sql("""SELECT flag, count(DISTINCT vessel_id) AS vessels, count(*) AS gaps, count(*) FILTER (score >= 51) AS high, CAST(floor(100 * count(*) FILTER (impossible) / count(*)) AS BIGINT) AS impossible_percent FROM alerts GROUP BY 1""", "alerts"))
def a23(spark, d):
    n = F.count("*")
    return alert_frame(spark, d).groupBy("flag").agg(F.countDistinct("vessel_id").alias("vessels"), n.alias("gaps"), F.count_if(F.col("score") >= 51).alias("high"), F.floor(100 * F.count_if("impossible") / n).alias("impossible_percent"))


@query("a25_dark_clusters", sql("SELECT CAST(floor(lat * 2) AS BIGINT) AS la, CAST(floor(lon * 2) AS BIGINT) AS lo, gap_start // 604800 AS week, count(*) AS gaps, count(DISTINCT vessel_id) AS vessels FROM gaps WHERE duration_minutes >= 720 GROUP BY 1, 2, 3 HAVING count(DISTINCT vessel_id) >= 3", "gaps"))
def a25(spark, d):
    cell = gap_frame(spark, d).filter("duration_minutes >= 720").groupBy(F.floor(F.col("lat") * 2).alias("la"), F.floor(F.col("lon") * 2).alias("lo"), F.floor(F.col("gap_start") / 604_800).alias("week"))
    return cell.agg(F.count("*").alias("gaps"), F.countDistinct("vessel_id").alias("vessels")).filter("vessels >= 3")


@query("u1_event_union", sql("""SELECT kind, vessel_id, count(*) AS n, min(t0) AS first FROM (SELECT 'gap' AS kind, vessel_id, gap_start AS t0 FROM gaps UNION ALL SELECT 'jump', vessel_id, t FROM steps WHERE d_s > 0 AND nm / hours > 30
  UNION ALL SELECT 'anchor', vessel_id, t FROM pos WHERE nav_status = 1 AND sog > 2) GROUP BY 1, 2""", "gaps"))
def u1(spark, d):
    p = positions(spark, d)
    shape = lambda df, kind, at: df.select(F.lit(kind).alias("kind"), "vessel_id", F.col(at).alias("at"))
    parts = [shape(gap_frame(spark, d), "gap", "gap_start"), shape(sequence.implied_speed(p, 30.0), "jump", "t"), shape(p.filter("nav_status = 1 and sog > 2"), "anchor", "t")]
    return alerts.timeline(parts).groupBy("kind", "vessel_id").agg(F.count("*").alias("n"), F.min("at").alias("first"))


@query("j1_vessel_with_last_gap", sql("SELECT v.vessel_id, v.flag, g.gap_id FROM vessels v LEFT JOIN (SELECT vessel_id, arg_max(gap_id, (gap_start, gap_id)) AS gap_id FROM gaps GROUP BY 1) g USING (vessel_id)", "gaps"))
def j1(spark, d):
    last = gap_frame(spark, d).groupBy("vessel_id").agg(F.max_by("gap_id", F.struct("gap_start", "gap_id")).alias("gap_id"))
    return vessels(spark, d).join(last, "vessel_id", "left").select("vessel_id", "flag", "gap_id")


@query("j6_space_time_range", sql(f"""SELECT a.point_id, count(*) AS near FROM pos a JOIN pos b ON b.vessel_id <> a.vessel_id AND b.t BETWEEN a.t - 10800 AND a.t + 10800 AND abs(a.lat - b.lat) <= 1
  WHERE a.nav_status = 15 AND {distance('a.lat', 'a.lon', 'b.lat', 'b.lon')} <= 20 GROUP BY 1""", "pos"))
def j6(spark, d):
    p = positions(spark, d)
    return pairs.counts_near(p.filter("nav_status = 15"), p, 20.0, 10_800)


@query("m9_condition_sessions", sql("""SELECT vessel_id, min(t) AS session_start, max(t) AS session_end, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY vessel_id ORDER BY t, point_id ROWS UNBOUNDED PRECEDING) AS s FROM
  (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY vessel_id ORDER BY t, point_id) <= 21600 THEN 0 ELSE 1 END AS new FROM pos)) GROUP BY vessel_id, s HAVING count(*) >= 3""", "pos"))
def m9(spark, d):
    w = sequence.by_vessel()
    new = F.when(F.col("t") - F.lag("t").over(w) <= 21_600, 0).otherwise(1)
    p = positions(spark, d).withColumn("new", new).withColumn("s", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return p.groupBy("vessel_id", "s").agg(F.min("t").alias("session_start"), F.max("t").alias("session_end"), F.count("*").alias("n")).filter("n >= 3").drop("s")


@query("r15_rescore_diff", sql("""SELECT band, new_band, count(*) AS n FROM (SELECT band, CASE WHEN s >= 76 THEN 'critical' WHEN s >= 51 THEN 'high' WHEN s >= 21 THEN 'medium' ELSE 'low' END AS new_band FROM
  (SELECT band, score + CASE WHEN corridor_kind = 'sts_zone' THEN 10 ELSE 0 END - CASE WHEN duration_minutes < 480 THEN 5 ELSE 0 END AS s FROM alerts)) GROUP BY 1, 2""", "alerts"))
def r15(spark, d):
    a = alert_frame(spark, d)
    other = F.col("score") + F.when(F.col("corridor_kind") == "sts_zone", 10).otherwise(0) - F.when(F.col("duration_minutes") < 480, 5).otherwise(0)
    return a.groupBy("band", score_band(other).alias("new_band")).agg(F.count("*").alias("n"))


@query("r31_near_port_gap", sql(f"SELECT gap_id, arg_min(port_id, (nm, port_id)) AS port_id FROM (SELECT g.gap_id, q.port_id, {distance('g.lat2', 'g.lon2', 'q.lat', 'q.lon')} AS nm FROM gaps g CROSS JOIN ports q) WHERE nm <= 10 GROUP BY 1", "gaps", "ports"))
def r31(spark, d):
    back = gap_frame(spark, d).select(F.col("gap_id").alias("point_id"), F.col("lat2").alias("lat"), F.col("lon2").alias("lon"))
    return pairs.near_port(back, ports(spark, d), 10.0).select(F.col("point_id").alias("gap_id"), "port_id")


@query("k12_feature_collection", sql("""SELECT corridor_id, '{"type":"Feature","id":' || corridor_id || ',"properties":{"gaps":' || count(*) || '}}' AS feature FROM zoned WHERE corridor_id IS NOT NULL GROUP BY 1""", "zoned"))
def k12(spark, d):
    n = zoned_frame(spark, d).filter("corridor_id is not null").groupBy("corridor_id").agg(F.count("*").alias("gaps"))
    return n.select("corridor_id", F.to_json(F.struct(F.lit("Feature").alias("type"), F.col("corridor_id").alias("id"), F.struct("gaps").alias("properties"))).alias("feature"))
