"""Queries on the signals of the gap score, their overrides and what is made of them."""

from __future__ import annotations

import pyspark.sql.functions as F

from wakeline.operators import identity as I
from wakeline.operators import signals as S
from wakeline.plans.base import alert_frame, query, zoned_frame
from wakeline.plans.identity_queries import AS_OF
from wakeline.plans.oracle import distance, sql
from wakeline.sources.adapter import changes, ports, positions, read, vessels

def risk():
    return F.col("flag_id") % 5 == 0

REAL = "old IS NOT NULL AND old <> value"


def rows(frame: str, **signals: str) -> str:
    """SQL of the long form of signals over a frame with gap_id."""
    each = " UNION ALL ".join(f"SELECT gap_id, '{k}' AS signal, CAST({v} AS INT) AS points FROM ({frame})" for k, v in signals.items())
    return f"SELECT * FROM ({each}) WHERE points <> 0"


IMO = "CAST(substr(imo, {i}, 1) AS INT) * {w}"
VALID = f"({' + '.join(IMO.format(i=i + 1, w=7 - i) for i in range(6))}) % 10 = CAST(substr(imo, 7, 1) AS INT)"
HITS = "(CASE WHEN 2024 - year_built >= 15 THEN 1 ELSE 0 END + CASE WHEN flag_id % 5 = 0 THEN 1 ELSE 0 END + CASE WHEN dwt > 80000 THEN 1 ELSE 0 END + CASE WHEN kind = 'MACHINERY' THEN 1 ELSE 0 END)"


@query("r5_identity_signals", sql(rows("SELECT g.gap_id, v.* FROM gaps g JOIN vessels v USING (vessel_id)", imo_invalid=f"CASE WHEN NOT ({VALID}) THEN 40 ELSE 0 END", no_size="CASE WHEN coalesce(dwt, 0) <= 0 THEN 10 ELSE 0 END", high_risk_flag="CASE WHEN flag_id % 5 = 0 THEN 15 ELSE 0 END",
  age="CASE WHEN 2024 - year_built >= 25 THEN 20 WHEN 2024 - year_built >= 20 THEN 10 WHEN 2024 - year_built >= 15 THEN 5 ELSE 0 END", profile_match=f"CASE WHEN {HITS} >= 4 THEN 25 WHEN {HITS} = 3 THEN 15 ELSE 0 END"), "gaps", "vessels"))
def r5(spark, d):
    return S.identity_signals(zoned_frame(spark, d), vessels(spark, d), 2024, risk())


SINCE = " ".join(f", count(*) FILTER (c.t >= g.gap_start - {n} * 86400) AS n_{n}" for n in (7, 30, 90, 365))
BOTH = "EXISTS (SELECT 1 FROM two f WHERE f.vessel_id = g.vessel_id AND f.t >= g.gap_start - 7776000)"
TWO = ", two AS (SELECT DISTINCT f.vessel_id, f.t FROM changes f JOIN changes m ON f.vessel_id = m.vessel_id AND f.field = 'flag' AND m.field = 'name' AND m.t BETWEEN f.t - 172800 AND f.t + 172800 WHERE f.old IS NOT NULL AND f.old <> f.value AND m.old IS NOT NULL AND m.old <> m.value)"


@query("r20_flag_changes", sql(TWO + " " + rows(f"SELECT g.gap_id, {BOTH} AS two {SINCE} FROM gaps g JOIN changes c ON c.vessel_id = g.vessel_id AND c.field = 'flag' AND c.t >= g.gap_start - 31536000 AND c.old IS NOT NULL AND c.old <> c.value GROUP BY 1, 2",
  flag_change="CASE WHEN two THEN 30 WHEN n_7 > 0 THEN 35 WHEN n_30 > 0 THEN 25 WHEN n_365 > 0 THEN 15 ELSE 0 END", flag_changes_90d="CASE WHEN n_90 >= 3 THEN 40 ELSE 0 END"), "gaps", "changes"))
def r20(spark, d):
    return S.flag_change_signals(zoned_frame(spark, d), changes(spark, d))


CALLS = f", calls AS (SELECT p.vessel_id, p.t, arg_min(q.port_id, ({distance('p.lat', 'p.lon', 'q.lat', 'q.lon')}, q.port_id)) AS port_id FROM pos p JOIN ports q ON {distance('p.lat', 'p.lon', 'q.lat', 'q.lon')} <= 10 GROUP BY p.vessel_id, p.t, p.point_id), called AS (SELECT z.*, (SELECT arg_max(struct_pack(t, port_id), t) FROM calls c WHERE c.vessel_id = z.vessel_id AND c.t <= z.gap_start) AS call FROM zoned z)"
VISIT = "(call IS NOT NULL AND (gap_start - call.t) / 86400.0 <= 30)"


@query("r27_voyage_signals", sql(CALLS + " " + rows("SELECT *, EXISTS (SELECT 1 FROM changes c WHERE c.vessel_id = x.vessel_id AND c.field = 'name' AND c.old IS NOT NULL AND c.old <> c.value AND c.t BETWEEN coalesce(least(x.call.t, x.gap_start - 86400), x.gap_start - 2592000) AND x.gap_start) AS renamed FROM called x",
  name_change_in_voyage="CASE WHEN renamed THEN 20 ELSE 0 END", terminal_gap_zone=f"CASE WHEN {VISIT} AND corridor_kind = 'sts_zone' THEN 40 WHEN {VISIT} THEN 25 ELSE 0 END", sanctioned_port=f"CASE WHEN {VISIT} AND call.port_id % 5 = 0 THEN 50 ELSE 0 END",
  at_sea="CASE WHEN (gap_start - call.t) / 86400.0 >= 14 THEN 35 WHEN (gap_start - call.t) / 86400.0 >= 7 THEN 25 WHEN (gap_start - call.t) / 86400.0 >= 3 THEN 15 ELSE 0 END").replace("least(x.call.t, x.gap_start - 86400)", "CASE WHEN x.call IS NOT NULL THEN least(x.call.t, x.gap_start - 86400) END"), "zoned", "ports", "changes"))
def r27(spark, d):
    called = S.with_port_calls(zoned_frame(spark, d), positions(spark, d), ports(spark, d), 10.0)
    return S.voyage_signals(called, changes(spark, d), F.col("last_port") % 5 == 0, (3, 7, 14))


SIDES = "(SELECT arg_max(struct_pack(t, lat, lon), (t, point_id)) FROM pos p WHERE p.vessel_id = c.vessel_id AND p.t <= c.t) AS a, (SELECT arg_min(struct_pack(t, lat, lon), (t, point_id)) FROM pos p WHERE p.vessel_id = c.vessel_id AND p.t >= c.t) AS b"


@query("r22_id_change", sql(f""", moved AS (SELECT vessel_id, t, CASE WHEN t - a.t <= 21600 AND b.t - t <= 21600 AND {distance('a.lat', 'a.lon', 'b.lat', 'b.lon')} > 5 THEN 20 ELSE 45 END AS p FROM (SELECT c.vessel_id, c.t, {SIDES} FROM changes c WHERE field = 'callsign' AND {REAL}))
  SELECT gap_id, 'id_change' AS signal, CAST(max(p) AS INT) AS points FROM gaps g JOIN moved m ON m.vessel_id = g.vessel_id AND m.t BETWEEN g.gap_start - 604800 AND g.gap_end + 604800 GROUP BY 1""", "gaps", "changes"))
def r22(spark, d):
    return S.id_change_signals(zoned_frame(spark, d), changes(spark, d), positions(spark, d))


LEGIT = f"""SELECT gap_id, gap_start, flag_id, count(*) OVER (PARTITION BY vessel_id ORDER BY gap_start RANGE BETWEEN 7776000 PRECEDING AND 1 PRECEDING) AS others, (SELECT max(t) FROM changes c WHERE c.vessel_id = g.vessel_id AND field = 'flag' AND {REAL} AND c.t <= g.gap_start) AS flag_t,
  (SELECT arg_max(value, (t, change_id)) FROM changes c WHERE c.vessel_id = g.vessel_id AND field = 'insurer' AND c.t <= g.gap_start) AS insurer FROM gaps g"""


@query("r23_legitimacy", sql(rows(LEGIT, clean_history="CASE WHEN others = 0 AND flag_id % 5 <> 0 THEN -10 ELSE 0 END", steady_flag="CASE WHEN flag_t IS NULL AND flag_id % 5 <> 0 THEN -10 ELSE 0 END", group_insurer="CASE WHEN insurer >= 4 THEN -15 ELSE 0 END", young_high_risk_flag="CASE WHEN (gap_start - flag_t) / 86400.0 < 730 AND flag_id % 5 = 0 THEN 20 ELSE 0 END"), "gaps", "changes"))
def r23(spark, d):
    return S.legitimacy_signals(zoned_frame(spark, d), changes(spark, d), risk())


@query("r25_report_signals", sql(", st AS (SELECT vessel_id, t, t - lag(t) OVER (PARTITION BY vessel_id ORDER BY t, point_id) AS d FROM pos) " + rows("SELECT gap_id, gap_start, (SELECT percentile_disc(0.5) WITHIN GROUP (ORDER BY d) FROM st WHERE st.vessel_id = g.vessel_id AND d IS NOT NULL AND st.t BETWEEN g.gap_start - 86400 AND g.gap_start) AS median, (SELECT min(t) FROM pos p WHERE p.vessel_id = g.vessel_id) AS first_t FROM gaps g",
  interval_mismatch="CASE WHEN median > 36000 THEN 10 ELSE 0 END", new_id="CASE WHEN (gap_start - first_t) / 86400.0 <= 3 THEN 20 WHEN (gap_start - first_t) / 86400.0 <= 6 THEN 10 ELSE 0 END"), "gaps"))
def r25(spark, d):
    return S.report_signals(zoned_frame(spark, d), positions(spark, d), 36_000, (3, 6))


@query("r6_event_signals", sql("""SELECT gap_id, signal, CAST(max(points) AS INT) AS points FROM gaps g JOIN (SELECT vessel_id, t, CASE nav_status WHEN 1 THEN 'status_mismatch' WHEN 15 THEN 'undefined_status' ELSE 'loitering' END AS signal, CASE nav_status WHEN 1 THEN 15 WHEN 15 THEN 5 ELSE 10 END AS points
  FROM pos WHERE nav_status = 15 OR (nav_status = 1 AND sog > 2) OR (nav_status = 5 AND sog < 1)) e ON e.vessel_id = g.vessel_id AND e.t BETWEEN g.gap_start - 21600 AND g.gap_end + 21600 GROUP BY 1, 2""", "gaps"))
def r6(spark, d):
    p, s = positions(spark, d).filter("nav_status = 15 or (nav_status = 1 and sog > 2) or (nav_status = 5 and sog < 1)"), F.col("nav_status")
    events = p.select("vessel_id", "t", F.when(s == 1, "status_mismatch").when(s == 15, "undefined_status").otherwise("loitering").alias("signal"), F.when(s == 1, 15).when(s == 15, 5).otherwise(10).alias("points"))
    return S.event_signals(zoned_frame(spark, d), events)


@query("r33_vessel_signals", sql(f"""SELECT gap_id, signal, points FROM gaps g JOIN (SELECT vessel_id, 'flag_hopping' AS signal, CASE WHEN n >= 5 THEN 50 WHEN n >= 3 THEN 40 ELSE 20 END AS points FROM (SELECT vessel_id, count(*) AS n FROM changes WHERE field = 'flag' AND {REAL} AND t <= {AS_OF} GROUP BY 1) WHERE n >= 2
  UNION ALL SELECT vessel_id, 'insurer_cycling', CASE WHEN n >= 3 THEN 30 ELSE 20 END FROM (SELECT vessel_id, count(*) AS n FROM changes WHERE field = 'insurer' AND {REAL} AND t <= {AS_OF} AND t > {AS_OF} - 7776000 GROUP BY 1) WHERE n >= 2) f USING (vessel_id)""", "gaps", "changes"))
def r33(spark, d):
    c = changes(spark, d)
    hops = I.counted_changes(c, "flag", AS_OF, (365,)).filter("n_365 >= 2").select("vessel_id", F.lit("flag_hopping").alias("signal"), F.when(F.col("n_365") >= 5, 50).when(F.col("n_365") >= 3, 40).otherwise(20).alias("points"))
    cycles = I.insurer_cycling(c, AS_OF).select("vessel_id", F.lit("insurer_cycling").alias("signal"), "points")
    return S.vessel_signals(zoned_frame(spark, d), S.union(hops, cycles))


@query("r34_fleet_signals", sql(""", now AS (SELECT vessel_id, arg_max(value, (t, change_id)) AS manager FROM changes WHERE field = 'manager' GROUP BY 1), n AS (SELECT manager, count(*) AS n FROM now WHERE vessel_id IN (SELECT vessel_id FROM gaps) GROUP BY 1 HAVING count(*) >= 3)
  SELECT gap_id, 'fleet_pattern' AS signal, CASE WHEN n >= 6 THEN 20 ELSE 10 END AS points FROM gaps JOIN now USING (vessel_id) JOIN n USING (manager)""", "gaps", "changes"))
def r34(spark, d):
    return S.fleet_signals(zoned_frame(spark, d), changes(spark, d))


@query("r3_selective_darkness", sql("""SELECT gap_id, 'selective_dark_zone_evasion' AS signal, 20 AS points FROM zoned a WHERE corridor_kind = 'dark_zone' AND (SELECT count(DISTINCT b.vessel_id) FROM zoned b WHERE b.corridor_id = a.corridor_id AND b.vessel_id <> a.vessel_id AND b.gap_start <= a.gap_end AND a.gap_start <= b.gap_end) <= 2""", "zoned"))
def r3(spark, d):
    return S.selective_darkness(zoned_frame(spark, d))


OVERRIDES = (("corridor", 3, "zone", 35), ("corridor", 5, "dark_zone", -20), ("region", 1, "duration", 30), ("region", 1, "zone", 25))
BASE = "SELECT gap_id, 'duration' AS signal, CASE WHEN duration_minutes >= 1440 THEN 55 ELSE 12 END AS points FROM zoned UNION ALL SELECT gap_id, 'zone', 20 FROM zoned WHERE corridor_kind = 'sts_zone' UNION ALL SELECT gap_id, 'dark_zone', -10 FROM zoned WHERE corridor_kind = 'dark_zone'"
OVER = f""", base AS ({BASE}), o AS (SELECT * FROM (VALUES {', '.join(f"('{s}', {i}, '{n}', {p})" for s, i, n, p in OVERRIDES)}) v(scope, id, signal, points)),
  own AS (SELECT b.gap_id, b.signal, coalesce(c.points, r.points, b.points) AS points FROM base b JOIN zoned z USING (gap_id) LEFT JOIN o c ON c.scope = 'corridor' AND c.id = z.corridor_id AND c.signal = b.signal LEFT JOIN o r ON r.scope = 'region' AND r.id = z.vessel_id % 3 AND r.signal = b.signal) """


def base_signals(spark, d):
    z = zoned_frame(spark, d).withColumn("region_id", (F.col("vessel_id") % 3).cast("int"))
    s = S.rows(z, duration=F.when(F.col("duration_minutes") >= 1440, 55).otherwise(12), zone=F.when(F.col("corridor_kind") == "sts_zone", 20).otherwise(0), dark_zone=F.when(F.col("corridor_kind") == "dark_zone", -10).otherwise(0))
    return s, z, spark.createDataFrame(list(OVERRIDES), "scope string, id int, signal string, points int")


@query("r14_overrides", sql(OVER + "SELECT gap_id, signal, CAST(points AS INT) AS points FROM own", "zoned"))
def r14(spark, d):
    return S.overridden(*base_signals(spark, d))


@query("r17_shadow_score", sql(OVER + "SELECT gap_id, score, proposed, proposed - score AS change FROM (SELECT gap_id, CAST(sum(points) AS BIGINT) AS score FROM base GROUP BY 1) JOIN (SELECT gap_id, CAST(sum(points) AS BIGINT) AS proposed FROM own GROUP BY 1) USING (gap_id) WHERE proposed <> score", "zoned"))
def r17(spark, d):
    return S.shadow(*base_signals(spark, d))


@query("r19_waterfall", sql(OVER + "SELECT gap_id, signal, CAST(points AS INT) AS points, CAST(row_number() OVER w AS INT) AS place, CAST(sum(points) OVER w AS BIGINT) AS running FROM base WINDOW w AS (PARTITION BY gap_id ORDER BY abs(points) DESC, signal ROWS UNBOUNDED PRECEDING)", "zoned"))
def r19(spark, d):
    return S.waterfall(base_signals(spark, d)[0])


@query("r19_related_alerts", sql("""SELECT gap_id, other, CAST(weight AS INT) AS weight FROM (SELECT *, row_number() OVER (PARTITION BY gap_id ORDER BY weight DESC, other) AS r FROM (SELECT gap_id, other, max(w) + CASE WHEN count(*) > 1 THEN 20 ELSE 0 END AS weight FROM (
  SELECT a.gap_id, b.gap_id AS other, 80 AS w FROM alerts a JOIN alerts b ON a.vessel_id = b.vessel_id AND b.gap_start BETWEEN a.gap_start - 604800 AND a.gap_start + 604800 UNION ALL SELECT a.gap_id, b.gap_id, 60 FROM alerts a JOIN alerts b ON a.corridor_id = b.corridor_id AND b.gap_start BETWEEN a.gap_start - 21600 AND a.gap_start + 21600)
  WHERE gap_id <> other GROUP BY 1, 2)) WHERE r <= 30""", "alerts"))
def r19_related(spark, d):
    return S.related(alert_frame(spark, d), hours=6)


@query("r16_dirty", sql("SELECT gap_id FROM gaps WHERE vessel_id IN (SELECT vessel_id FROM pos WHERE nav_status = 15) OR NOT (gap_id % 3 > 0 AND gap_id % 7 > 0)", "gaps"))
def r16(spark, d):
    g = zoned_frame(spark, d)
    scored = g.filter("gap_id % 3 > 0").select("gap_id", F.when(F.col("gap_id") % 7 > 0, "now").otherwise("old").alias("config"))
    return S.dirty(g, positions(spark, d).filter("nav_status = 15"), scored, "now")


@query("r18_stub_scores", sql("""SELECT vessel_id, CAST(floor((points + CASE WHEN flag_id % 5 = 0 THEN 15 ELSE 0 END + CASE WHEN 2024 - year_built >= 20 THEN 10 ELSE 0 END + CASE WHEN dwt IS NULL OR dwt <= 0 THEN 5 ELSE 0 END) * CASE WHEN dwt >= 200000 THEN 13 WHEN dwt >= 120000 THEN 12 ELSE 10 END / 10) AS INT) AS score
  FROM (SELECT s_suppkey * 13 AS vessel_id, 30 AS points FROM supplier) l LEFT JOIN vessels USING (vessel_id) WHERE vessel_id NOT IN (SELECT vessel_id FROM pos)""", "pos", "vessels"))
def r18(spark, d):
    listed = read(spark, d, "supplier").select((F.col("s_suppkey") * 13).alias("vessel_id"), F.lit(30).alias("points"))
    return S.stubs(listed, positions(spark, d), vessels(spark, d), F.coalesce(risk(), F.lit(False)), 2024)
