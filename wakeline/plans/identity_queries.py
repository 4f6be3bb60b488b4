"""Queries over changes of identity, cover, draught and destination."""

from __future__ import annotations

import pyspark.sql.functions as F

from wakeline.functions import prefixes as P
from wakeline.operators import identity as I
from wakeline.plans.base import query
from wakeline.plans.detector_queries import met
from wakeline.plans.oracle import distance, sql
from wakeline.sources.adapter import EPOCH, changes, corridors, ports, positions, vessels, voyages

AS_OF = EPOCH + 40 * 86_400
REAL = "old IS NOT NULL AND old <> value"
EUROPE = ("ROTTERDAM", "AUGUSTA", "KALAMATA")


def ranges(column: str, table, k: int, other: str) -> str:
    return "CASE " + " ".join(f"WHEN {column} BETWEEN {low} AND {high} THEN '{fields[k]}'" for low, high, *fields in table) + f" ELSE {other} END"


MID = "200 + vessel_id * 37 % 500"


FLAG_LIST = "(VALUES " + ", ".join(f"({k}, '{v}')" for k, v in P.FLAG_OF.items()) + ") g(prefix, flag_code)"


@query("f13_flag_of_prefix", sql(f"""SELECT vessel_id, flag_code, CASE WHEN flag_code IS NULL THEN 'unknown' WHEN flag_code IN ('{"', '".join(P.HIGH_RISK.split())}') THEN 'high' WHEN flag_code IN ('{"', '".join(P.LOW_RISK.split())}') THEN 'low' ELSE 'medium' END AS risk
  FROM vessels LEFT JOIN {FLAG_LIST} ON prefix = {MID}""", "vessels"))
def f13(spark, d):
    flag = P.flag_of(F.lit(200) + F.col("vessel_id") * 37 % 500)
    return vessels(spark, d).select("vessel_id", flag.alias("flag_code"), P.flag_risk(flag).alias("risk"))


@query("f19_ship_type", sql(f"SELECT vessel_id, CASE WHEN c BETWEEN 70 AND 89 AND c % 10 BETWEEN 1 AND 4 THEN kind || ' hazard ' || substr('ABCD', CAST(c % 10 AS INT), 1) ELSE kind END AS ship_type FROM (SELECT vessel_id, c, {ranges('c', I.SHIP_TYPES, 0, chr(39) + 'unknown' + chr(39))} AS kind FROM (SELECT vessel_id, vessel_id * 7 % 100 AS c FROM vessels))", "vessels"))
def f19(spark, d):
    return vessels(spark, d).select("vessel_id", I.ship_type(F.col("vessel_id") * 7 % 100).alias("ship_type"))


@query("w23_draught_change", sql(f"""SELECT vessel_id, point_id, CAST(draught - before AS INT) AS change, points FROM (SELECT s.*, CASE {' '.join(f'WHEN dwt >= {w} THEN {x}' for w, x, _ in I.DRAUGHT_STEPS[:-1])} ELSE {I.DRAUGHT_STEPS[-1][1]} END AS least, CASE {' '.join(f'WHEN dwt >= {w} THEN {p}' for w, _, p in I.DRAUGHT_STEPS[:-1])} ELSE {I.DRAUGHT_STEPS[-1][2]} END AS points FROM (
  SELECT *, lag(draught) OVER w AS before, lag(t) OVER w AS before_t, lead(draught) OVER w AS after FROM voyages WINDOW w AS (PARTITION BY vessel_id ORDER BY t, point_id)) s JOIN vessels USING (vessel_id)) x
  WHERE t - before_t <= 86400 AND abs(draught - before) >= least AND abs(after - draught) <= least / 2 AND NOT EXISTS (SELECT 1 FROM ports q WHERE {distance('x.lat', 'x.lon', 'q.lat', 'q.lon')} <= 5)""", "voyages", "vessels", "ports"))
def w23(spark, d):
    return I.draught_changes(voyages(spark, d), vessels(spark, d), ports(spark, d))


@query("w26_receivers_disagree", sql(f"""SELECT a.vessel_id, a.point_id AS point_id_1, b.point_id AS point_id_2, 30 AS points FROM voyages a JOIN voyages b ON a.vessel_id = b.vessel_id AND b.t BETWEEN a.t AND a.t + 7200 AND a.source <> b.source AND (b.t > a.t OR b.point_id > a.point_id)
  WHERE {distance('a.lat', 'a.lon', 'b.lat', 'b.lon')} > 40""", "voyages"))
def w26(spark, d):
    return I.receivers_disagree(voyages(spark, d), 7_200, 40.0)


@query("w27_identity_swap", met(172_800, 60, 43_200, f"""SELECT m.vessel_id_1, m.vessel_id_2, a.field, min(m.m) AS met_t, 50 AS points FROM (SELECT DISTINCT vessel_id_1, vessel_id_2, greatest(t_1, t_2) AS m FROM met) m JOIN changes a ON a.vessel_id = m.vessel_id_1 AND a.t BETWEEN m.m AND m.m + 864000 JOIN changes b ON b.vessel_id = m.vessel_id_2 AND b.field = a.field AND b.t BETWEEN m.m AND m.m + 864000
  WHERE a.old IS NOT NULL AND a.old <> a.value AND b.old IS NOT NULL AND b.old <> b.value AND (a.old = b.value OR b.old = a.value) GROUP BY 1, 2, 3""", "TRUE", "changes"))
def w27(spark, d):
    return I.identity_swaps(positions(spark, d), changes(spark, d), 864_000, 172_800, 60.0, 43_200)


@query("w30_flag_hopping", sql(f"""SELECT vessel_id, n_90, n_365, CAST(CASE WHEN EXISTS (SELECT 1 FROM changes f JOIN changes m ON f.vessel_id = m.vessel_id AND m.t BETWEEN f.t - 604800 AND f.t + 604800 WHERE f.vessel_id = h.vessel_id AND f.field = 'flag' AND f.t <= {AS_OF} AND m.field = 'manager' AND f.old <> f.value AND m.old <> m.value)
  THEN points // 2 ELSE points END AS INT) AS points FROM (SELECT vessel_id, n_90, n_365, CASE WHEN n_365 >= 5 THEN 50 WHEN n_90 >= 3 THEN 40 WHEN n_90 >= 2 THEN 20 END AS points FROM (
  SELECT vessel_id, count(*) FILTER (t > {AS_OF - 90 * 86400}) AS n_90, count(*) FILTER (t > {AS_OF - 365 * 86400}) AS n_365 FROM changes WHERE field = 'flag' AND t <= {AS_OF} AND {REAL} GROUP BY 1)) h WHERE points IS NOT NULL""", "changes"))
def w30(spark, d):
    return I.flag_hopping(changes(spark, d), AS_OF)


@query("w31_insurer_cycling", sql(f"""SELECT n.vessel_id, n_90, insurer, CASE WHEN n_90 >= 3 THEN 30 ELSE 20 END AS points FROM (SELECT vessel_id, count(*) AS n_90 FROM changes WHERE field = 'insurer' AND t <= {AS_OF} AND t > {AS_OF - 90 * 86400} AND {REAL} GROUP BY 1) n
  JOIN (SELECT vessel_id, arg_max(value, (t, change_id)) AS insurer FROM changes WHERE field = 'insurer' AND t <= {AS_OF} GROUP BY 1) i USING (vessel_id) WHERE n_90 >= 2""", "changes"))
def w31(spark, d):
    return I.insurer_cycling(changes(spark, d), AS_OF)


@query("w32_insurance_gap", sql(f"""SELECT vessel_id, change_id, days, ongoing, CASE WHEN days >= 90 THEN 40 WHEN days >= 60 THEN 30 WHEN days >= 30 THEN 20 ELSE 10 END AS points FROM (SELECT vessel_id, change_id, value, (coalesce(next, {AS_OF}) - t) // 86400 AS days, next IS NULL AS ongoing FROM (
  SELECT *, lead(t) OVER (PARTITION BY vessel_id ORDER BY t, change_id) AS next FROM changes WHERE field = 'insurer' AND t <= {AS_OF})) WHERE value = 0 AND days >= 7""", "changes"))
def w32(spark, d):
    return I.insurance_gaps(changes(spark, d), AS_OF, F.col("value") == 0)


NOW = EPOCH + 28 * 86_400
TO_ZONE = "((degrees(atan2(sin(radians(zo - lon)) * cos(radians(za)), cos(radians(lat)) * sin(radians(za)) - sin(radians(lat)) * cos(radians(za)) * cos(radians(zo - lon)))) + 360) % 360)"


@query("w34_destination", sql(f""", last AS (SELECT vessel_id, arg_max(struct_pack(destination, lat, lon), (t, point_id)) AS x FROM voyages WHERE t <= {NOW} GROUP BY 1), week AS (SELECT * FROM voyages WHERE t > {NOW - 7 * 86400} AND t <= {NOW})
  SELECT vessel_id, 'blank' AS kind, 10 AS points FROM last WHERE coalesce(x.destination, '') IN {I.BLANK} UNION ALL SELECT vessel_id, 'often', 20 FROM week WHERE destination IS NOT NULL GROUP BY 1 HAVING count(DISTINCT destination) > 3
  UNION ALL SELECT DISTINCT vessel_id, 'astray', 30 FROM (SELECT l.vessel_id, x.lat AS lat, x.lon AS lon, c[len(c) // 2 + 1] AS course, za, zo FROM last l JOIN (SELECT vessel_id, list_sort(list(cog)) AS c FROM week WHERE cog IS NOT NULL GROUP BY 1) USING (vessel_id) CROSS JOIN (SELECT (min_lat + max_lat) / 2 AS za, (min_lon + max_lon) / 2 AS zo FROM corridors WHERE kind = 'sts_zone') WHERE x.destination IN {EUROPE})
  WHERE least(abs({TO_ZONE} - course), 360 - abs({TO_ZONE} - course)) <= 45""", "voyages", "corridors"))
def w34(spark, d):
    return I.destination_anomalies(voyages(spark, d), corridors(spark).filter("kind = 'sts_zone'"), NOW, EUROPE)
