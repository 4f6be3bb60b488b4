"""Common table expressions for the DuckDB counterparts of the queries."""

from __future__ import annotations

from wakeline.functions.geo import RADIUS_NM
from wakeline.functions.vessels import OTHER_SPEEDS, SPEED_CLASSES
from wakeline.sources.adapter import CORRIDORS, DESTINATIONS, EPOCH, FIELDS, STATUS, VALUES


def distance(a: str, b: str, c: str, d: str) -> str:
    x = f"(pow(sin(radians({c} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin(radians({d} - {b}) / 2), 2))"
    return f"(CAST({2 * RADIUS_NM} AS DOUBLE) * atan2(sqrt({x}), sqrt(greatest(0, 1 - {x}))))"


def speed(dwt: str, k: int) -> str:
    return "CASE " + " ".join(f"WHEN {dwt} >= {least} THEN {s[k]}" for least, *s in SPEED_CLASSES) + f" ELSE {OTHER_SPEEDS[k]} END"


CTE = {
    "pos": f"""pos AS (SELECT user_id AS vessel_id, event_id AS point_id, epoch_us(ts) // 1000000 AS t, value / CAST(10 AS DOUBLE) AS sog,
      (CAST(json_extract_string(props, '$.k') AS INT) * 37) % 360 AS cog, CASE event_type {' '.join(f"WHEN '{k}' THEN {v}" for k, v in STATUS.items())} END AS nav_status,
      CAST(user_id % 3 AS DOUBLE) + CAST(event_id * 7919 % 200 AS DOUBLE) / CAST(100 AS DOUBLE) AS lat,
      CAST(user_id % 3 AS DOUBLE) + CAST(event_id * 104729 % 200 AS DOUBLE) / CAST(100 AS DOUBLE) AS lon,
      value, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events)""",
    "vessels": """vessels AS (SELECT c_custkey AS vessel_id, c_name AS name, 'NATION_' || c_nationkey AS flag, c_nationkey AS flag_id,
      (c_acctbal + CAST(1000 AS DOUBLE)) * CAST(20 AS DOUBLE) AS dwt, c_mktsegment AS kind, CAST(1980 + c_custkey % 45 AS INT) AS year_built,
      lpad(CAST(c_custkey * 7919 % 9000000 + 1000000 AS VARCHAR), 7, '0') AS imo FROM customer)""",
    "corridors": "corridors AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{n}', '{k}', " + ", ".join(f"CAST({x} AS DOUBLE)" for x in rest) + ")" for i, n, k, *rest in CORRIDORS) + ") v(corridor_id, corridor, kind, min_lat, max_lat, min_lon, max_lon, weight))",
    "ports": "ports AS (SELECT n_nationkey AS port_id, n_name AS port, CAST(n_nationkey * 16 AS DOUBLE) / CAST(100 AS DOUBLE) AS lat, CAST(n_nationkey * 7 % 25 * 16 AS DOUBLE) / CAST(100 AS DOUBLE) AS lon FROM nation)",
    "steps": f"""steps AS (SELECT *, d_s / 3600.0::DOUBLE AS hours, {distance('lat', 'lon', 'lat2', 'lon2')} AS nm FROM (
      SELECT *, lead(t) OVER w - t AS d_s, lead(t) OVER w AS t2, lead(lat) OVER w AS lat2, lead(lon) OVER w AS lon2, lead(sog) OVER w AS sog2, lead(point_id) OVER w AS point2, lead(k) OVER w AS k2
      FROM pos WINDOW w AS (PARTITION BY vessel_id ORDER BY t, point_id)) WHERE t2 IS NOT NULL)""",
    "gaps": f"""gaps AS (SELECT point_id AS gap_id, vessel_id, t AS gap_start, t2 AS gap_end, d_s // 60 AS duration_minutes, nm, hours, lat, lon, lat2, lon2, sog AS pre_gap_sog, k,
      nm / (({speed('v.dwt', 0)}) * hours) AS ratio, nm / (({speed('v.dwt', 0)}) * hours) > 1.1 AS impossible, v.dwt, v.flag, v.flag_id, v.name, v.kind
      FROM (SELECT s.*, c.dwt, c.flag, c.flag_id, c.name, c.kind FROM steps s JOIN vessels c USING (vessel_id) WHERE d_s >= 7200) v)""",
    "zoned": """zoned AS (SELECT g.*, c.corridor_id, c.weight AS corridor_weight, c.kind AS corridor_kind FROM gaps g LEFT JOIN
      (SELECT gap_id, corridor_id, weight, kind FROM (SELECT gap_id, c.corridor_id, c.weight, c.kind, row_number() OVER (PARTITION BY gap_id ORDER BY c.weight DESC, c.corridor_id) AS r
        FROM gaps g JOIN corridors c ON g.lat BETWEEN c.min_lat AND c.max_lat AND g.lon BETWEEN c.min_lon AND c.max_lon) WHERE r = 1) c USING (gap_id))""",
    "changes": f"""changes AS (SELECT *, lag(value) OVER w AS old, lag(change_id) OVER w AS old_change FROM (SELECT o_custkey AS vessel_id, o_orderkey AS change_id, {EPOCH} + (o_orderkey * 7919 % 120 - 60) * 86400 + o_orderkey % 24 * 3600 AS t,
      CASE o_orderkey % {len(FIELDS)} {' '.join(f"WHEN {i} THEN '{f}'" for i, f in enumerate(FIELDS))} END AS field, o_orderkey * 31 % (CASE o_orderkey % {len(FIELDS)} {' '.join(f"WHEN {i} THEN {n}" for i, n in enumerate(VALUES))} END) AS value FROM orders)
      WINDOW w AS (PARTITION BY vessel_id, field ORDER BY t, change_id))""",
    "voyages": f"""voyages AS (SELECT *, CAST(k % 12 + 4 AS DOUBLE) AS draught, CASE WHEN k % 11 > 0 THEN CASE k % {len(DESTINATIONS)} {' '.join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(DESTINATIONS))} END END AS destination, k % 3 AS source FROM pos)""",
    "detections": "detections AS (SELECT point_id AS detection_id, t, lat, lon, CAST(floor(value) % 300 + 20 AS INT) AS length, k * 13 % 360 AS heading FROM pos WHERE nav_status = 5)",
    "lights": "lights AS (SELECT point_id AS light_id, t, lat, lon, k % 2 AS quality FROM pos WHERE nav_status = 1)",
    "alerts": """alerts AS (SELECT *, CASE WHEN score >= 76 THEN 'critical' WHEN score >= 51 THEN 'high' WHEN score >= 21 THEN 'medium' ELSE 'low' END AS band,
      CASE gap_id % 4 WHEN 0 THEN 'new' WHEN 1 THEN 'under_review' WHEN 2 THEN 'confirmed' ELSE 'dismissed' END AS status, gap_start // 86400 AS day FROM (
      SELECT z.*, CASE WHEN duration_minutes >= 1440 THEN 55 WHEN duration_minutes >= 720 THEN 40 WHEN duration_minutes >= 480 THEN 25 WHEN duration_minutes >= 240 THEN 12 ELSE 5 END
        + CASE WHEN impossible THEN 40 WHEN ratio > 0.8 THEN 15 ELSE 0 END + CASE corridor_kind WHEN 'sts_zone' THEN 20 WHEN 'dark_zone' THEN -10 ELSE 0 END AS score FROM zoned z))""",
}
NEEDS = {"voyages": ("pos",), "detections": ("pos",), "lights": ("pos",), "steps": ("pos",), "gaps": ("steps", "vessels"), "zoned": ("gaps", "corridors"), "alerts": ("zoned",)}


def sql(body: str, *names: str) -> str:
    """The body after the named expressions and what they need."""
    order: list[str] = []

    def add(name: str) -> None:
        for x in NEEDS.get(name, ()):
            add(x)
        if name not in order:
            order.append(name)

    for n in names:
        add(n)
    return ("WITH " + ",\n".join(CTE[n] for n in order) + "\n" if order else "") + body
