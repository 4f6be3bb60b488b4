"""Queries on merges, chains, fleets, routes, polygons, names and the running of the pipeline."""

from __future__ import annotations

import pyspark.sql.functions as F

from wakeline.functions import polygons as P
from wakeline.functions import prefixes
from wakeline.operators import graph
from wakeline.operators import networks as N
from wakeline.operators import routes as R
from wakeline.operators.alerts import notify
from wakeline.operators.graph import _cut
from wakeline.operators.pairs import near_port
from wakeline.plans.base import alert_frame, gap_frame, query, zoned_frame
from wakeline.plans.cluster_queries import DAYS, recursive
from wakeline.plans.detector_queries import met
from wakeline.plans.identity_queries import MID
from wakeline.plans.oracle import distance, sql
from wakeline.plans.signal_queries import BASE, base_signals
from wakeline.sources.adapter import EPOCH, changes, corridors, ports, positions, read, vessels

LAST = "l AS (SELECT vessel_id, arg_max(struct_pack(t, lat, lon), (t, point_id)) AS x, arg_min(struct_pack(t, lat, lon), (t, point_id)) AS y FROM pos GROUP BY 1)"
LOW, HIGH = -27 * 86_400, -20 * 86_400  # every vessel reports all month, so successions overlap


@query("g1_merge_candidates", met(172_800, 20, 21_600, f""", {LAST} SELECT dark_id, new_id, CAST(s AS INT) AS score, CASE WHEN s >= 75 THEN 'merge' WHEN s >= 40 THEN 'review' ELSE 'no' END AS verdict FROM (SELECT dark_id, new_id, CASE WHEN nm <= 10 THEN 20 WHEN nm <= 50 THEN 10 ELSE 0 END + CASE WHEN abs(wait) <= 172800 THEN 15 WHEN abs(wait) <= 604800 THEN 10 ELSE 0 END
    + CASE WHEN v.flag = w.flag THEN 10 ELSE 0 END + CASE WHEN v.kind = w.kind THEN 15 ELSE 0 END + CASE WHEN v.dwt / nullif(w.dwt, 0) BETWEEN 0.8 AND 1.25 THEN 20 ELSE 0 END + CASE WHEN v.imo = w.imo THEN 25 ELSE 0 END AS s
  FROM (SELECT a.vessel_id AS dark_id, b.vessel_id AS new_id, b.y.t - a.x.t AS wait, {distance('a.x.lat', 'a.x.lon', 'b.y.lat', 'b.y.lon')} AS nm FROM l a JOIN l b ON a.vessel_id <> b.vessel_id AND b.y.t - a.x.t > {LOW} AND b.y.t - a.x.t <= {HIGH}) p JOIN vessels v ON v.vessel_id = dark_id JOIN vessels w ON w.vessel_id = new_id
  WHERE nm <= 16.0::DOUBLE * greatest(abs(wait) / 3600.0::DOUBLE, 1.0::DOUBLE) AND NOT EXISTS (SELECT 1 FROM met m WHERE m.vessel_id_1 = dark_id AND m.vessel_id_2 = new_id))""", "TRUE", "vessels"))
def g1(spark, d):
    p = positions(spark, d)
    return N.merge_candidates(p, vessels(spark, d), (172_800, 20.0, 21_600), LOW, HIGH)


ALIAS = "alias AS (SELECT vessel_id AS id, vessel_id - vessel_id % 49 AS canonical FROM vessels WHERE vessel_id % 49 <> 0)"


def alias(spark, d):
    v = F.col("vessel_id")
    return vessels(spark, d).filter(v % 49 != 0).select(v.alias("id"), (v - v % 49).alias("canonical"))


@query("g3_merge_execution", sql(f""", {ALIAS}, undone AS (SELECT * FROM alias WHERE id % 10 <> 3) SELECT vessel_id, gap_id, absorbed_id FROM (SELECT *, row_number() OVER (PARTITION BY vessel_id, slot ORDER BY absorbed_id IS NOT NULL, absorbed_id) AS r FROM (
  SELECT DISTINCT ON (old, slot) old, slot, gap_id, vessel_id, absorbed_id FROM (SELECT g.vessel_id AS old, g.gap_start // 86400 AS slot, g.gap_id, coalesce(u.canonical, g.vessel_id) AS vessel_id, CASE WHEN u.id IS NOT NULL THEN g.vessel_id END AS absorbed_id FROM gaps g LEFT JOIN undone u ON u.id = g.vessel_id) ORDER BY old, slot, gap_id)) WHERE r = 1""", "gaps"))
def g3_merge(spark, d):
    first = gap_frame(spark, d).groupBy("vessel_id", F.floor(F.col("gap_start") / 86_400).alias("slot")).agg(F.min("gap_id").alias("gap_id"))
    kept = N.reversed_merge(alias(spark, d), alias(spark, d).filter("id % 10 = 3"))
    return N.rekeyed(first, kept, unique=("vessel_id", "slot")).select("vessel_id", "gap_id", "absorbed_id")


@query("g6_doubtful_merges", sql(f""", {ALIAS} SELECT DISTINCT a.id, a.canonical FROM alias a JOIN vessels v ON v.vessel_id = a.id JOIN vessels w ON w.vessel_id = a.canonical WHERE v.imo IN (SELECT imo FROM vessels WHERE vessel_id % 11 = 0) OR w.imo IN (SELECT imo FROM vessels WHERE vessel_id % 11 = 0)""", "vessels"))
def g6(spark, d):
    v = vessels(spark, d)
    return N.doubtful_merges(alias(spark, d), v, v.filter("vessel_id % 11 = 0").select("imo"))


FLEETS = "fleets AS (SELECT vessel_id, arg_max(value, (t, change_id)) AS fleet FROM changes WHERE field = 'manager' GROUP BY 1)"


def fleets(spark, d):
    return changes(spark, d).filter("field = 'manager'").groupBy("vessel_id").agg(F.max_by("value", F.struct("t", "change_id")).alias("fleet"))


@query("g13_fleet_in_corridor", sql(f""", {FLEETS}, g AS (SELECT z.*, fleet FROM zoned z JOIN fleets USING (vessel_id)) SELECT DISTINCT fleet, 'same_corridor' AS pattern FROM g a WHERE (SELECT count(DISTINCT vessel_id) FROM g b WHERE b.fleet = a.fleet AND b.corridor_id IS NOT DISTINCT FROM a.corridor_id AND b.gap_start BETWEEN a.gap_start - 2592000 AND a.gap_start) >= 3
  UNION ALL SELECT DISTINCT fleet, 'same_place' FROM g a WHERE (SELECT count(DISTINCT vessel_id) FROM g b WHERE b.fleet = a.fleet AND trunc(b.lat / 5) = trunc(a.lat / 5) AND trunc(b.lon / 5) = trunc(a.lon / 5) AND b.gap_start BETWEEN a.gap_start - 172800 AND a.gap_start) >= 3 UNION ALL SELECT fleet, 'many_flags' FROM g GROUP BY 1 HAVING count(DISTINCT flag) >= 4""", "zoned", "changes"))
def g13_fleet(spark, d):
    return N.fleet_patterns(zoned_frame(spark, d), fleets(spark, d))


@query("g14_batch_renames", sql(f""", {FLEETS}, r AS (SELECT c.vessel_id, c.t, fleet FROM changes c JOIN fleets USING (vessel_id) WHERE field = 'name' AND old IS NOT NULL AND old <> value) SELECT fleet, max(n) AS vessels FROM (SELECT a.fleet, (SELECT count(DISTINCT vessel_id) FROM r b WHERE b.fleet = a.fleet AND b.t BETWEEN a.t - 2592000 AND a.t) AS n FROM r a) GROUP BY 1 HAVING max(n) > 3""", "changes"))
def g14_renames(spark, d):
    return N.batch_renames(changes(spark, d), fleets(spark, d))


ROUND = 0.37  # no mean of a day's reports, which have two or three decimals, lies on this edge, so the order of a sum does not count


def thousandths(x: str) -> str:
    return f"CAST(floor(({x}) * 1000 + {ROUND}) AS BIGINT)"


@query("g16_segments", recursive(f", {DAYS} SELECT vessel_id, w AS day, n, CAST(CASE WHEN nm > 0 THEN least(100, floor(100 * {distance('la1', 'lo1', 'la2', 'lo2')} / nm)) ELSE 100 END AS BIGINT) AS straightness, {thousandths('bearing')} AS bearing, {thousandths('nm')} AS nm, seconds, {thousandths('lat')} AS lat, {thousandths('lon')} AS lon, {thousandths('sog')} AS mean_sog FROM seg JOIN (SELECT vessel_id, t // 86400 AS w, max(t) - min(t) AS seconds FROM pos GROUP BY 1, 2) USING (vessel_id, w)", "pos").replace(")\n,", "),\n", 1))
def g16(spark, d):
    whole = lambda c: F.floor(F.col(c) * 1000 + ROUND).cast("long").alias(c)
    return N.segments(positions(spark, d)).select("vessel_id", "day", "n", "straightness", whole("bearing"), whole("nm"), "seconds", whole("lat"), whole("lon"), whole("mean_sog"))


CALLED = f"calls AS (SELECT p.vessel_id, arg_min(q.port_id, ({distance('p.lat', 'p.lon', 'q.lat', 'q.lon')}, q.port_id)) AS port_id, p.t FROM pos p JOIN ports q ON {distance('p.lat', 'p.lon', 'q.lat', 'q.lon')} <= 10 GROUP BY p.vessel_id, p.point_id, p.t)"


def calls(spark, d):
    p = positions(spark, d)
    return p.join(near_port(p, ports(spark, d), 10.0).select("point_id", "port_id"), "point_id").select("vessel_id", "port_id", "t")


@query("g24_route_templates", sql(f""", {CALLED}, a AS (SELECT vessel_id, port_id AS p0, lead(port_id, 1) OVER w AS p1, lead(port_id, 2) OVER w AS p2, lead(port_id, 3) OVER w AS p3 FROM calls WINDOW w AS (PARTITION BY vessel_id ORDER BY t, port_id)) SELECT route, count(DISTINCT vessel_id) AS vessels, count(*) AS n FROM (
  SELECT vessel_id, p0 || '>' || p1 || '>' || p2 AS route FROM a WHERE p2 IS NOT NULL UNION ALL SELECT vessel_id, p0 || '>' || p1 || '>' || p2 || '>' || p3 FROM a WHERE p3 IS NOT NULL) GROUP BY 1 HAVING count(DISTINCT vessel_id) >= 2""", "pos", "ports"))
def g24(spark, d):
    return N.route_windows(calls(spark, d))


@query("g24_next_port", sql(f""", {CALLED}, s AS (SELECT vessel_id, lag(port_id) OVER w || '>' || port_id AS seen, lead(port_id) OVER w AS nxt FROM calls WINDOW w AS (PARTITION BY vessel_id ORDER BY t, port_id)) SELECT vessel_id, (SELECT arg_min(nxt, (-n, nxt)) FROM (SELECT nxt, count(*) AS n FROM s b WHERE b.seen = a.seen AND nxt IS NOT NULL GROUP BY 1)) AS port_id
  FROM s a WHERE nxt IS NULL AND seen IN (SELECT seen FROM s WHERE nxt IS NOT NULL AND seen IS NOT NULL)""", "pos", "ports"))
def g24_next(spark, d):
    return N.next_ports(calls(spark, d))


@query("g24_route_groups")
def g24_groups(spark, d):
    """Templates from all runs of calls, grouped greedily in order."""
    t = R.templates(R.call_runs(calls(spark, d)), vessels(spark, d))
    return t.select("template.*", F.array_join(F.col("route").cast("array<string>"), ">").alias("route"), "frequency", "kind")


@query("g24_foretold_ports")
def g24_foretold(spark, d):
    c = calls(spark, d)
    known = _cut(R.templates(R.call_runs(c), vessels(spark, d)))
    out = R.foretold(c, known, positions(spark, d), corridors(spark))
    return out.select("vessel_id", F.col("template.vessel_id").alias("template_vessel"), "port_id", F.floor(F.col("likeness") * 100).cast("int").alias("percent"), "deviation")


@query("g23_similarity", sql("""SELECT a.vessel_id AS one, b.vessel_id AS two, CAST(floor(100 * (0.5::DOUBLE / (1 + sqrt(pow((a.dwt - b.dwt) / 10000, 2) + pow(CAST(a.year_built - b.year_built AS DOUBLE), 2)) / 10) + 0.5::DOUBLE * (CASE WHEN a.flag = b.flag THEN 0.5::DOUBLE ELSE 0 END + CASE WHEN a.kind = b.kind THEN 0.5::DOUBLE ELSE 0 END)) + 1e-9) AS BIGINT) AS percent FROM vessels a JOIN vessels b ON b.vessel_id = a.vessel_id + 1""", "vessels"))
def g23(spark, d):
    v = vessels(spark, d)
    f = v.select("vessel_id", "flag", "kind", F.array(F.col("dwt") / 10_000, F.col("year_built").cast("double")).alias("v"))
    return N.similarity(f, v.select(F.col("vessel_id").alias("one"), (F.col("vessel_id") + 1).alias("two")), {"flag": 0.5, "kind": 0.5})


@query("g26_prefix_risks", sql(f"""SELECT vessel_id, kind, CASE kind WHEN 'unallocated' THEN 35 WHEN 'landlocked' THEN 20 ELSE 10 END AS points FROM (SELECT vessel_id, CASE WHEN {MID} NOT IN ({', '.join(map(str, sorted(prefixes.numbers(prefixes.ALLOCATED))))}) THEN 'unallocated'
  WHEN {MID} IN ({prefixes.LANDLOCKED.replace(' ', ', ')}) THEN 'landlocked' WHEN {MID} IN ({prefixes.TINY.replace(' ', ', ')}) THEN 'tiny' END AS kind FROM vessels) WHERE kind IS NOT NULL""", "vessels"))
def g26(spark, d):
    return N.prefix_risks(vessels(spark, d), F.lit(200) + F.col("vessel_id") * 37 % 500)


@query("g26_reused_hulls", sql(f"SELECT v.vessel_id, v.imo FROM vessels v JOIN vessels s ON s.imo = v.imo AND s.vessel_id % 9 = 0 JOIN (SELECT vessel_id, max(t) AS last_t FROM pos GROUP BY 1) p ON p.vessel_id = v.vessel_id WHERE last_t > {EPOCH} + s.vessel_id % 40 * 86400", "vessels", "pos"))
def g26_hulls(spark, d):
    v = vessels(spark, d)
    return N.reused_hulls(v, v.filter("vessel_id % 9 = 0").select("imo", (F.lit(EPOCH) + F.col("vessel_id") % 40 * 86_400).alias("t")), positions(spark, d))


@query("g27_transparency", "SELECT s_suppkey AS owner, CASE WHEN s_suppkey % 4 = 1 THEN 15 ELSE 0 END + CASE WHEN s_nationkey IN (3, 7, 11) THEN 20 ELSE 0 END + CASE WHEN 1000 - s_suppkey * 37 % 1000 < 730 THEN 15 ELSE 0 END + CASE WHEN s_suppkey % 3 = 0 THEN 10 ELSE 0 END AS points FROM supplier")
def g27(spark, d):
    k = F.col("s_suppkey")
    owners = read(spark, d, "supplier").select(k.alias("owner"), F.col("s_nationkey").cast("string").alias("jurisdiction"), (k * 37 % 1000).alias("founded"), F.lit(1000).alias("as_of"), (k % 4).alias("ships"), (k % 3).alias("officers"))
    return N.transparency(owners, ("3", "7", "11"))


@query("g12_relay_chains")
def g12(spark, d):
    a = F.col("o_custkey").cast("long")  # transfers between neighbours by id: many small networks
    o = read(spark, d, "orders").select(a.alias("a"), (a - a % 4 + F.col("o_orderkey") % 4).alias("b"), F.unix_timestamp("o_orderdate").alias("t")).filter("a <> b")
    return N.relay_chains(o, graph.components(o.select("a", "b")))


# Fixed shapes: a triangle, a pentagon and a bent strip; zone_id, weight, WKT.
SHAPES = ((1, 1.0, "POLYGON((0 0, 2 0.2, 1 1.7, 0 0))"), (2, 1.5, "POLYGON((2 2, 3.5 2.2, 4 3.1, 2.9 4, 2.1 3, 2 2))"), (3, 1.5, "POLYGON((0.5 1, 3 1, 3 1.4, 1 1.4, 1 3, 0.5 3, 0.5 1))"))


def shapes(spark):
    return spark.createDataFrame(list(SHAPES), "zone_id int, weight double, wkt string").withColumn("ring", P.ring(F.col("wkt"))).drop("wkt")


def corners(wkt: str) -> list[tuple[str, str]]:
    return [tuple(p.split()) for p in wkt[9:-2].split(", ")]


def inside(lat: str, lon: str, wkt: str) -> str:
    c = corners(wkt)
    n = " + ".join(f"CASE WHEN (({a[1]} > {lat}) <> ({b[1]} > {lat})) AND {lon} < {a[0]} + ({lat} - {a[1]}) / nullif({b[1]} - {a[1]}, 0)::DOUBLE * ({b[0]} - {a[0]}) THEN 1 ELSE 0 END" for a, b in zip(c, c[1:]) if a[1] != b[1])
    return f"({n}) % 2 = 1"


@query("f6_points_in_polygons", sql(" UNION ALL ".join(f"SELECT point_id, {i} AS zone_id FROM pos WHERE {inside('lat', 'lon', w)}" for i, _, w in SHAPES), "pos"))
def f6(spark, d):
    return N.points_in_polygons(positions(spark, d).select("point_id", "lat", "lon"), shapes(spark)).select("point_id", "zone_id")


def side(a, b, c) -> str:
    return f"sign(({b[0]} - {a[0]})::DOUBLE * ({c[1]} - {a[1]}) - ({b[1]} - {a[1]})::DOUBLE * ({c[0]} - {a[0]}))"


def met_by(wkt: str) -> str:
    p, q, c = ("lon", "lat"), ("lon2", "lat2"), corners(wkt)
    boxes = lambda a, b, k: f"greatest(least({a[k]}, {b[k]}), least({p[k]}, {q[k]})) <= least(greatest({a[k]}, {b[k]}), greatest({p[k]}, {q[k]}))"
    cross = " OR ".join(f"({side(a, b, p)} * {side(a, b, q)} <= 0 AND {side(p, q, a)} * {side(p, q, b)} <= 0 AND {boxes(a, b, 0)} AND {boxes(a, b, 1)})" for a, b in zip(c, c[1:]))
    return f"({inside('lat', 'lon', wkt)} OR {inside('lat2', 'lon2', wkt)} OR {cross})"


@query("j8_gap_in_polygon", sql("SELECT gap_id, arg_min(zone_id, (-weight, zone_id)) AS zone_id FROM (" + " UNION ALL ".join(f"SELECT gap_id, {i} AS zone_id, {x}::DOUBLE AS weight FROM gaps WHERE {met_by(w)}" for i, x, w in SHAPES) + ") GROUP BY 1", "gaps"))
def j8_polygon(spark, d):
    return N.in_polygons(gap_frame(spark, d).select("gap_id", "lat", "lon", "lat2", "lon2"), shapes(spark), "gap_id")


@query("j10_name_pairs", """WITH n AS (SELECT DISTINCT p_name AS name, list_sort(list_distinct(string_split(p_name, ' '))) AS w, array_to_string(list_sort(string_split(p_name, ' ')), ' ') AS s FROM part) SELECT a.name AS one, b.name AS two FROM n a JOIN n b ON a.name < b.name AND len(list_intersect(a.w, b.w)) > 0 AND levenshtein(a.s, b.s) <= 3""")
def j10_pairs(spark, d):
    return N.sorted_name_pairs(read(spark, d, "part"), "p_name", 3)


@query("a27_drift", """SELECT event_type AS detector, count(*) FILTER (event_id % 3 = 0) AS n_now, count(*) FILTER (event_id % 3 <> 0) AS n_before, abs(count(*) FILTER (event_id % 3 = 0) - count(*) FILTER (event_id % 3 <> 0)) > 0.5 * greatest(1, count(*) FILTER (event_id % 3 <> 0)) AS disable FROM events GROUP BY 1""")
def a27(spark, d):
    e = read(spark, d, "events")
    n = lambda which: e.filter(which).groupBy(F.col("event_type").alias("detector")).agg(F.count("*").alias("n"))
    return N.drift(n("event_id % 3 = 0"), n("event_id % 3 <> 0"), 100, 110)


@query("a29_month_to_date", "SELECT o_orderpriority AS provider, CAST(floor(sum(round(o_totalprice * 100)) / 100) AS BIGINT) AS spent, count(*) AS orders, sum(o_totalprice) / 15 * 30 > 1000000 AS over FROM orders WHERE strftime(o_orderdate, '%Y-%m') = '1996-03' GROUP BY 1")
def a29(spark, d):
    o = read(spark, d, "orders").select(F.col("o_orderpriority").alias("provider"), F.col("o_orderdate").alias("day"), F.col("o_totalprice").alias("cost"))
    return N.month_to_date(o, "1996-03", 1_000_000.0, 15)


@query("k8_due_exports", "SELECT s_suppkey AS subscription_id FROM supplier WHERE s_suppkey % 4 > 0 AND (s_suppkey % 5 = 0 OR 1000000 - s_suppkey * 997 % 1000000 >= CASE WHEN s_suppkey % 2 = 0 THEN 86400 ELSE 604800 END)")
def k8(spark, d):
    k = F.col("s_suppkey")
    return N.due_exports(read(spark, d, "supplier").select(k.alias("subscription_id"), (k % 4 > 0).alias("active"), F.when(k % 5 != 0, k * 997 % 1_000_000).alias("last_run"), F.when(k % 2 == 0, 86_400).otherwise(604_800).alias("period")), 1_000_000)


@query("k15_throttled", sql("""SELECT 'high' AS rule, vessel_id, min(gap_start) AS t FROM alerts a WHERE score >= 51 AND NOT EXISTS (SELECT 1 FROM alerts l WHERE l.gap_id % 7 = 0 AND l.score >= 51 AND l.vessel_id = a.vessel_id AND l.gap_start BETWEEN a.gap_start - 172800 AND a.gap_start) GROUP BY vessel_id, gap_start // 172800""", "alerts"))
def k15_throttled(spark, d):
    hits = notify(alert_frame(spark, d), [("high", 51, None, None)]).select("rule", "vessel_id", F.col("gap_start").alias("t"), "gap_id")
    return N.throttled(hits.drop("gap_id"), hits.filter("gap_id % 7 = 0"), 172_800)


CARD = """'{"gap_id":' || gap_id || ',"vessel":"' || v.name || '","imo":"' || v.imo || '"' || CASE WHEN c.corridor IS NULL THEN '' ELSE ',"corridor":"' || c.corridor || '"' END || ',"gap_start":' || gap_start || ',"duration_minutes":' || duration_minutes || ',"score":' || score || ',"band":"' || band || '","signals":[' || s.list || '],"note":"An automated lead for analysts, not a finding."}'"""


@query("k13_evidence_cards", sql(f""", base AS ({BASE}), s AS (SELECT gap_id, string_agg('{{"signal":"' || signal || '","points":' || points || '}}', ',' ORDER BY signal, points) AS list FROM base GROUP BY 1) SELECT gap_id, {CARD} AS card FROM alerts a JOIN vessels v USING (vessel_id) LEFT JOIN corridors c USING (corridor_id) JOIN s USING (gap_id)""", "alerts", "vessels"))
def k13(spark, d):
    return N.evidence(alert_frame(spark, d), vessels(spark, d), corridors(spark), base_signals(spark, d)[0])


@query("k12_feature_collection", sql("""SELECT '{"type":"FeatureCollection","features":[' || string_agg('{"type":"Feature","properties":{"corridor_id":' || corridor_id || ',"alerts":' || n || '},"geometry":{"type":"Point","coordinates":[' || la || ',' || lo || ']}}', ',' ORDER BY corridor_id) || ']}' AS geojson FROM (
  SELECT corridor_id, count(*) AS n, CAST(floor(min(lon)) AS BIGINT) AS la, CAST(floor(min(lat)) AS BIGINT) AS lo FROM alerts WHERE corridor_id IS NOT NULL GROUP BY 1)""", "alerts"))
def k12(spark, d):
    per = alert_frame(spark, d).filter("corridor_id is not null").groupBy("corridor_id").agg(F.count("*").alias("alerts"), F.floor(F.min("lon")).alias("x"), F.floor(F.min("lat")).alias("y"))
    feature = F.struct(F.lit("Feature").alias("type"), F.struct("corridor_id", "alerts").alias("properties"), F.struct(F.lit("Point").alias("type"), F.array("x", "y").alias("coordinates")).alias("geometry"))
    one = per.agg(F.array_sort(F.collect_list(F.struct("corridor_id", feature.alias("f")))).alias("all"))  # one feature a corridor: configuration
    return one.select(F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), F.transform("all", lambda x: x["f"]).alias("features"))).alias("geojson"))


@query("p7_aliases", sql(f", {ALIAS} SELECT canonical AS vessel_id, id AS alias, v.imo FROM alias JOIN vessels v ON v.vessel_id = id", "vessels"))
def p7(spark, d):
    return alias(spark, d).join(vessels(spark, d).select(F.col("vessel_id").alias("id"), "imo"), "id").select(F.col("canonical").alias("vessel_id"), F.col("id").alias("alias"), "imo")


@query("p9_port_calls", sql(f", {CALLED} SELECT vessel_id, port_id, t FROM calls WHERE t BETWEEN {EPOCH + 5 * 86400} AND {EPOCH + 20 * 86400}", "pos", "ports"))
def p9(spark, d):
    return calls(spark, d).filter(F.col("t").between(EPOCH + 5 * 86_400, EPOCH + 20 * 86_400))


@query("p10_audit_log", sql("SELECT change_id, vessel_id, field, value, t FROM changes WHERE field IN ('name', 'flag') AND old IS NOT NULL AND old <> value", "changes"))
def p10(spark, d):
    return changes(spark, d).filter("field in ('name', 'flag') and old is not null and old <> value").select("change_id", "vessel_id", "field", "value", "t")
