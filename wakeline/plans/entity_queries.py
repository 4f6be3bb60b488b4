"""Identity, ownership, transfers between vessels, ingest checks and fitted detectors."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import Window

from wakeline.functions import geo
from wakeline.functions import vessels as V
from wakeline.operators import entities as E
from wakeline.operators import fitted, folds, graph, sequence
from wakeline.plans.base import alert_frame, gap_frame, query
from wakeline.plans.oracle import sql
from wakeline.sources.adapter import positions, read, transfers, vessels
from wakeline.sources.csv_positions import validate


@query("f11_check_digit", sql("SELECT vessel_id, (CAST(substr(imo, 1, 1) AS INT) * 7 + CAST(substr(imo, 2, 1) AS INT) * 6 + CAST(substr(imo, 3, 1) AS INT) * 5 + CAST(substr(imo, 4, 1) AS INT) * 4 + CAST(substr(imo, 5, 1) AS INT) * 3 + CAST(substr(imo, 6, 1) AS INT) * 2) % 10 = CAST(substr(imo, 7, 1) AS INT) AS valid FROM vessels", "vessels"))
def f11(spark, d):
    return vessels(spark, d).select("vessel_id", V.imo_valid(F.col("imo")).alias("valid"))


@query("g25_one_digit_neighbours", sql("""SELECT a.vessel_id AS vessel_1, b.vessel_id AS vessel_2 FROM (SELECT *, lpad(CAST(vessel_id * 10 AS VARCHAR), 7, '0') AS hull FROM vessels) a JOIN (SELECT *, lpad(CAST(vessel_id * 10 AS VARCHAR), 7, '0') AS hull FROM vessels) b ON a.vessel_id < b.vessel_id AND a.flag = b.flag
  AND len(list_filter(range(1, 8), lambda i: substr(a.hull, i, 1) <> substr(b.hull, i, 1))) = 1""", "vessels"))
def g25(spark, d):
    return E.one_digit_pairs(vessels(spark, d).withColumn("hull", F.lpad((F.col("vessel_id") * 10).cast("string"), 7, "0")), "hull", "flag")


@query("f14_owner_key", "SELECT s_suppkey AS owner_id, trim(regexp_replace(regexp_replace(regexp_replace(upper(trim(s_name)), '[^A-Z0-9 ]', ' ', 'g'), '\\b(?:LTD|LIMITED|LLC|INC|CORP|CORPORATION|CO|COMPANY|SA|GMBH|PLC|PTE|BV|AS|SHIPPING)\\b', ' ', 'g'), ' +', ' ', 'g')) AS key FROM supplier")
def f14(spark, d):
    return read(spark, d, "supplier").select(F.col("s_suppkey").alias("owner_id"), V.owner_key(F.col("s_name")).alias("key"))


@query("f16_jaccard", "SELECT a.p_partkey AS one, b.p_partkey AS two, CAST(floor(1000.0::DOUBLE * len(list_intersect(string_split(a.p_name, ' '), string_split(b.p_name, ' '))) / len(list_distinct(list_concat(string_split(a.p_name, ' '), string_split(b.p_name, ' '))))) AS BIGINT) AS permille FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_size = b.p_size AND a.p_partkey < b.p_partkey")
def f16(spark, d):
    p = read(spark, d, "part").select("p_brand", "p_size", "p_partkey", "p_name")
    both = E.dealt_pairs(p, ["p_brand", "p_size"], "p_partkey", "p_name")
    return E.word_similarity(both, p, "p_name").select("one", "two", F.floor(1000.0 * F.col("share")).alias("permille"))


@query("f17_length_from_tonnage", sql("SELECT vessel_id, CAST(floor(5 * pow(dwt, 0.325)) AS BIGINT) AS metres FROM vessels WHERE dwt > 0", "vessels"))
def f17(spark, d):
    return vessels(spark, d).filter("dwt > 0").select("vessel_id", F.floor(V.length_from_dwt(F.col("dwt"))).alias("metres"))


@query("f4_wkt_bbox", "SELECT n_nationkey AS id, CAST(n_nationkey AS DOUBLE) AS min_lon, CAST(n_regionkey AS DOUBLE) AS min_lat, CAST(n_nationkey + 2 AS DOUBLE) AS max_lon, CAST(n_regionkey + 3 AS DOUBLE) AS max_lat FROM nation")
def f4(spark, d):
    n = read(spark, d, "nation")
    wkt = F.format_string("POLYGON((%d %d, %d %d, %d %d, %d %d))", "n_nationkey", "n_regionkey", F.col("n_nationkey") + 2, "n_regionkey", F.col("n_nationkey") + 2, F.col("n_regionkey") + 3, "n_nationkey", "n_regionkey")
    return n.select(F.col("n_nationkey").alias("id"), geo.wkt_bbox(wkt).alias("b")).select("id", "b.*")


@query("f9_position_at", sql("SELECT gap_id, CAST(floor((lat + (lat2 - lat) * 0.5) * 1000 + 0.5) AS BIGINT) AS lat_milli, CAST(floor((lon + (lon2 - lon) * 0.5) * 1000 + 0.5) AS BIGINT) AS lon_milli FROM gaps", "gaps"))
def f9(spark, d):
    g = gap_frame(spark, d)
    lat, lon = geo.position_at("lat", "lon", "gap_start", "lat2", "lon2", "gap_end", (F.col("gap_start") + F.col("gap_end")) / 2)
    return g.select("gap_id", F.floor(lat * 1000 + 0.5).alias("lat_milli"), F.floor(lon * 1000 + 0.5).alias("lon_milli"))


@query("f22_hash_keys", sql("SELECT gap_id, sha256(vessel_id || ':' || gap_start) AS key FROM gaps", "gaps"))
def f22(spark, d):
    return gap_frame(spark, d).select("gap_id", F.sha2(F.concat_ws(":", "vessel_id", "gap_start"), 256).alias("key"))


@query("f20_json_access", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events")
def f20(spark, d):
    return read(spark, d, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k"))


@query("f23_time_labels", "SELECT strftime(ts, '%Y-%m') AS month, CAST(hour(ts) // 4 AS INT) AS watch, CAST(dayofweek(ts) AS INT) AS weekday, count(*) AS n FROM events GROUP BY 1, 2, 3")
def f23(spark, d):
    ts = F.col("ts")
    return read(spark, d, "events").groupBy(F.date_format(ts, "yyyy-MM").alias("month"), F.floor(F.hour(ts) / 4).cast("int").alias("watch"), (F.dayofweek(ts) - 1).alias("weekday")).agg(F.count("*").alias("n"))


@query("f18_recency", sql("SELECT gap_id, CASE WHEN d <= 7 THEN 20 WHEN d <= 30 THEN 15 WHEN d <= 90 THEN 10 ELSE 8 END AS tenths FROM (SELECT gap_id, 19760 - gap_start // 86400 AS d FROM gaps)", "gaps"))
def f18(spark, d):
    return gap_frame(spark, d).select("gap_id", (V.recency_factor(19_760 - F.floor(F.col("gap_start") / 86400)) * 10).cast("int").alias("tenths"))


@query("f21_text_templates", sql("SELECT gap_id, 'Vessel ' || name || ' was silent for ' || duration_minutes || ' minutes (' || band || ')' AS sentence FROM alerts WHERE score >= 51", "alerts"))
def f21(spark, d):
    return alert_frame(spark, d).filter("score >= 51").select("gap_id", F.format_string("Vessel %s was silent for %d minutes (%s)", "name", "duration_minutes", "band").alias("sentence"))


EDGES = "edges AS (SELECT DISTINCT o_custkey AS a, 1000000000 + l_suppkey AS b FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderdate >= TIMESTAMP '2000-01-01' AND l_quantity >= 49)"


def edges(spark, d):
    o = read(spark, d, "orders").filter("o_orderdate >= timestamp'2000-01-01 00:00:00'").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("a"))
    line = read(spark, d, "lineitem").filter("l_quantity >= 49").select("l_orderkey", (F.col("l_suppkey") + 1_000_000_000).alias("b"))
    return o.join(line, "l_orderkey").select("a", "b").distinct()


@query("g5_components", f"WITH RECURSIVE {EDGES}, two AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges), walk(node, root) AS (SELECT a, a FROM two UNION SELECT w.node, t.b FROM walk w JOIN two t ON w.root = t.a) SELECT component, count(*) AS n FROM (SELECT node, min(root) AS component FROM walk GROUP BY 1) GROUP BY 1")
def g5(spark, d):
    return graph.components(edges(spark, d)).groupBy("component").agg(F.count("*").alias("n"))


@query("g10_bounded_spread", f"""WITH {EDGES}, two AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges), s0 AS (SELECT DISTINCT a AS node, 0 AS hops FROM two WHERE a % 97 = 5), s1 AS (SELECT DISTINCT b AS node, 1 AS hops FROM two JOIN s0 ON a = node WHERE b NOT IN (SELECT node FROM s0)),
  s2 AS (SELECT DISTINCT b AS node, 2 AS hops FROM two JOIN s1 ON a = node WHERE b NOT IN (SELECT node FROM s0) AND b NOT IN (SELECT node FROM s1)), r AS (SELECT * FROM s0 UNION ALL SELECT * FROM s1 UNION ALL SELECT * FROM s2)
  SELECT node, hops, CASE hops WHEN 0 THEN 50 WHEN 1 THEN 40 ELSE 25 END AS points FROM r""")
def g10(spark, d):
    e = edges(spark, d)
    two = e.union(e.select("b", "a")).toDF("a", "b").distinct()
    found = graph.reach(two, two.filter("a % 97 = 5").select(F.col("a").alias("node")), 2)
    return found.select("node", "hops", F.when(F.col("hops") == 0, 50).when(F.col("hops") == 1, 40).otherwise(25).alias("points"))


LINKS = "links AS (SELECT c_custkey AS id, c_custkey - c_custkey % 7 AS merged_into FROM customer WHERE c_custkey % 7 <> 0 UNION ALL SELECT c_custkey, c_custkey - c_custkey % 49 FROM customer WHERE c_custkey % 7 = 0 AND c_custkey % 49 <> 0)"


def links(spark, d):
    c = read(spark, d, "customer").select(F.col("c_custkey").alias("id"))
    return c.filter("id % 49 <> 0").select("id", F.when(F.col("id") % 7 != 0, F.col("id") - F.col("id") % 7).otherwise(F.col("id") - F.col("id") % 49).alias("merged_into"))


@query("g4_canonical_id", "SELECT c_custkey AS id, c_custkey - c_custkey % 49 AS canonical FROM customer WHERE c_custkey % 49 <> 0")
def g4(spark, d):
    return graph.canonical(links(spark, d))


@query("g8_parent_chains", f"WITH RECURSIVE {LINKS}, up(root, node, hops) AS (SELECT id, merged_into, 1 FROM links UNION ALL SELECT root, merged_into, hops + 1 FROM up JOIN links ON node = id WHERE hops < 10) SELECT root, max(hops) AS depth, max(hops) > 1 AS shell FROM up GROUP BY 1")
def g8(spark, d):
    parents = links(spark, d).select(F.col("id").alias("child"), F.col("merged_into").alias("parent"))
    return graph.chains(parents, 10).groupBy("root").agg(F.max("hops").alias("depth"), (F.max("hops") > 1).alias("shell"))


@query("g3_alias_rekey", sql("SELECT coalesce(l.canonical, g.vessel_id) AS vessel_id, count(*) AS gaps FROM gaps g LEFT JOIN (SELECT c_custkey AS id, c_custkey - c_custkey % 49 AS canonical FROM customer WHERE c_custkey % 49 <> 0) l ON g.vessel_id = l.id GROUP BY 1", "gaps"))
def g3(spark, d):
    alias = graph.canonical(links(spark, d))
    g = gap_frame(spark, d).select("vessel_id")
    return g.join(alias, g.vessel_id == alias.id, "left").groupBy(F.coalesce("canonical", "vessel_id").alias("vessel_id")).agg(F.count("*").alias("gaps"))


@query("g2_dark_and_new", sql("SELECT vessel_id, max(t) < (SELECT max(t) FROM pos) - 7200 AS dark, min(t) >= (SELECT max(t) FROM pos) - 27 * 86400 AS is_new FROM pos GROUP BY 1", "pos"))
def g2(spark, d):
    p = positions(spark, d)
    return E.dark_and_new(p, 7200, 27 * 86400)


@query("j11_merge_candidates", sql("""SELECT a.vessel_id AS dark_id, b.vessel_id AS new_id, b.t0 - a.t1 AS wait_s FROM (SELECT vessel_id, max(t) AS t1 FROM pos GROUP BY 1) a JOIN (SELECT vessel_id, min(t) AS t0 FROM pos GROUP BY 1) b ON a.vessel_id <> b.vessel_id AND b.t0 > a.t1 - 29 * 86400 AND b.t0 - a.t1 <= -22 * 86400""", "pos"))
def j11(spark, d):
    p = positions(spark, d)
    return E.succession(p, -29 * 86400, -22 * 86400)


@query("j12_overlap_test", sql("SELECT DISTINCT a.vessel_id AS one, b.vessel_id AS two FROM pos a JOIN pos b ON a.t // 3600 = b.t // 3600 AND a.vessel_id + 1 = b.vessel_id", "pos"))
def j12(spark, d):
    h = positions(spark, d).select("vessel_id", F.floor(F.col("t") / 3600).alias("hour")).distinct()
    nxt = h.select((F.col("vessel_id") - 1).alias("vessel_id"), "hour")
    return h.join(nxt, ["vessel_id", "hour"]).select(F.col("vessel_id").alias("one"), (F.col("vessel_id") + 1).alias("two")).distinct()


@query("j14_partner_roles", "SELECT id, count(*) AS transfers, count(DISTINCT partner) AS partners FROM (SELECT o_custkey AS id, 1000000000 + l_suppkey AS partner FROM orders JOIN lineitem ON o_orderkey = l_orderkey UNION ALL SELECT 1000000000 + l_suppkey, o_custkey FROM orders JOIN lineitem ON o_orderkey = l_orderkey) GROUP BY 1")
def j14(spark, d):
    t = transfers(spark, d).withColumn("v2", F.col("vessel_2") + 1_000_000_000)
    roles = t.select(F.explode(F.array(F.struct(F.col("vessel_1").alias("id"), F.col("v2").alias("partner")), F.struct(F.col("v2").alias("id"), F.col("vessel_1").alias("partner")))).alias("r")).select("r.*")
    return roles.groupBy("id").agg(F.count("*").alias("transfers"), F.countDistinct("partner").alias("partners"))


@query("j9_identity_cascade", sql("""SELECT s_suppkey AS listed, coalesce(a.vessel_id, b.vessel_id) AS vessel_id, CASE WHEN a.vessel_id IS NOT NULL THEN 'id' WHEN b.vessel_id IS NOT NULL THEN 'name' END AS how FROM (SELECT s_suppkey, s_suppkey * 20 AS id, replace(s_name, 'Supplier', 'Customer') AS name FROM supplier) s
  LEFT JOIN vessels a ON a.vessel_id = s.id LEFT JOIN vessels b ON b.name = s.name""", "vessels"))
def j9(spark, d):
    listed = read(spark, d, "supplier").select(F.col("s_suppkey").alias("listed"), (F.col("s_suppkey") * 20).alias("id"), F.replace(F.col("s_name"), F.lit("Supplier"), F.lit("Customer")).alias("name"))
    return E.cascade(listed, vessels(spark, d))


@query("j2_semi_anti", sql("SELECT vessel_id FROM vessels v WHERE EXISTS (SELECT 1 FROM gaps g WHERE g.vessel_id = v.vessel_id) AND NOT EXISTS (SELECT 1 FROM pos p WHERE p.vessel_id = v.vessel_id AND p.nav_status = 15 AND p.sog > 12)", "gaps"))
def j2(spark, d):
    odd = positions(spark, d).filter("nav_status = 15 and sog > 12").select("vessel_id")
    return vessels(spark, d).select("vessel_id").join(gap_frame(spark, d).select("vessel_id"), "vessel_id", "left_semi").join(odd, "vessel_id", "left_anti")


@query("j10_name_blocks", "SELECT block, count(*) AS n FROM (SELECT list_min(string_split(p_name, ' ')) AS block FROM part) GROUP BY 1")
def j10(spark, d):
    return read(spark, d, "part").groupBy(F.array_min(F.split("p_name", " ")).alias("block")).agg(F.count("*").alias("n"))


@query("f15_token_sort_matches")
def f15(spark, d):
    names = read(spark, d, "part").select(F.col("p_name").alias("name")).distinct()
    return E.fuzzy_pairs(names, "name", 85.0)


@query("g9_cluster_flags", "SELECT c_custkey AS id, max(CASE WHEN c_custkey % 50 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY c_nationkey, c_mktsegment) AS flagged FROM customer")
def g9(spark, d):
    w = Window.partitionBy("c_nationkey", "c_mktsegment")
    return read(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.max(F.when(F.col("c_custkey") % 50 == 0, 1).otherwise(0)).over(w).alias("flagged"))


@query("g13_fleet_patterns", sql("SELECT flag, kind, count(DISTINCT a.vessel_id) AS vessels, CAST(floor(avg(score)) AS BIGINT) AS mean, count(DISTINCT corridor_id) AS corridors FROM alerts a GROUP BY 1, 2 HAVING count(DISTINCT a.vessel_id) >= 2", "alerts"))
def g13(spark, d):
    return alert_frame(spark, d).groupBy("flag", "kind").agg(F.countDistinct("vessel_id").alias("vessels"), F.floor(F.avg("score")).alias("mean"), F.countDistinct("corridor_id").alias("corridors")).filter("vessels >= 2")


@query("g14_manager_continuity", "SELECT l_suppkey AS manager, count(DISTINCT o_custkey) AS owners FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1 HAVING count(DISTINCT o_custkey) >= 3")
def g14(spark, d):
    return transfers(spark, d).groupBy(F.col("vessel_2").alias("manager")).agg(F.countDistinct("vessel_1").alias("owners")).filter("owners >= 3")


@query("g17_hotspot_trend", "SELECT o_custkey % 20 AS cell, count(*) AS n, CASE WHEN regr_slope(n, m) > 0 THEN 'up' ELSE 'down' END AS trend FROM (SELECT o_custkey % 20 AS o_custkey, datediff('month', DATE '1992-01-01', CAST(o_orderdate AS DATE)) AS m, count(*) AS n FROM orders GROUP BY 1, 2) GROUP BY 1")
def g17(spark, d):
    month = (F.year("o_orderdate") - 1992) * 12 + F.month("o_orderdate") - 1
    per = read(spark, d, "orders").groupBy((F.col("o_custkey") % 20).alias("cell"), month.alias("m")).agg(F.count("*").alias("n"))
    return per.groupBy("cell").agg(F.count("*").alias("k"), F.regr_slope("n", "m").alias("s")).select("cell", F.col("k").alias("n"), F.when(F.col("s") > 0, "up").otherwise("down").alias("trend"))


@query("g20_pca_anomaly")
def g20(spark, d):
    return fitted.pca_errors(fitted.vessel_features(positions(spark, d))).select("vessel_id", F.floor(F.col("error") * 1000).alias("error_milli"))


@query("g19_isolation_forest")
def g19(spark, d):
    return fitted.isolation_scores(fitted.vessel_features(positions(spark, d))).select("vessel_id", F.floor(F.col("score") * 1000).alias("score_milli"))


@query("g15_dbscan_zones")
def g15(spark, d):
    return fitted.dbscan(gap_frame(spark, d).filter("impossible").select(F.col("gap_id").alias("id"), "lat", "lon"), 3.0, 3)


@query("w13_erratic_status")
def w13(spark, d):
    return folds.erratic_status(positions(spark, d), 172_800, 3)


@query("w16_laid_up")
def w16(spark, d):
    return folds.laid_up(positions(spark, d), 1.0, 2)


@query("w28_track_naturalness")
def w28(spark, d):
    return folds.residuals(positions(spark, d), 0.3)


@query("w29_track_replay", sql("SELECT vessel_id, count(*) AS hours FROM (SELECT vessel_id, t // 3600 % 24 AS h FROM pos GROUP BY 1, 2 HAVING count(*) FILTER (t >= (SELECT max(t) FROM pos) - 604800) > 0 AND count(*) FILTER (t < (SELECT max(t) FROM pos) - 604800) > 0) GROUP BY 1 HAVING count(*) >= 6", "pos"))
def w29(spark, d):
    p = positions(spark, d)
    newest = p.agg(F.max("t").alias("newest"))
    p = p.crossJoin(F.broadcast(newest)).withColumn("late", F.col("t") >= F.col("newest") - 604_800)  # one row
    both = p.groupBy("vessel_id", (F.floor(F.col("t") / 3600) % 24).alias("h")).agg(F.count_if("late").alias("a"), F.count_if(~F.col("late")).alias("b")).filter("a > 0 and b > 0")
    return both.groupBy("vessel_id").agg(F.count("*").alias("hours")).filter("hours >= 6")


@query("w35_type_vs_size", sql("SELECT vessel_id, 25 AS score FROM vessels WHERE kind IN ('HOUSEHOLD', 'FURNITURE') AND dwt > 150000", "vessels"))
def w35(spark, d):
    return vessels(spark, d).filter("kind in ('HOUSEHOLD', 'FURNITURE') and dwt > 150000").select("vessel_id", F.lit(25).alias("score"))


@query("w37_confidence_class", sql("SELECT vessel_id, CASE WHEN max(score) >= 76 AND count(*) >= 5 THEN 'CONFIRMED' WHEN max(score) >= 76 THEN 'HIGH' WHEN max(score) >= 51 THEN 'MEDIUM' ELSE 'LOW' END AS class, arg_max(gap_id, (score, gap_id)) AS best FROM alerts GROUP BY 1", "alerts"))
def w37(spark, d):
    a = alert_frame(spark, d).groupBy("vessel_id").agg(F.max("score").alias("s"), F.count("*").alias("n"), F.max_by("gap_id", F.struct("score", "gap_id")).alias("best"))
    label = F.when((F.col("s") >= 76) & (F.col("n") >= 5), "CONFIRMED").when(F.col("s") >= 76, "HIGH").when(F.col("s") >= 51, "MEDIUM").otherwise("LOW")
    return a.select("vessel_id", label.alias("class"), "best")


@query("w33_port_sequences", sql("SELECT vessel_id, string_agg(CAST(nav_status AS VARCHAR), '>' ORDER BY t, point_id) AS route FROM (SELECT *, lag(nav_status) OVER (PARTITION BY vessel_id ORDER BY t, point_id) AS old FROM pos) WHERE old IS DISTINCT FROM nav_status GROUP BY 1", "pos"))
def w33(spark, d):
    p = positions(spark, d).withColumn("old", F.lag("nav_status").over(sequence.by_vessel())).filter(~F.col("old").eqNullSafe(F.col("nav_status")))
    return p.groupBy("vessel_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("t", "point_id", "nav_status"))), lambda s: s["nav_status"].cast("string")), ">").alias("route"))


@query("h6_budget_queue", sql("SELECT gap_id, CAST(spent AS BIGINT) AS spent FROM (SELECT gap_id, sum(duration_minutes) OVER (PARTITION BY vessel_id ORDER BY score DESC, gap_id ROWS UNBOUNDED PRECEDING) AS spent FROM alerts) WHERE spent <= 3000", "alerts"))
def h6(spark, d):
    w = Window.partitionBy("vessel_id").orderBy(F.desc("score"), "gap_id").rowsBetween(Window.unboundedPreceding, 0)
    return alert_frame(spark, d).select("gap_id", F.sum("duration_minutes").over(w).alias("spent")).filter("spent <= 3000")


@query("s3_row_validation", sql("SELECT reason, count(*) AS n FROM (SELECT CASE WHEN lat * 40 NOT BETWEEN -90 AND 90 THEN 'position' WHEN sog * 4 > 35 AND sog * 4 < 102.2 THEN 'speed' ELSE 'ok' END AS reason FROM pos) GROUP BY 1", "pos"))
def s3(spark, d):
    raw = positions(spark, d).select(F.lpad(F.col("vessel_id").cast("string"), 9, "2").alias("mmsi"), F.from_unixtime("t", "yyyy-MM-dd HH:mm:ss").alias("timestamp"), (F.col("lat") * 40).cast("string").alias("lat"), F.col("lon").cast("string").alias("lon"), (F.col("sog") * 4).cast("string").alias("sog"))
    checked = validate(raw)
    return checked.groupBy(F.coalesce("reject", F.lit("ok")).alias("reason")).agg(F.count("*").alias("n"))
