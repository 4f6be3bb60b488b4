"""What keeps memory, shuffles and time in bounds as tables grow, each against plain loops."""

import math
import random

import duckdb
import pyspark.sql.functions as F
import pytest

from wakeline.operators import clusters, encounters, entities, fitted, identity, networks, pairs, satellite, sequence, signals, spread
from wakeline.plans import network_queries
from wakeline.plans.oracle import distance
from wakeline.plans.catalog import ORACLES
from wakeline.plans import score_queries  # isort: skip; after all others
from wakeline.sources import adapter


@pytest.fixture
def fixed_plans(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.enabled", "true")


def miles(p, q):
    (a, b), (c, d) = (map(math.radians, x) for x in (p, q))
    x = math.sin((c - a) / 2) ** 2 + math.cos(a) * math.cos(c) * math.sin((d - b) / 2) ** 2
    return 2 * 3440.065 * math.atan2(math.sqrt(x), math.sqrt(1 - x))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def written(monkeypatch):
    """How many rows each table has that clusters and spread write on their way."""
    sizes, cut = [], clusters._cut

    def counted(df):
        out = cut(df)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(clusters, "_cut", counted)
    monkeypatch.setattr(spread, "_cut", counted)
    return sizes


def test_exploded_rows_are_not_sent_through_the_driver(spark, fixed_plans):
    p = spark.range(3).selectExpr("id as vessel_id", "id as point_id", "id as t", "0.0d as lat", "0.0d as lon", "1.0d as sog", "2.0d as cog")  # of a known size
    side = lambda k: p.select(F.col("vessel_id").alias(f"v_{k}"), *(F.col(c).alias(f"{c}_{k}") for c in ("t", "lat", "lon")))
    spans = lambda k: p.select("vessel_id", F.col("t").alias(f"start_{k}"), F.col("t").alias(f"end_{k}"))
    for df in (pairs.near_in_space_and_time(side(1), side(2), 10.0, 60), pairs.meetings(p, 60, 10.0, 60), pairs.overlapping(spans(1), spans(2), ["vessel_id"])):
        assert "Broadcast" not in plan(df)


def test_successions_of_one_bucket_are_dealt_over_tasks(spark, fixed_plans):
    rng = random.Random(3)
    rows = [(v, rng.randrange(0, 50) + 1_000 * e) for v in range(40) for e in (0, 1)]
    found = entities.succession(spark.createDataFrame(rows, "vessel_id long, t long"), -1_010, -970)
    t0, t1 = {v: t for v, t in rows if t < 500}, {v: t for v, t in rows if t > 500}
    want = sorted((a, b, t0[b] - t1[a]) for a in t1 for b in t0 if a != b and -1_010 < t0[b] - t1[a] <= -970)
    assert sorted(map(tuple, found.collect())) == want
    assert found.select(F.spark_partition_id()).distinct().count() > 1


def test_fleets_in_one_place_without_a_window_of_all(spark, fixed_plans):
    rng = random.Random(8)
    gaps = [(v, rng.choice([None, 1, 2]), rng.randrange(0, 60) * 86_400, 1.0 + v % 2 * 20, 1.0, "A") for v in range(40) for _ in range(rng.randrange(1, 4))]
    fleets = [(v, v % 12) for v in range(40)]
    found = networks.fleet_patterns(spark.createDataFrame(gaps, "vessel_id long, corridor_id int, gap_start long, lat double, lon double, flag string"), spark.createDataFrame(fleets, "vessel_id long, fleet long"), days=4, hours=72)
    near = lambda a, same, s: len({b[0] for b in gaps if b[0] % 12 == a[0] % 12 and same(b) == same(a) and 0 <= a[2] - b[2] <= s}) >= 3
    want = {(a[0] % 12, "same_corridor") for a in gaps if near(a, lambda g: g[1], 4 * 86_400)} | {(a[0] % 12, "same_place") for a in gaps if near(a, lambda g: int(g[3] / 5), 72 * 3_600)}
    assert {tuple(r) for r in found.collect()} == want and 0 < len(want) < 24
    assert "Window" not in plan(found)


@pytest.mark.parametrize("hours", [1, 3])
def test_related_alerts_without_all_pairs_of_a_corridor(spark, hours):
    rng = random.Random(hours)
    rows = [(i, rng.randrange(60), rng.choice([None, 1, 2]), rng.randrange(0, 60_000) + i % 3 * 700_000) for i in rng.sample(range(5_000), 900)]
    rows += [(6_000 + i, 100 + i, 1, 30_000) for i in range(60)] + [(5_500 - i, 200 + i, 2, 30_000 + i) for i in range(80)]
    got = signals.related(spark.createDataFrame(rows, "gap_id long, vessel_id long, corridor_id int, gap_start long"), hours=hours, most=8)
    want = []
    for a in rows:
        pairs_of = []
        for b in rows:
            ship = a[1] == b[1] and abs(a[3] - b[3]) <= 7 * 86_400
            lane = a[2] is not None and a[2] == b[2] and abs(a[3] - b[3]) <= hours * 3_600
            if a[0] != b[0] and (ship or lane):
                pairs_of.append((-(100 if ship and lane else 80 if ship else 60), b[0]))
        want += [(a[0], o, -w) for w, o in sorted(pairs_of)[:8]]
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert signals.first_of_slots(spark.createDataFrame(rows, "gap_id long, vessel_id long, corridor_id int, gap_start long").filter("corridor_id = 1 and gap_id >= 6000"), hours * 3_600, hours * 600, 16).agg(F.max(F.size("first"))).first()[0] == 16


@pytest.mark.parametrize("most", [2, 300])
def test_pairs_of_a_block_are_dealt_and_names_compared_once(spark, fixed_plans, most):
    rng = random.Random(most)
    rows = [(i, i % 2, rng.choice(["red ring", "red bolt", "blue ring", "ring red"])) for i in range(60)]
    p = spark.createDataFrame(rows, "id long, block long, name string")
    both = entities.dealt_pairs(p, ["block"], "id", "name")
    got = entities.word_similarity(both, p, "name", most)
    share = lambda a, b: len(set(a.split()) & set(b.split())) / len(set(a.split()) | set(b.split()))
    want = sorted((a, b, share(m, n)) for a, k, m in rows for b, q, n in rows if k == q and a < b)
    assert sorted((r.one, r.two, r.share) for r in got.collect()) == want
    assert both.select(F.spark_partition_id()).distinct().count() > 2


def test_points_on_edges_of_polygons_are_told_as_by_the_sql(spark):
    """Every hundredth of a degree, many of them on edges."""
    grid = spark.range(401 * 401).selectExpr("id as gap_id", "(id % 401)::double / 100 as lat", "floor(id / 401)::double / 100 as lon", "(id * 7 % 401)::double / 100 as lat2", "(id * 13 % 401)::double / 100 as lon2")
    got = networks.in_polygons(grid, network_queries.shapes(spark), "gap_id").toPandas()
    con = duckdb.connect()
    con.execute("CREATE TABLE gaps AS SELECT i AS gap_id, (i % 401)::DOUBLE / 100 AS lat, (i // 401)::DOUBLE / 100 AS lon, (i * 7 % 401)::DOUBLE / 100 AS lat2, (i * 13 % 401)::DOUBLE / 100 AS lon2 FROM range(401 * 401) r(i)")
    body = ORACLES["j8_gap_in_polygon"]
    want = con.execute(body[body.rindex("SELECT gap_id, arg_min") :]).fetchall()
    assert sorted(zip(got.gap_id, got.zone_id)) == sorted(want)


def test_pairs_are_not_shuffled_again(spark, fixed_plans):
    """Circles are counted where they met, lights need no distinct; each as by plain loops."""
    rng = random.Random(6)
    at = lambda: (rng.randrange(0, 20_000), rng.uniform(0, 1), rng.uniform(0, 1))
    near = lambda p, q, nm, s: abs(p[0] - q[0]) <= s and miles(p[1:], q[1:]) <= nm
    circles = [(i, i % 9, *at()) for i in range(120)]
    met = satellite.coherent_circles(spark.createDataFrame(circles, "point_id long, vessel_id long, t long, lat double, lon double"), 12.0, 3_600)
    want = [(a[0], len({b[1] for b in circles if a[1] != b[1] and near(a[2:], b[2:], 12.0, 3_600)})) for a in circles]
    assert sorted(map(tuple, met.collect())) == sorted(x for x in want if x[1] >= 2)
    assert plan(met).count("Exchange hashpartitioning") == 2  # the two sides of the join
    gaps = [(i, *a, *b) for i in range(80) for a, b in [(at(), at())]]
    lights = [(i, *at(), 1) for i in range(200)]
    flares = spark.createDataFrame([(50.0, 50.0)], "lat double, lon double")
    g = spark.createDataFrame(gaps, "gap_id long, gap_start long, lat double, lon double, gap_end long, lat2 double, lon2 double")
    found = satellite.lights_of_gaps(g, spark.createDataFrame(lights, "light_id long, t long, lat double, lon double, quality int"), flares, 20.0, 2)
    want = {(a[0], b[0]) for a in gaps for b in lights if near(a[1:4], b[1:4], 20.0, 7_200) or near(a[4:], b[1:4], 20.0, 7_200)}
    both = [(a[0], b[0]) for a in gaps for b in lights if near(a[1:4], b[1:4], 20.0, 7_200) and near(a[4:], b[1:4], 20.0, 7_200)]
    assert sorted(map(tuple, found.collect())) == sorted(want) and both
    assert "HashAggregate(keys=[gap_id" not in plan(found)


def test_crowded_hours_spare_pairs_of_gaps(spark):
    rng = random.Random(11)
    rows = []
    for i in range(300):
        start = rng.randrange(0, 400_000) if i % 3 else rng.randrange(0, 30_000)
        rows.append((i, i % 40, start, start + rng.randrange(7_200, 20_000), 5 + i % 2, "dark_zone"))
    z = spark.createDataFrame(rows, "gap_id long, vessel_id long, gap_start long, gap_end long, corridor_id int, corridor_kind string")
    others = lambda a: len({b[1] for b in rows if b[4] == a[4] and b[1] != a[1] and b[2] <= a[3] and a[2] <= b[3]})
    want = sorted(a[0] for a in rows if others(a) <= 2)
    found = signals.selective_darkness(z)
    assert sorted(r.gap_id for r in found.collect()) == want and 0 < len(want) < 300
    assert "/graph/" in plan(found)  # only the gaps left over are compared


@pytest.mark.parametrize("copies", [1, 20])
def test_points_in_one_place_are_paired_once(spark, written, copies):
    """Copies of a point are cores by their number; the pairs written do not grow with them."""
    rng = random.Random(9)
    places = [(rng.uniform(0, 1), rng.uniform(0, 1)) for _ in range(60)]
    rows = {i + 60 * k: (*p, 0.0, 1.0) for i, p in enumerate(places) for k in range(copies)}
    near = lambda a, b: miles(a[:2], b[:2]) <= 4.0
    frame = spark.createDataFrame([(i, *r) for i, r in rows.items()], "id long, lat double, lon double, bearing double, straightness double")
    weight = {i: copies * sum(near(p, q) for q in places) for i, p in enumerate(places)}
    for got in (fitted.dbscan(frame, 4.0, 3), clusters.segment_clusters(frame, 4.0)):
        label = {i: i for i, n in weight.items() if n >= 3}
        for _ in places:
            label = {i: min(label[j] for j in label if near(places[i], places[j])) for i in label}
        want = {i: label.get(i, min((label[j] for j in label if near(places[i], places[j])), default=None)) for i in weight}
        assert {r.id: r.cluster for r in got.collect()} == {i: want[i % 60] for i in rows}
    assert max(written) <= 600


def test_greedy_clusters_pair_points_of_one_place_once(spark, written):
    rng = random.Random(12)
    spots = [(rng.randrange(0, 9_000), rng.uniform(0, 1), rng.uniform(0, 1)) for _ in range(40)]
    points = {i: s for i, s in enumerate(rng.sample([s for k, s in enumerate(spots) for _ in range(1 + 15 * (k % 4))], 940))}
    left, want = {i: {j for j in points if j != i and abs(points[i][0] - points[j][0]) <= 3_600 and miles(points[i][1:], points[j][1:]) <= 9.0} for i in points}, {}
    while left:
        n, i = max((len(v), -k) for k, v in left.items())
        if n < 2:
            break
        gone = left[-i] | {-i}
        want |= dict.fromkeys(gone, -i)
        left = {k: v - gone for k, v in left.items() if k not in gone}
    got = spread.greedy_groups(spark.createDataFrame([(i, *p) for i, p in points.items()], "id long, t long, lat double, lon double"), 9.0, 3_600)
    assert {r.id: r.cluster for r in got.collect()} == want and len(set(want.values())) > 3
    assert max(n for n in written) <= 940  # not the square of what lies in one place


def test_dark_pairs_are_told_where_they_meet(spark, fixed_plans):
    rng = random.Random(4)
    ends = lambda: (rng.uniform(0, 3), rng.uniform(0, 3), rng.uniform(0, 3), rng.uniform(0, 3))
    kinds = [(s, s + rng.randrange(10_000, 300_000), *ends()) for s in (rng.randrange(0, 200_000) for _ in range(40))]
    gaps = [(i, i * 7 % 23, *kinds[i % 40]) for i in range(120)]
    zones = [(1, 0.0, 1.5, 0.0, 3.0), (2, 1.0, 2.0, 1.0, 2.5)]
    frame = spark.createDataFrame(gaps, "gap_id long, vessel_id long, gap_start long, gap_end long, lat double, lon double, lat2 double, lon2 double")
    found = encounters.dark_pairs(frame, spark.createDataFrame(zones, "corridor_id int, min_lat double, max_lat double, min_lon double, max_lon double"), spark.createDataFrame([(v,) for v in range(0, 23, 2)], "vessel_id long"))
    of = lambda g: {z[0] for z in zones for la, lo in (g[4:6], g[6:8]) if z[1] <= la <= z[2] and z[3] <= lo <= z[4]}
    want = {}
    for a in gaps:
        for b in gaps:
            both, nm = of(a) & of(b), min(miles(p, q) for p in (a[4:6], a[6:8]) for q in (b[4:6], b[6:8]))
            safe = (a[1] % 2) + (b[1] % 2)
            if a[1] < b[1] and both and min(a[3], b[3]) - max(a[2], b[2]) >= 14_400 and nm <= 50 and (safe == 0 or (safe == 1 and nm < 15)):
                want[a[0], b[0]] = (min(both), "high" if nm < 5 else "medium" if nm < 15 else "low")
    rows = found.collect()
    assert {(r.gap_1, r.gap_2): (r.corridor_id, r.confidence) for r in rows} == want and len(rows) == len(want) > 50
    assert "Exchange" not in plan(found).split("SortMergeJoin")[0]


def test_detections_are_counted_where_they_meet(spark, fixed_plans):
    rng = random.Random(2)
    at = lambda: (rng.randrange(0, 60_000), rng.uniform(0, 1), rng.uniform(0, 1))
    spots = [at() for _ in range(30)]
    gaps, seen = [(i, *spots[i % 30]) for i in range(60)], [(i, *(spots[i % 7] if i % 3 else at())) for i in range(90)]
    found = satellite.uncovered(spark.createDataFrame(seen, "detection_id long, t long, lat double, lon double"), spark.createDataFrame(gaps, "gap_id long, gap_start long, lat double, lon double"), 12.0, 2)
    n = {g[0]: sum(abs(g[1] - d[1]) <= 7_200 and miles(g[2:], d[2:]) <= 12.0 for d in seen) for g in gaps}
    assert {r.gap_id: r.detections for r in found.collect()} == {g: k for g, k in n.items() if k}
    assert "keys=[gap_id" not in plan(found)


def test_networks_take_no_more_members_than_are_shown(spark, written):
    rng = random.Random(3)
    rows = [(i, 1_000 + i, None if i % 3 == 0 else rng.randrange(0, 400), rng.choice([None, 1, 1, 2]), i % 37 == 0) for i in range(400)]
    owners = spark.createDataFrame(rows, "owner_id long, vessel_id long, parent_id long, cluster_id long, sanctioned boolean")
    starts = owners.filter("owner_id % 20 = 7").select("vessel_id")
    got = sorted(spread.network_nodes(owners, starts, limit=10).collect(), key=str)
    assert max(written) <= 2_500
    whole = spread.network_nodes(owners, starts, limit=100_000).filter("place <= 10")
    assert got == sorted(whole.collect(), key=str) and {r.layer for r in got} == {None, 0, 1, 2}
    assert max(written) > 4_000


def test_gaps_are_not_sent_through_the_driver(spark, fixed_plans):
    """Only the zones are; neither vessels, nor what zone a gap lies in, nor reports by buckets of time."""
    p = spark.range(9).selectExpr("id % 3 as vessel_id", "id as point_id", "id * 9000 as t", "0.5d as lat", "0.5d as lon", "1.0d as sog", "1 as k")
    v = spark.range(3).selectExpr("id as vessel_id", "1e5d as dwt", "'F' as flag", "1 as flag_id", "'N' as name", "'K' as kind")
    zoned = pairs.in_zone(sequence.gaps(p, v), adapter.corridors(spark), "gap_id")
    assert plan(zoned).count("BroadcastExchange") <= 1 and zoned.filter("corridor_id = 1").count() == 6
    near = sequence.near_times(p.select("vessel_id", F.col("t").alias("start")), p, "start", "t", 0, 60)
    assert "Broadcast" not in plan(near) and near.count() == 9


def test_signals_of_each_query_are_written_by_themselves(spark, monkeypatch):
    """Each query is asked once, though two keys of it count, and no join of its own is left in the plan of the whole."""
    asked = []
    z = spark.createDataFrame([(1, 7, 300, False, 0.1, None), (2, 8, 300, False, 0.1, None)], "gap_id long, vessel_id long, duration_minutes long, impossible boolean, ratio double, corridor_kind string")
    rows = lambda columns, values: lambda s, d: (asked.append(columns), s.createDataFrame(values, columns))[1]
    monkeypatch.setattr(score_queries, "LONG", ("long",))
    monkeypatch.setattr(score_queries, "MORE", (("dark", "gap_1", "'dark_pair'", "score"), ("dark", "gap_2", "'dark_pair'", "score"), ("ship", "vessel_id", "'ship'", "5")))
    monkeypatch.setattr(score_queries, "QUERIES", {"long": rows("gap_id long, signal string, points int", [(1, "x", 3), (1, "x", 4)]), "dark": rows("gap_1 long, gap_2 long, score int", [(1, 2, 30), (2, 3, 20)]), "ship": rows("vessel_id long", [(7,), (9,)])})
    got = score_queries.every_signal(spark, "", z)
    assert sorted(map(tuple, got.collect())) == [(1, "dark_pair", 30), (1, "duration", 12), (1, "ship", 5), (1, "x", 4), (2, "dark_pair", 30), (2, "duration", 12), (3, "dark_pair", 20)]
    assert len(asked) == 3 and "Join" not in plan(got)


def test_straight_days_are_told_to_the_last_bit(spark):
    """Where way and direct way are one up to the last bit, by the C library's functions, as DuckDB has them."""
    rng = random.Random(20)
    rows = [(v, 10 * v + i, 3_600 * i, rng.randrange(0, 200) / 100 if v % 2 else i * rng.randrange(1, 9) / 100, v % 7 / 10) for v in range(1_000) for i in range(3)]
    rows = [(v, p, t, la if v % 3 else v % 50 / 100 + t / 360_000, lo) for v, p, t, la, lo in rows]
    con, want = duckdb.connect(), {}

    def exact(p, q):
        return con.execute(f"SELECT {distance('a', 'b', 'c', 'd')} FROM (SELECT ?::DOUBLE AS a, ?::DOUBLE AS b, ?::DOUBLE AS c, ?::DOUBLE AS d)", [*p, *q]).fetchone()[0]

    for v in range(1_000):
        a, b, c = [r[3:] for r in rows[3 * v : 3 * v + 3]]
        way = exact(a, b) + exact(b, c)
        want[v] = math.floor(100 * exact(a, c) / way) if way > 0 else 0
    got = networks.segments(spark.createDataFrame(rows, "vessel_id long, point_id long, t long, lat double, lon double"))
    assert {r.vessel_id: r.straightness for r in got.collect()} == want and {99, 100} < set(want.values())


def test_days_are_thinned_in_order_with_their_last_report(spark):
    """A report a little after the start of a slot is left out, the last one is kept; two reports left are a track, and one that stays is straight."""
    rows = [(1, i, t, la, lo, s) for i, (t, la, lo, s) in enumerate([(0, 0.0, 0.0, 1.0), (1_700, 0.0, 0.1, 2.0), (1_850, 0.0, 0.2, 3.0), (3_620, 0.5, 0.2, None), (3_700, 0.0, 0.3, 5.0), (3_800, 1.0, 0.3, 7.0)])]
    rows += [(2, 10 + i, 86_400 + 60 * i, 1.0, 1.0, None) for i in range(3)] + [(3, 20, 0, 1.0, 1.0, 1.0), (3, 21, 50, 2.0, 1.0, 1.0)]
    frame = spark.createDataFrame(rows, "vessel_id long, point_id long, t long, lat double, lon double, sog double")
    got = {r.vessel_id: r for r in networks.segments(frame).collect()}
    track = [(0.0, 0.0), (0.0, 0.2), (0.0, 0.3), (1.0, 0.3)]
    way = sum(miles(p, q) for p, q in zip(track, track[1:]))
    one = got[1]
    assert set(got) == {1, 2} and (one.day, one.n, one.seconds, one.straightness) == (0, 4, 3_800, math.floor(100 * miles(track[0], track[-1]) / way))
    assert (one.nm, one.lat, one.lon, one.mean_sog) == (pytest.approx(way), pytest.approx(0.25), pytest.approx(0.2), pytest.approx(4.0)) and one.bearing == pytest.approx(math.degrees(math.atan2(math.sin(math.radians(0.3)) * math.cos(math.radians(1)), math.sin(math.radians(1)))))
    two = got[2]
    assert (two.day, two.n, two.seconds, two.straightness, two.nm, two.mean_sog) == (1, 2, 120, 100, 0.0, 0.0)


@pytest.mark.parametrize("strict", [False, True])
def test_only_reports_with_a_value_in_common_meet(spark, fixed_plans, monkeypatch, strict):
    rng = random.Random(27)
    points = [(v, 10 * v + i, rng.randrange(0, 40_000), rng.uniform(0, 0.5), rng.uniform(0, 0.5)) for v in range(30) for i in range(4)]
    changes = [(v, 10 * v + i, rng.randrange(0, 60_000), rng.choice(["flag", "name"]), rng.randrange(9), rng.choice([None, *range(9)])) for v in range(30) for i in range(5)]
    sent, meet = [], identity.meetings
    monkeypatch.setattr(identity, "meetings", lambda *a: (sent.append(meet(*a)), sent[-1])[1])
    frame = spark.createDataFrame(points, "vessel_id long, point_id long, t long, lat double, lon double")
    found = identity.identity_swaps(frame, spark.createDataFrame(changes, "vessel_id long, change_id long, t long, field string, value long, old long"), 20_000, 20_000, 12.0, 9_000, strict)
    want = {}
    for a in points:
        for b in points:
            m = max(a[2], b[2])
            if a[0] < b[0] and abs(a[2] - b[2]) <= 9_000 and a[2] // 20_000 == b[2] // 20_000 and miles(a[3:], b[3:]) <= 12.0:
                for c in changes:
                    for e in changes:
                        real = c[5] not in (None, c[4]) and e[5] not in (None, e[4]) and c[3] == e[3]
                        if c[0] == a[0] and e[0] == b[0] and real and m <= c[2] <= m + 20_000 and m <= e[2] <= m + 20_000 and (all if strict else any)((c[5] == e[4], e[5] == c[4])):
                            want[a[0], b[0], c[3]] = min(m, want.get((a[0], b[0], c[3]), m))
    assert {(r.vessel_id_1, r.vessel_id_2, r.field): r.met_t for r in found.collect()} == want and want
    pairs_of = sum(a[0] < b[0] and abs(a[2] - b[2]) <= 9_000 for a in points for b in points)
    assert sent[0].count() < pairs_of / 4


def test_only_possible_successors_meet(spark, fixed_plans, monkeypatch):
    """As by plain loops, of both orders of ids; pairs whose wait does not fit never come together."""
    rng = random.Random(1)
    spans = {v: (rng.randrange(0, 3), rng.randrange(5, 9)) for v in range(40)}
    points = [(v, 10 * v + i, t, rng.uniform(0, 0.4), rng.uniform(0, 0.4)) for v, (a, z) in spans.items() for i, t in enumerate([a * 86_400 + v, *(rng.randrange(a * 86_400 + 50, z * 86_400) for _ in range(6)), z * 86_400 + v])]
    low, high = -6 * 86_400, -4 * 86_400
    sent, meet = [], networks.meetings
    monkeypatch.setattr(networks, "meetings", lambda *a: (sent.append(meet(*a)), sent[-1])[1])
    frame = spark.createDataFrame(points, "vessel_id long, point_id long, t long, lat double, lon double")
    got = networks.meetings_of_successors(frame, 86_400, 15.0, 20_000, low, high)
    first, last = ({v: f(p[2] for p in points if p[0] == v) for v in spans} for f in (min, max))
    met = {(a[0], b[0]) for a in points for b in points if a[0] < b[0] and a[2] // 86_400 == b[2] // 86_400 and abs(a[2] - b[2]) <= 20_000 and miles(a[3:], b[3:]) <= 15.0}
    want = {(a, b) for a, b in met if low < first[b] - last[a] <= high}
    assert {(r.dark_id, r.new_id) for r in got.collect()} == want and 0 < len(want) < len(met) / 2
    assert {(r.vessel_id_1, r.vessel_id_2) for r in sent[0].select("vessel_id_1", "vessel_id_2").distinct().collect()} < met
    ships = spark.createDataFrame([(v, "F", "K", 1.0, str(v)) for v in spans], "vessel_id long, flag string, kind string, dwt double, imo string")
    pairs_of = {(r.dark_id, r.new_id) for r in networks.merge_candidates(frame, ships, (86_400, 15.0, 20_000), low, high).collect()}
    assert pairs_of == {(a, b) for a in spans for b in spans if a != b and low < first[b] - last[a] <= high} - want


@pytest.mark.parametrize("grid", [4, 1_000_000])
def test_reports_of_one_place_are_counted_together(spark, fixed_plans, grid):
    """As by plain loops, with times on both limits; and no more comes together than places in slots."""
    rng = random.Random(grid)
    rows = [(i, i % 17, rng.randrange(0, 40) * 300, rng.randrange(grid) / grid, rng.randrange(grid) / grid) for i in range(400)]
    frame = spark.createDataFrame(rows, "point_id long, vessel_id long, t long, lat double, lon double")
    got = pairs.counts_near(frame.filter("point_id % 5 = 0"), frame, 20.0, 1_800)
    want = {a[0]: sum(a[1] != b[1] and abs(a[2] - b[2]) <= 1_800 and miles(a[3:], b[3:]) <= 20.0 for b in rows) for a in rows if a[0] % 5 == 0}
    assert {r.point_id: r.near for r in got.collect()} == {k: n for k, n in want.items() if n}
    assert any(abs(a[2] - b[2]) == 1_800 for a in rows for b in rows)
    times = 1_800 // 300  # reports of one place and slot
    assert grid > 4 or plan(got).count("SortMergeJoin") == 2 and frame.selectExpr("lat", "lon", "floor(t / 1800)").distinct().count() < len(rows) / (times / 3)
