"""Distance joins find what brute force finds, near the poles, across 180 degrees and across cell edges."""

import math
import random

import pytest

from wakeline.operators import pairs


def nm(a, b, c, d):
    a, b, c, d = map(math.radians, (a, b, c, d))
    h = math.sin((c - a) / 2) ** 2 + math.cos(a) * math.cos(c) * math.sin((d - b) / 2) ** 2
    return 2 * 3440.065 * math.asin(math.sqrt(min(1, h)))


@pytest.mark.parametrize("lat,lon", [(0.0, 0.0), (45.0, -0.01), (70.0, 20.0), (-70.0, 179.95), (89.7, 10.0), (-89.9, -179.9)])
def test_meetings_and_ports_match_brute_force(spark, lat, lon):
    rng = random.Random(int(lat))
    spread = min(60.0, 0.6 / max(0.01, math.cos(math.radians(lat))))
    points = []
    for i in range(160):
        x = lon + rng.uniform(-spread, spread)
        points.append((i % 8, i, rng.randrange(7200), max(-90.0, min(90.0, lat + rng.uniform(-0.6, 0.6))), (x + 180) % 360 - 180, 1.0, 90))
    frame = spark.createDataFrame(points, "vessel_id int, point_id int, t int, lat double, lon double, sog double, cog int")
    got = {(r.vessel_id_1, r.t_1, r.vessel_id_2, r.t_2) for r in pairs.meetings(frame, 3_600, 10.0, 900).collect()}
    want = {(a[0], a[2], b[0], b[2]) for a in points for b in points if a[0] < b[0] and a[2] // 3600 == b[2] // 3600 and abs(a[2] - b[2]) <= 900 and nm(*a[3:5], *b[3:5]) <= 10}
    assert got == want and want
    ports = spark.createDataFrame([(k, points[k][3], points[k][4]) for k in range(0, 40, 5)], "port_id int, lat double, lon double")
    near = {r.point_id: r.port_id for r in pairs.near_port(frame, ports, 30.0).collect()}
    best = {p[1]: min((nm(*p[3:5], *points[k][3:5]), k) for k in range(0, 40, 5)) for p in points}
    assert near == {i: k for i, (d, k) in best.items() if d <= 30}
