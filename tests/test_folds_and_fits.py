"""Folds, clusters, fitted detectors and fuzzy names against plain versions."""

import math
import random

import numpy as np
import pytest

from wakeline.functions.vessels import indel_ratio
from wakeline.operators import entities, fitted, folds, graph, networks

from .test_grid import nm


@pytest.fixture(scope="module")
def reports(spark):
    rng = random.Random(4)
    rows = []
    for v in range(6):
        t, lat, lon = 0, rng.uniform(0, 5), rng.uniform(0, 5)
        for i in range(120):
            t += rng.randrange(300, 9000)
            lat, lon = lat + rng.gauss(0, 0.02), lon + rng.gauss(0, 0.02)
            rows.append((v, 1000 * v + i, t, lat, lon, rng.uniform(0, 20), rng.choice((0, 1, 5, 15))))
    frame = spark.createDataFrame(rows, "vessel_id long, point_id long, t long, lat double, lon double, sog double, nav_status int").repartition(3)
    return frame, {v: [r for r in rows if r[0] == v] for v in range(6)}


def test_erratic_status(reports):
    frame, by = reports
    got = sorted((r.vessel_id, r.start, r.end, r.changes) for r in folds.erratic_status(frame, 20_000, 4).collect())
    want = []
    for v, rows in by.items():
        at = [b[2] for a, b in zip(rows, rows[1:]) if a[6] != b[6]]
        dense = [any(at[k + 3] - at[k] <= 20_000 for k in range(max(0, i - 3), min(i, len(at) - 4) + 1)) for i in range(len(at))]
        windows = [k for k in range(len(at) - 3) if at[k + 3] - at[k] <= 20_000]
        last = -1
        for k in windows:
            if k <= last:
                continue
            end = k + 3
            while end + 1 < len(at) and end - 2 in windows:
                end += 1
            want.append((v, at[k], at[end], end - k + 1))
            last = end
        assert all(dense[i] for w in want if w[0] == v for i in range(len(at)) if w[1] <= at[i] <= w[2])
    assert got == sorted(want) and got


def test_laid_up(reports):
    frame, by = reports
    got = {r.vessel_id: (r.first_day, r.days) for r in folds.laid_up(frame, 0.15, 2).collect()}
    for v, rows in by.items():
        days = sorted({r[2] // 86_400 for r in rows})
        place = {d: (float(np.median([r[3] for r in rows if r[2] // 86_400 == d])), float(np.median([r[4] for r in rows if r[2] // 86_400 == d]))) for d in days}
        runs = [[days[0]]]
        for d in days[1:]:
            a = place[runs[-1][0]]
            if abs(place[d][0] - a[0]) > 0.15 or abs(place[d][1] - a[1]) > 0.15:
                runs.append([d])
            else:
                runs[-1].append(d)
        best = max(runs, key=lambda r: (r[-1] - r[0], -r[0]))
        n = best[-1] - best[0] + 1
        assert got.get(v) == ((best[0], n) if n >= 2 else None)
    assert got


def test_residuals(reports):
    frame, by = reports
    got = {r.vessel_id: (r.n, r.residual_milli) for r in folds.residuals(frame, 0.3).collect()}
    for v, rows in by.items():
        x, u, off = complex(rows[0][3], rows[0][4]), 0j, []
        for a, b in zip(rows, rows[1:]):
            dt = max(1, b[2] - a[2])
            miss = complex(b[3], b[4]) - (x + u * dt)
            off.append(abs(miss))
            x, u = x + u * dt + 0.3 * miss, u + 0.3 * miss / dt
        assert got[v][0] == len(off) and abs(got[v][1] - 1000 * sum(off) / len(off)) <= 1


def test_components_of_a_long_chain(spark):
    n = 3_000
    order = list(range(n))
    random.Random(1).shuffle(order)
    edges = [(order[i], order[i + 1]) for i in range(n - 1) if i % 1000 != 999]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    for k in range(0, n, 1000):
        assert {got[x] for x in order[k : k + 1000]} == {min(order[k : k + 1000])}


def test_clusters(spark):
    rng = random.Random(9)
    pts = [(i, 60 + rng.gauss(0, 0.2), 179.9 + rng.gauss(0, 0.4)) for i in range(60)] + [(100 + i, rng.uniform(-80, 80), rng.uniform(-180, 180)) for i in range(40)]
    pts = [(i, a, (o + 180) % 360 - 180) for i, a, o in pts]
    got = {r.id: r.cluster for r in fitted.dbscan(spark.createDataFrame(pts, "id long, lat double, lon double"), 8.0, 3).collect()}
    near = {p[0]: [q[0] for q in pts if nm(*p[1:], *q[1:]) <= 8] for p in pts}
    core = {i for i in near if len(near[i]) >= 3}
    label = {i: i for i in core}
    for _ in pts:
        label = {i: min(label[j] for j in near[i] if j in core) for i in core}
    assert got == {i: label[i] if i in core else min((label[j] for j in near[i] if j in core), default=None) for i in near}
    assert len(set(label.values())) >= 1 and None in got.values()


def test_principal_components_against_numpy(spark, reports):
    rows = fitted.vessel_features(reports[0]).toPandas().sort_values("vessel_id")
    rng = np.random.default_rng(2)
    import pandas as pd

    more = pd.DataFrame(rng.normal(size=(80, len(fitted.FEATURES))) @ rng.normal(size=(len(fitted.FEATURES),) * 2), columns=list(fitted.FEATURES))
    more.insert(0, "vessel_id", range(100, 180))
    frame = pd.concat([rows, more], ignore_index=True)
    got = fitted.pca_errors(spark.createDataFrame(frame)).toPandas().sort_values("vessel_id")["error"].to_numpy()
    x = frame.sort_values("vessel_id")[list(fitted.FEATURES)].to_numpy(float)
    z = (x - x.mean(0)) / x.std(0, ddof=1)
    _, _, v = np.linalg.svd(z, full_matrices=False)
    assert np.allclose(got, np.linalg.norm(z - z @ v[:3].T @ v[:3], axis=1), atol=1e-6)


def test_isolation_finds_what_lies_apart(spark):
    import pandas as pd

    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, len(fitted.FEATURES)))
    x[:8] += 7 * rng.choice([-1, 1], size=(8, len(fitted.FEATURES)))
    frame = pd.DataFrame(x, columns=list(fitted.FEATURES))
    frame.insert(0, "vessel_id", range(400))
    got = fitted.isolation_scores(spark.createDataFrame(frame)).toPandas().set_index("vessel_id")["score"]
    assert set(got.nlargest(8).index) == set(range(8)) and got.between(0, 1).all()
    assert abs(got.iloc[8:].mean() - 0.45) < 0.1  # the middle of a forest's scores


def test_fuzzy_names(spark):
    rng = random.Random(5)
    words = ["ocean", "oceans", "star", "stars", "pacific", "line", "lines", "blue"]
    names = sorted({" ".join(rng.sample(words, rng.randrange(1, 4))) for _ in range(60)})
    got = {(r.one, r.two): r.ratio for r in entities.fuzzy_pairs(spark.createDataFrame([(n,) for n in names], "name string"), "name", 85.0).collect()}
    ordered = lambda s: " ".join(sorted(s.split()))
    want = {(a, b): math.floor(indel_ratio(ordered(a), ordered(b))) for a in names for b in names if a < b and min(a.split()) == min(b.split()) and indel_ratio(ordered(a), ordered(b)) >= 85}
    assert got == want and got


def test_relay_chains(spark):
    rng = random.Random(6)
    moves = [(rng.randrange(20) * 3 + rng.randrange(3), i) for i in range(400)]
    moves = [(a, a - a % 3 + rng.randrange(3), t) for a, t in moves]
    moves = [m for m in moves if m[0] != m[1]]
    frame = spark.createDataFrame(moves, "a long, b long, t long")
    got = {r.component: (r.hops, r.points) for r in networks.relay_chains(frame, graph.components(frame.select("a", "b"))).collect()}
    want = {}
    for k in {a - a % 3 for a, *_ in moves}:
        own = sorted((t, a, b) for a, b, t in moves if a - a % 3 == k)
        at, n = own[0][2], 1
        for _, a, b in own[1:]:
            if a == at:
                at, n = b, n + 1
        if len(own) >= 3 and n >= 3:
            want[min(min(a, b) for _, a, b in own)] = (n, 40 if n >= 4 else 20)
    assert got == want and got
