"""Hard negatives against a plain version: windows, ties, repeated rows, broken vectors, other lengths, large values, groups, pruning."""

import duckdb
import numpy as np
import pytest

from wakeline.llm import hard_negatives as hard

SCHEMA = "vec_id long, embedding array<double>, label int, v string, kind int, low int, anchor_id int, near string"


def sound(rows):
    return [(i, [int(np.floor(256 * x)) for x in e], lab) for i, e, lab in rows if i is not None and lab is not None and e and all(x is not None and np.isfinite(x) for x in e)]


def plain(rows, every=100, positives=5, negatives=10):
    """All scores by Python integers; an anchor that is there twice is asked once."""
    rows, out = sound(rows), []
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    anchors = {}
    for i, v, lab in rows:
        if i % every == 0:
            anchors[i] = min(anchors.get(i, (lab, v)), (lab, v))
    for a, (lab, v) in anchors.items():
        scored = sorted(((dot(v, w), i, other == lab) for i, w, other in rows if len(w) == len(v)), key=lambda x: (-x[0], x[1]))
        for p, pid, _ in [x for x in scored if x[2] and x[1] != a][:positives]:
            far = [x for x in scored if not x[2] and 30 * p <= 100 * x[0] <= 90 * p][:negatives]
            out += [(a, pid, k, x[1], p, x[0]) for k, x in enumerate(far, 1)]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(i, e, lab, "v", 1, 2, 3, "n") for i, e, lab in rows], SCHEMA).repartition(5)


def asked(df):
    return sorted(tuple(r) for r in df.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


@pytest.mark.parametrize("group", [hard.GROUP, 20])
def test_matches_a_plain_version(spark, monkeypatch, group):
    monkeypatch.setattr(hard, "GROUP", group)
    rng = np.random.default_rng(3)
    rows = [(int(i), (rng.normal(size=16) + (i % 3)).tolist(), int(rng.integers(4))) for i in range(400)]
    rows += [(1000 + i, rows[200][1], int(i % 3)) for i in range(60)]  # ties of a hot vector
    rows += [rows[7]] * 4 + [(100, rows[100][1], 9), (300, rows[5][1], 0)]  # repeated rows and anchors
    rows += [(None, rows[1][1], 1), (500, None, 1), (600, [], 1), (700, [1.0, None], 1), (800, [float("nan")] * 16, 2), (900, [float("inf")] * 16, 2), (1100, rows[9][1], None)]
    rows += [(1200 + i, rng.normal(size=5).tolist(), i % 2) for i in range(0, 120, 4)]  # another length
    assert asked(hard.mine(frame(spark, rows))) == plain(rows)


def test_negative_scores_and_short_lists(spark):
    rows = [(0, [1.0, 0.0], 1), (1, [-1.0, 0.0], 1), (2, [-0.5, 0.0], 2), (100, [0.0, 1.0], 3), (101, [0.0, 0.0], 3), (102, [5.0, 0.0], 4), (103, [0.0, 0.0], 4), (200, [1.0, 1.0], 8)]
    assert asked(hard.mine(frame(spark, rows))) == plain(rows)
    assert asked(hard.mine(frame(spark, []))) == []


def test_values_past_what_a_double_holds(spark):
    rng = np.random.default_rng(1)
    rows = [(int(i), (rng.integers(1, 9, 4) * 1.0e4 + rng.integers(0, 256, 4) / 256).tolist(), i % 2) for i in range(200)]
    assert asked(hard.mine(frame(spark, rows), every=50)) == plain(rows, 50)


def test_bounds_discard_most_candidates():
    rng = np.random.default_rng(0)
    rows = np.floor(256 * rng.normal(size=(4000, 64)) * np.geomspace(1, 0.01, 64) @ np.linalg.qr(rng.normal(size=(64, 64)))[0]).astype(np.int64)
    turn = hard.rotation(rows.T.astype(float) @ rows)
    block = hard.Block(rows, np.zeros(4000, np.int64), np.arange(4000), turn, 11)
    verified = 0
    for i in range(0, 400, 10):
        got, n = block.search(rows[i], block.leading(rows[i : i + 1])[0], np.ones(len(block.rows), bool), i, np.array([-np.inf]), np.array([np.inf]), 5)
        score = rows @ rows[i]
        order = [int(x) for x in np.lexsort((np.arange(4000), -score)) if x != i][:5]
        assert got[0][0].tolist() == order
        verified += n
    assert verified < 40 * 4000 / 20


def test_windows_hold_the_best_scores_in_them(monkeypatch):
    monkeypatch.setattr(hard, "RESOLVE", 0)
    rng = np.random.default_rng(4)
    rows = rng.integers(-200, 200, (900, 24))
    rows[300:600] = rows[5]
    block = hard.Block(rows, rng.integers(0, 3, 900), np.arange(900), hard.rotation(rows.T.astype(float) @ rows), 11)
    for i in range(0, 900, 30):
        score, low = rows @ rows[i], np.array([-np.inf, -5000.0, 20_000.0, 1e9])
        chosen, high = block.labels != 1, np.array([0.0, 9000.0, 60_000.0, np.inf])
        held = {int(x) for a, z, c in zip(block.bounds, block.bounds[1:], chosen) if c for x in block.ids[a:z]}
        got, _ = block.search(rows[i], block.leading(rows[i : i + 1])[0], chosen, None, low, high, 10)
        for (ids, scores), lo, hi in zip(got, low, high):
            order = [int(x) for x in np.lexsort((np.arange(900), -score)) if x in held and lo <= score[x] <= hi][:10]
            assert ids.tolist() == order and scores.tolist() == score[order].tolist()


def test_rotation_is_orthonormal_and_sorted():
    x = np.random.default_rng(2).normal(size=(500, 12)) * np.arange(1, 13)
    turn = hard.rotation(x.T @ x)
    assert np.allclose(turn @ turn.T, np.eye(12)) and (np.diff(((x @ turn.T) ** 2).sum(0)) <= 1e-6).all()
    assert np.array_equal(hard.rotation(np.full((3, 3), np.inf)), np.eye(3))


def test_query_matches_sql(spark):
    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{d}/embeddings.parquet'")
    names = [x[0] for x in con.execute(hard.ORACLE).description]
    df = hard.op13_hard_negatives(spark, d)
    assert sorted(names) == sorted(df.columns)
    assert sorted(tuple(r) for r in df.select(*names).collect()) == sorted(con.execute(hard.ORACLE).fetchall())
