"""Route groups against the rule carried out in order, and ports foretold by hand."""

import random
from collections import Counter

import pytest

from wakeline.operators import routes as R


def like(a, b):
    return len(set(a) & set(b)) / len(set(a) | set(b)) >= 0.7


def plain(sequences, kinds):
    runs = [(v, n, s + 1, tuple(seq[s : s + n])) for v, seq in sorted(sequences.items()) for n in range(3, min(12, len(seq)) + 1) for s in range(len(seq) - n + 1)]
    used, out = set(), []
    for i, r in enumerate(runs):
        if i in used:
            continue
        group = [j for j in range(len(runs)) if j not in used and like(r[3], runs[j][3])]
        used |= set(group)
        if len(group) > 1:
            route, kind = (min(c.items(), key=lambda x: (-x[1], x[0]))[0] for c in (Counter(runs[j][3] for j in group), Counter(kinds[runs[j][0]] for j in group)))
            out.append((r[:3], route, len(group), kind))
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2])
def test_templates(spark, seed):
    rng = random.Random(seed)
    sequences = {v: [rng.randrange(9) for _ in range(rng.randrange(2, 16))] for v in range(12)}
    kinds = {v: rng.choice("ab") for v in sequences}
    calls = spark.createDataFrame([(v, p, t) for v, seq in sequences.items() for t, p in enumerate(seq)], "vessel_id long, port_id long, t long")
    got = R.templates(R.call_runs(calls), spark.createDataFrame(list(kinds.items()), "vessel_id long, kind string")).collect()
    assert sorted(((tuple(r.template)), tuple(r.route), r.frequency, r.kind) for r in got) == plain(sequences, kinds)
    assert R.templates(R.call_runs(calls.limit(0)), spark.createDataFrame([], "vessel_id long, kind string")).collect() == []


def test_foretold(spark):
    calls = spark.createDataFrame([(v, p, t) for v, seq in ((1, [1, 2, 3]), (2, [3, 1, 2]), (3, [8, 9]), (4, [5]), (5, [1, 2, 3, 4])) for t, p in enumerate(seq)], "vessel_id long, port_id long, t long")
    known = spark.createDataFrame([((1, 3, 1), [1, 2, 3, 1]), ((2, 3, 1), [3, 2, 1]), ((9, 3, 1), [4, 3, 2, 1])], "template struct<vessel_id:long,length:int,start:int>, route array<long>")
    spots = spark.createDataFrame([(1, 0.0, 0.0, 1), (2, 0.0, 9.0, 1), (2, 0.5, 0.5, 0), (5, 1.0, 1.0, 1)], "vessel_id long, lat double, lon double, t long")
    zones = spark.createDataFrame([("sts_zone", 0.0, 1.0, 0.0, 1.0), ("other", 0.0, 9.0, 8.0, 9.0)], "kind string, min_lat double, max_lat double, min_lon double, max_lon double")
    got = {r.vessel_id: (r.port_id, round(r.likeness, 2), r.deviation, r.template.vessel_id) for r in R.foretold(calls, known, spots, zones).collect()}
    assert got == {1: (1, 1.0, 25, 1), 2: (3, 1.0, 0, 1), 5: (3, 1.0, 25, 9)}
