"""Streams with timers and lists against the batch rules, restarts, backfill and health."""

import random
import time

import pytest
import pyspark.sql.functions as F

from wakeline.streaming import backfill as B
from wakeline.streaming import stateful as S

SCHEMA = "mmsi string, ts timestamp, sog double"
HOUR = 3600


def land(spark, folder, rows):
    rows = [(m, t, s) for m, t, s in rows]
    spark.createDataFrame(rows, "mmsi string, t long, sog double").select("mmsi", F.timestamp_seconds("t").alias("ts"), "sog").coalesce(1).write.mode("append").parquet(folder)


def drain(stream, out, checkpoint):
    query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(180)


def stamps(rows, *columns):
    return sorted(tuple(int(v.timestamp()) if hasattr(v, "timestamp") else v for v in (r[c] for c in columns)) for r in rows)


@pytest.fixture
def reports():
    rng, rows = random.Random(1), []
    for v in ("a", "b", "c"):
        t = 0
        for _ in range(40):
            t += rng.choice([600, 1200, 3000, 9000])
            rows.append((v, t, rng.choice([0.5, 0.5, 0.6, 7.0])))
    return sorted(rows, key=lambda r: r[1])


def test_silences_equal_the_batch_rule_over_a_restart(spark, tmp_path, reports):
    folder, out, cp = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")
    half, rng = len(reports) // 2, random.Random(2)
    for part in (reports[:half], reports[half:], [("z", reports[-1][1] + 40 * HOUR, 1.0)]):
        part = list(part)
        rng.shuffle(part)  # order of arrival does not matter within the delay
        land(spark, folder, part)
        drain(S.silences(spark.readStream.schema(SCHEMA).parquet(folder), 2.0, "30 hours"), out, cp)
    got = spark.read.parquet(out).collect()
    want = []
    for v in "abc":
        t = [r[1] for r in reports if r[0] == v]
        want += [(v, x, y) for x, y in zip(t, t[1:]) if y - x >= 2 * HOUR]
    end = reports[-1][1] + 10 * HOUR  # the watermark at the end
    assert stamps([r for r in got if not r.open], "mmsi", "gap_start", "gap_end") == sorted(want)
    last = {v: max(r[1] for r in reports if r[0] == v) for v in "abc"}
    told = sorted([(v, x) for v, x, _ in want] + [(v, t) for v, t in last.items() if t + 2 * HOUR <= end])
    assert stamps([r for r in got if r.open], "mmsi", "gap_start") == told


def test_runs_close_with_the_report_that_breaks_them(spark, tmp_path, reports):
    folder, out, cp = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")
    for part in (reports[::2] + reports[1:40:2], [("z", reports[-1][1] + 40 * HOUR, 9.0)]):
        land(spark, folder, part)
        drain(S.condition_runs(spark.readStream.schema(SCHEMA).parquet(folder), F.col("sog") < 1, 2, "30 hours"), out, cp)
    used, want = reports[::2] + reports[1:40:2], []
    for v in "abc":
        run = []
        for _, t, sog in sorted(r for r in used if r[0] == v):
            if sog < 1:
                run.append(t)
            else:
                want += [(v, run[0], run[-1], len(run))] if len(run) > 1 else []
                run = []
    assert want and stamps(spark.read.parquet(out).collect(), "mmsi", "start", "end", "n") == sorted(want)


def test_missing_ranges_and_plan(spark):
    rng = random.Random(3)
    covered = [(rng.choice("xyz"), a, a + rng.randrange(4), 1, rng.choice(["completed", "completed", "failed: X"])) for a in (rng.randrange(95, 135) for _ in range(14))]
    sources = [("x", 5), ("y", 7), ("z", 3), ("w", 4), ("full", 6)]
    covered.append(("full", 90, 140, 1, "completed"))
    frames = spark.createDataFrame(covered, B.LEDGER), spark.createDataFrame(sources, "source string, max_days int")
    plan = {}
    for r in B.backfill_plan(*frames, 100, 130).collect():
        plan.setdefault(r.source, []).extend(range(r.first_day, r.last_day + 1))
    for source, most in sources:
        done = {d for s, a, z, _, ok in covered if s == source and ok == "completed" for d in range(a, z + 1)}
        missing = [d for d in range(100, 131) if d not in done]
        assert sorted(plan[source]) == (missing[:most] if missing else list(range(131 - most, 131)))


def test_backfill_runs_again_without_doubling(spark, tmp_path):
    ledger, archive, asked = str(tmp_path / "ledger"), str(tmp_path / "archive"), []
    sources = spark.createDataFrame([("good", 3), ("bad", 2)], "source string, max_days int")

    def read(source, first, last):
        asked.append((source, first, last))
        if source == "bad" and len(asked) < 4:
            raise ValueError("no answer")
        return spark.createDataFrame([(d, d * 10 + i) for d in range(first - 1, last + 2) for i in range(2)], "day int, v long")

    for _ in range(5):
        B.run_backfill(spark, B.backfill_plan(B.read_ledger(spark, ledger), sources, 1, 5), read, archive, ledger)
    rows = spark.read.parquet(archive).collect()
    assert sorted((r.source, r.day, r.v) for r in rows) == sorted((s, d, d * 10 + i) for s, last in (("good", 5), ("bad", 5)) for d in range(1, last + 1) for i in range(2))
    status = [(r.source, r.status) for r in B.read_ledger(spark, ledger).collect()]
    assert ("bad", "failed: ValueError") in status and ("bad", "completed") in status
    assert asked[:2] == [("bad", 1, 2), ("good", 1, 3)]


def test_health_of_queries(spark, tmp_path, reports):
    folder, log = str(tmp_path / "in"), str(tmp_path / "health")
    land(spark, folder, reports)
    listener = B.HealthListener(spark, log, lambda: 1000.0)
    spark.streams.addListener(listener)
    try:
        query = spark.readStream.schema(SCHEMA).parquet(folder).writeStream.format("noop").queryName("feed").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        query.awaitTermination(120)
        for _ in range(60):
            if (tmp_path / "health").exists() and {r.status for r in B.read_health(spark, log).collect()} >= {"running", "stopped"}:
                break
            time.sleep(0.5)
    finally:
        spark.streams.removeListener(listener)
    rows = B.read_health(spark, log)
    workers = B.worker_health(rows.unionByName(spark.createDataFrame([("old", 100.0, "running", 5, None), ("bad", 990.0, "error", 1, "x")], B.HEALTH)), 1010.0)
    got = {r.worker: (r.stale, r.records, r.healthy) for r in workers.collect()}
    assert got == {"feed": (False, len(reports), True), "old": (True, 5, False), "bad": (False, 1, False)}
    assert B.overall_state(workers, ["feed", "none"]).first().asDict() == {"state": "degraded", "workers": 3, "missing": ["none"]}
    assert B.overall_state(workers.filter("worker = 'feed'"), ["feed"]).first().state == "healthy"
    assert B.overall_state(workers.limit(0), []).first().state == "unconfigured"


def test_breakers(spark):
    calls = [("a", float(i), False) for i in range(5)] + [("b", float(i), i != 3) for i in range(5)] + [("c", float(i), False) for i in range(5)] + [("c", 50.0, False), ("d", 1.0, False), ("d", 2.0, True)]
    got = {r.source: (r.failed, r.state) for r in B.breaker_states(spark.createDataFrame(calls, "source string, at double, ok boolean"), 65.0).collect()}
    assert got == {"a": (5, "half_open"), "b": (0, "closed"), "c": (6, "open"), "d": (0, "closed")}
