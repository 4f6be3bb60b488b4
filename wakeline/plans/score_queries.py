"""The gap score from the signals of all detectors."""

from __future__ import annotations

import pyspark.sql.functions as F

from wakeline.operators import gap_scores as G
from wakeline.operators.graph import _cut
from wakeline.operators.scoring import CORROBORATION, FAMILY_CAPS, duration_points, envelope_points
from wakeline.plans.base import ORACLES, QUERIES, query, zoned_frame
from wakeline.plans.oracle import sql
from wakeline.sources.adapter import positions, vessels

LONG = ("r3_selective_darkness", "r5_identity_signals", "r6_event_signals", "r20_flag_changes", "r22_id_change", "r23_legitimacy", "r25_report_signals", "r27_voyage_signals", "r33_vessel_signals", "r34_fleet_signals")
# query, key, signal (SQL), points (SQL); a vessel's signals go to all of its gaps
MORE = (
    ("h7_weather_deduction", "gap_id", "'weather'", "points"), ("r4_gap_frequency", "gap_id", "'frequency'", "points"), ("r37_own_history", "gap_id", "'own_history'", "points"), ("h2_lights_of_gaps", "gap_id", "'night_light'", "10"),
    ("h1_gap_midpoint_detections", "gap_id", "'validated_dark'", "20"), ("r28_unmatched_detections", "gap_id", "'unmatched_detection'", "30"), ("w20_dark_pairs", "gap_1", "'dark_pair'", "score"), ("w20_dark_pairs", "gap_2", "'dark_pair'", "score"),
    ("w24_sparse_transmission", "vessel_id", "'sparse_transmission'", "score"), ("w32_insurance_gap", "vessel_id", "'insurance_gap'", "points"), ("w34_destination", "vessel_id", "'destination_' || kind", "points"), ("w14_stale_values", "vessel_id", "'stale_values'", "15"),
    ("w11_circle_types", "vessel_id", "'circle_' || type", "score"), ("w19_approaches", "moving", "'approach'", "score"), ("w21_convoy_runs", "vessel_id_1", "'convoy'", "score"), ("w21_convoy_runs", "vessel_id_2", "'convoy'", "score"), ("g10_compound_spread", "vessel_id", "'sanctions_spread'", "score"),
)
BASE = """SELECT gap_id, 'duration' AS signal, CASE WHEN duration_minutes >= 1440 THEN 55 WHEN duration_minutes >= 720 THEN 40 WHEN duration_minutes >= 480 THEN 25 WHEN duration_minutes >= 240 THEN 12 ELSE 5 END AS points FROM zoned
  UNION ALL SELECT gap_id, 'envelope', CASE WHEN impossible THEN 40 WHEN ratio > 0.8 THEN 15 ELSE 0 END FROM zoned UNION ALL SELECT gap_id, 'zone', 20 FROM zoned WHERE corridor_kind = 'sts_zone' UNION ALL SELECT gap_id, 'dark_zone', -10 FROM zoned WHERE corridor_kind = 'dark_zone'"""


def part(name: str, key: str, signal: str, points: str) -> str:
    rows = f"(SELECT {key} AS key, {signal} AS signal, {points} AS points FROM ({ORACLES[name]}))"
    return f"SELECT key AS gap_id, signal, points FROM {rows}" if key.startswith("gap") else f"SELECT gap_id, signal, points FROM {rows} JOIN gaps ON vessel_id = key"


EVERY = " UNION ALL ".join([BASE, *(f"SELECT gap_id, signal, points FROM ({ORACLES[n]})" for n in LONG), *(part(*m) for m in MORE)])
NAMES = "(VALUES " + ", ".join(f"('{s}', '{f}', '{p}')" for s, f, p in G.TABLE) + ") n(signal, family, pillar)"
CAP = "CASE family " + " ".join(f"WHEN '{f}' THEN {c}" for f, c in FAMILY_CAPS.items()) + " END"
PILLARS = ("vessel", "position", "voyage", "watchlist", "other")
LISTED = lambda names: "(" + ", ".join(f"'{x}'" for x in names) + ")"
SCORES = f"""facts AS (SELECT z.gap_id, z.corridor_weight AS w, z.dwt, flag_id % 5 = 1 AS low, kind = 'HOUSEHOLD' AS plain, kind = 'FURNITURE' AS vague, (gap_start - f.t0) / 86400.0 AS known_days, f.n AS reports FROM zoned z JOIN (SELECT vessel_id, min(t) AS t0, count(*) AS n FROM pos GROUP BY 1) f USING (vessel_id)),
  raw AS (SELECT gap_id, signal, max(points) AS points FROM ({EVERY}) GROUP BY 1, 2 HAVING max(points) <> 0),
  nam AS (SELECT raw.*, family, coalesce(pillar, 'other') AS pillar FROM raw JOIN facts USING (gap_id) LEFT JOIN {NAMES} USING (signal) WHERE NOT (plain AND signal IN {LISTED(G.TRANSFER_SIGNALS)})),
  tot AS (SELECT *, sum(greatest(points, 0)) OVER (PARTITION BY gap_id, family) AS total FROM nam),
  cap AS (SELECT gap_id, signal, pillar, CAST(CASE WHEN points > 0 AND family IS NOT NULL AND total > {CAP} THEN round_even(points * {CAP} / total, 0) ELSE points END AS INT) AS points FROM tot),
  agg AS (SELECT gap_id, sum(greatest(points, 0)) AS plus, sum(least(points, 0)) AS minus, {', '.join(f"coalesce(sum(points) FILTER (pillar = '{p}' AND points > 0), 0) AS p_{p}" for p in PILLARS)}, bool_or(signal IN {LISTED(G.CERTAIN)}) AS certain FROM cap GROUP BY 1),
  act AS (SELECT *, {' + '.join(f'CAST(p_{p} > 0 AS INT)' for p in PILLARS)} AS active, {' + '.join(f'CAST(p_{p} >= 10 AS INT)' for p in PILLARS[:4])} AS corroborated FROM facts JOIN agg USING (gap_id)),
  mul AS (SELECT *, CASE WHEN plus < 25 THEN 'base' WHEN active < 2 THEN 'breadth' END AS gate, CASE WHEN plain THEN 10 ELSE CAST(round(coalesce(w, 1) * 10) AS INT) END AS w10, CASE WHEN dwt >= 200000 THEN 13 WHEN dwt >= 120000 THEN 12 WHEN dwt >= 80000 THEN 10 WHEN dwt >= 60000 THEN 8 ELSE 10 END AS s10 FROM act),
  fin AS (SELECT *, least(200, greatest(0, round_even((plus * (CASE WHEN low OR gate IS NOT NULL THEN least(w10, 10) ELSE w10 END) * (CASE WHEN gate IS NOT NULL THEN least(s10, 10) ELSE s10 END) + minus * 100) / 100.0::DOUBLE, 0))) AS s FROM mul),
  cls AS (SELECT *, least(s, CASE WHEN plain THEN 30 ELSE 200 END, CASE WHEN low AND vague THEN 50 ELSE 200 END) AS c FROM fin),
  lim AS (SELECT *, NOT (known_days >= 14 OR reports >= 50 OR certain) AND c > 50 AS unknown FROM cls)
  SELECT gap_id, CAST(least(200, CASE WHEN unknown THEN 50 ELSE c + CASE {' '.join(f'WHEN corroborated >= {n} THEN {p}' for n, p in CORROBORATION)} ELSE 0 END END) AS INT) AS score, CAST(p_vessel AS INT) AS pillar_vessel, CAST(p_position AS INT) AS pillar_position, CAST(p_voyage AS INT) AS pillar_voyage,
    CAST(corroborated AS INT) AS corroborated, gate, CASE WHEN unknown THEN 'missing_data' WHEN c < s THEN CASE WHEN plain THEN 'non_commercial' ELSE 'vague_type' END END AS "limit" FROM lim"""


def every_signal(spark, d, z):
    """All signals of all gaps (z): gap_id, signal, points. Each query runs once and its signals are written by themselves, so what one sends through the driver is gone before the next begins."""
    base = [
        G.as_signal(z, "duration", duration_points(F.col("duration_minutes"))), G.as_signal(z, "envelope", envelope_points(F.col("impossible"), F.col("ratio"))),
        G.as_signal(z.filter("corridor_kind = 'sts_zone'"), "zone", F.lit(20)), G.as_signal(z.filter("corridor_kind = 'dark_zone'"), "dark_zone", F.lit(-10)),
    ]
    long = [G.gathered(QUERIES[n](spark, d)) for n in LONG]
    return G.gathered(*base, *(_cut(x) for x in long), *(_cut(told(spark, d, z, name)) for name in dict.fromkeys(m[0] for m in MORE)))


def told(spark, d, z, name):
    """gap_id, signal, points: what one query of MORE says by all of its keys."""
    of = [m[1:] for m in MORE if m[0] == name]
    each = F.array(*(F.struct(F.col(key).alias("key"), F.expr(signal).alias("signal"), F.expr(points).alias("points")) for key, signal, points in of))
    rows = QUERIES[name](spark, d).select(F.explode(each).alias("_x")).select("_x.*").groupBy("key", "signal").agg(F.max("points").alias("points"))
    rows = rows if of[0][0].startswith("gap") else rows.join(z.select(F.col("vessel_id").alias("key"), "gap_id"), "key").drop("key").withColumnRenamed("gap_id", "key")
    return rows.select(F.col("key").alias("gap_id"), "signal", "points")


def facts(spark, d, z):
    seen = positions(spark, d).groupBy("vessel_id").agg(F.min("t").alias("_t"), F.count("*").alias("reports"))
    v = vessels(spark, d).select("vessel_id", (F.col("kind") == "HOUSEHOLD").alias("non_commercial"), (F.col("kind") == "FURNITURE").alias("vague_type"))
    return z.join(seen, "vessel_id").join(v, "vessel_id").withColumns({"low_risk": F.col("flag_id") % 5 == 1, "known_days": (F.col("gap_start") - F.col("_t")) / 86_400.0})


@query("r1_all_signals", sql(f", {SCORES}", "zoned").replace(")\n,", "),\n", 1))
def r1(spark, d):
    z = _cut(zoned_frame(spark, d))
    return G.gap_scores(facts(spark, d, z), every_signal(spark, d, z))
