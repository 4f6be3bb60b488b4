"""Gap scores: signals as a long table, then caps, gating, multipliers and limits."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, Window

# Points by configuration section.
DURATION = ((1440, 55), (720, 40), (480, 25), (240, 12), (0, 5))  # least minutes, points
FREQUENCY = ((30, 5, 50), (30, 4, 40), (14, 3, 32), (30, 3, 25), (7, 2, 18))  # days, gaps, points; the largest counts
BANDS = ((76, "critical"), (51, "high"), (21, "medium"))
FAMILY_CAPS = {"gap_and_speed": 55, "spoofing_and_position": 60, "identity_and_ownership": 50, "voyage_and_sts": 50, "satellite_and_dark": 45, "watchlist": 60, "behavioral": 40}
CORROBORATION = ((4, 30), (3, 20), (2, 10))
FAMILIES = {"duration": "gap_and_speed", "envelope": "gap_and_speed", "frequency": "gap_and_speed", "zone": "voyage_and_sts", "dark_zone": "satellite_and_dark", "flag": "identity_and_ownership", "age": "behavioral", "size": "behavioral"}
TOP = 200


def banded(value: Column, bands, other) -> Column:
    out = F.lit(other)
    for least, points in reversed(bands):
        out = F.when(value >= least, points).otherwise(out)
    return out


def score_band(score: Column) -> Column:
    return banded(score, BANDS, "low")


def duration_points(minutes: Column) -> Column:
    return banded(minutes, DURATION, 0)


def envelope_points(impossible: Column, ratio: Column) -> Column:
    return F.when(impossible, 40).when(ratio > 0.8, 15).otherwise(0)


def zone_points(kind: Column) -> Column:
    return F.when(kind == "sts_zone", 20).when(kind == "dark_zone", -10).otherwise(0)


def simple_score(zoned: DataFrame) -> DataFrame:
    """Zoned gaps with score, band, status and day."""
    score = duration_points(F.col("duration_minutes")) + envelope_points(F.col("impossible"), F.col("ratio")) + zone_points(F.col("corridor_kind"))
    status = F.element_at(F.array(*map(F.lit, ("new", "under_review", "confirmed", "dismissed"))), (F.col("gap_id") % 4 + 1).cast("int"))
    return zoned.withColumn("score", score).withColumns({"band": score_band(F.col("score")), "status": status, "day": F.floor(F.col("gap_start") / 86400)})


def frequency_points(gaps: DataFrame, bounded: bool = True) -> DataFrame:
    """gap_id, points: the largest tier of how many gaps its vessel had in the days up to it (unbounded: from then on too)."""
    points = [F.lit(0)]
    for days, n, p in FREQUENCY:
        w = Window.partitionBy("vessel_id").orderBy("gap_start").rangeBetween(-days * 86400, 0 if bounded else Window.unboundedFollowing)
        points.append(F.when(F.count("*").over(w) >= n, p).otherwise(0))
    return gaps.select("gap_id", F.greatest(*points).alias("points"))


def long_signals(alerts: DataFrame, as_of_year: int = 2024) -> DataFrame:
    """gap_id, signal, family, points of all signals that are not 0."""
    age = as_of_year - F.col("year_built")
    signals = {
        "duration": duration_points(F.col("duration_minutes")),
        "envelope": envelope_points(F.col("impossible"), F.col("ratio")),
        "frequency": F.col("frequency"),
        "zone": F.when(F.col("corridor_kind") == "sts_zone", 20).otherwise(0),
        "dark_zone": F.when(F.col("corridor_kind") == "dark_zone", -10).otherwise(0),
        "flag": F.when(F.col("flag_id") % 5 == 0, 20).when(F.col("flag_id") % 5 == 1, -10).otherwise(0),
        "age": F.when(age >= 25, 20).when(age >= 20, 10).when(age >= 15, 12).when(age >= 10, 0).otherwise(-5),
    }
    rows = F.array(*(F.struct(F.lit(k).alias("signal"), F.lit(FAMILIES[k]).alias("family"), v.cast("int").alias("points")) for k, v in signals.items()))
    return alerts.select("gap_id", "corridor_weight", "dwt", F.explode(rows).alias("s")).select("gap_id", "corridor_weight", "dwt", "s.*").filter("points <> 0")


def final_scores(signals: DataFrame, least_base: int = 25, least_families: int = 2) -> DataFrame:
    """Family caps, then gating and multipliers on the positive part, then corroboration, limited to 0 to TOP."""
    cap = F.create_map(*(F.lit(x) for p in FAMILY_CAPS.items() for x in p))
    by_family = signals.groupBy("gap_id", "family").agg(F.sum(F.greatest("points", F.lit(0))).alias("plus"), F.sum(F.least("points", F.lit(0))).alias("minus"), F.first("corridor_weight").alias("corridor_weight"), F.first("dwt").alias("dwt"))
    capped = by_family.withColumn("plus", F.least("plus", F.element_at(cap, F.col("family"))))
    total = capped.groupBy("gap_id").agg(F.sum("plus").alias("plus"), F.sum("minus").alias("minus"), F.count_if(F.col("plus") >= 10).alias("families"), F.first("corridor_weight").alias("weight"), F.first("dwt").alias("dwt"))
    size = F.when(F.col("dwt") >= 200_000, 13).when(F.col("dwt") >= 120_000, 12).when(F.col("dwt") >= 80_000, 10).when(F.col("dwt") >= 60_000, 8).otherwise(10)
    gate = (F.col("plus") >= least_base) & (F.col("families") >= least_families)
    # weights and sizes are tenths, so that the product is exact
    tenths = F.when(gate, F.round(F.coalesce("weight", F.lit(1.0)) * 10).cast("int") * size).otherwise(100)
    grown = F.floor(F.col("plus") * tenths / 100)
    bonus = banded(F.col("families"), CORROBORATION, 0)
    return total.select("gap_id", "families", F.greatest(F.lit(0), F.least(F.lit(TOP), grown + F.col("minus") + bonus)).cast("int").alias("score"))
