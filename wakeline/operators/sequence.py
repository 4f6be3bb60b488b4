"""Detectors over a vessel's ordered reports: steps, runs, windows."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, Window

from wakeline.functions.geo import haversine_nm
from wakeline.functions.vessels import max_speed

ORDER = ("t", "point_id")


def by_vessel(*order: str) -> Window:
    return Window.partitionBy("vessel_id").orderBy(*(order or ORDER))


def steps(points: DataFrame) -> DataFrame:
    """Each report with the next one of its vessel: d_s, hours, nm and the next report's fields with a 2."""
    w = by_vessel()
    follow = {f"{c}2": F.lead(c).over(w) for c in ("t", "lat", "lon", "sog", "k")} | {"point2": F.lead("point_id").over(w)}
    out = points.withColumns(follow).filter("t2 is not null").withColumn("d_s", F.col("t2") - F.col("t"))
    return out.withColumns({"hours": F.col("d_s") / 3600.0, "nm": haversine_nm("lat", "lon", "lat2", "lon2")})


def gaps(points: DataFrame, vessels: DataFrame, least_hours: float = 2.0, impossible_ratio: float = 1.1) -> DataFrame:
    """Silences of at least `least_hours`, with how far the vessel moved against how far it could have."""
    s = steps(points).filter(F.col("d_s") >= int(least_hours * 3600)).join(vessels.select("vessel_id", "dwt", "flag", "flag_id", "name", "kind").hint("merge"), "vessel_id")  # both lie by vessel; vessels are not sent through the driver
    ratio = F.col("nm") / (max_speed(F.col("dwt")) * F.col("hours"))
    return s.select(
        F.col("point_id").alias("gap_id"), "vessel_id", F.col("t").alias("gap_start"), F.col("t2").alias("gap_end"), F.floor(F.col("d_s") / 60).alias("duration_minutes"),
        "nm", "hours", "lat", "lon", "lat2", "lon2", F.col("sog").alias("pre_gap_sog"), "k", ratio.alias("ratio"), (ratio > impossible_ratio).alias("impossible"), "dwt", "flag", "flag_id", "name", "kind",
    )


def implied_speed(points: DataFrame, least_knots: float, most_hours: float | None = None, least_nm: float = 0.0, least_hours: float = 0.0) -> DataFrame:
    """Steps whose implied speed is above `least_knots`."""
    s = steps(points).filter((F.col("d_s") > 0) & (F.col("nm") >= least_nm) & (F.col("hours") >= least_hours))
    if most_hours is not None:
        s = s.filter(F.col("hours") <= most_hours)
    return s.withColumn("knots", F.col("nm") / F.col("hours")).filter(F.col("knots") > least_knots)


def runs(points: DataFrame, condition: Column, key: Column | None = None, drop_open: bool = True) -> DataFrame:
    """Maximal stretches of reports that meet a condition (and share a key): vessel_id, run start, end, count.

    With drop_open a stretch that reaches the vessel's last report is left out: it has not ended yet.
    """
    w = by_vessel()
    hit = F.coalesce(condition, F.lit(False))
    marked = points.withColumn("_hit", hit).withColumn("_key", key if key is not None else F.lit(0))
    new = F.col("_hit") & ~(F.coalesce(F.lag("_hit").over(w), F.lit(False)) & F.coalesce(F.lag("_key").over(w).eqNullSafe(F.col("_key")), F.lit(False)))
    marked = marked.withColumns({"_run": F.sum(F.when(new, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)), "_last": F.lead("t").over(w).isNull()})
    out = marked.filter("_hit").groupBy("vessel_id", "_run").agg(
        F.min("t").alias("start"), F.max("t").alias("end"), F.count("*").alias("n"), F.first("_key").alias("key"), F.max("_last").alias("open"), F.avg("lat").alias("lat"), F.avg("lon").alias("lon"), F.min("point_id").alias("first_point")
    )
    return (out.filter("not open") if drop_open else out).drop("_run")


def first_follower(points: DataFrame, seconds: int, knots: float) -> DataFrame:
    """For each report the first later one within `seconds` that would need more than `knots` to reach.

    The pairs come from an equi-join on time buckets as long as the reach, so a report meets its own and the next bucket only.
    """
    a = points.select("vessel_id", F.col("point_id").alias("anchor"), F.col("t").alias("t1"), F.col("lat").alias("lat1"), F.col("lon").alias("lon1"))
    a = a.withColumn("bucket", F.explode(F.array(F.floor(F.col("t1") / seconds), F.floor(F.col("t1") / seconds) + 1)))
    b = points.withColumn("bucket", F.floor(F.col("t") / seconds))
    near = a.join(b, ["vessel_id", "bucket"]).filter((F.col("t") > F.col("t1")) & (F.col("t") - F.col("t1") <= seconds))
    knots_now = haversine_nm("lat1", "lon1", "lat", "lon") / ((F.col("t") - F.col("t1")) / 3600.0)
    fast = near.withColumn("knots", knots_now).filter(F.col("knots") > knots)
    first = Window.partitionBy("anchor").orderBy("t", "point_id")
    return fast.withColumn("_r", F.row_number().over(first)).filter("_r = 1").select("vessel_id", "anchor", "point_id", "t1", "t", "knots")


def forward_window(points: DataFrame, seconds: int, **aggregates: Column) -> DataFrame:
    """Each report with aggregates over its vessel's reports from it on to `seconds` later."""
    w = Window.partitionBy("vessel_id").orderBy("t").rangeBetween(0, seconds)
    return points.withColumns({k: v.over(w) for k, v in aggregates.items()})


def deviation(values: Column) -> Column:
    """Sample deviation of an array's numbers, the mean moved from one to the next, step by step as in the SQL: a limit may lie on it up to the last bit."""

    def step(acc, v):
        n = acc["n"] + 1.0
        mean = acc["mean"] + (v - acc["mean"]) / n
        return F.struct(n.alias("n"), mean.alias("mean"), (acc["squares"] + (v - mean) * (v - acc["mean"])).alias("squares"))

    start = F.struct(*(F.lit(0.0).alias(c) for c in ("n", "mean", "squares")))
    return F.aggregate(values, start, step, lambda acc: F.when(acc["n"] > 1, F.sqrt(acc["squares"] / (acc["n"] - 1.0))))


def near_times(df: DataFrame, other: DataFrame, left_t: str, right_t: str, before: int, after: int, key: str = "vessel_id") -> DataFrame:
    """Rows of `df` and `other` with equal key and right_t within [left_t - before, left_t + after], by time buckets."""
    size = max(1, before + after)
    low, high = F.floor((F.col(left_t) - before) / size), F.floor((F.col(left_t) + after) / size)
    a = df.withColumn("_b", F.explode(F.sequence(low, high)))
    b = other.withColumn("_b", F.floor(F.col(right_t) / size))
    return a.hint("merge").join(b, [key, "_b"]).filter((F.col(right_t) >= F.col(left_t) - before) & (F.col(right_t) <= F.col(left_t) + after)).drop("_b")


def as_of(df: DataFrame, facts: DataFrame, t: str, fact_t: str, value: str, key: str = "vessel_id", forward: bool = False) -> DataFrame:
    """df with the last `value` at or before its time (or the first at or after it), by one sort of both sides."""
    a = df.withColumns({"_t": F.col(t), "_v": F.lit(None).cast(dict(facts.dtypes)[value]), "_row": F.lit(True)})
    b = facts.select(key, F.col(fact_t).alias("_t"), F.col(value).alias("_v")).withColumn("_row", F.lit(False))
    both = a.unionByName(b, allowMissingColumns=True)
    if forward:
        w = Window.partitionBy(key).orderBy("_t", F.desc("_row")).rowsBetween(0, Window.unboundedFollowing)
        got = F.first("_v", ignorenulls=True).over(w)
    else:
        w = Window.partitionBy(key).orderBy("_t", "_row").rowsBetween(Window.unboundedPreceding, 0)
        got = F.last("_v", ignorenulls=True).over(w)
    return both.withColumn(f"{'next' if forward else 'last'}_{value}", got).filter("_row").drop("_t", "_v", "_row")


def rate_of_change(points: DataFrame, column: str, least: int) -> DataFrame:
    """Reports per vessel and the population coefficient of variation of their intervals."""
    d = points.withColumn("_d", F.col("t") - F.lag("t").over(by_vessel()))
    out = d.groupBy("vessel_id").agg(F.count("_d").alias("n"), F.avg("_d").alias("mean"), F.stddev_pop("_d").alias("sd"))
    return out.filter((F.col("n") >= least) & (F.col("mean") > 0)).withColumn(column, F.col("sd") / F.col("mean"))
