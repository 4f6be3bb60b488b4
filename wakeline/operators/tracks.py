"""What a vessel's track gives away: circles and their kind, and a fingerprint of how it is steered."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyspark.sql.functions as F
import pyspark.sql.types as T
from pyspark.sql import Column, DataFrame, Window

from wakeline.functions.geo import bearing_difference, haversine_nm
from wakeline.operators.pairs import near_port, unsent
from wakeline.operators.sequence import forward_window, near_times

CIRCLE_SCORES = {"stationary": 25, "deliberate": 35, "equipment": 10}
FEATURES = ("speed_median", "speed_iqr", "speed_max", "acceleration", "turn_median", "heading_spread", "draught_range", "interval_median", "interval_variance", "deceleration")
LEAST_VARIANCE = 1e-12


def circles(points: DataFrame, ports: DataFrame, seconds: int = 21_600, least: int = 6, shortest: int = 14_400, longest: int = 28_800, knots: float = 3.0, spread: float = 0.02, port_nm: float = 5.0) -> DataFrame:
    """vessel_id, start, end, lat, lon for each report from which on a vessel moves fast and stays in one place for hours, away from ports.

    The spread allowed grows as meridians close in, up to that at 72.5 degrees; a window starts once for each time.
    """
    median = F.percentile("sog", F.lit(0.5))
    w = forward_window(points, seconds, n=F.count("*"), end=F.max("t"), speed=median, lat_sd=F.stddev_samp("lat"), lon_sd=F.stddev_samp("lon"), mean_lat=F.avg("lat"), mean_lon=F.avg("lon"))
    across = F.cos(F.radians("mean_lat"))
    most = spread / F.greatest(across, F.lit(0.3))
    found = w.filter((F.col("n") >= least) & (F.col("end") - F.col("t")).between(shortest, longest) & (F.col("speed") > knots) & (F.col("lat_sd") < most) & (F.col("lon_sd") * across < most))
    found = found.groupBy("vessel_id", F.col("t").alias("start")).agg(F.min_by(F.struct("point_id", "end", "mean_lat", "mean_lon"), "point_id").alias("c"))
    found = found.select("vessel_id", "start", "c.point_id", "c.end", F.col("c.mean_lat").alias("lat"), F.col("c.mean_lon").alias("lon"))
    return found.join(near_port(found, ports, port_nm).select("point_id"), "point_id", "left_anti").select("vessel_id", "start", "end", "lat", "lon")


def circle_types(found: DataFrame, points: DataFrame, seconds: int = 21_600) -> DataFrame:
    """circles with drift (miles between the centres of their thirds), speed and radius figures, type and score."""
    rows = near_times(found.select("vessel_id", "start"), points.select("vessel_id", "point_id", "t", "lat", "lon", F.col("sog").cast("double").alias("sog")), "start", "t", 0, seconds)
    one = Window.partitionBy("vessel_id", "start")
    rows = rows.withColumns({"i": F.row_number().over(one.orderBy("t", "point_id")) - 1, "n": F.count("*").over(one), "_la": F.avg("lat").over(one), "_lo": F.avg("lon").over(one)})
    third = F.least(F.lit(2), F.floor(F.col("i") / F.greatest(F.lit(1), F.floor(F.col("n") / 3))))
    rows = rows.withColumns({"third": third, "r": haversine_nm("_la", "_lo", "lat", "lon")})
    mean = lambda c, k: F.avg(F.when(F.col("third") == k, F.col(c)))
    got = rows.groupBy("vessel_id", "start").agg(
        F.count("*").alias("reports"), *(mean(c, k).alias(f"{c}{k}") for k in range(3) for c in ("lat", "lon")), F.coalesce(F.avg("sog"), F.lit(0.0)).alias("speed"), F.coalesce(F.stddev_samp("sog"), F.lit(0.0)).alias("speed_sd"),
        F.avg("r").alias("radius"), F.coalesce(F.stddev_samp("r"), F.lit(0.0)).alias("radius_sd"), F.coalesce(F.regr_slope("r", "i"), F.lit(0.0)).alias("trend"),
    )
    leg = lambda a, b: F.coalesce(haversine_nm(f"lat{a}", f"lon{a}", f"lat{b}", f"lon{b}"), F.lit(0.0))
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    got = got.withColumns({"drift": leg(0, 1) + leg(1, 2), "speed_cv": share("speed_sd", "speed"), "radius_cv": share("radius_sd", "radius")})
    still, far, uneven = F.col("drift") < 0.5, F.col("drift") > 2.0, F.col("radius_cv") > 0.5
    faulty = ((F.col("drift") < 2.0) & ((uneven & (F.col("trend") < 0)) | (F.col("radius_cv") > 0.75))) | ((F.col("speed_cv") > 0.6) & uneven)
    kind = F.when(F.col("reports") < 3, "deliberate").when(still & (F.col("speed") < 2.0), "stationary").when(far & (F.col("speed") > 3.0), "deliberate").when(faulty, "equipment").when(still, "stationary").otherwise("deliberate")
    points_of = F.coalesce(*(F.when(F.col("type") == k, v) for k, v in CIRCLE_SCORES.items()))
    return found.join(got.withColumn("type", kind).withColumn("score", points_of).select("vessel_id", "start", "reports", "drift", "speed", "speed_cv", "radius", "radius_cv", "trend", "type", "score"), ["vessel_id", "start"])


def restarting_windows(points: DataFrame, seconds: int) -> DataFrame:
    """points with `window`, the time of the report that opened it: a window ends before the first report `seconds` or more later, which opens the next.

    A vessel's rows pass in order through one task, which holds a batch and one time.
    """

    def run(batches):
        vessel, start = None, 0
        for b in batches:
            v, t = (np.asarray(b.column(c)) for c in ("vessel_id", "t"))
            out, i = np.empty(len(t), np.int64), 0
            while i < len(t):
                if v[i] != vessel:
                    vessel, start = v[i], t[i]
                elif t[i] - start >= seconds:
                    start = t[i]
                last = i + int(np.searchsorted(v[i:], v[i], "right"))
                j = i + max(1, int(np.searchsorted(t[i:last], start + seconds, "left")))
                out[i:j] = start
                i = j
            yield b.append_column("window", [int(x) for x in out])

    schema = T.StructType([*points.schema.fields, T.StructField("window", T.LongType())])
    return points.repartition("vessel_id").sortWithinPartitions("vessel_id", "t", "point_id").mapInArrow(run, schema)


def _middle(values: Column) -> Column:
    """Median of a sorted array."""
    n = F.size(values)
    return (F.get(values, F.floor((n - 1) / 2).cast("int")) + F.get(values, F.floor(n / 2).cast("int"))) / 2


def window_features(points: DataFrame, seconds: int = 21_600, knots: float = 0.5) -> DataFrame:
    """vessel_id, window, n, first_t, last_t and FEATURES of each window of the reports under way; features are null with fewer than three.

    points: vessel_id, point_id, t, sog, heading, draught.
    """
    moving = points.select(F.col("vessel_id").cast("long").alias("vessel_id"), "point_id", F.col("t").cast("long").alias("t"), *(F.col(c).cast("double").alias(c) for c in ("sog", "heading", "draught"))).filter(F.col("sog") >= knots)
    w = Window.partitionBy("vessel_id", "window").orderBy("t", "point_id")
    before = F.last("heading", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = restarting_windows(moving, seconds).withColumns({"_ds": F.col("sog") - F.lag("sog").over(w), "_dt": (F.col("t") - F.lag("t").over(w)).cast("double"), "_turn": F.when(F.col("heading").isNotNull(), bearing_difference(F.col("heading"), before))})
    median = lambda c: F.percentile(c, F.lit(0.5))
    got = rows.groupBy("vessel_id", "window").agg(
        F.count("*").alias("n"), F.min("t").alias("first_t"), F.max("t").alias("last_t"), F.array_sort(F.collect_list("sog")).alias("_s"), F.max("sog").alias("speed_max"), F.stddev_samp("_ds").alias("acceleration"), median("_turn").alias("turn_median"),
        F.stddev_samp("heading").alias("heading_spread"), (F.max("draught") - F.min("draught")).alias("draught_range"), median("_dt").alias("interval_median"), F.var_samp("_dt").alias("interval_variance"), F.avg(F.when(F.col("_ds") < 0, F.col("_ds"))).alias("deceleration"),
    )
    half = F.floor(F.size("_s") / 2).cast("int")
    upper = F.slice("_s", F.floor((F.size("_s") + 1) / 2).cast("int") + 1, F.greatest(half, F.lit(1)))
    got = got.withColumns({"speed_median": _middle(F.col("_s")), "speed_iqr": F.when(F.size("_s") >= 4, _middle(upper) - _middle(F.slice("_s", F.lit(1), F.greatest(half, F.lit(1)))))})
    return got.select("vessel_id", "window", "n", "first_t", "last_t", *(F.when(F.col("n") >= 3, F.coalesce(F.col(c), F.lit(0.0))).alias(c) for c in FEATURES))


def fingerprints(points: DataFrame, seconds: int = 21_600, knots: float = 0.5, least: int = 20, span: int = 7_200) -> DataFrame:
    """vessel_id, windows, reports, diagonal, features (medians over windows), covariance (row by row) of vessels with enough reports under way.

    With ten windows or more the covariance is the sample's with a hundredth of its mean variance added on the diagonal,
    with two to nine the variances alone, with one the identity.
    """
    w = window_features(points, seconds, knots)
    d = len(FEATURES)
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    x = [F.col(c) for c in FEATURES]
    got = w.groupBy("vessel_id").agg(
        F.sum("n").alias("reports"), (F.max("last_t") - F.min("first_t")).alias("_span"), F.count(FEATURES[0]).alias("windows"),
        F.array(*(F.percentile(c, F.lit(0.5)) for c in FEATURES)).alias("features"), *(F.covar_samp(x[i], x[j]).alias(f"_c{i}_{j}") for i, j in pairs),
    ).filter((F.col("reports") >= least) & (F.col("_span") >= span) & (F.col("windows") > 0))
    load = sum((F.col(f"_c{i}_{i}") for i in range(d)), F.lit(0.0)) * 0.01 / d

    def cell(i: int, j: int) -> Column:
        c, one = F.col(f"_c{min(i, j)}_{max(i, j)}"), F.lit(float(i == j))
        return F.when(F.col("windows") < 2, one).when(F.col("windows") < 10, F.greatest(c, F.lit(LEAST_VARIANCE)) if i == j else F.lit(0.0)).otherwise(c + load if i == j else c)

    return got.select("vessel_id", "windows", "reports", (F.col("windows") < 10).alias("diagonal"), "features", F.array(*(cell(i, j) for i in range(d) for j in range(d))).alias("covariance"))


def mahalanobis(difference: np.ndarray, covariance: np.ndarray, diagonal: bool) -> float:
    """Length of the difference in units of the covariance; by its diagonal where it is not positive definite."""
    if not diagonal:
        try:
            return float(np.linalg.norm(np.linalg.solve(np.linalg.cholesky(covariance), difference)))
        except np.linalg.LinAlgError:
            pass
    return float(np.sqrt((difference**2 / np.maximum(np.diag(covariance), LEAST_VARIANCE)).sum()))


def fingerprint_bonus(pairs: DataFrame, prints: DataFrame) -> DataFrame:
    """pairs (id_1, id_2) with distance (the smaller of both ways) and bonus; 0 and null where one has no fingerprint."""
    side = lambda k: unsent(prints.select(F.col("vessel_id").alias(f"id_{k}"), F.col("features").alias(f"_f{k}"), F.col("covariance").alias(f"_v{k}"), F.col("diagonal").alias(f"_d{k}")))  # noqa: E731  # the estimate takes an array for one number
    both = pairs.select("id_1", "id_2").join(side(1), "id_1").join(side(2), "id_2")

    def run(batches):
        for b in batches:
            out = []
            for f1, v1, d1, f2, v2, d2 in b[["_f1", "_v1", "_d1", "_f2", "_v2", "_d2"]].itertuples(index=False, name=None):
                gap, n = np.asarray(f1) - np.asarray(f2), len(f1)
                out.append(min(mahalanobis(gap, np.reshape(v1, (n, n)), d1), mahalanobis(gap, np.reshape(v2, (n, n)), d2)))
            yield pd.DataFrame({"id_1": b["id_1"], "id_2": b["id_2"], "distance": out})

    far = both.mapInPandas(run, "id_1 long, id_2 long, distance double")
    d = F.col("distance")
    bonus = F.when(d <= 2.60, 15).when(d <= 3.06, 10).when(d >= 3.54, -5).otherwise(0)  # quartiles of a chi distribution of ten degrees
    return pairs.join(unsent(far), ["id_1", "id_2"], "left").withColumn("bonus", bonus)
