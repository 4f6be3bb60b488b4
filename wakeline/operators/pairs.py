"""Joins between vessels, and of positions with zones and ports, on space and time buckets."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, Window

from wakeline.functions.geo import haversine_nm, in_box
from wakeline.operators.graph import _cut

BROADCAST_ROWS = 100_000


def small(df: DataFrame) -> DataFrame:
    """The table marked for broadcast if it has few rows, else as it is."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def _cells_in(row: Column, degrees: float) -> Column:
    """How many cells a band of latitude has: each as wide as `degrees` of latitude are high, at the edge of the next band."""
    edge = F.least(F.lit(90.0), (F.greatest(F.abs(row), F.abs(row + 1)) + 1) * degrees)
    return F.greatest(F.lit(1), F.floor(360.0 * F.cos(F.radians(edge)) / degrees))


def _cell(lon: Column, n: Column) -> Column:
    return F.pmod(F.floor((lon + 180.0) / 360.0 * n), n)


def gridded(df: DataFrame, nm: float, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """df with the cell (_row, _cell) of each position, for distances up to `nm`; cells narrow towards the poles and close at 180 degrees."""
    degrees = nm / 59.9
    row = F.floor(F.col(lat) / degrees)
    return df.withColumns({"_row": row, "_cell": _cell(F.col(lon), _cells_in(row, degrees))})


def around(df: DataFrame, nm: float, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """df once for each of the up to nine cells in which a position within `nm` can lie."""
    degrees = nm / 59.9
    own = F.floor(F.col(lat) / degrees)
    rows = df.withColumn("_row", F.explode(F.sequence(own - 1, own + 1)))
    n = _cells_in(F.col("_row"), degrees)
    at = F.floor((F.col(lon) + 180.0) / 360.0 * n)
    return rows.withColumn("_cell", F.explode(F.array_distinct(F.transform(F.array(at - 1, at, at + 1), lambda c: F.pmod(c, n)))))


def unsent(df: DataFrame) -> DataFrame:
    """df, to be joined by shuffle: rows that an explode has made, and what compression hides, are not in the estimate of its size, by which Spark may send it whole through the driver."""
    return df.hint("merge")


def meetings(points: DataFrame, seconds: int, nm: float, apart: int, columns: list[str] | None = None, keys: list[str] | None = None, others: DataFrame | None = None) -> DataFrame:
    """Pairs of reports of two vessels (smaller id first) in the same bucket, at most `apart` seconds and `nm` from each other, across cell edges.

    columns: what else of the reports is given (by default speed and course); keys: columns in which the two are equal;
    others: the reports of the vessel with the larger id, if not `points` too.
    """
    cols, keys = ["vessel_id", "t", "lat", "lon", *(["sog", "cog"] if columns is None else columns)], keys or []
    side = lambda df, k: df.select("bucket", "slot", "_row", "_cell", *keys, *(F.col(c).alias(f"{c}_{k}") for c in cols))
    slots = lambda df: df.select(*keys, *cols).withColumns({"bucket": F.floor(F.col("t") / seconds), "slot": F.floor(F.col("t") / apart)})
    a = side(gridded(slots(points), nm), 1)
    b = side(around(slots(points if others is None else others), nm).withColumn("slot", F.explode(F.array(F.col("slot") - 1, F.col("slot"), F.col("slot") + 1))), 2)
    met = a.join(unsent(b), ["bucket", "slot", "_row", "_cell", *keys]).filter("vessel_id_1 < vessel_id_2").filter(F.abs(F.col("t_1") - F.col("t_2")) <= apart)
    return met.drop("slot", "_row", "_cell").withColumn("nm", haversine_nm("lat_1", "lon_1", "lat_2", "lon_2")).filter(F.col("nm") <= nm)


def runs_of_meetings(met: DataFrame, least: int) -> DataFrame:
    """Stretches of consecutive buckets in which a pair met, with the mean place of each bucket's meetings."""
    keys = ["vessel_id_1", "vessel_id_2"]
    each = met.groupBy(*keys, "bucket").agg(F.avg("lat_1").alias("lat"), F.avg("lon_1").alias("lon"))
    island = each.withColumn("_i", F.col("bucket") - F.row_number().over(Window.partitionBy(*keys).orderBy("bucket")))
    n = F.count("*").over(Window.partitionBy(*keys, "_i"))
    return island.withColumn("n", n).filter(F.col("n") >= least)


def successors(last: DataFrame, first: DataFrame, low: int, high: int) -> DataFrame:
    """Rows of last (t1) and first (t0) with t0 - t1 in (low, high], with `wait`; one bucket may hold all rows, so each bucket's `first` is dealt over several tasks."""
    size, deals = max(1, high - low), 4 * last.sparkSession.sparkContext.defaultParallelism
    a = last.withColumn("_b", F.explode(F.sequence(F.floor((F.col("t1") + low) / size), F.floor((F.col("t1") + high) / size)))).withColumn("_deal", F.explode(F.sequence(F.lit(0), F.lit(deals - 1))))
    b = first.withColumns({"_b": F.floor(F.col("t0") / size), "_deal": F.pmod(F.xxhash64(*first.columns), F.lit(deals)).cast("int")})
    wait = F.col("t0") - F.col("t1")
    return unsent(a).join(b, ["_b", "_deal"]).withColumn("wait", wait).filter((F.col("wait") > low) & (F.col("wait") <= high)).drop("_b", "_deal")


def turned(a: str, b: str) -> Column:
    """Angle between two courses, 0 to 180; null if either is."""
    return F.least(F.abs(F.col(a) - F.col(b)), 360 - F.abs(F.col(a) - F.col(b)))


def transfers_by_run(points: DataFrame, zones: DataFrame, ports: DataFrame, seconds: int = 900, nm: float = 0.108, apart: int = 900, knots: float = 1.0, least: int = 8, port_nm: float = 3.0) -> DataFrame:
    """Pairs that lie slow and (anti)parallel side by side for `least` buckets, away from ports; more points in a transfer zone.

    A missing course does not speak against a pair, a missing speed does.
    """
    angle = turned("cog_1", "cog_2")
    met = meetings(points, seconds, nm, apart).filter((F.col("sog_1") < knots) & (F.col("sog_2") < knots) & F.coalesce((angle <= 30) | (angle >= 150), F.lit(True)))
    keys = ["vessel_id_1", "vessel_id_2", "_i"]
    place = _cut(runs_of_meetings(met, least).withColumn("point_id", F.struct(*keys, "bucket")))  # read four times below
    spots = place.groupBy(*keys).agg(F.min("bucket").alias("first_bucket"), F.max("bucket").alias("last_bucket"), F.first("n").alias("n"))
    ported = near_port(place, ports, port_nm).select("point_id.vessel_id_1", "point_id.vessel_id_2", "point_id._i").distinct()
    zoned = in_zone(place, zones, "point_id").groupBy(*keys).agg(F.max(F.col("corridor_id").isNotNull()).alias("in_zone"))
    out = spots.join(ported, keys, "left_anti").join(zoned, keys)
    return out.select("vessel_id_1", "vessel_id_2", "first_bucket", "last_bucket", "n", F.when(F.col("in_zone"), 35).otherwise(25).alias("score"))


def convoys(points: DataFrame, seconds: int = 900, nm: float = 5.0, apart: int = 900, knots: float = 3.0, degrees: float = 15.0, least: int = 16, tiers: tuple[int, int] = (3, 4)) -> DataFrame:
    """Pairs under way on like courses for `least` buckets or more; a missing speed counts as 0."""
    speed = lambda c: F.coalesce(F.col(c), F.lit(0.0)) >= knots
    met = meetings(points, seconds, nm, apart).filter(speed("sog_1") & speed("sog_2") & (turned("cog_1", "cog_2") <= degrees))
    runs = runs_of_meetings(met, least).groupBy("vessel_id_1", "vessel_id_2", "_i").agg(F.first("n").alias("n"))
    return runs.select("vessel_id_1", "vessel_id_2", "n", F.when(F.col("n") >= tiers[1], 35).when(F.col("n") >= tiers[0], 25).otherwise(15).alias("score"))


def in_zone(df: DataFrame, zones: DataFrame, key: str, lat: str = "lat", lon: str = "lon", tolerance: float = 0.0) -> DataFrame:
    """df with the heaviest zone (then the smallest id) that holds its position, or nulls.

    Zones are cut into one-degree cells, so this is an equi-join whatever their number.
    """
    span = lambda a, b: F.sequence(F.floor(F.col(a) - tolerance), F.floor(F.col(b) + tolerance))
    z = zones.withColumn("_la", F.explode(span("min_lat", "max_lat"))).withColumn("_lo", F.explode(span("min_lon", "max_lon"))).withColumnRenamed("kind", "corridor_kind")
    p = df.select(key, lat, lon).withColumns({"_la": F.floor(lat), "_lo": F.floor(lon)})
    inside = p.join(small(z), ["_la", "_lo"]).filter(in_box(lat, lon, "min_lat", "max_lat", "min_lon", "max_lon", tolerance))
    best = inside.groupBy(key).agg(F.min_by(F.struct("corridor_id", F.col("weight").alias("corridor_weight"), "corridor_kind"), F.struct(-F.col("weight"), F.col("corridor_id"))).alias("_z"))
    return df.join(unsent(best.select(key, "_z.*")), key, "left")


def near_port(points: DataFrame, ports: DataFrame, nm: float) -> DataFrame:
    """point_id, port_id, nm: the nearest port of each report within a distance."""
    p = around(ports.select("port_id", F.col("lat").alias("port_lat"), F.col("lon").alias("port_lon")), nm, "port_lat", "port_lon")
    near = gridded(points.select("point_id", "lat", "lon"), nm).join(small(p), ["_row", "_cell"])
    near = near.withColumn("nm", haversine_nm("lat", "lon", "port_lat", "port_lon")).filter(F.col("nm") <= nm)
    return near.groupBy("point_id").agg(F.min_by(F.struct("port_id", "nm"), F.struct("nm", "port_id")).alias("_p")).select("point_id", "_p.*")


CELL = ("_slot", "_row", "_cell")


def near_in_space_and_time(left: DataFrame, right: DataFrame, nm: float, seconds: int, cells: bool = False) -> DataFrame:
    """Rows of left (lat_1, lon_1, t_1) and right (lat_2, lon_2, t_2) within a distance and a time of each other, with `nm`.

    With `cells` also the CELL of the row of left, which has one: pairs grouped by it and a key of left need no shuffle.
    """
    slot = lambda t: F.floor(F.col(t) / seconds)
    a = gridded(left, nm, "lat_1", "lon_1").withColumn("_slot", slot("t_1"))
    b = around(right, nm, "lat_2", "lon_2").withColumn("_slot", F.explode(F.array(slot("t_2") - 1, slot("t_2"), slot("t_2") + 1)))
    near = a.join(unsent(b), ["_slot", "_row", "_cell"]).filter(F.abs(F.col("t_1") - F.col("t_2")) <= seconds)
    near = near if cells else near.drop(*CELL)
    return near.withColumn("nm", haversine_nm("lat_1", "lon_1", "lat_2", "lon_2")).filter(F.col("nm") <= nm)


def overlapping(a: DataFrame, b: DataFrame, keys: list[str], day: int = 86_400) -> DataFrame:
    """Rows of a (start_1, end_1) and b (start_2, end_2) with equal keys whose intervals overlap, by buckets of a day."""
    spread = lambda df, s, e: df.withColumn("_d", F.explode(F.sequence(F.floor(F.col(s) / day), F.floor(F.col(e) / day))))
    pairs = unsent(spread(a, "start_1", "end_1")).join(unsent(spread(b, "start_2", "end_2")), [*keys, "_d"])
    later = F.floor(F.greatest("start_1", "start_2") / day)  # of the buckets that a pair shares, the first
    return pairs.filter((F.col("start_1") <= F.col("end_2")) & (F.col("start_2") <= F.col("end_1")) & (F.col("_d") == later)).drop("_d")


def counts_near(points: DataFrame, others: DataFrame, nm: float, seconds: int) -> DataFrame:
    """point_id, near: how many reports of other vessels lie within a distance and a time of each of `points`; none, no row.

    points: point_id and vessel_id, t, lat, lon, as others. Reports of one place and slot are one with their number, so
    distances are of places; a slot that lies whole within reach is counted as it is, of the two at the ends a running
    count over both reports and ends tells how many are within. What is compared does not grow with reports of one place.
    """
    known = lambda df: df.dropna(subset=["vessel_id", "t", "lat", "lon"])
    slot = F.floor(F.col("t") / seconds)
    a = known(points).select("point_id", F.col("vessel_id").alias("own"), F.col("t").alias("at"), F.col("lat").alias("lat_2"), F.col("lon").alias("lon_2"), slot.alias("_mid"))
    reports = known(others).select("vessel_id", "t", "lat", "lon", slot.alias("_slot"))
    spots = gridded(reports.groupBy("lat", "lon", "_slot").agg(F.count("*").alias("n")), nm)
    asked = around(a, nm, "lat_2", "lon_2").withColumn("_slot", F.explode(F.array(F.col("_mid") - 1, F.col("_mid"), F.col("_mid") + 1)))
    met = unsent(asked).join(spots, ["_slot", "_row", "_cell"]).filter(haversine_nm("lat", "lon", "lat_2", "lon_2") <= nm)
    side = F.col("_slot") - F.col("_mid")
    # an end counts what comes before it: the later one with reports of its own second, the earlier one without, and takes this from all
    end = F.when(side > 0, F.col("at") + seconds + 1).otherwise(F.col("at") - seconds)
    ends = met.select("lat", "lon", "_slot", end.alias("t"), "point_id", side.alias("_side"), F.col("n").alias("_n"))
    both = ends.unionByName(reports.select("lat", "lon", "_slot", "t"), allowMissingColumns=True)
    w = Window.partitionBy("lat", "lon", "_slot").orderBy("t").rangeBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.count(F.when(F.col("_side").isNull(), 1)).over(w), F.lit(0))
    total = both.withColumn("_b", before).filter("_side is not null").select("point_id", F.when(F.col("_side") > 0, F.col("_b")).when(F.col("_side") < 0, F.col("_n") - F.col("_b")).otherwise(F.col("_n")).alias("n"))
    own = a.withColumn("_slot", F.explode(F.array(F.col("_mid") - 1, F.col("_mid"), F.col("_mid") + 1))).join(unsent(reports.withColumnRenamed("vessel_id", "own")), ["own", "_slot"])
    own = own.filter((F.abs(F.col("t") - F.col("at")) <= seconds) & (haversine_nm("lat", "lon", "lat_2", "lon_2") <= nm)).select("point_id", F.lit(-1).cast("long").alias("n"))
    return total.unionAll(own).groupBy("point_id").agg(F.sum("n").alias("near")).filter("near > 0")
