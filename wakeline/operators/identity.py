"""Detectors over changes of identity, cover, draught and destination."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, Window

from wakeline.functions.geo import haversine_nm
from wakeline.operators.pairs import meetings
from wakeline.operators.sequence import by_vessel, near_times

DAY = 86_400
# Least change of draught (m) and points, by deadweight.
DRAUGHT_STEPS = ((200_000, 3.0, 25), (120_000, 2.0, 20), (60_000, 1.5, 15), (0, 1.0, 15))


def real_changes(changes: DataFrame, field: str | None = None) -> DataFrame:
    """Changes whose value differs from the one before."""
    out = changes.filter("old is not null and old <> value")
    return out if field is None else out.filter(F.col("field") == field)


def counted_changes(changes: DataFrame, field: str, as_of: int, days: tuple[int, ...]) -> DataFrame:
    """vessel_id, n_<days>: how often a field changed in the days up to `as_of`, and `last`, the time of the last change."""
    seen = real_changes(changes, field).filter(F.col("t") <= as_of)
    n = [F.count_if(F.col("t") > as_of - d * DAY).alias(f"n_{d}") for d in days]
    return seen.groupBy("vessel_id").agg(*n, F.max("t").alias("last"))


def flag_hopping(changes: DataFrame, as_of: int, near_days: int = 7) -> DataFrame:
    """Vessels that changed flag 2 or 3 times in 90 days or 5 times in 365; halved if the manager changed about then."""
    n = counted_changes(changes, "flag", as_of, (90, 365))
    points = F.when(F.col("n_365") >= 5, 50).when(F.col("n_90") >= 3, 40).when(F.col("n_90") >= 2, 20)
    hops = n.withColumn("points", points).filter("points is not null")
    flags = real_changes(changes, "flag").filter(F.col("t") <= as_of).select("vessel_id", F.col("t").alias("flag_t"))
    owners = real_changes(changes, "manager").select("vessel_id", F.col("t").alias("owner_t"))
    sold = near_times(flags, owners, "flag_t", "owner_t", near_days * DAY, near_days * DAY).select("vessel_id").distinct().withColumn("sold", F.lit(True))
    out = hops.join(sold, "vessel_id", "left")
    return out.select("vessel_id", "n_90", "n_365", F.when(F.col("sold"), F.floor(F.col("points") / 2)).otherwise(F.col("points")).cast("int").alias("points"))


def insurer_cycling(changes: DataFrame, as_of: int) -> DataFrame:
    """Vessels with two or more changes of insurer in 90 days, and the present one."""
    n = counted_changes(changes, "insurer", as_of, (90,)).filter("n_90 >= 2")
    now = changes.filter((F.col("field") == "insurer") & (F.col("t") <= as_of)).groupBy("vessel_id").agg(F.max_by("value", F.struct("t", "change_id")).alias("insurer"))
    return n.join(now, "vessel_id").select("vessel_id", "n_90", "insurer", F.when(F.col("n_90") >= 3, 30).otherwise(20).alias("points"))


def insurance_gaps(changes: DataFrame, as_of: int, none: Column, least_days: int = 7) -> DataFrame:
    """Times without cover of `least_days` or more: from a change to no insurer to the next one, or to `as_of`."""
    w = Window.partitionBy("vessel_id").orderBy("t", "change_id")
    line = changes.filter((F.col("field") == "insurer") & (F.col("t") <= as_of)).select("vessel_id", "change_id", "t", none.alias("none"), F.lead("t").over(w).alias("next"))
    gaps = line.filter("none").withColumn("days", F.floor((F.coalesce("next", F.lit(as_of)) - F.col("t")) / DAY)).filter(F.col("days") >= least_days)
    points = F.when(F.col("days") >= 90, 40).when(F.col("days") >= 60, 30).when(F.col("days") >= 30, 20).otherwise(10)
    return gaps.select("vessel_id", "change_id", "days", F.col("next").isNull().alias("ongoing"), points.alias("points"))


def draught_changes(reports: DataFrame, vessels: DataFrame, ports: DataFrame | None, hours: int = 24, port_nm: float = 5.0) -> DataFrame:
    """Steps of draught within `hours` that the next reading confirms within half the threshold, away from ports."""
    from wakeline.operators.pairs import near_port

    w = by_vessel()
    seen = reports.filter("draught > 0").select("vessel_id", "point_id", "t", "lat", "lon", "draught", F.lag("draught").over(w).alias("before"), F.lag("t").over(w).alias("before_t"), F.lead("draught").over(w).alias("after"))
    least, points = F.lit(DRAUGHT_STEPS[-1][1]), F.lit(DRAUGHT_STEPS[-1][2])
    for dwt, step, p in reversed(DRAUGHT_STEPS[:-1]):
        least, points = F.when(F.col("dwt") >= dwt, step).otherwise(least), F.when(F.col("dwt") >= dwt, p).otherwise(points)
    sized = seen.join(vessels.select("vessel_id", "dwt"), "vessel_id").withColumns({"least": least, "points": points})
    found = sized.filter((F.col("t") - F.col("before_t") <= hours * 3_600) & (F.abs(F.col("draught") - F.col("before")) >= F.col("least")) & (F.abs(F.col("after") - F.col("draught")) <= F.col("least") / 2))
    if ports is not None:
        found = found.join(near_port(found, ports, port_nm).select("point_id"), "point_id", "left_anti")
    return found.select("vessel_id", "point_id", (F.col("draught") - F.col("before")).cast("int").alias("change"), "points")


def receivers_disagree(reports: DataFrame, seconds: int, nm: float, points: int = 30) -> DataFrame:
    """Pairs of reports of one vessel from different receivers, close in time and too far apart."""
    cols = ("point_id", "t", "lat", "lon", "source")
    a = reports.select("vessel_id", *(F.col(c).alias(f"{c}_1") for c in cols))
    b = reports.select("vessel_id", *(F.col(c).alias(f"{c}_2") for c in cols))
    near = near_times(a, b, "t_1", "t_2", 0, seconds).filter("source_1 <> source_2 and (t_2 > t_1 or point_id_2 > point_id_1)")
    return near.filter(haversine_nm("lat_1", "lon_1", "lat_2", "lon_2") > nm).select("vessel_id", "point_id_1", "point_id_2", F.lit(points).alias("points"))


def identity_swaps(points: DataFrame, changes: DataFrame, seconds: int, bucket: int, nm: float, apart: int, strict: bool = False, score: int = 50) -> DataFrame:
    """vessel_id_1 < vessel_id_2, field, met_t, points: pairs that met (as in pairs.meetings) and within `seconds` took over identities: what one gave up is what the other took (strict: and the reverse).

    Each report is joined with its vessel's changes to come, so only reports meet that have a value in common.
    """
    took = real_changes(changes).select("vessel_id", F.col("t").alias("change"), "field", F.col("value").alias("new"), "old")
    near = near_times(points.select("vessel_id", "t", "lat", "lon"), took, "t", "change", 0, seconds + apart)

    def side(gave: str, other: str) -> DataFrame:
        way = F.array(F.struct(F.lit(0).alias("way"), F.col(gave).alias("shared")), *([] if strict else [F.struct(F.lit(1).alias("way"), F.col(other).alias("shared"))]))
        return near.withColumn("_x", F.explode(way)).select("*", "_x.*").drop("_x")

    met = meetings(side("old", "new"), bucket, nm, apart, ["change", "new", "old"], ["field", "way", "shared"], side("new", "old"))
    met = met.withColumn("met_t", F.greatest("t_1", "t_2"))
    hits = met.filter(F.col("change_1").between(F.col("met_t"), F.col("met_t") + seconds) & F.col("change_2").between(F.col("met_t"), F.col("met_t") + seconds))
    if strict:
        hits = hits.filter(F.col("old_2") == F.col("new_1"))
    return hits.groupBy("vessel_id_1", "vessel_id_2", "field").agg(F.min("met_t").alias("met_t")).withColumn("points", F.lit(score))


BLANK = ("", "FOR ORDERS", "TBN", "UNKNOWN", "NONE", "ORDERS")


def destination_anomalies(reports: DataFrame, zones: DataFrame, as_of: int, europe: tuple[str, ...], blank: tuple[str, ...] = BLANK, many: int = 3, degrees: float = 45.0) -> DataFrame:
    """vessel_id, kind, points: a blank destination, more than `many` of them in 7 days, or a course to a transfer zone under a European port."""
    from wakeline.functions.geo import bearing_difference, initial_bearing

    week = reports.filter((F.col("t") > as_of - 7 * DAY) & (F.col("t") <= as_of))
    last = reports.filter(F.col("t") <= as_of).groupBy("vessel_id").agg(F.max_by(F.struct("destination", "lat", "lon"), F.struct("t", "point_id")).alias("x")).select("vessel_id", "x.*")
    empty = last.filter(F.coalesce("destination", F.lit("")).isin(*blank)).select("vessel_id", F.lit("blank").alias("kind"), F.lit(10).alias("points"))
    often = week.filter("destination is not null").groupBy("vessel_id").agg(F.countDistinct("destination").alias("n")).filter(F.col("n") > many).select("vessel_id", F.lit("often").alias("kind"), F.lit(20).alias("points"))
    courses = week.filter("cog is not null").groupBy("vessel_id").agg(F.sort_array(F.collect_list("cog")).alias("c"))  # a week of one vessel
    middle = courses.select("vessel_id", F.get("c", F.floor(F.size("c") / 2).cast("int")).alias("course"))
    z = zones.select(((F.col("min_lat") + F.col("max_lat")) / 2).alias("zone_lat"), ((F.col("min_lon") + F.col("max_lon")) / 2).alias("zone_lon")).withColumn("_k", F.lit(1))
    led = last.filter(F.col("destination").isin(*europe)).join(middle, "vessel_id").withColumn("_k", F.lit(1)).join(F.broadcast(z), "_k")  # the list of zones is configuration
    astray = led.filter(bearing_difference(initial_bearing("lat", "lon", "zone_lat", "zone_lon"), F.col("course")) <= degrees)
    return empty.unionByName(often).unionByName(astray.select("vessel_id", F.lit("astray").alias("kind"), F.lit(30).alias("points")).distinct())


# First and last code of ship types.
SHIP_TYPES = ((20, 29, "wing in ground"), (30, 30, "fishing"), (31, 32, "towing"), (33, 33, "dredging"), (34, 34, "diving"), (35, 35, "military"), (36, 36, "sailing"), (37, 37, "pleasure"), (40, 49, "high speed"), (50, 50, "pilot"), (51, 51, "rescue"), (52, 52, "tug"), (55, 55, "law enforcement"), (60, 69, "passenger"), (70, 79, "cargo"), (80, 89, "tanker"), (90, 99, "other"))
HAZARDS = {1: "A", 2: "B", 3: "C", 4: "D"}  # last digit of cargo and tanker codes


def ranged(value: Column, table, k: int, other=None) -> Column:
    """The k-th field of the row of `table` whose range holds a value."""
    out = F.lit(other)
    for low, high, *fields in reversed(table):
        out = F.when(value.between(low, high), fields[k]).otherwise(out)
    return out


def ship_type(code: Column) -> Column:
    kind = ranged(code, SHIP_TYPES, 0, "unknown")
    digit = code % 10
    hazard = F.lit(None).cast("string")
    for d, name in HAZARDS.items():
        hazard = F.when(digit == d, name).otherwise(hazard)
    return F.when(code.between(70, 89) & hazard.isNotNull(), F.concat(kind, F.lit(" hazard "), hazard)).otherwise(kind)
