"""Geometry on the sphere as Spark columns; distances in nautical miles, angles in degrees."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
import pyspark.sql.functions as F
from pyspark.sql import Column

RADIUS_NM = 3440.065
RADIUS_M = 6_371_000.0


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def _haversine(lat1, lon1, lat2, lon2, radius: float) -> Column:
    lat1, lon1, lat2, lon2 = map(_c, (lat1, lon1, lat2, lon2))
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.lit(2 * radius) * F.atan2(F.sqrt(a), F.sqrt(F.greatest(F.lit(0.0), 1 - a)))


def haversine_nm(lat1, lon1, lat2, lon2) -> Column:
    return _haversine(lat1, lon1, lat2, lon2, RADIUS_NM)


def haversine_m(lat1, lon1, lat2, lon2) -> Column:
    return _haversine(lat1, lon1, lat2, lon2, RADIUS_M)


def haversine_nm_c(lat1, lon1, lat2, lon2) -> Column:
    """haversine_nm by the C library's functions, step by step as in the SQL: for shares that lie on a whole number, where the last bit counts. Null if any is."""

    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for a, b, c, d in batches:
            out = []
            for p, q, r, s in zip(a.tolist(), b.tolist(), c.tolist(), d.tolist()):
                x = math.pow(math.sin(math.radians(r - p) / 2), 2) + math.cos(math.radians(p)) * math.cos(math.radians(r)) * math.pow(math.sin(math.radians(s - q) / 2), 2)
                out.append(2 * RADIUS_NM * math.atan2(math.sqrt(x), math.sqrt(max(0.0, 1 - x))))
            yield pd.Series(out, dtype="float64")

    columns = [_c(x).cast("double") for x in (lat1, lon1, lat2, lon2)]
    known = columns[0].isNotNull() & columns[1].isNotNull() & columns[2].isNotNull() & columns[3].isNotNull()
    return F.when(known, F.pandas_udf(run, "double")(*(F.coalesce(x, F.lit(0.0)) for x in columns)))


def initial_bearing(lat1, lon1, lat2, lon2) -> Column:
    """0 to 360."""
    lat1, lon1, lat2, lon2 = map(_c, (lat1, lon1, lat2, lon2))
    d = F.radians(lon2 - lon1)
    y = F.sin(d) * F.cos(F.radians(lat2))
    x = F.cos(F.radians(lat1)) * F.sin(F.radians(lat2)) - F.sin(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.cos(d)
    return F.pmod(F.degrees(F.atan2(y, x)) + 360.0, F.lit(360.0))


def bearing_difference(a, b) -> Column:
    """0 to 180."""
    d = F.pmod(F.abs(_c(a) - _c(b)), F.lit(360.0))
    return F.least(d, 360.0 - d)


def destination(lat, lon, bearing, nm) -> tuple[Column, Column]:
    """Latitude and longitude reached from a point on a bearing over a distance."""
    lat, lon, bearing, d = F.radians(_c(lat)), F.radians(_c(lon)), F.radians(_c(bearing)), _c(nm) / RADIUS_NM
    to = F.asin(F.sin(lat) * F.cos(d) + F.cos(lat) * F.sin(d) * F.cos(bearing))
    return F.degrees(to), F.degrees(lon + F.atan2(F.sin(bearing) * F.sin(d) * F.cos(lat), F.cos(d) - F.sin(lat) * F.sin(to)))


def circle(lat, lon, nm, vertices: int = 36) -> Column:
    """Array of (lat, lon) around a point."""

    def vertex(i):
        a, o = destination(lat, lon, i * (360.0 / vertices), nm)
        return F.struct(a.alias("lat"), o.alias("lon"))

    return F.transform(F.sequence(F.lit(0), F.lit(vertices - 1)), vertex)


def wkt_bbox(wkt) -> Column:
    """(min_lon, min_lat, max_lon, max_lat) of all number pairs of a geometry text; null without any."""
    pairs = F.regexp_extract_all(_c(wkt), F.lit(r"(-?[0-9]+(?:\.[0-9]+)?)\s+(-?[0-9]+(?:\.[0-9]+)?)"), F.lit(0))
    lon = F.transform(pairs, lambda p: F.split(p, r"\s+")[0].cast("double"))
    lat = F.transform(pairs, lambda p: F.split(p, r"\s+")[1].cast("double"))
    return F.when(F.size(pairs) > 0, F.struct(F.array_min(lon).alias("min_lon"), F.array_min(lat).alias("min_lat"), F.array_max(lon).alias("max_lon"), F.array_max(lat).alias("max_lat")))


def in_box(lat, lon, min_lat, max_lat, min_lon, max_lon, tolerance: float = 0.0) -> Column:
    lat, lon, a, b, c, d = map(_c, (lat, lon, min_lat, max_lat, min_lon, max_lon))
    return lat.between(a - tolerance, b + tolerance) & lon.between(c - tolerance, d + tolerance)


def position_at(lat1, lon1, t1, lat2, lon2, t2, t) -> tuple[Column, Column]:
    """Linear position between two reports; times outside are clamped to the ends."""
    lat1, lon1, t1, lat2, lon2, t2, t = map(_c, (lat1, lon1, t1, lat2, lon2, t2, t))
    share = F.when(t2 > t1, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (t - t1) / (t2 - t1)))).otherwise(0.0)
    return lat1 + (lat2 - lat1) * share, lon1 + (lon2 - lon1) * share


def track(lat1, lon1, lat2, lon2, points: int = 15) -> Column:
    """Array of (lat, lon), `points` of them, on the straight line between two reports."""
    share = lambda i: i.cast("double") / (points - 1)
    step = lambda i: F.struct((_c(lat1) + (_c(lat2) - _c(lat1)) * share(i)).alias("lat"), (_c(lon1) + (_c(lon2) - _c(lon1)) * share(i)).alias("lon"))
    return F.transform(F.sequence(F.lit(0), F.lit(points - 1)), step)


def segment_distance_nm(lat, lon, lat1, lon1, lat2, lon2) -> Column:
    """Distance of a point from a segment, by projection on the local plane."""
    lat, lon, lat1, lon1, lat2, lon2 = map(_c, (lat, lon, lat1, lon1, lat2, lon2))
    k = F.cos(F.radians(lat))
    ax, ay, bx, by = (lon1 - lon) * k, lat1 - lat, (lon2 - lon) * k, lat2 - lat
    dx, dy = bx - ax, by - ay
    size = dx * dx + dy * dy
    t = F.when(size > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), -(ax * dx + ay * dy) / size))).otherwise(0.0)
    return F.sqrt(F.pow(ax + t * dx, 2) + F.pow(ay + t * dy, 2)) * (math.pi / 180 * RADIUS_NM)


def segment_meets_box(lat1, lon1, lat2, lon2, min_lat, max_lat, min_lon, max_lon) -> Column:
    """Whether a straight segment meets an axis-parallel rectangle (slab test)."""
    lat1, lon1, lat2, lon2, a, b, c, d = map(_c, (lat1, lon1, lat2, lon2, min_lat, max_lat, min_lon, max_lon))

    def slab(p, q, lo, hi):
        step = q - p
        one, two = (lo - p) / F.nullif(step, F.lit(0.0)), (hi - p) / F.nullif(step, F.lit(0.0))
        inside = p.between(lo, hi)
        return F.when(step == 0, F.when(inside, 0.0).otherwise(2.0)).otherwise(F.least(one, two)), F.when(step == 0, F.when(inside, 1.0).otherwise(-1.0)).otherwise(F.greatest(one, two))

    (e1, x1), (e2, x2) = slab(lat1, lat2, a, b), slab(lon1, lon2, c, d)
    return F.greatest(e1, e2, F.lit(0.0)) <= F.least(x1, x2, F.lit(1.0))
