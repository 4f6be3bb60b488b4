"""Polygons as columns: rings are arrays of (lon, lat) structs, parsed from WKT; planar tests in degrees."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import Column

NUMBER = r"-?[0-9]+(?:\.[0-9]+)?"


def ring(wkt: Column) -> Column:
    """The outer ring of a POLYGON text; null for other texts."""
    outer = F.regexp_extract(wkt, r"(?i)^\s*POLYGON\s*\(\(([^)]*)\)", 1)
    pair = lambda p: F.struct(F.split(F.trim(p), r"\s+")[0].cast("double").alias("lon"), F.split(F.trim(p), r"\s+")[1].cast("double").alias("lat"))
    return F.when(F.length(outer) > 0, F.transform(F.split(outer, ","), pair))


def _edges(r: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.size(r) - 1), lambda i: F.struct(F.get(r, i - 1).alias("a"), F.get(r, i).alias("b"), _way(F.get(r, i - 1), F.get(r, i)).alias("way")))


def _way(a, b) -> Column:
    """From corner to corner, as the difference of the numbers written (nine decimals): that of doubles is off by a bit, and so would be what lies on an edge."""
    return F.struct(F.round(b["lon"] - a["lon"], 9).alias("lon"), F.round(b["lat"] - a["lat"], 9).alias("lat"))


def contains(r: Column, lat: Column, lon: Column) -> Column:
    """Whether a point lies in a ring, by crossings of the ray to the east (edges count from below up to, not with, their top)."""

    def crosses(e):
        a, b = e["a"], e["b"]
        at = a["lon"] + (lat - a["lat"]) / F.nullif(e["way"]["lat"], F.lit(0.0)) * e["way"]["lon"]
        return ((a["lat"] > lat) != (b["lat"] > lat)) & F.coalesce(lon < at, F.lit(False))

    return F.size(F.filter(_edges(r), crosses)) % 2 == 1


def _side(a, way, c) -> Column:
    return F.signum(way["lon"] * (c["lat"] - a["lat"]) - way["lat"] * (c["lon"] - a["lon"]))


def meets(r: Column, lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Whether a straight segment meets a ring's inside or edge."""
    p, q = F.struct(lon1.alias("lon"), lat1.alias("lat")), F.struct(lon2.alias("lon"), lat2.alias("lat"))
    on = F.struct((lon2 - lon1).alias("lon"), (lat2 - lat1).alias("lat"))
    crossing = F.exists(_edges(r), lambda e: (_side(e["a"], e["way"], p) * _side(e["a"], e["way"], q) <= 0) & (_side(p, on, e["a"]) * _side(p, on, e["b"]) <= 0) & _boxes(e, p, q))
    return contains(r, lat1, lon1) | contains(r, lat2, lon2) | crossing


def _boxes(e, p, q) -> Column:
    """Whether the boxes of two segments overlap, which collinear ones need."""
    over = lambda k: (F.greatest(F.least(e["a"][k], e["b"][k]), F.least(p[k], q[k])) <= F.least(F.greatest(e["a"][k], e["b"][k]), F.greatest(p[k], q[k])))
    return over("lon") & over("lat")


def area(r: Column) -> Column:
    """Area in square degrees."""
    twice = F.aggregate(_edges(r), F.lit(0.0), lambda s, e: s + e["a"]["lon"] * e["b"]["lat"] - e["b"]["lon"] * e["a"]["lat"])
    return F.abs(twice) / 2


def centroid(r: Column) -> Column:
    """(lat, lon) of a ring's centre of area; of its corners' mean if it has none."""
    twice = F.aggregate(_edges(r), F.lit(0.0), lambda s, e: s + e["a"]["lon"] * e["b"]["lat"] - e["b"]["lon"] * e["a"]["lat"])
    part = lambda k: F.aggregate(_edges(r), F.lit(0.0), lambda s, e: s + (e["a"][k] + e["b"][k]) * (e["a"]["lon"] * e["b"]["lat"] - e["b"]["lon"] * e["a"]["lat"]))
    mean = lambda k: F.aggregate(r, F.lit(0.0), lambda s, x: s + x[k]) / F.size(r)
    return F.struct(F.coalesce(part("lat") / F.nullif(3 * twice, F.lit(0.0)), mean("lat")).alias("lat"), F.coalesce(part("lon") / F.nullif(3 * twice, F.lit(0.0)), mean("lon")).alias("lon"))


def edge_distance_nm(r: Column, lat: Column, lon: Column) -> Column:
    """Distance of a point from a ring's nearest edge."""
    from wakeline.functions.geo import segment_distance_nm

    return F.array_min(F.transform(_edges(r), lambda e: segment_distance_nm(lat, lon, e["a"]["lat"], e["a"]["lon"], e["b"]["lat"], e["b"]["lon"])))


def box_overlap(a: Column, b: Column) -> Column:
    """Shared over joint area of two boxes (min_lat, max_lat, min_lon, max_lon)."""
    side = lambda k: F.greatest(F.lit(0.0), F.least(a[f"max_{k}"], b[f"max_{k}"]) - F.greatest(a[f"min_{k}"], b[f"min_{k}"]))
    size = lambda x: (x["max_lat"] - x["min_lat"]) * (x["max_lon"] - x["min_lon"])
    both = side("lat") * side("lon")
    return both / F.nullif(size(a) + size(b) - both, F.lit(0.0))
