"""Readers of landed vendor files: daily archives, REST and stream dumps, event, radar, scene, voyage and inspection files.

All give plain tables of typed columns; rows without an id, a time or a valid place are left out. Fetching is not done here.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, SparkSession

from wakeline.sources.csv_positions import parse_time

PLACED = "lat between -90 and 90 and lon between -180 and 180"


def _num(name: str) -> Column:
    return F.col(name).try_cast("double")


def _mmsi(c: Column) -> Column:
    return F.lpad(F.trim(c.cast("string")), 9, "0")


def _sound(df: DataFrame) -> DataFrame:
    return df.filter("mmsi rlike '^[0-9]{9}$' and ts is not null").filter(PLACED)


def _speed(c: Column) -> Column:
    return F.when(c < 102.2, c)


def _course(c: Column) -> Column:
    return F.when(c < 360, c)


def us_archive(spark: SparkSession, path: str, corridors: DataFrame | None = None, margin: float = 1.0) -> DataFrame:
    """Positions of US daily CSV files (plain or compressed), within the corridors' common box and a margin if given."""
    raw = spark.read.csv(path, header=True)
    raw = raw.toDF(*(c.strip().lower() for c in raw.columns))
    out = raw.select(
        _mmsi(F.col("mmsi")).alias("mmsi"), parse_time(F.col("basedatetime")).alias("ts"), _num("lat").alias("lat"), _num("lon").alias("lon"), _speed(_num("sog")).alias("sog"), _course(_num("cog")).alias("cog"),
        F.trim("vesselname").alias("name"), F.nullif(F.regexp_replace("imo", "[^0-9]", ""), F.lit("")).alias("imo"), F.col("vesseltype").try_cast("int").alias("type_code"), F.col("status").try_cast("int").alias("nav_status"), _num("draft").alias("draught"),
    )
    if corridors is not None:
        box = corridors.agg(F.min("min_lat").alias("a"), F.max("max_lat").alias("b"), F.min("min_lon").alias("c"), F.max("max_lon").alias("d")).first()  # one row
        out = out.filter(F.col("lat").between(box.a - margin, box.b + margin) & F.col("lon").between(box.c - margin, box.d + margin)) if box.a is not None else out.limit(0)
    return _sound(out)


def danish_archive(spark: SparkSession, path: str, kinds: tuple[str, ...] = ("Tanker",)) -> DataFrame:
    """Positions of Danish daily CSV files, of the ship types named (none: all)."""
    raw = spark.read.csv(path, header=True)
    raw = raw.toDF(*(c.strip(" #").lower() for c in raw.columns))
    out = raw.select(
        _mmsi(F.col("mmsi")).alias("mmsi"), F.try_to_timestamp("timestamp", F.lit("dd/MM/yyyy HH:mm:ss")).alias("ts"), _num("latitude").alias("lat"), _num("longitude").alias("lon"), _speed(_num("sog")).alias("sog"), _course(_num("cog")).alias("cog"),
        F.trim("name").alias("name"), F.nullif(F.regexp_replace("imo", "[^0-9]", ""), F.lit("")).alias("imo"), F.trim("ship type").alias("kind"), F.when(F.col("type of mobile").rlike("(?i)class a"), "A").when(F.col("type of mobile").rlike("(?i)class b"), "B").alias("ais_class"),
    )
    return _sound(out.filter(F.col("kind").isin(*kinds)) if kinds else out)


def tracks(spark: SparkSession, path: str) -> DataFrame:
    """Positions of landed Norwegian track files: arrays of reports."""
    raw = spark.read.schema("mmsi long, msgtime string, latitude double, longitude double, speedOverGround double, courseOverGround double, navigationalStatus int, name string").json(path, multiLine=True)
    return _sound(raw.select(_mmsi(F.col("mmsi")).alias("mmsi"), parse_time(F.regexp_replace("msgtime", r"\+00:00$", "Z")).alias("ts"), F.col("latitude").alias("lat"), F.col("longitude").alias("lon"), _speed(F.col("speedOverGround")).alias("sog"), _course(F.col("courseOverGround")).alias("cog"), F.col("navigationalStatus").alias("nav_status"), "name"))


def _decode(line: str) -> tuple[int, int, float, float, float, float] | None:
    """(mmsi, status, lat, lon, sog, cog) of a single-part position sentence of class A (types 1 to 3), else None."""
    part = line[line.find("!") :].split(",") if "!" in line else []
    if len(part) < 7 or part[1] != "1" or not part[5]:
        return None
    bits = 0
    for c in part[5]:
        v = ord(c) - 48
        bits = bits << 6 | (v - 8 if v > 40 else v) & 63
    size = 6 * len(part[5])

    def field(at: int, n: int, signed: bool = False) -> int:
        v = bits >> (size - at - n) & ((1 << n) - 1)
        return v - (1 << n) if signed and v >> (n - 1) else v

    if size < 168 or field(0, 6) not in (1, 2, 3):
        return None
    return field(8, 30), field(38, 4), field(89, 27, True) / 600_000, field(61, 28, True) / 600_000, field(50, 10) / 10, field(116, 12) / 10


def sentences(lines: DataFrame) -> DataFrame:
    """Positions decoded from lines (value, ts) of a receiver's stream, in batches; works on a streaming frame too."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [(ts, *d) for ts, d in zip(b["ts"], map(_decode, b["value"].fillna(""))) if d is not None]
            yield pd.DataFrame(got, columns=["ts", "id", "nav_status", "lat", "lon", "sog", "cog"])

    decoded = lines.select("value", "ts").mapInPandas(run, "ts timestamp, id long, nav_status int, lat double, lon double, sog double, cog double")
    return _sound(decoded.select(_mmsi(F.col("id")).alias("mmsi"), "ts", "lat", "lon", _speed(F.col("sog")).alias("sog"), _course(F.col("cog")).alias("cog"), "nav_status"))


def area_positions(spark: SparkSession, path: str) -> DataFrame:
    """Positions of landed area queries: [header, [reports]]; the header tells of errors."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json(F.get_json_object("value", "$[1]"), "array<struct<MMSI:long,TIME:string,LATITUDE:double,LONGITUDE:double,SOG:double,COG:double,NAVSTAT:int,IMO:long,NAME:string>>").alias("r"), F.get_json_object("value", "$[0].ERROR").alias("error"))
    r = raw.filter("coalesce(error, 'false') <> 'true'").select(F.explode("r").alias("r")).select("r.*")
    return _sound(r.select(_mmsi(F.col("MMSI")).alias("mmsi"), parse_time(F.regexp_replace("TIME", r" GMT$", "")).alias("ts"), F.col("LATITUDE").alias("lat"), F.col("LONGITUDE").alias("lon"), _speed(F.col("SOG")).alias("sog"), _course(F.col("COG")).alias("cog"), F.col("NAVSTAT").alias("nav_status"), F.trim("NAME").alias("name")))


NODES = "data struct<vessels:struct<nodes:array<struct<staticData:struct<mmsi:long,imo:long,name:string>,lastPositionUpdate:struct<timestamp:string,latitude:double,longitude:double,speed:double,course:double>>>>>"


def satellite_positions(spark: SparkSession, path: str) -> DataFrame:
    """Positions of landed pages of the satellite provider's graph queries."""
    n = spark.read.schema(NODES).json(path, multiLine=True).select(F.explode("data.vessels.nodes").alias("n")).select("n.staticData.*", "n.lastPositionUpdate.*")
    return _sound(n.select(_mmsi(F.col("mmsi")).alias("mmsi"), parse_time(F.col("timestamp")).alias("ts"), F.col("latitude").alias("lat"), F.col("longitude").alias("lon"), _speed(F.col("speed")).alias("sog"), _course(F.col("course")).alias("cog"), F.col("name")))


def within_quota(calls: DataFrame, month: str, quota: int) -> bool:
    """Whether fewer calls (ts) than the quota were made in a month (yyyy-MM)."""
    return calls.filter(F.date_format("ts", "yyyy-MM") == month).count() < quota


EVENT = "entries array<struct<id:string,type:string,start:string,end:string,position:struct<lat:double,lon:double>,vessel:struct<id:string,ssvid:string,name:string,flag:string>,encounter:struct<vessel:struct<ssvid:string>,medianDistanceKilometers:double>,port_visit:struct<startAnchorage:struct<name:string,flag:string>>,gap:struct<durationHours:double,distanceKm:double>>>"


def vendor_events(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Gaps, encounters and port visits of landed event pages; an event met twice counts once."""
    e = spark.read.schema(EVENT).json(path, multiLine=True).select(F.explode("entries").alias("e")).select("e.*").dropDuplicates(["id"])
    base = e.select("id", F.lower("type").alias("type"), F.lpad("vessel.ssvid", 9, "0").alias("mmsi"), F.col("vessel.name").alias("name"), parse_time(F.col("start")).alias("start"), parse_time(F.col("end")).alias("end"), F.col("position.lat").alias("lat"), F.col("position.lon").alias("lon"), "encounter", "port_visit", "gap")
    base = base.filter("start is not null and end >= start and mmsi rlike '^[0-9]{9}$'")
    keep = ("id", "mmsi", "name", "start", "end", "lat", "lon")
    gaps = base.filter("type = 'gap'").select(*keep, F.col("gap.durationHours").alias("hours"), (F.col("gap.distanceKm") / 1.852).alias("nm"))
    met = base.filter("type = 'encounter'").select(*keep, F.lpad("encounter.vessel.ssvid", 9, "0").alias("other_mmsi"), (F.col("encounter.medianDistanceKilometers") * 1_000).alias("metres"))
    visits = base.filter("type = 'port_visit'").select(*keep, F.col("port_visit.startAnchorage.name").alias("port"), F.col("port_visit.startAnchorage.flag").alias("country"))
    return gaps, met, visits


def radar_detections(spark: SparkSession, path: str, done: DataFrame | None = None) -> DataFrame:
    """corridor_id, day, lat, lon, detections, matched of landed sweeps; days of a corridor in `done` (corridor_id, day) are skipped."""
    raw = spark.read.schema("corridor_id int, date string, lat double, lon double, detections int, vesselIDs int").json(path)
    out = raw.select("corridor_id", F.to_date(F.try_to_timestamp("date", F.lit("yyyy-MM-dd"))).alias("day"), "lat", "lon", F.coalesce("detections", F.lit(1)).alias("detections"), (F.coalesce("vesselIDs", F.lit(0)) > 0).alias("matched")).filter("day is not null").filter(PLACED)
    return out if done is None else out.join(done.select("corridor_id", "day"), ["corridor_id", "day"], "left_anti")


def scenes(spark: SparkSession, path: str, most_cloud: float = 30.0) -> DataFrame:
    """scene_id, platform, start, cloud, footprint of a landed scene catalogue; optical scenes under clouds are left out."""
    v = spark.read.schema("value array<struct<Id:string,Name:string,ContentDate:struct<Start:string>,Footprint:string,Attributes:array<struct<Name:string,Value:string>>>>").json(path, multiLine=True).select(F.explode("value").alias("v")).select("v.*")
    cloud = F.get(F.filter("Attributes", lambda a: a["Name"] == "cloudCover"), F.lit(0))["Value"].try_cast("double")
    out = v.select(F.col("Id").alias("scene_id"), F.substring("Name", 1, 3).alias("platform"), parse_time(F.col("ContentDate.Start")).alias("start"), cloud.alias("cloud"), F.regexp_replace("Footprint", "^geography'SRID=4326;|'$", "").alias("footprint"))
    return out.filter(F.coalesce(F.col("cloud") <= most_cloud, F.lit(True)))


def voyages(spark: SparkSession, path: str, known: DataFrame) -> DataFrame:
    """Voyages of known vessels (imo) of landed cargo pages."""
    raw = spark.read.schema("data array<struct<id:string,ship_imo:string,departure_date:string,departure_port:string,arrival_port:string,commodity:string,value_tonne:double>>").json(path, multiLine=True).select(F.explode("data").alias("d")).select("d.*")
    out = raw.select(F.col("id").alias("voyage_id"), F.col("ship_imo").alias("imo"), F.to_date(F.try_to_timestamp(F.substring("departure_date", 1, 10), F.lit("yyyy-MM-dd"))).alias("departed"), "departure_port", "arrival_port", "commodity", F.col("value_tonne").alias("tonnes"))
    return out.join(known.select("imo").distinct(), "imo", "left_semi").dropDuplicates(["voyage_id"])


def enriched(vessels: DataFrame, *answers: DataFrame, key: str = "mmsi", fields: tuple[str, ...] = ("name", "imo", "flag", "dwt", "year_built", "kind")) -> DataFrame:
    """vessels with missing fields filled from the answers, the first that knows one wins; known values stay."""
    out = vessels
    for i, answer in enumerate(answers):
        has = [f for f in fields if f in answer.columns and f in vessels.columns]
        one = answer.groupBy(key).agg(*(F.max(f).alias(f"_{i}_{f}") for f in has))
        out = out.join(one, key, "left").withColumns({f: F.coalesce(f, f"_{i}_{f}") for f in has}).drop(*(f"_{i}_{f}" for f in has))
    return out


ROW, CELL = r"(?is)<tr[^>]*>(.*?)</tr>", r"(?is)<t[dh][^>]*>(.*?)</t[dh]>"


def registry_history(pages: DataFrame) -> DataFrame:
    """imo, company, role, since of the company tables in landed registry pages (imo, html)."""
    rows = pages.select("imo", F.explode(F.regexp_extract_all("html", F.lit(ROW), F.lit(1))).alias("r"))
    cells = F.transform(F.regexp_extract_all("r", F.lit(CELL), F.lit(1)), lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, "<[^>]*>", ""), r"\s+|&nbsp;", " ")))
    got = rows.select("imo", cells.alias("c")).filter("size(c) >= 3")
    return got.select("imo", F.get("c", F.lit(0)).alias("company"), F.get("c", F.lit(1)).alias("role"), F.coalesce(F.try_to_timestamp(F.get("c", F.lit(2)), F.lit("dd/MM/yyyy")), F.try_to_timestamp(F.get("c", F.lit(2)), F.lit("yyyy-MM-dd"))).cast("date").alias("since")).filter("since is not null")


def configured_zones(spark: SparkSession, zones: list[dict]) -> DataFrame:
    """A zone table (corridor_id by order of name) from parsed configuration: name, type, weight and a WKT polygon each."""
    from wakeline.functions.geo import wkt_bbox

    rows = [(i, z["name"], z.get("type", "export_route"), float(z.get("weight", 1.0)), z["geometry"]) for i, z in enumerate(sorted(zones, key=lambda z: z["name"]), 1)]
    if len({r[1] for r in rows}) < len(rows):
        raise ValueError("zone names must be unique")
    df = spark.createDataFrame(rows, "corridor_id int, corridor string, kind string, weight double, wkt string")
    return df.withColumn("b", wkt_bbox("wkt")).select("corridor_id", "corridor", "kind", "b.min_lat", "b.max_lat", "b.min_lon", "b.max_lon", "weight", "wkt")
