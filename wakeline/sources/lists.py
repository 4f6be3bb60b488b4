"""Reference lists: labelled vessels, night lights, sanction entities, feature collections."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession


def ground_truth(spark: SparkSession, path: str, label: str) -> DataFrame:
    """imo, mmsi, vessel_name, date_listed and the label of a CSV with a header; blanks are null."""
    raw = spark.read.csv(path, header=True)
    blank = lambda c: F.nullif(F.trim(c), F.lit("")).alias(c)
    return raw.select(*(blank(c) for c in ("imo", "mmsi", "vessel_name")), F.to_date(F.try_to_timestamp("date_listed", F.lit("yyyy-MM-dd"))).alias("date_listed"), F.lit(label).alias("label"))


def linked(rows: DataFrame, vessels: DataFrame) -> DataFrame:
    """Rows with the vessel_id found by imo, else by mmsi; the smallest id of several."""
    by = lambda c: vessels.filter(F.col(c).isNotNull()).groupBy(c).agg(F.min("vessel_id").alias(f"by_{c}"))
    return rows.join(by("imo"), "imo", "left").join(by("mmsi"), "mmsi", "left").withColumn("vessel_id", F.coalesce("by_imo", "by_mmsi")).drop("by_imo", "by_mmsi")


def night_lights(spark: SparkSession, path: str) -> DataFrame:
    """ts, lat, lon, radiance of a night-light CSV's boats (quality flag 1)."""
    raw = spark.read.csv(path, header=True)
    raw = raw.toDF(*(c.strip().lower() for c in raw.columns))
    num = lambda c: F.col(c).try_cast("double")
    rows = raw.filter(F.col("qf_detect").try_cast("int") == 1).select(F.col("date_mscan").try_cast("timestamp").alias("ts"), num("lat_dnb").alias("lat"), num("lon_dnb").alias("lon"), num("rad_dnb").alias("radiance"))
    return rows.filter("ts is not null and lat between -90 and 90 and lon between -180 and 180")


ENTITY = "id string, schema string, caption string, properties struct<name:array<string>,imoNumber:array<string>,mmsi:array<string>,flag:array<string>>, first_seen string"


def entities(spark: SparkSession, path: str, lines: bool = True) -> DataFrame:
    """entity_id, name, imo (digits), mmsi, flag, listed of the vessels in an entity file (JSON lines, or one array)."""
    raw = spark.read.schema(ENTITY).json(path, multiLine=not lines).filter("schema = 'Vessel'")
    p = F.col("properties")
    return raw.select(
        F.col("id").alias("entity_id"), F.coalesce(F.get(p["name"], F.lit(0)), F.col("caption")).alias("name"), F.nullif(F.regexp_replace(F.get(p["imoNumber"], F.lit(0)), "[^0-9]", ""), F.lit("")).alias("imo"),
        F.get(p["mmsi"], F.lit(0)).alias("mmsi"), F.upper(F.get(p["flag"], F.lit(0))).alias("flag"), F.to_date(F.try_to_timestamp(F.substring("first_seen", 1, 10), F.lit("yyyy-MM-dd"))).alias("listed"),
    )


FEATURES = "features array<struct<mmsi:long,geometry:struct<coordinates:array<double>>,properties:struct<sog:double,cog:double,heading:double,navStat:int,timestampExternal:long>>>"


def features(spark: SparkSession, path: str) -> DataFrame:
    """mmsi, ts, lat, lon, sog, cog, nav_status of landed feature collections of positions."""
    f = spark.read.schema(FEATURES).json(path, multiLine=True).select(F.explode("features").alias("f"))
    p, at = F.col("f.properties"), F.col("f.geometry.coordinates")
    rows = f.select(
        F.lpad(F.col("f.mmsi").cast("string"), 9, "0").alias("mmsi"), F.timestamp_millis(p["timestampExternal"]).alias("ts"), F.get(at, F.lit(1)).alias("lat"), F.get(at, F.lit(0)).alias("lon"),
        F.when(p["sog"] < 102.2, p["sog"]).alias("sog"), F.when(p["cog"] < 360, p["cog"]).alias("cog"), p["navStat"].alias("nav_status"),
    )
    return rows.filter("mmsi is not null and ts is not null and lat between -90 and 90 and lon between -180 and 180")


SDN = "ent_num string, name string, kind string, program string, title string, callsign string, vessel_type string, tonnage string, grt string, flag string, owner string, remarks string"


def sanctioned_vessels(spark: SparkSession, path: str) -> DataFrame:
    """entry_id, name, flag, imo, mmsi of the vessels of a sanctions CSV, whether it has a header or not; '-0-' is null."""
    raw = spark.read.schema(SDN).csv(path, quote='"', escape='"').filter(F.lower(F.trim("kind")) == "vessel")
    clean = lambda c: F.nullif(F.nullif(F.trim(c), F.lit("-0-")), F.lit(""))
    found = lambda pattern: F.nullif(F.regexp_extract(F.coalesce("remarks", F.lit("")), pattern, 1), F.lit(""))
    return raw.select(F.trim("ent_num").alias("entry_id"), clean("name").alias("name"), clean("flag").alias("flag"), found(r"(?i)IMO\s*([0-9]{7})").alias("imo"), found(r"(?i)MMSI\s*([0-9]{9})").alias("mmsi"))


def listed_csv(spark: SparkSession, path: str, names: dict[str, str]) -> DataFrame:
    """name, imo (7 digits), mmsi, flag, listed of a CSV list; `names` gives the list's column for each."""
    raw = spark.read.csv(path, header=True)
    raw = raw.toDF(*(c.strip().lower() for c in raw.columns))
    have = lambda k: F.nullif(F.trim(names[k]), F.lit("")) if names.get(k) in raw.columns else F.lit(None).cast("string")
    imo = F.regexp_extract(F.coalesce(have("imo"), F.lit("")), "([0-9]{7})", 1)
    return raw.select(have("name").alias("name"), F.nullif(imo, F.lit("")).alias("imo"), have("mmsi").alias("mmsi"), have("flag").alias("flag"), F.to_date(F.try_to_timestamp(F.substring(F.coalesce(have("listed"), F.lit("")), 1, 10), F.lit("yyyy-MM-dd"))).alias("listed")).filter("name is not null or imo is not null or mmsi is not null")


def listed_json(spark: SparkSession, path: str) -> DataFrame:
    """name, imo, mmsi, flag of a JSON array of vessels."""
    raw = spark.read.schema("name string, imo string, mmsi string, flag string").json(path, multiLine=True)
    return raw.select("name", F.nullif(F.regexp_replace(F.coalesce("imo", F.lit("")), "[^0-9]", ""), F.lit("")).alias("imo"), "mmsi", F.upper("flag").alias("flag")).filter("name is not null or imo is not null")


def stub_vessels(entries: DataFrame, vessels: DataFrame) -> DataFrame:
    """Entries with the vessel found by imo, else mmsi, else exact name; the rest with a new id from the hash of what names them, `stub` set."""
    found = linked(entries, vessels)
    by_name = vessels.groupBy(F.upper("name").alias("_n")).agg(F.min("vessel_id").alias("_by_name"))
    named = found.join(by_name, F.upper(found.name) == F.col("_n"), "left").drop("_n")
    known = F.coalesce("vessel_id", "_by_name")
    return named.withColumns({"stub": known.isNull(), "vessel_id": F.coalesce(known, F.xxhash64("imo", "mmsi", "name"))}).drop("_by_name")


def inspections(spark: SparkSession, path: str, as_of: str, recent_days: int = 1095) -> tuple[DataFrame, DataFrame]:
    """Inspections (inspection_id, imo, day, detained, deficiencies) of a JSON file, and per hull the recent ones, detentions and worst."""
    raw = spark.read.schema("id string, imo string, date string, detained boolean, deficiencies int, ban boolean").json(path, multiLine=True).dropDuplicates(["id"])
    rows = raw.select(F.col("id").alias("inspection_id"), "imo", F.to_date(F.try_to_timestamp("date", F.lit("yyyy-MM-dd"))).alias("day"), (F.coalesce("detained", F.lit(False)) | F.coalesce("ban", F.lit(False))).alias("detained"), F.coalesce("deficiencies", F.lit(0)).alias("deficiencies")).filter("imo is not null and day is not null")
    recent = rows.filter(F.date_diff(F.lit(as_of).cast("date"), "day").between(0, recent_days))
    return rows, recent.groupBy("imo").agg(F.count("*").alias("inspections"), F.count_if("detained").alias("detentions"), F.max("deficiencies").alias("worst"), F.max("day").alias("last_day"))
