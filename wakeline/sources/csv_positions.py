"""Position reports from CSV: names, checks and times."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, SparkSession

# Other names of the columns.
ALIASES = {
    "latitude": "lat", "longitude": "lon", "lng": "lon", "basedatetime": "timestamp", "datetime": "timestamp", "time": "timestamp", "# timestamp": "timestamp", "speed": "sog", "speed_over_ground": "sog", "course": "cog",
    "course_over_ground": "cog", "true_heading": "heading", "vesselname": "vessel_name", "shipname": "vessel_name", "name": "vessel_name", "vesseltype": "vessel_type", "ship_type": "vessel_type", "status": "nav_status", "navigational_status": "nav_status",
    "draft": "draught", "call_sign": "callsign", "imo_number": "imo", "transceiverclass": "ais_class",
}
REQUIRED = ("mmsi", "timestamp", "lat", "lon")
FORMATS = ("yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "dd/MM/yyyy HH:mm:ss", "yyyy/MM/dd HH:mm:ss", "MM/dd/yyyy HH:mm:ss", "yyyyMMdd HHmmss")
FASTEST = 35.0


def normalise(raw: DataFrame) -> DataFrame:
    """Lower-case names without byte order mark, aliases resolved; names the table has already win."""
    names = [c.lstrip("﻿").strip().lower() for c in raw.columns]
    taken, out = set(names), []
    for c in names:
        new = ALIASES.get(c, c)
        out.append(c if new != c and new in taken else new)
        taken.add(out[-1])
    df = raw.toDF(*out)
    missing = [c for c in REQUIRED if c not in df.columns]
    if missing:
        raise ValueError(f"columns missing: {', '.join(missing)}")
    return df


def parse_time(text: Column) -> Column:
    """Epoch seconds, ISO, or one of FORMATS; fractions beyond microseconds and a trailing UTC are cut."""
    t = F.trim(F.regexp_replace(F.regexp_replace(text, r"\s*(\+0000\s*)?UTC$", ""), r"(\.[0-9]{6})[0-9]+", "$1"))
    plain = F.regexp_replace(F.regexp_replace(t, r"\.[0-9]+", ""), "Z$", "")
    epoch = F.when(t.rlike(r"^[0-9]{10}(\.[0-9]+)?$"), F.timestamp_seconds(t.try_cast("double")))
    return F.coalesce(epoch, *(F.try_to_timestamp(plain, F.lit(f)) for f in FORMATS), F.when(t.rlike("^[0-9]{4}-"), t.try_cast("timestamp")))


def validate(raw: DataFrame, now: Column | None = None) -> DataFrame:
    """Typed rows with `reject`, the first failing rule or null, and sentinels set to null."""
    df = normalise(raw)
    num = lambda c: F.col(c).try_cast("double") if c in df.columns else F.lit(None).cast("double")
    mmsi, t = F.lpad(F.trim("mmsi"), 9, "0"), parse_time(F.col("timestamp").cast("string"))
    sog = F.when(num("sog") >= 102.2, None).otherwise(num("sog"))
    now = F.current_timestamp() if now is None else now
    reject = (
        F.when(~mmsi.rlike("^[0-9]{9}$") | mmsi.rlike("^(97[0-9]|99|00)"), "id")
        .when(num("lat").isNull() | num("lon").isNull() | ~num("lat").between(-90, 90) | ~num("lon").between(-180, 180), "position")
        .when((sog < 0) | (sog > FASTEST), "speed")
        .when(t.isNull() | (t > now + F.expr("interval 7 days")) | (F.year(t) < 2010), "time")
    )
    cog, heading = F.when(num("cog") < 360, num("cog")), F.when(num("heading") < 360, num("heading"))
    return df.select(mmsi.alias("mmsi"), t.alias("ts"), num("lat").alias("lat"), num("lon").alias("lon"), sog.alias("sog"), cog.alias("cog"), heading.alias("heading"), reject.alias("reject"))


def read_csv(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Accepted and rejected rows of CSV files with a header."""
    rows = validate(spark.read.csv(path, header=True))
    return rows.filter("reject is null").drop("reject"), rows.filter("reject is not null")
