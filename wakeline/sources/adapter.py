"""The analytic tables (positions, vessels, ports, corridors, transfers) read from the benchmark tables."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession, Window

STATUS = {"view": 0, "click": 1, "signup": 3, "purchase": 15, "error": 5}
# corridor_id, name, kind, min_lat, max_lat, min_lon, max_lon, weight
CORRIDORS = (
    (1, "north lane", "export_route", 0.0, 1.0, 0.0, 1.0, 1.5),
    (2, "anchorage", "anchorage_holding", 1.0, 1.5, 1.0, 2.0, 1.0),
    (3, "transfer zone", "sts_zone", 1.5, 2.5, 0.5, 1.5, 1.5),
    (4, "strait", "export_route", 2.5, 3.0, 2.0, 4.0, 1.5),
    (5, "jamming area", "dark_zone", 0.5, 1.5, 2.5, 3.5, 1.0),
    (6, "trade route", "legitimate_trade_route", 3.0, 4.0, 3.0, 4.0, 0.7),
)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vessel_id, point_id, t (epoch seconds), sog, cog, nav_status, lat, lon, value, k."""
    status = F.create_map(*(F.lit(x) for p in STATUS.items() for x in p))
    k = F.get_json_object("props", "$.k").cast("int")
    home = (F.col("user_id") % 3).cast("double")
    return read(spark, sf_dir, "events").select(
        F.col("user_id").alias("vessel_id"),
        F.col("event_id").alias("point_id"),
        F.expr("timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', ts)").alias("t"),
        (F.col("value") / 10.0).alias("sog"),
        (k * 37 % 360).alias("cog"),
        F.element_at(status, F.col("event_type")).alias("nav_status"),
        (home + (F.col("event_id") * 7919 % 200).cast("double") / 100.0).alias("lat"),
        (home + (F.col("event_id") * 104729 % 200).cast("double") / 100.0).alias("lon"),
        "value",
        k.alias("k"),
    )


def vessels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vessel_id, name, flag, flag_id, dwt, kind, year_built, imo."""
    return read(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("vessel_id"),
        F.col("c_name").alias("name"),
        F.concat(F.lit("NATION_"), F.col("c_nationkey").cast("string")).alias("flag"),
        F.col("c_nationkey").alias("flag_id"),
        ((F.col("c_acctbal") + 1000.0) * 20.0).alias("dwt"),
        F.col("c_mktsegment").alias("kind"),
        (1980 + F.col("c_custkey") % 45).cast("int").alias("year_built"),
        F.lpad((F.col("c_custkey") * 7919 % 9_000_000 + 1_000_000).cast("string"), 7, "0").alias("imo"),
    )


def corridors(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(CORRIDORS), "corridor_id int, corridor string, kind string, min_lat double, max_lat double, min_lon double, max_lon double, weight double")


def ports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """port_id, port, lat, lon; one per nation."""
    n = F.col("n_nationkey")
    return read(spark, sf_dir, "nation").select(n.alias("port_id"), F.col("n_name").alias("port"), (n * 16).cast("double") / 100.0, (n * 7 % 25 * 16).cast("double") / 100.0).toDF("port_id", "port", "lat", "lon")


def transfers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """transfer_id, vessel_1 (customer), vessel_2 (supplier, numbered after the customers' ids times 1), day."""
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("transfer_id"), F.col("o_custkey").alias("vessel_1"), F.col("o_orderdate").alias("at"))
    line = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("transfer_id"), F.col("l_suppkey").alias("vessel_2"))
    return o.join(line, "transfer_id").select("transfer_id", "vessel_1", "vessel_2", F.to_date("at").alias("day"))


FIELDS = ("flag", "name", "callsign", "insurer", "manager")
VALUES = (25, 40, 60, 6, 8)  # how many values a field takes
EPOCH = 1_704_067_200  # the first day of the reports
DESTINATIONS = ("ROTTERDAM", "", "SUEZ", "FOR ORDERS", "KALAMATA", "CEYHAN", "AUGUSTA", "SINGAPORE")


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vessel_id, change_id, t, field, value (a number), old (the value before, null for the first)."""
    k = F.col("o_orderkey")
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), (k % len(FIELDS) + 1).cast("int"))
    at = F.lit(EPOCH).cast("long") + (k * 7919 % 120 - 60) * 86_400 + k % 24 * 3_600
    rows = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("vessel_id"), k.alias("change_id"), at.alias("t"), pick(FIELDS).alias("field"), (k * 31 % pick(VALUES)).alias("value"))
    w = Window.partitionBy("vessel_id", "field").orderBy("t", "change_id")
    return rows.withColumn("old", F.lag("value").over(w)).withColumn("old_change", F.lag("change_id").over(w))


def voyages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """positions with draught, declared destination and receiver."""
    k = F.col("k")
    names = F.element_at(F.array(*map(F.lit, DESTINATIONS)), (k % len(DESTINATIONS) + 1).cast("int"))
    return positions(spark, sf_dir).withColumns({"draught": (k % 12 + 4).cast("double"), "destination": F.when(k % 11 > 0, names), "source": (k % 3).cast("int")})


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """detection_id, t, lat, lon, length, heading: radar detections, from the reports of status 5."""
    p = positions(spark, sf_dir).filter("nav_status = 5")
    return p.select(F.col("point_id").alias("detection_id"), "t", "lat", "lon", (F.floor("value") % 300 + 20).cast("int").alias("length"), (F.col("k") * 13 % 360).cast("int").alias("heading"))


def lights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """light_id, t, lat, lon, quality: night-light detections, from the reports of status 1."""
    p = positions(spark, sf_dir).filter("nav_status = 1")
    return p.select(F.col("point_id").alias("light_id"), "t", "lat", "lon", (F.col("k") % 2).cast("int").alias("quality"))
