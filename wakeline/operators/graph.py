"""Graphs as edge tables: components, chains, bounded search."""

from __future__ import annotations

import tempfile
import uuid

import pyspark.sql.functions as F
from pyspark.sql import DataFrame


def components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node) over edges (a, b).

    Each round every node points at its smallest neighbour, pointers are followed, and the edges are drawn
    anew between the nodes pointed at; loops and repeats go. So the graph shrinks by a factor each round and
    long chains take as few rounds as short ones.
    """
    one_way = lambda df: _cut(df.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    left = one_way(edges.select("a", "b"))
    label = _cut(left.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("component", F.col("node")))
    while not left.isEmpty():
        ends = left.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("other")), F.struct(F.col("b").alias("node"), F.col("a").alias("other")))).alias("e")).select("e.*")
        point = _cut(ends.groupBy("node").agg(F.min(F.least("node", "other")).alias("to")))
        follow = lambda df, column: df.join(point.select(F.col("node").alias(column), "to"), column)
        far = _cut(follow(follow(point.withColumnRenamed("to", "x"), "x").select("node", F.col("to").alias("y")), "y").select(F.col("node").alias("x"), "to"))
        drawn = left.join(far.select(F.col("x").alias("a"), F.col("to").alias("to_a")), "a").join(far.select(F.col("x").alias("b"), F.col("to").alias("to_b")), "b")
        left = one_way(drawn.select(F.col("to_a").alias("a"), F.col("to_b").alias("b")))
        label = _cut(label.join(far.withColumnRenamed("x", "component"), "component", "left").select("node", F.coalesce("to", "component").alias("component")))
    return label


def _cut(df: DataFrame) -> DataFrame:
    """Writes a table in the shared folder and reads it back, which cuts lineage and size estimates; a folder of this machine only where none is set and Spark runs on this machine alone."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        folder = tempfile.gettempdir()
    path = f"{folder.rstrip('/')}/graph/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def canonical(links: DataFrame, hops: int = 20) -> DataFrame:
    """id, canonical: follows (id, merged_into) links up to `hops` times; a cycle ends at the smallest id met."""
    out = links.select("id", F.col("merged_into").alias("canonical"), F.array("id").alias("_path"))
    done = 1
    while done < hops:
        step = links.select(F.col("id").alias("canonical"), F.col("merged_into").alias("_next"))
        out = out.join(step, "canonical", "left")
        stop = F.col("_next").isNull() | F.array_contains("_path", F.col("_next"))
        out = _cut(out.select("id", F.when(stop, F.col("canonical")).otherwise(F.col("_next")).alias("canonical"), F.when(stop, F.col("_path")).otherwise(F.array_append("_path", F.col("canonical"))).alias("_path"), (~stop).alias("_moved")))
        if out.filter("_moved").isEmpty():
            break
        out = out.drop("_moved")
        done += 1
    return out.select("id", "canonical")


def reach(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """node, hops: nodes within `depth` steps of the seeds (column node) over edges (a, b), with the fewest steps."""
    found = seeds.select("node").distinct().withColumn("hops", F.lit(0))
    front = found
    for d in range(1, depth + 1):
        front = front.join(edges, front.node == edges.a).select(F.col("b").alias("node")).distinct().join(found, "node", "left_anti").withColumn("hops", F.lit(d))
        front = _cut(front)
        found = found.unionByName(front)
    return found


def chains(edges: DataFrame, depth: int) -> DataFrame:
    """root, node, hops, cycle: parents followed upwards over (child, parent); a chain that meets itself ends as a cycle."""
    out = edges.select(F.col("child").alias("root"), F.col("parent").alias("node"), F.lit(1).alias("hops"), F.array("child", "parent").alias("_path"), (F.col("child") == F.col("parent")).alias("cycle"))
    front = out
    for d in range(2, depth + 1):
        up = front.filter("not cycle").join(edges, front.node == edges.child).select("root", F.col("parent").alias("node"), F.lit(d).alias("hops"), "_path", "parent")
        front = _cut(up.select("root", "node", "hops", F.array_append("_path", F.col("parent")).alias("_path"), F.array_contains("_path", F.col("parent")).alias("cycle")))
        out = out.unionByName(front)
    return out.drop("_path")
