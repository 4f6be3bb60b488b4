"""Route templates: runs of port calls grouped greedily in order by the likeness of their ports, and the next port they foretell."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, Window

from wakeline.functions.geo import haversine_nm
from wakeline.functions.vessels import jaccard
from wakeline.operators.graph import _cut
from wakeline.operators.pairs import small

LIKE = 0.7


def call_runs(calls: DataFrame, least: int = 3, longest: int = 12) -> DataFrame:
    """vessel_id, length, start, route: every stretch of `least` to `longest` calls in a row of a vessel (calls: vessel_id, port_id, t)."""
    w = Window.partitionBy("vessel_id").orderBy("t", "port_id")
    ahead = calls.select("vessel_id", F.row_number().over(w).alias("start"), F.collect_list("port_id").over(w.rowsBetween(0, longest - 1)).alias("ports"))
    each = ahead.filter(F.size("ports") >= least).select("vessel_id", "start", "ports", F.explode(F.sequence(F.lit(least), F.size("ports"))).alias("length"))
    return each.select("vessel_id", "length", "start", F.slice("ports", F.lit(1), F.col("length")).alias("route"))


def like_sets(sets: DataFrame, least: float = LIKE) -> DataFrame:
    """a, b: sets (id, ports) with a Jaccard similarity of `least`, both ways; they share one of their rarest ports."""
    ranked = sets.select("id", F.size("ports").alias("n"), F.explode("ports").alias("port"))
    seen = ranked.groupBy("port").agg(F.count("*").alias("f"))
    at = F.row_number().over(Window.partitionBy("id").orderBy("f", "port"))
    first = ranked.join(seen, "port").withColumn("_at", at).filter(F.col("_at") <= F.col("n") - F.ceil(F.col("n") * least - 1e-9) + 1).select("id", "n", "port")
    other = first.select(F.col("id").alias("b"), F.col("n").alias("m"), "port")
    pairs = first.select(F.col("id").alias("a"), "n", "port").join(other, "port").filter((F.col("a") < F.col("b")) & (F.least("n", "m") >= least * F.greatest("n", "m") - 1e-9)).select("a", "b").distinct()
    of = lambda k: sets.select(F.col("id").alias(k), F.col("ports").alias(f"_{k}"))
    near = pairs.join(of("a"), "a").join(of("b"), "b").filter(jaccard(F.col("_a"), F.col("_b")) >= least).select("a", "b")
    return near.unionAll(near.select("b", "a"))


def leaders(nodes: DataFrame, near: DataFrame) -> DataFrame:
    """id, leader for nodes (id, order, unique): in order, a node that no earlier leader is like leads, others follow the first leader they are like.

    Each round all nodes lead that no undecided earlier node is like, and what is like them is decided; nodes far
    apart are decided at once, so the rounds are few whatever the number of nodes.
    """
    order = nodes.select("id", "order")
    left, led = _cut(order), None
    links = _cut(near.join(order.withColumnRenamed("id", "a").withColumnRenamed("order", "oa"), "a").join(order.withColumnRenamed("id", "b").withColumnRenamed("order", "ob"), "b").select("a", "b", "oa", "ob"))
    open_links = links
    while not left.isEmpty():
        later = open_links.filter("ob < oa").select(F.col("a").alias("id")).distinct()
        new = _cut(left.join(later, "id", "left_anti"))
        led = new if led is None else led.unionAll(new)
        gone = _cut(new.select("id").unionAll(open_links.join(new.select(F.col("id").alias("a")), "a", "left_semi").select("b")).distinct())
        left = _cut(left.join(gone, "id", "left_anti"))
        open_links = _cut(open_links.join(gone.withColumnRenamed("id", "a"), "a", "left_anti").join(gone.withColumnRenamed("id", "b"), "b", "left_anti"))
    if led is None:
        return order.select("id", F.col("id").alias("leader"))
    follow = links.join(led.select(F.col("id").alias("b")), "b", "left_semi").groupBy(F.col("a").alias("id")).agg(F.min_by("b", "ob").alias("leader"))
    return led.select("id", F.col("id").alias("leader")).unionAll(follow.join(led, "id", "left_anti").select("id", "leader"))


def templates(runs: DataFrame, kinds: DataFrame, least: float = LIKE) -> DataFrame:
    """template (its first run's order), route (the commonest of the group), frequency, kind (the commonest): groups of two runs or more.

    runs: as of call_runs, taken by vessel, length and start; kinds: vessel_id, kind. Ties go to the smaller route and kind.
    """
    r = runs.join(kinds.select("vessel_id", "kind"), "vessel_id", "left").withColumn("ports", F.array_sort(F.array_distinct("route"))).withColumn("id", F.concat_ws(",", F.col("ports").cast("array<string>")))
    sets = _cut(r.groupBy("id").agg(F.first("ports").alias("ports"), F.min(F.struct("vessel_id", "length", "start")).alias("order")))
    group = leaders(sets, like_sets(sets, least))
    named = r.join(group, "id")
    most = lambda c: named.filter(F.col(c).isNotNull()).groupBy("leader", c).agg(F.count("*").alias("n")).groupBy("leader").agg(F.min_by(c, F.struct(-F.col("n"), F.col(c))).alias(c))
    total = named.groupBy("leader").agg(F.count("*").alias("frequency")).filter("frequency >= 2")
    first = sets.select(F.col("id").alias("leader"), F.col("order").alias("template"))
    return total.join(first, "leader").join(most("route"), "leader").join(most("kind"), "leader", "left").select("template", "route", "frequency", "kind")


def foretold(calls: DataFrame, known: DataFrame, positions: DataFrame, zones: DataFrame, recent: int = 10, nm: float = 100.0, least: float = LIKE) -> DataFrame:
    """vessel_id, template, port_id, likeness, deviation: the port after the last one in the template most like the last `recent` calls (the first of equals).

    A template that does not hold the last port, or ends with it, foretells its first port. deviation: 25 if the
    vessel's last report (positions: vessel_id, lat, lon, t) is within `nm` of the centre of a transfer zone.
    """
    back = Window.partitionBy("vessel_id").orderBy(F.desc("t"), F.desc("port_id"))
    last = calls.withColumn("_r", F.row_number().over(back)).filter(F.col("_r") <= recent)
    own = last.groupBy("vessel_id").agg(F.array_sort(F.collect_set("port_id")).alias("ports"), F.min_by("port_id", "_r").alias("last"), F.count("*").alias("n")).filter("n >= 2")
    t = known.select("template", "route", F.array_distinct("route").alias("held"))
    meet = own.select("vessel_id", "ports", "last", F.explode("ports").alias("port")).join(t.select("template", "route", "held", F.explode("held").alias("port")), "port").dropDuplicates(["vessel_id", "template"])
    like = meet.withColumn("likeness", jaccard(F.col("ports"), F.col("held"))).filter(F.col("likeness") >= least)
    best = like.groupBy("vessel_id").agg(F.min_by(F.struct("template", "route", "last", "likeness"), F.struct(-F.col("likeness"), F.col("template"))).alias("b")).select("vessel_id", "b.*")
    at = F.array_position("route", F.col("last")).cast("int")
    following: Column = F.when((at > 0) & (at < F.size("route")), F.get("route", at)).otherwise(F.get("route", F.lit(0)))
    centre = zones.filter("kind = 'sts_zone'").select(((F.col("min_lat") + F.col("max_lat")) / 2).alias("_la"), ((F.col("min_lon") + F.col("max_lon")) / 2).alias("_lo"))
    spot = positions.groupBy("vessel_id").agg(F.max_by(F.struct("lat", "lon"), F.struct("t", "lat")).alias("p")).select("vessel_id", "p.*")
    reach = nm / 59.0
    cells = centre.withColumn("_r", F.explode(F.sequence(F.floor((F.col("_la") - reach) / reach), F.floor((F.col("_la") + reach) / reach))))
    near = spot.withColumn("_r", F.floor(F.col("lat") / reach)).join(small(cells), "_r").filter(haversine_nm("lat", "lon", "_la", "_lo") <= nm).select("vessel_id").distinct().withColumn("_near", F.lit(25))
    return best.join(near, "vessel_id", "left").select("vessel_id", "template", following.alias("port_id"), "likeness", F.coalesce("_near", F.lit(0)).alias("deviation"))
