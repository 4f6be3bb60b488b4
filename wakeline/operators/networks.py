"""Relations between vessels: successions scored for a merge, relay chains, fleets, routes, ownership, similarity."""

from __future__ import annotations

import pandas as pd
import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, Window

from wakeline.functions.geo import haversine_nm, haversine_nm_c, initial_bearing
from wakeline.functions.polygons import contains, meets
from wakeline.functions.prefixes import prefix_kind
from wakeline.operators.clusters import thinned_days
from wakeline.operators.pairs import meetings, successors, unsent

DAY = 86_400


def merge_candidates(points: DataFrame, vessels: DataFrame, met: tuple[int, float, int] | None, low: int, high: int, knots: float = 16.0, auto: int = 75) -> DataFrame:
    """dark_id, new_id, score, verdict: a vessel last seen and one first seen `low` to `high` seconds later, near enough to be the same.

    Evidence adds up: closeness, short wait, same flag, type and like size, same hull number; blocks: a meeting of the two
    (met: seconds, nm, apart of pairs.meetings), different hull numbers when both are sound.
    """
    at = lambda k, order: points.groupBy("vessel_id").agg(order(F.struct("t", "lat", "lon"), F.struct("t", "point_id")).alias(k)).select("vessel_id", f"{k}.*")
    last, first = at("l", F.max_by), at("f", F.min_by)
    a = last.select(F.col("vessel_id").alias("dark_id"), F.col("t").alias("t1"), F.col("lat").alias("lat1"), F.col("lon").alias("lon1"))
    b = first.select(F.col("vessel_id").alias("new_id"), F.col("t").alias("t0"), F.col("lat").alias("lat0"), F.col("lon").alias("lon0"))
    pairs = successors(a, b, low, high).filter("dark_id <> new_id").withColumn("nm", haversine_nm("lat1", "lon1", "lat0", "lon0"))
    pairs = pairs.filter(F.col("nm") <= knots * F.greatest(F.abs(F.col("wait")) / 3_600.0, F.lit(1.0)))
    side = lambda k, n: vessels.select(F.col("vessel_id").alias(k), *(F.col(c).alias(f"{c}_{n}") for c in ("flag", "kind", "dwt", "imo")))
    both = pairs.join(side("dark_id", 1), "dark_id").join(side("new_id", 2), "new_id")
    if met is not None:
        both = both.join(unsent(meetings_of_successors(points, *met, low, high)), ["dark_id", "new_id"], "left_anti")
    like = F.col("dwt_1") / F.nullif("dwt_2", F.lit(0.0))
    score = (
        F.when(F.col("nm") <= 10, 20).when(F.col("nm") <= 50, 10).otherwise(0) + F.when(F.abs("wait") <= 2 * DAY, 15).when(F.abs("wait") <= 7 * DAY, 10).otherwise(0)
        + F.when(F.col("flag_1") == F.col("flag_2"), 10).otherwise(0) + F.when(F.col("kind_1") == F.col("kind_2"), 15).otherwise(0)
        + F.when(like.between(0.8, 1.25), 20).otherwise(0) + F.when(F.col("imo_1") == F.col("imo_2"), 25).otherwise(0)
    )
    return both.select("dark_id", "new_id", score.alias("score")).withColumn("verdict", F.when(F.col("score") >= auto, "merge").when(F.col("score") >= 40, "review").otherwise("no"))


def meetings_of_successors(points: DataFrame, seconds: int, nm: float, apart: int, low: int, high: int) -> DataFrame:
    """dark_id < new_id of vessels that met, where new was first seen `low` to `high` seconds after dark was last seen; only reports of such vessels meet, by the day new was first seen."""
    each = points.groupBy("vessel_id").agg(F.min("t").alias("first"), F.max("t").alias("last"))
    p = points.select("vessel_id", "t", "lat", "lon").join(each, "vessel_id")
    day = lambda t: F.floor(t / DAY)
    dark = p.withColumn("_day", F.explode(F.sequence(day(F.col("last") + low), day(F.col("last") + high))))
    both = meetings(dark, seconds, nm, apart, ["first", "last"], ["_day"], p.withColumn("_day", day(F.col("first"))))
    wait = F.col("first_2") - F.col("last_1")
    return both.filter((wait > low) & (wait <= high)).select(F.col("vessel_id_1").alias("dark_id"), F.col("vessel_id_2").alias("new_id")).distinct()


def rekeyed(events: DataFrame, alias: DataFrame, key: str = "vessel_id", unique: tuple[str, ...] = ()) -> DataFrame:
    """events under canonical ids (alias: id, canonical); of rows that now clash on `unique`, the one that had the canonical id, then the smallest, stays."""
    out = events.join(alias.select(F.col("id").alias(key), "canonical"), key, "left").withColumn("absorbed_id", F.when(F.col("canonical").isNotNull(), F.col(key))).withColumn(key, F.coalesce("canonical", key)).drop("canonical")
    if not unique:
        return out
    w = Window.partitionBy(*unique).orderBy(F.col("absorbed_id").isNotNull(), "absorbed_id")
    return out.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def reversed_merge(alias: DataFrame, undone: DataFrame) -> DataFrame:
    """The alias table without the merges taken back (undone: id)."""
    return alias.join(undone.select("id"), "id", "left_anti")


def doubtful_merges(alias: DataFrame, vessels: DataFrame, suspects: DataFrame) -> DataFrame:
    """Merges either of whose vessels has a hull number under suspicion (suspects: imo)."""
    own = lambda k: vessels.select(F.col("vessel_id").alias(k), F.col("imo").alias(f"imo_{k}"))
    bad = suspects.select("imo").distinct()
    both = alias.join(own("id"), "id").join(own("canonical"), "canonical").select("id", "canonical", F.explode(F.array("imo_id", "imo_canonical")).alias("imo"))
    return both.join(bad, "imo", "left_semi").select("id", "canonical").distinct()


def relay_chains(transfers: DataFrame, component: DataFrame, least: int = 3) -> DataFrame:
    """component, hops, points: in each component of vessels the transfers in order of time, each taken if it goes on from a vessel reached already.

    transfers: a, b, t; component: node, component. The fold runs over one component's transfers.
    """
    rows = transfers.join(component, transfers.a == component.node).select("component", "a", "b", "t")

    def fold(x: pd.DataFrame) -> pd.DataFrame:
        x = x.sort_values(["t", "a", "b"])
        at, hops = None, 0
        for a, b in zip(x["a"], x["b"]):
            if at is None or a == at:
                at, hops = b, hops + 1
        return pd.DataFrame({"component": [x["component"].iloc[0]], "hops": [hops]})

    big = rows.groupBy("component").agg(F.count("*").alias("n")).filter(F.col("n") >= least).select("component")
    found = rows.join(big, "component", "left_semi").groupBy("component").applyInPandas(fold, "component long, hops long")
    return found.filter(F.col("hops") >= least).withColumn("points", F.when(F.col("hops") >= least + 1, 40).otherwise(20))


def fleet_patterns(gaps: DataFrame, fleets: DataFrame, days: int = 30, hours: int = 48) -> DataFrame:
    """fleet, pattern: three vessels or more of a fleet dark in one corridor within `days`, or dark in `hours` in one place; four flags or more."""
    g = gaps.join(fleets, "vessel_id")

    def crowded(keys: list[str], seconds: int, name: str) -> DataFrame:
        """Time is cut into buckets as long as the reach. Three vessels in one bucket are enough; a bucket with fewer is their
        first and last times, and is looked at with the one before: at a vessel's first time, who else was dark within reach?
        """
        own = ["fleet", *keys]
        each = g.groupBy(*own, F.floor(F.col("gap_start") / seconds).alias("_b"), "vessel_id").agg(F.min("gap_start").alias("lo"), F.max("gap_start").alias("hi"))
        some = F.struct("vessel_id", "lo", "hi")
        buckets = each.groupBy(*own, "_b").agg(F.count("*").alias("n"), F.min(some).alias("a"), F.max(some).alias("z"))
        both = F.array(F.struct("_b", F.lit(False).alias("before")), F.struct((F.col("_b") + 1).alias("_b"), F.lit(True).alias("before")))
        few = buckets.filter("n < 3").select(*own, F.explode(both).alias("at"), F.array_distinct(F.array("a", "z")).alias("v"))
        of = lambda before: F.flatten(F.collect_list(F.when(F.col("at.before") == before, F.col("v"))))  # noqa: E731  (two vessels at most)
        pair = few.groupBy(*own, "at._b").agg(of(False).alias("now"), of(True).alias("past"))
        ids = lambda vs: F.transform(vs, lambda x: x["vessel_id"])
        dark = lambda t: F.array_union(ids(F.filter("now", lambda y: y["lo"] <= t)), ids(F.filter("past", lambda y: y["hi"] >= t - seconds)))
        found = pair.filter(F.exists("now", lambda x: F.size(dark(x["lo"])) >= 3))
        return buckets.filter("n >= 3").select("fleet").unionAll(found.select("fleet")).distinct().select("fleet", F.lit(name).alias("pattern"))

    lane = crowded(["corridor_id"], days * DAY, "same_corridor") if "corridor_id" in gaps.columns else None
    g = g.withColumns({"_la": (F.col("lat") / 5).cast("int"), "_lo": (F.col("lon") / 5).cast("int")})
    place = crowded(["_la", "_lo"], hours * 3_600, "same_place")
    flags = g.groupBy("fleet").agg(F.countDistinct("flag").alias("n")).filter("n >= 4").select("fleet", F.lit("many_flags").alias("pattern"))
    return place.unionByName(flags) if lane is None else lane.unionByName(place).unionByName(flags)


def batch_renames(changes: DataFrame, fleets: DataFrame, days: int = 30, more_than: int = 3) -> DataFrame:
    """fleet, vessels: the most vessels of a fleet renamed within `days`, where more than `more_than`."""
    w = Window.partitionBy("fleet").orderBy("t").rangeBetween(-days * DAY, 0)
    n = changes.filter("field = 'name' and old is not null and old <> value").join(fleets, "vessel_id").withColumn("n", F.size(F.collect_set("vessel_id").over(w)))
    return n.groupBy("fleet").agg(F.max("n").alias("vessels")).filter(F.col("vessels") > more_than)


def segments(points: DataFrame, apart: int = 1_800, least: int = 3) -> DataFrame:
    """A row for each vessel and day with `least` reports: vessel_id, day, n, straightness (percent), bearing, nm, seconds, lat, lon, mean_sog of its track, thinned in order to reports `apart` seconds apart.

    A track without length is straight; without speeds the mean is that of the way.
    """
    p = points if "sog" in points.columns else points.withColumn("sog", F.lit(None).cast("double"))
    kept = thinned_days(p, DAY, apart, least).select("vessel_id", F.col("window").alias("day"), F.posexplode("w").alias("i", "x")).select("vessel_id", "day", "i", "x.*")
    w = Window.partitionBy("vessel_id", "day").orderBy("i")
    hop = kept.withColumn("_nm", haversine_nm_c(F.lag("lat").over(w), F.lag("lon").over(w), F.col("lat"), F.col("lon")))
    end = F.struct("lat", "lon", "t")
    day = hop.groupBy("vessel_id", "day").agg(F.count("*").alias("n"), F.sum("_nm").alias("nm"), F.min_by(end, "i").alias("a"), F.max_by(end, "i").alias("b"), F.avg("lat").alias("lat"), F.avg("lon").alias("lon"), F.avg("sog").alias("_sog"))
    ends = [F.col("a.lat"), F.col("a.lon"), F.col("b.lat"), F.col("b.lon")]
    seconds = F.col("b.t") - F.col("a.t")
    straight = F.when(F.col("nm") > 0, F.least(F.lit(100), F.floor(100 * haversine_nm_c(*ends) / F.col("nm")))).otherwise(100)
    speed = F.coalesce("_sog", F.when(seconds > 0, F.col("nm") / (seconds / 3_600.0)), F.lit(0.0))
    return day.select("vessel_id", "day", "n", straight.cast("long").alias("straightness"), initial_bearing(*ends).alias("bearing"), "nm", seconds.alias("seconds"), "lat", "lon", speed.alias("mean_sog"))


def similarity(features: DataFrame, pairs: DataFrame, flags: dict[str, float], weight: float = 0.5) -> DataFrame:
    """one, two, percent: 1 / (1 + d / 10) of the distance of two vessels' features (array v) and the shared attributes, weighted."""
    side = lambda k: features.select(F.col("vessel_id").alias(k), F.col("v").alias(f"v_{k}"), *(F.col(f).alias(f"{f}_{k}") for f in flags))
    both = pairs.join(side("one"), "one").join(side("two"), "two")
    d = F.sqrt(F.aggregate(F.zip_with("v_one", "v_two", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
    shared = sum((F.when(F.col(f"{f}_one") == F.col(f"{f}_two"), w).otherwise(0.0) for f, w in flags.items()), F.lit(0.0))
    return both.select("one", "two", F.floor(100 * (weight / (1 + d / 10) + (1 - weight) * shared) + 1e-9).alias("percent"))


def route_windows(calls: DataFrame, least: int = 3, most: int = 4) -> DataFrame:
    """route (ports in order), vessels, n: all runs of `least` to `most` ports in vessels' calls (vessel_id, port_id, t) that two or more share."""
    w = Window.partitionBy("vessel_id").orderBy("t", "port_id")
    ports = [F.lead("port_id", i).over(w).alias(f"p{i}") for i in range(most)]
    ahead = calls.select("vessel_id", *ports)
    runs = F.array(*(F.when(F.col(f"p{k - 1}").isNotNull(), F.concat_ws(">", *(F.col(f"p{i}").cast("string") for i in range(k)))) for k in range(least, most + 1)))
    return ahead.select("vessel_id", F.explode(F.array_compact(runs)).alias("route")).groupBy("route").agg(F.countDistinct("vessel_id").alias("vessels"), F.count("*").alias("n")).filter("vessels >= 2")


def next_ports(calls: DataFrame, history: int = 2) -> DataFrame:
    """vessel_id, port_id: the port that most often follows a vessel's last calls, over all vessels' calls."""
    w = Window.partitionBy("vessel_id").orderBy("t", "port_id")
    key = F.concat_ws(">", *(F.lag("port_id", i).over(w).cast("string") for i in range(history - 1, -1, -1)))
    seen = calls.select("vessel_id", "t", key.alias("seen"), F.lead("port_id").over(w).alias("next"), F.row_number().over(w).alias("k")).filter(F.col("k") >= history)
    often = seen.filter("next is not null").groupBy("seen", "next").agg(F.count("*").alias("n"))
    best = often.groupBy("seen").agg(F.min_by("next", F.struct((-F.col("n")).alias("n"), "next")).alias("port_id"))
    return seen.filter("next is null").select("vessel_id", "seen").join(best, "seen").select("vessel_id", "port_id")


def prefix_risks(vessels: DataFrame, prefix: Column) -> DataFrame:
    """vessel_id, kind, points: prefixes that nobody has, of landlocked states, of tiny territories."""
    kind = prefix_kind(prefix)
    points = F.when(kind == "unallocated", 35).when(kind == "landlocked", 20).when(kind == "tiny", 10)
    return vessels.select("vessel_id", kind.alias("kind"), points.alias("points")).filter("kind is not null")


def reused_hulls(vessels: DataFrame, scrapped: DataFrame, reports: DataFrame) -> DataFrame:
    """vessel_id, imo: vessels that report under the hull number of a scrapped ship (scrapped: imo, t) after it went."""
    last = reports.groupBy("vessel_id").agg(F.max("t").alias("last_t"))
    return vessels.select("vessel_id", "imo").join(scrapped.withColumnRenamed("t", "gone_t"), "imo").join(last, "vessel_id").filter("last_t > gone_t").select("vessel_id", "imo")


def transparency(owners: DataFrame, opaque: tuple[str, ...]) -> DataFrame:
    """owner, points: one ship only, opaque jurisdiction, young company, no officer; owners: owner, jurisdiction, founded, as_of (days), ships, officers."""
    points = F.when(F.col("ships") == 1, 15).otherwise(0) + F.when(F.col("jurisdiction").isin(*opaque), 20).otherwise(0) + F.when(F.col("as_of") - F.col("founded") < 730, 15).otherwise(0) + F.when(F.col("officers") == 0, 10).otherwise(0)
    return owners.select("owner", points.alias("points"))


def in_polygons(tracks: DataFrame, zones: DataFrame, key: str) -> DataFrame:
    """key, zone_id: the heaviest zone (zone_id, weight, ring), then the smallest id, that each segment (lat, lon, lat2, lon2) meets; by one-degree cells of both boxes."""
    span = lambda a, b: F.sequence(F.floor(a), F.floor(b))
    ring = F.col("ring")
    low, high = (lambda k: F.array_min(F.transform(ring, lambda p: p[k]))), (lambda k: F.array_max(F.transform(ring, lambda p: p[k])))
    z = zones.withColumn("_la", F.explode(span(low("lat"), high("lat")))).withColumn("_lo", F.explode(span(low("lon"), high("lon"))))
    t = tracks.withColumn("_la", F.explode(span(F.least("lat", "lat2"), F.greatest("lat", "lat2")))).withColumn("_lo", F.explode(span(F.least("lon", "lon2"), F.greatest("lon", "lon2"))))
    hit = t.join(z, ["_la", "_lo"]).filter(meets(ring, F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2")))
    return hit.groupBy(key).agg(F.min_by("zone_id", F.struct(-F.col("weight"), F.col("zone_id"))).alias("zone_id"))


def points_in_polygons(points: DataFrame, zones: DataFrame) -> DataFrame:
    """points with zone_id for each zone that holds them."""
    ring = F.col("ring")
    span = lambda k: F.sequence(F.floor(F.array_min(F.transform(ring, lambda p: p[k]))), F.floor(F.array_max(F.transform(ring, lambda p: p[k]))))
    z = zones.withColumn("_la", F.explode(span("lat"))).withColumn("_lo", F.explode(span("lon")))
    return points.withColumns({"_la": F.floor("lat"), "_lo": F.floor("lon")}).join(z, ["_la", "_lo"]).filter(contains(ring, F.col("lat"), F.col("lon"))).drop("_la", "_lo", "ring")


def sorted_name_pairs(names: DataFrame, column: str, most: int) -> DataFrame:
    """one, two: different names that share a word and, words sorted, are `most` edits apart; each pair once, in the block of its smallest shared word."""
    words = F.array_sort(F.array_distinct(F.split(column, " ")))
    n = names.select(F.col(column).alias("name"), words.alias("w"), F.array_join(F.array_sort(F.split(column, " ")), " ").alias("s")).distinct().withColumn("block", F.explode("w"))
    a, b = (n.select("block", F.col("name").alias(k), F.col("w").alias(f"w_{k}"), F.col("s").alias(f"s_{k}")) for k in ("one", "two"))
    near = a.join(b, "block").filter("one < two").filter(F.abs(F.length("s_one") - F.length("s_two")) <= most)
    near = near.filter(F.array_min(F.array_intersect("w_one", "w_two")) == F.col("block")).filter(F.levenshtein("s_one", "s_two") <= most)
    return near.select("one", "two")


def drift(now: DataFrame, before: DataFrame, volume_now: int, volume_before: int, change: float = 0.5, volume: float = 0.2) -> DataFrame:
    """detector, n_now, n_before, disable: counts that moved by more than `change` while the volume of reports moved by less than `volume`."""
    steady = abs(volume_now - volume_before) <= volume * max(1, volume_before)
    both = now.withColumnRenamed("n", "n_now").join(before.withColumnRenamed("n", "n_before"), "detector", "full").fillna(0, ["n_now", "n_before"])
    return both.withColumn("disable", F.lit(steady) & (F.abs(F.col("n_now") - F.col("n_before")) > change * F.greatest(F.lit(1), F.col("n_before"))))


def month_to_date(orders: DataFrame, month: str, budget: float, day_of_month: int) -> DataFrame:
    """provider, spent, orders, over: what each provider cost in a month (yyyy-MM), and whether its rate breaks the budget."""
    own = orders.filter(F.date_format("day", "yyyy-MM") == month).groupBy("provider").agg(F.sum(F.coalesce("cost", F.lit(0.0))).alias("spent"), F.count("*").alias("orders"))
    return own.select("provider", F.floor("spent").alias("spent"), "orders", (F.col("spent") / day_of_month * 30 > budget).alias("over"))


def due_exports(subscriptions: DataFrame, now: int) -> DataFrame:
    """subscription_id of the exports whose period (seconds) has passed since the last run, or that never ran."""
    return subscriptions.filter("active").filter(F.col("last_run").isNull() | (F.lit(now) - F.col("last_run") >= F.col("period"))).select("subscription_id")


def throttled(matches: DataFrame, log: DataFrame, seconds: int) -> DataFrame:
    """Rule matches (rule, vessel_id, t) without one of the same rule and vessel in the log within the window before; of several, the first of each window."""
    from wakeline.operators.sequence import near_times

    sent = log.select("rule", "vessel_id", F.col("t").alias("sent_t"))
    m = matches.withColumn("_k", F.concat_ws(":", "rule", "vessel_id"))
    old = near_times(m, sent.withColumn("_k", F.concat_ws(":", "rule", "vessel_id")).select("_k", "sent_t"), "t", "sent_t", seconds, 0, "_k").select("rule", "vessel_id", "t").distinct()
    fresh = matches.join(old, ["rule", "vessel_id", "t"], "left_anti")
    return fresh.groupBy("rule", "vessel_id", F.floor(F.col("t") / seconds).alias("slot")).agg(F.min("t").alias("t")).drop("slot")


def evidence(alerts: DataFrame, vessels: DataFrame, corridors: DataFrame, signals: DataFrame) -> DataFrame:
    """gap_id, card: one JSON text per alert with the vessel, the corridor, the silence and its signals."""
    s = signals.groupBy("gap_id").agg(F.array_sort(F.collect_list(F.struct("signal", "points"))).alias("signals"))
    one = alerts.select("gap_id", "vessel_id", "corridor_id", "gap_start", "duration_minutes", "score", "band").join(vessels.select("vessel_id", F.col("name").alias("vessel"), "imo"), "vessel_id", "left").join(corridors.select("corridor_id", "corridor"), "corridor_id", "left").join(s, "gap_id", "left")
    note = F.lit("An automated lead for analysts, not a finding.")
    return one.select("gap_id", F.to_json(F.struct("gap_id", "vessel", "imo", "corridor", "gap_start", "duration_minutes", "score", "band", "signals", note.alias("note"))).alias("card"))
