"""Lists, counts, groups, rates and accuracy over alerts."""

from __future__ import annotations

from functools import reduce

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame

BANDS = ("critical", "high", "medium", "low")
PAGE_CAP = 500


def listed(alerts: DataFrame, min_score: int | None = None, name_part: str | None = None, statuses: tuple[str, ...] | None = None, since: int | None = None, until: int | None = None, corridor_id: int | None = None) -> DataFrame:
    """Alerts that meet every condition given."""
    tests = [
        None if min_score is None else F.col("score") >= min_score,
        None if name_part is None else F.lower("name").contains(name_part.lower()),
        None if statuses is None else F.col("status").isin(*statuses),
        None if since is None else F.col("gap_start") >= since,
        None if until is None else F.col("gap_start") <= until,
        None if corridor_id is None else F.col("corridor_id") == corridor_id,
    ]
    return reduce(lambda df, c: df if c is None else df.filter(c), tests, alerts)


def page(alerts: DataFrame, by: str, skip: int, limit: int, ascending: bool = False, key: str = "gap_id") -> DataFrame:
    """One page in the order of a column, ties by key; a page has at most PAGE_CAP rows."""
    if not 0 < limit <= PAGE_CAP:
        raise ValueError(f"a page has 1 to {PAGE_CAP} rows")
    return alerts.orderBy(F.col(by).asc() if ascending else F.col(by).desc(), key).offset(skip).limit(limit)


def search_vessels(vessels: DataFrame, text: str, least_dwt: float | None = None, least_year: int | None = None) -> DataFrame:
    found = vessels.filter(F.lower("name").contains(text.lower()) | (F.col("imo") == text))
    found = found if least_dwt is None else found.filter(F.col("dwt") >= least_dwt)
    return found if least_year is None else found.filter(F.col("year_built") >= least_year)


def timeline(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def band_counts(alerts: DataFrame, *by: str, **more: Column) -> DataFrame:
    counts = [F.count("*").alias("total"), *(F.count_if(F.col("band") == b).alias(b) for b in BANDS), *(c.alias(k) for k, c in more.items())]
    return alerts.groupBy(*by).agg(*counts)


def dedup_groups(alerts: DataFrame, days: int) -> DataFrame:
    """One row per vessel, corridor and slot of `days`; main is the first of the alerts with the highest score."""
    slot = F.floor(F.col("day") / days).alias("slot")
    main = F.min_by("gap_id", F.struct((-F.col("score")).alias("s"), "gap_start", "gap_id"))
    return alerts.groupBy("vessel_id", "corridor_id", slot).agg(F.count("*").alias("n"), F.min("gap_start").alias("first"), F.max("gap_start").alias("last"), F.max("score").alias("worst"), main.alias("main"))


def rate_baseline(alerts: DataFrame, seconds: int = 604_800) -> DataFrame:
    """Per corridor: tumbling windows from the first gap of all, their gaps, and the 95th percentile."""
    first = alerts.agg(F.min("gap_start").alias("first"))
    w = F.floor((F.col("gap_start") - F.col("first")) / seconds)
    per = alerts.crossJoin(F.broadcast(first)).groupBy("corridor_id", w.alias("w")).agg(F.count("*").alias("n"))  # `first` is one row
    return per.groupBy("corridor_id").agg(F.count("*").alias("windows"), F.sum("n").alias("gaps"), F.floor(F.percentile("n", 0.95) * 10).alias("p95_tenths"))


def fp_rates(alerts: DataFrame, by: list, least: int = 1) -> DataFrame:
    """Reviewed alerts, false positives among them, and their rate in percent."""
    seen = alerts.filter(F.col("status").isin("confirmed", "dismissed")).groupBy(*by).agg(F.count("*").alias("reviewed"), F.count_if(F.col("status") == "dismissed").alias("fp"))
    return seen.filter(F.col("reviewed") >= least).withColumn("fp_percent", F.floor(100 * F.col("fp") / F.col("reviewed")))


def rate_snapshots(alerts: DataFrame, kinds: dict[str, Column]) -> DataFrame:
    parts = F.array(*(F.struct(F.lit(k).alias("kind"), v.alias("key")) for k, v in kinds.items()))
    return fp_rates(alerts.select("status", F.explode(parts).alias("p")).select("status", "p.*"), ["kind", "key"])


def signal_matrix(signals: DataFrame, alerts: DataFrame, least: int) -> DataFrame:
    """True and false positives by signal and corridor."""
    seen = signals.select("gap_id", "signal").join(alerts.select("gap_id", "corridor_id", "status").filter(F.col("status").isin("confirmed", "dismissed")), "gap_id")
    counts = seen.groupBy("signal", "corridor_id").agg(F.count_if(F.col("status") == "confirmed").alias("tp"), F.count_if(F.col("status") == "dismissed").alias("fp"))
    return counts.filter(F.col("tp") + F.col("fp") >= least)


def vessel_scores(alerts: DataFrame) -> DataFrame:
    """Nearest-rank third quartile of each vessel's scores, and its label (every third vessel)."""
    return alerts.groupBy("vessel_id").agg(F.expr("percentile_disc(0.75) within group (order by score)").alias("s")).withColumn("y", F.col("vessel_id") % 3 == 0)


def confusion(scores: DataFrame, threshold: int) -> DataFrame:
    p, y = F.col("s") >= threshold, F.col("y")
    return scores.agg(F.count_if(p & y).alias("tp"), F.count_if(p & ~y).alias("fp"), F.count_if(~p & y).alias("fn"), F.count_if(~p & ~y).alias("tn"))


def sweep(scores: DataFrame, low: int, high: int, step: int) -> DataFrame:
    """True and false positives and misses at each threshold, from one count per score value."""
    per = scores.groupBy("s").agg(F.count_if("y").alias("yes"), F.count_if(~F.col("y")).alias("no"))
    each = per.withColumn("threshold", F.explode(F.sequence(F.lit(low).cast("long"), F.lit(high).cast("long"), F.lit(step).cast("long"))))
    over = F.col("s") >= F.col("threshold")
    total = lambda c, n: F.sum(F.when(c, F.col(n)).otherwise(0))
    return each.groupBy("threshold").agg(total(over, "yes").alias("tp"), total(over, "no").alias("fp"), total(~over, "yes").alias("fn"))


def behaviour(points: DataFrame, seconds: int, least: int = 3) -> DataFrame:
    """Speed in the last `seconds` against the time before, per vessel, with a tier of deviation."""
    newest = points.agg(F.max("t").alias("newest"))
    p = points.crossJoin(F.broadcast(newest)).withColumn("recent", F.col("t") >= F.col("newest") - seconds)  # `newest` is one row
    now, before = F.when(F.col("recent"), F.col("sog")), F.when(~F.col("recent"), F.col("sog"))
    stats = p.groupBy("vessel_id").agg(F.count(before).alias("before_n"), F.count(now).alias("now_n"), F.median(now).alias("now_m"), F.median(before).alias("before_m"), F.stddev_samp(before).alias("sd"))
    gap = F.abs(F.col("now_m") - F.col("before_m"))
    tier = F.when(gap > F.col("sd"), "high").when(gap > F.col("sd") / 2, "medium").otherwise("low")
    return stats.filter((F.col("before_n") >= least) & (F.col("now_n") >= least)).select("vessel_id", "before_n", "now_n", F.floor(F.col("now_m") * 10).alias("now_tenths"), tier.alias("tier"))


def delta(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Every key with added, removed or unchanged."""
    both = old.select(key, F.lit(True).alias("_o")).join(new.select(key, F.lit(True).alias("_n")), key, "full")
    return both.select(key, F.when(F.col("_o").isNull(), "added").when(F.col("_n").isNull(), "removed").otherwise("unchanged").alias("delta"))


def track_lines(points: DataFrame) -> DataFrame:
    """A line per vessel: lon and lat in hundredths, in time order."""
    p = F.array_sort(F.collect_list(F.struct("t", "point_id", "lat", "lon")))
    spot = lambda s: F.concat_ws(" ", F.floor(s["lon"] * 100), F.floor(s["lat"] * 100))
    return points.groupBy("vessel_id").agg(F.array_join(F.transform(p, spot), ",").alias("line"))


def notify(alerts: DataFrame, rules: list[tuple]) -> DataFrame:
    """Alerts with the rules (rule, least score, corridor, status) they meet; a null condition holds for all."""
    met = F.array(*(F.when(F.lit(True if s is None else F.col("score") >= s) & F.lit(True if c is None else F.coalesce(F.col("corridor_id") == c, F.lit(False))) & F.lit(True if w is None else F.col("status") == w), r) for r, s, c, w in rules))
    return alerts.withColumn("rule", F.explode(F.array_compact(met)))
