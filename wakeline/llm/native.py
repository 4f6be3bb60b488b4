"""Spans of regex matches as Spark columns, in code points, without Python on the executors."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import Column

SPANS = "array<struct<start:int,end:int,value:string>>"


def matches(text: Column, pattern: str) -> tuple[Column, Column]:
    """The leftmost non-overlapping matches of a pattern and the stretches around them."""
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)


def let(value: Column, f) -> Column:
    """f(value) with the value worked out once; an expression named in a lambda is worked out for each element."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def sums_before(lengths: Column) -> Column:
    """For each length the sum of those before it. Arrays grow in blocks of about the root of their number, as adding to one copies it."""
    none = F.array().cast("array<int>")
    add = lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))
    fold = lambda values, at: F.aggregate(values, F.struct(at.alias("at"), none.alias("out")), add, lambda acc: acc["out"])

    def in_blocks(x):
        size = F.ceil(F.sqrt(F.size(x))).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / size).cast("int")), lambda i: F.slice(x, i * size + 1, size))
        totals = lambda b: F.transform(b, lambda y: F.aggregate(y, F.lit(0), lambda acc, z: acc + z))
        return let(blocks, lambda b: let(fold(totals(b), F.lit(0)), lambda before: F.flatten(F.transform(b, lambda y, i: fold(y, F.get(before, i))))))

    return F.when(F.size(lengths) > 0, let(lengths, in_blocks)).otherwise(none)


def lay_out(kept: Column, around: Column, kept_first: bool = False) -> Column:
    """Spans of `kept` when kept and around alternate in the text (around first, unless kept_first)."""

    def laid(both):
        other = lambda i: F.coalesce(F.length(F.get(both["around"], i)), F.lit(0))
        lengths = F.transform(both["kept"], lambda value, i: other(i) + F.length(value))

        def span(value, i, before):
            begin = F.get(before, i) + (F.lit(0) if kept_first else other(i))
            return F.struct(begin.alias("start"), (begin + F.length(value)).alias("end"), value.alias("value"))

        return let(sums_before(lengths), lambda before: F.transform(both["kept"], lambda value, i: span(value, i, before)))

    return F.when(F.size(kept) > 0, let(F.struct(kept.alias("kept"), around.alias("around")), laid)).otherwise(F.array().cast(SPANS))


def named(spans: Column, kind: str, order: int) -> Column:
    """Spans as (start, order, end, kind), which sorts by start and then by kind as listed."""
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(order).alias("order"), s["end"].alias("end"), F.lit(kind).alias("kind")))


def joined(spans: Column) -> Column:
    """kind:start:end of named spans in order, comma-joined."""
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
