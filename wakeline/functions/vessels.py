"""Vessel attributes as Spark columns: classes, identifiers, names."""

from __future__ import annotations

import pandas as pd
import pyspark.sql.functions as F
from pyspark.sql import Column
from pyspark.sql.types import DoubleType

# Lower bound of deadweight, fastest plausible speed and speed that proves a spoof (knots).
SPEED_CLASSES = ((200_000, 18.0, 22.0), (120_000, 19.0, 23.0), (80_000, 20.0, 24.0), (60_000, 20.0, 24.0))
OTHER_SPEEDS = (17.0, 22.0)
COMPANY_SUFFIXES = "LTD|LIMITED|LLC|INC|CORP|CORPORATION|CO|COMPANY|SA|GMBH|PLC|PTE|BV|AS|SHIPPING"


def _by_class(dwt: Column, k: int) -> Column:
    out = F.lit(OTHER_SPEEDS[k])
    for least, *speeds in reversed(SPEED_CLASSES):
        out = F.when(dwt >= least, speeds[k]).otherwise(out)
    return out


def max_speed(dwt: Column) -> Column:
    return _by_class(dwt, 0)


def spoof_speed(dwt: Column) -> Column:
    return _by_class(dwt, 1)


def is_tanker(mmsi: Column, kind: Column, dwt: Column, keywords=("tanker",), least_dwt: float = 20_000, include=(), exclude=()) -> Column:
    """Excluded ids never, included ids always, else by a keyword of the type, else by size."""
    named = F.lit(False)
    for word in keywords:
        named = named | F.coalesce(F.lower(kind).contains(word.lower()), F.lit(False))
    return F.when(mmsi.isin(list(exclude)), False).when(mmsi.isin(list(include)), True).otherwise(named | F.coalesce(dwt >= least_dwt, F.lit(False)))


def imo_valid(imo: Column) -> Column:
    """Seven digits whose last is the check digit: the sum of each digit times 7 to 2, modulo 10."""
    digit = lambda i: F.substring(imo, i + 1, 1).try_cast("int")
    total = sum((digit(i) * (7 - i) for i in range(6)), F.lit(0))
    return F.coalesce(imo.rlike("^[0-9]{7}$") & (total % 10 == digit(6)), F.lit(False))


def one_digit_apart(a: Column, b: Column) -> Column:
    """Same length and exactly one differing character."""
    differ = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: x != y)
    return (F.length(a) == F.length(b)) & (F.size(F.filter(differ, lambda x: x)) == 1)


def owner_key(name: Column) -> Column:
    """Upper case without punctuation, company suffixes and doubled spaces."""
    plain = F.regexp_replace(F.upper(F.trim(name)), r"[^A-Z0-9 ]", " ")
    bare = F.regexp_replace(plain, rf"\b(?:{COMPANY_SUFFIXES})\b", " ")
    return F.trim(F.regexp_replace(bare, " +", " "))


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all elements; 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def length_from_dwt(dwt: Column) -> Column:
    """Estimated length over all in metres."""
    return 5.0 * F.pow(dwt, F.lit(0.325))


def recency_factor(days: Column) -> Column:
    return F.when(days <= 7, 2.0).when(days <= 30, 1.5).when(days <= 90, 1.0).otherwise(0.8)


def indel_ratio(a: str, b: str) -> float:
    """100 times the share of characters that need no insertion or deletion."""
    if not a and not b:
        return 100.0
    row = [0] * (len(b) + 1)
    for x in a:
        left = 0
        for j, y in enumerate(b, 1):
            left, row[j] = row[j], left + 1 if x == y else max(row[j], row[j - 1])
    return 200.0 * row[-1] / (len(a) + len(b))


@F.pandas_udf(DoubleType())
def token_sort_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Similarity of two names after their words are sorted."""
    order = lambda s: " ".join(sorted((s or "").split()))
    return pd.Series([indel_ratio(order(x), order(y)) for x, y in zip(a, b)])
