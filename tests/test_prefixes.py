"""Flags and kinds of prefixes; the expected values are written by hand."""

import pytest
import pyspark.sql.functions as F

from wakeline.functions import prefixes as P
from wakeline.operators.networks import prefix_risks


@pytest.mark.parametrize(("prefix", "flag", "risk"), [(211, "DE", "low"), (218, "DE", "low"), (366, "US", "low"), (239, "GR", "medium"), (212, "CY", "medium"), (237, None, "unknown"), (351, "PA", "medium"), (273, "RU", "high"), (511, "PW", "high"), (538, "MH", "medium"), (374, None, "unknown"), (999, None, "unknown"), (314, "BB", "high"), (477, "HK", "medium")])
def test_flags(spark, prefix, flag, risk):
    f = P.flag_of(F.lit(prefix))
    assert tuple(spark.range(1).select(f, P.flag_risk(f)).first()) == (flag, risk)


def test_kinds(spark):
    want = {600: "unallocated", 639: "unallocated", 699: "unallocated", 217: "unallocated", 999: "unallocated", 203: "landlocked", 269: "landlocked", 720: "landlocked", 607: "tiny", 635: "tiny", 211: None, 237: None, 366: None, 636: None}
    vessels = spark.createDataFrame([(k,) for k in want], "vessel_id long")
    points = {"unallocated": 35, "landlocked": 20, "tiny": 10}
    assert {r.vessel_id: (r.kind, r.points) for r in prefix_risks(vessels, F.col("vessel_id")).collect()} == {k: (v, points[v]) for k, v in want.items() if v}


def test_tables_are_whole():
    assert len(P.FLAG_OF) == 202 and len(P.FLAGS.split()) == 404 and list(P.FLAG_OF) == sorted(P.FLAG_OF)
    assert not P.numbers("600 602 604 606 614 623 628 639-641 643 646 648 651-653 658 673 680-699") & P.numbers(P.ALLOCATED)
    assert P.numbers(P.TINY) <= P.numbers(P.ALLOCATED) and P.numbers("1 3-5") == {1, 3, 4, 5}
