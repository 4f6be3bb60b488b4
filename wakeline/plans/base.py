"""The registry, and the frames most queries begin with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from wakeline.operators.pairs import in_zone
from wakeline.operators.scoring import simple_score
from wakeline.operators.sequence import gaps
from wakeline.sources import adapter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Registers a query under the operator's number and name."""

    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return add


def gap_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gaps(adapter.positions(spark, sf_dir), adapter.vessels(spark, sf_dir))


def zoned_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    return in_zone(gap_frame(spark, sf_dir), adapter.corridors(spark), "gap_id")


def alert_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simple_score(zoned_frame(spark, sf_dir))
