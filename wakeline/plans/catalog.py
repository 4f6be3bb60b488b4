"""Registered queries and their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wakeline.plans import alert_queries, cluster_queries, detector_queries, entity_queries, identity_queries, network_queries, operations_queries, satellite_queries, signal_queries, spatial_queries, spread_queries, track_queries
from wakeline.plans.base import ORACLES, QUERIES

from wakeline.plans import score_queries  # isort: skip  (gathers the queries above)

__all__ = ["ORACLES", "QUERIES", "alert_queries", "cluster_queries", "detector_queries", "entity_queries", "flagship", "identity_queries", "network_queries", "operations_queries", "satellite_queries", "score_queries", "signal_queries", "spatial_queries", "spread_queries", "track_queries"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which vessels went dark, for how long, and was the reappearance possible: gaps by duration band."""
    return QUERIES["r2_gap_bands"](spark, sf_dir)
