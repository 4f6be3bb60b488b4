"""Fitted detectors: principal components, isolation forest, density clusters."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyspark.sql.functions as F
from pyspark.sql import DataFrame

from wakeline.operators.clusters import place_clusters

FEATURES = ("n", "mean_sog", "sd_sog", "max_sog", "sd_lat", "sd_lon", "statuses")


def vessel_features(points: DataFrame) -> DataFrame:
    """One row of features per vessel."""
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return points.groupBy("vessel_id").agg(
        F.count("*").cast("double").alias("n"), F.avg("sog").alias("mean_sog"), zero(F.stddev_samp("sog")).alias("sd_sog"), F.max("sog").alias("max_sog"),
        zero(F.stddev_samp("lat")).alias("sd_lat"), zero(F.stddev_samp("lon")).alias("sd_lon"), F.countDistinct("nav_status").cast("double").alias("statuses"),
    )


def pca_errors(rows: DataFrame, kept: int = 3) -> DataFrame:
    """Distance of each standardised row from the span of the `kept` largest components.

    Means, deviations and the correlation matrix are aggregates; only they reach the driver.
    """
    cols = [F.col(c) for c in FEATURES]
    pairs = [(i, j) for i in range(len(cols)) for j in range(i, len(cols))]
    got = rows.agg(*(F.avg(c).alias(f"m{i}") for i, c in enumerate(cols)), *(F.stddev_samp(c).alias(f"s{i}") for i, c in enumerate(cols)), *(F.covar_samp(cols[i], cols[j]).alias(f"c{i}_{j}") for i, j in pairs)).first()
    mean = [got[f"m{i}"] or 0.0 for i in range(len(cols))]
    sd = [got[f"s{i}"] or 1.0 for i in range(len(cols))]
    matrix = np.eye(len(cols))
    for i, j in pairs:
        c = got[f"c{i}_{j}"]
        matrix[i, j] = matrix[j, i] = (c or 0.0) / (sd[i] * sd[j]) if i != j else 1.0
    _, vectors = np.linalg.eigh(matrix)
    z = [(c - m) / (s or 1.0) for c, m, s in zip(cols, mean, sd)]
    minor = vectors[:, : len(cols) - kept].T
    error = sum((F.pow(sum(float(v) * x for v, x in zip(row, z)), F.lit(2)) for row in minor), F.lit(0.0))
    return rows.withColumn("error", F.sqrt(error))


def isolation_scores(rows: DataFrame, trees: int = 100, sample: int = 256, seed: int = 42) -> DataFrame:
    """Isolation forest: trees on a bounded sample (trees x sample rows at most), scores of all rows in batches."""
    hashed = rows.orderBy(F.xxhash64("vessel_id"), "vessel_id").limit(trees * sample).select(*FEATURES).toPandas().to_numpy(float)
    rng, deepest = np.random.default_rng(seed), int(np.ceil(np.log2(max(2, min(sample, len(hashed))))))

    def grow(x: np.ndarray, depth: int):
        span = np.ptp(x, axis=0) if len(x) else np.zeros(len(FEATURES))
        if depth == deepest or len(x) <= 1 or not span.any():
            return len(x)
        k = int(rng.choice(np.flatnonzero(span)))
        cut = float(rng.uniform(x[:, k].min(), x[:, k].max()))
        return k, cut, grow(x[x[:, k] < cut], depth + 1), grow(x[x[:, k] >= cut], depth + 1)

    def rest(n: int) -> float:
        return 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n if n > 2 else float(n == 2)

    size = min(sample, len(hashed))
    forest = [grow(hashed[rng.choice(len(hashed), size, replace=False)], 0) for _ in range(trees)]

    def path(x: np.ndarray, node, depth: int = 0) -> np.ndarray:
        if isinstance(node, int):
            return np.full(len(x), depth + rest(node))
        left = x[:, node[0]] < node[1]
        out = np.empty(len(x))
        out[left], out[~left] = path(x[left], node[2], depth + 1), path(x[~left], node[3], depth + 1)
        return out

    def score(batches):
        for b in batches:
            x = b[list(FEATURES)].to_numpy(float)
            mean = np.mean([path(x, t) for t in forest], axis=0)
            yield pd.DataFrame({"vessel_id": b["vessel_id"], "score": 2 ** (-mean / (rest(size) or 1.0))})

    return rows.select("vessel_id", *FEATURES).mapInPandas(score, "vessel_id long, score double")


def dbscan(points: DataFrame, nm: float, least: int) -> DataFrame:
    """id, cluster: the smallest core id of the cluster, or null for noise; a border point joins its smallest cluster.

    Points in one place are compared once, full cells not at all.
    """
    return place_clusters(points, nm, least)
