"""Detectors whose state depends on what came before: one ordered pass per vessel."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def per_vessel(points: DataFrame, columns: list[str], schema: str, fold) -> DataFrame:
    """fold(rows of one vessel in order) for each vessel; a vessel's reports are what one group holds."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        return fold(rows.sort_values(["t", "point_id"], ignore_index=True))

    return points.select("vessel_id", "point_id", "t", *columns).groupBy("vessel_id").applyInPandas(run, schema)


def erratic_status(points: DataFrame, seconds: int, least: int) -> DataFrame:
    """Episodes with `least` status changes within `seconds`, extended while the next window has as many."""

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        status, t = rows["nav_status"].to_numpy(), rows["t"].to_numpy()
        change = t[1:][status[1:] != status[:-1]]
        out, i = [], 0
        while i + least <= len(change):
            if change[i + least - 1] - change[i] > seconds:
                i += 1
                continue
            j = i + least - 1
            while j + 1 < len(change) and change[j + 1] - change[j + 2 - least] <= seconds:
                j += 1
            out.append((rows["vessel_id"].iloc[0], change[i], change[j], j - i + 1))
            i = j + 1
        return pd.DataFrame(out, columns=["vessel_id", "start", "end", "changes"])

    return per_vessel(points, ["nav_status"], "vessel_id long, start long, end long, changes long", fold)


def laid_up(points: DataFrame, degrees: float, least_days: int) -> DataFrame:
    """Each vessel's longest stay within `degrees` of the first day of the stay, by daily median positions."""

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        daily = rows.assign(day=rows["t"] // 86_400).groupby("day")[["lat", "lon"]].median()
        best, start, anchor = (0, 0), None, None
        for day, lat, lon in daily.itertuples():
            if anchor is None or abs(lat - anchor[0]) > degrees or abs(lon - anchor[1]) > degrees:
                start, anchor = day, (lat, lon)
            best = max(best, (int(day - start) + 1, -int(start)))
        return pd.DataFrame([(rows["vessel_id"].iloc[0], -best[1], best[0])] if best[0] >= least_days else [], columns=["vessel_id", "first_day", "days"])

    return per_vessel(points, ["lat", "lon"], "vessel_id long, first_day long, days long", fold)


def residuals(points: DataFrame, alpha: float) -> DataFrame:
    """Mean distance (thousandths of a degree) of each vessel's reports from a constant-velocity filter's forecast."""

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        place, t = rows[["lat", "lon"]].to_numpy(), rows["t"].to_numpy(float)
        state, speed, off = place[0], np.zeros(2), []
        for i in range(1, len(place)):
            step = max(1.0, t[i] - t[i - 1])
            guess = state + speed * step
            miss = place[i] - guess
            off.append(float(np.hypot(*miss)))
            state, speed = guess + alpha * miss, speed + alpha * miss / step
        return pd.DataFrame([(rows["vessel_id"].iloc[0], len(off), int(np.mean(off) * 1000))] if off else [], columns=["vessel_id", "n", "residual_milli"])

    return per_vessel(points, ["lat", "lon"], "vessel_id long, n long, residual_milli long", fold)
