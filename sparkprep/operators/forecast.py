"""Forecasts of many series, each fitted in its own group."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Season lengths by step.
SEASONS = {"h": 24, "D": 7, "B": 5, "W": 52, "MS": 12, "M": 12, "QS": 4, "Q": 4}


def season_of(df: DataFrame, time: str) -> int:
    """The season's length by the step of the stamps; 1 where the step has none."""
    from sparkprep.operators.profile import temporal_statistics

    row = temporal_statistics(df, time).first()
    return SEASONS.get(row["frequency"], 1) if row else 1


def seasonal_naive(df: DataFrame, series: str, time: str, value: str, season: int | None, horizon: int) -> DataFrame:
    """(series, step, forecast): the last season again; a hole in it gets the series' mean. Without a season it comes from the stamps' step."""
    season = season_of(df, time) if season is None else season
    back = F.row_number().over(Window.partitionBy(series).orderBy(F.col(time).desc()))
    last = df.withColumn("_b", back).where(F.col("_b") <= season).select(F.col(series).alias("_s"), (season - F.col("_b")).alias("_slot"), F.col(value).cast("double").alias("_v"))
    means = df.groupBy(series).agg(F.avg(value).alias("_mean"))
    steps = means.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    joined = steps.join(last, (F.col(series) == F.col("_s")) & (F.pmod(F.col("step") - 1, F.lit(season)) == F.col("_slot")), "left")
    return joined.select(series, "step", F.coalesce(F.when(~F.isnan("_v"), F.col("_v")), F.col("_mean")).alias("forecast"))


def _smooth(x: np.ndarray, season: int, trend: bool, damped: bool, a: float, b: float, g: float, phi: float) -> tuple[float, np.ndarray]:
    """(squared one-step error, what is left to forecast from) of one set of weights."""
    seasonal = season > 1 and len(x) >= 2 * season
    s = x[:season] - x[:season].mean() if seasonal else np.zeros(1)
    s, m = s.copy(), len(s)
    level = x[:season].mean() if seasonal else x[0]
    slope = ((x[season : 2 * season].mean() - x[:season].mean()) / season if seasonal else x[1] - x[0]) if trend else 0.0
    error = 0.0
    for i, v in enumerate(x):
        guess = level + phi * slope + s[i % m]
        error += (v - guess) ** 2
        before = level
        level = a * (v - s[i % m]) + (1 - a) * (level + phi * slope)
        if trend:
            slope = b * (level - before) + (1 - b) * phi * slope
        if seasonal:
            s[i % m] = g * (v - level) + (1 - g) * s[i % m]
    return error, np.concatenate([[level, slope, len(x)], s])


def exponential_smoothing(df: DataFrame, series: str, time: str, value: str, season: int = 1, horizon: int = 7, trend: bool = True, damped: bool = False) -> DataFrame:
    """(series, step, forecast). Weights by a grid; a season needs two full ones, fewer than four points repeat the last."""
    kind = df.schema[series].dataType.simpleString()
    phi = 0.9 if damped else 1.0

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values(time)[value].to_numpy(dtype=float)
        x = x[np.isfinite(x)]
        name, steps = pdf[series].iloc[0], np.arange(1, horizon + 1)
        if len(x) < 4:
            out = np.full(horizon, x[-1] if len(x) else np.nan)
        else:
            tried = [(_smooth(x, season, trend, damped, a, b, g, phi), (a, b, g)) for a in (0.1, 0.3, 0.5, 0.8) for b in ((0.05, 0.2) if trend else (0.0,)) for g in ((0.1, 0.3) if season > 1 else (0.0,))]
            (_, state), _ = min(tried, key=lambda t: t[0][0])
            level, slope, n, s = state[0], state[1], int(state[2]), state[3:]
            damp = np.cumsum(phi**steps) if damped else steps
            out = level + slope * damp + s[(n + steps - 1) % len(s)]
        return pd.DataFrame({series: [name] * horizon, "step": steps, "forecast": out})

    return df.select(series, time, value).groupBy(series).applyInPandas(fit, f"`{series}` {kind}, step int, forecast double")


def theta(df: DataFrame, series: str, time: str, value: str, horizon: int = 7, alpha: float = 0.5) -> DataFrame:
    """(series, step, forecast): the mean of the linear trend and of simple smoothing of the doubled curvature."""
    kind = df.schema[series].dataType.simpleString()

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values(time)[value].to_numpy(dtype=float)
        x = x[np.isfinite(x)]
        steps = np.arange(1, horizon + 1)
        if len(x) < 4:
            out = np.full(horizon, x[-1] if len(x) else np.nan)
        else:
            t = np.arange(len(x))
            slope, start = np.polyfit(t, x, 1)
            curve, level = 2 * x - (start + slope * t), None
            for v in curve:
                level = v if level is None else alpha * v + (1 - alpha) * level
            out = (level + start + slope * (len(x) - 1 + steps)) / 2
        return pd.DataFrame({series: [pdf[series].iloc[0]] * horizon, "step": steps, "forecast": out})

    return df.select(series, time, value).groupBy(series).applyInPandas(fit, f"`{series}` {kind}, step int, forecast double")
