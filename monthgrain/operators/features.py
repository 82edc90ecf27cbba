"""Leakage-safe model features: everything looks at earlier rows only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from monthgrain.contracts import LAGS, ROLLING_WINDOWS, require_columns
from monthgrain.functions.frames import by_month, full_mean

BASE_FEATURES = (
    *[f"lag_{k}" for k in LAGS],
    *[f"rolling_mean_{k}" for k in ROLLING_WINDOWS],
    "month",
    "quarter",
    "year",
)


def calendar_parts(df: DataFrame, period: str = "period_date") -> DataFrame:
    require_columns(df, (period,), "calendar input")
    return df.withColumns({"month": F.month(period), "quarter": F.quarter(period), "year": F.year(period)})


def lag_features(df: DataFrame, lags: Sequence[int] = LAGS) -> DataFrame:
    """Value of the k-th earlier row of the series."""
    require_columns(df, ("series_id", "period_date", "value"), "lag input")
    if min(lags) < 1:
        raise ValueError("lags must be at least 1")
    w = by_month()
    return df.withColumns({f"lag_{k}": F.lag("value", k).over(w) for k in lags})


def rolling_features(df: DataFrame, windows: Sequence[int] = ROLLING_WINDOWS) -> DataFrame:
    """Mean of the k rows before the current one, NULL until k are present."""
    require_columns(df, ("series_id", "period_date", "value"), "rolling input")
    if min(windows) < 1:
        raise ValueError("windows must be at least 1")
    w, v = by_month(), F.col("value")
    return df.withColumns({f"rolling_mean_{k}": full_mean(v, w, -k, -1) for k in windows})


def feature_frame(df: DataFrame) -> DataFrame:
    """Calendar, lag and rolling features; every window shares one exchange and one sort."""
    return rolling_features(lag_features(calendar_parts(df)))


def pooled_training_frame(history: DataFrame) -> DataFrame:
    """Complete feature rows of all series of a metric, with the location identity as a category."""
    require_columns(history, ("period_date", "series_id", "geography_level", "location_id", "metric", "value"), "history")
    keyed = feature_frame(history).withColumn(
        "location_key", F.concat_ws("_", "geography_level", F.col("location_id").cast("string"))
    )
    return keyed.dropna(subset=[*BASE_FEATURES, "value"])
