"""Seasonal naive forecasts: the value of the same calendar month one season earlier."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from monthgrain.contracts import (
    HORIZON,
    MIN_HISTORY_MONTHS,
    MODEL_NAIVE,
    N_ORIGINS,
    PREDICTION_COLUMNS,
    SEASON,
    SERIES_ATTRS,
)
from monthgrain.functions.frames import months_back
from monthgrain.operators.splits import with_origin_bounds

ERROR_COLUMNS = ("error", "absolute_error", "squared_error")


def with_errors(predictions: DataFrame) -> DataFrame:
    error = F.col("actual") - F.col("predicted")
    return predictions.withColumns(
        {"error": error, "absolute_error": F.abs(error), "squared_error": error * error}
    )


def naive_backtest(
    panel: DataFrame,
    horizon: int = HORIZON,
    n_origins: int = N_ORIGINS,
    min_history: int = MIN_HISTORY_MONTHS,
    season: int = SEASON,
) -> DataFrame:
    """Predictions of every rolling origin without materialising any training set.

    A month at place ``p`` is the step-``h`` target of the origin at place ``p - h``. With ``h`` no
    larger than the season, the reference month lies inside that origin's training rows, so one window
    pass over the panel and an explode of the horizon give the whole backtest.
    """
    if season < horizon:
        raise ValueError("the season must cover the horizon, otherwise future values would be read")
    reference = F.max("value").over(months_back(season))
    missing = F.raise_error(F.lit("the month one season earlier is absent"))
    rows = with_origin_bounds(panel, horizon, n_origins, min_history).withColumn("_reference", reference)
    targets = (
        rows.withColumn("horizon_step", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
        .withColumn("_origin_place", F.col("_place") - F.col("horizon_step"))
        .where(F.col("_origin_place").between(F.col("_first_origin"), F.col("_last_origin")))
    )
    predicted = F.when(F.col("_reference").isNull(), missing.cast("double")).otherwise(F.col("_reference"))
    return with_errors(
        targets.select(
            F.lit(MODEL_NAIVE).alias("model"),
            "series_id",
            *SERIES_ATTRS,
            F.add_months("period_date", -F.col("horizon_step")).alias("origin"),
            F.col("period_date").alias("forecast_period"),
            "horizon_step",
            F.col("value").alias("actual"),
            predicted.alias("predicted"),
        )
    ).select(*PREDICTION_COLUMNS, *ERROR_COLUMNS)


def future_periods(history: DataFrame, horizon: int = HORIZON) -> DataFrame:
    """Next ``horizon`` months after the common last month; fails when series end differently."""
    if horizon < 1:
        raise ValueError("horizon must be at least 1")
    ends = history.groupBy("series_id").agg(F.max("period_date").alias("end")).agg(
        F.min("end").alias("lo"), F.max("end").alias("hi")
    )
    differ = F.raise_error(F.lit("series end in different months"))
    origin = F.when(F.col("lo") != F.col("hi"), differ.cast("date")).otherwise(F.col("hi"))
    steps = F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("horizon_step")
    return (
        ends.where(F.col("hi").isNotNull())
        .select(origin.alias("forecast_origin"), steps)
        .withColumn("forecast_period", F.add_months("forecast_origin", F.col("horizon_step")))
    )


def naive_forward(history: DataFrame, horizon: int = HORIZON, season: int = SEASON) -> DataFrame:
    """Forward forecasts from the newest season of every series; needs no actuals.

    The months of the newest season shifted by one season are the forecast months, so this is a filter
    and a projection after joining the one-row-per-step calendar.
    """
    calendar = future_periods(history, horizon).withColumn("period_date", F.add_months("forecast_period", -season))
    return history.join(F.broadcast(calendar), "period_date").select(
        F.lit(MODEL_NAIVE).alias("model"),
        "series_id",
        *SERIES_ATTRS,
        "forecast_origin",
        "forecast_period",
        "horizon_step",
        F.col("value").alias("predicted"),
    )
