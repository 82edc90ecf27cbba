"""Forward forecasts: research winners and the fixed production policy."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from monthgrain.contracts import (
    FORECAST_KEY,
    HORIZON,
    MODEL_ORDER,
    PRODUCTION_MODEL,
    PRODUCTION_POLICY,
    SERIES_ATTRS,
    require_columns,
)
from monthgrain.functions.scoring import percent_change
from monthgrain.operators.checks import check_table, not_finite, violation
from monthgrain.operators.joins import checked_join
from monthgrain.operators.smoothing import smoothing_forward

FINAL_COLUMNS = (
    "series_id",
    *SERIES_ATTRS,
    "model",
    "forecast_origin",
    "forecast_period",
    "horizon_step",
    "predicted",
    "backtest_mae",
    "backtest_rmse",
    "backtest_smape",
)


def winner_forward(forecasts: DataFrame, winners: DataFrame) -> DataFrame:
    """Forward rows of each series' winner model with its backtest metrics."""
    require_columns(winners, ("series_id", "best_model", "best_mae", "best_rmse", "best_smape"), "winners")
    chosen = winners.select(
        "series_id",
        "best_model",
        *[F.col(f"best_{m}").alias(f"backtest_{m}") for m in ("mae", "rmse", "smape")],
    )
    known = F.col("best_model").isin(*MODEL_ORDER)
    model = F.when(known, F.col("best_model")).otherwise(F.raise_error(F.lit("unsupported winner model")).cast("string"))
    joined = checked_join(forecasts, chosen.withColumn("best_model", model), ["series_id"], "inner", "winners")
    return joined.where(F.col("model") == F.col("best_model")).select(*FINAL_COLUMNS)


def production_forward(
    history: DataFrame, by_series: DataFrame, horizon: int = HORIZON, forecasts: DataFrame | None = None
) -> DataFrame:
    """The fixed production model for every series with its own backtest metrics and the policy tag."""
    require_columns(by_series, ("model", "series_id", "mae", "rmse", "smape"), "series metrics")
    rows = smoothing_forward(history, horizon) if forecasts is None else forecasts
    own = by_series.where(F.col("model") == PRODUCTION_MODEL).select(
        "series_id", *[F.col(m).alias(f"backtest_{m}") for m in ("mae", "rmse", "smape")]
    )
    joined = checked_join(rows, own, ["series_id"], "left", "production metrics")
    bad = not_finite(F.col("predicted"))
    for m in ("mae", "rmse", "smape"):
        bad = bad | not_finite(F.col(f"backtest_{m}"))
    failure = F.raise_error(F.lit("production forecasts need finite predictions and backtest metrics")).cast("double")
    return (
        joined.withColumn("predicted", F.when(bad, failure).otherwise(F.col("predicted")))
        .select(*FINAL_COLUMNS)
        .withColumn("forecast_policy", F.lit(PRODUCTION_POLICY))
    )


def forward_checks(forecasts: DataFrame, expected_series: DataFrame, horizon: int = HORIZON) -> DataFrame:
    """Unique keys, finite values, full horizon and full series coverage of a forward product."""
    per_key = forecasts.groupBy("model", "series_id", "forecast_period").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(not_finite(F.col("predicted"))).alias("bad")
    )
    per_series = per_key.groupBy("series_id", "model").agg(
        F.sum("n").alias("rows"), F.sum(F.col("n") - 1).alias("repeats"), F.sum("bad").alias("bad")
    )
    wanted = expected_series.select("series_id").distinct().withColumn("_wanted", F.lit(True))
    totals = per_series.join(wanted, "series_id", "full").agg(
        violation(F.sum("repeats"), "unique_keys"),
        violation(F.sum("bad"), "finite_values"),
        violation(F.count_if(F.col("rows") != horizon), "full_horizon"),
        violation(F.count_if(F.col("rows").isNull()), "missing_series"),
        violation(F.count_if(F.col("_wanted").isNull()), "extra_series"),
    )
    return check_table(
        totals,
        {
            "unique_keys": "Forward keys must be unique.",
            "finite_values": "Forward forecasts must be finite.",
            "full_horizon": "Each series needs every forward month.",
            "missing_series": "Every modelled series needs forecasts.",
            "extra_series": "Only modelled series may be forecast.",
        },
    )


def forecast_against_latest(forecasts: DataFrame, history: DataFrame) -> DataFrame:
    """Change of every forecast month against the last observation, preceded by a connecting row."""
    latest = history.groupBy("series_id").agg(F.max_by("value", "period_date").alias("latest_value"))
    joined = forecasts.select("series_id", "forecast_origin", "forecast_period", "horizon_step", "predicted").join(
        latest, "series_id"
    )
    rows = joined.withColumn("change_vs_latest_pct", percent_change(F.col("predicted"), F.col("latest_value")))
    link = (
        joined.where(F.col("horizon_step") == 1)
        .withColumns(
            {
                "forecast_period": F.col("forecast_origin"),
                "horizon_step": F.lit(0),
                "predicted": F.col("latest_value"),
                "change_vs_latest_pct": F.lit(None).cast("double"),
            }
        )
    )
    return rows.unionByName(link).drop("forecast_origin")


def latest_backtest(winner_rows: DataFrame) -> DataFrame:
    """Rows of the newest origin of every series."""
    newest = winner_rows.groupBy("series_id").agg(F.max("origin").alias("origin"))
    return winner_rows.join(newest, ["series_id", "origin"]).select(*FORECAST_KEY, "model", "actual", "predicted")


def attach_actuals(forecasts: DataFrame, panel: DataFrame) -> DataFrame:
    """Forecast rows with the observed value of their month; a missing one fails the job."""
    actuals = panel.select("series_id", F.col("period_date").alias("forecast_period"), F.col("value").alias("actual"))
    joined = checked_join(forecasts, actuals, ["series_id", "forecast_period"], "left", "actuals")
    missing = F.raise_error(F.lit("a forecast month has no actual value")).cast("double")
    return joined.withColumn("actual", F.when(F.col("actual").isNull(), missing).otherwise(F.col("actual")))
