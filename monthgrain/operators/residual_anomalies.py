"""Unusual one-step forecast residuals of each series' winner model."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from monthgrain.contracts import (
    METRIC_BONDS,
    METRIC_RENT,
    RESIDUAL_HORIZON,
    RESIDUAL_MATERIALITY,
    RESIDUAL_MIN_PRIOR,
    require_columns,
)
from monthgrain.functions.frames import by_month, reject_repeats
from monthgrain.functions.parsing import number_or_null
from monthgrain.functions.scoring import (
    alert_status,
    is_true,
    percent_of,
    residual_direction,
    robust_scale,
    scale_method,
    with_robust_baseline,
)
from monthgrain.operators.historical_anomalies import score_fields
from monthgrain.operators.joins import checked_join

NEEDED = ("model", "series_id", "metric", "origin", "forecast_period", "horizon_step", "actual", "predicted")


def winner_predictions(predictions: DataFrame, winners: DataFrame, horizon: int | None = None) -> DataFrame:
    """Predictions of each series' winner model, optionally of one horizon only."""
    require_columns(predictions, NEEDED, "predictions")
    require_columns(winners, ("series_id", "metric", "best_model"), "winners")
    rows = predictions if horizon is None else predictions.where(F.col("horizon_step") == horizon)
    chosen = winners.select("series_id", "metric", "best_model")
    joined = checked_join(rows, chosen, ["series_id", "metric"], "inner", "winners")
    return joined.where(F.col("model") == F.col("best_model"))


def detect_residual(
    predictions: DataFrame,
    winners: DataFrame,
    horizon: int = RESIDUAL_HORIZON,
    min_prior: int = RESIDUAL_MIN_PRIOR,
) -> DataFrame:
    """Score each residual against all earlier residuals of its series (an expanding frame).

    The frame holds at most one residual per rolling origin of a series.
    """
    if horizon < 1 or min_prior < 3:
        raise ValueError("need horizon >= 1 and min_prior >= 3")
    w = by_month("series_id", "forecast_period")
    typed = {c: number_or_null(F.col(c)) for c in ("actual", "predicted")}
    difference = typed["actual"] - typed["predicted"]
    guarded = reject_repeats(difference, w, F.col("forecast_period"), "winner predictions")
    earlier = F.collect_list(difference).over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = winner_predictions(predictions, winners, horizon).withColumns(
        {**typed, "forecast_residual": guarded, "_prior": earlier}
    )
    rows = with_robust_baseline(rows, "_prior", min_prior, "residual_median", "residual_mad", "residual_iqr")
    residual, mad, iqr = F.col("forecast_residual"), F.col("residual_mad"), F.col("residual_iqr")
    scale = robust_scale(mad, iqr)
    score = F.when(scale > 0, (residual - F.col("residual_median")) / scale)
    return rows.withColumns(
        {
            "forecast_residual_pct": percent_of(residual, F.col("predicted")),
            "forecast_error_direction": residual_direction(residual),
            "forecast_scale_method": scale_method(mad, iqr),
            "forecast_residual_scale": scale,
            "forecast_anomaly_score": score,
            **score_fields(score, "forecast"),
            "forecast_anomaly_horizon": F.lit(horizon),
            "minimum_prior_residuals": F.lit(min_prior),
        }
    )


def practical_residual(anomalies: DataFrame) -> DataFrame:
    """Material residuals: rent needs both minima, bonds either; and the resulting alerts."""
    need = ("metric", "forecast_residual", "forecast_residual_pct", "forecast_is_anomaly", "forecast_score_available")
    require_columns(anomalies, need, "residual anomalies")
    size, pct, metric = F.abs("forecast_residual"), F.abs("forecast_residual_pct"), F.col("metric")
    known = F.col("forecast_residual").isNotNull() & F.col("forecast_residual_pct").isNotNull()
    (rent_abs, rent_pct), (bond_abs, bond_pct) = RESIDUAL_MATERIALITY[METRIC_RENT], RESIDUAL_MATERIALITY[METRIC_BONDS]
    material = F.when(metric == METRIC_RENT, (size >= rent_abs) & (pct >= rent_pct)).when(
        metric == METRIC_BONDS, (size >= bond_abs) | (pct >= bond_pct)
    )
    material = known & is_true(material)
    scored, anomaly = is_true(F.col("forecast_score_available")), is_true(F.col("forecast_is_anomaly"))
    alert = scored & anomaly & material
    return anomalies.withColumns(
        {
            "forecast_practical_significance_available": known,
            "forecast_practical_significance": material,
            "forecast_statistical_anomaly": anomaly,
            "forecast_dashboard_alert": alert,
            "forecast_alert_status": alert_status(scored, known, alert, anomaly),
        }
    )
