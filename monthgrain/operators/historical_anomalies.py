"""Unusual year-on-year movements of a monthly series, and whether they matter in practice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from monthgrain.contracts import (
    BASELINE_MIN,
    BASELINE_WINDOW,
    HISTORICAL_MATERIALITY,
    MODERATE_SCORE,
    SEASON,
    require_columns,
)
from monthgrain.functions.frames import by_month, reject_repeats
from monthgrain.functions.parsing import number_or_null
from monthgrain.functions.scoring import (
    alert_status,
    direction,
    is_true,
    percent_of,
    robust_scale,
    scale_method,
    severity,
    with_robust_baseline,
)


def _with_reference(panel: DataFrame, lag: int) -> DataFrame:
    w = by_month()
    value = reject_repeats(number_or_null(F.col("value")), w, F.col("period_date"), "panel")
    return panel.withColumns({"value": value, "seasonal_reference": F.lag(number_or_null(F.col("value")), lag).over(w)})


def seasonal_difference(panel: DataFrame, lag: int = SEASON) -> DataFrame:
    """Value minus the value ``lag`` rows earlier in the same series."""
    return _with_reference(panel, lag).withColumn("seasonal_change", F.col("value") - F.col("seasonal_reference"))


def detect_historical(
    panel: DataFrame,
    seasonal_lag: int = SEASON,
    baseline_window: int = BASELINE_WINDOW,
    min_periods: int = BASELINE_MIN,
) -> DataFrame:
    """Score every month against the robust spread of the series' earlier seasonal changes.

    The current change is not part of its own baseline: the frame ends at the previous row. All windows
    share one exchange and one sort on the series.
    """
    require_columns(panel, ("series_id", "period_date", "value"), "panel")
    if seasonal_lag < 1 or baseline_window < 2 or min_periods < 2 or min_periods > baseline_window:
        raise ValueError("need seasonal_lag >= 1 and 2 <= min_periods <= baseline_window")
    change = F.col("value") - F.col("seasonal_reference")
    before = by_month().rowsBetween(-baseline_window, -1)
    rows = _with_reference(panel, seasonal_lag).withColumns(
        {"seasonal_change": change, "_prior": F.collect_list(change).over(before)}
    )
    rows = with_robust_baseline(
        rows, "_prior", min_periods, "historical_change_expected", "historical_mad", "historical_iqr"
    )
    mad, iqr = F.col("historical_mad"), F.col("historical_iqr")
    expected = F.col("seasonal_reference") + F.col("historical_change_expected")
    deviation = F.col("value") - expected
    scale = robust_scale(mad, iqr)
    score = F.when(scale > 0, deviation / scale)
    return rows.withColumns(
        {
            "historical_expected": expected,
            "historical_deviation": deviation,
            "historical_deviation_pct": percent_of(deviation, expected),
            "historical_scale_method": scale_method(mad, iqr),
            "historical_scale": scale,
            "historical_score": score,
            **score_fields(score, "historical"),
            "seasonal_lag": F.lit(seasonal_lag),
            "baseline_window": F.lit(baseline_window),
            "minimum_baseline_observations": F.lit(min_periods),
        }
    )


def score_fields(score: Column, prefix: str) -> dict[str, Column]:
    """Availability, severity, direction and anomaly flag of a score."""
    return {
        f"{prefix}_score_available": score.isNotNull(),
        f"{prefix}_severity": severity(score),
        f"{prefix}_direction": direction(score),
        f"{prefix}_is_anomaly": is_true(F.abs(score) >= MODERATE_SCORE),
    }


def practical_historical(anomalies: DataFrame) -> DataFrame:
    """Material deviations (both the absolute and the percentage minimum) and the resulting alerts."""
    need = (
        "metric",
        "historical_deviation",
        "historical_deviation_pct",
        "historical_is_anomaly",
        "historical_score_available",
    )
    require_columns(anomalies, need, "historical anomalies")
    metric = F.col("metric")
    absolute = percentage = F.lit(None).cast("double")
    for name, (abs_min, pct_min) in HISTORICAL_MATERIALITY.items():
        absolute = F.when(metric == name, F.lit(abs_min)).otherwise(absolute)
        percentage = F.when(metric == name, F.lit(pct_min)).otherwise(percentage)
    dev, pct = F.col("historical_deviation"), F.col("historical_deviation_pct")
    known = absolute.isNotNull() & dev.isNotNull() & pct.isNotNull()
    material = is_true(known & (F.abs(dev) >= absolute) & (F.abs(pct) >= percentage))
    scored, anomaly = is_true(F.col("historical_score_available")), is_true(F.col("historical_is_anomaly"))
    alert = scored & anomaly & material
    return anomalies.withColumns(
        {
            "practical_abs_threshold": absolute,
            "practical_pct_threshold": percentage,
            "practical_significance_available": known,
            "practical_significance": material,
            "statistical_anomaly": anomaly,
            "dashboard_alert": alert,
            "alert_status": alert_status(scored, known, alert, anomaly),
        }
    )
