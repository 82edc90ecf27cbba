"""Metric, robust-scale and classification expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from monthgrain.contracts import HIGH_SCORE, IQR_TO_SIGMA, MAD_TO_SIGMA, MODERATE_SCORE

# ---- forecast error ------------------------------------------------------------------------


def mae(actual: Column, predicted: Column) -> Column:
    return F.avg(F.abs(actual - predicted))


def rmse(actual: Column, predicted: Column) -> Column:
    error = actual - predicted
    return F.sqrt(F.avg(error * error))


def smape(actual: Column, predicted: Column) -> Column:
    """Symmetric percentage error, 0..200; a pair of zeros contributes no error."""
    size = F.abs(actual) + F.abs(predicted)
    term = F.when(size == 0, F.lit(0.0)).otherwise(F.lit(2.0) * F.abs(actual - predicted) / size)
    return F.avg(term) * 100.0


def error_metrics(actual: str = "actual", predicted: str = "predicted") -> list[Column]:
    a, p = F.col(actual), F.col(predicted)
    return [mae(a, p).alias("mae"), rmse(a, p).alias("rmse"), smape(a, p).alias("smape")]


def percent_of(part: Column, whole: Column) -> Column:
    """``part / whole * 100``; NULL for a zero or missing whole."""
    return F.when(whole != 0, part / whole * 100.0)


def percent_change(now: Column, before: Column) -> Column:
    return F.when(before != 0, (now / before - 1) * 100.0)


# ---- order statistics of a short sorted array -----------------------------------------------


def sorted_quantile(values: str, q: float) -> Column:
    """Linear-interpolation quantile of the ascending array column ``values``."""
    place = f"((size({values}) - 1) * {float(q)}D)"
    at = lambda rounded: f"get({values}, int({rounded}{place}))"
    share = f"({place} - floor{place})"
    return F.expr(f"{at('floor')} * (1.0D - {share}) + {at('ceil')} * {share}")


def with_robust_baseline(df, values: str, minimum: int, median: str, mad: str, iqr: str):
    """Median, median absolute deviation and interquartile range of the array column ``values``.

    The array is the content of a window frame; all three are NULL when it holds fewer than
    ``minimum`` numbers. ``values`` is dropped.
    """
    ordered = F.when(F.size(values) >= minimum, F.sort_array(F.col(values)))
    df = df.withColumn(values, ordered)
    low, middle, high = (sorted_quantile(values, q) for q in (0.25, 0.5, 0.75))
    df = df.withColumns({median: middle, iqr: high - low})
    spread = F.sort_array(F.transform(F.col(values), lambda x: F.abs(x - F.col(median))))
    kept = [c for c in df.columns if c != values]
    return df.withColumn(values, spread).select(*kept, sorted_quantile(values, 0.5).alias(mad))


def scale_method(mad: Column, iqr: Column) -> Column:
    return F.when(mad > 0, "mad").when(iqr > 0, "iqr").otherwise("unavailable")


def robust_scale(mad: Column, iqr: Column) -> Column:
    """MAD first, IQR when MAD is zero, NULL when both are."""
    return F.when(mad > 0, mad / MAD_TO_SIGMA).when(iqr > 0, iqr / IQR_TO_SIGMA)


# ---- classification --------------------------------------------------------------------------


def severity(score: Column, moderate: float = MODERATE_SCORE, high: float = HIGH_SCORE) -> Column:
    return (
        F.when(score.isNull(), "unavailable")
        .when(F.abs(score) >= high, "high")
        .when(F.abs(score) >= moderate, "moderate")
        .otherwise("normal")
    )


def direction(score: Column, moderate: float = MODERATE_SCORE) -> Column:
    return (
        F.when(score.isNull(), "unavailable")
        .when(score >= moderate, "high")
        .when(score <= -moderate, "low")
        .otherwise("normal")
    )


def residual_direction(residual: Column) -> Column:
    return F.when(residual > 0, "above_forecast").when(residual < 0, "below_forecast").otherwise("on_forecast")


def is_true(flag: Column) -> Column:
    return F.coalesce(flag, F.lit(False))


def flag_or_false(df, name: str) -> Column:
    """Boolean column by name; an absent column or a NULL counts as false."""
    return is_true(F.col(name)) if name in df.columns else F.lit(False)


def alert_status(scored: Column, judged: Column, alert: Column, anomaly: Column) -> Column:
    return (
        F.when(~scored | ~judged, "unavailable")
        .when(alert, "dashboard_alert")
        .when(anomaly, "statistical_only")
        .otherwise("normal")
    )


def alert_category(status: Column, level: Column) -> Column:
    return (
        F.when(status == "confirmed_anomaly", "Both detectors flagged").when(level == "high", "High").otherwise("Moderate")
    )
