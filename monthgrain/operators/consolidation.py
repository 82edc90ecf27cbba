"""One row per series-month combining both detectors, with its checks, metadata and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from monthgrain import contracts as C
from monthgrain.contracts import require_columns
from monthgrain.functions.scoring import is_true
from monthgrain.operators.checks import check_table, violation
from monthgrain.operators.joins import beside, checked_join, without_duplicated_series

HISTORICAL_NEEDED = (
    "period_date",
    "series_id",
    "metric",
    "historical_score_available",
    "historical_severity",
    "historical_direction",
    "historical_is_anomaly",
    "dashboard_alert",
    "alert_status",
)
FORECAST_NEEDED = (
    "forecast_period",
    "series_id",
    "metric",
    "model",
    "predicted",
    "forecast_residual",
    "forecast_residual_pct",
    "forecast_error_direction",
    "forecast_anomaly_score",
    "forecast_score_available",
    "forecast_severity",
    "forecast_direction",
    "forecast_is_anomaly",
    "forecast_dashboard_alert",
    "forecast_alert_status",
)
FORECAST_CARRIED = (
    "origin",
    "horizon_step",
    "residual_median",
    "residual_mad",
    "residual_iqr",
    "forecast_residual_scale",
    "forecast_scale_method",
    "forecast_practical_significance_available",
    "forecast_practical_significance",
    "forecast_statistical_anomaly",
)
SUMMARY_NEEDED = (
    "period_date",
    "series_id",
    "metric",
    "value",
    "historical_detector_available",
    "forecast_detector_available",
    "historical_dashboard_alert",
    "forecast_dashboard_alert",
    "overall_dashboard_alert",
    "overall_status",
    "overall_severity",
    "overall_direction",
    "detector_coverage",
    "has_forecast_record",
)
# Names and wording of the published check table
SUMMARY_CHECKS = {
    "unique_series_period": "Each series-period must appear exactly once.",
    "valid_overall_status": "Overall status must use the approved status vocabulary.",
    "valid_overall_severity": "Overall severity must be normal, moderate, high, or unavailable.",
    "valid_overall_direction": "Overall direction must use the approved direction vocabulary.",
    "valid_detector_coverage": "Detector coverage must use the approved coverage vocabulary.",
    "overall_alert_union": "Overall dashboard alert must equal historical OR forecast alert.",
    "confirmed_anomaly_logic": "Confirmed anomaly requires both dashboard alert types.",
    "historical_alert_logic": "Historical alert status requires historical alert only.",
    "forecast_alert_logic": "Forecast alert status requires forecast alert only.",
    "unavailable_status_logic": "Overall status is unavailable only when neither detector is available.",
    "normal_status_logic": "Normal requires detector coverage and no active dashboard alert.",
    "detector_coverage_logic": "Detector coverage must match historical and forecast availability.",
    "alert_severity_consistency": "Every dashboard alert must have moderate or high severity.",
    "normal_severity_consistency": "Normal observations must have normal overall severity.",
    "unavailable_severity_consistency": "Unavailable observations must have unavailable overall severity.",
    "forecast_availability_requires_record": "Forecast detector availability requires a matched forecast record.",
}
SIGNAL = {"above_forecast": "high", "below_forecast": "low", "on_forecast": "normal"}


def _signal(error_direction: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, meaning in SIGNAL.items():
        out = F.when(error_direction == name, meaning).otherwise(out)
    return out


def _severity_rank(active: Column, severity: Column) -> Column:
    """Rank of a severity while its alert is active: high 2, moderate 1, anything else below."""
    rank = F.when(severity == "high", 2).when(severity == "moderate", 1).when(severity == "normal", 0).otherwise(-1)
    return F.when(active, rank)


def coverage(historical: Column, forecast: Column) -> Column:
    return (
        F.when(historical & forecast, "both")
        .when(historical, "historical_only")
        .when(forecast, "forecast_only")
        .otherwise("unavailable")
    )


def consolidate(historical: DataFrame, forecast: DataFrame) -> DataFrame:
    """Left join of the residual detector onto the historical one and the overall verdict per row.

    Each record meets one record at most: a repeated month fails in the historical detector, a repeated residual key here.
    """
    require_columns(historical, HISTORICAL_NEEDED, "historical anomalies")
    require_columns(forecast, FORECAST_NEEDED, "residual anomalies")
    carried = [c for c in (*FORECAST_NEEDED, *FORECAST_CARRIED) if c in forecast.columns]
    right = (
        forecast.select(*carried)
        .withColumnsRenamed({"forecast_period": "period_date", "metric": "forecast_metric", "model": "forecast_model"})
        .withColumn("has_forecast_record", F.lit(True))
    )
    joined = checked_join(historical, right, ["series_id", "period_date"], "left", "residual anomalies")
    mismatch = F.col("forecast_metric") != F.col("metric")
    record = F.when(mismatch, F.raise_error(F.lit("historical and forecast metric differ")).cast("boolean"))
    ha, fa = is_true(F.col("dashboard_alert")), is_true(F.col("forecast_dashboard_alert"))
    hs, fs = is_true(F.col("historical_score_available")), is_true(F.col("forecast_score_available"))
    worst = F.greatest(
        _severity_rank(ha, F.col("historical_severity")), _severity_rank(fa, F.col("forecast_severity"))
    )
    said = _signal(F.col("forecast_error_direction"))
    return joined.withColumns(
        {
            "has_forecast_record": record.otherwise(is_true(F.col("has_forecast_record"))),
            "historical_dashboard_alert": ha,
            "forecast_dashboard_alert": fa,
            "historical_detector_available": hs,
            "forecast_detector_available": fs,
            "detector_coverage": coverage(hs, fs),
            "overall_status": F.when(~(hs | fs), "unavailable")
            .when(ha & fa, "confirmed_anomaly")
            .when(ha, "historical_alert")
            .when(fa, "forecast_alert")
            .otherwise("normal"),
            "overall_dashboard_alert": ha | fa,
            "overall_severity": F.when(~(hs | fs) | (worst == -1), "unavailable")
            .when(worst == 2, "high")
            .when(worst == 1, "moderate")
            .otherwise("normal"),
            "overall_direction": F.when(ha & fa & (F.col("historical_direction") == said), said)
            .when(ha & fa, "mixed")
            .when(ha, F.col("historical_direction"))
            .when(fa, said)
            .otherwise("normal"),
        }
    ).drop("forecast_metric")


def summary_checks(summary: DataFrame) -> DataFrame:
    """Sixteen invariants of the consolidated rows, all counted in one aggregation.

    Counts are taken per key first, so the exchange carries one row per series-month and the uniqueness
    check needs no second pass.
    """
    require_columns(summary, SUMMARY_NEEDED, "anomaly summary")
    hs, fs = is_true(F.col("historical_detector_available")), is_true(F.col("forecast_detector_available"))
    ha, fa = is_true(F.col("historical_dashboard_alert")), is_true(F.col("forecast_dashboard_alert"))
    alert = is_true(F.col("overall_dashboard_alert"))
    status, level = F.col("overall_status"), F.col("overall_severity")

    def outside(column: str, allowed: tuple[str, ...]) -> Column:
        return ~is_true(F.col(column).isin(*allowed))

    def differs(name: str, wanted: Column) -> Column:
        return is_true(status == name) != wanted

    rules = {
        "valid_overall_status": outside("overall_status", C.STATUS_VALUES),
        "valid_overall_severity": outside("overall_severity", C.SEVERITY_VALUES),
        "valid_overall_direction": outside("overall_direction", C.DIRECTION_VALUES),
        "valid_detector_coverage": outside("detector_coverage", C.COVERAGE_VALUES),
        "overall_alert_union": alert != (ha | fa),
        "confirmed_anomaly_logic": differs("confirmed_anomaly", ha & fa),
        "historical_alert_logic": differs("historical_alert", ha & ~fa),
        "forecast_alert_logic": differs("forecast_alert", fa & ~ha),
        "unavailable_status_logic": differs("unavailable", ~hs & ~fs),
        "normal_status_logic": differs("normal", (hs | fs) & ~ha & ~fa),
        "detector_coverage_logic": ~F.col("detector_coverage").eqNullSafe(coverage(hs, fs)),
        "alert_severity_consistency": alert & ~is_true(level.isin("moderate", "high")),
        "normal_severity_consistency": is_true(status == "normal") & ~level.eqNullSafe("normal"),
        "unavailable_severity_consistency": is_true(status == "unavailable") & ~level.eqNullSafe("unavailable"),
        "forecast_availability_requires_record": fs & ~is_true(F.col("has_forecast_record")),
    }
    per_key = summary.groupBy("series_id", "period_date").agg(
        F.count(F.lit(1)).alias("n"), *[F.count_if(rule).alias(name) for name, rule in rules.items()]
    )
    totals = per_key.agg(
        violation(F.sum(F.when(F.col("n") > 1, F.col("n"))), "unique_series_period"),
        *[violation(F.sum(name), name) for name in rules],
    )
    return check_table(totals, SUMMARY_CHECKS)


def anomaly_metadata(summary: DataFrame) -> DataFrame:
    """Settings and outcome counts as ``(category, item, value)`` text rows."""
    status, level = F.col("overall_status"), F.col("overall_severity")
    per_series = summary.groupBy("series_id").agg(
        F.count(F.lit(1)).alias("rows"),
        F.collect_set("period_date").alias("months"),
        F.min("period_date").alias("lo"),
        F.max("period_date").alias("hi"),
        F.count_if("has_forecast_record").alias("records"),
        F.count_if("historical_dashboard_alert").alias("h"),
        F.count_if("forecast_dashboard_alert").alias("f"),
        F.count_if("overall_dashboard_alert").alias("o"),
        F.count_if(status == "confirmed_anomaly").alias("both"),
        F.count_if(level == "high").alias("high"),
        F.count_if(level == "moderate").alias("moderate"),
        F.count_if(status == "unavailable").alias("unavailable"),
    )
    # distinct months are counted as rows, not in one set collected over all series
    months = per_series.select(F.explode("months").alias("m")).distinct().agg(F.count(F.lit(1)).alias("periods"))
    totals = per_series.agg(
        F.sum("rows").alias("rows"),
        F.count(F.lit(1)).alias("series"),
        F.min("lo").alias("lo"),
        F.max("hi").alias("hi"),
        *[F.sum(c).alias(c) for c in ("records", "h", "f", "o", "both", "high", "moderate", "unavailable")],
    )
    totals = beside(totals, months)
    rent_h, bond_h = C.HISTORICAL_MATERIALITY[C.METRIC_RENT], C.HISTORICAL_MATERIALITY[C.METRIC_BONDS]
    rent_f, bond_f = C.RESIDUAL_MATERIALITY[C.METRIC_RENT], C.RESIDUAL_MATERIALITY[C.METRIC_BONDS]
    # fixed values: rows of the published metadata table
    items = [
        ("dataset", "rows", F.col("rows")),
        ("dataset", "series", F.col("series")),
        ("dataset", "periods", F.col("periods")),
        ("dataset", "start_period", F.col("lo")),
        ("dataset", "end_period", F.col("hi")),
        ("dataset", "forecast_records", F.col("records")),
        ("historical_detector", "seasonal_lag", C.SEASON),
        ("historical_detector", "baseline_window", C.BASELINE_WINDOW),
        ("historical_detector", "minimum_baseline_observations", C.BASELINE_MIN),
        ("historical_detector", "moderate_threshold", C.MODERATE_SCORE),
        ("historical_detector", "high_threshold", C.HIGH_SCORE),
        ("historical_practical", "median_rent_absolute_threshold", rent_h[0]),
        ("historical_practical", "median_rent_percentage_threshold", rent_h[1]),
        ("historical_practical", "bonds_absolute_threshold", bond_h[0]),
        ("historical_practical", "bonds_percentage_threshold", bond_h[1]),
        ("forecast_detector", "horizon", C.RESIDUAL_HORIZON),
        ("forecast_detector", "minimum_prior_residuals", C.RESIDUAL_MIN_PRIOR),
        ("forecast_detector", "moderate_threshold", C.MODERATE_SCORE),
        ("forecast_detector", "high_threshold", C.HIGH_SCORE),
        ("forecast_practical", "median_rent_absolute_threshold", rent_f[0]),
        ("forecast_practical", "median_rent_percentage_threshold", rent_f[1]),
        ("forecast_practical", "bonds_absolute_threshold", bond_f[0]),
        ("forecast_practical", "bonds_percentage_threshold", bond_f[1]),
        ("outputs", "historical_dashboard_alerts", F.col("h")),
        ("outputs", "forecast_dashboard_alerts", F.col("f")),
        ("outputs", "confirmed_anomalies", F.col("both")),
        ("outputs", "overall_dashboard_alerts", F.col("o")),
        ("outputs", "overall_high", F.col("high")),
        ("outputs", "overall_moderate", F.col("moderate")),
        ("outputs", "overall_unavailable", F.col("unavailable")),
    ]
    rows = F.array(
        *[
            F.struct(
                F.lit(category).alias("category"),
                F.lit(item).alias("item"),
                (value if isinstance(value, Column) else F.lit(str(value))).cast("string").alias("value"),
            )
            for category, item, value in items
        ]
    )
    return totals.select(F.inline(rows))


def alert_rows(summary: DataFrame) -> DataFrame:
    return summary.where(is_true(F.col("overall_dashboard_alert")))


def alert_feed(summary: DataFrame) -> DataFrame:
    return alert_rows(summary).orderBy(F.col("period_date").desc(), "series_id")


def status_distribution(summary: DataFrame, column: str = "overall_status") -> DataFrame:
    return summary.groupBy(F.coalesce(F.col(column), F.lit("unavailable")).alias("status")).agg(
        F.count(F.lit(1)).alias("observations")
    )


def alert_statistics(summary: DataFrame) -> DataFrame:
    """Alert counts, newest alert and forecast coverage of every series."""
    alert = is_true(F.col("overall_dashboard_alert"))
    when = F.when(alert, F.col("period_date"))
    return summary.groupBy("series_id", *C.SERIES_ATTRS).agg(
        F.count(F.lit(1)).alias("observations"),
        F.count_if(alert).alias("alerts"),
        F.count_if(alert & (F.col("overall_severity") == "high")).alias("high_alerts"),
        F.count_if(alert & (F.col("overall_status") == "confirmed_anomaly")).alias("both_detector_alerts"),
        F.max(when).alias("latest_alert"),
        F.max_by("overall_status", when).alias("latest_alert_status"),
        F.bool_or(is_true(F.col("has_forecast_record"))).alias("has_forecast_coverage"),
    )


def most_extreme(scored: DataFrame, score: str, period: str, n: int = 20) -> DataFrame:
    """Top ``n`` anomalies by absolute score; the key breaks ties, so the report is deterministic."""
    size = F.abs(F.col(score))
    return scored.where(F.col(score).isNotNull()).orderBy(size.desc(), "series_id", period).limit(n)


def platform_headline(panel: DataFrame, catalog: DataFrame, summary: DataFrame, forecasts: DataFrame) -> DataFrame:
    """One-row platform figures; anomaly counts leave out the duplicated authority series."""
    series = panel.groupBy("series_id").agg(
        F.count(F.lit(1)).alias("n"), F.bool_or(is_true(F.col("source_snapshot_provisional"))).alias("p")
    )
    history = series.agg(
        F.count(F.lit(1)).alias("historical_series"),
        F.sum("n").alias("historical_observations"),
        F.bool_or("p").alias("source_snapshot_provisional"),
    )
    eligible = catalog.agg(F.count_if(is_true(F.col("eligible_for_forecasting"))).alias("forecast_eligible_series"))
    alerts = without_duplicated_series(summary).agg(
        F.count_if("overall_dashboard_alert").alias("overall_alerts"),
        F.count_if(F.col("overall_status") == "confirmed_anomaly").alias("both_detectors_flagged"),
    )
    produced = forecasts.select("series_id").distinct().agg(F.count(F.lit(1)).alias("production_series"))
    return beside(history, eligible, alerts, produced)

