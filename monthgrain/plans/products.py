"""The batch products, stage by stage: analytics, backtests with comparison, anomalies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from monthgrain.operators import checks, comparison, consolidation, evaluation, panel, production, quality, summaries
from monthgrain.operators.historical_anomalies import detect_historical, practical_historical
from monthgrain.operators.joins import without_duplicated_series
from monthgrain.operators.residual_anomalies import detect_residual, practical_residual
from monthgrain.session import durable


def analytics_products(wide: DataFrame) -> dict[str, DataFrame]:
    """Seven products of the monthly panel, which is written once and read by all of them."""
    rows = durable(panel.monthly_panel(wide), "panel")
    checks.assert_checks(panel.panel_checks(rows), "monthly panel checks")
    catalog, quality_rows = quality.series_catalog(rows), quality.quality_summary(rows)
    return {
        "monthly_panel": rows,
        "series_catalog": catalog,
        "quality_summary": quality_rows,
        "historical_summary": summaries.historical_summary(rows),
        "monthly_seasonality": summaries.monthly_seasonality(rows),
        "recent_history_summary": summaries.recent_history(rows),
        "modelling_readiness": quality.modelling_readiness(rows, catalog, quality_rows),
    }


def comparison_products(frames: Sequence[DataFrame]) -> dict[str, DataFrame]:
    """Six comparison products of aligned model predictions."""
    rows = durable(comparison.combine_predictions(frames), "predictions")
    checks.assert_checks(checks.alignment_checks(rows, len(frames)), "model alignment checks")
    by_series = comparison.metrics_by_series(rows)
    products = {
        "metrics_by_origin": comparison.metrics_by_origin(rows),
        "metrics_by_series": by_series,
        "metrics_by_horizon": comparison.metrics_by_horizon(rows),
        "model_comparison": comparison.model_comparison(rows),
        "series_model_winners": comparison.series_winners(by_series),
    }
    checks.assert_checks(checks.comparison_completeness(rows, products), "comparison checks")
    return {"combined_predictions": rows, **products}


def forward_products(history: DataFrame, by_series: DataFrame) -> dict[str, DataFrame]:
    rows = durable(production.production_forward(history, by_series), "forward")
    checks.assert_checks(production.forward_checks(rows, history), "production forecast checks")
    return {"final_forward_forecasts": rows}


def anomaly_products(panel_rows: DataFrame, predictions: DataFrame, winners: DataFrame) -> dict[str, DataFrame]:
    """Both detectors, the consolidated summary, its sixteen checks and the metadata table."""
    historical = durable(practical_historical(detect_historical(panel_rows)), "historical")
    residual = durable(practical_residual(detect_residual(predictions, winners)), "residual")
    summary = durable(consolidation.consolidate(historical, residual), "summary")
    verdicts = checks.assert_checks(consolidation.summary_checks(summary), "anomaly summary validation")
    return {
        "historical_anomalies": historical,
        "forecast_anomalies": residual,
        "anomaly_summary": summary,
        "anomaly_validation_summary": verdicts,
        "anomaly_metadata_summary": consolidation.anomaly_metadata(summary),
    }


def evaluation_table(panel_rows: DataFrame, historical: DataFrame, start, end) -> DataFrame:
    """Shock recovery, threshold sweep and transition rates in one loosely united table."""
    parts = {
        "synthetic_injection": evaluation.shock_recovery(panel_rows),
        "threshold_sensitivity": evaluation.threshold_sweep(panel_rows),
        "transition_period": evaluation.transition_rates(without_duplicated_series(historical), start, end),
    }
    return comparison.union_loose([p.withColumn("evaluation_group", F.lit(g)) for g, p in parts.items()])
