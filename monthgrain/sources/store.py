"""Processed products: contract-checked readers and sinks."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from monthgrain.contracts import (
    PRODUCTION_MODEL,
    PRODUCTION_POLICY,
    SERIES_ATTRS,
    ContractError,
    require_columns,
)

KEYS = ("series_id", *SERIES_ATTRS)


@dataclass(frozen=True)
class Contract:
    """Where a product lives, what it must contain and its reading order."""

    folder: str
    required: tuple[str, ...] = ()
    order: tuple[str, ...] = ()


CONTRACTS: dict[str, Contract] = {
    "monthly_panel": Contract(
        "analytics", (*KEYS, "period_date", "value", "source_snapshot_provisional"), ("series_id", "period_date")
    ),
    "series_catalog": Contract("analytics", ("series_id", "continuous_start", "eligible_for_forecasting")),
    "quality_summary": Contract("analytics", ("series_id", "status")),
    "historical_summary": Contract("analytics", ("series_id",)),
    "monthly_seasonality": Contract(
        "analytics",
        (*KEYS, "month", "median_value", "mean_value", "minimum_value", "maximum_value", "n_observations"),
        ("series_id", "month"),
    ),
    "recent_history_summary": Contract("analytics", ("series_id",)),
    "modelling_readiness": Contract("analytics", ("dataset_ready",)),
    "combined_predictions": Contract("forecasting", ("model", "series_id", "origin", "forecast_period")),
    "metrics_by_origin": Contract("forecasting", ("model", "series_id", "origin")),
    "metrics_by_series": Contract("forecasting", ("model", "series_id", "mae", "rmse", "smape")),
    "metrics_by_horizon": Contract("forecasting", ("model", "metric", "horizon_step")),
    "model_comparison": Contract("forecasting", ("model", "metric", "rank_mae")),
    "series_model_winners": Contract(
        "forecasting", (*KEYS, "best_model", "best_mae", "best_rmse", "best_smape"), ("series_id",)
    ),
    "final_forward_forecasts": Contract(
        "forecasting",
        (
            *KEYS,
            "model",
            "forecast_origin",
            "forecast_period",
            "horizon_step",
            "predicted",
            "backtest_mae",
            "backtest_rmse",
            "backtest_smape",
            "forecast_policy",
        ),
        ("series_id", "horizon_step"),
    ),
    "anomaly_summary": Contract("anomaly", ("series_id", "period_date", "overall_status")),
    "historical_anomalies": Contract("anomaly", ("series_id", "period_date", "historical_score")),
    "forecast_anomalies": Contract("anomaly", ("series_id", "forecast_period", "forecast_anomaly_score")),
    "anomaly_validation_summary": Contract("anomaly", ("check_name", "passed")),
    "anomaly_metadata_summary": Contract("anomaly", ("category", "item", "value")),
    "anomaly_evaluation_summary": Contract("anomaly", ("evaluation_group", "evaluation")),
}


def _path(root: str, name: str) -> str:
    return f"{root.rstrip('/')}/{CONTRACTS[name].folder}/{name}"


def write_product(df: DataFrame, root: str, name: str) -> str:
    """Replace one product. Series products are clustered on the series, so readers prune files by it."""
    require_columns(df, CONTRACTS[name].required, name)
    path = _path(root, name)
    clustered = df.repartitionByRange("series_id").sortWithinPartitions("series_id") if "series_id" in df.columns else df
    clustered.write.mode("overwrite").parquet(path)
    return path


def write_products(products: Mapping[str, DataFrame], root: str) -> list[str]:
    return [write_product(df, root, name) for name, df in products.items()]


def read_product(spark: SparkSession, root: str, name: str, ordered: bool = False) -> DataFrame:
    """Read a product after checking its contract; sorting is optional because it costs an exchange."""
    if name not in CONTRACTS:
        raise ContractError(f"unknown product: {name}")
    df = require_columns(spark.read.parquet(_path(root, name)), CONTRACTS[name].required, name)
    if name == "final_forward_forecasts":
        production_gate(df)
    return df.orderBy(*CONTRACTS[name].order) if ordered and CONTRACTS[name].order else df


def production_gate(forecasts: DataFrame) -> DataFrame:
    """Only the production model under the production policy may be served."""
    odd = forecasts.agg(
        F.count_if(F.col("model") != PRODUCTION_MODEL).alias("model"),
        F.count_if(F.col("forecast_policy") != PRODUCTION_POLICY).alias("policy"),
        F.count("model").alias("rows"),
        F.count("forecast_policy").alias("tagged"),
    ).first()
    if odd.model or odd.policy or not odd.rows or not odd.tagged:
        raise ContractError("forward forecasts are not the production model under the production policy")
    return forecasts
