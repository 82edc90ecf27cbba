"""Fixed values and column contracts shared by every operator."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame

# --- Fixed values: metric, level and location vocabularies -------------------------------
METRIC_RENT = "median_rent"
METRIC_BONDS = "bonds_lodged"
METRICS = (METRIC_RENT, METRIC_BONDS)
LEVEL_REGION = "region"
LEVEL_AUTHORITY = "territorial_authority"
LEVELS = (LEVEL_REGION, LEVEL_AUTHORITY)
AGGREGATE_LOCATION_IDS = (-99, -1)

# --- Fixed values: authority series that repeat a region series --------------------------
DUPLICATED_AUTHORITY_IDS = (28, 51, 52, 53, 76)

# --- Fixed values: forecasting ------------------------------------------------------------
MODEL_NAIVE = "seasonal_naive"
MODEL_SMOOTHING = "ets_additive_damped"
MODEL_BOOSTED = "xgboost_pooled_recursive"
MODEL_ORDER = (MODEL_NAIVE, MODEL_SMOOTHING, MODEL_BOOSTED)
PRODUCTION_MODEL = MODEL_SMOOTHING
PRODUCTION_POLICY = "fixed_ets_v1"
PER_SERIES_POLICY = "per_series_selection"
FIXED_POLICY_PREFIX = "fixed_"
HORIZON = 6
N_ORIGINS = 12
MIN_HISTORY_MONTHS = 60
SEASON = 12
REQUIRED_RUN_MONTHS = MIN_HISTORY_MONTHS + HORIZON + N_ORIGINS - 1
LAGS = (1, 2, 3, 6, 12)
ROLLING_WINDOWS = (3, 6, 12)
ALIGNMENT_TOLERANCE = 1e-12

# --- Fixed values: anomaly scoring --------------------------------------------------------
MAD_TO_SIGMA = 0.6745
IQR_TO_SIGMA = 1.349
MODERATE_SCORE = 2.5
HIGH_SCORE = 3.5
BASELINE_WINDOW = 36
BASELINE_MIN = 24
RESIDUAL_HORIZON = 1
RESIDUAL_MIN_PRIOR = 6

# metric -> (absolute, percentage) minimum deviation; both must be met
HISTORICAL_MATERIALITY = {METRIC_RENT: (15.0, 3.0), METRIC_BONDS: (25.0, 20.0)}
# metric -> (absolute, percentage); rent needs both, bonds needs either
RESIDUAL_MATERIALITY = {METRIC_RENT: (15.0, 2.0), METRIC_BONDS: (50.0, 10.0)}
SWEEP_THRESHOLDS = (2.0, 2.5, 3.0, 3.5, 4.0)
SHOCK_SIZE = 150.0

STATUS_VALUES = ("normal", "historical_alert", "forecast_alert", "confirmed_anomaly", "unavailable")
SEVERITY_VALUES = ("normal", "moderate", "high", "unavailable")
DIRECTION_VALUES = ("normal", "high", "low", "mixed")
COVERAGE_VALUES = ("historical_only", "forecast_only", "both", "unavailable")

# --- Fixed values: cross-source reconciliation --------------------------------------------
REGION_AREA_DEFINITION = "REGC2019"
TOTAL_CATEGORY = "ALL"
UNKNOWN_CATEGORY = "NA"
MEDIAN_TOLERANCE = 20.0
BONDS_PCT_TOLERANCE = 20.0


def duplicated_series_ids() -> list[str]:
    """Authority series left out of modelling because a region series carries the same numbers."""
    return [f"{LEVEL_AUTHORITY}_{i}_{m}" for i in DUPLICATED_AUTHORITY_IDS for m in METRICS]


SERIES_ATTRS = ("metric", "geography_level", "location_id", "location_name")
PANEL_COLUMNS = (
    "period_date",
    "series_id",
    "geography_level",
    "location_id",
    "location_name",
    "metric",
    "value",
    "source_snapshot_provisional",
    "source_snapshot_id",
)
FORECAST_KEY = ("series_id", "origin", "forecast_period", "horizon_step")
PREDICTION_COLUMNS = (
    "model",
    "series_id",
    "metric",
    "geography_level",
    "location_id",
    "location_name",
    "origin",
    "forecast_period",
    "horizon_step",
    "actual",
    "predicted",
)


class ContractError(ValueError):
    """An input does not satisfy an operator's column or value contract."""


def require_columns(df: DataFrame, columns: Iterable[str], what: str) -> DataFrame:
    """Return ``df`` unchanged, or raise when any required column is absent."""
    missing = sorted(set(columns).difference(df.columns))
    if missing:
        raise ContractError(f"{what} is missing columns: {', '.join(missing)}")
    return df
