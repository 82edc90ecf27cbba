"""The check-table contract and the prediction checks built on it.

A check is one row ``(check_name, passed, observed, expected, details)``; ``observed`` counts violations.
All checks of a family are counted in one aggregation and turned into rows at the end.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from monthgrain.contracts import (
    ALIGNMENT_TOLERANCE,
    FORECAST_KEY,
    HORIZON,
    N_ORIGINS,
    PREDICTION_COLUMNS,
    SERIES_ATTRS,
    ContractError,
    require_columns,
)
from monthgrain.functions.parsing import month_number
from monthgrain.operators.joins import beside


def violation(total: Column, name: str) -> Column:
    return F.coalesce(total, F.lit(0)).cast("bigint").alias(name)


def check_table(totals: DataFrame, details: Mapping[str, str], expected: int = 0) -> DataFrame:
    """Unpivot a single row of violation counts into check rows, in the order of ``details``."""
    names = list(details)
    notes = F.create_map(*[F.lit(x) for pair in details.items() for x in pair])
    long = totals.select(*names).unpivot([], names, "check_name", "observed")
    return long.select(
        "check_name",
        (F.col("observed") == expected).alias("passed"),
        "observed",
        F.lit(expected).cast("bigint").alias("expected"),
        notes[F.col("check_name")].alias("details"),
    )


def assert_checks(checks: DataFrame, what: str) -> DataFrame:
    """Run the checks and raise naming every failed one (the table is a handful of rows)."""
    failed = [r.check_name for r in checks.where(~F.col("passed")).select("check_name").collect()]
    if failed:
        raise ContractError(f"{what} failed: {', '.join(sorted(failed))}")
    return checks


def not_finite(value: Column) -> Column:
    return value.isNull() | F.isnan(value) | (F.abs(value) == float("inf"))


def prediction_checks(predictions: DataFrame) -> DataFrame:
    """One model, unique forecast keys, finite numbers."""
    require_columns(predictions, PREDICTION_COLUMNS, "predictions")
    per_key = predictions.groupBy(*FORECAST_KEY).agg(
        F.count(F.lit(1)).alias("n"),
        F.collect_set("model").alias("models"),
        F.count_if(not_finite(F.col("actual")) | not_finite(F.col("predicted"))).alias("bad"),
    )
    totals = per_key.agg(
        violation(F.when(F.count(F.lit(1)) == 0, 1), "not_empty"),
        violation(F.size(F.array_distinct(F.flatten(F.collect_set("models")))) - 1, "single_model"),
        violation(F.sum(F.col("n") - 1), "unique_keys"),
        violation(F.sum("bad"), "finite_values"),
    )
    return check_table(
        totals,
        {
            "not_empty": "At least one prediction is required.",
            "single_model": "A prediction frame holds exactly one model.",
            "unique_keys": "Forecast keys must be unique.",
            "finite_values": "Actual and predicted values must be finite.",
        },
    )


def alignment_checks(combined: DataFrame, n_models: int) -> DataFrame:
    """Every observation is predicted by every model with equal metadata and actual value.

    One grouping by forecast key replaces the pairwise comparison of model frames.
    """
    require_columns(combined, PREDICTION_COLUMNS, "combined predictions")
    per_key = combined.groupBy(*FORECAST_KEY).agg(
        F.size(F.collect_set("model")).alias("models"),
        F.count(F.lit(1)).alias("n"),
        *[F.size(F.collect_set(c)).alias(f"d_{c}") for c in SERIES_ATTRS],
        (F.max("actual") - F.min("actual")).alias("spread"),
    )
    totals = per_key.agg(
        violation(F.count_if((F.col("models") != n_models) | (F.col("n") != n_models)), "same_keys"),
        violation(F.count_if(F.greatest(*[F.col(f"d_{c}") for c in SERIES_ATTRS]) > 1), "same_metadata"),
        violation(F.count_if(F.col("spread") > ALIGNMENT_TOLERANCE), "same_actual"),
    )
    return check_table(
        totals,
        {
            "same_keys": "Every model must predict every observation once.",
            "same_metadata": "Series metadata must agree between models.",
            "same_actual": "Actual values must agree between models.",
        },
    )


def backtest_checks(predictions: DataFrame, n_origins: int = N_ORIGINS, horizon: int = HORIZON) -> DataFrame:
    """Completeness of one model's backtest: origins per series and exact horizon steps per origin."""
    numbers = [F.col(c) for c in ("actual", "predicted", "error", "absolute_error", "squared_error")]
    bad = numbers[0].isNull()
    for n in numbers:
        bad = bad | not_finite(n)
    per_origin = predictions.groupBy("series_id", "origin").agg(
        F.count(F.lit(1)).alias("n"),
        F.sort_array(F.collect_set("horizon_step")).alias("steps"),
        F.count_if(bad).alias("bad"),
    )
    wanted = F.array(*[F.lit(h) for h in range(1, horizon + 1)])
    per_series = per_origin.groupBy("series_id").agg(
        F.count(F.lit(1)).alias("origins"),
        F.sum("n").alias("rows"),
        F.count_if(F.col("steps").cast("array<int>") != wanted).alias("bad_steps"),
        F.sum("bad").alias("bad"),
    )
    totals = per_series.agg(
        violation(F.count_if(F.col("rows") != n_origins * horizon), "row_count"),
        violation(F.count_if(F.col("origins") != n_origins), "origin_count"),
        violation(F.sum("bad_steps"), "horizon_steps"),
        violation(F.sum("bad"), "finite_values"),
    )
    return check_table(
        totals,
        {
            "row_count": "Each series needs origins x horizon rows.",
            "origin_count": "Each series needs the full number of origins.",
            "horizon_steps": "Each origin needs every horizon step exactly once.",
            "finite_values": "Forecast results must be finite.",
        },
    )


def continuity_checks(panel: DataFrame) -> DataFrame:
    """One row per series: is it an unbroken run of months?"""
    month = month_number(F.col("period_date"))
    return (
        panel.groupBy("series_id")
        .agg(
            (F.max(month) - F.min(month) + 1).cast("bigint").alias("expected_months"),
            F.size(F.collect_set("period_date")).cast("bigint").alias("observed_months"),
        )
        .withColumn("continuous", F.col("expected_months") == F.col("observed_months"))
    )


def common_origin_checks(panel: DataFrame) -> DataFrame:
    """Do all series end in the same month?"""
    last = panel.groupBy("series_id").agg(F.max("period_date").alias("last_period"))
    ends = last.agg(
        F.min("last_period").alias("earliest_end"),
        F.max("last_period").alias("latest_end"),
        F.count(F.lit(1)).alias("n_series"),
    )
    return ends.withColumn("common_origin", F.col("earliest_end") == F.col("latest_end"))


def comparison_completeness(combined: DataFrame, products: Mapping[str, DataFrame]) -> DataFrame:
    """Row counts of the comparison products against what the combined predictions imply."""
    per_key = combined.groupBy(*FORECAST_KEY, "metric").agg(F.size(F.collect_set("model")).alias("models"))
    per_series = per_key.groupBy("series_id", "metric").agg(
        F.count(F.lit(1)).alias("keys"),
        F.sum("models").alias("rows"),
        F.min("models").alias("least_models"),
        F.max("models").alias("most_models"),
        F.size(F.collect_set("origin")).alias("origins"),
        F.size(F.collect_set("horizon_step")).alias("horizons"),
    )
    facts = per_series.agg(
        F.max("most_models").alias("n_models"),
        F.min("least_models").alias("least_models"),
        F.size(F.collect_set("metric")).alias("n_metrics"),
        F.count(F.lit(1)).alias("n_series"),
        F.max("origins").alias("n_origins"),
        F.min("origins").alias("least_origins"),
        F.max("horizons").alias("n_horizons"),
        F.sum("rows").alias("combined_rows"),
    )
    facts = beside(facts, *[f.agg(F.count(F.lit(1)).alias(f"{name}_rows")) for name, f in products.items()])
    m, s, o, h, k = (F.col(c) for c in ("n_models", "n_series", "n_origins", "n_horizons", "n_metrics"))
    wanted = {
        "metrics_by_origin": m * s * o,
        "metrics_by_series": m * s,
        "metrics_by_horizon": m * k * h,
        "model_comparison": m * k,
        "series_model_winners": s,
    }
    gaps = [
        violation(o - F.col("least_origins"), "equal_origins"),
        violation(m - F.col("least_models"), "models_per_observation"),
        violation(F.abs(F.col("combined_rows") - m * s * o * h), "combined_rows"),
        *[violation(F.abs(F.col(f"{n}_rows") - wanted[n]), f"{n}_rows") for n in products],
    ]
    details = {
        "equal_origins": "Series must share one number of origins.",
        "models_per_observation": "Every observation needs every model.",
        "combined_rows": "Combined rows must be models x series x origins x horizons.",
        **{f"{n}_rows": f"Row count of {n} must follow from the predictions." for n in products},
    }
    return check_table(facts.select(*gaps), details)


def set_difference_table(expected: DataFrame, observed: DataFrame, key: str = "series_id") -> DataFrame:
    """Keys on one side only, labelled ``missing`` or ``extra``; empty means equal sets."""
    left, right = expected.select(key).distinct(), observed.select(key).distinct()
    missing = left.join(right, key, "left_anti").withColumn("side", F.lit("missing"))
    extra = right.join(left, key, "left_anti").withColumn("side", F.lit("extra"))
    return missing.unionByName(extra)


def one_valued(df: DataFrame, column: str, allowed: Sequence[str]) -> DataFrame:
    """Values of ``column`` outside ``allowed``, plus allowed values that never occur."""
    seen = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("rows"))
    wanted = df.sparkSession.createDataFrame([(a,) for a in allowed], f"{column} string")
    both = seen.join(wanted.withColumn("wanted", F.lit(True)), column, "full")
    return both.where(F.col("wanted").isNull() | F.col("rows").isNull()).select(column, "rows")
