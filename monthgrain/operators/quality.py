"""Series coverage, quality and modelling readiness."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from monthgrain.contracts import (
    HORIZON,
    MIN_HISTORY_MONTHS,
    N_ORIGINS,
    REQUIRED_RUN_MONTHS,
    SEASON,
    SERIES_ATTRS,
    require_columns,
)
from monthgrain.functions.parsing import month_number
from monthgrain.operators.joins import beside

CATALOG_ORDER = ("metric", "geography_level", "location_id")


def series_catalog(panel: DataFrame, required_months: int = REQUIRED_RUN_MONTHS) -> DataFrame:
    """One row per series: coverage, gaps, the trailing unbroken run and eligibility.

    A single map-side-combined aggregation. The only growing state is the set of distinct months,
    bounded by the calendar whatever the number of rows, so a series holding a large part of all rows
    is collapsed before the exchange.
    """
    require_columns(panel, ("series_id", "period_date", "value", *SERIES_ATTRS), "panel")
    missing_value = F.col("value").isNull() | F.isnan("value")
    base = panel.groupBy("series_id").agg(
        *[F.min_by(c, "period_date").alias(c) for c in SERIES_ATTRS],
        F.min("period_date").alias("start_period"),
        F.max("period_date").alias("end_period"),
        F.count(F.lit(1)).alias("n_observations"),
        F.count_if(missing_value).alias("null_values"),
        F.max(F.when(missing_value, F.col("period_date"))).alias("_last_null"),
        F.sort_array(F.collect_set("period_date"), asc=False).alias("_months"),
    )
    end = month_number(F.col("end_period"))
    expected = (end - month_number(F.col("start_period")) + 1).cast("bigint")
    unbroken = F.filter(F.col("_months"), lambda d, i: end - month_number(d) == i)
    run = base.withColumn("_run", unbroken).withColumn("expected_observations", expected)
    run = run.withColumn("continuous_start", F.array_min("_run"))
    return run.select(
        "series_id",
        "geography_level",
        "location_id",
        "location_name",
        "metric",
        "start_period",
        "end_period",
        "n_observations",
        "expected_observations",
        (F.col("expected_observations") - F.size("_months")).cast("bigint").alias("missing_months"),
        "null_values",
        (F.col("n_observations") / F.col("expected_observations")).alias("completeness_rate"),
        "continuous_start",
        F.size("_run").cast("bigint").alias("continuous_months"),
        (
            (F.size("_run") >= required_months)
            & F.coalesce(F.col("_last_null") < F.col("continuous_start"), F.lit(True))
        ).alias("eligible_for_forecasting"),
    )


def quality_summary(panel: DataFrame) -> DataFrame:
    """Duplicate, null, negative and zero counts per series with a PASS/FAIL verdict."""
    require_columns(panel, ("series_id", "period_date", "metric", "value", "source_snapshot_provisional"), "panel")
    v = F.col("value")
    counts = panel.groupBy("series_id").agg(
        F.min_by("metric", "period_date").alias("metric"),
        (F.count(F.lit(1)) - F.size(F.collect_set("period_date"))).cast("bigint").alias("duplicate_periods"),
        F.count_if(v.isNull() | F.isnan(v)).alias("null_values"),
        F.count_if(v < 0).alias("negative_values"),
        F.count_if(v == 0).alias("zero_values"),
        F.coalesce(F.bool_or("source_snapshot_provisional"), F.lit(False)).alias("source_snapshot_provisional"),
    )
    bad = F.col("duplicate_periods") + F.col("null_values") + F.col("negative_values")
    return counts.withColumn("status", F.when(bad == 0, "PASS").otherwise("FAIL"))


def modelling_readiness(panel: DataFrame, catalog: DataFrame, quality: DataFrame) -> DataFrame:
    """One-row gate over the catalog and quality summaries."""
    require_columns(panel, ("period_date", "series_id", "metric", "value"), "panel")
    require_columns(
        catalog,
        ("series_id", "n_observations", "missing_months", "continuous_months", "eligible_for_forecasting"),
        "catalog",
    )
    require_columns(quality, ("series_id", "status"), "quality summary")
    spans = panel.groupBy("series_id").agg(F.min("period_date").alias("lo"), F.max("period_date").alias("hi"))
    extent = spans.agg(
        F.count(F.lit(1)).alias("n_series"), F.min("lo").alias("start_period"), F.max("hi").alias("end_period")
    )
    passed = quality.groupBy("series_id").agg(F.bool_or(F.col("status") == "PASS").alias("passed"))
    ok, eligible = F.col("passed"), F.col("eligible_for_forecasting")
    counts = catalog.join(passed, "series_id", "full").agg(
        F.count_if(F.col("missing_months") == 0).alias("complete_series"),
        F.count_if(eligible).alias("forecast_eligible_series"),
        F.count_if(ok).alias("quality_pass_series"),
        F.count_if(eligible & ok).alias("eligible_quality_pass_series"),
        F.min("n_observations").alias("minimum_observations"),
        F.coalesce(F.min(F.when(eligible, F.col("continuous_months"))), F.lit(0)).cast("bigint").alias(
            "minimum_eligible_continuous_months"
        ),
    )
    n, shortest = F.col("forecast_eligible_series"), F.col("minimum_eligible_continuous_months")
    rolling = (n > 0) & (shortest >= REQUIRED_RUN_MONTHS)
    features = (n > 0) & (shortest > SEASON)
    checked = (n > 0) & (F.col("eligible_quality_pass_series") == n)
    return beside(extent, counts).select(
        (rolling & features & checked).alias("dataset_ready"),
        "n_series",
        "complete_series",
        "forecast_eligible_series",
        "quality_pass_series",
        "eligible_quality_pass_series",
        "minimum_observations",
        "minimum_eligible_continuous_months",
        "start_period",
        "end_period",
        F.lit(HORIZON).alias("forecast_horizon"),
        F.lit(SEASON).alias("seasonal_period"),
        F.lit(N_ORIGINS).alias("rolling_origins"),
        F.lit(MIN_HISTORY_MONTHS).alias("minimum_history_months"),
        F.lit(REQUIRED_RUN_MONTHS).alias("required_continuous_months"),
        rolling.alias("rolling_origin_ready"),
        features.alias("feature_history_ready"),
    )


def catalog_histogram(catalog: DataFrame, column: str) -> DataFrame:
    return catalog.groupBy(column).agg(F.count(F.lit(1)).alias("n_series"))
