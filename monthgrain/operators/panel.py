"""Wide monthly table to the long monthly panel."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from monthgrain.contracts import (
    AGGREGATE_LOCATION_IDS,
    LEVELS,
    METRICS,
    PANEL_COLUMNS,
    require_columns,
)
from monthgrain.functions.parsing import number_or_null, series_key
from monthgrain.operators.checks import check_table, violation

WIDE_KEYS = ("period_date", "geography_level", "location_id", "location_name", "is_provisional", "source_snapshot_id")
PANEL_ORDER = ("metric", "geography_level", "location_id", "period_date")


def core_geographies(wide: DataFrame) -> DataFrame:
    """Keep regions and territorial authorities, without the total and unknown rows."""
    require_columns(wide, ("geography_level", "location_id"), "wide table")
    return wide.where(F.col("geography_level").isin(*LEVELS) & ~F.col("location_id").isin(*AGGREGATE_LOCATION_IDS))


def melt_metrics(wide: DataFrame) -> DataFrame:
    """One row per metric; a map-side reshape, no exchange."""
    require_columns(wide, (*WIDE_KEYS, *METRICS), "wide table")
    typed = wide.select(*WIDE_KEYS, *[number_or_null(F.col(m)).alias(m) for m in METRICS])
    return typed.unpivot(list(WIDE_KEYS), list(METRICS), "metric", "value").select(
        F.col("period_date").cast("date").alias("period_date"),
        series_key(F.col("geography_level"), F.col("location_id"), F.col("metric")).alias("series_id"),
        "geography_level",
        "location_id",
        "location_name",
        "metric",
        "value",
        F.col("is_provisional").alias("source_snapshot_provisional"),
        "source_snapshot_id",
    )


def monthly_panel(wide: DataFrame) -> DataFrame:
    """Long panel; sorting is left to the sink and validation to :func:`panel_checks`."""
    return melt_metrics(core_geographies(wide))


def panel_checks(panel: DataFrame) -> DataFrame:
    """Structural checks in one pass: counts per key first (combined map-side), then one global row."""
    require_columns(panel, PANEL_COLUMNS, "panel")
    day = F.col("period_date")
    per_key = panel.groupBy("series_id", "period_date").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("metric").isNotNull() & ~F.col("metric").isin(*METRICS)).alias("odd_metric"),
        F.count_if(day.isNull()).alias("no_date"),
        F.count_if(F.dayofmonth(day) != 1).alias("mid_month"),
    )
    totals = per_key.agg(
        violation(F.sum("odd_metric"), "known_metrics"),
        violation(F.sum(F.when(F.col("n") > 1, F.col("n"))), "unique_series_period"),
        violation(F.sum("no_date"), "dated_rows"),
        violation(F.sum("mid_month"), "month_starts"),
    )
    return check_table(
        totals,
        {
            "known_metrics": "Only the two panel metrics may appear.",
            "unique_series_period": "Each series-period must appear exactly once.",
            "dated_rows": "Every row needs a period date.",
            "month_starts": "Period dates must be the first day of a month.",
        },
    )
