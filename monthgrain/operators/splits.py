"""Series selection and rolling-origin evaluation windows."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, functions as F

from monthgrain.contracts import HORIZON, MIN_HISTORY_MONTHS, N_ORIGINS, REQUIRED_RUN_MONTHS, require_columns
from monthgrain.functions.frames import by_month, newest_first, whole_series
from monthgrain.functions.parsing import month_number
from monthgrain.operators.joins import checked_join, without_duplicated_series


def select_series(panel: DataFrame, catalog: DataFrame) -> DataFrame:
    """Eligible series cut at the start of their trailing unbroken run, duplicates left out."""
    require_columns(panel, ("series_id", "period_date"), "panel")
    require_columns(catalog, ("series_id", "continuous_start", "continuous_months", "eligible_for_forecasting"), "catalog")
    chosen = without_duplicated_series(catalog.where("eligible_for_forecasting")).select("series_id", "continuous_start")
    kept = checked_join(panel, chosen, ["series_id"], "inner", "series catalog")
    return kept.where(F.col("period_date") >= F.col("continuous_start")).select(*panel.columns)


def complete_months(panel: DataFrame, before: dt.date | None) -> DataFrame:
    """Rows of months before ``before``, so that all series end in the same, finished month; all rows without it."""
    return panel if before is None else panel.where(F.col("period_date") < F.lit(before))


def select_trailing_runs(
    panel: DataFrame, required_months: int = REQUIRED_RUN_MONTHS, before: dt.date | None = None
) -> DataFrame:
    """Same rows as :func:`select_series` with the panel's own catalog, in one pass; ``before`` as in :func:`complete_months`.

    A month belongs to the trailing run when its distance from the last month equals its place counted
    from the end. Everything is a window over the series, so no catalog is built, nothing is joined back,
    and the operators that follow keep the partitioning.
    """
    require_columns(panel, ("series_id", "period_date", "value"), "panel")
    panel = complete_months(panel, before)
    everything = whole_series()
    back = F.max(month_number(F.col("period_date"))).over(everything) - month_number(F.col("period_date"))
    placed = without_duplicated_series(panel).withColumn(
        "_in_run", back == F.dense_rank().over(newest_first()) - 1
    )
    months = F.count_if("_in_run").over(everything)
    gaps = F.count_if(F.col("_in_run") & (F.col("value").isNull() | F.isnan("value"))).over(everything)
    judged = placed.withColumns({"_months": months, "_gaps": gaps})
    chosen = F.col("_in_run") & (F.col("_months") >= required_months) & (F.col("_gaps") == 0)
    return judged.where(chosen).select(*panel.columns)


def _complete_run(place: Column, n: Column, first: Column, last: Column, needed: int) -> Column:
    gap = month_number(last) - month_number(first) + 1 != n
    return (
        F.when(gap, F.raise_error(F.lit("months are missing or repeated")))
        .when(n < needed, F.raise_error(F.lit("too few months for a rolling-origin window")))
        .otherwise(place)
    )


def with_origin_bounds(
    panel: DataFrame,
    horizon: int = HORIZON,
    n_origins: int = N_ORIGINS,
    min_history: int = MIN_HISTORY_MONTHS,
    strict: bool = True,
) -> DataFrame:
    """Add the row number of every month and the first and last row number usable as an origin."""
    if min(horizon, n_origins, min_history) < 1:
        raise ValueError("horizon, n_origins and min_history must be at least 1")
    everything, w = whole_series(), by_month()
    rows = panel.withColumns(
        {
            "_place": F.row_number().over(w),
            "_n": F.count(F.lit(1)).over(everything),
            "_start": F.min("period_date").over(everything),
            "_end": F.max("period_date").over(everything),
        }
    )
    if strict:
        place = _complete_run(F.col("_place"), F.col("_n"), F.col("_start"), F.col("_end"), min_history + horizon)
        rows = rows.withColumn("_place", place)
    return rows.withColumns(
        {
            "_first_origin": F.greatest(F.lit(min_history), F.col("_n") - horizon - n_origins + 1),
            "_last_origin": F.col("_n") - horizon,
        }
    )


def rolling_origins(
    panel: DataFrame,
    horizon: int = HORIZON,
    n_origins: int = N_ORIGINS,
    min_history: int = MIN_HISTORY_MONTHS,
    strict: bool = True,
) -> DataFrame:
    """One row per evaluation window; the newest ``n_origins`` with enough history before them."""
    rows = with_origin_bounds(panel, horizon, n_origins, min_history, strict)
    return rows.where(F.col("_place").between(F.col("_first_origin"), F.col("_last_origin"))).select(
        "series_id",
        F.col("period_date").alias("origin"),
        F.col("_start").alias("train_start"),
        F.col("period_date").alias("train_end"),
        F.add_months("period_date", 1).alias("test_start"),
        F.add_months("period_date", horizon).alias("test_end"),
        F.lit(horizon).alias("horizon"),
    )


def slice_origins(panel: DataFrame, splits: DataFrame) -> DataFrame:
    """Train and test rows of every window: an equi join on the series with a month condition."""
    require_columns(panel, ("series_id", "period_date", "value"), "panel")
    windows = splits.select("series_id", "origin", "train_end", "test_start", "test_end")
    part = F.when(F.col("period_date") <= F.col("train_end"), "train").when(
        F.col("period_date").between(F.col("test_start"), F.col("test_end")), "test"
    )
    joined = panel.select("series_id", "period_date", "value").join(windows, "series_id")
    return (
        joined.where(F.col("period_date") <= F.col("test_end"))
        .withColumn("part", part)
        .select("series_id", "origin", "part", "period_date", "value")
    )
