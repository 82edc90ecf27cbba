"""Descriptive history: summaries per series, movements, growth and seasonality."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, functions as F

from monthgrain.contracts import SERIES_ATTRS, require_columns
from monthgrain.functions.frames import by_month, full_mean, months_back, newest_first
from monthgrain.functions.parsing import number_or_null
from monthgrain.functions.scoring import percent_change, percent_of

KEYS = ("series_id", *SERIES_ATTRS)


def _numeric(panel: DataFrame) -> DataFrame:
    require_columns(panel, ("period_date", "series_id", "value", *SERIES_ATTRS), "panel")
    return panel.withColumn("value", number_or_null(F.col("value")))


def _spread(prefix: str = "", suffix: str = "") -> list:
    name = lambda n: f"{prefix}{n}{suffix}"
    return [
        F.avg("value").alias(name("mean")),
        F.median("value").alias(name("median")),
        F.stddev_samp("value").alias(name("std")),
        F.min("value").alias(name("minimum")),
        F.max("value").alias(name("maximum")),
    ]


def historical_summary(panel: DataFrame) -> DataFrame:
    """Level, spread and latest movement of every series (lags count rows, not months)."""
    w = by_month()
    v = F.col("value")
    moved = _numeric(panel).select(
        *KEYS,
        "period_date",
        "value",
        (v - F.lag(v, 1).over(w)).alias("_step"),
        F.lag(v, 12).over(w).alias("_year_before"),
    )
    latest = F.max_by(F.struct("value", "_step", "_year_before"), "period_date").alias("_latest")
    out = moved.groupBy(*KEYS).agg(
        F.min("period_date").alias("start_period"),
        F.max("period_date").alias("end_period"),
        F.count(F.lit(1)).alias("n_observations"),
        *_spread(),
        latest,
        F.avg("_step").alias("mean_monthly_change"),
        F.stddev_samp("_step").alias("std_monthly_change"),
    )
    change = F.col("_latest.value") - F.col("_latest._year_before")
    return out.withColumns(
        {
            "latest_value": F.col("_latest.value"),
            "change_1m": F.col("_latest._step"),
            "change_12m": change,
            "pct_change_12m": percent_of(change, F.col("_latest._year_before")),
        }
    ).drop("_latest")


def monthly_seasonality(panel: DataFrame) -> DataFrame:
    """Statistics by calendar month."""
    return (
        _numeric(panel)
        .groupBy(*KEYS, F.month("period_date").alias("month"))
        .agg(*_spread(suffix="_value"), F.count("value").alias("n_observations"))
    )


def last_rows(df: DataFrame, n: int, key: str = "series_id", period: str = "period_date") -> DataFrame:
    """Newest ``n`` rows of every series."""
    if n < 1:
        raise ValueError("n must be at least 1")
    place = F.row_number().over(newest_first(key, period))
    return df.withColumn("_place", place).where(F.col("_place") <= n).drop("_place")


def recent_history(panel: DataFrame, recent_months: int = 24) -> DataFrame:
    """Statistics of the newest rows of every series."""
    recent = last_rows(_numeric(panel), recent_months)
    return recent.groupBy(*KEYS).agg(
        F.min("period_date").alias("recent_start_period"),
        F.max("period_date").alias("recent_end_period"),
        F.count(F.lit(1)).alias("recent_observations"),
        *_spread("recent_"),
    )


def movements(panel: DataFrame) -> DataFrame:
    """Rolling 12-row mean, month-on-month (rows) and year-on-year (calendar) change; one exchange."""
    w, v = by_month(), F.col("value")
    year_ago = F.max(v).over(months_back(12))
    return panel.withColumns(
        {
            "value_year_ago": year_ago,
            "rolling_12m": full_mean(v, w, -11, 0),
            "mom_pct": percent_change(v, F.lag(v, 1).over(w)),
        }
    ).withColumn("yoy_pct", percent_change(v, F.col("value_year_ago")))


def year_ago_by_join(panel: DataFrame) -> DataFrame:
    """Year-ago value by a self join on the shifted month (same result as the calendar frame)."""
    shifted = panel.select(
        "series_id", F.add_months("period_date", 12).alias("period_date"), F.col("value").alias("value_year_ago")
    )
    return panel.join(shifted, ["series_id", "period_date"], "left")


def in_range(df: DataFrame, start: str | dt.date, end: str | dt.date, column: str = "period_date") -> DataFrame:
    """Rows inside an inclusive date range; text dates are accepted."""
    return df.where(F.col(column).between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def one_series(df: DataFrame, level: str, location: str, metric: str) -> DataFrame:
    return df.where(
        (F.col("geography_level") == level) & (F.col("location_name") == location) & (F.col("metric") == metric)
    )


def latest_years(df: DataFrame, years: int, column: str = "period_date") -> DataFrame:
    """Rows from the newest ``years`` of the data set; the bound is a scalar subquery."""
    newest = df.agg(F.add_months(F.max(column), -12 * years))
    return df.where(F.col(column) >= newest.scalar())


def annual_averages(panel: DataFrame) -> DataFrame:
    """Yearly means; growth only between two consecutive listed years that both have twelve months."""
    yearly = panel.groupBy(*KEYS, F.year("period_date").alias("year")).agg(
        F.avg("value").alias("average"), F.count(F.lit(1)).alias("months")
    )
    w = by_month("series_id", "year")
    full, before = F.col("months") >= 12, F.lag("average", 1).over(w)
    both_full = full & (F.lag("months", 1).over(w) >= 12)
    return yearly.withColumns(
        {
            "coverage": F.when(full, "Full year").otherwise("Partial year"),
            "yoy_pct": F.when(both_full, percent_change(F.col("average"), before)),
        }
    )


def period_kpis(panel: DataFrame) -> DataFrame:
    """Headline figures of every series: latest, extremes with their first dates, average, change."""
    w, v = by_month(), F.col("value")
    rows = panel.select(
        *KEYS,
        "period_date",
        "value",
        F.lag(v, 1).over(w).alias("_before"),
        F.max(v).over(months_back(12)).alias("_year_ago"),
    )
    recency = -F.datediff("period_date", F.lit(dt.date(1970, 1, 1)))
    out = rows.groupBy(*KEYS).agg(
        F.max("period_date").alias("latest_date"),
        F.max_by(F.struct("value", "_before", "_year_ago"), "period_date").alias("_latest"),
        F.min_by("value", "period_date").alias("_first"),
        F.avg("value").alias("period_average"),
        F.min(F.when(v.isNotNull(), F.struct("value", "period_date"))).alias("_low"),
        F.max(F.when(v.isNotNull(), F.struct(v, recency.alias("recency"), F.col("period_date")))).alias("_high"),
    )
    now = F.col("_latest.value")
    return out.select(
        *KEYS,
        "latest_date",
        now.alias("latest_value"),
        percent_of(now - F.col("_latest._before"), F.col("_latest._before")).alias("mom_change"),
        percent_of(now - F.col("_latest._year_ago"), F.col("_latest._year_ago")).alias("yoy_change"),
        "period_average",
        percent_of(now - F.col("_first"), F.col("_first")).alias("period_change"),
        F.col("_low.value").alias("minimum_value"),
        F.col("_low.period_date").alias("minimum_date"),
        F.col("_high.value").alias("maximum_value"),
        F.col("_high.period_date").alias("maximum_date"),
    )


def annualised_growth(panel: DataFrame) -> DataFrame:
    """Compound yearly growth between the first and last valid 12-month mean.

    Falls back to the end months when fewer than two such means exist; needs a span of a year and
    positive ends.
    """
    smooth = panel.select(
        *KEYS, "period_date", "value", full_mean(F.col("value"), by_month(), -11, 0).alias("rolling_12m")
    )
    valid = F.when(F.col("rolling_12m").isNotNull(), F.col("period_date"))
    ends = smooth.groupBy(*KEYS).agg(
        F.count("rolling_12m").alias("_n"),
        F.min_by(F.struct("rolling_12m", "period_date"), valid).alias("_first_mean"),
        F.max_by(F.struct("rolling_12m", "period_date"), valid).alias("_last_mean"),
        F.min_by(F.struct("value", "period_date"), "period_date").alias("_first"),
        F.max_by(F.struct("value", "period_date"), "period_date").alias("_last"),
    )
    smoothed = F.col("_n") >= 2
    pick = lambda a, b: F.when(smoothed, F.col(a)).otherwise(F.col(b))
    out = ends.select(
        *KEYS,
        F.when(smoothed, "12-month averages").otherwise("monthly values").alias("growth_basis"),
        pick("_first_mean.period_date", "_first.period_date").alias("growth_start"),
        pick("_last_mean.period_date", "_last.period_date").alias("growth_end"),
        pick("_first_mean.rolling_12m", "_first.value").alias("_a"),
        pick("_last_mean.rolling_12m", "_last.value").alias("_b"),
    )
    years = F.datediff("growth_end", "growth_start") / 365.25
    usable = (years >= 1) & (F.col("_a") > 0) & (F.col("_b") > 0)
    growth = (F.pow(F.col("_b") / F.col("_a"), F.lit(1.0) / years) - 1) * 100.0
    return out.withColumn("annualised_growth", F.when(usable, growth)).drop("_a", "_b")


def seasonal_profile(seasonality: DataFrame) -> DataFrame:
    """Calendar-month medians against their mean, with peak, low and spread of each series."""
    require_columns(seasonality, ("series_id", "month", "median_value"), "seasonality")
    per_series = seasonality.groupBy("series_id").agg(
        F.avg("median_value").alias("seasonal_mean"),
        F.min(F.struct("median_value", "month")).alias("_low"),
        F.max(F.struct(F.col("median_value"), (-F.col("month")).alias("m"))).alias("_peak"),
    )
    spread = percent_of(F.col("_peak.median_value") - F.col("_low.median_value"), F.col("seasonal_mean"))
    facts = per_series.select(
        "series_id",
        "seasonal_mean",
        (-F.col("_peak.m")).alias("peak_month"),
        F.col("_low.month").alias("low_month"),
        spread.alias("spread_pct"),
    )
    return seasonality.select(*KEYS, "month", "median_value").join(facts, "series_id").withColumn(
        "deviation_pct", percent_change(F.col("median_value"), F.col("seasonal_mean"))
    )


def history_table(panel: DataFrame) -> DataFrame:
    """Newest-first values with both movements."""
    columns = ("series_id", "period_date", "value", "mom_pct", "yoy_pct")
    return movements(panel).select(*columns).orderBy(F.col("period_date").desc(), "series_id")


def export_rounded(panel: DataFrame) -> DataFrame:
    """Download layout: month text, renamed percentages, two decimals."""
    return movements(panel).select(
        "series_id",
        F.date_format("period_date", "yyyy-MM").alias("period"),
        F.round("value", 2).alias("value"),
        F.round("mom_pct", 2).alias("month_on_month_pct"),
        F.round("yoy_pct", 2).alias("year_on_year_pct"),
    )
