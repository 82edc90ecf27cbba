"""Window specifications used by the series operators.

Every operator of a family uses the same partitioning and ordering, so one exchange and one sort on
``series_id`` serve all of them. A series holds one row per month, which bounds each partition.
"""

from __future__ import annotations

from pyspark.sql import Column, Window, functions as F
from pyspark.sql.window import WindowSpec

from monthgrain.functions.parsing import month_number


def by_month(key: str = "series_id", period: str = "period_date") -> WindowSpec:
    return Window.partitionBy(key).orderBy(period)


def newest_first(key: str = "series_id", period: str = "period_date") -> WindowSpec:
    return Window.partitionBy(key).orderBy(F.col(period).desc())


def whole_series(key: str = "series_id") -> WindowSpec:
    return Window.partitionBy(key)


def months_back(months: int, key: str = "series_id", period: str = "period_date") -> WindowSpec:
    """Frame holding only the row exactly ``months`` calendar months earlier (empty if absent)."""
    return Window.partitionBy(key).orderBy(month_number(F.col(period))).rangeBetween(-months, -months)


def full_mean(value: Column, spec: WindowSpec, first: int, last: int) -> Column:
    """Mean over a row frame, NULL until the frame is full of non-null values."""
    frame = spec.rowsBetween(first, last)
    return F.when(F.count(value).over(frame) == last - first + 1, F.avg(value).over(frame))


def reject_repeats(value: Column, spec: WindowSpec, period: Column, what: str) -> Column:
    """``value``, failing the job when two rows of a series share a month."""
    repeated = F.lag(period, 1).over(spec) == period
    return F.when(repeated, F.raise_error(F.lit(f"{what} has two rows for one series and month"))).otherwise(value)
