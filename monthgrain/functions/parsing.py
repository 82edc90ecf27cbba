"""Text-to-typed-value expressions; a value that does not parse becomes NULL and is counted by a check."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

ZONE_SUFFIX = r"(Z|[+-]\d{2}:?\d{2})$"
MEASURE_TYPE = "decimal(18,4)"


def month_from_dmy(text: Column) -> Column:
    """``D/MM/YYYY`` to a date; NULL unless it is the first day of a month."""
    day = F.to_date(F.try_to_timestamp(text, F.lit("d/M/yyyy")))
    return F.when(F.dayofmonth(day) == 1, day)


def _unpadded_date(text: Column) -> Column:
    return F.to_date(F.try_to_timestamp(F.trim(text), F.lit("yyyy-M-d")))


def period_range(text: Column) -> Column:
    """``2026-7-1/2026-7-31`` to ``struct(period_start, period_end)``; NULL unless start <= end."""
    parts = F.split(text, "/")
    start, end = _unpadded_date(F.get(parts, F.lit(0))), _unpadded_date(F.get(parts, F.lit(1)))
    pair = F.struct(start.alias("period_start"), end.alias("period_end"))
    return F.when((F.size(parts) == 2) & (start <= end), pair)


def whole_number(text: Column) -> Column:
    """Integer held as text or float; NULL when it is not a number or has a fraction.

    Fixed-point, since a double would round whole numbers beyond 2**53.
    """
    number = text.try_cast("decimal(38,18)")
    return F.when(number == F.floor(number), number.try_cast("bigint"))


def measure(text: Column) -> Column:
    """Fixed-point measure; NULL when the text is not numeric."""
    return text.try_cast(MEASURE_TYPE)


def number_or_null(value: Column) -> Column:
    """Coerce to double; unparsable text and NaN both become NULL."""
    number = value.try_cast("double")
    return F.when(~F.isnan(number), number)


def flag(text: Column) -> Column:
    """``true`` / ``false`` in any case and padding; anything else is NULL."""
    word = F.lower(F.trim(text))
    return F.when(word == "true", True).when(word == "false", False)


def zoned_instant(text: Column) -> Column:
    """ISO timestamp that must carry a zone."""
    return F.when(text.rlike(ZONE_SUFFIX), text.try_cast("timestamp"))


def present_text(text: Column) -> Column:
    """Trimmed text, NULL when blank."""
    word = F.trim(text)
    return F.when(word != "", word)


def series_key(level: Column, location: Column, metric: Column) -> Column:
    return F.concat_ws("_", level, location.cast("string"), metric)


def month_number(day: Column) -> Column:
    """Months since year 0, so that month arithmetic is integer subtraction."""
    return F.year(day) * 12 + F.month(day)
