"""Rows and checks that several test modules share."""

from __future__ import annotations

import datetime as dt

import pytest


def month(start: str, offset: int) -> dt.date:
    first = dt.date.fromisoformat(start)
    index = first.year * 12 + first.month - 1 + offset
    return dt.date(index // 12, index % 12 + 1, 1)


def series_rows(values, start="2015-01-01", location=1, metric="median_rent", level="region", skip=()):
    sid = f"{level}_{location}_{metric}"
    return [
        (month(start, i), sid, level, location, f"Place {location}", metric, v, False, 1)
        for i, v in enumerate(values)
        if i not in skip
    ]


def raises_in_job(df, text: str) -> None:
    """The plan is lazy: the failure shows when the rows are produced."""
    with pytest.raises(Exception) as caught:
        df.collect()
    assert text in str(caught.value)
