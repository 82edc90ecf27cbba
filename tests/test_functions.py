from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from monthgrain.functions import parsing, scoring


def values(spark, rows, schema, column):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


def test_month_from_dmy(spark):
    rows = [("1/07/2026",), ("01/7/2026",), ("2/07/2026",), ("2026-07-01",), ("31/02/2026",), (None,)]
    got = values(spark, rows, "t string", parsing.month_from_dmy(F.col("t")))
    assert got == [dt.date(2026, 7, 1), dt.date(2026, 7, 1), None, None, None, None]


def test_period_range(spark):
    rows = [("2026-7-1/2026-7-31",), ("2026-7-31/2026-7-1",), ("2026-7-1",), ("x/2026-7-1",), ("2026-7-1/2026-7-2/2026-7-3",)]
    got = values(spark, rows, "t string", parsing.period_range(F.col("t")))
    assert tuple(got[0]) == (dt.date(2026, 7, 1), dt.date(2026, 7, 31))
    assert got[1:] == [None] * 4


def test_whole_number_and_measure(spark):
    rows = [("12",), ("12.0",), ("12.5",), ("NA",), ("",), (None,)]
    assert values(spark, rows, "t string", parsing.whole_number(F.col("t"))) == [12, 12, None, None, None, None]
    got = values(spark, rows, "t string", parsing.measure(F.col("t")))
    assert [None if v is None else float(v) for v in got] == [12, 12, 12.5, None, None, None]


def test_number_or_null_drops_nan(spark):
    rows = [("1.5",), ("bad",), ("NaN",), (None,)]
    assert values(spark, rows, "t string", parsing.number_or_null(F.col("t"))) == [1.5, None, None, None]


def test_flag_and_text(spark):
    rows = [(" TRUE ",), ("False",), ("yes",), ("  ",)]
    assert values(spark, rows, "t string", parsing.flag(F.col("t"))) == [True, False, None, None]
    assert values(spark, rows, "t string", parsing.present_text(F.col("t"))) == ["TRUE", "False", "yes", None]


def test_instant_needs_zone(spark):
    rows = [("2026-07-01T00:00:00+12:00",), ("2026-07-01T00:00:00Z",), ("2026-07-01T00:00:00",), ("soon",)]
    got = values(spark, rows, "t string", F.unix_seconds(parsing.zoned_instant(F.col("t"))))
    assert got[1] - got[0] == 12 * 3600 and got[2:] == [None, None]


def test_severity_and_direction_thresholds_are_inclusive(spark):
    rows = [(3.5,), (-3.5,), (2.5,), (-2.5,), (2.4999,), (0.0,), (None,)]
    severity = values(spark, rows, "s double", scoring.severity(F.col("s")))
    assert severity == ["high", "high", "moderate", "moderate", "normal", "normal", "unavailable"]
    direction = values(spark, rows, "s double", scoring.direction(F.col("s")))
    assert direction == ["high", "low", "high", "low", "normal", "normal", "unavailable"]


def test_error_metrics_with_zero_pair(spark):
    df = spark.createDataFrame([(0.0, 0.0), (10.0, 8.0), (4.0, 8.0)], "actual double, predicted double")
    row = df.agg(*scoring.error_metrics()).first()
    assert abs(row.mae - 2.0) < 1e-12
    assert abs(row.rmse - (20 / 3) ** 0.5) < 1e-12
    assert abs(row.smape - (0 + 2 * 2 / 18 + 2 * 4 / 12) / 3 * 100) < 1e-12


def test_percent_of_zero_whole_is_null(spark):
    rows = [(1.0, 0.0), (1.0, 4.0), (1.0, None)]
    assert values(spark, rows, "a double, b double", scoring.percent_of(F.col("a"), F.col("b"))) == [None, 25.0, None]


def test_absent_flag_counts_as_false(spark):
    df = spark.createDataFrame([(True,), (None,)], "present boolean")
    got = df.select(scoring.flag_or_false(df, "present"), scoring.flag_or_false(df, "absent")).collect()
    assert [tuple(r) for r in got] == [(True, False), (False, False)]


def test_sorted_quantile_matches_linear_interpolation(spark):
    import numpy as np

    data = [3.0, 7.5, 8.0, 12.0, 40.0, 41.5]
    df = spark.createDataFrame([(data,)], "v array<double>")
    got = df.select(*[scoring.sorted_quantile("v", q) for q in (0.25, 0.5, 0.75)]).first()
    assert np.allclose(list(got), np.quantile(data, [0.25, 0.5, 0.75]))


def test_whole_numbers_are_exact(spark):
    df = spark.createDataFrame([("9007199254740993",), ("12.0",), ("12.5",), ("x",), (None,)], "t string")
    assert [r[0] for r in df.select(parsing.whole_number(F.col("t"))).collect()] == [9007199254740993, 12, None, None, None]
