from __future__ import annotations

import datetime as dt

import pytest
from helpers import month, series_rows

from monthgrain.contracts import ContractError, duplicated_series_ids
from monthgrain.operators import checks, joins, panel, quality, splits, summaries

WIDE = (
    "period_date date, geography_level string, location_id int, location_name string, median_rent decimal(18,4), "
    "bonds_lodged int, is_provisional boolean, source_snapshot_id bigint"
)


@pytest.fixture
def wide(spark):
    from decimal import Decimal as D

    day = dt.date(2026, 1, 1)
    rows = [
        (day, "region", 2, "North", D("500"), 10, True, 1),
        (month("2026-01-01", 1), "region", 2, "North", D("510"), 12, True, 1),
        (day, "territorial_authority", 60, "Town", None, 3, True, 1),
        (day, "region", -99, "ALL", D("480"), 99, True, 1),
        (day, "region", -1, "NA", D("470"), 9, True, 1),
        (day, "suburb", 7, "Hill", D("470"), 9, True, 1),
    ]
    return spark.createDataFrame(rows, WIDE)


def test_panel_keeps_core_geographies_and_melts(wide):
    rows = panel.monthly_panel(wide).collect()
    assert len(rows) == 6
    assert {r.series_id for r in rows} == {
        "region_2_median_rent",
        "region_2_bonds_lodged",
        "territorial_authority_60_median_rent",
        "territorial_authority_60_bonds_lodged",
    }
    by_key = {(r.series_id, r.period_date): r.value for r in rows}
    assert by_key["region_2_median_rent", dt.date(2026, 1, 1)] == 500.0
    assert by_key["territorial_authority_60_median_rent", dt.date(2026, 1, 1)] is None
    assert all(r.source_snapshot_provisional for r in rows)


def test_panel_requires_columns(wide):
    with pytest.raises(ContractError, match="bonds_lodged"):
        panel.monthly_panel(wide.drop("bonds_lodged"))


def test_panel_checks_find_each_problem(make_panel):
    good = series_rows([1.0, 2.0])
    assert {r.passed for r in panel.panel_checks(make_panel(good)).collect()} == {True}
    twice = make_panel(good, good[:1])
    failed = {r.check_name: r.observed for r in panel.panel_checks(twice).collect() if not r.passed}
    assert failed == {"unique_series_period": 2}
    odd = [(dt.date(2020, 1, 15), "s", "region", 1, "A", "other", 1.0, False, 1)]
    failed = {r.check_name for r in panel.panel_checks(make_panel(good, odd)).collect() if not r.passed}
    assert failed == {"known_metrics", "month_starts"}
    with pytest.raises(ContractError, match="unique_series_period"):
        checks.assert_checks(panel.panel_checks(twice), "panel")


def catalog_row(df):
    return quality.series_catalog(df).first()


@pytest.mark.parametrize("n, eligible", [(60, False), (76, False), (77, True)])
def test_eligibility_needs_77_unbroken_months(make_panel, n, eligible):
    row = catalog_row(make_panel(series_rows([500.0] * n)))
    assert (row.n_observations, row.continuous_months, row.missing_months) == (n, n, 0)
    assert row.completeness_rate == 1.0 and row.eligible_for_forecasting is eligible


def test_gap_starts_a_new_run(make_panel):
    row = catalog_row(make_panel(series_rows([500.0] * 60, skip={30})))
    assert (row.n_observations, row.expected_observations, row.missing_months) == (59, 60, 1)
    assert row.continuous_start == month("2015-01-01", 31) and row.continuous_months == 29


def test_null_inside_the_run_blocks_eligibility(make_panel):
    values = [500.0] * 90
    values[50] = None
    row = catalog_row(make_panel(series_rows(values)))
    assert row.null_values == 1 and row.continuous_months == 90 and not row.eligible_for_forecasting
    # a null before the trailing run does not matter
    values = [500.0] * 100
    values[5] = None
    assert catalog_row(make_panel(series_rows(values, skip={10}))).eligible_for_forecasting


def test_repeated_month_does_not_shorten_the_run(make_panel):
    rows = series_rows([500.0] * 77)
    row = catalog_row(make_panel(rows, rows[-1:]))
    assert row.n_observations == 78 and row.continuous_months == 77 and row.missing_months == 0


def test_quality_summary_counts(make_panel):
    rows = series_rows([1.0, -2.0, 0.0, None])
    row = quality.quality_summary(make_panel(rows, rows[:1])).first()
    assert (row.duplicate_periods, row.null_values, row.negative_values, row.zero_values) == (1, 1, 1, 1)
    assert row.status == "FAIL" and row.source_snapshot_provisional is False
    assert quality.quality_summary(make_panel(series_rows([1.0, 0.0]))).first().status == "PASS"


def test_readiness(make_panel):
    ready = make_panel(series_rows([5.0] * 120), series_rows([5.0] * 120, location=2))
    row = quality.modelling_readiness(ready, quality.series_catalog(ready), quality.quality_summary(ready)).first()
    assert row.dataset_ready and row.forecast_eligible_series == 2 and row.minimum_eligible_continuous_months == 120
    short = make_panel(series_rows([5.0] * 20))
    row = quality.modelling_readiness(short, quality.series_catalog(short), quality.quality_summary(short)).first()
    assert not row.dataset_ready and row.minimum_eligible_continuous_months == 0 and row.complete_series == 1


def test_eligible_but_failing_quality_is_not_ready(make_panel):
    df = make_panel(series_rows([-5.0] * 120))
    row = quality.modelling_readiness(df, quality.series_catalog(df), quality.quality_summary(df)).first()
    assert row.rolling_origin_ready and not row.dataset_ready and row.eligible_quality_pass_series == 0


def test_selection_two_ways(make_panel):
    dup = duplicated_series_ids()[0]
    _, _, ident, metric = dup.split("_", 3)
    df = make_panel(
        series_rows([float(i) for i in range(100)], skip={10}),
        series_rows([1.0] * 70, location=2),
        series_rows([1.0] * 90, location=int(ident), level="territorial_authority", metric=metric),
        series_rows([1.0] * 40 + [None] + [1.0] * 60, location=4),
        series_rows([1.0] * 80, location=5, metric="bonds_lodged"),
    )
    by_join = splits.select_series(df, quality.series_catalog(df)).collect()
    by_window = splits.select_trailing_runs(df).collect()
    assert sorted(map(str, by_join)) == sorted(map(str, by_window))
    assert {r.series_id for r in by_window} == {"region_1_median_rent", "region_5_bonds_lodged"}
    assert min(r.period_date for r in by_window if r.location_id == 1) == month("2015-01-01", 11)


def test_historical_summary_counts_rows_back(make_panel):
    row = summaries.historical_summary(make_panel(series_rows([100.0 + i for i in range(24)]))).first()
    assert (row.mean, row.median, row.minimum, row.maximum, row.latest_value) == (111.5, 111.5, 100.0, 123.0, 123.0)
    assert (row.change_1m, row.change_12m) == (1.0, 12.0)
    assert abs(row.pct_change_12m - 12 / 111 * 100) < 1e-9
    assert row.mean_monthly_change == 1.0 and row.std_monthly_change == 0.0


def test_historical_summary_of_short_and_zero_series(make_panel):
    row = summaries.historical_summary(make_panel(series_rows([5.0]))).first()
    assert row.std is None and row.change_1m is None and row.change_12m is None
    row = summaries.historical_summary(make_panel(series_rows([0.0] + [1.0] * 12))).first()
    assert row.change_12m == 1.0 and row.pct_change_12m is None


def test_seasonality_and_recent_history(make_panel):
    df = make_panel(series_rows([float(i % 12 + 1) for i in range(36)]))
    by_month = {r.month: r for r in summaries.monthly_seasonality(df).collect()}
    assert by_month[7].mean_value == 7.0 and by_month[7].n_observations == 3 and by_month[7].std_value == 0.0
    row = summaries.recent_history(df, 12).first()
    assert row.recent_observations == 12 and row.recent_start_period == month("2015-01-01", 24)
    with pytest.raises(ValueError):
        summaries.recent_history(df, 0)
    profile = summaries.seasonal_profile(summaries.monthly_seasonality(df)).first()
    assert (profile.peak_month, profile.low_month) == (12, 1)


def test_year_ago_is_calendar_but_lag_is_rows(make_panel):
    df = make_panel(series_rows([float(i) for i in range(30)], skip={5}))
    frame = {r.period_date: r.value_year_ago for r in summaries.movements(df).collect()}
    joined = {r.period_date: r.value_year_ago for r in summaries.year_ago_by_join(df).collect()}
    assert frame == joined
    assert frame[month("2015-01-01", 17)] is None and frame[month("2015-01-01", 18)] == 6.0


def test_annual_growth_needs_two_full_years(make_panel):
    rows = summaries.annual_averages(make_panel(series_rows([10.0] * 12 + [20.0] * 12 + [30.0] * 6))).collect()
    by_year = {r.year: r for r in rows}
    assert by_year[2016].yoy_pct == 100.0 and by_year[2017].yoy_pct is None
    assert by_year[2017].coverage == "Partial year"


def test_annualised_growth_uses_smooth_ends_or_falls_back(make_panel):
    smooth = summaries.annualised_growth(make_panel(series_rows([100.0] * 12 + [121.0] * 24))).first()
    assert smooth.growth_basis == "12-month averages" and smooth.annualised_growth > 0
    raw = summaries.annualised_growth(make_panel(series_rows([100.0] * 12))).first()
    assert raw.growth_basis == "monthly values" and raw.annualised_growth is None
    assert summaries.annualised_growth(make_panel(series_rows([-1.0] * 40))).first().annualised_growth is None


def test_kpis_take_the_first_date_of_an_extreme(make_panel):
    row = summaries.period_kpis(make_panel(series_rows([3.0, 9.0, 1.0, 9.0, 1.0, 4.0]))).first()
    assert (row.maximum_value, row.maximum_date) == (9.0, month("2015-01-01", 1))
    assert (row.minimum_value, row.minimum_date) == (1.0, month("2015-01-01", 2))
    assert row.mom_change == 300.0 and row.yoy_change is None


def test_window_filters(make_panel):
    df = make_panel(series_rows([float(i) for i in range(40)]))
    assert summaries.in_range(df, "2015-02-01", "2015-04-01").count() == 3
    assert summaries.latest_years(df, 1).count() == 13
    assert summaries.one_series(df, "region", "Place 1", "median_rent").count() == 40


def test_checked_join_rejects_a_repeated_key(make_panel, spark):
    df = make_panel(series_rows([1.0, 2.0]))
    one = spark.createDataFrame([("region_1_median_rent", 1), ("region_1_median_rent", 2)], "series_id string, x int")
    with pytest.raises(Exception, match="more than once"):
        joins.checked_join(df, one, ["series_id"]).collect()
    assert joins.checked_join(df, one.limit(1), ["series_id"]).count() == 2
