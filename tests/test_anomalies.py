from __future__ import annotations

import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from helpers import month, raises_in_job, series_rows
from pyspark.sql import functions as F

from monthgrain.contracts import MODEL_NAIVE, MODEL_SMOOTHING, ContractError
from monthgrain.operators import consolidation, evaluation
from monthgrain.operators.checks import assert_checks
from monthgrain.operators.historical_anomalies import detect_historical, practical_historical
from monthgrain.operators.residual_anomalies import detect_residual, practical_residual, winner_predictions


def wavy(n, seed=7):
    rng = random.Random(seed)
    return [500.0 + i * 0.5 + (i % 12) * 3 + rng.randint(-6, 6) for i in range(n)]


def ordered(df, period="period_date"):
    return df.orderBy("series_id", period).collect()


# ---- historical detector ----------------------------------------------------------------------


def test_detector_matches_pandas_rolling_statistics(make_panel):
    data = {1: wavy(90, 1), 2: [v if i not in (20, 41) else None for i, v in enumerate(wavy(90, 2))]}
    rows = detect_historical(make_panel(*[series_rows(v, location=k) for k, v in data.items()])).toPandas()
    for k, values in data.items():
        got = rows[rows.location_id == k].sort_values("period_date").reset_index(drop=True)
        change = pd.Series(values, dtype=float).diff(12)
        prior = change.shift(1).rolling(36, min_periods=24)
        expected = prior.median()
        mad = prior.apply(lambda w: np.nanmedian(np.abs(w - np.nanmedian(w))), raw=True)
        iqr = prior.quantile(0.75) - prior.quantile(0.25)
        for column, want in (("historical_change_expected", expected), ("historical_mad", mad), ("historical_iqr", iqr)):
            assert np.allclose(got[column].astype(float), want, equal_nan=True), (k, column)
        assert got.historical_score_available.sum() > 20


def test_spike_in_the_last_month_is_high(make_panel):
    values = wavy(80)
    values[-1] += 500
    last = ordered(detect_historical(make_panel(series_rows(values))))[-1]
    assert last.historical_severity == "high" and last.historical_direction == "high" and last.historical_is_anomaly
    values[-1] -= 1000
    assert ordered(detect_historical(make_panel(series_rows(values))))[-1].historical_direction == "low"


def test_current_value_is_not_in_its_own_baseline(make_panel):
    values = wavy(80)
    base = ordered(detect_historical(make_panel(series_rows(values))))
    other = ordered(detect_historical(make_panel(series_rows(values[:-1] + [values[-1] + 1000]))))
    assert base[-1].historical_change_expected == other[-1].historical_change_expected
    assert base[-1].historical_scale == other[-1].historical_scale
    assert [r.historical_score for r in base[:-1]] == [r.historical_score for r in other[:-1]]


def test_score_starts_after_lag_and_minimum_baseline(make_panel):
    rows = ordered(detect_historical(make_panel(series_rows(wavy(60)))))
    first = next(i for i, r in enumerate(rows) if r.historical_score_available)
    assert first == 12 + 24
    assert rows[11].seasonal_reference is None and rows[12].seasonal_reference == rows[0].value
    assert rows[0].historical_severity == "unavailable"


def test_zero_mad_falls_back_to_iqr_and_zero_scale_is_unavailable(make_panel):
    # constant yearly step: every seasonal change is equal
    flat = ordered(detect_historical(make_panel(series_rows([float(i) for i in range(60)]))))[-1]
    assert flat.historical_mad == 0.0 and flat.historical_iqr == 0.0
    assert flat.historical_scale_method == "unavailable" and not flat.historical_score_available
    # seasonal changes equal in most months, larger in over a quarter of them
    values = [100.0] * 12
    for i in range(12, 90):
        values.append(values[i - 12] + (10.0 if i % 3 == 0 and i % 2 == 0 else 20.0 if i % 5 == 0 else 5.0))
    rows = ordered(detect_historical(make_panel(series_rows(values))))
    methods = {r.historical_scale_method for r in rows if r.historical_score_available}
    assert "iqr" in methods
    row = next(r for r in rows if r.historical_scale_method == "iqr")
    assert row.historical_mad == 0.0 and abs(row.historical_scale - row.historical_iqr / 1.349) < 1e-12


def test_lag_counts_rows_not_months(make_panel):
    rows = ordered(detect_historical(make_panel(series_rows([float(i) for i in range(30)], skip={5}))))
    assert rows[12].seasonal_reference == 0.0 and rows[12].value == 13.0


def test_repeated_month_fails_the_job(make_panel):
    rows = series_rows(wavy(30))
    raises_in_job(detect_historical(make_panel(rows, rows[3:4])), "two rows for one series and month")


def test_bad_settings_and_columns(make_panel):
    df = make_panel(series_rows(wavy(30)))
    for bad in ({"seasonal_lag": 0}, {"baseline_window": 1}, {"min_periods": 1}, {"min_periods": 40}):
        with pytest.raises(ValueError):
            detect_historical(df, **bad)
    with pytest.raises(ContractError):
        detect_historical(df.drop("value"))


PRACTICAL = (
    "metric string, historical_deviation double, historical_deviation_pct double, historical_is_anomaly boolean, "
    "historical_score_available boolean"
)


@pytest.mark.parametrize(
    "row, significant, status",
    [
        (("median_rent", 15.0, 3.0, True, True), True, "dashboard_alert"),
        (("median_rent", -15.0, -3.0, True, True), True, "dashboard_alert"),
        (("median_rent", 15.0, 2.99, True, True), False, "statistical_only"),
        (("median_rent", 14.9, 9.0, True, True), False, "statistical_only"),
        (("bonds_lodged", 25.0, 20.0, True, True), True, "dashboard_alert"),
        (("bonds_lodged", 60.0, 19.0, True, True), False, "statistical_only"),
        (("median_rent", 50.0, 9.0, False, True), True, "normal"),
        (("median_rent", 50.0, 9.0, True, False), True, "unavailable"),
        (("median_rent", 50.0, None, True, True), False, "unavailable"),
        (("other", 50.0, 50.0, True, True), False, "unavailable"),
        (("median_rent", 50.0, 9.0, None, None), True, "unavailable"),
    ],
)
def test_practical_thresholds(spark, row, significant, status):
    got = practical_historical(spark.createDataFrame([row], PRACTICAL)).first()
    assert (got.practical_significance, got.alert_status) == (significant, status)
    assert got.dashboard_alert == (status == "dashboard_alert")


# ---- residual detector -----------------------------------------------------------------------------


def residual_rows(residuals, metric="median_rent", winner=MODEL_NAIVE):
    sid = f"region_1_{metric}"
    rows = []
    for i, r in enumerate(residuals):
        origin = month("2020-01-01", i)
        for model, extra, step in ((winner, 0.0, 1), (winner, 300.0, 2), ("loser", 900.0, 1)):
            actual = None if r is None else 500.0 + r + extra
            rows.append((model, sid, metric, "region", 1, "Place", origin, month("2020-01-01", i + step), step, actual, 500.0))
    return rows


@pytest.fixture
def winners(spark):
    rows = [(f"region_1_{m}", m, MODEL_NAIVE) for m in ("median_rent", "bonds_lodged")]
    return spark.createDataFrame(rows, "series_id string, metric string, best_model string")


def test_only_winner_horizon_one_rows_are_scored(make_predictions, winners):
    residuals = [1.0, -2.0, 3.0, -1.0, 2.0, -3.0, 1.0, 40.0]
    rows = ordered(detect_residual(make_predictions(residual_rows(residuals)), winners), "forecast_period")
    assert [r.forecast_residual for r in rows] == residuals
    assert [r.forecast_score_available for r in rows] == [False] * 6 + [True] * 2
    last = rows[-1]
    prior = pd.Series(residuals[:-1])
    assert last.residual_median == prior.median()
    assert last.residual_mad == (prior - prior.median()).abs().median()
    assert abs(last.residual_iqr - (prior.quantile(0.75) - prior.quantile(0.25))) < 1e-12
    assert last.forecast_severity == "high" and last.forecast_error_direction == "above_forecast"


def test_current_residual_is_not_in_its_own_baseline(make_predictions, winners):
    head = [1.0, -2.0, 3.0, -1.0, 2.0, -3.0, 1.0]
    a, b = (ordered(detect_residual(make_predictions(residual_rows(head + [x])), winners), "forecast_period")[-1] for x in (5.0, 500.0))
    assert a.residual_median == b.residual_median and a.forecast_residual_scale == b.forecast_residual_scale


def test_zero_residual_scale_is_unavailable(make_predictions, winners):
    last = ordered(detect_residual(make_predictions(residual_rows([2.0] * 7 + [50.0])), winners), "forecast_period")[-1]
    assert last.forecast_scale_method == "unavailable" and last.forecast_severity == "unavailable"


def test_winner_mapping_must_be_unique(make_predictions, winners):
    rows = make_predictions(residual_rows([1.0]))
    raises_in_job(winner_predictions(rows, winners.unionByName(winners), 1), "more than once")
    with pytest.raises(ValueError):
        detect_residual(rows, winners, min_prior=2)


RESIDUAL = (
    "metric string, forecast_residual double, forecast_residual_pct double, forecast_is_anomaly boolean, "
    "forecast_score_available boolean"
)


@pytest.mark.parametrize(
    "row, significant",
    [
        (("median_rent", 15.0, 2.0, True, True), True),
        (("median_rent", 15.0, 1.9, True, True), False),
        (("median_rent", 14.0, 5.0, True, True), False),
        (("bonds_lodged", -50.0, 1.0, True, True), True),
        (("bonds_lodged", 3.0, -10.0, True, True), True),
        (("bonds_lodged", 49.0, 9.9, True, True), False),
        (("bonds_lodged", 90.0, None, True, True), False),
        (("other", 90.0, 90.0, True, True), False),
    ],
)
def test_residual_materiality(spark, row, significant):
    got = practical_residual(spark.createDataFrame([row], RESIDUAL)).first()
    assert got.forecast_practical_significance is significant
    assert got.forecast_alert_status == (
        "dashboard_alert" if significant else "unavailable" if row[2] is None else "statistical_only"
    )


# ---- consolidation -----------------------------------------------------------------------------------

HISTORICAL = (
    "period_date date, series_id string, metric string, geography_level string, location_id int, location_name string, "
    "value double, historical_score_available boolean, historical_severity string, historical_direction string, "
    "historical_is_anomaly boolean, dashboard_alert boolean, alert_status string"
)
FORECAST = (
    "forecast_period date, series_id string, metric string, model string, predicted double, forecast_residual double, "
    "forecast_residual_pct double, forecast_error_direction string, forecast_anomaly_score double, "
    "forecast_score_available boolean, forecast_severity string, forecast_direction string, forecast_is_anomaly boolean, "
    "forecast_dashboard_alert boolean, forecast_alert_status string"
)


def consolidated(spark, historical, forecast, metric="median_rent"):
    """``historical`` = (scored, severity, direction, alert); ``forecast`` = (scored, severity, error direction, alert)."""
    day = dt.date(2026, 1, 1)
    scored, severity, direction, alert = historical
    h = [(day, "s", "median_rent", "region", 1, "A", 1.0, scored, severity, direction, alert, alert, "x")]
    f = []
    if forecast is not None:
        scored, severity, said, alert = forecast
        f = [(day, "s", metric, MODEL_SMOOTHING, 1.0, 1.0, 1.0, said, 3.0, scored, severity, "high", alert, alert, "x")]
    return consolidation.consolidate(spark.createDataFrame(h, HISTORICAL), spark.createDataFrame(f, FORECAST))


CASES = [
    ((True, "high", "high", True), (True, "moderate", "above_forecast", True), "both", "confirmed_anomaly", "high", "high"),
    ((True, "moderate", "low", True), (True, "high", "above_forecast", True), "both", "confirmed_anomaly", "high", "mixed"),
    ((True, "moderate", "low", True), (True, "high", "above_forecast", False), "both", "historical_alert", "moderate", "low"),
    ((True, "high", "high", False), (True, "moderate", "below_forecast", True), "both", "forecast_alert", "moderate", "low"),
    ((True, "high", "high", False), (True, "high", "above_forecast", False), "both", "normal", "normal", "normal"),
    ((True, "normal", "normal", False), None, "historical_only", "normal", "normal", "normal"),
    ((False, "unavailable", "unavailable", False), (True, "high", "above_forecast", True), "forecast_only", "forecast_alert", "high", "high"),
    ((False, "unavailable", "unavailable", False), (False, "unavailable", "on_forecast", False), "unavailable", "unavailable", "unavailable", "normal"),
]


@pytest.mark.parametrize("historical, forecast, coverage, status, severity, direction", CASES)
def test_consolidated_verdict(spark, historical, forecast, coverage, status, severity, direction):
    row = consolidated(spark, historical, forecast).first()
    assert (row.detector_coverage, row.overall_status, row.overall_severity, row.overall_direction) == (
        coverage,
        status,
        severity,
        direction,
    )
    assert row.has_forecast_record is (forecast is not None)
    assert row.overall_dashboard_alert == (status in ("confirmed_anomaly", "historical_alert", "forecast_alert"))


def test_metric_mismatch_fails(spark):
    df = consolidated(spark, CASES[0][0], CASES[0][1], metric="bonds_lodged")
    raises_in_job(df, "metric differ")


@pytest.fixture
def summary(spark):
    frames = [
        consolidated(spark, h, f).withColumn("series_id", F.lit(f"s{i}")) for i, (h, f, *_) in enumerate(CASES)
    ]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return spark.createDataFrame(out.collect(), out.schema)


def test_sixteen_checks_pass(summary):
    rows = consolidation.summary_checks(summary).collect()
    assert len(rows) == 16 and all(r.passed for r in rows)


@pytest.mark.parametrize(
    "column, value, check",
    [
        ("overall_status", "odd", "valid_overall_status"),
        ("overall_severity", "odd", "valid_overall_severity"),
        ("overall_direction", "up", "valid_overall_direction"),
        ("detector_coverage", "historical_only", "detector_coverage_logic"),
        ("overall_dashboard_alert", False, "overall_alert_union"),
        ("overall_severity", "normal", "alert_severity_consistency"),
        ("has_forecast_record", False, "forecast_availability_requires_record"),
        ("series_id", "same", "unique_series_period"),
        ("overall_status", None, "valid_overall_status"),
    ],
)
def test_corruption_is_found(summary, column, value, check):
    broken = consolidation.summary_checks(summary.withColumn(column, F.lit(value).cast(summary.schema[column].dataType)))
    assert check in {r.check_name for r in broken.where("not passed").collect()}
    with pytest.raises(ContractError, match=check):
        assert_checks(broken, "summary")


def test_metadata_and_reports(summary):
    rows = {(r.category, r.item): r.value for r in consolidation.anomaly_metadata(summary).collect()}
    assert len(rows) == 30
    assert rows["dataset", "rows"] == "8" and rows["dataset", "periods"] == "1" and rows["dataset", "start_period"] == "2026-01-01"
    assert rows["outputs", "confirmed_anomalies"] == "2" and rows["outputs", "overall_unavailable"] == "1"
    status = {r.status: r.observations for r in consolidation.status_distribution(summary).collect()}
    assert status == {"confirmed_anomaly": 2, "historical_alert": 1, "forecast_alert": 2, "normal": 2, "unavailable": 1}
    stats = {r.series_id: r for r in consolidation.alert_statistics(summary).collect()}
    assert stats["s0"].both_detector_alerts == 1 and stats["s4"].alerts == 0 and stats["s4"].latest_alert is None


def test_most_extreme_breaks_ties_by_key(spark):
    df = spark.createDataFrame([("b", 5.0), ("a", -5.0), ("c", 9.0), ("d", None)], "series_id string, score double")
    got = consolidation.most_extreme(df.withColumn("period_date", F.lit("x")), "score", "period_date", 2).collect()
    assert [r.series_id for r in got] == ["c", "a"]


# ---- evaluation -----------------------------------------------------------------------------------------


def test_transition_windows_have_equal_length(spark):
    rows = [(month("2023-01-01", i), i % 2 == 0, i % 4 == 0, i % 8 == 0) for i in range(30)]
    schema = "period_date date, historical_score_available boolean, historical_is_anomaly boolean, dashboard_alert boolean"
    got = {r.period: r for r in evaluation.transition_rates(spark.createDataFrame(rows, schema)).collect()}
    after, before = got["bond_hub_transition"], got["pre_transition_comparison"]
    assert after.months == before.months == 6 and after.rows == before.rows == 6
    assert (before.start_date, before.end_date) == (dt.date(2024, 7, 1), dt.date(2024, 12, 1))
    assert after.statistical_anomaly_rate == after.statistical_anomalies / after.scored_observations


def test_shocks_are_recovered_in_both_directions(make_panel):
    df = make_panel(series_rows(wavy(96, 3)), series_rows(wavy(96, 4), location=2))
    rows = evaluation.shock_recovery(df).collect()
    assert len(rows) == 4 and all(r.passed for r in rows)
    assert {(r.scenario, r.observed_direction) for r in rows} == {("positive_shock", "high"), ("negative_shock", "low")}


def test_sweep_and_evaluation_checks(make_panel):
    df = make_panel(series_rows(wavy(96, 3)))
    sweep = evaluation.threshold_sweep(df)
    rows = sorted(sweep.collect(), key=lambda r: r.threshold)
    assert [r.threshold for r in rows] == [2.0, 2.5, 3.0, 3.5, 4.0]
    assert all(r.injection_recovery_rate == 1.0 for r in rows)
    assert [r.background_alerts for r in rows] == sorted((r.background_alerts for r in rows), reverse=True)
    from monthgrain.plans.products import evaluation_table

    scored = practical_historical(detect_historical(df))
    table = evaluation_table(df, scored, dt.date(2021, 1, 1), dt.date(2022, 12, 31))
    assert {r.passed for r in evaluation.evaluation_checks(table, 2).collect()} == {True}
    failed = evaluation.evaluation_checks(table.where("evaluation_group <> 'transition_period'"), 2).where("not passed")
    assert {r.check_name for r in failed.collect()} == {"known_groups", "transition_rows"}
