"""Detectors, consolidation, reports and evaluation (families N, W10, A17-A19, T02, T03, T06, D04, Q11, Q12)."""

from __future__ import annotations

from datetime import date

from monthgrain import contracts as C
from monthgrain.operators import consolidation, evaluation, historical_anomalies, residual_anomalies, smoothing
from monthgrain.operators.joins import without_duplicated_series
from monthgrain.plans.catalogue import query
from monthgrain.plans.driver_tables import TRANSITION, DriverTables
from monthgrain.plans.oracle import historical_sql, sql_list
from monthgrain.plans.products import evaluation_table
from monthgrain.plans.queries_history import _checks_sql
from monthgrain.session import durable

DETECTED = """series_id, period_date, metric, value, seasonal_reference, seasonal_change, historical_change_expected, historical_mad,
historical_iqr, historical_expected, historical_deviation, historical_deviation_pct, historical_scale_method, historical_scale,
historical_score, historical_score_available, historical_severity, historical_direction, historical_is_anomaly"""
DETECTED_DOUBLES = [
    "seasonal_change",
    "historical_change_expected",
    "historical_mad",
    "historical_iqr",
    "historical_expected",
    "historical_deviation",
    "historical_deviation_pct",
    "historical_scale",
    "historical_score",
]


def names(text: str) -> list[str]:
    return [n.strip() for n in text.replace("\n", " ").split(",")]


@query("n01_historical_anomalies", f"SELECT {DETECTED} FROM q_detected", rounded=DETECTED_DOUBLES)
def n01(d: DriverTables):
    return historical_anomalies.detect_historical(d.panel).select(*names(DETECTED))


PRACTICAL = """series_id, period_date, practical_abs_threshold, practical_pct_threshold, practical_significance_available,
practical_significance, statistical_anomaly, dashboard_alert, alert_status"""


@query("n02_historical_practical", f"SELECT {PRACTICAL} FROM q_historical")
def n02(d: DriverTables):
    return d.historical.select(*names(PRACTICAL))


WINNER_ROWS = "model, series_id, metric, origin, forecast_period, horizon_step, actual, predicted, best_model"


@query(
    "n03_winner_horizon_predictions",
    f"SELECT {WINNER_ROWS} FROM q_winner_rows WHERE horizon_step = 1",
    rounded=["predicted"],
)
def n03(d: DriverTables):
    return residual_anomalies.winner_predictions(d.predictions, d.winners, C.RESIDUAL_HORIZON).select(*names(WINNER_ROWS))


RESIDUAL = """series_id, forecast_period, metric, model, origin, horizon_step, actual, predicted, forecast_residual,
forecast_residual_pct, forecast_error_direction, residual_median, residual_mad, residual_iqr, forecast_residual_scale,
forecast_scale_method, forecast_anomaly_score, forecast_score_available, forecast_severity, forecast_direction, forecast_is_anomaly"""
RESIDUAL_DOUBLES = [
    "predicted",
    "forecast_residual",
    "forecast_residual_pct",
    "residual_median",
    "residual_mad",
    "residual_iqr",
    "forecast_residual_scale",
    "forecast_anomaly_score",
]


@query("n04_residual_anomalies", f"SELECT {RESIDUAL} FROM q_residual", rounded=RESIDUAL_DOUBLES)
def n04(d: DriverTables):
    return residual_anomalies.detect_residual(d.predictions, d.winners).select(*names(RESIDUAL))


RESIDUAL_PRACTICAL = """series_id, forecast_period, forecast_practical_significance_available, forecast_practical_significance,
forecast_statistical_anomaly, forecast_dashboard_alert, forecast_alert_status"""


@query("n05_residual_practical", f"SELECT {RESIDUAL_PRACTICAL} FROM q_residual")
def n05(d: DriverTables):
    return d.residual.select(*names(RESIDUAL_PRACTICAL))


for _name, _column in (
    ("w10_expanding_median", "residual_median"),
    ("w10_expanding_mad", "residual_mad"),
    ("w10_expanding_iqr", "residual_iqr"),
):

    @query(_name, f"SELECT series_id, forecast_period, {_column} FROM q_residual", rounded=[_column])
    def _expanding(d: DriverTables, column: str = _column):
        rows = residual_anomalies.detect_residual(d.predictions, d.winners)
        return rows.select("series_id", "forecast_period", column)


SUMMARY = """series_id, period_date, metric, value, has_forecast_record, historical_detector_available,
forecast_detector_available, historical_dashboard_alert, forecast_dashboard_alert, detector_coverage, overall_status,
overall_dashboard_alert, overall_severity, overall_direction"""


@query("n06_consolidate", f"SELECT {SUMMARY} FROM q_summary")
def n06(d: DriverTables):
    return d.summary.select(*names(SUMMARY))


@query(
    "j05_consolidate_join",
    "SELECT series_id, period_date, forecast_model, predicted, forecast_residual, forecast_anomaly_score FROM q_summary",
    rounded=["predicted", "forecast_residual", "forecast_anomaly_score"],
)
def j05(d: DriverTables):
    return d.summary.select(
        "series_id", "period_date", "forecast_model", "predicted", "forecast_residual", "forecast_anomaly_score"
    )


# ---- reports ------------------------------------------------------------------------------------


@query(
    "t02_extreme_anomalies",
    """
    SELECT series_id, period_date, historical_score, historical_direction, historical_severity FROM q_historical
    WHERE historical_score IS NOT NULL AND historical_is_anomaly
    ORDER BY abs(historical_score) DESC, series_id, period_date LIMIT 20
    """,
    rounded=["historical_score"],
)
def t02(d: DriverTables):
    found = d.historical.where("historical_is_anomaly")
    return consolidation.most_extreme(found, "historical_score", "period_date").select(
        "series_id", "period_date", "historical_score", "historical_direction", "historical_severity"
    )


@query(
    "t03_alert_feed",
    """
    SELECT period_date, series_id, location_name, overall_status, overall_severity, overall_direction FROM q_summary
    WHERE overall_dashboard_alert ORDER BY period_date DESC, series_id
    """,
)
def t03(d: DriverTables):
    return consolidation.alert_feed(d.summary).select(
        "period_date", "series_id", "location_name", "overall_status", "overall_severity", "overall_direction"
    )


@query(
    "a17_platform_headline",
    f"""
    SELECT (SELECT count(DISTINCT series_id) FROM q_panel) AS historical_series, (SELECT count(*) FROM q_panel) AS historical_observations,
           (SELECT bool_or(source_snapshot_provisional) FROM q_panel) AS source_snapshot_provisional,
           (SELECT count(*) FROM q_catalog WHERE eligible_for_forecasting) AS forecast_eligible_series,
           count(*) FILTER (overall_dashboard_alert) AS overall_alerts,
           count(*) FILTER (overall_status = 'confirmed_anomaly') AS both_detectors_flagged,
           (SELECT count(DISTINCT series_id) FROM q_forward) AS production_series
    FROM q_summary WHERE series_id NOT IN ({sql_list(C.duplicated_series_ids())})
    """,
)
def a17(d: DriverTables):
    forecasts = smoothing.smoothing_forward(d.modelled)
    return consolidation.platform_headline(d.stored_panel, d.catalog, d.summary, forecasts)


@query(
    "a18_status_distribution",
    "SELECT coalesce(overall_status, 'unavailable') AS status, count(*) AS observations FROM q_summary GROUP BY 1",
)
def a18(d: DriverTables):
    return consolidation.status_distribution(d.summary)


SETTINGS = [
    ("historical_detector", "seasonal_lag", "12"),
    ("historical_detector", "baseline_window", "36"),
    ("historical_detector", "minimum_baseline_observations", "24"),
    ("historical_detector", "moderate_threshold", "2.5"),
    ("historical_detector", "high_threshold", "3.5"),
    ("historical_practical", "median_rent_absolute_threshold", "15.0"),
    ("historical_practical", "median_rent_percentage_threshold", "3.0"),
    ("historical_practical", "bonds_absolute_threshold", "25.0"),
    ("historical_practical", "bonds_percentage_threshold", "20.0"),
    ("forecast_detector", "horizon", "1"),
    ("forecast_detector", "minimum_prior_residuals", "6"),
    ("forecast_detector", "moderate_threshold", "2.5"),
    ("forecast_detector", "high_threshold", "3.5"),
    ("forecast_practical", "median_rent_absolute_threshold", "15.0"),
    ("forecast_practical", "median_rent_percentage_threshold", "2.0"),
    ("forecast_practical", "bonds_absolute_threshold", "50.0"),
    ("forecast_practical", "bonds_percentage_threshold", "10.0"),
]
COUNTED = {
    ("dataset", "rows"): "count(*)",
    ("dataset", "series"): "count(DISTINCT series_id)",
    ("dataset", "periods"): "count(DISTINCT period_date)",
    ("dataset", "start_period"): "min(period_date)",
    ("dataset", "end_period"): "max(period_date)",
    ("dataset", "forecast_records"): "count(*) FILTER (has_forecast_record)",
    ("outputs", "historical_dashboard_alerts"): "count(*) FILTER (historical_dashboard_alert)",
    ("outputs", "forecast_dashboard_alerts"): "count(*) FILTER (forecast_dashboard_alert)",
    ("outputs", "confirmed_anomalies"): "count(*) FILTER (overall_status = 'confirmed_anomaly')",
    ("outputs", "overall_dashboard_alerts"): "count(*) FILTER (overall_dashboard_alert)",
    ("outputs", "overall_high"): "count(*) FILTER (overall_severity = 'high')",
    ("outputs", "overall_moderate"): "count(*) FILTER (overall_severity = 'moderate')",
    ("outputs", "overall_unavailable"): "count(*) FILTER (overall_status = 'unavailable')",
}


@query(
    "a19_anomaly_metadata",
    " UNION ALL ".join(
        [
            f"SELECT '{c}' AS category, '{i}' AS item, CAST({e} AS VARCHAR) AS value FROM q_summary"
            for (c, i), e in COUNTED.items()
        ]
        + [f"SELECT '{c}', '{i}', '{v}'" for c, i, v in SETTINGS]
    ),
)
def a19(d: DriverTables):
    return consolidation.anomaly_metadata(d.stored_summary)


@query(
    "d04_alert_statistics",
    """
    SELECT series_id, metric, geography_level, location_id, location_name, count(*) AS observations,
           count(*) FILTER (overall_dashboard_alert) AS alerts,
           count(*) FILTER (overall_dashboard_alert AND overall_severity = 'high') AS high_alerts,
           count(*) FILTER (overall_dashboard_alert AND overall_status = 'confirmed_anomaly') AS both_detector_alerts,
           max(period_date) FILTER (overall_dashboard_alert) AS latest_alert,
           arg_max(overall_status, period_date) FILTER (overall_dashboard_alert) AS latest_alert_status,
           bool_or(has_forecast_record) AS has_forecast_coverage
    FROM q_summary GROUP BY ALL
    """,
)
def d04(d: DriverTables):
    return consolidation.alert_statistics(d.summary)


# ---- checks ---------------------------------------------------------------------------------------

STATUS_SQL = "overall_status IS NOT DISTINCT FROM"
RULES = {
    "valid_overall_status": f"overall_status NOT IN ({sql_list(C.STATUS_VALUES)})",
    "valid_overall_severity": f"overall_severity NOT IN ({sql_list(C.SEVERITY_VALUES)})",
    "valid_overall_direction": f"overall_direction NOT IN ({sql_list(C.DIRECTION_VALUES)})",
    "valid_detector_coverage": f"detector_coverage NOT IN ({sql_list(C.COVERAGE_VALUES)})",
    "overall_alert_union": "overall_dashboard_alert <> (ha OR fa)",
    "confirmed_anomaly_logic": f"({STATUS_SQL} 'confirmed_anomaly') <> (ha AND fa)",
    "historical_alert_logic": f"({STATUS_SQL} 'historical_alert') <> (ha AND NOT fa)",
    "forecast_alert_logic": f"({STATUS_SQL} 'forecast_alert') <> (fa AND NOT ha)",
    "unavailable_status_logic": f"({STATUS_SQL} 'unavailable') <> (NOT hs AND NOT fs)",
    "normal_status_logic": f"({STATUS_SQL} 'normal') <> ((hs OR fs) AND NOT ha AND NOT fa)",
    "detector_coverage_logic": """detector_coverage <> CASE WHEN hs AND fs THEN 'both' WHEN hs THEN 'historical_only'
                                  WHEN fs THEN 'forecast_only' ELSE 'unavailable' END""",
    "alert_severity_consistency": "overall_dashboard_alert AND overall_severity NOT IN ('moderate', 'high')",
    "normal_severity_consistency": "overall_status = 'normal' AND overall_severity <> 'normal'",
    "unavailable_severity_consistency": "overall_status = 'unavailable' AND overall_severity <> 'unavailable'",
    "forecast_availability_requires_record": "fs AND NOT has_forecast_record",
}


@query(
    "q11_anomaly_summary_checks",
    _checks_sql(
        "SELECT (SELECT coalesce(sum(k), 0) FROM (SELECT count(*) AS k FROM q_summary GROUP BY series_id, period_date) WHERE k > 1)"
        " AS unique_series_period, "
        + ", ".join(f"count(*) FILTER ({rule}) AS {name}" for name, rule in RULES.items())
        + " FROM (SELECT *, historical_dashboard_alert AS ha, forecast_dashboard_alert AS fa,"
        " historical_detector_available AS hs, forecast_detector_available AS fs FROM q_summary)",
        ["unique_series_period", *RULES],
    ),
)
def q11(d: DriverTables):
    return consolidation.summary_checks(d.summary).drop("details")


# ---- evaluation --------------------------------------------------------------------------------------


def _window() -> tuple[date, date]:
    start, end = TRANSITION
    return date.fromisoformat(start), date.fromisoformat(end)


RATES_SQL = f"""
SELECT 'transition_period' AS evaluation, w.period, w.start_date, w.end_date, w.months, count(h.series_id) AS rows,
       count(*) FILTER (h.historical_score_available) AS scored_observations,
       count(*) FILTER (h.historical_is_anomaly) AS statistical_anomalies,
       count(*) FILTER (h.dashboard_alert) AS dashboard_alerts,
       CASE WHEN count(*) FILTER (h.historical_score_available) > 0
            THEN count(*) FILTER (h.historical_is_anomaly) / count(*) FILTER (h.historical_score_available) ELSE 0 END
         AS statistical_anomaly_rate,
       CASE WHEN count(*) FILTER (h.historical_score_available) > 0
            THEN count(*) FILTER (h.dashboard_alert) / count(*) FILTER (h.historical_score_available) ELSE 0 END
         AS dashboard_alert_rate
FROM (
  SELECT 'pre_transition_comparison' AS period, CAST(DATE '2000-01-01' - to_months(months) AS DATE) AS start_date,
         DATE '1999-12-01' AS end_date, months FROM (SELECT CAST(datediff('month', DATE '2000-01-01', least(max(period_date), DATE '2001-12-31')) + 1 AS INTEGER) AS months FROM q_panel)
  UNION ALL
  SELECT 'bond_hub_transition', DATE '2000-01-01', least(max(period_date), DATE '2001-12-31'),
         CAST(datediff('month', DATE '2000-01-01', least(max(period_date), DATE '2001-12-31')) + 1 AS INTEGER) FROM q_panel
) w
LEFT JOIN (SELECT * FROM q_historical WHERE series_id NOT IN ({sql_list(C.duplicated_series_ids())})) h
  ON h.period_date BETWEEN w.start_date AND w.end_date
GROUP BY w.period, w.start_date, w.end_date, w.months
"""


@query("n07_transition_rates", RATES_SQL, rounded=["statistical_anomaly_rate", "dashboard_alert_rate"])
def n07(d: DriverTables):
    return evaluation.transition_rates(without_duplicated_series(d.historical), *_window())


SHOCKED_SQL = historical_sql(
    """(SELECT concat(series_id, '|', shock_value) AS series_id, series_id AS base_series, metric, period_date, shock_value,
        place = 1 AS newest, value + CASE WHEN place = 1 THEN shock_value ELSE 0 END AS value
 FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY period_date DESC) AS place FROM q_panel),
      (VALUES (CAST(150 AS DOUBLE)), (CAST(-150 AS DOUBLE))) s(shock_value))"""
)


RECOVERY_SQL = f"""
    SELECT 'synthetic_injection' AS evaluation, CASE WHEN shock_value > 0 THEN 'positive_shock' ELSE 'negative_shock' END AS scenario,
           base_series AS series_id, metric, shock_value, true AS expected_anomaly, historical_is_anomaly AS detected_anomaly,
           CASE WHEN shock_value > 0 THEN 'high' ELSE 'low' END AS expected_direction, historical_direction AS observed_direction,
           historical_severity AS severity, historical_score AS score,
           historical_is_anomaly AND historical_direction = CASE WHEN shock_value > 0 THEN 'high' ELSE 'low' END AS passed
    FROM ({SHOCKED_SQL}) WHERE newest
    """


@query(
    "n08_shock_injection_recovery",
    RECOVERY_SQL,
    rounded=["score"],
)
def n08(d: DriverTables):
    return evaluation.shock_recovery(d.panel)


SWEEP_SQL = f"""
SELECT 'threshold_sensitivity' AS evaluation, threshold, cases AS injected_cases, injected_recovered,
       CASE WHEN cases > 0 THEN injected_recovered / cases ELSE 0 END AS injection_recovery_rate,
       scored AS background_scored_observations, background_alerts,
       CASE WHEN scored > 0 THEN background_alerts / scored ELSE 0 END AS background_alert_rate
FROM (
  SELECT threshold, (SELECT count(historical_score) FROM shocked) AS cases,
         (SELECT count(*) FROM shocked WHERE abs(historical_score) >= threshold) AS injected_recovered,
         (SELECT count(historical_score) FROM q_detected) AS scored,
         (SELECT count(*) FROM q_detected WHERE abs(historical_score) >= threshold) AS background_alerts
  FROM (VALUES (CAST(2 AS DOUBLE)), (2.5), (3), (3.5), (4)) t(threshold)
)
"""


@query(
    "n09_threshold_sweep",
    f"SELECT * FROM (WITH shocked AS (SELECT * FROM ({SHOCKED_SQL}) WHERE newest) {SWEEP_SQL})",
    rounded=["injection_recovery_rate", "background_alert_rate"],
)
def n09(d: DriverTables):
    return evaluation.threshold_sweep(d.stored_panel)


def _evaluation_table(d: DriverTables):
    historical = historical_anomalies.practical_historical(historical_anomalies.detect_historical(d.stored_panel))
    return evaluation_table(d.stored_panel, historical, *_window())


@query(
    "t06_concat_evaluations",
    f"""
    SELECT * FROM (
      WITH shocked AS (SELECT * FROM ({SHOCKED_SQL}) WHERE newest)
      SELECT *, 'synthetic_injection' AS evaluation_group FROM ({RECOVERY_SQL})
      UNION ALL BY NAME SELECT *, 'threshold_sensitivity' AS evaluation_group FROM ({SWEEP_SQL})
      UNION ALL BY NAME SELECT *, 'transition_period' AS evaluation_group FROM ({RATES_SQL})
    )
    """,
    rounded=["score", "injection_recovery_rate", "background_alert_rate", "statistical_anomaly_rate", "dashboard_alert_rate"],
)
def t06(d: DriverTables):
    return _evaluation_table(d)


@query(
    "q12_evaluation_checks",
    _checks_sql(
        f"""WITH shocked AS (SELECT * FROM ({SHOCKED_SQL}) WHERE newest), sweep AS ({SWEEP_SQL}), rates AS ({RATES_SQL})
        SELECT 3 - CAST((SELECT count(*) > 0 FROM shocked) AS INTEGER) - CAST((SELECT count(*) > 0 FROM sweep) AS INTEGER)
                 - CAST((SELECT count(*) > 0 FROM rates) AS INTEGER) AS known_groups,
               (SELECT abs(count(*) - 2 * count(DISTINCT base_series)) FROM shocked) AS injection_rows,
               (SELECT abs(count(*) - 5) FROM sweep) AS sensitivity_rows,
               (SELECT count(*) FILTER (injection_recovery_rate NOT BETWEEN 0 AND 1 OR background_alert_rate NOT BETWEEN 0 AND 1)
                FROM sweep) AS valid_rates,
               (SELECT abs(count(*) - 2) FROM rates) AS transition_rows,
               (SELECT count(DISTINCT months) - 1 FROM rates) AS equal_windows""",
        ["known_groups", "injection_rows", "sensitivity_rows", "valid_rates", "transition_rows", "equal_windows"],
    ),
)
def q12(d: DriverTables):
    series = d.stored_panel.select("series_id").distinct().count()
    return evaluation.evaluation_checks(durable(_evaluation_table(d), "evaluation"), 2 * series).drop("details")
