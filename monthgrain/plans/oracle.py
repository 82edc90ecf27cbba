"""SQL building blocks of the correctness check.

Named common table expressions restate the derivations in plain SQL; a query's check names the blocks it
reads and :func:`with_blocks` puts them, with everything they depend on, in front of its SELECT.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from monthgrain import contracts as C
from monthgrain.operators.smoothing import GRID

BLOCKS: dict[str, str] = {}


def block(name: str, sql: str) -> None:
    BLOCKS[name] = sql.strip()


def _needed(sql: str, seen: list[str], inside: str = "") -> None:
    for name in BLOCKS:
        if name not in (*seen, inside) and re.search(rf"\b{name}\b", sql):
            _needed(BLOCKS[name], seen, name)
            seen.append(name)


def with_blocks(select: str, rounded: Sequence[str] = ()) -> str:
    """Complete statement for ``select``; ``rounded`` columns are rounded as in the Spark query."""
    blocks: list[str] = []
    _needed(select, blocks)
    body = select.strip()
    if rounded:
        fixes = ", ".join(f"round({c} + 1e-9, 6) AS {c}" for c in rounded)
        body = f"SELECT * REPLACE ({fixes}) FROM ({body})"
    if not blocks:
        return body
    recursive = "RECURSIVE " if "q_fold" in blocks else ""
    text = ",\n".join(f"{b} AS {'' if b == 'q_fold' else 'MATERIALIZED '}({BLOCKS[b]})" for b in blocks)
    return f"WITH {recursive}{text}\n{body}"


def sql_list(values: Sequence[object]) -> str:
    return ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in values)


# ---- observations ----------------------------------------------------------------------------
WIDE = """
SELECT period_date, geography_level, location_id, location_name,
       CAST(sum(price) AS DOUBLE) / count(*) / 500 AS median_rent,
       count(*) AS bonds_lodged,
       period_date >= DATE '2001-05-01' AS is_provisional,
       CAST(year(period_date) AS BIGINT) AS source_snapshot_id
FROM (
  SELECT *, 'territorial_authority' AS geography_level, n_nationkey + 28 AS location_id, n_name AS location_name FROM {src}
  UNION ALL
  SELECT *, 'region', r_regionkey + 1, r_name FROM {src}
  UNION ALL
  SELECT *, 'region', -99, 'ALL' FROM {src}
)
GROUP BY period_date, geography_level, location_id, location_name
"""
ORDERS = """
SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS period_date, n_nationkey, n_name, r_regionkey, r_name,
       CAST(o_totalprice AS DECIMAL(18, 2)) AS price
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
     JOIN region ON n_regionkey = r_regionkey
"""
block("q_orders", ORDERS)
block("q_clean", WIDE.format(src="q_orders"))
block("q_sold", ORDERS + " WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)")
block(
    "q_market",
    f"""
SELECT period_date AS period_start, last_day(period_date) AS period_end, 'REGC2019' AS area_definition,
       location_name AS area_name, 'ALL' AS dwelling_type, 'ALL' AS bedrooms, median_rent, bonds_lodged
FROM ({WIDE.format(src="q_sold")}) WHERE geography_level = 'region'
""",
)
block(
    "q_panel",
    """
SELECT period_date, concat(geography_level, '_', location_id, '_', metric) AS series_id, geography_level, location_id,
       location_name, metric, value, is_provisional AS source_snapshot_provisional, source_snapshot_id
FROM (
  SELECT *, 'median_rent' AS metric, median_rent AS value FROM q_clean
  UNION ALL
  SELECT *, 'bonds_lodged', CAST(bonds_lodged AS DOUBLE) FROM q_clean
)
WHERE geography_level IN ('region', 'territorial_authority') AND location_id NOT IN (-99, -1)
""",
)

# ---- coverage and selection ------------------------------------------------------------------
RUNS = """
SELECT *, datediff('month', period_date, max(period_date) OVER (PARTITION BY series_id)) AS back,
       row_number() OVER (PARTITION BY series_id ORDER BY period_date DESC) - 1 AS place
FROM {src}
"""
CATALOG = """
SELECT *, n_observations / expected_observations AS completeness_rate,
       expected_observations - n_observations AS missing_months,
       continuous_months >= 77 AND run_nulls = 0 AS eligible_for_forecasting
FROM (
  SELECT series_id, geography_level, location_id, location_name, metric,
         min(period_date) AS start_period, max(period_date) AS end_period, count(*) AS n_observations,
         datediff('month', min(period_date), max(period_date)) + 1 AS expected_observations,
         count(*) FILTER (value IS NULL) AS null_values,
         min(period_date) FILTER (back = place) AS continuous_start,
         count(*) FILTER (back = place) AS continuous_months,
         count(*) FILTER (back = place AND value IS NULL) AS run_nulls
  FROM {src} GROUP BY ALL
)
"""
block("q_runs", RUNS.format(src="q_panel"))
block("q_catalog", CATALOG.format(src="q_runs"))
# months that the newest order date has left behind
block(
    "q_full",
    "SELECT * FROM q_panel WHERE period_date < (SELECT date_trunc('month', max(o_orderdate) + INTERVAL 1 DAY) FROM orders)",
)
block("q_full_runs", RUNS.format(src="q_full"))
block("q_full_catalog", CATALOG.format(src="q_full_runs"))
block(
    "q_quality",
    """
SELECT *, CASE WHEN duplicate_periods + null_values + negative_values = 0 THEN 'PASS' ELSE 'FAIL' END AS status
FROM (
  SELECT series_id, min(metric) AS metric, count(*) - count(DISTINCT period_date) AS duplicate_periods,
         count(*) FILTER (value IS NULL) AS null_values, count(*) FILTER (value < 0) AS negative_values,
         count(*) FILTER (value = 0) AS zero_values, bool_or(source_snapshot_provisional) AS source_snapshot_provisional
  FROM q_panel GROUP BY series_id
)
""",
)
block(
    "q_selected",
    f"""
SELECT q_full.* FROM q_full JOIN q_full_catalog USING (series_id)
WHERE eligible_for_forecasting AND q_full.period_date >= continuous_start
  AND series_id NOT IN ({sql_list(C.duplicated_series_ids())})
""",
)
block(
    "q_placed",
    """
SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY period_date) AS place,
       count(*) OVER (PARTITION BY series_id) AS n, min(period_date) OVER (PARTITION BY series_id) AS first_period
FROM q_selected
""",
)
block(
    "q_origins",
    """
SELECT series_id, period_date AS origin, first_period AS train_start, period_date AS train_end,
       CAST(period_date + INTERVAL 1 MONTH AS DATE) AS test_start,
       CAST(period_date + INTERVAL 6 MONTH AS DATE) AS test_end, 6 AS horizon
FROM q_placed WHERE place BETWEEN greatest(60, n - 17) AND n - 6
""",
)

# ---- forecasts -------------------------------------------------------------------------------
block(
    "q_naive",
    """
SELECT 'seasonal_naive' AS model, t.series_id, t.metric, t.geography_level, t.location_id, t.location_name, o.origin,
       t.period_date AS forecast_period, CAST(datediff('month', o.origin, t.period_date) AS INTEGER) AS horizon_step,
       t.value AS actual, r.value AS predicted
FROM q_origins o
JOIN q_selected t ON t.series_id = o.series_id AND t.period_date > o.origin AND t.period_date <= o.test_end
JOIN q_selected r ON r.series_id = o.series_id AND r.period_date = CAST(t.period_date - INTERVAL 12 MONTH AS DATE)
     AND r.period_date <= o.origin
""",
)
block(
    "q_grid",
    "SELECT * FROM (VALUES "
    + ", ".join(f"(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE), CAST({g} AS DOUBLE), CAST({p} AS DOUBLE))" for a, b, g, p in GRID)
    + ") AS t(alpha, beta, gamma, phi)",
)
block(
    "q_arrays",
    """
SELECT series_id, list(value ORDER BY period_date) AS y, count(*) AS n, min(period_date) AS first_period
FROM q_selected GROUP BY series_id
""",
)
block(
    "q_start",
    """
SELECT series_id, n, y1 / 12.0 AS level, (y2 - y1) / 144.0 AS trend,
       list_transform(y[1:12], lambda v: v - y1 / 12.0) AS season
FROM (SELECT *, list_reduce(y[1:12], lambda a, b: a + b) AS y1, list_reduce(y[13:24], lambda a, b: a + b) AS y2 FROM q_arrays)
""",
)
block(
    "q_fold",
    """
SELECT series_id, n, alpha, beta, gamma, phi, 0 AS i, level, trend, season, CAST(0 AS DOUBLE) AS sse FROM q_start, q_grid
UNION ALL
SELECT series_id, n, alpha, beta, gamma, phi, i + 1, level + drift + alpha * e, drift + alpha * beta * e,
       list_concat(season[2:12], [season[1] + gamma * e]), sse + e * e
FROM (
  SELECT *, v - (level + drift + season[1]) AS e
  FROM (
    SELECT f.*, f.phi * f.trend AS drift, a.y[f.i + 1] AS v FROM q_fold f JOIN q_arrays a USING (series_id) WHERE f.i < f.n
  )
)
""",
)
block(
    "q_paths",
    """
SELECT *, phi AS d1, phi + phi * phi AS d2, phi + phi * phi + phi * phi * phi AS d3,
       phi + phi * phi + phi * phi * phi + phi * phi * phi * phi AS d4,
       phi + phi * phi + phi * phi * phi + phi * phi * phi * phi + phi * phi * phi * phi * phi AS d5,
       phi + phi * phi + phi * phi * phi + phi * phi * phi * phi + phi * phi * phi * phi * phi
         + phi * phi * phi * phi * phi * phi AS d6
FROM (
  SELECT *, row_number() OVER (PARTITION BY series_id, i ORDER BY sse, alpha, beta, gamma, phi) AS best
  FROM q_fold WHERE i BETWEEN greatest(60, n - 17) AND n AND (i <= n - 6 OR i = n)
) WHERE best = 1
""",
)
block(
    "q_path_steps",
    "\nUNION ALL\n".join(
        f"SELECT series_id, n, i, {h} AS horizon_step, level + trend * d{h} + season[{h}] AS predicted FROM q_paths"
        for h in range(1, 7)
    ),
)
block(
    "q_smoothed",
    """
SELECT 'ets_additive_damped' AS model, t.series_id, t.metric, t.geography_level, t.location_id, t.location_name,
       CAST(t.first_period + to_months(CAST(p.i - 1 AS INTEGER)) AS DATE) AS origin, t.period_date AS forecast_period,
       CAST(p.horizon_step AS INTEGER) AS horizon_step, t.value AS actual, p.predicted
FROM q_path_steps p JOIN q_placed t ON t.series_id = p.series_id AND t.place = p.i + p.horizon_step
WHERE p.i <= p.n - 6
""",
)
block("q_predictions", "SELECT * FROM q_naive UNION ALL SELECT * FROM q_smoothed")
SMAPE_SQL = """avg(CASE WHEN abs(actual) + abs(predicted) = 0 THEN 0 ELSE 2.0 * abs(actual - predicted) / (abs(actual) + abs(predicted)) END)
  * 100.0 AS smape"""
METRICS_SQL = f"""
avg(abs(actual - predicted)) AS mae, sqrt(avg((actual - predicted) * (actual - predicted))) AS rmse, {SMAPE_SQL}
"""
block(
    "q_by_series",
    f"""
SELECT model, series_id, metric, geography_level, location_id, location_name, count(DISTINCT origin) AS n_origins,
       count(*) AS n_forecasts, {METRICS_SQL}
FROM q_predictions GROUP BY ALL
""",
)
block(
    "q_winners",
    """
SELECT series_id, metric, geography_level, location_id, location_name, model AS best_model,
       mae AS best_mae, rmse AS best_rmse, smape AS best_smape
FROM q_by_series
QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY smape, mae, rmse, model) = 1
""",
)
block(
    "q_comparison",
    f"""
SELECT s.model, s.metric, n_series, n_forecasts, s.mae, s.rmse, s.smape,
       CAST(rank() OVER (PARTITION BY s.metric ORDER BY s.mae) AS INTEGER) AS rank_mae,
       CAST(rank() OVER (PARTITION BY s.metric ORDER BY s.rmse) AS INTEGER) AS rank_rmse,
       CAST(rank() OVER (PARTITION BY s.metric ORDER BY s.smape) AS INTEGER) AS rank_smape,
       (b.mae - s.mae) / b.mae * 100.0 AS mae_improvement_vs_baseline_pct,
       (b.rmse - s.rmse) / b.rmse * 100.0 AS rmse_improvement_vs_baseline_pct,
       (b.smape - s.smape) / b.smape * 100.0 AS smape_improvement_vs_baseline_pct
FROM (SELECT model, metric, count(DISTINCT series_id) AS n_series, count(*) AS n_forecasts, {METRICS_SQL}
      FROM q_predictions GROUP BY model, metric) s
LEFT JOIN (SELECT metric, {METRICS_SQL} FROM q_predictions WHERE model = 'seasonal_naive' GROUP BY metric) b USING (metric)
""",
)
block(
    "q_forward",
    """
SELECT 'ets_additive_damped' AS model, l.series_id, l.metric, l.geography_level, l.location_id, l.location_name,
       l.period_date AS forecast_origin, CAST(l.period_date + to_months(CAST(p.horizon_step AS INTEGER)) AS DATE) AS forecast_period,
       CAST(p.horizon_step AS INTEGER) AS horizon_step, p.predicted
FROM q_path_steps p JOIN q_placed l ON l.series_id = p.series_id AND l.place = l.n AND p.i = p.n
""",
)
block(
    "q_naive_forward",
    """
SELECT 'seasonal_naive' AS model, h.series_id, h.metric, h.geography_level, h.location_id, h.location_name,
       o.origin AS forecast_origin, CAST(h.period_date + INTERVAL 12 MONTH AS DATE) AS forecast_period,
       CAST(datediff('month', o.origin, h.period_date) + 12 AS INTEGER) AS horizon_step, h.value AS predicted
FROM q_selected h, (SELECT max(period_date) AS origin FROM q_selected) o
WHERE datediff('month', o.origin, h.period_date) + 12 BETWEEN 1 AND 6
""",
)

# ---- anomalies -------------------------------------------------------------------------------
SCORE_FIELDS = """
{s} IS NOT NULL AS {p}_score_available,
CASE WHEN {s} IS NULL THEN 'unavailable' WHEN abs({s}) >= 3.5 THEN 'high' WHEN abs({s}) >= 2.5 THEN 'moderate'
     ELSE 'normal' END AS {p}_severity,
CASE WHEN {s} IS NULL THEN 'unavailable' WHEN {s} >= 2.5 THEN 'high' WHEN {s} <= -2.5 THEN 'low' ELSE 'normal' END
  AS {p}_direction,
{s} IS NOT NULL AND abs({s}) >= 2.5 AS {p}_is_anomaly
"""


def historical_sql(source: str) -> str:
    """Detector without practical significance over any panel-shaped relation."""
    return f"""
SELECT *, {SCORE_FIELDS.format(s="historical_score", p="historical")}, 12 AS seasonal_lag, 36 AS baseline_window,
       24 AS minimum_baseline_observations
FROM (
  SELECT *, CASE WHEN historical_scale > 0 THEN historical_deviation / historical_scale END AS historical_score
  FROM (
    SELECT *, CASE WHEN historical_expected <> 0 THEN historical_deviation / historical_expected * 100.0 END
             AS historical_deviation_pct,
           CASE WHEN historical_mad > 0 THEN 'mad' WHEN historical_iqr > 0 THEN 'iqr' ELSE 'unavailable' END
             AS historical_scale_method,
           CASE WHEN historical_mad > 0 THEN historical_mad / 0.6745 WHEN historical_iqr > 0 THEN historical_iqr / 1.349 END
             AS historical_scale
    FROM (
      SELECT *, seasonal_reference + historical_change_expected AS historical_expected,
             value - (seasonal_reference + historical_change_expected) AS historical_deviation
      FROM (
        SELECT * EXCLUDE (k, m0, d0, r0), CASE WHEN k >= 24 THEN m0 END AS historical_change_expected,
               CASE WHEN k >= 24 THEN d0 END AS historical_mad, CASE WHEN k >= 24 THEN r0 END AS historical_iqr
        FROM (
          SELECT *, count(seasonal_change) OVER f AS k, quantile_cont(seasonal_change, 0.5) OVER f AS m0,
                 mad(seasonal_change) OVER f AS d0,
                 quantile_cont(seasonal_change, 0.75) OVER f - quantile_cont(seasonal_change, 0.25) OVER f AS r0
          FROM (
            SELECT *, value - seasonal_reference AS seasonal_change
            FROM (SELECT *, lag(value, 12) OVER (PARTITION BY series_id ORDER BY period_date) AS seasonal_reference
                  FROM {source})
          )
          WINDOW f AS (PARTITION BY series_id ORDER BY period_date ROWS BETWEEN 36 PRECEDING AND 1 PRECEDING)
        )
      )
    )
  )
)
"""


block("q_detected", historical_sql("q_panel"))
block(
    "q_historical",
    """
SELECT *,
       CASE WHEN NOT historical_score_available OR NOT practical_significance_available THEN 'unavailable'
            WHEN dashboard_alert THEN 'dashboard_alert' WHEN statistical_anomaly THEN 'statistical_only' ELSE 'normal' END
         AS alert_status
FROM (
  SELECT *, historical_score_available AND historical_is_anomaly AND practical_significance AS dashboard_alert
  FROM (
    SELECT *, historical_is_anomaly AS statistical_anomaly,
           historical_deviation IS NOT NULL AND historical_deviation_pct IS NOT NULL AS practical_significance_available,
           coalesce(abs(historical_deviation) >= practical_abs_threshold
                    AND abs(historical_deviation_pct) >= practical_pct_threshold, false) AS practical_significance
    FROM (
      SELECT *, CAST(CASE metric WHEN 'median_rent' THEN 15 WHEN 'bonds_lodged' THEN 25 END AS DOUBLE) AS practical_abs_threshold,
             CAST(CASE metric WHEN 'median_rent' THEN 3 WHEN 'bonds_lodged' THEN 20 END AS DOUBLE) AS practical_pct_threshold
      FROM q_detected
    )
  )
)
""",
)
block(
    "q_winner_rows",
    """
SELECT p.*, w.best_model FROM q_predictions p JOIN q_winners w ON w.series_id = p.series_id AND w.metric = p.metric
WHERE p.model = w.best_model
""",
)
block(
    "q_residual_scored",
    f"""
SELECT *, {SCORE_FIELDS.format(s="forecast_anomaly_score", p="forecast")}
FROM (
  SELECT *, CASE WHEN forecast_residual_scale > 0
                 THEN (forecast_residual - residual_median) / forecast_residual_scale END AS forecast_anomaly_score
  FROM (
    SELECT * EXCLUDE (k, m0, d0, r0), m0 AS residual_median, d0 AS residual_mad, r0 AS residual_iqr,
           CASE WHEN d0 > 0 THEN 'mad' WHEN r0 > 0 THEN 'iqr' ELSE 'unavailable' END AS forecast_scale_method,
           CASE WHEN d0 > 0 THEN d0 / 0.6745 WHEN r0 > 0 THEN r0 / 1.349 END AS forecast_residual_scale
    FROM (
      SELECT * REPLACE (CASE WHEN k >= 6 THEN m0 END AS m0, CASE WHEN k >= 6 THEN d0 END AS d0, CASE WHEN k >= 6 THEN r0 END AS r0)
      FROM (
        SELECT *, count(forecast_residual) OVER f AS k, quantile_cont(forecast_residual, 0.5) OVER f AS m0,
               mad(forecast_residual) OVER f AS d0,
               quantile_cont(forecast_residual, 0.75) OVER f - quantile_cont(forecast_residual, 0.25) OVER f AS r0
        FROM (
          SELECT *, actual - predicted AS forecast_residual,
                 CASE WHEN predicted <> 0 THEN (actual - predicted) / predicted * 100.0 END AS forecast_residual_pct,
                 CASE WHEN actual > predicted THEN 'above_forecast' WHEN actual < predicted THEN 'below_forecast'
                      ELSE 'on_forecast' END AS forecast_error_direction
          FROM q_winner_rows WHERE horizon_step = 1
        )
        WINDOW f AS (PARTITION BY series_id ORDER BY forecast_period ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
      )
    )
  )
)
""",
)
block(
    "q_residual",
    """
SELECT *, CASE WHEN NOT forecast_score_available OR NOT forecast_practical_significance_available THEN 'unavailable'
               WHEN forecast_dashboard_alert THEN 'dashboard_alert' WHEN forecast_statistical_anomaly THEN 'statistical_only'
               ELSE 'normal' END AS forecast_alert_status
FROM (
  SELECT *, forecast_is_anomaly AS forecast_statistical_anomaly,
         forecast_is_anomaly AND forecast_practical_significance AS forecast_dashboard_alert
  FROM (
    SELECT *, forecast_residual IS NOT NULL AND forecast_residual_pct IS NOT NULL AS forecast_practical_significance_available,
           coalesce(CASE metric
             WHEN 'median_rent' THEN abs(forecast_residual) >= 15 AND abs(forecast_residual_pct) >= 2
             WHEN 'bonds_lodged' THEN forecast_residual_pct IS NOT NULL
                  AND (abs(forecast_residual) >= 50 OR abs(forecast_residual_pct) >= 10) END, false)
             AS forecast_practical_significance
    FROM q_residual_scored
  )
)
""",
)
block(
    "q_summary",
    """
SELECT * EXCLUDE (ha, fa, hs, fs, said, severity_now),
       ha AS historical_dashboard_alert, fa AS forecast_dashboard_alert,
       hs AS historical_detector_available, fs AS forecast_detector_available,
       CASE WHEN hs AND fs THEN 'both' WHEN hs THEN 'historical_only' WHEN fs THEN 'forecast_only' ELSE 'unavailable' END
         AS detector_coverage,
       CASE WHEN NOT hs AND NOT fs THEN 'unavailable' WHEN ha AND fa THEN 'confirmed_anomaly' WHEN ha THEN 'historical_alert'
            WHEN fa THEN 'forecast_alert' ELSE 'normal' END AS overall_status,
       ha OR fa AS overall_dashboard_alert,
       CASE WHEN NOT hs AND NOT fs THEN 'unavailable' WHEN severity_now = 2 THEN 'high' WHEN severity_now = 1 THEN 'moderate'
            ELSE 'normal' END AS overall_severity,
       CASE WHEN ha AND fa AND historical_direction = said THEN said WHEN ha AND fa THEN 'mixed'
            WHEN ha THEN historical_direction WHEN fa THEN said ELSE 'normal' END AS overall_direction
FROM (
  SELECT h.*, f.model AS forecast_model, f.predicted, f.forecast_residual, f.forecast_residual_pct, f.forecast_error_direction,
         f.forecast_anomaly_score, f.forecast_severity, f.series_id IS NOT NULL AS has_forecast_record,
         h.dashboard_alert AS ha, coalesce(f.forecast_dashboard_alert, false) AS fa,
         h.historical_score_available AS hs, coalesce(f.forecast_score_available, false) AS fs,
         CASE f.forecast_error_direction WHEN 'above_forecast' THEN 'high' WHEN 'below_forecast' THEN 'low'
              WHEN 'on_forecast' THEN 'normal' END AS said,
         greatest(CASE WHEN h.dashboard_alert THEN CASE h.historical_severity WHEN 'high' THEN 2 WHEN 'moderate' THEN 1 ELSE 0 END
                       ELSE 0 END,
                  CASE WHEN coalesce(f.forecast_dashboard_alert, false)
                       THEN CASE f.forecast_severity WHEN 'high' THEN 2 WHEN 'moderate' THEN 1 ELSE 0 END ELSE 0 END)
           AS severity_now
  FROM q_historical h LEFT JOIN q_residual f ON f.series_id = h.series_id AND f.forecast_period = h.period_date
)
""",
)
