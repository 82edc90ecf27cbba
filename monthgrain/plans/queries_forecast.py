"""Backtests, comparison, policies and forward forecasts (families M, A07-A14, J, T, V, Q05-Q10)."""

from __future__ import annotations

from pyspark.sql import functions as F

from monthgrain import contracts as C
from monthgrain.functions.scoring import error_metrics
from monthgrain.operators import checks, comparison, joins, policy, production, seasonal_naive, smoothing
from monthgrain.operators.residual_anomalies import winner_predictions
from monthgrain.plans.catalogue import query
from monthgrain.plans.driver_tables import POLICY_CUTOFF, DriverTables
from monthgrain.plans.oracle import METRICS_SQL, SMAPE_SQL
from monthgrain.plans.queries_history import _checks_sql
from monthgrain.session import durable

PREDICTED = "model, series_id, metric, geography_level, location_id, location_name, origin, forecast_period, horizon_step, actual, predicted"
SCORES = ["mae", "rmse", "smape"]
ERRORS_SQL = "actual - predicted AS error, abs(actual - predicted) AS absolute_error, (actual - predicted) * (actual - predicted) AS squared_error"


# ---- backtests ---------------------------------------------------------------------------------


@query("m04_seasonal_naive_backtest", f"SELECT {PREDICTED}, {ERRORS_SQL} FROM q_naive")
def m04(d: DriverTables):
    return d.naive


@query(
    "m05_ets_backtest",
    f"SELECT {PREDICTED}, {ERRORS_SQL} FROM q_smoothed",
    rounded=["predicted", "error", "absolute_error", "squared_error"],
)
def m05(d: DriverTables):
    return d.smoothed


@query("m05_fitted_backtest", rounded=["predicted", "error", "absolute_error", "squared_error"])
def m05_fitted(d: DriverTables):
    return smoothing.smoothing_backtest(d.selected, steps=smoothing.STEPS)


@query("m05_fitted_gain")
def m05_gain(d: DriverTables):
    """Squared training error of the grid point and of the fit refined from it, for every series."""
    history = d.modelled
    grid = smoothing.smoothing_fits(history).select("series_id", F.col("sse").alias("grid_sse"))
    return smoothing.smoothing_fits(history, steps=smoothing.STEPS).join(grid, "series_id")


@query("m05_fitted_errors")
def m05_errors(d: DriverTables):
    """Out-of-sample errors of grid and refined fits by metric and forecast step."""
    frames = [
        smoothing.smoothing_backtest(d.modelled, steps=steps).withColumn("fit", F.lit(name))
        for name, steps in (("grid", 0), ("refined", smoothing.STEPS))
    ]
    rows = frames[0].unionByName(frames[1])
    return rows.groupBy("fit", "metric", "horizon_step").agg(F.count(F.lit(1)).alias("n_forecasts"), *error_metrics())


FIXED_POINT = (0.3, 0.15, 0.15, 0.9)


@query(
    "m06_ets_fixed_smooth",
    """
    SELECT series_id, CAST(i AS INTEGER) AS train_rows, sse, alpha, beta, gamma, phi FROM q_fold
    WHERE i = n AND alpha = 0.3 AND beta = 0.15 AND gamma = 0.15 AND phi = 0.9
    """,
    rounded=["sse"],
)
def m06(d: DriverTables):
    return smoothing.smoothing_fits(d.selected, grid=[FIXED_POINT])


# ---- comparison ----------------------------------------------------------------------------------


@query(
    "a07_metrics_by_origin",
    f"""
    SELECT model, series_id, metric, geography_level, location_id, location_name, origin, count(*) AS n_forecasts, {METRICS_SQL}
    FROM q_predictions GROUP BY ALL
    """,
    rounded=SCORES,
)
def a07(d: DriverTables):
    return comparison.metrics_by_origin(d.predictions)


@query("a08_metrics_by_series", "SELECT * FROM q_by_series", rounded=SCORES)
def a08(d: DriverTables):
    return d.by_series


@query(
    "a09_metrics_by_horizon",
    f"""
    SELECT model, metric, horizon_step, count(DISTINCT series_id) AS n_series, count(*) AS n_forecasts, {METRICS_SQL}
    FROM q_predictions GROUP BY model, metric, horizon_step
    """,
    rounded=SCORES,
)
def a09(d: DriverTables):
    return comparison.metrics_by_horizon(d.predictions)


@query(
    "a10_model_summary",
    f"""
    SELECT model, 'overall' AS scope, 'all' AS metric, count(DISTINCT series_id) AS n_series, count(*) AS n_forecasts, {METRICS_SQL}
    FROM q_predictions GROUP BY model
    UNION ALL
    SELECT model, 'metric', metric, count(DISTINCT series_id), count(*), {METRICS_SQL} FROM q_predictions GROUP BY model, metric
    """,
    rounded=SCORES,
)
def a10(d: DriverTables):
    return comparison.model_summary(d.predictions)


@query(
    "a11_model_comparison",
    "SELECT * FROM q_comparison",
    rounded=[*SCORES, *[f"{m}_improvement_vs_baseline_pct" for m in SCORES]],
)
def a11(d: DriverTables):
    return comparison.model_comparison(d.predictions)


@query(
    "a12_mae_rmse_smape",
    f"SELECT metric, {METRICS_SQL} FROM q_naive GROUP BY metric",
    rounded=SCORES,
)
def a12(d: DriverTables):
    return comparison.metrics_by_horizon(d.naive.withColumn("horizon_step", F.lit(0))).select("metric", *SCORES)


@query("a13_series_winner", "SELECT * FROM q_winners", rounded=["best_mae", "best_rmse", "best_smape"])
def a13(d: DriverTables):
    return d.winners


WINNER_COUNTS_SQL = """
SELECT metric, model, series_count,
       CASE WHEN sum(series_count) OVER (PARTITION BY metric) > 0
            THEN series_count / sum(series_count) OVER (PARTITION BY metric) * 100.0 ELSE 0 END AS share_pct
FROM (SELECT k.metric, m.model, count(w.series_id) AS series_count
      FROM (SELECT DISTINCT metric FROM q_winners) k
      CROSS JOIN (VALUES ('seasonal_naive'), ('ets_additive_damped'), ('xgboost_pooled_recursive')) m(model)
      LEFT JOIN q_winners w ON w.metric = k.metric AND w.best_model = m.model GROUP BY k.metric, m.model)
"""


@query("a14_winner_counts", f"SELECT * FROM ({WINNER_COUNTS_SQL}) WHERE series_count > 0", rounded=["share_pct"])
def a14(d: DriverTables):
    return comparison.winner_counts(d.winners).where("series_count > 0")


@query("j10_model_order_join", WINNER_COUNTS_SQL, rounded=["share_pct"])
def j10(d: DriverTables):
    return comparison.winner_counts(d.winners)


@query(
    "w11_metric_rank",
    "SELECT model, metric, rank_mae, rank_rmse, rank_smape FROM q_comparison",
)
def w11(d: DriverTables):
    return comparison.model_comparison(d.predictions).select("model", "metric", "rank_mae", "rank_rmse", "rank_smape")


# ---- joins -------------------------------------------------------------------------------------------


@query("j03_winner_join", f"SELECT {PREDICTED}, best_model FROM q_winner_rows", rounded=["predicted"])
def j03(d: DriverTables):
    return winner_predictions(d.predictions, d.winners).select(*C.PREDICTION_COLUMNS, "best_model")


@query(
    "j04_baseline_join",
    "SELECT model, metric, mae_improvement_vs_baseline_pct FROM q_comparison",
    rounded=["mae_improvement_vs_baseline_pct"],
)
def j04(d: DriverTables):
    return comparison.model_comparison(d.predictions).select("model", "metric", "mae_improvement_vs_baseline_pct")


@query(
    "j07_actuals_join",
    "SELECT model, series_id, origin, forecast_period, horizon_step, predicted, actual FROM q_naive",
)
def j07(d: DriverTables):
    forecasts = d.naive.select("model", "series_id", "origin", "forecast_period", "horizon_step", "predicted")
    return production.attach_actuals(forecasts, d.modelled)


# ---- sets and order ------------------------------------------------------------------------------------


@query(
    "t04_model_rank_order",
    """
    SELECT *, CASE model WHEN 'seasonal_naive' THEN 0 WHEN 'ets_additive_damped' THEN 1 WHEN 'xgboost_pooled_recursive' THEN 2
              ELSE 3 END AS model_order FROM (SELECT model, series_id, origin, horizon_step FROM q_predictions)
    """,
)
def t04(d: DriverTables):
    rows = comparison.in_model_order(d.predictions).select("model", "series_id", "origin", "horizon_step")
    return rows.withColumn("model_order", comparison.model_position(F.col("model")))


@query("t05_concat_models", f"SELECT {PREDICTED} FROM q_predictions", rounded=["predicted"])
def t05(d: DriverTables):
    return d.predictions


@query(
    "t07_series_set_equality",
    """
    SELECT series_id, 'missing' AS side FROM (SELECT series_id FROM q_panel EXCEPT SELECT series_id FROM q_selected)
    UNION ALL SELECT series_id, 'extra' FROM (SELECT series_id FROM q_selected EXCEPT SELECT series_id FROM q_panel)
    """,
)
def t07(d: DriverTables):
    return checks.set_difference_table(d.stored_panel, d.selected)


@query(
    "t08_target_overlap",
    f"""
    SELECT DISTINCT forecast_period FROM q_predictions WHERE forecast_period <= DATE '{POLICY_CUTOFF}'
    INTERSECT SELECT forecast_period FROM q_predictions WHERE origin >= DATE '{POLICY_CUTOFF}' AND forecast_period > DATE '{POLICY_CUTOFF}'
    """,
)
def t08(d: DriverTables):
    selection, evaluation = policy.split_by_cutoff(d.predictions, POLICY_CUTOFF)
    return selection.select("forecast_period").intersect(evaluation.select("forecast_period"))


@query(
    "t09_dedupe",
    "SELECT DISTINCT series_id, metric, geography_level, location_id, location_name FROM q_panel",
)
def t09(d: DriverTables):
    attrs = d.panel.select("series_id", *C.SERIES_ATTRS).dropDuplicates()
    return joins.unique_side(attrs, ["series_id"], "series metadata")


# ---- checks ----------------------------------------------------------------------------------------------


@query(
    "q05_prediction_checks",
    _checks_sql(
        """SELECT CASE WHEN count(*) = 0 THEN 1 ELSE 0 END AS not_empty, count(DISTINCT model) - 1 AS single_model,
        count(*) - count(DISTINCT (series_id, origin, forecast_period, horizon_step)) AS unique_keys,
        count(*) FILTER (NOT isfinite(actual) OR NOT isfinite(predicted) OR actual IS NULL OR predicted IS NULL) AS finite_values FROM q_naive""",
        ["not_empty", "single_model", "unique_keys", "finite_values"],
    ),
)
def q05(d: DriverTables):
    return checks.prediction_checks(d.naive).drop("details")


@query(
    "q06_alignment_checks",
    _checks_sql(
        """SELECT count(*) FILTER (models <> 2 OR k <> 2) AS same_keys, count(*) FILTER (attrs > 1) AS same_metadata,
        count(*) FILTER (gap > 1e-12) AS same_actual
        FROM (SELECT count(DISTINCT model) AS models, count(*) AS k, max(actual) - min(actual) AS gap,
                     count(DISTINCT (metric, geography_level, location_id, location_name)) AS attrs
              FROM q_predictions GROUP BY series_id, origin, forecast_period, horizon_step)""",
        ["same_keys", "same_metadata", "same_actual"],
    ),
)
def q06(d: DriverTables):
    return checks.alignment_checks(d.predictions, 2).drop("details")


@query(
    "q08_backtest_completeness",
    _checks_sql(
        """SELECT count(*) FILTER (k <> 72) AS row_count, count(*) FILTER (origins <> 12) AS origin_count,
        CAST(sum(odd) AS BIGINT) AS horizon_steps, CAST(sum(bad) AS BIGINT) AS finite_values
        FROM (SELECT series_id, sum(k) AS k, count(*) AS origins, count(*) FILTER (steps <> [1, 2, 3, 4, 5, 6]) AS odd, sum(bad) AS bad
              FROM (SELECT series_id, origin, count(*) AS k, list(DISTINCT horizon_step ORDER BY horizon_step) AS steps,
                           count(*) FILTER (NOT isfinite(actual - predicted)) AS bad
                    FROM q_smoothed GROUP BY series_id, origin)
              GROUP BY series_id)""",
        ["row_count", "origin_count", "horizon_steps", "finite_values"],
    ),
)
def q08(d: DriverTables):
    return checks.backtest_checks(d.smoothed).drop("details")


PRODUCTS = ("metrics_by_origin", "metrics_by_series", "metrics_by_horizon", "model_comparison", "series_model_winners")


def _comparison_products(d: DriverTables) -> dict:
    rows = d.predictions
    return {
        "metrics_by_origin": comparison.metrics_by_origin(rows),
        "metrics_by_series": d.by_series,
        "metrics_by_horizon": comparison.metrics_by_horizon(rows),
        "model_comparison": comparison.model_comparison(rows),
        "series_model_winners": d.winners,
    }


@query(
    "q09_comparison_completeness",
    _checks_sql(
        """SELECT (SELECT max(o) - min(o) FROM (SELECT count(DISTINCT origin) AS o FROM q_predictions GROUP BY series_id)) AS equal_origins,
        m - (SELECT min(k) FROM (SELECT count(DISTINCT model) AS k FROM q_predictions
                                 GROUP BY series_id, origin, forecast_period, horizon_step)) AS models_per_observation,
        abs(r - m * s * o * h) AS combined_rows,
        abs((SELECT count(*) FROM (SELECT DISTINCT model, series_id, origin FROM q_predictions)) - m * s * o) AS metrics_by_origin_rows,
        abs((SELECT count(*) FROM q_by_series) - m * s) AS metrics_by_series_rows,
        abs((SELECT count(*) FROM (SELECT DISTINCT model, metric, horizon_step FROM q_predictions)) - m * k * h) AS metrics_by_horizon_rows,
        abs((SELECT count(*) FROM q_comparison) - m * k) AS model_comparison_rows,
        abs((SELECT count(*) FROM q_winners) - s) AS series_model_winners_rows
        FROM (SELECT count(DISTINCT model) AS m, count(DISTINCT series_id) AS s, count(DISTINCT metric) AS k,
                     count(DISTINCT horizon_step) AS h, count(*) AS r,
                     (SELECT count(DISTINCT origin) FROM q_predictions) AS o FROM q_predictions)""",
        ["equal_origins", "models_per_observation", "combined_rows", *[f"{p}_rows" for p in PRODUCTS]],
    ),
)
def q09(d: DriverTables):
    return checks.comparison_completeness(d.predictions, _comparison_products(d)).drop("details")


@query(
    "q10_forward_checks",
    _checks_sql(
        """SELECT count(*) - count(DISTINCT (series_id, forecast_period)) AS unique_keys,
        count(*) FILTER (NOT isfinite(predicted)) AS finite_values,
        (SELECT count(*) FROM (SELECT count(*) AS k FROM q_forward GROUP BY series_id) WHERE k <> 6) AS full_horizon,
        (SELECT count(*) FROM (SELECT series_id FROM q_selected EXCEPT SELECT series_id FROM q_forward)) AS missing_series,
        (SELECT count(*) FROM (SELECT series_id FROM q_forward EXCEPT SELECT series_id FROM q_selected)) AS extra_series
        FROM q_forward""",
        ["unique_keys", "finite_values", "full_horizon", "missing_series", "extra_series"],
    ),
)
def q10(d: DriverTables):
    forecasts = smoothing.smoothing_forward(d.modelled)
    return production.forward_checks(forecasts, d.modelled).drop("details")


# ---- forward forecasts -------------------------------------------------------------------------------------

FORWARD = "model, series_id, metric, geography_level, location_id, location_name, forecast_origin, forecast_period, horizon_step, predicted"


@query(
    "m09_future_periods",
    """
    SELECT origin AS forecast_origin, CAST(h AS INTEGER) AS horizon_step, CAST(origin + to_months(CAST(h AS INTEGER)) AS DATE) AS forecast_period
    FROM (SELECT max(period_date) AS origin FROM q_selected), range(1, 7) t(h)
    """,
)
def m09(d: DriverTables):
    return seasonal_naive.future_periods(d.selected)


@query("m10_seasonal_naive_forward", f"SELECT {FORWARD} FROM q_naive_forward")
def m10(d: DriverTables):
    return seasonal_naive.naive_forward(d.modelled)


@query("m11_ets_forward", f"SELECT {FORWARD} FROM q_forward", rounded=["predicted"])
def m11(d: DriverTables):
    return smoothing.smoothing_forward(d.modelled)


@query("m11_fitted_forward", rounded=["predicted"])
def m11_fitted(d: DriverTables):
    return smoothing.smoothing_forward(d.modelled, steps=smoothing.STEPS)


WINNER_FORWARD_SQL = """
SELECT f.series_id, f.metric, f.geography_level, f.location_id, f.location_name, f.model, f.forecast_origin, f.forecast_period,
       f.horizon_step, f.predicted, w.best_mae AS backtest_mae, w.best_rmse AS backtest_rmse, w.best_smape AS backtest_smape
FROM (SELECT * FROM q_forward UNION ALL SELECT * FROM q_naive_forward) f JOIN q_winners w ON w.series_id = f.series_id
WHERE f.model = w.best_model
"""
BACKTEST = ["backtest_mae", "backtest_rmse", "backtest_smape"]


@query("m14_winner_forward", WINNER_FORWARD_SQL, rounded=["predicted", *BACKTEST])
def m14(d: DriverTables):
    history = d.modelled
    both = seasonal_naive.naive_forward(history).unionByName(smoothing.smoothing_forward(history))
    return production.winner_forward(both, d.winners)


PRODUCTION_SQL = """
SELECT f.series_id, f.metric, f.geography_level, f.location_id, f.location_name, f.model, f.forecast_origin, f.forecast_period,
       f.horizon_step, f.predicted, b.mae AS backtest_mae, b.rmse AS backtest_rmse, b.smape AS backtest_smape,
       'fixed_ets_v1' AS forecast_policy
FROM q_forward f JOIN q_by_series b ON b.series_id = f.series_id AND b.model = f.model
"""


@query("m15_production_forward", PRODUCTION_SQL, rounded=["predicted", *BACKTEST])
def m15(d: DriverTables):
    by_series = comparison.metrics_by_series(smoothing.smoothing_backtest(d.modelled))
    return production.production_forward(d.modelled, by_series)


@query(
    "m16_forecast_vs_latest",
    """
    SELECT f.series_id, f.forecast_period, f.horizon_step, f.predicted, l.value AS latest_value,
           CASE WHEN l.value <> 0 THEN (f.predicted / l.value - 1) * 100.0 END AS change_vs_latest_pct
    FROM q_forward f JOIN q_placed l ON l.series_id = f.series_id AND l.place = l.n
    UNION ALL
    SELECT series_id, period_date, 0, value, value, NULL FROM q_placed WHERE place = n
    """,
    rounded=["predicted", "change_vs_latest_pct"],
)
def m16(d: DriverTables):
    history = d.modelled
    return production.forecast_against_latest(durable(smoothing.smoothing_forward(history), "forward"), history)


@query(
    "m17_latest_backtest",
    """
    SELECT series_id, origin, forecast_period, horizon_step, model, actual, predicted FROM q_winner_rows
    QUALIFY origin = max(origin) OVER (PARTITION BY series_id)
    """,
    rounded=["predicted"],
)
def m17(d: DriverTables):
    return production.latest_backtest(winner_predictions(d.predictions, d.winners))


@query(
    "m18_winner_headline",
    "SELECT metric, model AS best_model, mae AS best_mae FROM q_comparison QUALIFY row_number() OVER (PARTITION BY metric ORDER BY rank_mae, mae) = 1",
    rounded=["best_mae"],
)
def m18(d: DriverTables):
    return comparison.headline_winner(comparison.model_comparison(d.predictions))


# ---- policies ------------------------------------------------------------------------------------------------

SELECTION_SQL = f"SELECT * FROM q_predictions WHERE forecast_period <= DATE '{POLICY_CUTOFF}'"
EVALUATION_SQL = f"SELECT * FROM q_predictions WHERE origin >= DATE '{POLICY_CUTOFF}' AND forecast_period > DATE '{POLICY_CUTOFF}'"
CHOSEN_SQL = f"""
SELECT series_id, model, smape AS selection_smape
FROM (SELECT series_id, model, {METRICS_SQL} FROM ({SELECTION_SQL}) GROUP BY series_id, model)
QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY smape, model) = 1
"""


@query(
    "v01_cutoff_split",
    f"""
    SELECT s.*, e.*, 0::BIGINT AS target_overlap,
           (SELECT count(*) > 0 FROM q_predictions WHERE origin = DATE '{POLICY_CUTOFF}') AS cutoff_is_origin
    FROM (SELECT count(*) AS selection_rows, min(forecast_period) AS selection_start, max(forecast_period) AS selection_end
          FROM ({SELECTION_SQL})) s,
         (SELECT count(*) AS evaluation_rows, min(forecast_period) AS evaluation_start, max(forecast_period) AS evaluation_end
          FROM ({EVALUATION_SQL})) e
    """,
)
def v01(d: DriverTables):
    return policy.cutoff_facts(d.predictions, POLICY_CUTOFF)


@query("v02_selection_winners", CHOSEN_SQL, rounded=["selection_smape"])
def v02(d: DriverTables):
    selection, _ = policy.split_by_cutoff(d.predictions, POLICY_CUTOFF)
    return policy.selection_winners(selection)


@query(
    "v03_evaluate_policies",
    f"""
    SELECT scope, policy, count(DISTINCT series_id) AS n_series, count(*) AS n_forecasts, {SMAPE_SQL}
    FROM (
      SELECT unnest(['all', metric]) AS scope, policy, series_id, actual, predicted
      FROM (SELECT *, 'fixed_' || model AS policy FROM ({EVALUATION_SQL})
            UNION ALL
            SELECT e.*, 'per_series_selection' FROM ({EVALUATION_SQL}) e JOIN ({CHOSEN_SQL}) c
              ON c.series_id = e.series_id AND c.model = e.model)
    )
    GROUP BY scope, policy
    """,
    rounded=["smape"],
)
def v03(d: DriverTables):
    selection, evaluation = policy.split_by_cutoff(d.predictions, POLICY_CUTOFF)
    return policy.evaluate_policies(evaluation, policy.selection_winners(selection))
