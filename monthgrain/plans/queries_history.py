"""Coverage, descriptive summaries, windows, checks and reconciliation (families A01-A06, A15, A16, A20, W, D, Q, X)."""

from __future__ import annotations

from pyspark.sql import functions as F

from monthgrain import contracts as C
from monthgrain.functions.frames import by_month, full_mean, months_back
from monthgrain.functions.scoring import percent_change
from monthgrain.operators import checks, features, historical_anomalies, joins, panel, quality, reconcile, splits, summaries
from monthgrain.plans.catalogue import query
from monthgrain.plans.driver_tables import DriverTables
from monthgrain.session import durable

ATTRS = "series_id, metric, geography_level, location_id, location_name"


# ---- coverage and quality -----------------------------------------------------------------------


@query(
    "a01_series_catalog",
    """
    SELECT series_id, geography_level, location_id, location_name, metric, start_period, end_period, n_observations,
           expected_observations, missing_months, null_values, completeness_rate, continuous_start, continuous_months,
           eligible_for_forecasting FROM q_catalog
    """,
    rounded=["completeness_rate"],
)
def a01(d: DriverTables):
    return quality.series_catalog(d.panel)


@query(
    "a02_quality_summary",
    """
    SELECT series_id, metric, duplicate_periods, null_values, negative_values, zero_values, source_snapshot_provisional, status
    FROM q_quality
    """,
)
def a02(d: DriverTables):
    return quality.quality_summary(d.panel)


SPREAD_SQL = """avg({v}) AS {p}mean{s}, median({v}) AS {p}median{s}, stddev_samp({v}) AS {p}std{s}, min({v}) AS {p}minimum{s},
max({v}) AS {p}maximum{s}"""


@query(
    "a03_historical_summary",
    f"""
    SELECT * EXCLUDE (year_before),  latest_value - year_before AS change_12m,
           CASE WHEN year_before <> 0 THEN (latest_value - year_before) / year_before * 100.0 END AS pct_change_12m
    FROM (
      SELECT {ATTRS}, min(period_date) AS start_period, max(period_date) AS end_period, count(*) AS n_observations,
             {SPREAD_SQL.format(v="value", p="", s="")}, arg_max(value, period_date) AS latest_value,
             arg_max(step, period_date) AS change_1m, arg_max(before, period_date) AS year_before,
             avg(step) AS mean_monthly_change, stddev_samp(step) AS std_monthly_change
      FROM (SELECT *, value - lag(value) OVER w AS step, lag(value, 12) OVER w AS before FROM q_panel
            WINDOW w AS (PARTITION BY series_id ORDER BY period_date))
      GROUP BY ALL
    )
    """,
    rounded=["mean", "median", "std", "change_1m", "change_12m", "pct_change_12m", "mean_monthly_change", "std_monthly_change"],
)
def a03(d: DriverTables):
    return summaries.historical_summary(d.panel)


@query(
    "a04_monthly_seasonality",
    f"""
    SELECT {ATTRS}, CAST(month(period_date) AS INTEGER) AS month, {SPREAD_SQL.format(v="value", p="", s="_value")},
           count(value) AS n_observations FROM q_panel GROUP BY ALL
    """,
    rounded=["mean_value", "median_value", "std_value"],
)
def a04(d: DriverTables):
    return summaries.monthly_seasonality(d.panel)


@query(
    "a05_recent_history",
    f"""
    SELECT {ATTRS}, min(period_date) AS recent_start_period, max(period_date) AS recent_end_period,
           count(*) AS recent_observations, {SPREAD_SQL.format(v="value", p="recent_", s="")}
    FROM (SELECT * FROM q_panel QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY period_date DESC) <= 24)
    GROUP BY ALL
    """,
    rounded=["recent_mean", "recent_median", "recent_std"],
)
def a05(d: DriverTables):
    return summaries.recent_history(d.panel)


@query(
    "a06_modelling_readiness",
    """
    SELECT n > 0 AND shortest >= 77 AND shortest > 12 AND both_ok = n AS dataset_ready, n_series, complete_series,
           n AS forecast_eligible_series, quality_pass_series, both_ok AS eligible_quality_pass_series, minimum_observations,
           shortest AS minimum_eligible_continuous_months, start_period, end_period, 6 AS forecast_horizon,
           12 AS seasonal_period, 12 AS rolling_origins, 60 AS minimum_history_months, 77 AS required_continuous_months,
           n > 0 AND shortest >= 77 AS rolling_origin_ready, n > 0 AND shortest > 12 AS feature_history_ready
    FROM (
      SELECT count(*) AS n_series, count(*) FILTER (missing_months = 0) AS complete_series,
             count(*) FILTER (eligible_for_forecasting) AS n, count(*) FILTER (q.status = 'PASS') AS quality_pass_series,
             count(*) FILTER (eligible_for_forecasting AND q.status = 'PASS') AS both_ok,
             min(n_observations) AS minimum_observations,
             coalesce(min(continuous_months) FILTER (eligible_for_forecasting), 0) AS shortest,
             min(start_period) AS start_period, max(end_period) AS end_period
      FROM q_catalog JOIN q_quality q USING (series_id)
    )
    """,
)
def a06(d: DriverTables):
    p = d.stored_panel
    return quality.modelling_readiness(p, quality.series_catalog(p), quality.quality_summary(p))


@query(
    "a20_catalog_histogram",
    """
    SELECT 'n_observations' AS measure, CAST(n_observations AS DOUBLE) AS level, count(*) AS n_series FROM q_catalog GROUP BY ALL
    UNION ALL SELECT 'completeness_rate', completeness_rate, count(*) FROM q_catalog GROUP BY ALL
    """,
    rounded=["level"],
)
def a20(d: DriverTables):
    parts = []
    for column in ("n_observations", "completeness_rate"):
        rows = quality.catalog_histogram(d.catalog, column)
        parts.append(rows.select(F.lit(column).alias("measure"), F.col(column).cast("double").alias("level"), "n_series"))
    return parts[0].unionByName(parts[1])


@query(
    "a15_annual_averages",
    f"""
    SELECT {ATTRS}, year, average, months, CASE WHEN months >= 12 THEN 'Full year' ELSE 'Partial year' END AS coverage,
           CASE WHEN months >= 12 AND lag(months) OVER w >= 12 THEN (average / lag(average) OVER w - 1) * 100.0 END AS yoy_pct
    FROM (SELECT {ATTRS}, CAST(year(period_date) AS INTEGER) AS year, avg(value) AS average, count(*) AS months
          FROM q_panel GROUP BY ALL)
    WINDOW w AS (PARTITION BY series_id ORDER BY year)
    """,
    rounded=["average", "yoy_pct"],
)
def a15(d: DriverTables):
    return summaries.annual_averages(d.panel)


@query(
    "a16_period_kpis",
    f"""
    SELECT {ATTRS}, latest_date, latest_value,
           CASE WHEN before <> 0 THEN (latest_value - before) / before * 100.0 END AS mom_change,
           CASE WHEN year_ago <> 0 THEN (latest_value - year_ago) / year_ago * 100.0 END AS yoy_change, period_average,
           CASE WHEN first_value <> 0 THEN (latest_value - first_value) / first_value * 100.0 END AS period_change,
           minimum_value, minimum_date, maximum_value, maximum_date
    FROM (
      SELECT {ATTRS}, max(period_date) AS latest_date, arg_max(value, period_date) AS latest_value,
             arg_max(before, period_date) FILTER (newest) AS before, max(year_ago) FILTER (newest) AS year_ago,
             avg(value) AS period_average, arg_min(value, period_date) AS first_value, min(value) AS minimum_value,
             min(period_date) FILTER (value = lowest) AS minimum_date, max(value) AS maximum_value,
             min(period_date) FILTER (value = highest) AS maximum_date
      FROM (
        SELECT a.*, lag(a.value) OVER (PARTITION BY a.series_id ORDER BY a.period_date) AS before, b.value AS year_ago,
               min(a.value) OVER (PARTITION BY a.series_id) AS lowest, max(a.value) OVER (PARTITION BY a.series_id) AS highest,
               a.period_date = max(a.period_date) OVER (PARTITION BY a.series_id) AS newest
        FROM q_panel a LEFT JOIN q_panel b ON a.series_id = b.series_id
             AND b.period_date = CAST(a.period_date - INTERVAL 12 MONTH AS DATE)
      ) GROUP BY ALL
    )
    """,
    rounded=["mom_change", "yoy_change", "period_average", "period_change"],
)
def a16(d: DriverTables):
    return summaries.period_kpis(d.panel)


# ---- windows -------------------------------------------------------------------------------------

LAGS_SQL = ", ".join(f"lag(value, {k}) OVER w AS lag_{k}" for k in C.LAGS)
ROLL_SQL = ", ".join(
    f"CASE WHEN count(value) OVER r{k} = {k} THEN avg(value) OVER r{k} END AS rolling_mean_{k}" for k in C.ROLLING_WINDOWS
)
ROLL_WINDOWS = ", ".join(
    f"r{k} AS (PARTITION BY series_id ORDER BY period_date ROWS BETWEEN {k} PRECEDING AND 1 PRECEDING)" for k in C.ROLLING_WINDOWS
)
W_SQL = "w AS (PARTITION BY series_id ORDER BY period_date)"
ROLLED = [f"rolling_mean_{k}" for k in C.ROLLING_WINDOWS]


@query("w01_lag_features", f"SELECT series_id, period_date, value, {LAGS_SQL} FROM q_panel WINDOW {W_SQL}")
def w01(d: DriverTables):
    return features.lag_features(d.panel.select("series_id", "period_date", "value"))


@query(
    "w02_rolling_features",
    f"SELECT series_id, period_date, value, {ROLL_SQL} FROM q_panel WINDOW {ROLL_WINDOWS}",
    rounded=ROLLED,
)
def w02(d: DriverTables):
    return features.rolling_features(d.panel.select("series_id", "period_date", "value"))


PARTS_SQL = """CAST(month(period_date) AS INTEGER) AS month, CAST(quarter(period_date) AS INTEGER) AS quarter,
CAST(year(period_date) AS INTEGER) AS year"""


@query(
    "w03_feature_frame",
    f"SELECT series_id, period_date, value, {PARTS_SQL}, {LAGS_SQL}, {ROLL_SQL} FROM q_panel WINDOW {W_SQL}, {ROLL_WINDOWS}",
    rounded=ROLLED,
)
def w03(d: DriverTables):
    return features.feature_frame(d.panel.select("series_id", "period_date", "value"))


@query(
    "w04_rolling_12m_mean",
    """
    SELECT series_id, period_date, CASE WHEN count(value) OVER f = 12 THEN avg(value) OVER f END AS rolling_12m FROM q_panel
    WINDOW f AS (PARTITION BY series_id ORDER BY period_date ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)
    """,
    rounded=["rolling_12m"],
)
def w04(d: DriverTables):
    return d.panel.select(
        "series_id", "period_date", full_mean(F.col("value"), by_month(), -11, 0).alias("rolling_12m")
    )


@query(
    "w05_mom_pct",
    f"""
    SELECT series_id, period_date, CASE WHEN lag(value) OVER w <> 0 THEN (value / lag(value) OVER w - 1) * 100.0 END AS mom_pct
    FROM q_panel WINDOW {W_SQL}
    """,
    rounded=["mom_pct"],
)
def w05(d: DriverTables):
    change = percent_change(F.col("value"), F.lag("value", 1).over(by_month()))
    return d.panel.select("series_id", "period_date", change.alias("mom_pct"))


YEAR_AGO_SQL = """q_panel a LEFT JOIN q_panel b ON a.series_id = b.series_id
AND b.period_date = CAST(a.period_date - INTERVAL 12 MONTH AS DATE)"""


@query(
    "w06_yoy_pct",
    f"SELECT a.series_id, a.period_date, CASE WHEN b.value <> 0 THEN (a.value / b.value - 1) * 100.0 END AS yoy_pct FROM {YEAR_AGO_SQL}",
    rounded=["yoy_pct"],
)
def w06(d: DriverTables):
    change = percent_change(F.col("value"), F.max("value").over(months_back(12)))
    return d.panel.select("series_id", "period_date", change.alias("yoy_pct"))


for _name, _column in (
    ("w07_rolling_median", "historical_change_expected"),
    ("w08_rolling_mad", "historical_mad"),
    ("w09_rolling_iqr", "historical_iqr"),
):

    @query(_name, f"SELECT series_id, period_date, {_column} FROM q_detected", rounded=[_column])
    def _rolling(d: DriverTables, column: str = _column):
        return historical_anomalies.detect_historical(d.panel).select("series_id", "period_date", column)


@query(
    "w12_seasonal_difference",
    f"SELECT series_id, period_date, lag(value, 12) OVER w AS seasonal_reference, value - lag(value, 12) OVER w AS seasonal_change FROM q_panel WINDOW {W_SQL}",
)
def w12(d: DriverTables):
    return historical_anomalies.seasonal_difference(d.panel).select(
        "series_id", "period_date", "seasonal_reference", "seasonal_change"
    )


@query("w13_trailing_run", "SELECT series_id, continuous_start, continuous_months FROM q_catalog")
def w13(d: DriverTables):
    return quality.series_catalog(d.panel).select("series_id", "continuous_start", "continuous_months")


@query(
    "w14_last_rows",
    "SELECT series_id, period_date, value FROM q_panel QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY period_date DESC) <= 24",
)
def w14(d: DriverTables):
    return summaries.last_rows(d.panel.select("series_id", "period_date", "value"), 24)


# ---- descriptive products -------------------------------------------------------------------------


@query(
    "d01_annualised_growth",
    f"""
    SELECT {ATTRS}, growth_basis, growth_start, growth_end,
           CASE WHEN years >= 1 AND a > 0 AND b > 0 THEN (pow(b / a, 1.0 / years) - 1) * 100.0 END AS annualised_growth
    FROM (
      SELECT *, datediff('day', growth_start, growth_end) / 365.25 AS years
      FROM (
        SELECT {ATTRS}, CASE WHEN k >= 2 THEN '12-month averages' ELSE 'monthly values' END AS growth_basis,
               CASE WHEN k >= 2 THEN s0 ELSE p0 END AS growth_start, CASE WHEN k >= 2 THEN s1 ELSE p1 END AS growth_end,
               CASE WHEN k >= 2 THEN r0 ELSE v0 END AS a, CASE WHEN k >= 2 THEN r1 ELSE v1 END AS b
        FROM (
          SELECT {ATTRS}, count(r) AS k, min(period_date) FILTER (r IS NOT NULL) AS s0, max(period_date) FILTER (r IS NOT NULL) AS s1,
                 arg_min(r, period_date) FILTER (r IS NOT NULL) AS r0, arg_max(r, period_date) FILTER (r IS NOT NULL) AS r1,
                 min(period_date) AS p0, max(period_date) AS p1, arg_min(value, period_date) AS v0, arg_max(value, period_date) AS v1
          FROM (SELECT *, CASE WHEN count(value) OVER f = 12 THEN avg(value) OVER f END AS r FROM q_panel
                WINDOW f AS (PARTITION BY series_id ORDER BY period_date ROWS BETWEEN 11 PRECEDING AND CURRENT ROW))
          GROUP BY ALL
        )
      )
    )
    """,
    rounded=["annualised_growth"],
)
def d01(d: DriverTables):
    return summaries.annualised_growth(d.panel)


@query(
    "d02_seasonal_profile",
    f"""
    SELECT {ATTRS}, month, median_value, seasonal_mean, peak_month, low_month,
           CASE WHEN seasonal_mean <> 0 THEN (peak - low) / seasonal_mean * 100.0 END AS spread_pct,
           CASE WHEN seasonal_mean <> 0 THEN (median_value / seasonal_mean - 1) * 100.0 END AS deviation_pct
    FROM (
      SELECT *, avg(median_value) OVER s AS seasonal_mean, max(median_value) OVER s AS peak, min(median_value) OVER s AS low,
             first(month) OVER (PARTITION BY series_id ORDER BY median_value DESC, month) AS peak_month,
             first(month) OVER (PARTITION BY series_id ORDER BY median_value, month) AS low_month
      FROM (SELECT {ATTRS}, CAST(month(period_date) AS INTEGER) AS month, median(value) AS median_value FROM q_panel GROUP BY ALL)
      WINDOW s AS (PARTITION BY series_id)
    )
    """,
    rounded=["median_value", "seasonal_mean", "spread_pct", "deviation_pct"],
)
def d02(d: DriverTables):
    return summaries.seasonal_profile(summaries.monthly_seasonality(d.stored_panel))


@query(
    "d03_history_table",
    f"""
    SELECT a.series_id, a.period_date, a.value,
           (a.value / lag(a.value) OVER (PARTITION BY a.series_id ORDER BY a.period_date) - 1) * 100.0 AS mom_pct,
           (a.value / b.value - 1) * 100.0 AS yoy_pct
    FROM {YEAR_AGO_SQL} ORDER BY a.period_date DESC, a.series_id
    """,
    rounded=["mom_pct", "yoy_pct"],
)
def d03(d: DriverTables):
    return summaries.history_table(d.panel)


# ---- joins on the panel -----------------------------------------------------------------------------


@query(
    "j01_assert_join",
    "SELECT p.series_id, p.period_date, p.value, q.status FROM q_panel p JOIN q_quality q USING (series_id)",
)
def j01(d: DriverTables):
    p = d.stored_panel
    status = quality.quality_summary(p).select("series_id", "status")
    return joins.checked_join(p.select("series_id", "period_date", "value"), status, ["series_id"], what="quality summary")


@query(
    "j02_catalog_join",
    """
    SELECT p.series_id, p.period_date, p.value, c.continuous_start FROM q_panel p JOIN q_catalog c USING (series_id)
    WHERE p.period_date >= c.continuous_start
    """,
)
def j02(d: DriverTables):
    start = d.catalog.select("series_id", "continuous_start")
    rows = d.stored_panel.select("series_id", "period_date", "value")
    return joins.checked_join(rows, start, ["series_id"], what="catalog").where("period_date >= continuous_start")


@query(
    "j06_year_ago_join",
    f"SELECT a.series_id, a.period_date, a.value, b.value AS value_year_ago FROM {YEAR_AGO_SQL}",
)
def j06(d: DriverTables):
    return summaries.year_ago_by_join(d.stored_panel.select("series_id", "period_date", "value"))


# ---- checks -------------------------------------------------------------------------------------------


def _checks_sql(totals: str, names: list[str]) -> str:
    """Check rows of a one-row relation of violation counts, without the prose column."""
    parts = [
        f"SELECT '{n}' AS check_name, {n} = 0 AS passed, CAST({n} AS BIGINT) AS observed, CAST(0 AS BIGINT) AS expected FROM totals"
        for n in names
    ]
    return f"SELECT * FROM (WITH totals AS ({totals}) " + " UNION ALL ".join(parts) + ")"


@query(
    "q04_panel_checks",
    _checks_sql(
        """SELECT count(*) FILTER (metric NOT IN ('median_rent', 'bonds_lodged')) AS known_metrics,
        (SELECT coalesce(sum(k), 0) FROM (SELECT count(*) AS k FROM q_panel GROUP BY series_id, period_date) WHERE k > 1) AS unique_series_period,
        count(*) FILTER (period_date IS NULL) AS dated_rows, count(*) FILTER (day(period_date) <> 1) AS month_starts FROM q_panel""",
        ["known_metrics", "unique_series_period", "dated_rows", "month_starts"],
    ),
)
def q04(d: DriverTables):
    return panel.panel_checks(d.panel).drop("details")


@query(
    "q13_continuity_check",
    """
    SELECT *, expected_months = observed_months AS continuous
    FROM (SELECT series_id, datediff('month', min(period_date), max(period_date)) + 1 AS expected_months,
                 count(DISTINCT period_date) AS observed_months FROM q_panel GROUP BY series_id)
    """,
)
def q13(d: DriverTables):
    return checks.continuity_checks(d.panel)


@query(
    "q14_common_origin_check",
    """
    SELECT min(e) AS earliest_end, max(e) AS latest_end, count(*) AS n_series, min(e) = max(e) AS common_origin
    FROM (SELECT series_id, max(period_date) AS e FROM q_selected GROUP BY series_id)
    """,
)
def q14(d: DriverTables):
    return checks.common_origin_checks(d.selected)


# ---- selection and splits --------------------------------------------------------------------------------


@query("m01_select_forecasting_series", "SELECT series_id, metric, period_date, value FROM q_selected")
def m01(d: DriverTables):
    panel = splits.complete_months(d.stored_panel, d.complete_before)
    chosen = splits.select_series(panel, quality.series_catalog(panel))
    return chosen.select("series_id", "metric", "period_date", "value")


@query("m02_rolling_origins", "SELECT * FROM q_origins")
def m02(d: DriverTables):
    return splits.rolling_origins(d.selected)


@query(
    "m03_slice_origin",
    """
    SELECT p.series_id, o.origin, CASE WHEN p.period_date <= o.origin THEN 'train' ELSE 'test' END AS part, p.period_date, p.value
    FROM q_selected p JOIN q_origins o ON o.series_id = p.series_id AND p.period_date <= o.test_end
    """,
)
def m03(d: DriverTables):
    return splits.slice_origins(d.modelled, splits.rolling_origins(d.modelled))


@query(
    "m07_pooled_training_frame",
    f"""
    SELECT * FROM (
      SELECT series_id, metric, period_date, value, {PARTS_SQL}, {LAGS_SQL}, {ROLL_SQL},
             concat(geography_level, '_', location_id) AS location_key
      FROM q_selected WINDOW {W_SQL}, {ROLL_WINDOWS}
    ) WHERE lag_12 IS NOT NULL AND rolling_mean_12 IS NOT NULL
    """,
    rounded=ROLLED,
)
def m07(d: DriverTables):
    return features.pooled_training_frame(d.selected).select(
        "series_id", "metric", "period_date", "value", *features.BASE_FEATURES, "location_key"
    )


# ---- reconciliation -----------------------------------------------------------------------------------------

COMMON_SQL = """SELECT max(m.period_start) AS period_date FROM (SELECT DISTINCT period_start FROM q_market WHERE area_name NOT IN ('ALL', 'NA')) m
JOIN (SELECT DISTINCT period_date FROM q_clean WHERE geography_level = 'region' AND location_id NOT IN (-99, -1)) r
  ON m.period_start = r.period_date"""
SIDES_SQL = f"""
SELECT m.area_name AS region, m.median_rent AS market_median_rent, r.median_rent AS rental_median_rent,
       m.bonds_lodged AS market_bonds_lodged, r.bonds_lodged AS rental_bonds_lodged
FROM (SELECT * FROM q_market WHERE area_name NOT IN ('ALL', 'NA') AND period_start = ({COMMON_SQL})) m
JOIN (SELECT * FROM q_clean WHERE geography_level = 'region' AND location_id NOT IN (-99, -1) AND period_date = ({COMMON_SQL})) r
  ON m.area_name = r.location_name
"""
COMPARED_SQL = f"""
SELECT region, market_median_rent, rental_median_rent, market_median_rent - rental_median_rent AS median_rent_difference,
       CASE WHEN abs(market_median_rent - rental_median_rent) <= 20 THEN 'PASS' ELSE 'WARN' END AS median_rent_status,
       market_bonds_lodged, rental_bonds_lodged, market_bonds_lodged - rental_bonds_lodged AS bonds_lodged_difference,
       CASE WHEN rental_bonds_lodged <> 0
            THEN (market_bonds_lodged - rental_bonds_lodged) / rental_bonds_lodged * 100.0 END AS bonds_lodged_difference_pct,
       CASE WHEN rental_bonds_lodged <> 0 AND abs((market_bonds_lodged - rental_bonds_lodged) / rental_bonds_lodged * 100.0) <= 20
            THEN 'PASS' ELSE 'WARN' END AS bonds_lodged_status
FROM ({SIDES_SQL})
"""


def _sides(d: DriverTables):
    """Both sources at the newest common month, each derived and written once."""
    market, bonds = durable(d.market, "market"), durable(d.clean, "clean")
    return reconcile.at_period(market, bonds, reconcile.latest_common_period(market, bonds))


@query("x01_latest_common_period", COMMON_SQL)
def x01(d: DriverTables):
    return reconcile.latest_common_period(d.market, d.clean)


@query(
    "j08_common_period_join",
    """
    SELECT DISTINCT m.period_start AS period_date FROM q_market m JOIN q_clean r ON m.period_start = r.period_date
    WHERE m.area_name NOT IN ('ALL', 'NA') AND r.geography_level = 'region' AND r.location_id NOT IN (-99, -1)
    """,
)
def j08(d: DriverTables):
    left = reconcile.market_region_rows(d.market).select(F.col("period_start").alias("period_date"))
    return left.intersect(reconcile.bond_region_rows(d.clean).select("period_date"))


@query("j09_region_match", f"SELECT region, 'matched' AS match FROM ({SIDES_SQL})")
def j09(d: DriverTables):
    return reconcile.match_regions(*_sides(d)).select("region", "match")


@query("x02_compare_sources", COMPARED_SQL, rounded=["median_rent_difference", "bonds_lodged_difference_pct"])
def x02(d: DriverTables):
    return reconcile.compare_sources(*_sides(d))


@query(
    "x03_cross_source_verdict",
    f"""
    SELECT count(*) AS market_region_count, count(*) AS rental_region_count, count(*) AS matched_region_count,
           CAST(0 AS BIGINT) AS missing_in_market, CAST(0 AS BIGINT) AS missing_in_rental,
           count(*) FILTER (median_rent_status = 'PASS') AS median_pass_count,
           count(*) FILTER (median_rent_status = 'WARN') AS median_warn_count,
           count(*) FILTER (bonds_lodged_status = 'PASS') AS bonds_pass_count,
           count(*) FILTER (bonds_lodged_status = 'WARN') AS bonds_warn_count,
           CASE WHEN count(*) FILTER (median_rent_status = 'WARN' OR bonds_lodged_status = 'WARN') > 0 THEN 'WARN' ELSE 'PASS' END
             AS overall_status
    FROM ({COMPARED_SQL})
    """,
)
def x03(d: DriverTables):
    return reconcile.cross_source_verdict(*_sides(d))

