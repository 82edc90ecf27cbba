"""Row-wise projections, filters and simple reshapes (families P, F, T, R, S08, S12)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from monthgrain import contracts as C
from monthgrain.functions import parsing, scoring
from monthgrain.operators import consolidation, evaluation, features, joins, panel, reconcile, summaries
from monthgrain.plans.catalogue import query
from monthgrain.plans.driver_tables import TRANSITION, DriverTables
from monthgrain.plans.oracle import sql_list
from monthgrain.sources import bond

PANEL_FIELDS = "period_date, series_id, geography_level, location_id, location_name, metric, value, source_snapshot_provisional, source_snapshot_id"


# ---- scans and projections -----------------------------------------------------------------


@query(
    "s08_table_projection_scan",
    "SELECT period_date, geography_level, location_id, location_name, median_rent, bonds_lodged, is_provisional, source_snapshot_id FROM q_clean",
)
def s08(d: DriverTables):
    return d.clean.select(
        "period_date", "geography_level", "location_id", "location_name", *C.METRICS, "is_provisional", "source_snapshot_id"
    )


@query(
    "s12_export_rounded",
    """
    SELECT series_id, strftime(period_date, '%Y-%m') AS period, round(value, 2) AS value, round(mom, 2) AS month_on_month_pct,
           round(yoy, 2) AS year_on_year_pct
    FROM (SELECT a.*, (a.value / lag(a.value) OVER (PARTITION BY a.series_id ORDER BY a.period_date) - 1) * 100.0 AS mom,
                 (a.value / b.value - 1) * 100.0 AS yoy
          FROM q_panel a LEFT JOIN q_panel b ON a.series_id = b.series_id
               AND b.period_date = CAST(a.period_date - INTERVAL 12 MONTH AS DATE))
    """,
)
def s12(d: DriverTables):
    return summaries.export_rounded(d.panel)


@query(
    "p01_parse_dmy_month",
    """
    SELECT o_orderkey, time_frame, CASE WHEN day(strptime(time_frame, '%d/%m/%Y')) = 1
           THEN CAST(strptime(time_frame, '%d/%m/%Y') AS DATE) END AS period_date
    FROM (SELECT o_orderkey, strftime(o_orderdate, '%-d/%m/%Y') AS time_frame FROM orders)
    """,
)
def p01(d: DriverTables):
    text = d.table("orders").select("o_orderkey", F.date_format("o_orderdate", "d/MM/yyyy").alias("time_frame"))
    return text.withColumn("period_date", parsing.month_from_dmy(F.col("time_frame")))


@query(
    "p02_parse_period_range",
    """
    SELECT o_orderkey, period_covered, CASE WHEN a <= b THEN a END AS period_start, CASE WHEN a <= b THEN b END AS period_end
    FROM (
      SELECT *, CAST(strptime(split_part(period_covered, '/', 1), '%Y-%m-%d') AS DATE) AS a,
             CAST(strptime(split_part(period_covered, '/', 2), '%Y-%m-%d') AS DATE) AS b
      FROM (
        SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN hi || '/' || lo ELSE lo || '/' || hi END AS period_covered
        FROM (SELECT *, strftime(o_orderdate, '%Y-%-m-%-d') AS lo, strftime(last_day(o_orderdate), '%Y-%-m-%-d') AS hi FROM orders)
      )
    )
    """,
)
def p02(d: DriverTables):
    day = F.col("o_orderdate").cast("date")
    lo, hi = F.date_format(day, "yyyy-M-d"), F.date_format(F.last_day(day), "yyyy-M-d")
    text = F.when(F.col("o_orderstatus") == "F", F.concat_ws("/", hi, lo)).otherwise(F.concat_ws("/", lo, hi))
    rows = d.table("orders").select("o_orderkey", text.alias("period_covered"))
    return rows.withColumn("_r", parsing.period_range(F.col("period_covered"))).select(
        "o_orderkey", "period_covered", "_r.period_start", "_r.period_end"
    )


@query(
    "p03_bond_column_map",
    """
    SELECT period_date, 'region' AS geography_level, location_id, location_name, bonds_lodged, bonds_lodged * 3 AS active_bonds,
           bonds_lodged // 2 AS bonds_closed, CAST(floor(median_rent) AS BIGINT) AS median_rent,
           CAST(floor(median_rent) AS BIGINT) - 1 AS geometric_mean_rent, CAST(floor(median_rent) AS BIGINT) + 50 AS upper_quartile_rent,
           CAST(floor(median_rent) AS BIGINT) - 50 AS lower_quartile_rent, 0.5::DOUBLE AS log_std_dev_weekly_rent,
           'region_20010801.csv' AS source_snapshot, '2001-08-01T00:00:00+00:00' AS retrieved_at_utc, true AS is_provisional
    FROM q_clean WHERE geography_level = 'region'
    """,
)
def p03(d: DriverTables):
    return bond.map_bond_columns(
        d.raw_bonds(d.clean.where(F.col("geography_level") == C.LEVEL_REGION)),
        dataset=C.LEVEL_REGION,
        source_snapshot="region_20010801.csv",
        retrieved_at_utc="2001-08-01T00:00:00+00:00",
        is_provisional=True,
    )


@query(
    "p05_cast_required",
    """
    SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice, CAST(l_quantity AS BIGINT) AS whole_quantity,
           CASE WHEN l_extendedprice = floor(l_extendedprice) THEN CAST(l_extendedprice AS BIGINT) END AS whole_price,
           CAST(CAST(l_extendedprice AS DECIMAL(18, 2)) AS DECIMAL(18, 4)) AS price
    FROM lineitem
    """,
)
def p05(d: DriverTables):
    text = lambda c: F.col(c).cast("decimal(18,2)").cast("string")
    return d.table("lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_quantity",
        "l_extendedprice",
        parsing.whole_number(text("l_quantity")).alias("whole_quantity"),
        parsing.whole_number(text("l_extendedprice")).alias("whole_price"),
        parsing.measure(text("l_extendedprice")).alias("price"),
    )


@query(
    "p06_cast_optional",
    """
    SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN CAST(floor(o_totalprice) AS BIGINT) END AS whole_price,
           CASE WHEN o_orderstatus = 'F' THEN CAST(CAST(o_totalprice AS DECIMAL(18, 2)) AS DECIMAL(18, 4)) END AS price
    FROM orders
    """,
)
def p06(d: DriverTables):
    status = F.col("o_orderstatus")
    whole = F.when(status != "P", F.floor("o_totalprice").cast("string"))
    price = F.when(status == "F", F.col("o_totalprice").cast("decimal(18,2)").cast("string")).when(status == "O", "n/a")
    return d.table("orders").select(
        "o_orderkey", parsing.whole_number(whole).alias("whole_price"), parsing.measure(price).alias("price")
    )


@query(
    "p07_parse_bool_text",
    "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN true WHEN 'O' THEN false END AS provisional FROM orders",
)
def p07(d: DriverTables):
    status = F.col("o_orderstatus")
    text = F.when(status == "F", " TRUE ").when(status == "O", "False").otherwise("yes")
    return d.table("orders").select("o_orderkey", parsing.flag(text).alias("provisional"))


@query(
    "p08_parse_utc",
    """
    SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' THEN CAST(epoch(o_orderdate) AS BIGINT)
                            WHEN o_orderpriority = '2-HIGH' THEN CAST(epoch(o_orderdate) AS BIGINT) - 12 * 3600 END AS retrieved_seconds
    FROM orders
    """,
)
def p08(d: DriverTables):
    priority = F.col("o_orderpriority")
    zone = F.when(priority == "1-URGENT", "Z").when(priority == "2-HIGH", "+12:00").otherwise("")
    text = F.concat(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"), zone)
    instant = parsing.zoned_instant(text)
    return d.table("orders").select("o_orderkey", F.unix_seconds(instant).alias("retrieved_seconds"))


@query(
    "p09_trim_required_text",
    "SELECT c_custkey, c_name AS location_name FROM customer WHERE c_mktsegment <> 'BUILDING'",
)
def p09(d: DriverTables):
    padded = F.when(F.col("c_mktsegment") == "BUILDING", "   ").otherwise(F.concat(F.lit("  "), F.col("c_name"), F.lit(" ")))
    named = d.table("customer").select("c_custkey", parsing.present_text(padded).alias("location_name"))
    return named.where(F.col("location_name").isNotNull())


@query("p10_series_key", "SELECT period_date, series_id, metric FROM q_panel")
def p10(d: DriverTables):
    return panel.melt_metrics(panel.core_geographies(d.clean)).select("period_date", "series_id", "metric")


@query(
    "p11_to_number_coerce",
    """
    SELECT o_orderkey, CASE WHEN o_orderpriority NOT IN ('5-LOW', '4-NOT SPECIFIED') THEN o_totalprice END AS value FROM orders
    """,
)
def p11(d: DriverTables):
    priority = F.col("o_orderpriority")
    text = (
        F.when(priority == "5-LOW", "n/a")
        .when(priority == "4-NOT SPECIFIED", "NaN")
        .otherwise(F.col("o_totalprice").cast("string"))
    )
    return d.table("orders").select("o_orderkey", parsing.number_or_null(text).alias("value"))


@query(
    "p13_calendar_parts",
    """
    SELECT series_id, period_date, CAST(month(period_date) AS INTEGER) AS month, CAST(quarter(period_date) AS INTEGER) AS quarter,
           CAST(year(period_date) AS INTEGER) AS year FROM q_panel
    """,
)
def p13(d: DriverTables):
    return features.calendar_parts(d.panel.select("series_id", "period_date"))


# ---- classification of detector rows ---------------------------------------------------------


@query(
    "p17_deviation_pct",
    """
    SELECT series_id, period_date, CASE WHEN historical_expected <> 0
           THEN historical_deviation / historical_expected * 100.0 END AS historical_deviation_pct FROM q_historical
    """,
    rounded=["historical_deviation_pct"],
)
def p17(d: DriverTables):
    pct = scoring.percent_of(F.col("historical_deviation"), F.col("historical_expected"))
    return d.historical.select("series_id", "period_date", pct.alias("historical_deviation_pct"))


@query("p18_severity_class", "SELECT series_id, period_date, historical_severity AS severity FROM q_historical")
def p18(d: DriverTables):
    return d.historical.select("series_id", "period_date", scoring.severity(F.col("historical_score")).alias("severity"))


@query("p19_direction_class", "SELECT series_id, period_date, historical_direction AS direction FROM q_historical")
def p19(d: DriverTables):
    return d.historical.select("series_id", "period_date", scoring.direction(F.col("historical_score")).alias("direction"))


@query(
    "p20_residual_direction",
    """
    SELECT model, series_id, origin, horizon_step, CASE WHEN actual > predicted THEN 'above_forecast'
           WHEN actual < predicted THEN 'below_forecast' ELSE 'on_forecast' END AS forecast_error_direction FROM q_naive
    """,
)
def p20(d: DriverTables):
    said = scoring.residual_direction(F.col("actual") - F.col("predicted"))
    return d.naive.select("model", "series_id", "origin", "horizon_step", said.alias("forecast_error_direction"))


@query(
    "p21_null_safe_bool",
    """
    SELECT h.series_id, h.period_date, n.series_id IS NOT NULL AS has_forecast_record, false AS absent_flag
    FROM q_historical h LEFT JOIN (SELECT DISTINCT series_id, forecast_period FROM q_naive) n
         ON n.series_id = h.series_id AND n.forecast_period = h.period_date
    """,
)
def p21(d: DriverTables):
    forecast = d.naive.select("series_id", F.col("forecast_period").alias("period_date")).distinct()
    rows = d.stored_panel.select("series_id", "period_date").join(
        forecast.withColumn("has_forecast_record", F.lit(True)), ["series_id", "period_date"], "left"
    )
    return rows.select(
        "series_id",
        "period_date",
        scoring.flag_or_false(rows, "has_forecast_record").alias("has_forecast_record"),
        scoring.flag_or_false(rows, "absent_flag").alias("absent_flag"),
    )


@query(
    "p22_alert_category",
    """
    SELECT series_id, period_date, CASE WHEN overall_status = 'confirmed_anomaly' THEN 'Both detectors flagged'
           WHEN overall_severity = 'high' THEN 'High' ELSE 'Moderate' END AS alert_category
    FROM q_summary WHERE overall_dashboard_alert
    """,
)
def p22(d: DriverTables):
    category = scoring.alert_category(F.col("overall_status"), F.col("overall_severity"))
    return consolidation.alert_rows(d.summary).select("series_id", "period_date", category.alias("alert_category"))


# ---- filters ---------------------------------------------------------------------------------


@query(
    "f01_core_geographies",
    "SELECT period_date, geography_level, location_id, median_rent, bonds_lodged FROM q_clean WHERE location_id NOT IN (-99, -1)",
)
def f01(d: DriverTables):
    return panel.core_geographies(d.clean).select("period_date", "geography_level", "location_id", *C.METRICS)


@query(
    "f02_filter_series",
    f"SELECT {PANEL_FIELDS} FROM q_panel WHERE geography_level = 'region' AND location_name = 'ASIA' AND metric = 'median_rent'",
)
def f02(d: DriverTables):
    return summaries.one_series(d.panel, C.LEVEL_REGION, "ASIA", C.METRIC_RENT)


@query(
    "f03_filter_date_range",
    f"SELECT {PANEL_FIELDS} FROM q_panel WHERE period_date BETWEEN DATE '1998-01-01' AND DATE '1999-12-01'",
)
def f03(d: DriverTables):
    return summaries.in_range(d.panel, "1998-01-01", "1999-12-01")


@query(
    "f04_market_aggregate_rows",
    """
    SELECT area_name, median_rent, bonds_lodged FROM q_market
    WHERE period_start = DATE '2001-07-01' AND area_name NOT IN ('ALL', 'NA')
    """,
)
def f04(d: DriverTables):
    at = d.market.where(F.col("period_start") == F.lit("2001-07-01").cast("date"))
    return reconcile.market_region_rows(at).select("area_name", *C.METRICS)


@query(
    "f05_bond_region_rows",
    """
    SELECT location_name, median_rent, bonds_lodged FROM q_clean
    WHERE period_date = DATE '2001-07-01' AND geography_level = 'region' AND location_id NOT IN (-99, -1)
    """,
)
def f05(d: DriverTables):
    at = d.clean.where(F.col("period_date") == F.lit("2001-07-01").cast("date"))
    return reconcile.bond_region_rows(at).select("location_name", *C.METRICS)


@query(
    "f06_drop_duplicate_geographies",
    f"SELECT {PANEL_FIELDS} FROM q_panel WHERE series_id NOT IN ({sql_list(C.duplicated_series_ids())})",
)
def f06(d: DriverTables):
    return joins.without_duplicated_series(d.panel)


@query(
    "f07_alert_rows",
    "SELECT series_id, period_date, overall_status, overall_severity, overall_direction FROM q_summary WHERE overall_dashboard_alert",
)
def f07(d: DriverTables):
    return consolidation.alert_rows(d.summary).select(
        "series_id", "period_date", "overall_status", "overall_severity", "overall_direction"
    )


@query(
    "f08_default_window",
    f"""
    SELECT {PANEL_FIELDS} FROM q_panel
    WHERE period_date >= (SELECT CAST(max(period_date) - INTERVAL 3 YEAR AS DATE) FROM q_panel)
    """,
)
def f08(d: DriverTables):
    return summaries.latest_years(d.stored_panel, 3)


@query(
    "f09_transition_mask",
    "SELECT series_id, period_date, period_date BETWEEN DATE '2000-01-01' AND DATE '2001-12-31' AS in_transition FROM q_panel",
)
def f09(d: DriverTables):
    start, end = (F.lit(t).cast("date") for t in TRANSITION)
    return evaluation.in_transition(d.panel.select("series_id", "period_date"), start, end)


# ---- reshape ---------------------------------------------------------------------------------


@query(
    "r01_melt_metrics",
    """
    SELECT period_date, concat(geography_level, '_', location_id, '_', metric) AS series_id, metric, value
    FROM (SELECT *, 'median_rent' AS metric, median_rent AS value FROM q_clean
          UNION ALL SELECT *, 'bonds_lodged', CAST(bonds_lodged AS DOUBLE) FROM q_clean)
    """,
)
def r01(d: DriverTables):
    return panel.melt_metrics(d.clean).select("period_date", "series_id", "metric", "value")


@query("r02_monthly_panel", f"SELECT {PANEL_FIELDS} FROM q_panel")
def r02(d: DriverTables):
    return d.panel


@query("t01_canonical_sort", f"SELECT {PANEL_FIELDS} FROM q_panel ORDER BY metric, geography_level, location_id, period_date")
def t01(d: DriverTables):
    return d.panel.orderBy(*panel.PANEL_ORDER)
