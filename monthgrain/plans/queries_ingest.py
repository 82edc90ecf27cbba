"""Raw scans, staging, ledger, upserts, product store and the trained model (families S, U, P04, Q02, Q03, Q07, Q15, M08, N10)."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import DataFrame, functions as F

from monthgrain import contracts as C
from monthgrain.operators import checks, comparison, policy, pooled, production, seasonal_naive, smoothing
from monthgrain.operators.consolidation import consolidate
from monthgrain.operators.historical_anomalies import detect_historical, practical_historical
from monthgrain.operators.residual_anomalies import detect_residual, practical_residual
from monthgrain.plans import products
from monthgrain.plans.catalogue import query
from monthgrain.plans.driver_tables import POLICY_CUTOFF, DriverTables
from monthgrain.plans.queries_forecast import PRODUCTION_SQL
from monthgrain.plans.queries_history import _checks_sql
from monthgrain.plans.queries_rows import PANEL_FIELDS
from monthgrain.session import durable, durable_root
from monthgrain.sources import bond, large_payload, ledger, rent, snapshots, staging, store

SEEN_AT = "2001-08-01T00:00:00+00:00"
REVISION_FROM = "2000-07-01"


def _folder(d: DriverTables, label: str) -> str:
    return f"{durable_root(d.spark)}/{label}-{uuid.uuid4().hex}"


# ---- raw scans ----------------------------------------------------------------------------------

RAW_SQL = """
SELECT strftime(period_date, '%-d/%m/%Y') AS "TimeFrame", CAST(location_id AS VARCHAR) AS location_id, location_name AS location,
       CAST(bonds_lodged AS VARCHAR) AS "LodgedBonds", CAST(bonds_lodged * 3 AS VARCHAR) AS "ActiveBonds",
       CAST(bonds_lodged // 2 AS VARCHAR) AS "ClosedBonds", CAST(CAST(floor(median_rent) AS BIGINT) AS VARCHAR) AS "MedianRent",
       CAST(CAST(floor(median_rent) AS BIGINT) - 1 AS VARCHAR) AS "GeometricMeanRent",
       CAST(CAST(floor(median_rent) AS BIGINT) + 50 AS VARCHAR) AS "UpperQuartileRent",
       CAST(CAST(floor(median_rent) AS BIGINT) - 50 AS VARCHAR) AS "LowerQuartileRent", '0.5' AS "LogStdDevWeeklyRent"
FROM q_clean
"""


def _scanned_bonds(d: DriverTables) -> DataFrame:
    path = _folder(d, "raw-bonds")
    d.raw_bonds(d.clean).write.option("header", True).csv(path)
    return bond.scan_bonds(d.spark, path)


@query("s01_bond_csv_scan", RAW_SQL)
def s01(d: DriverTables):
    return _scanned_bonds(d)


def _payload_path(d: DriverTables) -> str:
    """One payload per month as JSON lines (a month's items are one row per named area)."""
    number = lambda c: F.col(c).cast("double")
    item = F.struct(
        F.col("area_name").alias("area"),
        F.col("dwelling_type").alias("dwell"),
        F.col("bedrooms").alias("nBedrms"),
        number("bonds_lodged").alias("nLodged"),
        F.lit(None).cast("double").alias("nClosed"),
        (number("bonds_lodged") * 3).alias("nCurr"),
        *[number("median_rent").alias(n) for n in rent.MEASURE_FIELDS],
    )
    span = F.concat(F.date_format("period_start", "yyyy-M-d"), F.lit("/"), F.date_format("period_end", "yyyy-M-d"))
    payloads = d.market.groupBy(F.col("area_definition").alias("areaDefinition"), span.alias("periodCovered")).agg(
        F.collect_list(item).alias("items")
    )
    path = _folder(d, "raw-payloads")
    payloads.write.option("ignoreNullFields", False).json(path)
    return path


@query(
    "s02_rent_json_scan",
    """
    SELECT 'REGC2019' AS "areaDefinition", strftime(period_start, '%Y-%-m-%-d') || '/' || strftime(period_end, '%Y-%-m-%-d') AS "periodCovered",
           CAST(count(*) AS INTEGER) AS n_items FROM q_market GROUP BY period_start, period_end
    """,
)
def s02(d: DriverTables):
    scanned = rent.scan_payloads(d.spark, _payload_path(d), multi_line=False)
    return scanned.select("areaDefinition", "periodCovered", F.size("items").alias("n_items"))


@query(
    "s03_payload_explode",
    """
    SELECT period_start, period_end, area_definition, area_name AS area, dwelling_type AS dwell, bedrooms AS "nBedrms",
           CAST(bonds_lodged AS DOUBLE) AS "nLodged", median_rent AS med FROM q_market
    """,
)
def s03(d: DriverTables):
    items = rent.explode_items(rent.scan_payloads(d.spark, _payload_path(d), multi_line=False))
    return items.select("period_start", "period_end", "area_definition", "area", "dwell", "nBedrms", "nLodged", "med")


@query(
    "p04_rent_column_map",
    """
    SELECT period_start, period_end, area_definition, area_name AS area, dwelling_type, bedrooms, CAST(bonds_lodged AS DOUBLE) AS bonds_lodged,
           CAST(NULL AS DOUBLE) AS bonds_closed, CAST(bonds_lodged * 3 AS DOUBLE) AS active_bonds, median_rent AS mean_rent,
           median_rent AS lower_quartile_rent, median_rent, median_rent AS upper_quartile_rent, median_rent AS rent_std_dev,
           median_rent AS bond_rent_ratio, median_rent AS log_mean, median_rent AS log_std_dev,
           median_rent AS synthetic_lower_quartile, median_rent AS synthetic_upper_quartile, '2001-08-01T00:00:00+00:00' AS retrieved_at_utc
    FROM q_market
    """,
)
def p04(d: DriverTables):
    items = rent.explode_items(rent.scan_payloads(d.spark, _payload_path(d), multi_line=False))
    return rent.map_rent_columns(items, SEEN_AT).drop("source_snapshot")


def _large_payload_path(d: DriverTables) -> str:
    """All items as one payload over the whole calendar, one file."""
    number = lambda c: F.col(c).cast("double")
    item = F.struct(
        F.col("area_name").alias("area"),
        F.col("dwelling_type").alias("dwell"),
        F.col("bedrooms").alias("nBedrms"),
        number("bonds_lodged").alias("nLodged"),
        F.lit(None).cast("double").alias("nClosed"),
        (number("bonds_lodged") * 3).alias("nCurr"),
        *[number("median_rent").alias(n) for n in rent.MEASURE_FIELDS],
    )
    market = durable(d.market, "market")
    span = [F.date_format(f(c), "yyyy-M-d") for f, c in ((F.min, "period_start"), (F.max, "period_end"))]
    opening = F.concat(F.lit('{"areaDefinition": "REGC2019", "periodCovered": "'), span[0], F.lit("/"), span[1], F.lit('", "items": ['))
    text = F.to_json(item, {"ignoreNullFields": "false"})
    lines = market.agg(F.lit(0).cast("long").alias("n"), opening.alias("value")).unionByName(
        market.select((F.monotonically_increasing_id() + 1).alias("n"), text.alias("value"))
    )
    last = lines.agg(F.max("n")).first()[0]
    comma = F.when((F.col("n") > 0) & (F.col("n") < last), ",").otherwise("")
    path = _folder(d, "large-payload")
    closing = d.spark.createDataFrame([(last + 1, "]}")], "n long, value string")
    ordered = lines.unionByName(closing).coalesce(1).sortWithinPartitions("n")
    ordered.select(F.concat("value", comma).alias("value")).write.text(path)
    return path


@query(
    "s02_large_payload_scan",
    """
    SELECT (SELECT min(period_start) FROM q_market) AS period_start, (SELECT max(period_end) FROM q_market) AS period_end, area_definition,
           area_name AS area, dwelling_type AS dwell, bedrooms AS "nBedrms", CAST(bonds_lodged AS DOUBLE) AS "nLodged", median_rent AS med
    FROM q_market
    """,
)
def s02_large(d: DriverTables):
    items = rent.explode_items(large_payload.scan_large_payloads(d.spark, _large_payload_path(d)))
    return items.select("period_start", "period_end", "area_definition", "area", "dwell", "nBedrms", "nLodged", "med")


@query(
    "q02_rent_payload_checks",
    _checks_sql(
        """SELECT count(*) FILTER (area_definition IS NULL OR period_start IS NULL) AS top_level_fields,
        CASE WHEN count(*) = 0 THEN 1 ELSE 0 END AS items_present, 0 AS item_fields,
        count(*) FILTER (trim(area_name) = '' OR trim(dwelling_type) = '' OR trim(bedrooms) = '') AS text_fields, 0 AS number_fields FROM q_market""",
        ["top_level_fields", "items_present", "item_fields", "text_fields", "number_fields"],
    ),
)
def q02(d: DriverTables):
    raw = rent.scan_payloads(d.spark, _payload_path(d), multi_line=False, raw_items=True)
    return rent.payload_checks(raw).drop("details")


@query(
    "q03_bond_table_checks",
    _checks_sql(
        """SELECT CASE WHEN count(*) = 0 THEN 1 ELSE 0 END AS not_empty, count(*) FILTER (trim(location_name) = '') AS location_present,
        count(*) FILTER (day(period_date) <> 1) AS month_start, count(*) FILTER (location_id IS NULL) AS whole_location_id,
        """
        + ", ".join(
            f"count(*) FILTER (bonds_lodged IS NULL OR median_rent IS NULL) AS whole_{c}" for c in bond.WHOLE_COLUMNS[1:]
        )
        + ", 0 AS numeric_LogStdDevWeeklyRent FROM q_clean",
        ["not_empty", "location_present", "month_start", *[f"whole_{c}" for c in bond.WHOLE_COLUMNS], "numeric_LogStdDevWeeklyRent"],
    ),
)
def q03(d: DriverTables):
    return bond.bond_checks(_scanned_bonds(d)).drop("details")


# ---- snapshots ------------------------------------------------------------------------------------


@query("s04_snapshot_ledger_scan")
def s04(d: DriverTables):
    path = _folder(d, "raw-snapshots")
    rows = d.raw_bonds(d.clean)
    rows.withColumn("year", F.substring_index("TimeFrame", "/", -1)).repartition("year").write.partitionBy("year").option(
        "header", True
    ).csv(path)
    found = snapshots.scan_snapshots(d.spark, path, "*.csv")
    return found.select("file_name", "file_size_bytes", "checksum_sha256")


@query(
    "s04_snapshot_digests",
    """
    SELECT year, CAST(octet_length(encode(body)) AS BIGINT) AS file_size_bytes, sha256(body) AS checksum_sha256
    FROM (
      SELECT CAST(year(period_date) AS INTEGER) AS year, string_agg(line, chr(10) ORDER BY line) || chr(10) AS body
      FROM (SELECT period_date, concat_ws(',', strftime(period_date, '%Y-%m-%d'), geography_level, location_id, location_name,
                   bonds_lodged) AS line FROM q_clean)
      GROUP BY year(period_date))
    """,
)
def s04_digests(d: DriverTables):
    """Size and digest of files whose every byte SQL can state: one file a year, its lines in order."""
    path = _folder(d, "plain-snapshots")
    day = F.date_format("period_date", "yyyy-MM-dd")
    line = F.concat_ws(",", day, "geography_level", "location_id", "location_name", "bonds_lodged")
    # a year holds twelve lines a place
    lines = F.concat_ws("\n", F.sort_array(F.collect_list(line)))
    years = d.clean.groupBy(F.year("period_date").alias("year")).agg(lines.alias("value"))
    years.write.partitionBy("year").text(path)
    found = snapshots.scan_snapshots(d.spark, path, "*.txt")
    year = F.regexp_extract("path", "year=([0-9]+)/", 1).cast("int")
    return found.select(year.alias("year"), "file_size_bytes", "checksum_sha256")


def _snapshot_files(d: DriverTables) -> DataFrame:
    """One raw snapshot per (level, year) of the observations, with an identity and a checksum."""
    months = d.clean.where(F.col("location_id") > 0).groupBy("geography_level", F.year("period_date").alias("year")).agg(
        F.count(F.lit(1)).alias("row_count"), F.sum("bonds_lodged").alias("bonds")
    )
    stem = F.concat(F.lit("rental_bond_"), F.col("geography_level"), F.lit("_"), F.col("year").cast("string"), F.lit("0101T000000Z"))
    return months.select(
        F.concat(F.lit("raw/"), F.col("year").cast("string"), F.lit("/01/01/"), stem, F.lit(".csv")).alias("path"),
        F.concat(stem, F.lit(".csv")).alias("file_name"),
        stem.alias("stem"),
        F.col("geography_level").alias("level"),
        "year",
        "row_count",
        F.sha2(F.concat_ws("-", "geography_level", F.col("year").cast("string"), F.col("bonds").cast("string")), 256).alias(
            "checksum_sha256"
        ),
    )


FILES_SQL = """
(SELECT 'raw/' || year || '/01/01/' || stem || '.csv' AS path, stem || '.csv' AS file_name, *
 FROM (SELECT geography_level AS level, CAST(year(period_date) AS INTEGER) AS year, count(*) AS row_count,
              sha256(concat_ws('-', geography_level, year(period_date), sum(bonds_lodged))) AS checksum_sha256,
              'rental_bond_' || geography_level || '_' || year(period_date) || '0101T000000Z' AS stem
       FROM q_clean WHERE location_id > 0 GROUP BY geography_level, year(period_date)))
"""


def _sidecars(files: DataFrame) -> DataFrame:
    """Metadata rows of the snapshots; 1996 has none and 1997 names another file."""
    return files.where("year <> 1996").select(
        "stem",
        F.concat("stem", F.lit(".metadata.json")).alias("metadata_file_name"),
        F.when(F.col("year") == 1997, "other.csv").otherwise(F.col("file_name")).alias("raw_file"),
        F.col("level").alias("dataset"),
        F.lit(SEEN_AT).alias("retrieved_at_utc"),
        F.col("checksum_sha256").alias("sha256"),
        (F.col("year") >= 2001).alias("provisional"),
        F.lit(0).cast("bigint").alias("file_size_bytes"),
    )


@query(
    "s05_metadata_join",
    f"""
    SELECT file_name, CASE WHEN year <> 1996 THEN level END AS dataset, CASE WHEN year <> 1996 THEN year >= 2001 END AS provisional,
           CASE year WHEN 1996 THEN 'metadata file is missing' WHEN 1997 THEN 'raw_file does not match the snapshot' END AS problem
    FROM {FILES_SQL}
    """,
)
def s05(d: DriverTables):
    files = _snapshot_files(d)
    joined = snapshots.attach_metadata(files, _sidecars(files))
    return joined.select("file_name", "dataset", "provisional", "problem")


@query(
    "s06_latest_snapshot",
    f"SELECT 'rental_bond_' || level AS dataset, max(path) AS path FROM {FILES_SQL} GROUP BY level",
)
def s06(d: DriverTables):
    return snapshots.latest_snapshots(_snapshot_files(d))


# ---- staging ----------------------------------------------------------------------------------------

STAGED_SQL = """
SELECT period_date, geography_level, location_id, location_name, bonds_lodged, bonds_lodged * 3 AS active_bonds,
       bonds_lodged // 2 AS bonds_closed, CAST(floor(median_rent) AS DECIMAL(18, 4)) AS median_rent,
       CAST(floor(median_rent) - 1 AS DECIMAL(18, 4)) AS geometric_mean_rent, CAST(floor(median_rent) + 50 AS DECIMAL(18, 4)) AS upper_quartile_rent,
       CAST(floor(median_rent) - 50 AS DECIMAL(18, 4)) AS lower_quartile_rent, CAST(0.5 AS DECIMAL(18, 4)) AS log_std_dev_weekly_rent
FROM q_clean WHERE geography_level = 'region'
"""


def _staged_regions(d: DriverTables) -> DataFrame:
    raw = d.raw_bonds(d.clean.where(F.col("geography_level") == C.LEVEL_REGION))
    return bond.map_bond_columns(
        raw, dataset=C.LEVEL_REGION, source_snapshot="region.csv", retrieved_at_utc=SEEN_AT, is_provisional=True
    )


@query("s07_staging_scan", STAGED_SQL)
def s07(d: DriverTables):
    path = staging.write_staging(_staged_regions(d), _folder(d, "staging"), "2001-08-01", "region")
    return bond.typed_bonds(staging.scan_staging(d.spark, path, bond.STAGING_COLUMNS, empty_is_null=False))


@query(
    "s10_staging_sink",
    "SELECT 'region.csv' AS source_snapshot, count(*) AS rows FROM q_clean WHERE geography_level = 'region'",
)
def s10(d: DriverTables):
    path = staging.write_staging(_staged_regions(d), _folder(d, "staging"), "2001-08-01", "region")
    rows = staging.scan_staging(d.spark, path, bond.STAGING_COLUMNS, empty_is_null=False)
    return rows.groupBy("source_snapshot").agg(F.count(F.lit(1)).alias("rows"))


@query(
    "q07_lineage_checks",
    _checks_sql(
        f"""SELECT count(*) FILTER (f.file_name IS NULL) AS raw_file_known, count(*) FILTER (f.year IN (1996, 1997)) AS metadata_valid,
        count(*) FILTER (f.year = 1996) AS timestamp_matches,
        count(*) FILTER (f.year = 1996 OR f.level <> s.level) AS dataset_matches,
        count(*) FILTER (f.year = 1996 OR (f.year >= 2001) <> s.provisional) AS provisional_matches
        FROM (SELECT DISTINCT 'rental_bond_' || geography_level || '_' || year(period_date) || '0101T000000Z.csv' AS file_name,
                     geography_level AS level, year(period_date) >= 2001 AS provisional FROM q_clean WHERE location_id > 0) s
        LEFT JOIN {FILES_SQL} f ON f.file_name = s.file_name""",
        ["raw_file_known", "metadata_valid", "timestamp_matches", "dataset_matches", "provisional_matches"],
    ),
)
def q07(d: DriverTables):
    files = _snapshot_files(d)
    known = snapshots.attach_metadata(files, _sidecars(files))
    year = F.year("period_date")
    staged = d.clean.where(F.col("location_id") > 0).select(
        F.concat(F.lit("rental_bond_"), "geography_level", F.lit("_"), year.cast("string"), F.lit("0101T000000Z.csv")).alias(
            "source_snapshot"
        ),
        "geography_level",
        F.lit(SEEN_AT).alias("retrieved_at_utc"),
        (year >= 2001).alias("is_provisional"),
    )
    return staging.lineage_checks(staged, known).drop("details")


# ---- ledger and upserts ---------------------------------------------------------------------------------

IDENT_SQL = "CAST('0x' || substr(sha256('rental_bond_' || level || ':' || checksum_sha256), 1, 15) AS BIGINT)"


def _ledger_sides(d: DriverTables) -> tuple[DataFrame, DataFrame]:
    files = _snapshot_files(d).withColumn("source_name", F.concat(F.lit("rental_bond_"), "level"))
    rows = files.select("year", "source_name", "checksum_sha256", "file_name", "row_count")
    existing = rows.where("year <= 1999").select(
        ledger.snapshot_id(F.col("source_name"), F.col("checksum_sha256")).alias("snapshot_id"),
        "source_name",
        "checksum_sha256",
        "file_name",
        "row_count",
        F.lit("loaded").alias("status"),
    )
    return existing, rows.where("year >= 1998").drop("year")


@query(
    "u01_snapshot_register",
    f"""
    SELECT {IDENT_SQL} AS snapshot_id, 'rental_bond_' || level AS source_name, checksum_sha256, file_name, row_count,
           CASE WHEN year <= 1999 THEN 'loaded' ELSE 'validated' END AS status FROM {FILES_SQL}
    """,
)
def u01(d: DriverTables):
    return ledger.register_snapshots(*_ledger_sides(d))


@query(
    "u04_mark_loaded",
    f"""
    SELECT 'rental_bond_' || level AS source_name, file_name, CASE WHEN year = 2001 AND level = 'region' THEN 99 ELSE row_count END AS row_count,
           CASE WHEN year <= 1999 OR year = 2001 AND level = 'region' THEN 'loaded' ELSE 'validated' END AS status FROM {FILES_SQL}
    """,
)
def u04(d: DriverTables):
    registered = ledger.register_snapshots(*_ledger_sides(d))
    target = F.when(F.col("file_name") == "rental_bond_region_20010101T000000Z.csv", F.col("snapshot_id"))
    return ledger.mark_loaded(registered, target, 99).select("source_name", "file_name", "row_count", "status")


def _revisions(rows: DataFrame, period: str) -> tuple[DataFrame, DataFrame]:
    """First load (all but the newest half year) and a second, overlapping load with revised counts."""
    first = rows.where(F.col(period) < F.lit("2001-02-01").cast("date")).withColumn("load_seq", F.lit(1).cast("bigint"))
    second = rows.where(F.col(period) >= F.lit(REVISION_FROM).cast("date")).withColumn("load_seq", F.lit(2).cast("bigint"))
    return first, second.withColumn("bonds_lodged", F.col("bonds_lodged") + 1000)


REVISED = f">= DATE '{REVISION_FROM}'"
UPSERT_BOND_SQL = f"""
SELECT period_date, geography_level, location_id, location_name, bonds_lodged + CASE WHEN period_date {REVISED} THEN 1000 ELSE 0 END AS bonds_lodged,
       median_rent, CAST(CASE WHEN period_date {REVISED} THEN 2 ELSE 1 END AS BIGINT) AS load_seq FROM q_clean
"""


@query("u02_upsert_bond", UPSERT_BOND_SQL)
def u02(d: DriverTables):
    rows = d.clean.select("period_date", "geography_level", "location_id", "location_name", "bonds_lodged", "median_rent")
    return ledger.upsert(*_revisions(rows, "period_date"), ledger.BOND_KEY)


@query(
    "u03_upsert_rent",
    f"""
    SELECT * REPLACE (bonds_lodged + CASE WHEN period_start {REVISED} THEN 1000 ELSE 0 END AS bonds_lodged),
           CAST(CASE WHEN period_start {REVISED} THEN 2 ELSE 1 END AS BIGINT) AS load_seq FROM q_market
    """,
)
def u03(d: DriverTables):
    return ledger.upsert(*_revisions(d.market, "period_start"), ledger.RENT_KEY)


BOND_TABLE = (
    "period_date date, geography_level string, location_id int, location_name string, bonds_lodged bigint, median_rent double, "
    "source_snapshot_id bigint, retrieved_at timestamp"
)


@query("u05_load_staging", UPSERT_BOND_SQL)
def u05(d: DriverTables):
    root = _folder(d, "loaded")
    table = ledger.LoadedTable(d.spark, f"{root}/bonds", BOND_TABLE, ledger.BOND_KEY)
    book = ledger.LoadedTable(d.spark, f"{root}/ledger", ledger.LEDGER_SCHEMA, ledger.LEDGER_KEY)
    rows = durable(
        d.clean.select("period_date", "geography_level", "location_id", "location_name", "bonds_lodged", "median_rent"), "clean"
    )
    for seq, part in enumerate(_revisions(rows, "period_date"), start=1):
        ledger.load_snapshot(
            part.drop("load_seq"),
            table,
            book,
            source_name="rental_bond",
            checksum=f"checksum-{seq}",
            file_name=f"load_{seq}.csv",
            retrieved_at=dt.datetime(2001, 8, seq),
            load_seq=seq,
        )
    return table.read().drop("source_snapshot_id", "retrieved_at")


# ---- product store ---------------------------------------------------------------------------------------


@query("s09_processed_reader", f"SELECT {PANEL_FIELDS} FROM q_panel")
def s09(d: DriverTables):
    root = _folder(d, "products")
    store.write_product(d.panel, root, "monthly_panel")
    return store.read_product(d.spark, root, "monthly_panel")


def _written(d: DriverTables, made: dict[str, DataFrame]) -> DataFrame:
    root = _folder(d, "products")
    store.write_products(made, root)
    return comparison.union_loose(
        [
            store.read_product(d.spark, root, name).agg(F.count(F.lit(1)).alias("rows")).withColumn("product", F.lit(name))
            for name in made
        ]
    )


@query(
    "s11_processed_sink",
    """
    SELECT 'monthly_panel' AS product, count(*) AS rows FROM q_panel UNION ALL SELECT 'series_catalog', count(*) FROM q_catalog
    UNION ALL SELECT 'quality_summary', count(*) FROM q_quality UNION ALL SELECT 'historical_summary', count(*) FROM q_quality
    UNION ALL SELECT 'monthly_seasonality', count(*) FROM (SELECT DISTINCT series_id, month(period_date) FROM q_panel)
    UNION ALL SELECT 'recent_history_summary', count(*) FROM q_quality UNION ALL SELECT 'modelling_readiness', 1
    """,
)
def s11(d: DriverTables):
    return _written(d, products.analytics_products(d.clean))


@query(
    "n10_anomaly_products",
    """
    SELECT 'historical_anomalies' AS product, count(*) AS rows FROM q_historical UNION ALL SELECT 'forecast_anomalies', count(*) FROM q_residual
    UNION ALL SELECT 'anomaly_summary', count(*) FROM q_summary UNION ALL SELECT 'anomaly_validation_summary', 16
    UNION ALL SELECT 'anomaly_metadata_summary', 30
    """,
)
def n10(d: DriverTables):
    return _written(d, products.anomaly_products(d.stored_panel, d.predictions, d.winners))


@query(
    "q15_production_gate",
    f"SELECT model, forecast_policy, count(*) AS rows FROM ({PRODUCTION_SQL}) GROUP BY ALL",
)
def q15(d: DriverTables):
    by_series = comparison.metrics_by_series(smoothing.smoothing_backtest(d.modelled))
    forecasts = durable(production.production_forward(d.modelled, by_series), "forward")
    served = store.production_gate(forecasts)
    return served.groupBy("model", "forecast_policy").agg(F.count(F.lit(1)).alias("rows"))


@query(
    "q01_require_columns",
    "SELECT series_id, CAST(count(*) AS BIGINT) AS rows FROM q_panel GROUP BY series_id",
)
def q01(d: DriverTables):
    rows = C.require_columns(d.panel, C.PANEL_COLUMNS, "panel")
    return rows.groupBy("series_id").agg(F.count(F.lit(1)).alias("rows"))


# ---- trained model -----------------------------------------------------------------------------------------

@query("m08_pooled_boost_backtest")
def m08(d: DriverTables):
    return pooled.boosted_backtest(d.modelled)


# the same comparisons as a11, a13, q06, v03 and n06, with the trained model in them; SQL cannot state a trained model


@query("t05_three_models")
def t05_three(d: DriverTables):
    return d.all_predictions


@query("q06_three_models")
def q06_three(d: DriverTables):
    return checks.alignment_checks(d.all_predictions, len(C.MODEL_ORDER)).drop("details")


@query("a11_three_models")
def a11_three(d: DriverTables):
    return comparison.model_comparison(d.all_predictions)


@query("a13_three_models")
def a13_three(d: DriverTables):
    return comparison.series_winners(comparison.metrics_by_series(d.all_predictions))


@query("v03_three_models")
def v03_three(d: DriverTables):
    selection, evaluation = policy.split_by_cutoff(d.all_predictions, POLICY_CUTOFF)
    return policy.evaluate_policies(evaluation, policy.selection_winners(selection))


@query("n06_three_models")
def n06_three(d: DriverTables):
    winners = comparison.series_winners(comparison.metrics_by_series(d.all_predictions))
    residual = practical_residual(detect_residual(d.all_predictions, winners))
    return consolidate(practical_historical(detect_historical(d.stored_panel)), residual)


@query("m12_boost_forward")
def m12(d: DriverTables):
    return pooled.boosted_forward(d.modelled)


@query("m13_all_model_forward")
def m13(d: DriverTables):
    history = d.modelled
    rows = durable(
        comparison.union_loose(
            [seasonal_naive.naive_forward(history), smoothing.smoothing_forward(history), pooled.boosted_forward(history)]
        ),
        "all-forward",
    )
    expected = history.select("series_id").distinct()
    for model in C.MODEL_ORDER:
        checks.assert_checks(production.forward_checks(rows.where(F.col("model") == model), expected), f"{model} forecasts")
    return rows
