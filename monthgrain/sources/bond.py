"""The monthly bond CSV: scan, checks and mapping to the staging layout."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from monthgrain.contracts import LEVELS, ContractError, require_columns
from monthgrain.functions.parsing import measure, month_from_dmy, whole_number
from monthgrain.operators.checks import check_table, violation

# Column layout of the published file and its staging names
RAW_COLUMNS = (
    "TimeFrame",
    "location_id",
    "location",
    "LodgedBonds",
    "ActiveBonds",
    "ClosedBonds",
    "MedianRent",
    "GeometricMeanRent",
    "UpperQuartileRent",
    "LowerQuartileRent",
    "LogStdDevWeeklyRent",
)
WHOLE_COLUMNS = RAW_COLUMNS[1:2] + RAW_COLUMNS[3:10]
STAGING_NAMES = {
    "location_id": "location_id",
    "location": "location_name",
    "LodgedBonds": "bonds_lodged",
    "ActiveBonds": "active_bonds",
    "ClosedBonds": "bonds_closed",
    "MedianRent": "median_rent",
    "GeometricMeanRent": "geometric_mean_rent",
    "UpperQuartileRent": "upper_quartile_rent",
    "LowerQuartileRent": "lower_quartile_rent",
    "LogStdDevWeeklyRent": "log_std_dev_weekly_rent",
}
LINEAGE_COLUMNS = ("source_snapshot", "retrieved_at_utc", "is_provisional")
STAGING_COLUMNS = ("period_date", "geography_level", *STAGING_NAMES.values(), *LINEAGE_COLUMNS)
NO_NULL_TOKEN = "\u0000"


def scan_bonds(spark: SparkSession, path: str) -> DataFrame:
    """Read raw files as text. The header must match the layout in order; ``NA`` stays text.

    Numbers stay text too, so that a bad cell is counted by :func:`bond_checks` instead of ending the scan.
    """
    schema = StructType([StructField(c, StringType()) for c in RAW_COLUMNS])
    reader = spark.read.schema(schema).option("header", True).option("enforceSchema", False)
    return reader.option("nullValue", NO_NULL_TOKEN).option("mode", "FAILFAST").csv(path)


def bond_checks(raw: DataFrame) -> DataFrame:
    """Layout and cell checks in one pass over the raw rows."""
    if tuple(raw.columns) != RAW_COLUMNS:
        raise ContractError(f"bond file columns differ from the layout: {raw.columns}")
    blank = F.trim(F.coalesce(F.col("location"), F.lit(""))) == ""
    numeric = F.col("LogStdDevWeeklyRent").try_cast("double")
    totals = raw.agg(
        violation(F.when(F.count(F.lit(1)) == 0, 1), "not_empty"),
        violation(F.count_if(blank), "location_present"),
        violation(F.count_if(month_from_dmy(F.col("TimeFrame")).isNull()), "month_start"),
        *[violation(F.count_if(whole_number(F.col(c)).isNull()), f"whole_{c}") for c in WHOLE_COLUMNS],
        violation(F.count_if(numeric.isNull() | F.isnan(numeric)), "numeric_LogStdDevWeeklyRent"),
    )
    details = {
        "not_empty": "The file must hold rows.",
        "location_present": "Location must not be blank.",
        "month_start": "TimeFrame must be the first day of a month as D/MM/YYYY.",
        **{f"whole_{c}": f"{c} must hold whole numbers." for c in WHOLE_COLUMNS},
        "numeric_LogStdDevWeeklyRent": "LogStdDevWeeklyRent must be numeric.",
    }
    return check_table(totals, details)


def map_bond_columns(
    raw: DataFrame, *, dataset: str, source_snapshot: str, retrieved_at_utc: str, is_provisional: bool
) -> DataFrame:
    """Staging layout of one snapshot with its lineage columns."""
    if dataset not in LEVELS:
        raise ContractError(f"unsupported bond dataset: {dataset}")
    require_columns(raw, RAW_COLUMNS, "bond file")
    return raw.select(
        month_from_dmy(F.col("TimeFrame")).alias("period_date"),
        F.lit(dataset).alias("geography_level"),
        *[F.col(a).alias(b) for a, b in STAGING_NAMES.items()],
        F.lit(source_snapshot).alias("source_snapshot"),
        F.lit(retrieved_at_utc).alias("retrieved_at_utc"),
        F.lit(is_provisional).alias("is_provisional"),
    )


def typed_bonds(staging: DataFrame) -> DataFrame:
    """Staging text to loadable types; a value that does not convert fails the job."""
    require_columns(staging, STAGING_COLUMNS, "bond staging")

    def needed(value, name: str):
        message = F.lit(f"bond staging column {name} holds a value that cannot be loaded")
        return F.when(value.isNull(), F.raise_error(message)).otherwise(value).alias(name)

    text = lambda c: F.col(c).cast("string")
    level = F.when(F.col("geography_level").isin(*LEVELS), F.col("geography_level"))
    name = F.trim("location_name")
    return staging.select(
        needed(text("period_date").try_cast("date"), "period_date"),
        needed(level, "geography_level"),
        needed(whole_number(text("location_id")).cast("int"), "location_id"),
        needed(F.when(name != "", name), "location_name"),
        *[needed(whole_number(text(c)), c) for c in ("bonds_lodged", "active_bonds", "bonds_closed")],
        *[needed(measure(text(c)), c) for c in STAGING_COLUMNS[7:12]],
    )
