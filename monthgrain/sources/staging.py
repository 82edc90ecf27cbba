"""Staging files between raw snapshots and the keyed tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from monthgrain.contracts import ContractError, require_columns
from monthgrain.functions.parsing import flag, zoned_instant
from monthgrain.operators.checks import check_table, violation
from monthgrain.sources.bond import NO_NULL_TOKEN


def write_staging(df: DataFrame, root: str, day: str, stem: str) -> str:
    """Write one snapshot's staging rows under ``root/YYYY/MM/DD/stem``; an existing target is an error."""
    path = f"{root.rstrip('/')}/{day.replace('-', '/')}/{stem}"
    df.write.mode("errorifexists").option("header", True).csv(path)
    return path


def scan_staging(spark: SparkSession, path: str, columns: Sequence[str], empty_is_null: bool) -> DataFrame:
    """Read staging rows as text. ``NA`` is always text; empty cells are NULL only where that is allowed."""
    schema = StructType([StructField(c, StringType()) for c in columns])
    reader = spark.read.schema(schema).option("header", True).option("enforceSchema", False).option("mode", "FAILFAST")
    reader = reader.option("nullValue", "" if empty_is_null else NO_NULL_TOKEN)
    rows = reader.csv(path)
    if rows.isEmpty():
        raise ContractError(f"staging holds no rows: {path}")
    return rows


def lineage_checks(staging: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Does every staged snapshot come from exactly one raw file with matching metadata?

    Staging is reduced to one row per snapshot before it meets the snapshot list (a set of distinct
    values, not of rows). ``snapshots`` comes from :func:`monthgrain.sources.snapshots.attach_metadata`.
    """
    require_columns(staging, ("source_snapshot", "retrieved_at_utc"), "staging")
    aggs = [
        F.min(zoned_instant(F.col("retrieved_at_utc"))).alias("_t0"),
        F.max(zoned_instant(F.col("retrieved_at_utc"))).alias("_t1"),
        F.count_if(zoned_instant(F.col("retrieved_at_utc")).isNull()).alias("_no_time"),
    ]
    with_level = "geography_level" in staging.columns
    if with_level:
        provisional = flag(F.col("is_provisional").cast("string"))
        aggs += [
            F.min("geography_level").alias("_l0"),
            F.max("geography_level").alias("_l1"),
            F.bool_and(provisional).alias("_p0"),
            F.bool_or(provisional).alias("_p1"),
            F.count_if(provisional.isNull()).alias("_no_flag"),
        ]
    per_file = staging.groupBy("source_snapshot").agg(*aggs)
    known = snapshots.select(
        F.col("file_name").alias("source_snapshot"),
        "dataset",
        "problem",
        "provisional",
        zoned_instant(F.col("retrieved_at_utc")).alias("_at"),
        F.lit(True).alias("_known"),
    )
    rows = per_file.join(known, "source_snapshot", "left")
    at = F.col("_at")
    rules = {
        "raw_file_known": F.col("_known").isNull(),
        "metadata_valid": F.col("problem").isNotNull(),
        "timestamp_matches": (F.col("_no_time") > 0) | ~(F.col("_t0").eqNullSafe(at) & F.col("_t1").eqNullSafe(at)),
    }
    details = {
        "raw_file_known": "Every staged snapshot needs its raw file.",
        "metadata_valid": "Snapshot metadata and checksum must be valid.",
        "timestamp_matches": "Staged retrieval times must equal the metadata.",
    }
    if with_level:
        level = F.col("dataset")
        prov = F.col("provisional")
        rules["dataset_matches"] = ~(F.col("_l0").eqNullSafe(level) & F.col("_l1").eqNullSafe(level))
        rules["provisional_matches"] = (F.col("_no_flag") > 0) | ~(
            F.col("_p0").eqNullSafe(prov) & F.col("_p1").eqNullSafe(prov)
        )
        details["dataset_matches"] = "Staged geography level must equal the metadata dataset."
        details["provisional_matches"] = "Staged provisional flag must equal the metadata."
    totals = rows.agg(*[violation(F.count_if(rule), name) for name, rule in rules.items()])
    return check_table(totals, details)
