"""The nested rent statistics payload: scan, checks, explode and mapping to the staging layout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructField, StructType

from monthgrain.contracts import require_columns
from monthgrain.functions.parsing import measure, period_range, present_text, whole_number
from monthgrain.operators.checks import check_table, violation

# Item fields of the published payload and their staging names
TEXT_FIELDS = ("area", "dwell", "nBedrms")
COUNT_FIELDS = ("nLodged", "nClosed", "nCurr")
MEASURE_FIELDS = ("mean", "lq", "med", "uq", "sd", "brr", "lmean", "lsd", "slq", "suq")
NUMBER_FIELDS = COUNT_FIELDS + MEASURE_FIELDS
STAGING_NAMES = {
    "area": "area",
    "dwell": "dwelling_type",
    "nBedrms": "bedrooms",
    "nLodged": "bonds_lodged",
    "nClosed": "bonds_closed",
    "nCurr": "active_bonds",
    "mean": "mean_rent",
    "lq": "lower_quartile_rent",
    "med": "median_rent",
    "uq": "upper_quartile_rent",
    "sd": "rent_std_dev",
    "brr": "bond_rent_ratio",
    "lmean": "log_mean",
    "lsd": "log_std_dev",
    "slq": "synthetic_lower_quartile",
    "suq": "synthetic_upper_quartile",
}
PAYLOAD_NAMES = ("period_start", "period_end", "area_definition")
LINEAGE_COLUMNS = ("source_snapshot", "retrieved_at_utc")
STAGING_COLUMNS = (*PAYLOAD_NAMES, *STAGING_NAMES.values(), *LINEAGE_COLUMNS)
UPSERT_KEY = (*PAYLOAD_NAMES, "area_name", "dwelling_type", "bedrooms")

ITEM_TYPE = StructType(
    [StructField(c, StringType()) for c in TEXT_FIELDS] + [StructField(c, DoubleType()) for c in NUMBER_FIELDS]
)
PAYLOAD_TYPE = StructType(
    [
        StructField("areaDefinition", StringType()),
        StructField("periodCovered", StringType()),
        StructField("items", ArrayType(ITEM_TYPE)),
    ]
)
# the same payload with items kept as their JSON text, for checks on presence and type
RAW_PAYLOAD_TYPE = StructType(
    [*PAYLOAD_TYPE.fields[:2], StructField("items", ArrayType(StringType()))]
)


def scan_payloads(spark: SparkSession, path: str, multi_line: bool = True, raw_items: bool = False) -> DataFrame:
    """One row per payload with the name of its file; invalid JSON ends the scan."""
    schema = RAW_PAYLOAD_TYPE if raw_items else PAYLOAD_TYPE
    reader = spark.read.schema(schema).option("multiLine", multi_line).option("mode", "FAILFAST")
    return reader.json(path).withColumn("source_snapshot", F.col("_metadata.file_name"))


def explode_items(payloads: DataFrame) -> DataFrame:
    """One row per item with the payload's own columns repeated (a map-side operation)."""
    require_columns(payloads, ("areaDefinition", "periodCovered", "items"), "payload")
    span = period_range(F.col("periodCovered"))
    bad = F.raise_error(F.lit("periodCovered is not a valid start/end pair")).cast("struct<period_start:date,period_end:date>")
    keep = [c for c in payloads.columns if c not in ("areaDefinition", "periodCovered", "items")]
    rows = payloads.withColumn("_span", F.when(span.isNull(), bad).otherwise(span))
    return rows.select(
        "_span.period_start",
        "_span.period_end",
        F.col("areaDefinition").alias("area_definition"),
        *keep,
        F.inline("items"),
    )


def map_rent_columns(items: DataFrame, retrieved_at_utc: str | Column) -> DataFrame:
    """Staging layout of exploded items."""
    at = retrieved_at_utc if isinstance(retrieved_at_utc, Column) else F.lit(retrieved_at_utc)
    return items.select(
        *PAYLOAD_NAMES,
        *[F.col(a).alias(b) for a, b in STAGING_NAMES.items()],
        "source_snapshot",
        at.alias("retrieved_at_utc"),
    )


def payload_checks(raw_payloads: DataFrame) -> DataFrame:
    """Presence and type rules over all items of all payloads, counted in one aggregation.

    Takes a scan with ``raw_items``: only the JSON text can tell an absent field from a null one and a
    boolean from a number.
    """
    exploded = raw_payloads.select("areaDefinition", "periodCovered", F.explode_outer("items").alias("item"))
    item = F.col("item")
    parsed = exploded.withColumns({"_keys": F.json_object_keys(item), "_v": F.try_parse_json(item)})

    def kind(name: str) -> Column:
        return F.schema_of_variant(F.try_variant_get("_v", f"$.{name}", "variant"))

    def text(name: str) -> Column:
        return F.trim(F.try_variant_get("_v", f"$.{name}", "string"))

    is_item = item.isNotNull()
    absent = F.coalesce(F.size(F.array_except(F.array(*[F.lit(n) for n in STAGING_NAMES]), F.col("_keys"))), F.lit(1)) > 0
    not_text = F.lit(False)
    for n in TEXT_FIELDS:
        not_text = not_text | F.coalesce(kind(n) != "STRING", F.lit(False)) | F.coalesce(text(n) == "", F.lit(False))
    not_number = F.lit(False)
    for n in NUMBER_FIELDS:
        not_number = not_number | F.coalesce(kind(n).rlike("^(STRING|BOOLEAN|ARRAY|OBJECT|DATE|TIMESTAMP)"), F.lit(False))
    totals = parsed.agg(
        violation(F.count_if(F.col("areaDefinition").isNull() | F.col("periodCovered").isNull()), "top_level_fields"),
        violation(F.count_if(~is_item) + F.when(F.count(F.lit(1)) == 0, 1).otherwise(0), "items_present"),
        violation(F.count_if(is_item & absent), "item_fields"),
        violation(F.count_if(is_item & not_text), "text_fields"),
        violation(F.count_if(is_item & not_number), "number_fields"),
    )
    return check_table(
        totals,
        {
            "top_level_fields": "Area definition and period must be present.",
            "items_present": "Items must be a non-empty list.",
            "item_fields": "Every item needs all sixteen fields.",
            "text_fields": "Area, dwelling and bedrooms must be non-empty text.",
            "number_fields": "Statistics must be numbers or null.",
        },
    )


def typed_rents(staging: DataFrame) -> DataFrame:
    """Staging text to loadable types.

    Periods and names must be there and well formed, or the job fails; counts and measures may be missing but not malformed.
    """
    require_columns(staging, STAGING_COLUMNS, "rent staging")

    def needed(value: Column, name: str) -> Column:
        message = F.lit(f"rent staging column {name} holds a value that cannot be loaded")
        return F.when(value.isNull(), F.raise_error(message)).otherwise(value).alias(name)

    def optional(name: str, convert) -> Column:
        text = F.col(name).cast("string")
        value = convert(text)
        message = F.lit(f"rent staging column {name} holds a value that cannot be loaded")
        return F.when(text.isNotNull() & value.isNull(), F.raise_error(message)).otherwise(value).alias(name)

    names = list(STAGING_NAMES.values())
    return staging.select(
        *[needed(F.col(c).cast("string").try_cast("date"), c) for c in ("period_start", "period_end")],
        needed(present_text(F.col("area_definition")), "area_definition"),
        needed(present_text(F.col("area")), "area_name"),
        needed(present_text(F.col("dwelling_type")), "dwelling_type"),
        needed(present_text(F.col("bedrooms")), "bedrooms"),
        *[optional(c, whole_number) for c in names[3:6]],
        *[optional(c, measure) for c in names[6:]],
    )
