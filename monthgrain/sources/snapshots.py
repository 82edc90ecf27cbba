"""Raw snapshot files: identity, sidecar metadata and the newest file of each dataset."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import BooleanType, LongType, MapType, StringType, StructField, StructType

from monthgrain.contracts import LEVELS, require_columns
from monthgrain.functions.parsing import zoned_instant

METADATA_TYPE = StructType(
    [
        StructField("raw_file", StringType()),
        StructField("dataset", StringType()),
        StructField("source_url", StringType()),
        StructField("retrieved_at_utc", StringType()),
        StructField("file_size_bytes", LongType()),
        StructField("sha256", StringType()),
        StructField("provisional", BooleanType()),
        StructField("request_parameters", MapType(StringType(), StringType())),
    ]
)
SIDECAR = ".metadata.json"


def scan_snapshots(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """Path, name, size and SHA-256 of every raw file below ``root``, hashed in the tasks.

    The content itself never leaves the scan.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern)
    name = F.element_at(F.split("path", "/"), -1)
    files = reader.load(root).select(
        "path",
        name.alias("file_name"),
        F.col("length").alias("file_size_bytes"),
        F.sha2("content", 256).alias("checksum_sha256"),
    )
    return files.where(~F.col("file_name").endswith(SIDECAR)).withColumn(
        "stem", F.regexp_replace("file_name", r"\.[^.]+$", "")
    )


def scan_metadata(spark: SparkSession, root: str) -> DataFrame:
    """Sidecar metadata of every snapshot below ``root``; a flag that is not boolean reads as NULL."""
    reader = spark.read.schema(METADATA_TYPE).option("multiLine", True).option("recursiveFileLookup", True)
    rows = reader.option("pathGlobFilter", f"*{SIDECAR}").json(root)
    name = F.col("_metadata.file_name")
    return rows.select("*", name.alias("metadata_file_name"), F.regexp_replace(name, r"\.metadata\.json$", "").alias("stem"))


def attach_metadata(snapshots: DataFrame, metadata: DataFrame) -> DataFrame:
    """Snapshots with their sidecar and the first thing wrong with it (NULL when nothing is)."""
    require_columns(snapshots, ("file_name", "stem", "checksum_sha256"), "snapshots")
    joined = snapshots.join(metadata.drop("file_size_bytes"), "stem", "left")
    problem = (
        F.when(F.col("metadata_file_name").isNull(), "metadata file is missing")
        .when(~F.col("raw_file").eqNullSafe(F.col("file_name")), "raw_file does not match the snapshot")
        .when(~F.coalesce(F.col("dataset").isin(*LEVELS), F.lit(False)), "unsupported dataset")
        .when(F.col("retrieved_at_utc").isNull(), "retrieved_at_utc is missing")
        .when(zoned_instant(F.col("retrieved_at_utc")).isNull(), "retrieved_at_utc is not a zoned timestamp")
        .when(F.col("provisional").isNull(), "provisional flag is not boolean")
        .when(~F.col("sha256").eqNullSafe(F.col("checksum_sha256")), "checksum does not match")
    )
    return joined.withColumn("problem", problem)


def latest_snapshots(snapshots: DataFrame, dataset_of: str = r"^(.*)_[0-9TZ]+\.[^.]+$") -> DataFrame:
    """Greatest path of each dataset; names carry their retrieval time, so order is age."""
    dataset = F.regexp_extract("file_name", dataset_of, 1)
    return snapshots.where(dataset != "").groupBy(dataset.alias("dataset")).agg(F.max("path").alias("path"))
