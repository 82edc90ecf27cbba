"""Session construction and durable intermediate tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", partitions: int = 8, app: str = "monthgrain") -> SparkSession:
    """Session for tests and the bench; a cluster job brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def durable_root(spark: SparkSession) -> str:
    """Shared folder for intermediate tables: the checkpoint folder of the session, else its warehouse folder.

    Both are places that every executor of a cluster reaches; nothing goes to a machine's own temporary folder.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return (configured or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_durable").rstrip("/")


def durable(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and return a scan of it.

    Used where several branches read the same expensive frame: the source tables are then read once,
    the branches keep column pruning, file statistics let joins pick a broadcast by real size, and a
    lost executor costs a re-read of this table instead of the whole lineage.
    """
    spark = df.sparkSession
    path = f"{durable_root(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
