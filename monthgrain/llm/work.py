"""Working tables in the folder that all executors share."""

from __future__ import annotations

import gc
import re
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The session's checkpoint folder; where none is set (tests), the warehouse folder."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return (root or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_work").rstrip("/")


class Work:
    """Tables written once and scanned by their readers, so that a lost executor re-reads instead of recomputing.

    ``drop`` removes a table that no later plan reads; ``close`` removes the whole folder, once the operator's result is written.
    """

    def __init__(self, spark: SparkSession, label: str) -> None:
        self.spark = spark
        plain = re.sub(r"[^A-Za-z0-9_-]", "-", label)  # a path, not a pattern
        self.root = f"{shared_root(spark)}/{plain}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(self.path(name))
        # the table stands in for its shuffles now: let Spark's cleaner drop their files
        gc.collect()
        self.spark._jvm.System.gc()
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        for name in names:
            self._delete(self.path(name))

    def close(self) -> None:
        self._delete(self.root)

    def _delete(self, path: str) -> None:
        place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(place, True)
