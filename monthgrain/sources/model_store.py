"""Trained models and their predictions in the shared folder, found again by a fingerprint of what they were trained on.

An entry is a folder ``kind/fingerprint/attempt``; its ``done`` table is written last, so that an entry that was cut short is
never read, and two writers of one entry do not meet.  Nothing is overwritten: equal fingerprints stand for equal content.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from monthgrain.session import durable_root


def digest(*parts: object) -> str:
    """Fingerprint of plain values."""
    return hashlib.sha256(json.dumps(parts, sort_keys=True, default=str).encode()).hexdigest()[:32]


def content(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """Row count and two order-free sums of row hashes per group of ``by``: equal for equal rows in any order."""
    columns = sorted(c for c in rows.columns if c not in by)
    hashed = F.xxhash64(*columns)
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.bit_xor(hashed).alias("x"),
        F.sum(F.shiftright(hashed, 16)).alias("s"),
    )


class Store:
    """Entries under the session's shared folder."""

    def __init__(self, spark: SparkSession, root: str | None = None) -> None:
        self.spark = spark
        self.root = (root or f"{durable_root(spark)}/_store").rstrip("/")

    def find(self, kind: str, key: str) -> str | None:
        """Folder of a finished attempt."""
        pattern = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{kind}/{key}/*/done/_SUCCESS")
        found = pattern.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(pattern)
        places = sorted(str(f.getPath().getParent().getParent()) for f in found or [])
        return places[0] if places else None

    def put(self, kind: str, key: str, write: Callable[[str], None]) -> str:
        """Let ``write`` fill a new attempt, then mark it as finished."""
        path = f"{self.root}/{kind}/{key}/{uuid.uuid4().hex}"
        write(path)
        self.spark.range(1).coalesce(1).write.parquet(f"{path}/done")
        return path

    def get(self, kind: str, key: str, write: Callable[[str], None]) -> str:
        """The entry, made by ``write`` where it is missing."""
        return self.find(kind, key) or self.put(kind, key, write)
