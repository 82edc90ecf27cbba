"""Snapshot ledger, keyed upserts and the load of one staging snapshot."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from monthgrain.contracts import ContractError, require_columns

LEDGER_KEY = ("source_name", "checksum_sha256")
BOND_KEY = ("period_date", "geography_level", "location_id")
RENT_KEY = ("period_start", "period_end", "area_definition", "area_name", "dwelling_type", "bedrooms")
LEDGER_SCHEMA = "snapshot_id bigint, source_name string, checksum_sha256 string, file_name string, row_count bigint, status string"


def snapshot_id(source_name: Column, checksum: Column) -> Column:
    """Identifier computed from the ledger key (60 bits of its hash), so that it needs no sequence."""
    digest = F.sha2(F.concat_ws(":", source_name, checksum), 256)
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")


def register_snapshots(ledger: DataFrame, incoming: DataFrame) -> DataFrame:
    """Ledger with the incoming snapshots added where their key is new; existing rows stay as they are.

    Repeats inside ``incoming`` collapse map-side to the smallest file name.
    """
    require_columns(incoming, (*LEDGER_KEY, "file_name", "row_count"), "snapshots to register")
    first = incoming.groupBy(*LEDGER_KEY).agg(F.min(F.struct("file_name", "row_count")).alias("f"))
    fresh = first.join(ledger.select(*LEDGER_KEY), list(LEDGER_KEY), "left_anti").select(
        snapshot_id(F.col("source_name"), F.col("checksum_sha256")).alias("snapshot_id"),
        *LEDGER_KEY,
        "f.file_name",
        "f.row_count",
        F.lit("validated").alias("status"),
    )
    return ledger.unionByName(fresh)


def mark_loaded(ledger: DataFrame, ident: int | Column, row_count: int | Column) -> DataFrame:
    """Ledger with the status and row count of one snapshot updated."""
    ident = ident if isinstance(ident, Column) else F.lit(ident)
    rows = row_count if isinstance(row_count, Column) else F.lit(row_count)
    hit = F.col("snapshot_id") == ident
    return ledger.withColumns(
        {
            "status": F.when(hit, "loaded").otherwise(F.col("status")),
            "row_count": F.when(hit, rows.cast("bigint")).otherwise(F.col("row_count")),
        }
    )


def newest_versions(rows: DataFrame, key: Sequence[str], load_order: str = "load_seq") -> DataFrame:
    """The row of the last load for every key.

    An aggregation instead of a ranking window: versions of a key are combined map-side, so a key that
    was revised very often is no hot partition and nothing is sorted.
    """
    require_columns(rows, (*key, load_order), "versioned rows")
    rest = [c for c in rows.columns if c not in (*key, load_order)]
    newest = rows.groupBy(*key).agg(F.max(F.struct(load_order, *rest)).alias("_row"))
    return newest.select(*key, "_row.*").select(*rows.columns)


def upsert(existing: DataFrame, incoming: DataFrame, key: Sequence[str], load_order: str = "load_seq") -> DataFrame:
    """Existing rows with the incoming ones written over them by key; the later load wins."""
    require_columns(incoming, (*key, load_order), "incoming rows")
    return newest_versions(existing.unionByName(incoming.select(*existing.columns)), key, load_order)


@dataclass(frozen=True)
class LoadedTable:
    """A keyed table stored as one folder per load; readers see the newest version of every key.

    A load writes its own folder and never rewrites what is there, so its cost follows the snapshot and
    not the table. Loading again under the same number replaces that folder with the same rows. When
    many loads have piled up, :meth:`compact` folds them into a fresh root.
    """

    spark: SparkSession
    root: str
    schema: str
    key: tuple[str, ...]

    def append(self, rows: DataFrame, load_seq: int) -> None:
        names = [f.name for f in self.versions().schema.fields if f.name != "load_seq"]
        require_columns(rows, names, "rows to load")
        rows.select(*names).write.mode("overwrite").parquet(f"{self.root.rstrip('/')}/load_seq={load_seq}")

    def versions(self) -> DataFrame:
        """Every loaded row with the number of its load (a partition column, pruned by filters on it)."""
        schema = f"{self.schema}, load_seq bigint"
        try:
            return self.spark.read.schema(schema).parquet(self.root)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def read(self) -> DataFrame:
        return newest_versions(self.versions(), self.key)

    def compact(self, root: str) -> LoadedTable:
        """Same content under ``root`` as one load that keeps the order with later ones."""
        last = self.versions().agg(F.max("load_seq").alias("n")).first().n
        folded = LoadedTable(self.spark, root, self.schema, self.key)
        if last is not None:
            folded.append(self.read(), last)
        return folded


def load_snapshot(
    rows: DataFrame,
    table: LoadedTable,
    ledger: LoadedTable,
    *,
    source_name: str,
    checksum: str,
    file_name: str,
    retrieved_at: dt.datetime,
    load_seq: int,
) -> int:
    """One unit of work: register the snapshot, write its typed rows, mark it loaded; returns the row count.

    The ledger entry is written last, so a snapshot listed as loaded is complete. Running it again with
    the same snapshot and number gives the same tables.
    """
    n = rows.count()
    if n == 0:
        raise ContractError("no records were provided for loading")
    entry = rows.sparkSession.createDataFrame(
        [(source_name, checksum, file_name, n)],
        "source_name string, checksum_sha256 string, file_name string, row_count bigint",
    )
    ident = snapshot_id(F.lit(source_name), F.lit(checksum))
    table.append(rows.withColumns({"source_snapshot_id": ident, "retrieved_at": F.lit(retrieved_at)}), load_seq)
    known = register_snapshots(ledger.read().drop("load_seq"), entry).where(F.col("snapshot_id") == ident)
    # a single ledger row, detached from the folder that a repeated load replaces
    marked = mark_loaded(known, ident, n)
    ledger.append(rows.sparkSession.createDataFrame(marked.collect(), marked.schema), load_seq)
    return n
