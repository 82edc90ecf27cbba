"""Registry of named queries: one Spark callable and, where SQL can state it, one check per operator."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import DoubleType

from monthgrain.plans.driver_tables import DriverTables
from monthgrain.plans.oracle import with_blocks


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[DriverTables], DataFrame]
    sql: str | None

    def __call__(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return self.build(DriverTables(spark, sf_dir))


REGISTRY: dict[str, Query] = {}


def settle(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Round doubles off ties, so that a different order of addition gives the same printed value."""
    return df.withColumns({c: F.round(F.col(c) + 1e-9, 6) for c in columns})


def doubles(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, DoubleType)]


def query(name: str, sql: str | None = None, rounded: Sequence[str] = ()):
    """Register a query; ``rounded`` columns are settled on both sides."""

    def add(build: Callable[[DriverTables], DataFrame]) -> Callable[[DriverTables], DataFrame]:
        made = (lambda d: settle(build(d), rounded)) if rounded else build
        REGISTRY[name] = Query(name, made, with_blocks(sql, rounded) if sql else None)
        return build

    return add


def load_all() -> dict[str, Query]:
    """Import every query module and return the registry in registration order."""
    from monthgrain.plans import (  # noqa: F401
        queries_anomaly,
        queries_forecast,
        queries_history,
        queries_ingest,
        queries_rows,
    )

    return REGISTRY
