"""Joins whose cardinality is checked."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from monthgrain.contracts import duplicated_series_ids


def unique_side(df: DataFrame, on: Sequence[str], what: str) -> DataFrame:
    """``df``, failing the job when a key occurs twice.

    The repeats are found by a map-side-combined count. The surviving row is taken inside the same
    aggregation, so the check costs one exchange on the join key, which the join then reuses.
    """
    rest = [c for c in df.columns if c not in on]
    counted = df.groupBy(*on).agg(F.count(F.lit(1)).alias("_n"), *[F.first(c).alias(c) for c in rest])
    message = F.lit(f"{what}: the join key occurs more than once")
    guard = F.when(F.col("_n") > 1, F.raise_error(message)).otherwise(F.lit(True))
    return counted.where(guard).select(*df.columns)


def checked_join(many: DataFrame, one: DataFrame, on: Sequence[str], how: str = "inner", what: str = "join") -> DataFrame:
    """Many-to-one join. Whether the small side is broadcast is left to Spark, which knows its size."""
    return many.join(unique_side(one, on, what), list(on), how)


def one_to_one_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner", what: str = "join") -> DataFrame:
    return unique_side(left, on, what).join(unique_side(right, on, what), list(on), how)


def without_duplicated_series(df: DataFrame) -> DataFrame:
    """Leave out the reviewed authority series that repeat a region series (a fixed list of ten)."""
    return df.where(~F.col("series_id").isin(*duplicated_series_ids()))


def beside(*frames: DataFrame) -> DataFrame:
    """One-row frames side by side in one row: united by name, then every column's only value is kept."""
    united = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return united.agg(*[F.max(c).alias(c) for f in frames for c in f.columns])


def repeated_keys(df: DataFrame, on: Sequence[str]) -> DataFrame:
    return df.groupBy(*on).agg(F.count(F.lit(1)).alias("n_rows")).where(F.col("n_rows") > 1)
