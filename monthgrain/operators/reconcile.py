"""Reconciliation of two monthly sources by region."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from monthgrain.contracts import (
    AGGREGATE_LOCATION_IDS,
    BONDS_PCT_TOLERANCE,
    LEVEL_REGION,
    MEDIAN_TOLERANCE,
    REGION_AREA_DEFINITION,
    TOTAL_CATEGORY,
    UNKNOWN_CATEGORY,
)
from monthgrain.operators.joins import beside


def market_region_rows(market: DataFrame) -> DataFrame:
    """Named region totals of the market source."""
    return market.where(
        (F.col("area_definition") == REGION_AREA_DEFINITION)
        & (F.col("dwelling_type") == TOTAL_CATEGORY)
        & (F.col("bedrooms") == TOTAL_CATEGORY)
        & ~F.col("area_name").isin(TOTAL_CATEGORY, UNKNOWN_CATEGORY)
    )


def bond_region_rows(bonds: DataFrame) -> DataFrame:
    """Named region rows of the bond source."""
    return bonds.where(
        (F.col("geography_level") == LEVEL_REGION) & ~F.col("location_id").isin(*AGGREGATE_LOCATION_IDS)
    )


def latest_common_period(market: DataFrame, bonds: DataFrame) -> DataFrame:
    """Newest month present in both sources, as a one-row frame (NULL when there is none)."""
    left = market_region_rows(market).select(F.col("period_start").alias("period_date"))
    right = bond_region_rows(bonds).select("period_date")
    return left.intersect(right).agg(F.max("period_date").alias("period_date"))


def at_period(market: DataFrame, bonds: DataFrame, period: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Region rows of both sources at one period; the period is a one-row frame."""
    one = F.broadcast(period)
    left = market_region_rows(market).withColumnRenamed("period_start", "period_date").join(one, "period_date")
    right = bond_region_rows(bonds).join(one, "period_date")
    return (
        left.select(
            F.col("area_name").alias("region"),
            F.col("median_rent").alias("market_median_rent"),
            F.col("bonds_lodged").alias("market_bonds_lodged"),
        ),
        right.select(
            F.col("location_name").alias("region"),
            F.col("median_rent").alias("rental_median_rent"),
            F.col("bonds_lodged").alias("rental_bonds_lodged"),
        ),
    )


def match_regions(market_rows: DataFrame, bond_rows: DataFrame) -> DataFrame:
    """Every region once, with the side it is missing on."""
    left = market_rows.withColumn("_m", F.lit(True))
    right = bond_rows.withColumn("_r", F.lit(True))
    state = (
        F.when(F.col("_m").isNull(), "missing_in_market").when(F.col("_r").isNull(), "missing_in_rental").otherwise("matched")
    )
    return left.join(right, "region", "full").withColumn("match", state).drop("_m", "_r")


def compare_sources(
    market_rows: DataFrame,
    bond_rows: DataFrame,
    median_tolerance: float = MEDIAN_TOLERANCE,
    bonds_pct_tolerance: float = BONDS_PCT_TOLERANCE,
) -> DataFrame:
    """Signed differences and PASS/WARN per matched region; a zero reference count warns."""
    rows = match_regions(market_rows, bond_rows).where(F.col("match") == "matched")
    median_gap = F.col("market_median_rent") - F.col("rental_median_rent")
    bonds_gap = F.col("market_bonds_lodged") - F.col("rental_bonds_lodged")
    reference = F.col("rental_bonds_lodged")
    pct = F.when(reference != 0, bonds_gap / reference * 100.0)
    verdict = lambda ok: F.when(ok, "PASS").otherwise("WARN")
    return rows.select(
        "region",
        "market_median_rent",
        "rental_median_rent",
        median_gap.alias("median_rent_difference"),
        verdict(F.abs(median_gap) <= median_tolerance).alias("median_rent_status"),
        "market_bonds_lodged",
        "rental_bonds_lodged",
        bonds_gap.alias("bonds_lodged_difference"),
        pct.alias("bonds_lodged_difference_pct"),
        verdict(F.abs(pct) <= bonds_pct_tolerance).alias("bonds_lodged_status"),
    )


def cross_source_verdict(market_rows: DataFrame, bond_rows: DataFrame, **tolerances: float) -> DataFrame:
    """One row: counts per side and status, and the overall verdict."""
    matches = match_regions(market_rows, bond_rows).agg(
        F.count_if(F.col("match") != "missing_in_market").alias("market_region_count"),
        F.count_if(F.col("match") != "missing_in_rental").alias("rental_region_count"),
        F.count_if(F.col("match") == "matched").alias("matched_region_count"),
        F.count_if(F.col("match") == "missing_in_market").alias("missing_in_market"),
        F.count_if(F.col("match") == "missing_in_rental").alias("missing_in_rental"),
    )
    counts = compare_sources(market_rows, bond_rows, **tolerances).agg(
        F.count_if(F.col("median_rent_status") == "PASS").alias("median_pass_count"),
        F.count_if(F.col("median_rent_status") == "WARN").alias("median_warn_count"),
        F.count_if(F.col("bonds_lodged_status") == "PASS").alias("bonds_pass_count"),
        F.count_if(F.col("bonds_lodged_status") == "WARN").alias("bonds_warn_count"),
    )
    missing = F.col("missing_in_market") + F.col("missing_in_rental") > 0
    warned = F.col("median_warn_count") + F.col("bonds_warn_count") > 0
    return beside(matches, counts).withColumn(
        "overall_status", F.when(missing, "FAIL").when(warned, "WARN").otherwise("PASS")
    )
