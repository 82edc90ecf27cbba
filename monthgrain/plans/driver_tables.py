"""The wide monthly tables derived from the star-schema test tables.

``orders`` by customer nation and region stand in for the observations: the monthly order count is
``bonds_lodged`` and the mean order price (scaled to rent-like numbers) is ``median_rent``. A mean of exact
decimal sums is used so that the derivation is combined map-side at any size and does not depend on the
order of addition.
"""

from __future__ import annotations

import datetime as dt
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from monthgrain.contracts import LEVEL_AUTHORITY, LEVEL_REGION, REGION_AREA_DEFINITION
from monthgrain.operators import comparison, pooled, quality, seasonal_naive, smoothing, splits
from monthgrain.operators.consolidation import consolidate
from monthgrain.operators.historical_anomalies import detect_historical, practical_historical
from monthgrain.operators.panel import monthly_panel
from monthgrain.operators.residual_anomalies import detect_residual, practical_residual
from monthgrain.session import durable

PROVISIONAL_FROM = "2001-05-01"
PRICE_SCALE = 500
# authority ids are offset so that the fixed list of duplicated series meets some of them
AUTHORITY_OFFSET = 28
POLICY_CUTOFF = "2000-08-01"
TRANSITION = ("2000-01-01", "2001-12-31")

# declared, so that no query starts with a job that reads file footers
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
    "l_shipdate timestamp_ntz",
}


class DriverTables:
    """Lazily built frames of one query; nothing is shared between queries."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.sf_dir}/{name}.parquet")

    # ---- observations ------------------------------------------------------------------

    def _geography(self) -> DataFrame:
        """Nation and region names, two dimension tables of fixed size."""
        nation, region = self.table("nation"), self.table("region")
        return nation.join(region, nation.n_regionkey == region.r_regionkey).select(
            "n_nationkey", "n_name", "r_regionkey", "r_name"
        )

    def _by_nation(self, orders: DataFrame) -> DataFrame:
        """Order count and exact price total per month and nation of all orders: the only pass over ``orders``."""
        customer = self.table("customer").select("c_custkey", "c_nationkey")
        kept = orders.select(
            "o_custkey",
            F.trunc(F.col("o_orderdate").cast("date"), "month").alias("period_date"),
            F.col("o_totalprice").cast("decimal(18,2)").alias("price"),
        )
        return (
            kept.join(customer, F.col("o_custkey") == F.col("c_custkey"))
            .groupBy("period_date", "c_nationkey")
            .agg(F.sum("price").alias("price"), F.count(F.lit(1)).alias("orders"))
        )

    def _wide(self, orders: DataFrame) -> DataFrame:
        """Authority, region and total rows from the per-nation sums (sums add up, so no second scan)."""
        place = lambda level, ident, name: F.struct(
            F.lit(level).alias("geography_level"),
            (ident if isinstance(ident, Column) else F.lit(ident)).cast("int").alias("location_id"),
            (name if isinstance(name, Column) else F.lit(name)).alias("location_name"),
        )
        places = F.array(
            place(LEVEL_AUTHORITY, F.col("n_nationkey") + AUTHORITY_OFFSET, F.col("n_name")),
            place(LEVEL_REGION, F.col("r_regionkey") + 1, F.col("r_name")),
            place(LEVEL_REGION, -99, "ALL"),
        )
        sums = self._by_nation(orders).join(self._geography(), F.col("c_nationkey") == F.col("n_nationkey"))
        return (
            sums.select("period_date", "price", "orders", F.inline(places))
            .groupBy("period_date", "geography_level", "location_id", "location_name")
            .agg(F.sum("price").alias("price"), F.sum("orders").alias("bonds_lodged"))
            .select(
                "period_date",
                "geography_level",
                "location_id",
                "location_name",
                (F.col("price").cast("double") / F.col("bonds_lodged") / PRICE_SCALE).alias("median_rent"),
                "bonds_lodged",
                (F.col("period_date") >= F.lit(PROVISIONAL_FROM).cast("date")).alias("is_provisional"),
                F.year("period_date").cast("bigint").alias("source_snapshot_id"),
            )
        )

    @cached_property
    def clean(self) -> DataFrame:
        return self._wide(self.table("orders"))

    @cached_property
    def market(self) -> DataFrame:
        """Second source: the same measures over orders that have line items.

        The line items are reduced to distinct order keys map-side before the semi join.
        """
        keys = self.table("lineitem").select(F.col("l_orderkey").alias("o_orderkey")).distinct()
        wide = self._wide(self.table("orders").join(keys, "o_orderkey", "left_semi"))
        regions = wide.where(F.col("geography_level") == LEVEL_REGION)
        return regions.select(
            F.col("period_date").alias("period_start"),
            F.last_day("period_date").alias("period_end"),
            F.lit(REGION_AREA_DEFINITION).alias("area_definition"),
            F.col("location_name").alias("area_name"),
            F.lit("ALL").alias("dwelling_type"),
            F.lit("ALL").alias("bedrooms"),
            "median_rent",
            "bonds_lodged",
        )

    @staticmethod
    def raw_bonds(wide: DataFrame) -> DataFrame:
        """Raw-file layout of the observations; the statistics the tables lack are simple functions of them."""
        rent = F.floor("median_rent").cast("bigint")
        lodged = F.col("bonds_lodged")
        return wide.select(
            F.date_format("period_date", "d/MM/yyyy").alias("TimeFrame"),
            "location_id",
            F.col("location_name").alias("location"),
            lodged.alias("LodgedBonds"),
            (lodged * 3).alias("ActiveBonds"),
            F.floor(lodged / 2).cast("bigint").alias("ClosedBonds"),
            rent.alias("MedianRent"),
            (rent - 1).alias("GeometricMeanRent"),
            (rent + 50).alias("UpperQuartileRent"),
            (rent - 50).alias("LowerQuartileRent"),
            F.lit(0.5).alias("LogStdDevWeeklyRent"),
        )

    @cached_property
    def panel(self) -> DataFrame:
        return monthly_panel(self.clean)

    @cached_property
    def stored_panel(self) -> DataFrame:
        """The panel written once, for queries that read it in several branches."""
        return durable(self.panel, "panel")

    # ---- forecasting -------------------------------------------------------------------

    @cached_property
    def complete_before(self) -> dt.date | None:
        """First day of the month that the newest order leaves unfinished; forecasting needs months before it.

        One column of ``orders`` is reduced to its maximum; everything descriptive keeps all months.
        """
        newest = self.table("orders").agg(F.max("o_orderdate").alias("d")).first()["d"]
        return (newest.date() + dt.timedelta(days=1)).replace(day=1) if newest else None

    @cached_property
    def catalog(self) -> DataFrame:
        return quality.series_catalog(self.stored_panel)

    @cached_property
    def selected(self) -> DataFrame:
        """Modelled rows, found in the same window pass that later operators partition by."""
        return splits.select_trailing_runs(self.panel, before=self.complete_before)

    @cached_property
    def modelled(self) -> DataFrame:
        """The same rows from the stored panel, for queries that read them in several branches."""
        return splits.select_trailing_runs(self.stored_panel, before=self.complete_before)

    @cached_property
    def naive(self) -> DataFrame:
        return seasonal_naive.naive_backtest(self.selected)

    @cached_property
    def smoothed(self) -> DataFrame:
        return smoothing.smoothing_backtest(self.selected)

    @cached_property
    def predictions(self) -> DataFrame:
        """Both deterministic models' rolling-origin predictions, written once."""
        frames = [seasonal_naive.naive_backtest(self.modelled), smoothing.smoothing_backtest(self.modelled)]
        return durable(comparison.combine_predictions(frames), "predictions")

    @cached_property
    def all_predictions(self) -> DataFrame:
        """Rolling-origin predictions of all three models; the trained one comes from its store, or is trained into it."""
        frames = [
            seasonal_naive.naive_backtest(self.modelled),
            smoothing.smoothing_backtest(self.modelled),
            pooled.boosted_backtest(self.modelled),
        ]
        return durable(comparison.combine_predictions(frames), "all-predictions")

    @cached_property
    def by_series(self) -> DataFrame:
        return comparison.metrics_by_series(self.predictions)

    @cached_property
    def winners(self) -> DataFrame:
        return comparison.series_winners(self.by_series)

    # ---- anomalies ---------------------------------------------------------------------

    @cached_property
    def historical(self) -> DataFrame:
        return practical_historical(detect_historical(self.panel))

    @cached_property
    def residual(self) -> DataFrame:
        return practical_residual(detect_residual(self.predictions, self.winners))

    @cached_property
    def summary(self) -> DataFrame:
        historical = practical_historical(detect_historical(self.stored_panel))
        return consolidate(historical, self.residual)

    @cached_property
    def stored_summary(self) -> DataFrame:
        return durable(self.summary, "summary")
