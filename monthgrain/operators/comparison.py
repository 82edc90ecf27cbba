"""Model evaluation and comparison."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from monthgrain.contracts import (
    MODEL_NAIVE,
    MODEL_ORDER,
    PREDICTION_COLUMNS,
    SERIES_ATTRS,
    require_columns,
)
from monthgrain.functions.scoring import error_metrics
from monthgrain.operators.joins import checked_join

MEASURES = ("mae", "rmse", "smape")


def combine_predictions(frames: Sequence[DataFrame]) -> DataFrame:
    """Union of model frames; run the prediction and alignment checks on the result."""
    if len(frames) < 2:
        raise ValueError("at least two model prediction frames are required")
    for f in frames:
        require_columns(f, PREDICTION_COLUMNS, "predictions")
    return reduce(lambda a, b: a.unionByName(b), [f.select(*PREDICTION_COLUMNS) for f in frames])


def union_loose(frames: Sequence[DataFrame]) -> DataFrame:
    """Union of frames with different columns; absent ones become NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def model_position(model: Column) -> Column:
    """Place of a model in the fixed order, unknown models last."""
    places = F.create_map(*[F.lit(x) for i, m in enumerate(MODEL_ORDER) for x in (m, i)])
    return F.coalesce(F.try_element_at(places, model), F.lit(len(MODEL_ORDER)))


def in_model_order(predictions: DataFrame) -> DataFrame:
    return predictions.orderBy(model_position(F.col("model")), "series_id", "origin", "horizon_step")


def metrics_by_origin(predictions: DataFrame) -> DataFrame:
    return predictions.groupBy("model", "series_id", *SERIES_ATTRS, "origin").agg(
        F.count(F.lit(1)).alias("n_forecasts"), *error_metrics()
    )


def metrics_by_series(predictions: DataFrame) -> DataFrame:
    """The origins of a series are few, so their distinct count is a bounded set, not a second exchange."""
    return predictions.groupBy("model", "series_id", *SERIES_ATTRS).agg(
        F.size(F.collect_set("origin")).cast("bigint").alias("n_origins"),
        F.count(F.lit(1)).alias("n_forecasts"),
        *error_metrics(),
    )


def _error_sums() -> list[Column]:
    a, p = F.col("actual"), F.col("predicted")
    size = F.abs(a) + F.abs(p)
    return [
        F.sum(F.abs(a - p)).alias("_abs"),
        F.sum((a - p) * (a - p)).alias("_sq"),
        F.sum(F.when(size == 0, F.lit(0.0)).otherwise(F.lit(2.0) * F.abs(a - p) / size)).alias("_sym"),
        F.count(F.lit(1)).alias("_n"),
    ]


def _pooled(predictions: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Metrics over groups that hold many series.

    Error sums are taken per (group, series) first and added up per group, so a group with a large part
    of all rows is combined in parallel and counting distinct series is counting rows.
    """
    per_series = predictions.groupBy(*keys, "series_id").agg(*_error_sums())
    return per_series.groupBy(*keys).agg(*_pooled_aggs())


def _pooled_aggs() -> list[Column]:
    n = F.sum("_n")
    return [
        F.count(F.lit(1)).alias("n_series"),
        n.alias("n_forecasts"),
        (F.sum("_abs") / n).alias("mae"),
        F.sqrt(F.sum("_sq") / n).alias("rmse"),
        (F.sum("_sym") / n * 100.0).alias("smape"),
    ]


def metrics_by_horizon(predictions: DataFrame) -> DataFrame:
    return _pooled(predictions, ("model", "metric", "horizon_step"))


def model_summary(predictions: DataFrame) -> DataFrame:
    """Overall row and one row per metric for each model, from a single rollup of the error sums."""
    per_series = predictions.groupBy("model", "metric", "series_id").agg(*_error_sums())
    rolled = per_series.groupingSets([["model"], ["model", "metric"]], "model", "metric").agg(
        F.grouping("metric").alias("_all"), *_pooled_aggs()
    )
    return rolled.select(
        "model",
        F.when(F.col("_all") == 1, "overall").otherwise("metric").alias("scope"),
        F.when(F.col("_all") == 1, "all").otherwise(F.col("metric")).alias("metric"),
        "n_series",
        "n_forecasts",
        *MEASURES,
    )


def model_comparison(predictions: DataFrame, baseline: str = MODEL_NAIVE) -> DataFrame:
    """Metrics, ranks and improvement over the baseline for every model and metric."""
    scores = _pooled(predictions, ("model", "metric"))
    ranks = {
        f"rank_{m}": F.rank().over(Window.partitionBy("metric").orderBy(m)) for m in MEASURES
    }
    base = scores.where(F.col("model") == baseline).select("metric", *[F.col(m).alias(f"_base_{m}") for m in MEASURES])
    joined = checked_join(scores.withColumns(ranks), base, ["metric"], "left", "baseline")
    absent = F.raise_error(F.lit("the baseline model is missing for a metric")).cast("double")
    better = {}
    for m in MEASURES:
        b = F.col(f"_base_{m}")
        b = F.when(b.isNull(), absent).otherwise(b)
        better[f"{m}_improvement_vs_baseline_pct"] = F.when(b != 0, (b - F.col(m)) / b * 100.0)
    return joined.withColumns(better).drop(*[f"_base_{m}" for m in MEASURES])


def series_winners(by_series: DataFrame) -> DataFrame:
    """Best model of each series by (smape, mae, rmse, model)."""
    require_columns(by_series, ("model", "series_id", *SERIES_ATTRS, *MEASURES), "series metrics")
    order = F.struct(*[F.coalesce(F.col(m), F.lit(float("inf"))) for m in ("smape", "mae", "rmse")], F.col("model"))
    best = by_series.groupBy("series_id").agg(
        F.min_by(F.struct(*SERIES_ATTRS, "model", *MEASURES), order).alias("b")
    )
    return best.select(
        "series_id",
        *[F.col(f"b.{c}").alias(c) for c in SERIES_ATTRS],
        F.col("b.model").alias("best_model"),
        *[F.col(f"b.{m}").alias(f"best_{m}") for m in MEASURES],
    )


def winner_counts(winners: DataFrame, models: Sequence[str] = MODEL_ORDER) -> DataFrame:
    """Series won per metric and model with shares; models without a win are listed with zero."""
    counts = winners.groupBy("metric", F.col("best_model").alias("model")).agg(F.count(F.lit(1)).alias("series_count"))
    listed = counts.select("metric").distinct().withColumn("model", F.explode(F.array(*[F.lit(m) for m in models])))
    full = listed.join(counts, ["metric", "model"], "left").withColumn(
        "series_count", F.coalesce(F.col("series_count"), F.lit(0)).cast("bigint")
    )
    total = F.sum("series_count").over(Window.partitionBy("metric"))
    return full.withColumn("share_pct", F.when(total > 0, F.col("series_count") / total * 100.0).otherwise(0.0))


def headline_winner(comparison: DataFrame) -> DataFrame:
    """Best model of each metric by (rank_mae, mae)."""
    order = F.struct("rank_mae", "mae", "model")
    return comparison.groupBy("metric").agg(
        F.min_by("model", order).alias("best_model"), F.min_by("mae", order).alias("best_mae")
    )
