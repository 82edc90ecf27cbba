"""Held-out evaluation of model selection policies."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, functions as F

from monthgrain.contracts import FIXED_POLICY_PREFIX, PER_SERIES_POLICY, ContractError, require_columns
from monthgrain.functions.scoring import smape
from monthgrain.operators.comparison import _error_sums, _pooled_aggs
from monthgrain.operators.joins import checked_join

NEEDED = ("model", "series_id", "metric", "origin", "forecast_period", "actual", "predicted")


def split_by_cutoff(predictions: DataFrame, cutoff: str | dt.date) -> tuple[DataFrame, DataFrame]:
    """Selection targets up to the cutoff; evaluation origins from it with targets after it.

    The two target ranges cannot overlap by construction; :func:`cutoff_checks` reports empty sides
    and a cutoff that is no origin.
    """
    require_columns(predictions, NEEDED, "predictions")
    cut = F.lit(cutoff).cast("date")
    selection = predictions.where(F.col("forecast_period") <= cut)
    evaluation = predictions.where((F.col("origin") >= cut) & (F.col("forecast_period") > cut))
    return selection, evaluation


def cutoff_facts(predictions: DataFrame, cutoff: str | dt.date) -> DataFrame:
    """Rows and target span of each side, common targets and whether the cutoff is an origin."""
    cut = F.lit(cutoff).cast("date")
    target, origin = F.col("forecast_period"), F.col("origin")
    chosen, tested = target <= cut, (origin >= cut) & (target > cut)
    per_target = predictions.groupBy("forecast_period").agg(
        F.count_if(chosen).alias("s"), F.count_if(tested).alias("e"), F.count_if(origin == cut).alias("o")
    )
    s, e = F.col("s"), F.col("e")
    return per_target.agg(
        F.sum("s").alias("selection_rows"),
        F.min(F.when(s > 0, target)).alias("selection_start"),
        F.max(F.when(s > 0, target)).alias("selection_end"),
        F.sum("e").alias("evaluation_rows"),
        F.min(F.when(e > 0, target)).alias("evaluation_start"),
        F.max(F.when(e > 0, target)).alias("evaluation_end"),
        F.count_if((s > 0) & (e > 0)).alias("target_overlap"),
        (F.sum("o") > 0).alias("cutoff_is_origin"),
    )


def assert_cutoff(predictions: DataFrame, cutoff: str | dt.date) -> DataFrame:
    facts = cutoff_facts(predictions, cutoff)
    row = facts.first()
    if not row.selection_rows or not row.evaluation_rows:
        raise ContractError("the selection or the evaluation period holds no forecasts")
    if not row.cutoff_is_origin:
        raise ContractError("the cutoff is not a prediction origin")
    return facts


def selection_winners(selection: DataFrame) -> DataFrame:
    """Lowest-sMAPE model of each series on the selection targets, ties by model name."""
    scores = selection.groupBy("series_id", "model").agg(
        smape(F.col("actual"), F.col("predicted")).alias("selection_smape")
    )
    best = scores.groupBy("series_id").agg(
        F.min(F.struct("selection_smape", "model")).alias("b")
    )
    return best.select("series_id", F.col("b.model").alias("model"), F.col("b.selection_smape").alias("selection_smape"))


def evaluate_policies(evaluation: DataFrame, winners: DataFrame) -> DataFrame:
    """sMAPE of per-series selection and of every fixed model, overall and per metric.

    Error sums are taken once per (model, metric, series); tagging with the policies and scopes then
    multiplies only that small frame, never the predictions.
    """
    require_columns(evaluation, NEEDED, "evaluation")
    sums = evaluation.groupBy("model", "metric", "series_id").agg(*_error_sums())
    chosen = winners.select("series_id", F.col("model").alias("_chosen"))
    tagged = checked_join(sums, chosen, ["series_id"], "left", "selection winners")
    no_winner = F.raise_error(F.lit("every evaluated series needs exactly one selection winner")).cast("string")
    fixed = F.concat(F.lit(FIXED_POLICY_PREFIX), F.col("model"))
    fixed = F.when(F.col("_chosen").isNull(), no_winner).otherwise(fixed)
    selected = F.when(F.col("model") == F.col("_chosen"), F.lit(PER_SERIES_POLICY))
    rows = (
        tagged.withColumn("policy", F.explode(F.array_compact(F.array(fixed, selected))))
        .withColumn("scope", F.explode(F.array(F.lit("all"), F.col("metric"))))
    )
    return rows.groupBy("scope", "policy").agg(*_pooled_aggs()).select("scope", "policy", "n_series", "n_forecasts", "smape")
