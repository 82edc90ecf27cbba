"""Evidence about the historical detector: transition rates, shock recovery, threshold sweep."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from monthgrain.contracts import SHOCK_SIZE, SWEEP_THRESHOLDS, require_columns
from monthgrain.functions.parsing import month_number
from monthgrain.functions.scoring import is_true
from monthgrain.operators.checks import check_table, violation
from monthgrain.operators.historical_anomalies import detect_historical
from monthgrain.operators.joins import beside

# The documented change of the source system
TRANSITION_START = dt.date(2025, 1, 1)
TRANSITION_END = dt.date(2026, 12, 31)

SHOCKED_SERIES = "_shocked_series"


def in_transition(df: DataFrame, start: dt.date = TRANSITION_START, end: dt.date = TRANSITION_END) -> DataFrame:
    return df.withColumn("in_transition", F.col("period_date").between(F.lit(start), F.lit(end)))


def transition_rates(
    anomalies: DataFrame, start: dt.date = TRANSITION_START, end: dt.date = TRANSITION_END
) -> DataFrame:
    """Anomaly and alert rates in the transition and in an equally long window just before it.

    Rows are summed per month first; both windows are then conditional sums over a calendar-sized frame.
    """
    need = ("period_date", "historical_score_available", "historical_is_anomaly", "dashboard_alert")
    require_columns(anomalies, need, "historical anomalies")
    scored = is_true(F.col("historical_score_available"))
    monthly = anomalies.groupBy("period_date").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(scored).alias("scored"),
        F.count_if(scored & is_true(F.col("historical_is_anomaly"))).alias("flagged"),
        F.count_if(is_true(F.col("dashboard_alert"))).alias("alerts"),
    )
    last = monthly.agg(F.least(F.max("period_date"), F.lit(end))).scalar()
    months = (month_number(last) - month_number(F.lit(start)) + 1).cast("int")
    windows = {
        "pre_transition_comparison": (F.add_months(F.lit(start), -months), F.add_months(F.lit(start), -1)),
        "bond_hub_transition": (F.lit(start), last),
    }

    def totals(name: str) -> Column:
        lo, hi = windows[name]
        inside = F.col("period_date").between(lo, hi)
        added = lambda c: F.coalesce(F.sum(F.when(inside, F.col(c))), F.lit(0)).cast("bigint")
        return F.struct(
            F.lit(name).alias("period"),
            F.any_value(lo).alias("start_date"),
            F.any_value(hi).alias("end_date"),
            F.any_value(months).alias("months"),
            added("rows").alias("rows"),
            added("scored").alias("scored_observations"),
            added("flagged").alias("statistical_anomalies"),
            added("alerts").alias("dashboard_alerts"),
        )

    counts = monthly.agg(F.array(*[totals(name) for name in windows]).alias("windows")).select(F.inline("windows"))
    n = F.col("scored_observations")
    rate = lambda c: F.when(n > 0, F.col(c) / n).otherwise(0.0)
    return counts.withColumns(
        {
            "evaluation": F.lit("transition_period"),
            "statistical_anomaly_rate": rate("statistical_anomalies"),
            "dashboard_alert_rate": rate("dashboard_alerts"),
        }
    )


def shocked_last_scores(panel: DataFrame, shocks: Sequence[float] = (SHOCK_SIZE, -SHOCK_SIZE)) -> DataFrame:
    """Score of the newest month of every series after adding each shock to it.

    Both scenarios are scored in one detector pass: the scenario becomes part of the series key.
    """
    newest = F.row_number().over(Window.partitionBy("series_id").orderBy(F.col("period_date").desc())) == 1
    marked = panel.select("series_id", "period_date", "value", "metric", newest.alias("_newest"))
    scenarios = F.array(*[F.lit(float(s)) for s in shocks])
    tried = marked.withColumn("shock_value", F.explode(scenarios)).withColumns(
        {
            "value": F.col("value") + F.when(F.col("_newest"), F.col("shock_value")).otherwise(0.0),
            SHOCKED_SERIES: F.col("series_id"),
            "series_id": F.concat_ws("|", "series_id", F.col("shock_value").cast("string")),
        }
    )
    scored = detect_historical(tried).where("_newest")
    return scored.withColumn("series_id", F.col(SHOCKED_SERIES)).drop(SHOCKED_SERIES, "_newest")


def shock_recovery(panel: DataFrame, shocks: Sequence[float] = (SHOCK_SIZE, -SHOCK_SIZE)) -> DataFrame:
    """Was the injected shock flagged in the right direction, for every real series at once?"""
    expected = F.when(F.col("shock_value") > 0, "high").otherwise("low")
    hit = F.col("historical_is_anomaly") & (F.col("historical_direction") == expected)
    return shocked_last_scores(panel, shocks).select(
        F.lit("synthetic_injection").alias("evaluation"),
        F.when(F.col("shock_value") > 0, "positive_shock").otherwise("negative_shock").alias("scenario"),
        "series_id",
        "metric",
        "shock_value",
        F.lit(True).alias("expected_anomaly"),
        F.col("historical_is_anomaly").alias("detected_anomaly"),
        expected.alias("expected_direction"),
        F.col("historical_direction").alias("observed_direction"),
        F.col("historical_severity").alias("severity"),
        F.col("historical_score").alias("score"),
        hit.alias("passed"),
    )


def threshold_sweep(panel: DataFrame, thresholds: Sequence[float] = SWEEP_THRESHOLDS) -> DataFrame:
    """Shock recovery and background alert rate at each threshold.

    Scores are compared with all thresholds inside one aggregation; no score x threshold rows are made.
    """
    size = F.abs("historical_score")

    def reached(prefix: str):
        return [F.count_if(size >= t).alias(f"{prefix}{i}") for i, t in enumerate(thresholds)]

    shocked = shocked_last_scores(panel).agg(F.count("historical_score").alias("cases"), *reached("hit"))
    clean = detect_historical(panel).agg(F.count("historical_score").alias("scored"), *reached("alert"))
    rows = F.array(
        *[
            F.struct(
                F.lit(float(t)).alias("threshold"),
                F.col(f"hit{i}").alias("injected_recovered"),
                F.col(f"alert{i}").alias("background_alerts"),
            )
            for i, t in enumerate(thresholds)
        ]
    )
    swept = beside(shocked, clean).select("cases", "scored", F.inline(rows))
    rate = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    return swept.select(
        F.lit("threshold_sensitivity").alias("evaluation"),
        "threshold",
        F.col("cases").alias("injected_cases"),
        "injected_recovered",
        rate("injected_recovered", "cases").alias("injection_recovery_rate"),
        F.col("scored").alias("background_scored_observations"),
        "background_alerts",
        rate("background_alerts", "scored").alias("background_alert_rate"),
    )


def evaluation_checks(summary: DataFrame, injected_rows: int, thresholds: int = len(SWEEP_THRESHOLDS)) -> DataFrame:
    """Groups, row counts, rates and window lengths of the unified evaluation table."""
    require_columns(summary, ("evaluation_group", "evaluation"), "evaluation summary")
    group = F.col("evaluation_group")
    outside = lambda c: F.count_if(~F.col(c).between(0.0, 1.0))
    per_group = summary.groupBy("evaluation_group").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(~is_true(F.col("passed"))).alias("not_passed"),
        (outside("injection_recovery_rate") + outside("background_alert_rate")).alias("bad_rate"),
        F.size(F.collect_set("months")).alias("lengths"),
    )
    known = ("synthetic_injection", "threshold_sensitivity", "transition_period")
    rows = lambda name: F.coalesce(F.max(F.when(group == name, F.col("n"))), F.lit(0))
    totals = per_group.agg(
        violation(
            F.abs(F.count_if(group.isin(*known)) - 3) + F.count_if(~F.coalesce(group.isin(*known), F.lit(False))), "known_groups"
        ),
        violation(F.abs(rows("synthetic_injection") - injected_rows), "injection_rows"),
        violation(F.abs(rows("threshold_sensitivity") - thresholds), "sensitivity_rows"),
        violation(F.sum("bad_rate"), "valid_rates"),
        violation(F.abs(rows("transition_period") - 2), "transition_rows"),
        violation(F.max(F.when(group == "transition_period", F.col("lengths"))) - 1, "equal_windows"),
    )
    return check_table(
        totals,
        {
            "known_groups": "Exactly the three evaluation groups must be present.",
            "injection_rows": "One row per injected scenario.",
            "sensitivity_rows": "One row per threshold.",
            "valid_rates": "Rates must lie between 0 and 1.",
            "transition_rows": "One row per window.",
            "equal_windows": "Transition and comparison windows must have equal length.",
        },
    )
