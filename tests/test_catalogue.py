from __future__ import annotations

import os
import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from monthgrain.plans.driver_tables import DriverTables

SF = "/root/testdata/sf0.001"
present = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are not here")


def executed(df) -> str:
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.split("== Initial Plan ==")[0]


def test_every_check_has_a_query():
    queries, checks = entry.queries(), entry.oracle_sql()
    assert set(checks) <= set(queries) and len(queries) >= 140
    assert all(re.fullmatch(r"[a-z]\d\d_[a-z0-9_]+|op\d+_[a-z0-9_]+|pipeline", name) for name in queries)


@present
def test_flagship_runs_once_over_orders_with_one_series_exchange(spark):
    plan = executed(entry.entry(spark))
    assert len(re.findall(r"FileScan parquet [^\n]*orders\.parquet", plan)) == 1
    assert not re.search(r"(LessThan|GreaterThan)\w*\(o_orderdate", plan)  # no date drops orders
    assert re.search(r"ReadSchema: struct<o_custkey:bigint,o_totalprice:double,o_orderdate:timestamp_ntz>", plan)
    # month-nation sums, month-place sums, series windows
    assert len(re.findall(r"- Exchange hashpartitioning", plan)) == 3
    assert len(re.findall(r"Exchange hashpartitioning\(series_id", plan)) == 1


@present
@pytest.mark.parametrize("name, exchanges", [("w03_feature_frame", 3), ("a01_series_catalog", 3), ("m05_ets_backtest", 4)])
def test_exchange_budget(spark, name, exchanges):
    plan = executed(entry.queries()[name](spark, SF))
    assert len(re.findall(r"- Exchange ", plan)) <= exchanges
    assert len(re.findall(r"FileScan parquet [^\n]*orders\.parquet", plan)) == 1


@present
@pytest.mark.parametrize("name", ["n06_consolidate", "v03_evaluate_policies", "x03_cross_source_verdict", "s06_latest_snapshot"])
def test_queries_run_on_the_smallest_tables(spark, name):
    assert entry.queries()[name](spark, SF).count() >= 0


@present
def test_panel_counts_add_up_to_all_orders(spark):
    d = DriverTables(spark, SF)
    customers = d.table("customer").select(F.col("c_custkey").alias("o_custkey"))
    joined = d.table("orders").join(customers, "o_custkey").count()
    counts = d.panel.where("metric = 'bonds_lodged'").groupBy("geography_level").agg(F.sum("value")).collect()
    assert {int(total) for _, total in counts} == {joined}
    last = d.selected.agg(F.max("period_date")).first()[0]
    assert last is None or last < d.complete_before


@present
def test_result_does_not_depend_on_broadcasting(spark):
    """With no side small enough to broadcast, customers meet orders in a sort-merge join."""
    build = entry.queries()["n01_historical_anomalies"]
    usual = sorted(map(str, build(spark, SF).collect()))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        df = build(spark, SF)
        plan = executed(df)
        assert "SortMergeJoin [o_custkey" in plan and "Broadcast" not in plan
        assert sorted(map(str, df.collect())) == usual
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@present
@pytest.mark.parametrize("name, calls", [("m08_pooled_boost_backtest", "boosted_backtest"), ("m12_boost_forward", "boosted_forward"), ("m13_all_model_forward", "boosted_forward")])
def test_trained_queries_use_the_library_settings(spark, monkeypatch, name, calls):
    from monthgrain.operators import pooled

    class Seen(Exception):
        pass

    def record(*args, **named):
        raise Seen(args[1:], named)

    monkeypatch.setattr(pooled, calls, record)
    with pytest.raises(Seen) as seen:
        entry.queries()[name](spark, SF)
    assert seen.value.args == ((), {})


@present
def test_three_models_are_compared(spark, monkeypatch):
    """The comparison queries with the trained model hold all three, key by key; a quick model stands in for the full one."""
    from monthgrain.operators import pooled

    whole = pooled.boosted_backtest
    monkeypatch.setattr(pooled, "boosted_backtest", lambda rows: whole(rows, pooled.Boosting(trees=2, depth=2)))
    run = lambda name: entry.queries()[name](spark, SF).collect()
    rows = run("t05_three_models")
    keys = {}
    for r in rows:
        keys.setdefault((r.series_id, r.origin, r.horizon_step), {})[r.model] = (r.actual, r.predicted)
    assert rows and all(len(v) == 3 and len({a for a, _ in v.values()}) == 1 for v in keys.values())
    compared = run("a11_three_models")
    assert len(compared) == 3 * len({r.metric for r in compared})
    for c in compared:
        gaps = [abs(r.actual - r.predicted) for r in rows if (r.model, r.metric) == (c.model, c.metric)]
        assert c.n_forecasts == len(gaps) and abs(c.mae - sum(gaps) / len(gaps)) < 1e-6 * c.mae
    assert {r.rank_mae for r in compared} == {1, 2, 3}
    assert all(r.passed for r in run("q06_three_models"))
    assert {r.policy for r in run("v03_three_models")} == {"per_series_selection", *(f"fixed_{r.model}" for r in compared)}
