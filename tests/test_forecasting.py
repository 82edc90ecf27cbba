from __future__ import annotations

import datetime as dt
import math

import numpy as np
import pytest
from helpers import month, raises_in_job, series_rows

from monthgrain.contracts import MODEL_NAIVE, MODEL_SMOOTHING, ContractError
from monthgrain.operators import (
    boosting,
    checks,
    comparison,
    features,
    policy,
    pooled,
    production,
    refinement,
    seasonal_naive,
    smoothing,
    splits,
)
from monthgrain.sources.model_store import Store


def seasonal(n, base=500.0, slope=0.7, amplitude=20.0, phase=0):
    wobble = (0.0, 3.0, -2.0, 4.0, -1.0, 2.0, -3.0)
    return [base + slope * i + amplitude * math.sin((i + phase) * math.pi / 6) + wobble[i % 7] for i in range(n)]


# ---- features -----------------------------------------------------------------------------


def test_features_look_back_only(make_panel):
    rows = features.feature_frame(make_panel(series_rows([float(i) for i in range(1, 16)]))).orderBy("period_date").collect()
    assert rows[12].lag_1 == 12.0 and rows[12].lag_12 == 1.0
    assert rows[12].rolling_mean_3 == 11.0 and rows[12].rolling_mean_12 == 6.5
    assert rows[11].rolling_mean_12 is None and rows[2].rolling_mean_3 is None
    assert (rows[3].month, rows[3].quarter, rows[3].year) == (4, 2, 2015)
    changed = [float(i) for i in range(1, 15)] + [1000.0]
    other = features.feature_frame(make_panel(series_rows(changed))).orderBy("period_date").collect()
    assert other[14].lag_1 == rows[14].lag_1 and other[14].rolling_mean_12 == rows[14].rolling_mean_12


def test_features_do_not_cross_series(make_panel):
    df = make_panel(series_rows([1.0, 2.0]), series_rows([10.0, 20.0], location=2))
    assert {(r.series_id, r.lag_1) for r in features.lag_features(df).collect() if r.period_date.month == 2} == {
        ("region_1_median_rent", 1.0),
        ("region_2_median_rent", 10.0),
    }
    with pytest.raises(ValueError):
        features.lag_features(df, lags=(0,))
    with pytest.raises(ValueError):
        features.rolling_features(df, windows=(0,))


# ---- splits ---------------------------------------------------------------------------------


def test_origins_are_the_newest_twelve(make_panel):
    rows = splits.rolling_origins(make_panel(series_rows(seasonal(100)))).orderBy("origin").collect()
    assert len(rows) == 12
    assert rows[-1].origin == month("2015-01-01", 93) and rows[-1].test_end == month("2015-01-01", 99)
    assert rows[0].origin == month("2015-01-01", 82) and rows[0].train_start == dt.date(2015, 1, 1)
    assert all(r.train_end == r.origin for r in rows)


def test_short_series_has_fewer_origins(make_panel):
    assert splits.rolling_origins(make_panel(series_rows(seasonal(70)))).count() == 5


@pytest.mark.parametrize("n, skip, text", [(65, (), "too few months"), (90, (40,), "missing or repeated")])
def test_unusable_series_fail(make_panel, n, skip, text):
    raises_in_job(splits.rolling_origins(make_panel(series_rows(seasonal(n), skip=skip))), text)


def test_slices_have_full_train_and_test(make_panel):
    df = make_panel(series_rows(seasonal(80)))
    rows = splits.slice_origins(df, splits.rolling_origins(df)).groupBy("origin", "part").count().collect()
    test = {r.origin: r["count"] for r in rows if r.part == "test"}
    train = {r.origin: r["count"] for r in rows if r.part == "train"}
    assert set(test.values()) == {6} and sorted(train.values()) == list(range(63, 75))


# ---- seasonal naive ----------------------------------------------------------------------------


def test_naive_repeats_the_value_of_a_year_ago(make_panel):
    values = seasonal(80)
    rows = seasonal_naive.naive_backtest(make_panel(series_rows(values))).collect()
    assert len(rows) == 72
    for r in rows:
        at = (r.forecast_period.year - 2015) * 12 + r.forecast_period.month - 1
        assert r.predicted == values[at - 12] and r.actual == values[at]
        assert r.error == r.actual - r.predicted and r.absolute_error == abs(r.error)
        assert r.horizon_step == at - ((r.origin.year - 2015) * 12 + r.origin.month - 1)


def test_naive_forecast_does_not_see_the_future(make_panel):
    values = seasonal(80)
    base = seasonal_naive.naive_backtest(make_panel(series_rows(values))).collect()
    other = seasonal_naive.naive_backtest(make_panel(series_rows(values[:-6] + [9e9] * 6))).collect()
    assert {(r.origin, r.horizon_step): r.predicted for r in base} == {(r.origin, r.horizon_step): r.predicted for r in other}
    with pytest.raises(ValueError):
        seasonal_naive.naive_backtest(make_panel(series_rows(values)), season=3)


def test_forward_calendar_and_naive(make_panel):
    values = seasonal(80)
    df = make_panel(series_rows(values), series_rows(values, location=2))
    calendar = seasonal_naive.future_periods(df).orderBy("horizon_step").collect()
    assert [r.forecast_period for r in calendar] == [month("2015-01-01", 80 + h) for h in range(6)]
    rows = seasonal_naive.naive_forward(df).where("location_id = 2").orderBy("horizon_step").collect()
    assert [r.predicted for r in rows] == values[68:74]
    uneven = make_panel(series_rows(values), series_rows(values[:-1], location=2))
    raises_in_job(seasonal_naive.future_periods(uneven), "different months")


# ---- smoothing -------------------------------------------------------------------------------------


def reference_fit(y, grid, horizon, season=12):
    """Plain loop over one series: (sse, parameters, forecasts) of the best grid point."""
    best = None
    for al, be, ga, ph in sorted(grid):
        one, two = sum(y[1:season], y[0]), sum(y[season + 1 : 2 * season], y[season])
        level, trend = one / season, (two - one) / (season * season)
        s = [v - level for v in y[:season]]
        sse = 0.0
        for i, v in enumerate(y):
            drift = ph * trend
            e = v - (level + drift + s[i % season])
            level, trend = level + drift + al * e, drift + al * be * e
            s[i % season] += ga * e
            sse += e * e
        damp, path = 0.0, []
        for h in range(horizon):
            damp += ph ** (h + 1)
            path.append(level + trend * damp + s[(len(y) + h) % season])
        if best is None or sse < best[0]:
            best = (sse, (al, be, ga, ph), path)
    return best


def test_smoothing_matches_a_plain_loop_for_series_of_different_length(make_panel):
    data = {1: seasonal(80), 2: seasonal(95, base=40, slope=-0.1, amplitude=9, phase=3), 3: seasonal(66, base=9, amplitude=1)}
    df = make_panel(*[series_rows(v, location=k) for k, v in data.items()])
    rows = smoothing.smoothing_backtest(df).collect()
    assert len(rows) == 72 + 72 + 6
    seen = {}
    for r in rows:
        seen.setdefault((r.location_id, r.origin), []).append(r)
    for (location, origin), group in seen.items():
        n = (origin.year - 2015) * 12 + origin.month
        _, _, path = reference_fit(data[location][:n], smoothing.GRID, 6)
        group.sort(key=lambda r: r.horizon_step)
        assert [r.horizon_step for r in group] == [1, 2, 3, 4, 5, 6]
        assert np.allclose([r.predicted for r in group], path, rtol=1e-12)
        assert [r.actual for r in group] == data[location][n : n + 6]


def test_smoothing_fit_and_forward(make_panel):
    y = seasonal(80)
    df = make_panel(series_rows(y))
    sse, point, path = reference_fit(y, smoothing.GRID, 6)
    fit = smoothing.smoothing_fits(df).first()
    assert (fit.alpha, fit.beta, fit.gamma, fit.phi) == point and abs(fit.sse - sse) < 1e-9
    rows = smoothing.smoothing_forward(df).orderBy("horizon_step").collect()
    assert np.allclose([r.predicted for r in rows], path)
    assert rows[0].forecast_period == month("2015-01-01", 80) and rows[0].model == MODEL_SMOOTHING


def plain_fold(y, point, start, horizon, season=12):
    """Squared error and forecasts of one series from given parameters and start state."""
    (al, be, ga, ph), level, trend, s, sse = point, start[0], start[1], list(start[2:]), 0.0
    for i, v in enumerate(y):
        drift = ph * trend
        e = v - (level + drift + s[i % season])
        level, trend = level + drift + al * e, drift + al * be * e
        s[i % season] += ga * e
        sse += e * e
    damps = [sum(ph ** (k + 1) for k in range(h + 1)) for h in range(horizon)]
    return sse, [level + trend * damps[h] + s[(len(y) + h) % season] for h in range(horizon)]


def noisy(n, seed, base=300.0):
    rng = np.random.default_rng(seed)
    walk = np.cumsum(rng.normal(0.4, 2.0, n))
    return [float(base + walk[i] + 12 * np.sin(i * np.pi / 6) + rng.normal(0, 4)) for i in range(n)]


def test_refined_fits_are_local_optima_inside_the_bounds(make_panel):
    data = {1: noisy(80, 1), 2: noisy(95, 2, 60.0), 3: seasonal(66, base=9, amplitude=1), 4: [50.0] * 70}
    df = make_panel(*[series_rows(v, location=k) for k, v in data.items()])
    grid = {r.series_id: r for r in smoothing.smoothing_fits(df).collect()}
    fits = {r.series_id: r for r in smoothing.smoothing_fits(df, steps=200).collect()}
    rng = np.random.default_rng(5)
    for k, y in data.items():
        name = f"region_{k}_median_rent"
        fit = fits[name]
        point = np.array([fit.alpha, fit.beta, fit.gamma, fit.phi])
        assert (point >= refinement.BOUNDS[:, 0]).all() and (point <= refinement.BOUNDS[:, 1]).all()
        assert fit.gamma <= 1 - fit.alpha and fit.sse <= grid[name].sse
        sse, _ = plain_fold(y, point, fit.start, 1)
        assert np.isclose(sse, fit.sse, rtol=1e-9, atol=1e-12)
        if k <= 2:
            assert fit.sse < 0.9 * grid[name].sse
            for _ in range(300):  # no small step inside the bounds is clearly better
                moved = np.clip(point + rng.normal(0, 1e-3, 4), refinement.BOUNDS[:, 0], refinement.BOUNDS[:, 1])
                moved[2] = min(moved[2], 1 - moved[0])
                near, _ = plain_fold(y, moved, np.array(fit.start) + rng.normal(0, 1e-2, 14), 1)
                assert near >= sse * (1 - 1e-5)


def test_refinement_slopes_match_difference_quotients():
    y = np.array([noisy(60, 3), noisy(60, 4)])
    n = np.array([60, 41])
    p = np.concatenate([[[0.3, 0.2, 0.1, 0.9]] * 2, y[:, :14] * 0 + 5.0], axis=1)
    errors, slopes = refinement.fold(y, n, p, 12)
    assert (errors[1, 41:] == 0).all() and (slopes[1, 41:] == 0).all()
    for k in range(p.shape[1]):
        up, down = p.copy(), p.copy()
        up[:, k] += 1e-6
        down[:, k] -= 1e-6
        quotient = (refinement.fold(y, n, up, 12, False)[0] - refinement.fold(y, n, down, 12, False)[0]) / 2e-6
        assert np.allclose(slopes[:, :, k], quotient, rtol=1e-4, atol=1e-4)


def test_refined_backtest_is_whole_repeatable_and_blind_to_the_future(make_panel):
    y = noisy(84, 9)
    df = make_panel(series_rows(y), series_rows(noisy(90, 10), location=2))
    keyed = lambda d: {(r.location_id, r.origin, r.horizon_step): r.predicted for r in smoothing.smoothing_backtest(d, steps=20).collect()}
    base = keyed(df)
    assert len(base) == len(smoothing.smoothing_backtest(df).collect()) == 2 * 12 * 6 and base == keyed(df)
    other = keyed(make_panel(series_rows(y[:-6] + [1e6] * 6), series_rows(noisy(90, 10), location=2)))
    early = {k: v for k, v in base.items() if k[0] == 1 and k[1] <= month("2015-01-01", 77)}
    assert early and all(np.isclose(other[k], v, rtol=1e-9) for k, v in early.items())
    forward = smoothing.smoothing_forward(make_panel(series_rows(y)), steps=20).orderBy("horizon_step").collect()
    fit = smoothing.smoothing_fits(make_panel(series_rows(y)), steps=20).first()
    _, path = plain_fold(y, (fit.alpha, fit.beta, fit.gamma, fit.phi), fit.start, 6)
    assert np.allclose([r.predicted for r in forward], path, rtol=1e-9)


def test_smoothing_does_not_see_the_future(make_panel):
    y = seasonal(80)
    keyed = lambda df: {(r.origin, r.horizon_step): r.predicted for r in smoothing.smoothing_backtest(df).collect()}
    base, other = keyed(make_panel(series_rows(y))), keyed(make_panel(series_rows(y[:-6] + [1e6] * 6)))
    first_origins = {k: v for k, v in base.items() if k[0] <= month("2015-01-01", 73)}
    assert first_origins and all(other[k] == v for k, v in first_origins.items())


@pytest.mark.parametrize(
    "values, skip, text",
    [
        (seasonal(23), (), "two full seasons"),
        (seasonal(80), (30,), "gaps or repeats"),
        (seasonal(40) + [None] + seasonal(40), (), "cannot be missing"),
        (seasonal(40) + [float("inf")] + seasonal(40), (), "finite"),
    ],
)
def test_smoothing_rejects_unusable_series(make_panel, values, skip, text):
    raises_in_job(smoothing.smoothing_fits(make_panel(series_rows(values, skip=skip))), text)


# ---- pooled trees -------------------------------------------------------------------------------------


def test_pooled_backtest_is_complete_finite_and_repeatable(make_panel, spark, tmp_path):
    df = make_panel(*[series_rows(seasonal(80, base=100 * k), location=k) for k in (1, 2, 3)])
    quick = pooled.Boosting(trees=2, depth=2)
    run = lambda folder: pooled.boosted_backtest(df, quick, n_origins=1, store=Store(spark, str(tmp_path / folder))).collect()
    rows, again = run("one"), run("two")
    assert len(rows) == 3 * 6 and all(math.isfinite(r.predicted) for r in rows)
    assert {r.horizon_step for r in rows} == {1, 2, 3, 4, 5, 6}
    key = lambda r: (r.series_id, r.horizon_step)
    assert {key(r): r.predicted for r in rows} == {key(r): r.predicted for r in again}
    values = {(r.series_id, r.period_date): r.value for r in df.collect()}
    for r in rows:
        assert r.actual == values[r.series_id, r.forecast_period]
        assert (r.error, r.absolute_error, r.squared_error) == (r.actual - r.predicted, abs(r.error), r.error * r.error)


def test_stored_models_and_predictions_are_used_again(make_panel, spark, tmp_path, monkeypatch):
    """A restart trains and forecasts only what is missing; other rows, settings or horizons make other entries."""
    places = [series_rows(seasonal(79, base=100 * k), location=k) for k in (1, 2)]
    df, quick, store = make_panel(*places), pooled.Boosting(trees=2, depth=2), Store(spark, str(tmp_path / "store"))
    trained, fit = [], pooled._tree_model

    def counted(settings):
        trained.append(settings)
        if len(trained) == 2:
            raise RuntimeError("lost on the way")
        return fit(settings)

    monkeypatch.setattr(pooled, "_tree_model", counted)
    monkeypatch.setattr(pooled, "TOGETHER", 1)
    run = lambda panel=df, **more: pooled.boosted_backtest(panel, quick, n_origins=2, store=store, **more)
    with pytest.raises(RuntimeError):
        run()
    first = sorted(map(str, run().collect()))
    assert len(trained) == 3  # the first origin's model was kept
    assert sorted(map(str, run().collect())) == first and len(trained) == 3
    assert len(run(horizon=3).collect()) == 2 * 2 * 3
    before = len(trained)
    changed = make_panel(places[0], [(*r[:6], r[6] + (i == 30), *r[7:]) for i, r in enumerate(places[1])])
    run(changed)
    assert len(trained) == before + 2
    forward = lambda: sorted(map(str, pooled.boosted_forward(df, quick, store=store).collect()))
    one, before = forward(), len(trained)
    assert forward() == one and len(trained) == before


def test_models_that_grow_together_are_those_that_grow_alone(spark):
    """Many models take the passes of one, and the first split is the best of all of brute force."""
    rng = np.random.default_rng(5)
    rows = [(m, f"p{i % 4}", i * 977 + m, float(rng.integers(0, 9)), float(rng.integers(0, 30))) for m in (0, 1) for i in range(90)]
    rows = [(m, p, k, (a > 4) * 20.0 + (p == "p2") * 5 + b / 10 + m * (b > 20) * 40, a, b) for m, p, k, a, b in rows]
    frame = spark.createDataFrame(rows, "model int, location_key string, key long, value double, a double, b double")
    places, learner = np.array(["p0", "p1", "p2", "p3"]), boosting.Learner(trees=4, depth=2, step=0.05, subsample=1.0, seed=42)
    context = spark.sparkContext

    def run(name, df, *models, **more):
        context.setJobGroup(name, name)
        found = boosting.fit(df, ["a", "b"], {m: places for m in models}, learner, **more)
        return found, len(context.statusTracker().getJobIdsForGroup(name))

    try:
        both, jobs = run("both", frame.repartition(3), 0, 1, rows_per_task=20)
        alone, jobs_alone = zip(*(run(f"only-{m}", frame.filter(f"model = {m}"), m, rows_per_task=1000) for m in (0, 1)))
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    assert jobs <= max(jobs_alone) + 2 < sum(jobs_alone)  # reading the rows may take a job more
    for m in (0, 1):
        for one, other in zip(both[m], alone[m][m], strict=True):
            assert all((x == y).all() for x, y in ((one.feature, other.feature), (one.split, other.split), (one.value, other.value)))
        own = [r for r in rows if r[0] == m]
        left = lambda t: np.sum((np.array(t) - np.mean(t)) ** 2) if t else 0.0
        tests = {(f, c): [r[4 + f] > c for r in own] for f in (0, 1) for c in {r[4 + f] for r in own}}
        tests |= {(boosting.PLACE, i): [r[1] == f"p{i}" for r in own] for i in range(4)}
        error = {k: left([r[3] for r, t in zip(own, v) if t]) + left([r[3] for r, t in zip(own, v) if not t]) for k, v in tests.items()}
        first = both[m][0]
        assert error[int(first.feature[0]), first.split[0]] <= min(error.values()) + 1e-6
        features, place = np.array([[r[4] for r in own], [r[5] for r in own]]), np.searchsorted(places, [r[1] for r in own])
        value, whole = np.array([r[3] for r in own]), boosting.predict(both[m], features, place)
        assert np.mean((value - whole) ** 2) < np.mean((value - boosting.predict(both[m][:1], features, place)) ** 2) < np.var(value)


def test_an_entry_without_its_mark_is_not_read(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    with pytest.raises(ValueError):
        store.put("rows", "k", lambda path: (spark.range(3).write.parquet(f"{path}/rows"), int("x")))
    assert store.find("rows", "k") is None
    place = store.get("rows", "k", lambda path: spark.range(4).write.parquet(f"{path}/rows"))
    assert store.find("rows", "k").endswith(place.rsplit("/", 1)[1]) and spark.read.parquet(f"{place}/rows").count() == 4


# ---- comparison ------------------------------------------------------------------------------------------


def prediction(model, series=1, origin="2020-01-01", step=1, actual=100.0, predicted=90.0, metric="median_rent"):
    day = dt.date.fromisoformat(origin)
    return (
        model,
        f"region_{series}_{metric}",
        metric,
        "region",
        series,
        f"Place {series}",
        day,
        month(origin, step),
        step,
        actual,
        predicted,
    )


@pytest.fixture
def two_models(make_predictions):
    rows = []
    for series in (1, 2):
        for step in (1, 2):
            rows.append(prediction(MODEL_NAIVE, series, step=step, predicted=90.0))
            rows.append(prediction(MODEL_SMOOTHING, series, step=step, predicted=95.0 if series == 1 else 80.0))
    return make_predictions(rows)


def test_metrics_and_winners(two_models):
    by_series = comparison.metrics_by_series(two_models)
    got = {(r.model, r.series_id): r for r in by_series.collect()}
    row = got[MODEL_SMOOTHING, "region_1_median_rent"]
    assert (row.mae, row.rmse, row.n_origins, row.n_forecasts) == (5.0, 5.0, 1, 2)
    winners = {r.series_id: r.best_model for r in comparison.series_winners(by_series).collect()}
    assert winners == {"region_1_median_rent": MODEL_SMOOTHING, "region_2_median_rent": MODEL_NAIVE}


def test_comparison_ranks_and_improvement(two_models):
    rows = {r.model: r for r in comparison.model_comparison(two_models).collect()}
    assert rows[MODEL_NAIVE].mae == 10.0 and rows[MODEL_SMOOTHING].mae == 12.5
    assert (rows[MODEL_NAIVE].rank_mae, rows[MODEL_SMOOTHING].rank_mae) == (1, 2)
    assert rows[MODEL_SMOOTHING].mae_improvement_vs_baseline_pct == -25.0
    assert rows[MODEL_NAIVE].mae_improvement_vs_baseline_pct == 0.0
    assert comparison.headline_winner(comparison.model_comparison(two_models)).first().best_model == MODEL_NAIVE
    raises_in_job(comparison.model_comparison(two_models.where(f"model <> '{MODEL_NAIVE}'")), "baseline model is missing")


def test_equal_scores_share_the_rank_and_tie_by_name(make_predictions):
    df = make_predictions([prediction(m, predicted=90.0) for m in (MODEL_NAIVE, MODEL_SMOOTHING)])
    assert {r.rank_smape for r in comparison.model_comparison(df).collect()} == {1}
    assert comparison.series_winners(comparison.metrics_by_series(df)).first().best_model == MODEL_SMOOTHING


def test_summary_and_counts(two_models):
    rows = {(r.model, r.scope, r.metric): r for r in comparison.model_summary(two_models).collect()}
    assert len(rows) == 4 and rows[MODEL_NAIVE, "overall", "all"].n_series == 2
    counts = comparison.winner_counts(comparison.series_winners(comparison.metrics_by_series(two_models))).collect()
    assert {r.model: (r.series_count, r.share_pct) for r in counts} == {
        MODEL_NAIVE: (1, 50.0),
        MODEL_SMOOTHING: (1, 50.0),
        "xgboost_pooled_recursive": (0, 0.0),
    }


def test_alignment_and_prediction_checks(two_models, make_predictions):
    assert {r.passed for r in checks.alignment_checks(two_models, 2).collect()} == {True}
    other = make_predictions([prediction(MODEL_NAIVE), prediction(MODEL_SMOOTHING, actual=101.0)])
    failed = {r.check_name for r in checks.alignment_checks(other, 2).collect() if not r.passed}
    assert failed == {"same_actual"}
    lone = make_predictions([prediction(MODEL_NAIVE), prediction(MODEL_SMOOTHING, step=2)])
    assert not checks.alignment_checks(lone, 2).where("check_name = 'same_keys'").first().passed
    failed = {r.check_name for r in checks.prediction_checks(two_models).collect() if not r.passed}
    assert failed == {"single_model", "unique_keys"}
    bad = make_predictions([prediction(MODEL_NAIVE, predicted=float("nan")), prediction(MODEL_NAIVE, step=2, actual=None)])
    assert checks.prediction_checks(bad).where("check_name = 'finite_values'").first().observed == 2
    empty = checks.prediction_checks(two_models.limit(0)).where("not passed").collect()
    assert [r.check_name for r in empty if r.check_name == "not_empty"] == ["not_empty"]
    with pytest.raises(ValueError):
        comparison.combine_predictions([two_models])


def test_backtest_checks_find_a_missing_step(make_panel):
    df = seasonal_naive.naive_backtest(make_panel(series_rows(seasonal(80))))
    assert {r.passed for r in checks.backtest_checks(df).collect()} == {True}
    holed = df.where("not (horizon_step = 3 and origin = (select max(date'2021-01-01')))")
    failed = {r.check_name for r in checks.backtest_checks(holed).collect() if not r.passed}
    assert failed == {"row_count", "horizon_steps"}


def test_completeness_of_products(two_models):
    by_series = comparison.metrics_by_series(two_models)
    products = {
        "metrics_by_origin": comparison.metrics_by_origin(two_models),
        "metrics_by_series": by_series,
        "metrics_by_horizon": comparison.metrics_by_horizon(two_models),
        "model_comparison": comparison.model_comparison(two_models),
        "series_model_winners": comparison.series_winners(by_series),
    }
    assert {r.passed for r in checks.comparison_completeness(two_models, products).collect()} == {True}
    products["series_model_winners"] = products["series_model_winners"].limit(1)
    failed = checks.comparison_completeness(two_models, products).where("not passed").collect()
    assert [(r.check_name, r.observed) for r in failed] == [("series_model_winners_rows", 1)]


# ---- policies ------------------------------------------------------------------------------------------------


@pytest.fixture
def policy_rows(make_predictions):
    rows = []
    for series, good in ((1, MODEL_NAIVE), (2, MODEL_SMOOTHING)):
        for k in range(12):
            origin = month("2025-02-01", k).isoformat()
            for step in range(1, 7):
                for model in (MODEL_NAIVE, MODEL_SMOOTHING):
                    rows.append(prediction(model, series, origin, step, 100.0, 99.0 if model == good else 95.0))
    return make_predictions(rows)


def test_cutoff_split_is_strict(policy_rows):
    selection, evaluation = policy.split_by_cutoff(policy_rows, "2025-08-01")
    assert selection.agg({"forecast_period": "max"}).first()[0] == dt.date(2025, 8, 1)
    row = evaluation.selectExpr("min(forecast_period) as t", "min(origin) as o").first()
    assert row.t == dt.date(2025, 9, 1) and row.o == dt.date(2025, 8, 1)
    facts = policy.cutoff_facts(policy_rows, "2025-08-01").first()
    assert facts.target_overlap == 0 and facts.cutoff_is_origin
    with pytest.raises(ContractError):
        policy.assert_cutoff(policy_rows, "2030-01-01")
    with pytest.raises(ContractError, match="not a prediction origin"):
        policy.assert_cutoff(policy_rows, "2025-08-15")


def test_policies(policy_rows):
    selection, evaluation = policy.split_by_cutoff(policy_rows, "2025-08-01")
    winners = policy.selection_winners(selection)
    assert {r.series_id: r.model for r in winners.collect()} == {
        "region_1_median_rent": MODEL_NAIVE,
        "region_2_median_rent": MODEL_SMOOTHING,
    }
    rows = {(r.scope, r.policy): r for r in policy.evaluate_policies(evaluation, winners).collect()}
    assert len(rows) == 6
    best = rows["all", "per_series_selection"]
    assert best.n_series == 2 and best.n_forecasts == 72 and abs(best.smape - 2 / 199 * 100) < 1e-9
    assert rows["all", f"fixed_{MODEL_NAIVE}"].smape > best.smape
    raises_in_job(policy.evaluate_policies(evaluation, winners.limit(1)), "exactly one selection winner")


# ---- forward products ---------------------------------------------------------------------------------------------


def test_production_uses_the_fixed_models_own_metrics(make_panel, spark):
    df = make_panel(series_rows(seasonal(80)), series_rows(seasonal(80), location=2))
    rows = [(m, f"region_{k}_median_rent", e, e, e) for k in (1, 2) for m, e in ((MODEL_NAIVE, 0.1), (MODEL_SMOOTHING, 7.0))]
    metrics = spark.createDataFrame(rows, "model string, series_id string, mae double, rmse double, smape double")
    out = production.production_forward(df, metrics)
    got = out.collect()
    assert len(got) == 12 and {r.model for r in got} == {MODEL_SMOOTHING} and {r.backtest_mae for r in got} == {7.0}
    assert {r.forecast_policy for r in got} == {"fixed_ets_v1"}
    assert {r.passed for r in production.forward_checks(out, df).collect()} == {True}
    raises_in_job(production.production_forward(df, metrics.where("series_id like '%1%'")), "finite predictions and backtest")
    failed = production.forward_checks(out.where("location_id = 1"), df).where("not passed").collect()
    assert [(r.check_name, r.observed) for r in failed] == [("missing_series", 1)]


def test_winner_forward_keeps_each_winner(make_panel, spark):
    df = make_panel(series_rows(seasonal(80)), series_rows(seasonal(80), location=2))
    both = seasonal_naive.naive_forward(df).unionByName(smoothing.smoothing_forward(df))
    schema = "series_id string, best_model string, best_mae double, best_rmse double, best_smape double"
    winners = spark.createDataFrame(
        [("region_1_median_rent", MODEL_NAIVE, 1.0, 1.0, 1.0), ("region_2_median_rent", MODEL_SMOOTHING, 2.0, 2.0, 2.0)], schema
    )
    got = production.winner_forward(both, winners).groupBy("series_id", "model").count().collect()
    assert {(r.series_id, r.model, r["count"]) for r in got} == {
        ("region_1_median_rent", MODEL_NAIVE, 6),
        ("region_2_median_rent", MODEL_SMOOTHING, 6),
    }
    unknown = spark.createDataFrame([("region_1_median_rent", "guess", 1.0, 1.0, 1.0)], schema)
    raises_in_job(production.winner_forward(both, unknown), "unsupported winner model")


def test_forecast_against_latest_has_a_connecting_row(make_panel):
    df = make_panel(series_rows(seasonal(80)))
    rows = production.forecast_against_latest(seasonal_naive.naive_forward(df), df).orderBy("horizon_step").collect()
    assert [r.horizon_step for r in rows] == list(range(7))
    assert rows[0].predicted == rows[0].latest_value and rows[0].change_vs_latest_pct is None


def test_missing_actual_fails(make_panel, make_predictions):
    df = make_panel(series_rows(seasonal(80)))
    forecasts = make_predictions([prediction(MODEL_NAIVE, origin="2030-01-01")]).drop("actual")
    raises_in_job(production.attach_actuals(forecasts, df), "no actual value")
