"""Pooled boosted trees: one model per metric and origin over all series, forecast recursively.

Models of different (metric, origin) do not depend on each other, so up to ``TOGETHER`` of them grow side by side: one
distributed pass adds up what all of them need for the next level of their trees (``boosting``).
Every finished model, and the predictions of every (metric, origin), are kept in the shared folder under a fingerprint of
the training rows and settings: a restart goes on where it stopped, and no model is trained twice on the same rows.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from monthgrain.contracts import (
    HORIZON,
    LAGS,
    MIN_HISTORY_MONTHS,
    MODEL_BOOSTED,
    N_ORIGINS,
    PREDICTION_COLUMNS,
    ROLLING_WINDOWS,
    SERIES_ATTRS,
)
from monthgrain.functions.frames import newest_first
from monthgrain.operators import boosting
from monthgrain.operators.comparison import union_loose
from monthgrain.operators.features import BASE_FEATURES, pooled_training_frame
from monthgrain.operators.production import attach_actuals
from monthgrain.operators.seasonal_naive import ERROR_COLUMNS, future_periods, with_errors
from monthgrain.operators.splits import rolling_origins
from monthgrain.session import durable
from monthgrain.sources.model_store import Store, content, digest

#: Models that are trained at a time.
TOGETHER = 64
#: Store entries that are written at a time.
WRITERS = 8
#: Training rows, counted once for every model, that one task of a fit takes.
ROWS_PER_TASK = 40_000
DEPTH = max(max(LAGS), max(ROLLING_WINDOWS))
#: Part of every fingerprint: entries of another learner are not read.
LEARNER = "binned trees 1"
TREES = "key string, tree int, weight double, feature array<int>, split array<double>, value array<double>"
PLACES = "key string, places array<string>"


@dataclass(frozen=True)
class Boosting:
    """Settings of the pooled model."""

    trees: int = 300
    depth: int = 4
    step: float = 0.05
    subsample: float = 0.8
    seed: int = 42


def _tree_model(settings: Boosting) -> boosting.Learner:
    return boosting.Learner(**asdict(settings))


def _tails(history: DataFrame, origin: Column) -> DataFrame:
    """Last twelve values of every series up to the origin: the whole state of the recursion."""
    recent = history.where(F.col("period_date") <= origin).withColumn("_back", F.row_number().over(newest_first()))
    return (
        recent.where(F.col("_back") <= DEPTH)
        .groupBy("series_id", *SERIES_ATTRS)
        .agg(
            F.sort_array(F.collect_list(F.struct("period_date", "value"))).alias("_rows"),
            F.max("period_date").alias("_end"),
        )
        .withColumn("tail", F.col("_rows.value"))
        .withColumn("location_key", F.concat_ws("_", "geography_level", F.col("location_id").cast("string")))
        .drop("_rows")
    )


def _step_features(tail: np.ndarray, origin: np.ndarray, step: int) -> np.ndarray:
    """Features (in the order of ``BASE_FEATURES``) of the month ``step`` after the origin, from the state alone."""
    period = origin.astype("datetime64[M]").astype(np.int64) + step
    month = period % 12 + 1
    lags = [tail[:, -k] for k in LAGS]
    means = [tail[:, -k:].sum(1) / k for k in ROLLING_WINDOWS]
    return np.stack([*lags, *means, month, (month + 2) // 3, 1970 + period // 12])


@dataclass(frozen=True)
class _Fit:
    """One pooled model that is wanted: its fingerprint and the number of its training rows."""

    metric: str
    origin: dt.date
    key: str
    rows: int


def _recursive(models: dict[int, tuple[np.ndarray, list[boosting.Tree]]], horizon: int):
    """Forecast the states (model, location_key, tail, origin) step by step: each prediction is appended to the state."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            model, origin = batch["model_no"].to_numpy(zero_copy_only=False), batch["origin"].to_numpy(zero_copy_only=False)
            tails = batch["tail"]
            values = tails.flatten()
            if values.null_count or set(tails.value_lengths().to_pylist()) != {DEPTH}:
                raise ValueError(f"a series needs {DEPTH} values up to its origin")
            tail = values.to_numpy(zero_copy_only=False).reshape(-1, DEPTH)
            where = batch["location_key"].to_numpy(zero_copy_only=False).astype(str)
            place = np.zeros(len(where), np.int64)
            for m in np.unique(model).tolist():
                places, at = models[m][0], model == m
                place[at] = np.searchsorted(places, where[at])
                if not np.isin(where[at], places).all():
                    raise ValueError("a location is in no training row")
            predicted = np.empty((len(where), horizon))
            for step in range(1, horizon + 1):
                features = _step_features(tail, origin, step)
                for m in np.unique(model).tolist():
                    at = model == m
                    predicted[at, step - 1] = boosting.predict(models[m][1], features[:, at], place[at])
                tail = np.concatenate([tail[:, 1:], predicted[:, step - 1 : step]], axis=1)
            kept = batch.select(["series_id", *SERIES_ATTRS, "origin", "model_no"])
            ahead = pa.array(list(predicted), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*kept.columns, ahead], [*kept.schema.names, "ahead"])

    return run


def _forecast_rows(states: DataFrame, models: dict[int, tuple[np.ndarray, list[boosting.Tree]]], horizon: int) -> DataFrame:
    keep = ["series_id", *SERIES_ATTRS, "origin", "model_no"]
    schema = states.select(*keep).schema.add("ahead", T.ArrayType(T.DoubleType()))
    rows = states.select(*keep, "location_key", "tail").mapInArrow(_recursive(models, horizon), schema)
    rows = rows.select(*keep, F.posexplode("ahead").alias("_i", "predicted"))
    step = F.col("_i") + 1
    return rows.select(
        "model_no",
        "series_id",
        *SERIES_ATTRS,
        "origin",
        F.add_months("origin", step).alias("forecast_period"),
        step.alias("horizon_step"),
        "predicted",
        F.lit(MODEL_BOOSTED).alias("model"),
    )


def _wanted(training: DataFrame, origins: list[tuple[str, dt.date]], settings: Boosting) -> list[_Fit]:
    """Fingerprints of all models, from one pass: rows are hashed per month, months are added up to each origin."""
    months = content(training, ["metric", "period_date"]).collect()  # one row per metric and month
    fits = []
    for metric, origin in origins:
        own = sorted((str(r.period_date), r.n, r.x, r.s) for r in months if r.metric == metric and r.period_date <= origin)
        # location categories come from all rows of the metric
        everything = sorted((str(r.period_date), r.n, r.x, r.s) for r in months if r.metric == metric)
        fits.append(_Fit(metric, origin, digest(LEARNER, asdict(settings), BASE_FEATURES, own, everything), sum(r[1] for r in own)))
    return fits


def _side_by_side(spark, work: Callable[[_Fit], None], fits: list[_Fit]) -> None:
    """Run ``work`` for every fit in a bounded pool; after a failure or a cancelled query nothing new is started."""
    if not fits:
        return
    pool = ThreadPoolExecutor(min(WRITERS, len(fits)))
    try:
        for done in [pool.submit(inheritable_thread_target(spark)(work), f) for f in fits]:
            done.result()
    finally:
        pool.shutdown(wait=False, cancel_futures=True)


def _train(training: DataFrame, fits: list[_Fit], settings: Boosting, store: Store) -> None:
    """Train what the store lacks; features look back only, so an earlier origin is a date filter on one feature table."""
    spark = training.sparkSession
    missing = [f for f in fits if not store.find("model", f.key)]
    if not missing:
        return
    metrics = sorted({f.metric for f in missing})
    # location categories come from all rows of the metric
    known = training.where(F.col("metric").isin(metrics)).select("metric", "location_key").distinct().collect()
    places = {m: np.array(sorted(r.location_key for r in known if r.metric == m), str) for m in metrics}
    keyed = training.withColumn("key", F.xxhash64("series_id", "period_date"))
    for i in range(0, len(missing), TOGETHER):
        own = missing[i : i + TOGETHER]
        learner = [_tree_model(settings) for _ in own][0]
        models = spark.createDataFrame([(n, f.metric, f.origin) for n, f in enumerate(own)], "model int, metric string, origin date")
        rows = keyed.join(F.broadcast(models), "metric").where(F.col("period_date") <= F.col("origin"))
        grown = boosting.fit(rows, list(BASE_FEATURES), {n: places[f.metric] for n, f in enumerate(own)}, learner, ROWS_PER_TASK)
        number = {f: n for n, f in enumerate(own)}

        def keep(f: _Fit) -> None:
            trees = [
                (f.key, i, t.weight, t.feature.tolist(), t.split.tolist(), t.value.tolist()) for i, t in enumerate(grown[number[f]])
            ]
            locations = spark.createDataFrame([(f.key, places[f.metric].tolist())], PLACES)

            def write(path: str) -> None:
                locations.coalesce(1).write.parquet(f"{path}/places")
                spark.createDataFrame(trees, TREES).coalesce(1).write.parquet(f"{path}/trees")

            store.put("model", f.key, write)

        _side_by_side(spark, keep, own)


def _stored(spark: SparkSession, fits: list[_Fit], store: Store) -> dict[int, tuple[np.ndarray, list[boosting.Tree]]]:
    """Locations and trees of every fit, by its number."""
    at = [store.find("model", f.key) for f in fits]
    places = {r.key: np.array(r.places, str) for r in spark.read.schema(PLACES).parquet(*(f"{p}/places" for p in at)).collect()}
    trees: dict[str, list] = {}
    for r in spark.read.schema(TREES).parquet(*(f"{p}/trees" for p in at)).collect():
        trees.setdefault(r.key, []).append((r.tree, boosting.Tree(np.array(r.feature), np.array(r.split), np.array(r.value), r.weight)))
    return {n: (places[f.key], [t for _, t in sorted(trees[f.key], key=lambda x: x[0])]) for n, f in enumerate(fits)}


def _forecasts(history: DataFrame, origins: list[tuple[str, dt.date]], settings: Boosting, horizon: int, store: Store | None) -> DataFrame:
    """Forecasts of all (metric, origin), each kept as a partition of its own; only missing ones are computed."""
    spark = history.sparkSession
    store = store or Store(spark)
    training = durable(pooled_training_frame(history), "boosted-training")
    fits = _wanted(training, origins, settings)
    key = lambda f: digest(f.key, str(f.origin), horizon)
    missing = [f for f in fits if not store.find("forecast", key(f))]
    if missing:
        _train(training, missing, settings, store)
        numbers = spark.createDataFrame([(n, f.metric, f.origin) for n, f in enumerate(missing)], "model_no int, metric string, origin date")
        states = _states(history, [(f.metric, f.origin) for f in missing]).join(F.broadcast(numbers), ["metric", "origin"])
        rows = durable(_forecast_rows(states, _stored(spark, missing, store), horizon), "boosted-forecasts")
        number = {f: n for n, f in enumerate(missing)}

        def keep(f: _Fit) -> None:
            own = rows.where(F.col("model_no") == number[f]).drop("model_no")
            store.put("forecast", key(f), lambda path: own.write.parquet(f"{path}/rows"))

        _side_by_side(spark, keep, missing)
    paths = [f"{store.find('forecast', key(f))}/rows" for f in fits]
    return spark.read.parquet(*paths)


def _states(history: DataFrame, origins: list[tuple[str, dt.date]]) -> DataFrame:
    unique = sorted({o for _, o in origins})
    tails = union_loose([_tails(history, F.lit(o)).withColumn("origin", F.lit(o)) for o in unique])
    differ = F.raise_error(F.lit("series end in different months")).cast("array<double>")
    return tails.withColumn("tail", F.when(F.col("_end") != F.col("origin"), differ).otherwise(F.col("tail"))).drop("_end")


def boosted_backtest(
    panel: DataFrame,
    settings: Boosting = Boosting(),
    horizon: int = HORIZON,
    n_origins: int = N_ORIGINS,
    min_history: int = MIN_HISTORY_MONTHS,
    store: Store | None = None,
) -> DataFrame:
    """Rolling-origin predictions; each metric takes its origins from its alphabetically first series.

    ``store`` keeps models and predictions (by default in the session's shared folder).
    """
    firsts = panel.groupBy("metric").agg(F.min("series_id").alias("series_id"))
    calendar = rolling_origins(panel.join(firsts, ["metric", "series_id"]), horizon, n_origins, min_history)
    # a few origins per metric: the loop over models runs on the driver, the work does not
    wanted = calendar.join(firsts, "series_id").select("metric", "origin").orderBy("metric", "origin")
    origins = [(r.metric, r.origin) for r in wanted.collect()]
    if not origins:
        raise ValueError("no rolling origin: histories are too short")
    forecasts = _forecasts(panel, origins, settings, horizon, store)
    return with_errors(attach_actuals(forecasts, panel)).select(*PREDICTION_COLUMNS, *ERROR_COLUMNS)


def boosted_forward(history: DataFrame, settings: Boosting = Boosting(), horizon: int = HORIZON, store: Store | None = None) -> DataFrame:
    """Forward forecasts of every metric from its own pooled model."""
    first = future_periods(history, horizon).orderBy("horizon_step").first()
    metrics = sorted(r.metric for r in history.select("metric").distinct().collect())
    origins = [(m, first.forecast_origin) for m in metrics]
    forecasts = _forecasts(history, origins, settings, horizon, store)
    return forecasts.select(
        "model",
        "series_id",
        *SERIES_ATTRS,
        F.col("origin").alias("forecast_origin"),
        "forecast_period",
        "horizon_step",
        "predicted",
    )
