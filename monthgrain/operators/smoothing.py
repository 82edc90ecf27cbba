"""Additive damped exponential smoothing with additive seasonality, fitted on a parameter grid and, if asked, refined from there.

The start state depends on the first two seasons only, so the state after ``t`` months is the same
whichever origin asks for it. One fold over a series therefore serves all of its origins: the fold
emits a forecast at each origin as it passes, instead of refitting every (series, origin) pair.
With ``steps``, each (series, origin) pair starts from its grid point and refines parameters and start state (``refinement``).

The recursion is the one part of the engine that has no built-in expression fast enough: interpreted
array folds cost tens of microseconds per month and grid point, Arrow blocks a few nanoseconds.
"""

from __future__ import annotations

import sys
from collections.abc import Iterable, Iterator, Sequence
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from monthgrain.contracts import (
    HORIZON,
    MIN_HISTORY_MONTHS,
    MODEL_SMOOTHING,
    N_ORIGINS,
    PREDICTION_COLUMNS,
    SEASON,
    SERIES_ATTRS,
)
from monthgrain.functions.parsing import month_number
from monthgrain.operators import refinement
from monthgrain.operators.seasonal_naive import ERROR_COLUMNS, future_periods, with_errors

Parameters = tuple[float, float, float, float]
GRID: tuple[Parameters, ...] = tuple(
    product((0.1, 0.3, 0.6), (0.05, 0.15, 0.3), (0.05, 0.15, 0.3), (0.8, 0.9, 0.98))
)
# the kernel travels with the plan, so executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# series folded together inside a task: keeps the working arrays in cache
SERIES_PER_BLOCK = 256
# the same for refined fits, which carry derivatives: 32 series x 12 origins x 18 unknowns x 100 months are 55 MB
REFINED_PER_BLOCK = 32
#: Trial steps of a refined fit; most finish earlier.
STEPS = 40


def _series_arrays(history: DataFrame, season: int) -> DataFrame:
    """One row per series with its values in month order (bounded by the calendar), checked.

    The explicit partition count keeps adaptive coalescing from folding many series in one task: the
    fit is compute-bound, while coalescing looks at bytes only. It is the session's number of shuffle partitions.
    """
    tasks = int(history.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = history.repartition(tasks, "series_id").groupBy("series_id").agg(
        *[F.min_by(c, "period_date").alias(c) for c in SERIES_ATTRS],
        F.sort_array(F.collect_list(F.struct("period_date", "value"))).alias("_rows"),
        F.count(F.lit(1)).alias("_n"),
        F.count("value").alias("_present"),
        F.min("period_date").alias("_start"),
        F.max("period_date").alias("_end"),
    )
    span = month_number(F.col("_end")) - month_number(F.col("_start")) + 1
    distinct = F.size(F.array_distinct(F.col("_rows.period_date")))
    problem = (
        F.when(F.col("_n") < 2 * season, "smoothing needs two full seasons")
        .when(F.col("_present") < F.col("_n"), "smoothing values cannot be missing")
        .when((span != F.col("_n")) | (distinct != F.col("_n")), "smoothing needs months without gaps or repeats")
    )
    values = F.when(problem.isNotNull(), F.raise_error(problem).cast("array<double>")).otherwise(F.col("_rows.value"))
    return rows.withColumn("y", values).drop("_rows", "_present")


def _state_path(y: np.ndarray, season: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start level, trend and seasonal offsets of every row of ``y`` from its first two seasons."""
    year_one, year_two = y[:, 0].copy(), y[:, season].copy()
    for k in range(1, season):
        year_one += y[:, k]
        year_two += y[:, season + k]
    level = year_one / float(season)
    return level, (year_two - year_one) / float(season * season), y[:, :season] - level[:, None]


def _best_fits(y: np.ndarray, first: np.ndarray, last: np.ndarray, grid: np.ndarray, horizon: int, season: int):
    """Fold all rows of ``y`` through all grid points at once.

    Yields ``(train_rows, row numbers, winning grid point, sse, forecast path)`` for each month that is a
    training end of some row. Rows shorter than the matrix are padded with NaN past their last month.
    """
    alpha, beta, gamma, phi = (grid[:, k][None, :] for k in range(4))
    level0, trend0, season0 = _state_path(y, season)
    shape = (len(y), len(grid))
    level, trend = np.broadcast_to(level0[:, None], shape), np.broadcast_to(trend0[:, None], shape)
    # the slot of a calendar position is reused every ``season`` months
    offsets = [np.broadcast_to(season0[:, k][:, None], shape) for k in range(season)]
    sse = np.zeros(shape)
    damp = [phi]
    power = phi
    for _ in range(1, horizon):
        power = power * phi
        damp.append(damp[-1] + power)
    for i in range(y.shape[1]):
        slot = i % season
        drift = phi * trend
        error = y[:, i][:, None] - (level + drift + offsets[slot])
        level = level + drift + alpha * error
        trend = drift + alpha * beta * error
        offsets[slot] = offsets[slot] + gamma * error
        sse = sse + error * error
        rows = np.flatnonzero((first <= i + 1) & (i + 1 <= last))
        if rows.size:
            point = np.argmin(sse[rows], axis=1)
            at = (rows, point)
            path = np.stack(
                [
                    level[at] + trend[at] * damp[h][0, point] + offsets[(i + 1 + h) % season][at]
                    for h in range(horizon)
                ],
                axis=1,
            )
            yield i + 1, rows, point, sse[at], path


def _refined_fits(y: np.ndarray, first: np.ndarray, last: np.ndarray, grid: np.ndarray, horizon: int, season: int, steps: int):
    """All fits of ``y``'s rows at once: ``(train_rows, row numbers, unknowns, sse, forecast path)``, one entry per fit."""
    found = [(np.full(rows.size, n), rows, point) for n, rows, point, _, _ in _best_fits(y, first, last, grid, horizon, season)]
    if not found:
        return None
    n, rows, point = (np.concatenate(part) for part in zip(*found))
    level, trend, offsets = _state_path(y, season)
    start = np.concatenate([grid[point], level[rows, None], trend[rows, None], offsets[rows]], axis=1)
    values = np.nan_to_num(y)[rows]
    unknowns, sse = refinement.refine(values, n, start, season, steps)
    return n, rows, unknowns, sse, refinement.paths(values, n, unknowns, horizon, season)


def fit_paths(
    arrays: DataFrame, first: Column, last: Column, grid: Sequence[Parameters], horizon: int, season: int, steps: int = 0
) -> DataFrame:
    """Best grid point, forecast path and actual values for every series and training length.

    ``start`` holds level, trend and seasonal offsets before the first month; with ``steps`` it is refined with the parameters.

    Series arrive as Arrow batches. Inside a task the recursion runs over months only: each step is a
    handful of array operations on a (series x grid point) block, so the work per series is small and
    no grid copies of a series are shuffled. Grid points are ordered, so the first minimum is the tie rule.
    """
    points = np.array(sorted(grid), dtype=float)
    carried = ["series_id", *SERIES_ATTRS, "_start"]
    fields = {f.name: f for f in arrays.schema.fields}
    schema = StructType(
        [fields[c] for c in carried]
        + [StructField("train_rows", IntegerType())]
        + [StructField(c, DoubleType()) for c in ("sse", "alpha", "beta", "gamma", "phi")]
        + [StructField(c, ArrayType(DoubleType())) for c in ("path", "actuals", "start")]
    )

    def lists(block: np.ndarray) -> pa.Array:
        ends = np.arange(0, block.size + 1, block.shape[1], dtype=np.int32)
        return pa.ListArray.from_arrays(ends, pa.array(block.ravel(), from_pandas=True))

    def fit_block(block: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        values = block.column("y")
        sizes = values.value_lengths().to_numpy()
        y = np.full((len(sizes), int(sizes.max()) + horizon), np.nan)
        y[np.arange(y.shape[1])[None, :] < sizes[:, None]] = values.flatten().to_numpy(zero_copy_only=False)
        lo, hi = (block.column(c).to_numpy() for c in ("_first", "_last"))
        if not np.isfinite(values.flatten().to_numpy(zero_copy_only=False)).all():
            raise ValueError("smoothing values must be finite")
        known = y[:, : int(sizes.max())]
        if steps:
            fits = [_refined_fits(known, lo, hi, points, horizon, season, steps)]
        else:
            before = np.column_stack(_state_path(known, season))
            fits = (
                (np.full(rows.size, n), rows, np.concatenate([points[point], before[rows]], axis=1), sse, path)
                for n, rows, point, sse, path in _best_fits(known, lo, hi, points, horizon, season)
            )
        for train_rows, rows, unknowns, sse, path in filter(None, fits):
            kept = block.select(carried).take(pa.array(rows))
            ahead = train_rows[:, None] + np.arange(horizon)
            new = [
                pa.array(train_rows.astype(np.int32)),
                pa.array(sse),
                *[pa.array(unknowns[:, k]) for k in range(4)],
                lists(path),
                lists(y[rows[:, None], ahead]),
                lists(unknowns[:, 4:]),
            ]
            yield pa.RecordBatch.from_arrays([*kept.columns, *new], names=[f.name for f in schema.fields])

    together = REFINED_PER_BLOCK if steps else SERIES_PER_BLOCK

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, together):
                yield from fit_block(batch.slice(start, together))

    inputs = arrays.select(*carried, "y", first.cast("int").alias("_first"), last.cast("int").alias("_last"))
    return inputs.mapInArrow(fit, schema)


def smoothing_backtest(
    panel: DataFrame,
    horizon: int = HORIZON,
    n_origins: int = N_ORIGINS,
    min_history: int = MIN_HISTORY_MONTHS,
    season: int = SEASON,
    grid: Iterable[Parameters] = GRID,
    steps: int = 0,
) -> DataFrame:
    """Rolling-origin predictions of every series; ``steps`` refines each fit from its grid point."""
    arrays = _series_arrays(panel, season)
    n = F.col("_n").cast("int")
    short = F.raise_error(F.lit("too few months for a rolling-origin window")).cast("int")
    last = F.when(n < min_history + horizon, short).otherwise(n - horizon)
    first = F.greatest(F.lit(min_history), n - horizon - n_origins + 1)
    fitted = fit_paths(arrays, first, last, tuple(grid), horizon, season, steps)
    pairs = F.arrays_zip("path", "actuals")
    steps = fitted.select("series_id", *SERIES_ATTRS, "_start", "train_rows", F.posexplode(pairs).alias("_step", "_pair"))
    step = (F.col("_step") + 1).cast("int")
    return with_errors(
        steps.select(
            F.lit(MODEL_SMOOTHING).alias("model"),
            "series_id",
            *SERIES_ATTRS,
            F.add_months("_start", F.col("train_rows") - 1).alias("origin"),
            F.add_months("_start", F.col("train_rows") - 1 + step).alias("forecast_period"),
            step.alias("horizon_step"),
            F.col("_pair.actuals").alias("actual"),
            F.col("_pair.path").alias("predicted"),
        )
    ).select(*PREDICTION_COLUMNS, *ERROR_COLUMNS)


def smoothing_fits(panel: DataFrame, grid: Iterable[Parameters] = GRID, season: int = SEASON, steps: int = 0) -> DataFrame:
    """Chosen parameters and squared error of every series fitted on its whole history; refined fits carry their start state."""
    arrays = _series_arrays(panel, season)
    n = F.col("_n").cast("int")
    shown = ["series_id", "train_rows", "sse", "alpha", "beta", "gamma", "phi", *(["start"] if steps else [])]
    return fit_paths(arrays, n, n, tuple(grid), 1, season, steps).select(*shown)


def smoothing_forward(
    history: DataFrame, horizon: int = HORIZON, grid: Iterable[Parameters] = GRID, season: int = SEASON, steps: int = 0
) -> DataFrame:
    """Forward forecasts from the whole history; all series must end in the same month. ``steps`` refines as in the backtest."""
    arrays = _series_arrays(history, season)
    n = F.col("_n").cast("int")
    fitted = fit_paths(arrays, n, n, tuple(grid), horizon, season, steps)
    steps = fitted.select("series_id", *SERIES_ATTRS, F.posexplode("path").alias("_step", "predicted"))
    calendar = F.broadcast(future_periods(history, horizon))  # one row per forecast month
    return (
        steps.withColumn("horizon_step", (F.col("_step") + 1).cast("int"))
        .join(calendar, "horizon_step")
        .select(
            F.lit(MODEL_SMOOTHING).alias("model"),
            "series_id",
            *SERIES_ATTRS,
            "forecast_origin",
            "forecast_period",
            "horizon_step",
            "predicted",
        )
    )
