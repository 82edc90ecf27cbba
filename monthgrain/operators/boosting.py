"""Boosted regression trees of many models at once: one pass over all rows per level of a tree, whatever the number of models.

The rows of every model are cut into at most ``BINS`` bins per feature by quantiles of that model's own rows, and kept in
partitions as blocks.  For each level every task adds up, by model, node, feature and bin, how many rows there are and what is left
to explain; the sums of a model meet in one reducer (where a task holds a model whole, there), which returns only the best split of each node.  Locations are a
category: a split parts one location from the others, as a one-hot column would.

The scheme is that of Spark's learner: the first tree fits the values, each later one twice the remaining error, shrunk by
``step``; a leaf predicts the mean of its rows; a row is drawn for a tree by a hash of its key, so neither the order of
rows nor their partitions matter.  What is added up are whole multiples of a small unit, so sums do not depend on their order either.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, functions as F

BINS = 32
LEAF, PLACE = -1, -2
#: Trees after which the predictions so far are kept anew.
KEPT_AFTER = 3
#: Parts of the largest value that are told apart.
UNITS = float(1 << 26)


@dataclass(frozen=True)
class Learner:
    trees: int
    depth: int
    step: float
    subsample: float
    seed: int


@dataclass
class Tree:
    """A complete binary tree: feature (or ``LEAF``, ``PLACE``), bin or place of the split, and the mean of each node."""

    feature: np.ndarray
    split: np.ndarray
    value: np.ndarray
    weight: float

    @staticmethod
    def empty(depth: int, weight: float) -> Tree:
        size = (2 << depth) - 1
        return Tree(np.full(size, LEAF, np.int32), np.zeros(size, np.int64), np.zeros(size), weight)


def _leaves(tree: Tree, bins: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Node of each row; ``bins`` is (feature, row)."""
    node, rows = np.zeros(len(place), np.int64), np.arange(len(place))
    for _ in range(len(tree.feature).bit_length() - 1):
        feature, split = tree.feature[node], tree.split[node]
        right = np.where(feature == PLACE, place == split, bins[np.maximum(feature, 0), rows] > split)
        node = np.where(feature == LEAF, node, 2 * node + 1 + right)
    return node


def _grown(fitted: np.ndarray, trees: list[Tree], bins: np.ndarray, place: np.ndarray) -> np.ndarray:
    for tree in trees:
        fitted = fitted + tree.weight * tree.value[_leaves(tree, bins, place)]
    return fitted


def _drawn(key: np.ndarray, seed: int, number: int, share: float) -> np.ndarray:
    """Whether each row is drawn for a tree (splitmix64 of its key)."""
    with np.errstate(over="ignore"):
        x = key + np.uint64((seed * 1_000_003 + number + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)) < share * (1 << 53)


def _binned(cuts: dict[int, list[np.ndarray]], places: dict[int, np.ndarray]):
    """Rows (model, location_key, key, value, features) as blocks of one model each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            model, key, value = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 2, 3))
            where = batch.column(1).to_numpy(zero_copy_only=False).astype(str)
            features = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4, batch.num_columns)]
            out = []
            for m in np.unique(model).tolist():
                at = model == m
                bins = np.stack([np.searchsorted(c, x[at], "left") for c, x in zip(cuts[m], features)]).astype(np.uint8)
                place = np.searchsorted(places[m], where[at]).astype(np.int32)
                out.append(pickle.dumps((m, bins, place, value[at].astype(float), key[at].view(np.uint64), np.zeros(at.sum()))))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["block"])

    return run


def _merged(blocks: Iterator) -> Iterator[tuple]:
    """One block per model and partition."""
    held: dict[int, list] = {}
    for block in blocks:
        m, *parts = pickle.loads(block)
        held.setdefault(m, []).append(parts)
    for m, parts in held.items():
        bins, *rest = zip(*parts)
        yield m, np.concatenate(bins, axis=1), *(np.concatenate(r) for r in rest)


def _sums(level: int, number: int, learner: Learner, done: dict, growing: dict, unit: dict, width: dict):
    """Per model: rows and remaining error by node, feature and bin, and by node and place."""

    def run(part: Iterator[tuple]) -> Iterator[tuple]:
        for m, bins, place, value, key, fitted in part:
            drawn = _drawn(key, learner.seed, number, learner.subsample)
            bins, place = bins[:, drawn], place[drawn]
            left = value[drawn] if number == 0 else 2 * (value[drawn] - _grown(fitted[drawn], done[m], bins, place))
            node = _leaves(growing[m], bins, place) - ((1 << level) - 1)
            open_ = node >= 0
            node, bins, place, left = node[open_], bins[:, open_], place[open_], np.rint(left[open_] / unit[m])
            size = 1 << level
            added = lambda at, left, n: np.array((np.bincount(at, minlength=n), np.bincount(at, left, n)))
            cell = (np.arange(len(bins))[:, None] * size + node) * BINS + bins
            numeric = added(cell.reshape(-1), np.tile(left, len(bins)), len(bins) * size * BINS)
            by_place = added(node * width[m] + place, left, size * width[m])
            yield m, (numeric.reshape(2, len(bins), size, BINS), by_place.reshape(2, size, width[m]))

    return run


def _best(sums: tuple[np.ndarray, np.ndarray]) -> list[tuple]:
    """(node, feature, split, mean, mean left, mean right) of each node that has rows; feature ``LEAF`` where nothing parts it."""
    numeric, places = sums
    out = []
    for node in range(places.shape[1]):
        n, s = (float(x) for x in places[:, node].sum(1))
        if not n:
            continue
        below = np.cumsum(numeric[:, :, node], axis=2)[:, :, :-1]  # (rows and sum, feature, bin)
        # a location's own rows are the right side
        left_n = np.concatenate([below[0].reshape(-1), n - places[0, node]])
        left_s = np.concatenate([below[1].reshape(-1), s - places[1, node]])
        right_n, right_s = n - left_n, s - left_s
        fits = (left_n > 0) & (right_n > 0)
        gain = left_s**2 / np.maximum(left_n, 1) + right_s**2 / np.maximum(right_n, 1) - s * s / n
        gain = np.where(fits, gain, -1.0)
        top = int(np.argmax(gain))
        if gain[top] <= 0:
            out.append((node, LEAF, 0, s / n, 0.0, 0.0))
            continue
        cut = below[0].size
        feature, split = divmod(top, BINS - 1) if top < cut else (PLACE, top - cut)
        out.append((node, feature, split, s / n, left_s[top] / left_n[top], right_s[top] / right_n[top]))
    return out


def fit(rows: DataFrame, features: list[str], places: dict[int, np.ndarray], learner: Learner, rows_per_task: int) -> dict[int, list[Tree]]:
    """Trees of every model; ``rows`` has model, location_key, key, value and the features, a row per model that it trains.

    Splits of the trees are thresholds (a row goes left up to it) and, of places, numbers in ``places``.
    """
    at = [i / BINS for i in range(1, BINS)]
    cut = [F.percentile_approx(F.col(c).cast("double"), at, 10_000).alias(c) for c in features]
    seen = rows.groupBy("model").agg(F.count("*").alias("n"), F.max(F.abs("value")).alias("most"), *cut).collect()
    if {r.model for r in seen} != set(places):
        raise ValueError("a model has no training rows")
    cuts = {r.model: [np.unique(np.array(r[c], float)) for c in features] for r in seen}
    unit = {r.model: (r.most or 1.0) / UNITS for r in seen}
    width = {m: len(p) for m, p in places.items()}
    cores = rows.sparkSession.sparkContext.defaultParallelism
    # models that fit into a task each are dealt to tasks whole: their sums need no shuffle
    whole = max(r.n for r in seen) <= rows_per_task
    tasks = 1 + sum(r.n for r in seen) // rows_per_task
    tasks = max(tasks, min(len(places), cores)) if whole else tasks
    plain = rows.select("model", "location_key", "key", F.col("value").cast("double"), *(F.col(c).cast("double") for c in features))
    blocks = plain.repartition(tasks, "model" if whole else "key").mapInArrow(_binned(cuts, places), "block binary")
    state = blocks.rdd.map(lambda r: bytes(r.block)).mapPartitions(_merged).persist(StorageLevel.MEMORY_AND_DISK)
    trees: dict[int, list[Tree]] = {m: [] for m in places}
    done: dict[int, list[Tree]] = {m: [] for m in places}
    older = None
    reducers = min(len(places), max(2, tasks))
    both = lambda a, b: (a[0] + b[0], a[1] + b[1])
    for number in range(learner.trees):
        growing = {m: Tree.empty(learner.depth, 1.0 if number == 0 else learner.step) for m in places}
        for level in range(learner.depth):
            sums = state.mapPartitions(_sums(level, number, learner, done, growing, unit, width))
            first = (1 << level) - 1
            split = 0
            added = sums if whole else sums.reduceByKey(both, reducers)
            for m, nodes in added.mapValues(_best).collect():
                tree = growing[m]
                for node, feature, cut_at, mean, left, right in nodes:
                    i = first + node
                    tree.value[i] = mean * unit[m]
                    if feature != LEAF:
                        tree.feature[i], tree.split[i] = feature, cut_at
                        tree.value[2 * i + 1], tree.value[2 * i + 2] = left * unit[m], right * unit[m]
                        split += 1
            if older is not None:
                older.unpersist()
                older = None
            if not split:
                break
        for m, tree in growing.items():
            trees[m].append(tree)
            done[m] = [*done[m], tree]
        if (number + 1) % KEPT_AFTER == 0:
            apply = lambda b, done=done: (*b[:5], _grown(b[5], done[b[0]], b[1], b[2]))
            older, state = state, state.map(apply).persist(StorageLevel.MEMORY_AND_DISK)
            done = {m: [] for m in places}
    state.unpersist()
    for m, own in trees.items():
        for tree in own:
            numeric = tree.feature >= 0
            bound = [cuts[m][f][s] if f >= 0 else float(s) for f, s in zip(tree.feature, tree.split)]
            tree.split = np.where(numeric | (tree.feature == PLACE), bound, 0.0)
    return trees


def predict(trees: list[Tree], features: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Predictions of rows: ``features`` is (feature, row)."""
    return _grown(np.zeros(len(place)), trees, features, place)
