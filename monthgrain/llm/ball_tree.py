"""Ranked lexical search as an exact maximum inner product over sparse ball trees.

The score of a document for a query is the inner product of two whole-number vectors over the query terms: the term's weight
times its repeats in the query, and the saturated frequency of the term in the document.

1. Query terms are counted.  Queries are taken in blocks of at most ``QUERY_TERMS`` distinct terms per query added up (or one query),
   so what travels to every task is bounded whatever the query table holds.
2. One pass cuts every document into terms and keeps its length and the frequencies of the block's terms, as two arrays.
   Document frequencies, the number of documents and the total length are aggregations of that table.
3. Each task turns its documents into vectors, ``SHARD`` documents at a time, and builds a ball tree over them: a node has the
   centroid of its documents and the radius of the ball that holds all of them, and along each term the radius of the ball
   that holds their projections; a node is split by which of two far documents is nearer.
   Shards are cut from documents sorted by length class and first term, so that a ball holds documents that are alike.
4. A query visits subtrees best-first.  The bound of a subtree is the inner product with its centroid plus the smaller of the
   query's norm times the radius and the sum of its weights times the radii along its terms (few terms of many: the second
   is the one that prunes).  Bounds are rounded up by more than the error of the double arithmetic, and only a subtree whose
   bound is below the query's present k-th score is left out, so no tie is lost.  The k-th score is carried from shard to shard.
5. Leaves are scored exactly in 64-bit integers.  A task returns its best k per query; a window keeps the best k of all.

Defined results: null texts have no terms; a query without terms, or whose terms no document holds, has no rows; documents of
score 0 are left out; equal scores are ordered by ascending doc_id, rows without an id first; repeated rows are ranked one by
one; repeated items are queries of their own; empty tables give no rows; other columns, whatever their names, are left out.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from monthgrain.llm import textkernel as tk
from monthgrain.llm.work import Work

TOP = 20
#: Term occurrences of the queries of one block.
QUERY_TERMS = 1 << 16
#: Documents of one tree, documents of a leaf, and cells (nodes x terms) that the centroids of a tree may hold.
SHARD = 4096
LEAF = 64
CELLS = 1 << 24
#: Relative slack of the bounds; sums of up to 2**20 doubles err by less.
SLACK = 1e-9
_OUTSIDE = np.ones(256, bool)
_OUTSIDE[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False


def terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of every run of letters, digits and bytes beyond ASCII."""
    return tk.words(np.where(_OUTSIDE[data], 0x20, 0x61).astype(np.uint8), offsets)


def hashed(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    start, end, owner = terms(data, offsets)
    return tk.range_hash(tk.prefix(tk.lowered(data)), start, end), start, end, owner


def _query_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(query, item_id, term hash, repeats) of every item."""
    for block in tk.blocks(batches, "text"):
        value, _, _, owner = hashed(*tk.flat(block.column(2)))
        cells, repeats = np.unique(np.stack([owner.astype(np.uint64), value], 1), axis=0, return_counts=True) if len(value) else (np.zeros((0, 2), np.uint64), np.zeros(0, int))
        row = pa.array(cells[:, 0].astype(np.int64))
        yield pa.RecordBatch.from_arrays(
            [block.column(0).take(row), block.column(1).take(row), pa.array(np.ascontiguousarray(cells[:, 1]).view(np.int64)), pa.array(repeats.astype(np.int64))],
            ["query", "item_id", "term", "repeats"],
        )


def _frequencies(known: np.ndarray):
    """doc_id, length, and the numbers and frequencies of the known terms of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in tk.blocks(batches, "text"):
            n = block.num_rows
            value, _, _, owner = hashed(*tk.flat(block.column(1)))
            length = np.bincount(owner, minlength=n)
            place = np.minimum(np.searchsorted(known, value), len(known) - 1)
            hit = known[place] == value
            cell, often = np.unique(owner[hit] * len(known) + place[hit], return_counts=True)
            ends = np.concatenate([[0], np.cumsum(np.bincount(cell // len(known), minlength=n))]).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x)) for x in ((cell % len(known)).astype(np.int32), often.astype(np.int64))]
            yield pa.RecordBatch.from_arrays([block.column(0), pa.array(length.astype(np.int64)), *lists], ["doc_id", "n", "terms", "tf"])

    return run


def saturated(tf: np.ndarray, n: np.ndarray, documents: int, total: int) -> np.ndarray:
    """Component of a document's vector: (10^9 * tf) div (1000 * tf + 12 * m)."""
    known, which = np.unique(n, return_inverse=True)
    m = 75 + np.array([25 * x * documents // total for x in known.tolist()], np.int64)[which]  # beyond 64 bits on the way
    return 1_000_000_000 * tf // (1000 * tf + 12 * m)


@dataclass
class Queries:
    """The queries of one block as sparse rows over the block's terms."""

    ids: np.ndarray
    begin: np.ndarray
    term: np.ndarray
    weight: np.ndarray

    def __post_init__(self) -> None:
        squares = np.concatenate([[0.0], np.cumsum(self.weight.astype(float) ** 2)])
        self.norm = np.sqrt(np.diff(squares[self.begin])) * (1 + SLACK)

    def row(self, q: int) -> tuple[np.ndarray, np.ndarray]:
        a, b = self.begin[q], self.begin[q + 1]
        return self.term[a:b], self.weight[a:b]


@dataclass
class Rows:
    """Documents as sparse rows of whole numbers over the block's terms."""

    begin: np.ndarray
    term: np.ndarray
    value: np.ndarray

    def __len__(self) -> int:
        return len(self.begin) - 1

    def taken(self, rows: np.ndarray) -> Rows:
        count = np.diff(self.begin)[rows]
        begin = np.concatenate([[0], np.cumsum(count)])
        at = np.arange(int(begin[-1])) + np.repeat(self.begin[rows] - begin[:-1], count)
        return Rows(begin, self.term[at], self.value[at])

    def dot(self, point: np.ndarray) -> np.ndarray:
        """Inner product of every row (none is empty) with a dense vector."""
        return np.add.reduceat(self.value * point[self.term], self.begin[:-1])


class BallTree:
    """Centroid and radius of every subtree; ``rows`` are reordered so that a subtree is a run of them."""

    def __init__(self, rows: Rows, width: int, leaf: int = LEAF) -> None:
        self.width, self.leaf = width, leaf
        self.spans: list[tuple[int, int]] = []
        self.children: list[tuple[int, int] | None] = []
        self.centroids: list[np.ndarray] = []
        self.radii: list[float] = []
        self.spreads: list[np.ndarray] = []
        self.order: list[np.ndarray] = []
        self._grow(rows, np.arange(len(rows)), 0)
        self.rows = rows.taken(np.concatenate(self.order))
        self.places = np.concatenate(self.order)
        self.centroid = np.stack(self.centroids)
        self.radius = np.array(self.radii)
        self.spread = np.stack(self.spreads)

    def _distance(self, rows: Rows, squares: np.ndarray, point: np.ndarray, own: float) -> np.ndarray:
        """Distances from a point, never below the true ones: the cancellation of three sums is added back."""
        return np.sqrt(np.maximum(squares - 2 * rows.dot(point) + own, 0) + SLACK * 1e-3 * (squares + own))

    def bounds(self, queries: Queries) -> np.ndarray:
        """No document of a node (row) scores more for a query (column)."""
        weight, first = queries.weight.astype(float), queries.begin[:-1]
        inner = np.add.reduceat(self.centroid[:, queries.term] * weight, first, axis=1)
        apart = np.add.reduceat(self.spread[:, queries.term] * weight, first, axis=1)
        return (inner + np.minimum(self.radius[:, None] * queries.norm[None, :], apart)) * (1 + SLACK) + 1

    def _grow(self, rows: Rows, places: np.ndarray, first: int) -> int:
        node, n = len(self.spans), len(rows)
        centre = np.bincount(rows.term, weights=rows.value, minlength=self.width) / n
        squares = np.add.reduceat(rows.value * rows.value, rows.begin[:-1])
        away = self._distance(rows, squares, centre, float(centre @ centre))
        self.spans.append((first, first + n))
        self.children.append(None)
        self.centroids.append(centre)
        self.radii.append(float(away.max()) * (1 + SLACK))
        high, low = np.zeros(self.width), np.zeros(self.width)
        np.maximum.at(high, rows.term, rows.value)
        common = np.bincount(rows.term, minlength=self.width) == n
        low[common] = high[common]
        np.minimum.at(low, rows.term, np.where(common[rows.term], rows.value, 0))
        self.spreads.append(np.maximum(high - centre, centre - low))
        if n <= self.leaf:
            self.order.append(places)
            return node
        point = np.zeros(self.width)

        def to(row: int) -> np.ndarray:
            a, b = rows.begin[row], rows.begin[row + 1]
            point[rows.term[a:b]] = rows.value[a:b]
            out = self._distance(rows, squares, point, float(squares[row]))
            point[rows.term[a:b]] = 0
            return out

        left = to(int(np.argmax(away)))
        lean = left - to(int(np.argmax(left)))
        cut = int(np.count_nonzero(lean < 0))
        least = max(n // 8, 1)
        cut = min(max(cut, least), n - least)  # the depth stays logarithmic
        by = np.argsort(lean, kind="stable")
        one = self._grow(rows.taken(by[:cut]), places[by[:cut]], first)
        two = self._grow(rows.taken(by[cut:]), places[by[cut:]], first + cut)
        self.children[node] = (one, two)
        return node


class _Best:
    """The k best (score, doc_id) of every query: higher scores first, then smaller ids, rows without an id before them."""

    def __init__(self, n: int, k: int) -> None:
        self.k = k
        self.heaps: list[list[tuple]] = [[] for _ in range(n)]

    def least(self, q: int) -> int:
        return self.heaps[q][0][0] if len(self.heaps[q]) == self.k else 1

    def offer(self, q: int, score: int, doc: int | None) -> None:
        entry = (score, 1, 0) if doc is None else (score, 0, -doc)
        heap = self.heaps[q]
        if len(heap) < self.k:
            heapq.heappush(heap, entry)
        elif entry > heap[0]:
            heapq.heapreplace(heap, entry)


def search_shard(ids: list, rows: Rows, width: int, queries: Queries, best: _Best, leaf: int = LEAF) -> int:
    """Best-first search of every query in one shard; returns how many documents were scored."""
    tree = BallTree(rows, width, leaf)
    rows, scored = tree.rows, 0
    whole = rows.value.astype(np.int64)
    bound = tree.bounds(queries)
    weights = np.zeros(width, np.int64)
    for q in range(len(queries.ids)):
        term, weight = queries.row(q)
        weights[term] = weight
        waiting = [(-bound[0, q], 0)]
        while waiting:
            high, node = heapq.heappop(waiting)
            least = best.least(q)
            if -high < least:
                break
            if tree.children[node] is not None:
                for child in tree.children[node]:
                    limit = min(bound[child, q], -high)
                    if limit >= least:
                        heapq.heappush(waiting, (-limit, child))
                continue
            a, b = tree.spans[node]
            first, last = rows.begin[a], rows.begin[b]
            scores = np.add.reduceat(whole[first:last] * weights[rows.term[first:last]], rows.begin[a:b] - first)
            scored += b - a
            for i in np.flatnonzero(scores >= least).tolist():
                best.offer(q, int(scores[i]), ids[tree.places[a + i]])
        weights[term] = 0
    return scored


def _searched(queries: Queries, documents: int, total: int, width: int, k: int, leaf: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Best(len(queries.ids), k)
        size = max(leaf, min(SHARD, CELLS // width * leaf // 2))
        for batch in batches:
            for i in range(0, batch.num_rows, size):
                part = batch.slice(i, size)
                lists = part.column(2)
                begin = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))])
                n = np.repeat(part.column(1).to_numpy(), np.diff(begin))
                # components are below 10^6 + 1, exact in doubles
                value = saturated(part.column(3).flatten().to_numpy(), n, documents, total).astype(float)
                rows = Rows(begin, lists.flatten().to_numpy(), value)
                search_shard(part.column(0).to_pylist(), rows, width, queries, best, leaf)
        rows = [(q, score, None if bare else -negative) for q, heap in enumerate(best.heaps) for score, bare, negative in heap]
        names = ["item_id", "query", "score", "doc_id"]
        query = np.array([r[0] for r in rows], np.int64)
        columns = [pa.array([queries.ids[q][1] for q in query], pa.int64()), pa.array([queries.ids[q][0] for q in query], pa.int64())]
        yield pa.RecordBatch.from_arrays([*columns, pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64())], names)

    return run


def _block(docs: DataFrame, rows: list, work: Work, k: int, leaf: int, name: str) -> DataFrame:
    """Best k of every query of one block, per task."""
    known = np.unique(np.array([r.term for r in rows], np.int64).view(np.uint64))
    path = f"{name}-frequencies"
    held = work.save(docs.mapInArrow(_frequencies(known), "doc_id long, n long, terms array<int>, tf array<long>"), path)
    facts = held.agg(F.count_if(F.col("n") > 0).alias("documents"), F.sum("n").alias("total")).first()
    often = held.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    df = np.zeros(len(known))
    for r in often.collect():  # one row per term of the block
        df[r.term] = r.df
    weight = np.floor(1000 * np.log((2 * facts.documents + 2) / (2 * df + 1))).astype(np.int64)
    ordered = sorted(rows, key=lambda r: r.query)
    ids = sorted({(r.query, r.item_id) for r in ordered}, key=lambda x: x[0])
    begin = np.searchsorted([r.query for r in ordered], [q for q, _ in ids] + [ids[-1][0] + 1])
    term = np.searchsorted(known, np.array([r.term for r in ordered], np.int64).view(np.uint64))
    queries = Queries(ids, begin, term, weight[term] * np.array([r.repeats for r in ordered], np.int64))
    alike = held.filter(F.size("terms") > 0).sortWithinPartitions(F.floor(F.log2(F.col("n"))), F.try_element_at("terms", F.lit(1)))
    run = _searched(queries, facts.documents, max(facts.total or 0, 1), len(known), k, leaf)
    return alike.mapInArrow(run, "item_id long, query long, score long, doc_id long")


def search(docs: DataFrame, items: DataFrame, work: Work, k: int = TOP, leaf: int = LEAF, query_terms: int = QUERY_TERMS) -> DataFrame:
    """item_id, rank, doc_id and score of the ``k`` best documents (doc_id, text) of every item (item_id, text)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    asked = items.select(F.monotonically_increasing_id().alias("query"), F.col("item_id").cast("long").alias("item_id"), "text")
    asked = work.save(asked.mapInArrow(_query_rows, "query long, item_id long, term long, repeats long"), "queries")
    # queries in order, cut into blocks by the running number of their terms (one row per query)
    sizes = asked.groupBy("query").agg(F.count("*").alias("terms"))
    blocks, held = [[]], 0
    for r in sizes.orderBy("query").toLocalIterator():
        if held and held + r.terms > query_terms:
            blocks.append([])
            held = 0
        blocks[-1].append(r.query)
        held += r.terms
    found = []
    for i, block in enumerate(blocks):
        if block:
            own = asked.filter((F.col("query") >= block[0]) & (F.col("query") <= block[-1]))
            best = _block(rows, own.collect(), work, k, leaf, f"block-{i}")
            found.append(work.save(best, f"block-{i}-best"))
    if not found:
        return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    every = found[0]
    for other in found[1:]:
        every = every.unionByName(other)
    rank = F.row_number().over(W.partitionBy("query").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_first()))
    return every.withColumn("rank", rank).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
