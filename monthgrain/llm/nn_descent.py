"""Approximate nearest neighbours: NN-descent builds a neighbour graph, queries walk it greedily.

Equal vectors are one node, so a vector that a third of the rows hold is one node with many members.  The graph starts from
small groups of vectors that fall on the same side of random planes (large groups are salted into small ones) and from random
groups.  Each round joins neighbours of neighbours: around every node, its neighbours and a sample of the nodes that name it
meet; pairs with a link that is new since the last round are measured in double precision, as differences of the original
vectors, and what beats a node's current neighbours enters the next round's top ``k``.  Rounds stop when few links change.

A query starts at its own node, keeps the ``beam`` nearest nodes seen, expands those not yet expanded along links in both
directions, and stops when all are; all queries walk together, one join per step.  A node that has left the ``beam`` cannot come
back, so every node is expanded at most once and each walk ends by itself.  Such nodes stay in the walk's table without their
score, so that no node is measured twice for a query.  Distances there are Euclidean in double
precision on the original vectors, and members of equal vectors are added at the end, smallest ids first.

The beam is wide, since vectors without clusters have many nodes nearly as near as the true ones: a narrow one ends in a local
minimum.  What a walk measures grows with the table until it reaches the beam times the links of a node, so a denser graph (``k``)
with a narrower beam is the cheaper way to the same recall: the graph grows in proportion to the nodes.

Nodes are dealt by a hash into blocks of some thousands, and what passes between blocks travels as arrays, one row per pair of
blocks.  A round fetches the vector of a node once for a block, not once for each neighbourhood that it is in.  A block also
knows which queries have met its nodes, so a step of the walk goes from the beams to the blocks of the front's links, on to the
blocks of the linked nodes, where what is new is measured, and back to the beams with what may enter them.

Sampling of reverse neighbours (``reverse``) is part of the method; recall is measured in the tests against brute force.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components take no part, nor do those of another
length than the most frequent (the longer of two); a null id takes no part; of rows that repeat an id, the one with the
smallest vector does; ties go to the smaller id; an empty table gives no rows; other columns are left out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from monthgrain.llm.work import Work

GRAPH = "u long, v long, d double"
#: A node and the queries (by place) that have met it; of those that met it last and may keep it, also the scores.
MET = "node long, q binary, entered binary, score binary"
MET_FIELDS = pa.schema([("node", pa.int64()), *((c, pa.binary()) for c in ("q", "entered", "score"))])
#: What blocks send to each other: arrays as bytes.
MESSAGE = "to int, kind int, a binary, b binary, c binary, d binary, n long"
FIELDS = pa.schema([("to", pa.int32()), ("kind", pa.int32()), *((c, pa.binary()) for c in "abcd"), ("n", pa.int64())])
CODES, LISTS, REVERSE, AROUND, WANTED, VECTORS, FOUND, LINKS, FRONT, REACHED, SEEN, BEAM, SCORED = range(13)
#: Numbers that a local join may hold at once as differences.
HELD = 4 << 20
#: Queries whose beams are kept together.
BEAMS = 64
#: Rows that a task gathers before it sends them.
GATHERED = 1 << 20

@dataclass(frozen=True)
class Settings:
    k: int = 28
    reverse: int = 16
    planes: int = 4
    group: int = 64
    rounds: int = 8
    settled: float = 0.004
    beam: int = 400
    seed: int = 20


def usable(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """id, vec (double) of the rows that take part, one per id."""
    vec = F.transform(F.col(vector), lambda x: x.cast("double"))
    finite = ~F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    good = rows.select(F.col(key).alias("id"), vec.alias("vec")).filter(F.col("id").isNotNull() & (F.size("vec") > 0))
    good = good.filter(finite & F.exists("vec", lambda x: x != 0))
    size = good.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    length = size["n"] if size else 0
    return good.filter(F.size("vec") == length).groupBy("id").agg(F.min("vec").alias("vec"))



def _mixed(ids: np.ndarray) -> np.ndarray:
    """A hash of each id (splitmix64); equal only for equal ids."""
    x = ids.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _dealt(ids: np.ndarray, blocks: int) -> np.ndarray:
    """The block of each id."""
    return (_mixed(ids) % np.uint64(blocks)).astype(np.int32)


def _stable(small: np.ndarray) -> np.ndarray:
    """The stable order of whole numbers from 0: numpy sorts 16 bits by counting."""
    order = np.argsort(small.astype(np.uint16), kind="stable")
    high = 16
    while len(small) and int(small.max()) >> high:
        order = order[np.argsort((small[order] >> high).astype(np.uint16), kind="stable")]
        high += 16
    return order


def _message(to: int, kind: int, *arrays: np.ndarray, n: int = 0) -> tuple:
    parts = [np.ascontiguousarray(x).tobytes() for x in arrays]
    return (int(to), kind, *parts, *[None] * (4 - len(parts)), int(n))


def _messages(kind: int, to: np.ndarray, *arrays: np.ndarray) -> Iterator[tuple]:
    """One message for each block that ``to`` names, with its part of every array."""
    if not len(to):
        return
    order = _stable(to)
    to = to[order]
    starts = np.flatnonzero(_ranked(to) == 0)
    for first, rows in zip(starts, np.split(order, starts[1:])):
        yield _message(to[first], kind, *(x[rows] for x in arrays))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[]] * len(FIELDS)
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(columns, FIELDS)], schema=FIELDS)


class _Inbox:
    """The messages of one block."""

    def __init__(self, table: pa.Table) -> None:
        self.to = table["to"][0].as_py() if len(table) else 0
        self.kinds = table["kind"].to_numpy()
        self.columns = {c: table[c] for c in "abcd"}

    def each(self, kind: int, *types: type) -> Iterator[tuple[np.ndarray, ...]]:
        for i in np.flatnonzero(self.kinds == kind):
            yield tuple(np.frombuffer(self.columns[c][int(i)].as_buffer(), t) for c, t in zip("abcd", types))

    def all(self, kind: int, *types: type) -> list[np.ndarray]:
        found = list(self.each(kind, *types))
        return [np.concatenate([np.zeros(0, t), *(x[i] for x in found)]) for i, t in enumerate(types)]


def _by_block(run: Callable[[_Inbox], Iterator[tuple]], *sent: DataFrame) -> DataFrame:
    """What the blocks send when they have got their messages."""

    def block(table: pa.Table) -> pa.Table:
        return pa.Table.from_batches([_batch(list(run(_Inbox(table))))])

    return _gathered(*sent).applyInArrow(block, MESSAGE)


def _gathered(*sent: DataFrame):
    messages = sent[0]
    for other in sent[1:]:
        messages = messages.unionByName(other)
    return messages.groupBy("to")


def _send(rows: DataFrame, run: Callable[..., Iterator[tuple]]) -> DataFrame:
    """The messages made of the columns of many rows."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= GATHERED:
                yield made(held)
                held = []
        if sum(b.num_rows for b in held):
            yield made(held)

    def made(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        columns = pa.Table.from_batches(held).columns
        return _batch(list(run(*(x.to_numpy() for x in columns))))

    return rows.mapInArrow(send, MESSAGE)


def _each_block(messages: DataFrame, run: Callable[[_Inbox], Iterator[tuple]]) -> DataFrame:
    """What every message's block sends on its own."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield _batch(list(run(_Inbox(pa.Table.from_batches([batch.slice(i, 1)])))))

    return messages.mapInArrow(send, MESSAGE)


def _codes(nodes: DataFrame, blocks: int) -> DataFrame:
    """The ids and vectors of every block, by id: 32 bits a number where those are exact."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                ids, vectors = batch.column(0).to_numpy(), _matrix(batch.column(1))
                yield _batch(list(_messages(VECTORS, _dealt(ids, blocks), ids, vectors)))

    def join(box: _Inbox) -> Iterator[tuple]:
        ids, flat = box.all(VECTORS, np.int64, np.float64)
        order = np.argsort(ids)
        vectors = flat.reshape(len(ids), -1)[order]
        with np.errstate(over="ignore"):
            narrow = vectors.astype(np.float32)
        yield _message(box.to, CODES, ids[order], narrow if np.array_equal(narrow, vectors) else vectors, n=len(ids))

    return _by_block(join, nodes.mapInArrow(pack, MESSAGE))


def _matrix(lists: pa.Array) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)


def _vectors(part: np.ndarray, size: int, dim: int) -> np.ndarray:
    """The vectors of so many ids, of bytes."""
    return part.view(np.float32 if part.nbytes == 4 * size * dim else np.float64).reshape(size, dim)


def _plane_groups(size: int, settings: Settings, center: list[float]):
    """Side of random planes through the centre, once per table of planes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        middle = np.array(center)
        bits = max(0, int(np.ceil(np.log2(max(size / settings.group, 1)))))
        for batch in batches:
            for i in range(batch.num_rows):
                ((ids, code),) = _Inbox(pa.Table.from_batches([batch.slice(i, 1)])).each(CODES, np.int64, np.uint8)
                vectors = _vectors(code, len(ids), len(middle)).astype(float)
                for t in range(settings.planes):
                    planes = np.random.default_rng(settings.seed + t).standard_normal((len(middle), bits))
                    sides = ((vectors - middle) @ planes > 0) @ (1 << np.arange(bits, dtype=np.int64)) if bits else np.zeros(len(vectors), np.int64)
                    table = pa.array(np.full(len(ids), t, np.int32))
                    yield pa.RecordBatch.from_arrays([table, pa.array(sides.astype(np.int64)), pa.array(ids)], ["t", "side", "id"])

    return run


def _ranked(key: np.ndarray) -> np.ndarray:
    """Place of every entry among the equal ones before it; equal ones lie together."""
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    return np.arange(len(key)) - np.repeat(first, np.diff(np.r_[first, len(key)]))


def _best(u: np.ndarray, v: np.ndarray, d: np.ndarray, new: np.ndarray, k: int) -> list[np.ndarray]:
    """The k nearest per node (u, a place), by node and distance; a link already in the graph is old."""
    if not len(u):
        return [u, v, d, new]
    order = np.argsort(v)
    order = order[_stable(u[order])]
    u, v = u[order], v[order]
    first = np.flatnonzero(np.r_[True, (u[1:] != u[:-1]) | (v[1:] != v[:-1])])
    u, v = u[first], v[first]
    d, new = np.minimum.reduceat(d[order], first), np.logical_and.reduceat(new[order], first)
    order = np.argsort(d)
    order = order[_stable(u[order])]
    if ((u[order[1:]] == u[order[:-1]]) & (d[order[1:]] == d[order[:-1]])).any():
        order = np.lexsort((v, d, u))
    order = order[_ranked(u[order]) < k]
    return [x[order] for x in (u, v, d, new)]


def _met(vectors: np.ndarray, bound: np.ndarray, sizes: np.ndarray, fresh: np.ndarray, members: np.ndarray, keep: int):
    """Links (u, v, d) of groups, all as places among the vectors, shorter than the bound of u.

    ``members`` has the groups one after the other, the first ``fresh`` of each new; a pair has a new side.
    """
    dim = vectors.shape[1]
    middle = np.median(vectors[:: max(1, len(vectors) // 1000)].astype(float), axis=0)
    bound, held, n_held = bound.copy(), [], 0
    starts = np.cumsum(sizes) - sizes
    order = np.lexsort((sizes, fresh))
    order = order[(fresh[order] > 0) & (sizes[order] > 1)]
    first, widest = 0, int(sizes.max(initial=1))
    while first < len(order):
        last = first + max(1, HELD // (8 * widest * (dim + widest)))
        some = order[first:last]
        first = last
        width, top = int(sizes[some].max()), int(fresh[some].max())
        column = np.arange(width)
        present = column < sizes[some][:, None]
        place = members[np.where(present, starts[some][:, None] + column, starts[some][:, None])]
        exact = vectors[place].astype(float, copy=False)
        near = exact - middle
        square = np.einsum("gix,gix->gi", near, near)
        total = square[:, :top, None] + square[:, None, :]
        far = total - 2 * (near[:, :top] @ near.transpose(0, 2, 1))
        good = (column[:top] < fresh[some][:, None])[:, :, None] & present[:, None, :] & (place[:, :top, None] != place[:, None, :])
        # the product loses near-equal vectors among long ones; those are measured as differences of the original vectors
        g, i, j = np.nonzero(good & ~(far > 1e-3 * total))
        for at in range(0, len(g), step := max(1, HELD // dim)):
            x, y, z = g[at : at + step], i[at : at + step], j[at : at + step]
            apart = exact[x, y] - exact[x, z]
            far[x, y, z] = np.einsum("px,px->p", apart, apart)
        with np.errstate(invalid="ignore"):
            far = np.sqrt(far)
        limit = bound[place]
        for here, swap in ((good & (far < limit[:, :top, None]), False), (good & (far < limit[:, None, :]) & (column >= fresh[some][:, None])[:, None, :], True)):
            g, i, j = np.nonzero(here)
            u, v = (place[g, j], place[g, i]) if swap else (place[g, i], place[g, j])
            held.append((u, v, far[g, i, j]))
            n_held += len(u)
        if n_held > HELD // 2:
            held = [_nearest(held, bound, keep)]
            n_held = len(held[0][0])
    return _nearest(held, bound, keep) if held else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


def _nearest(held: list[tuple[np.ndarray, ...]], bound: np.ndarray, keep: int) -> tuple[np.ndarray, ...]:
    """The ``keep`` nearest of each node; a node that has them is bound by the last of them."""
    u, v, d = (np.concatenate(x) for x in zip(*held))
    u, v, d, _ = _best(u, v, d, np.zeros(len(u), bool), keep)
    last = np.flatnonzero(_ranked(u) == keep - 1)
    # the bound itself may be met again
    bound[u[last]] = np.minimum(bound[u[last]], np.nextafter(d[last], np.inf))
    return u, v, d


def _reverse(blocks: int):
    def run(box: _Inbox) -> Iterator[tuple]:
        ids, sizes, v, _, new = _lists(box)
        yield from _messages(REVERSE, _dealt(v, blocks), v, np.repeat(ids, sizes), new)

    return run


def _lists(box: _Inbox) -> list[np.ndarray]:
    """ids, number of links of each, and the links one after the other: v, d, new."""
    ids, v, d, flags = (np.zeros(0, t) for t in (np.int64, np.int64, np.float64, np.int64))
    for ids, v, d, flags in box.each(LISTS, np.int64, np.int64, np.float64, np.int64):
        pass
    return [ids, flags[: len(ids)], v, d, flags[len(ids) :].astype(bool)]


def _packed_lists(to: int, ids: np.ndarray, u: np.ndarray, v: np.ndarray, d: np.ndarray, new: np.ndarray) -> tuple:
    sizes = np.bincount(u, minlength=len(ids)).astype(np.int64)
    return _message(to, LISTS, ids, v, d, np.r_[sizes, new.astype(np.int64)], n=new.sum())


def _around(settings: Settings, blocks: int, turn: int):
    """Around every node: its neighbours and a sample of those that name it, new ones first."""

    def run(box: _Inbox) -> Iterator[tuple]:
        ids, sizes, v, _, new = _lists(box)
        of, u, late = box.all(REVERSE, np.int64, np.int64, np.bool_)
        of = np.searchsorted(ids, of)
        draw = np.argsort(_mixed(u) ^ _mixed(of * 64 + turn))
        draw = draw[_stable((2 * of + ~late)[draw])]
        draw = draw[_ranked(of[draw]) < settings.reverse]
        g = np.r_[np.repeat(np.arange(len(ids)), sizes), of[draw]]
        yield from _groups(box.to, g, np.r_[v, u[draw]], np.r_[new, late[draw]], blocks)

    return run


def _groups(to: int, g: np.ndarray, member: np.ndarray, new: np.ndarray, blocks: int) -> Iterator[tuple]:
    """The groups (numbered) that have a new member, and what vectors they want."""
    if not len(g):
        return
    order = np.argsort(member)
    order = order[_stable(g[order])]
    g, member = g[order], member[order]
    first = np.flatnonzero(np.r_[True, (g[1:] != g[:-1]) | (member[1:] != member[:-1])])
    new = np.logical_or.reduceat(new[order], first)
    g, member = g[first], member[first]
    order = _stable(2 * g + ~new)
    g, member, new = g[order], member[order], new[order]
    first = np.flatnonzero(_ranked(g) == 0)
    sizes, fresh = np.diff(np.r_[first, len(g)]), np.add.reduceat(new.astype(np.int64), first)
    live = (fresh > 0) & (sizes > 1)
    member = member[np.repeat(live, sizes)]
    yield _message(to, AROUND, member, sizes[live], fresh[live])
    wanted = np.unique(member)
    for message in _messages(WANTED, _dealt(wanted, blocks), wanted):
        yield (*message[:3], np.int32(to).tobytes(), *message[4:])


def _answer(settings: Settings, dim: int):
    """Vectors and bounds of the nodes that other blocks want."""

    def run(box: _Inbox) -> Iterator[tuple]:
        for ids, code in box.each(CODES, np.int64, np.uint8):
            vectors, bound = _vectors(code, len(ids), dim), np.full(len(ids), np.inf)
            _, sizes, _, d, _ = _lists(box)
            if len(sizes):
                full = sizes == settings.k
                bound[full] = d[np.cumsum(sizes)[full] - 1]
            for wanted, asker in box.each(WANTED, np.int64, np.int32):
                at = np.searchsorted(ids, wanted)
                yield _message(asker[0], VECTORS, wanted, vectors[at], bound[at])

    return run


def _local_join(settings: Settings, blocks: int, dim: int):
    """Distances of all pairs with a new side in the groups of a block: each node's best few go to its block."""

    def run(box: _Inbox) -> Iterator[tuple]:
        for member, sizes, fresh in box.each(AROUND, np.int64, np.int64, np.int64):
            got = [(ids, _vectors(code, len(ids), dim), bound) for ids, code, bound in box.each(VECTORS, np.int64, np.uint8, np.float64)]
            if not got:
                return
            ids, vectors, bound = (np.concatenate(x) for x in zip(*got))
            order = np.argsort(ids)
            ids, vectors, bound = ids[order], vectors[order], bound[order]
            place = np.searchsorted(ids, member)
            u, v, d = _met(vectors, bound, sizes, fresh, place, settings.k)
            yield from _messages(FOUND, _dealt(ids[u], blocks), ids[u], ids[v], d)

    return run


def _merge(settings: Settings):
    def run(box: _Inbox) -> Iterator[tuple]:
        ids, sizes, v, d, new = _lists(box)
        u, w, far = box.all(FOUND, np.int64, np.int64, np.float64)
        late = np.r_[np.zeros(len(v), bool), np.ones(len(w), bool)]
        place = np.r_[np.repeat(np.arange(len(ids)), sizes), np.searchsorted(ids, u)]
        yield _packed_lists(box.to, ids, *_best(place, np.r_[v, w], np.r_[d, far], late, settings.k))

    return run


def _no_lists(box: _Inbox) -> Iterator[tuple]:
    for ids, _ in box.each(CODES, np.int64, np.uint8):
        yield _message(box.to, LISTS, ids, np.zeros(0, np.int64), np.zeros(0), np.zeros(len(ids), np.int64))


def _as_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            ids, sizes, v, d, _ = _lists(_Inbox(pa.Table.from_batches([batch.slice(i, 1)])))
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, sizes)), pa.array(v), pa.array(d)], ["u", "v", "d"])


def _blocks(size: int, dim: int, settings: Settings) -> int:
    """So many that a block can hold the vectors around its nodes, and some for small tables."""
    held = max(1, 2 * HELD // ((settings.k + settings.reverse) * max(1, dim)))
    return max(-(-size // held), min(16, size // 512 + 1))


def _shape(nodes: DataFrame) -> tuple[int, int]:
    """Number of nodes, and of their vectors' numbers."""
    found = nodes.agg(F.count("*").alias("n"), F.max(F.size("vec")).alias("dim")).first()
    return found["n"], found["dim"] or 0


def build(nodes: DataFrame, work: Work, settings: Settings) -> DataFrame:
    """(u, v, d) with the approximate k nearest nodes of every node; ``nodes`` has node and vec."""
    size, dim = _shape(nodes)
    blocks = _blocks(size, dim, settings)
    # medians: one huge component would move means so far that all others fall on one side
    cut = F.percentile_approx("x", 0.5, 1000).alias("x")
    middle = nodes.select(F.posexplode("vec").alias("i", "x")).groupBy("i").agg(cut).orderBy("i").collect()
    codes = work.save(_codes(nodes.select("node", "vec"), blocks), "codes")
    planes = codes.mapInArrow(_plane_groups(size, settings, [r["x"] for r in middle]), "t int, side long, id long")
    counted = planes.groupBy("t", "side").agg(F.count("*").alias("n"))
    salt = F.pmod(F.xxhash64("id", "t"), F.ceil(F.col("n") / settings.group))
    sides = planes.join(counted, ["t", "side"]).select(F.xxhash64("t", "side", salt).alias("g"), "id")
    chance = F.pmod(F.xxhash64(F.col("id"), F.lit(settings.seed)), F.lit(max(1, size // 16)))
    groups = sides.unionByName(planes.filter("t = 0").select(chance.alias("g"), "id"))

    def send(g: np.ndarray, ids: np.ndarray) -> Iterator[tuple]:
        yield from _messages(REVERSE, _dealt(g, blocks), g, ids)

    def first(box: _Inbox) -> Iterator[tuple]:
        g, ids = box.all(REVERSE, np.int64, np.int64)
        yield from _groups(box.to, np.unique(g, return_inverse=True)[1], ids, np.ones(len(g), bool), blocks)

    graph = work.save(_each_block(codes, _no_lists), "graph-start")
    for i in range(settings.rounds + 1):
        if i:
            pieces = _by_block(_around(settings, blocks, i), graph, _each_block(graph, _reverse(blocks)))
        else:
            pieces = _by_block(first, _send(groups, send))
        around = work.save(pieces, f"around-{i}")
        answers = _by_block(_answer(settings, dim), codes, graph, around.filter(F.col("kind") == WANTED))
        found = _by_block(_local_join(settings, blocks, dim), answers, around.filter(F.col("kind") == AROUND))
        merged = work.save(_by_block(_merge(settings), graph, found), f"graph-{i}")
        work.drop(f"graph-{i - 1}" if i else "graph-start", f"around-{i}")
        graph = merged
        changed = graph.agg(F.sum("n").alias("n")).first()["n"] or 0
        if i and changed <= settings.settled * size * settings.k:
            break
    work.drop("codes")
    return graph.mapInArrow(_as_links, GRAPH)


def _links(graph: DataFrame, blocks: int, settings: Settings) -> DataFrame:
    """The links of every block's nodes in both directions, of those that name a node the nearest."""

    def send(u: np.ndarray, v: np.ndarray, d: np.ndarray) -> Iterator[tuple]:
        yield from _messages(FOUND, _dealt(u, blocks), u, v)
        yield from _messages(REVERSE, _dealt(v, blocks), v, u, d)

    def join(box: _Inbox) -> Iterator[tuple]:
        u, v = box.all(FOUND, np.int64, np.int64)
        of, back, d = box.all(REVERSE, np.int64, np.int64, np.float64)
        nearest = np.lexsort((back, d, of))
        nearest = nearest[_ranked(of[nearest]) < settings.k]
        u, v = np.r_[u, of[nearest]], np.r_[v, back[nearest]]
        order = np.lexsort((v, u))
        u, v = u[order], v[order]
        once = np.r_[True, (u[1:] != u[:-1]) | (v[1:] != v[:-1])]
        ids, sizes = np.unique(u[once], return_counts=True)
        yield _message(box.to, LINKS, ids, sizes.astype(np.int64), v[once])

    return _by_block(join, _send(graph.select("u", "v", "d"), send))


def _front(blocks: int, settings: Settings):
    """The nodes of the beams that are not expanded yet, and the score that a node must have to enter."""

    def run(box: _Inbox) -> Iterator[tuple]:
        q, node, score, done = box.all(BEAM, np.int32, np.int64, np.float64, np.bool_)
        first = np.flatnonzero(_ranked(q) == 0)
        sizes = np.diff(np.r_[first, len(q)])
        bound = np.where(sizes < settings.beam, np.inf, score[first + sizes - 1])
        front = np.flatnonzero(~done)
        # rounded up
        bound = np.nextafter(bound.astype(np.float32), np.float32(np.inf))
        yield from _messages(FRONT, _dealt(node[front], blocks), q[front], node[front], np.repeat(bound, sizes)[front])

    return run


def _reach(blocks: int):
    """What the front is linked to."""

    def run(box: _Inbox) -> Iterator[tuple]:
        q, u, bound = box.all(FRONT, np.int32, np.int64, np.float32)
        for ids, sizes, v in box.each(LINKS, np.int64, np.int64, np.int64):
            if not len(q):
                return
            place = np.minimum(np.searchsorted(ids, u), len(ids) - 1)
            linked = ids[place] == u  # a node may have no links
            q, place, bound = q[linked], place[linked], bound[linked]
            n = sizes[place]
            start = np.repeat((np.cumsum(sizes) - sizes)[place] - (np.cumsum(n) - n), n)
            v = v[start + np.arange(n.sum())]
            yield from _messages(REACHED, _dealt(v, blocks), np.repeat(q, n), v, np.repeat(bound, n))

    return run


def _measure(box: _Inbox, queries: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The nodes of a block that queries met, and the scores of those that met now and may enter the beam."""
    asked = len(queries)
    limit = np.full(asked, np.inf)
    q, v, bound = box.all(REACHED, np.int32, np.int64, np.float32)
    limit[q] = bound
    for ids, code in box.each(CODES, np.int64, np.uint8):
        met = np.unique(np.searchsorted(ids, v) * asked + q)
        old, known, sizes = box.all(SEEN, np.int32, np.int64, np.int64)
        seen = np.sort(np.repeat(np.searchsorted(ids, known), sizes) * asked + old)
        if len(seen):
            met = met[seen[np.minimum(np.searchsorted(seen, met), len(seen) - 1)] != met]
        vectors = _vectors(code, len(ids), queries.shape[1])
        place, q = np.divmod(met, asked)
        score = np.empty(len(met))
        for first in range(0, len(met), step := max(1, HELD // (8 * queries.shape[1]))):
            some = slice(first, first + step)
            apart = queries[q[some]] - vectors[place[some]]
            score[some] = np.sqrt(np.einsum("px,px->p", apart, apart))
        near = score <= limit[q]
        place, q, score = place[near], q[near].astype(np.int32), score[near]
        every = np.sort(np.r_[seen, met], kind="stable")
        nodes, ends = np.unique(every // asked, return_index=True)
        queries_of = np.split((every % asked).astype(np.int32), ends[1:])
        first, last = np.searchsorted(place, nodes), np.searchsorted(place, nodes, "right")
        columns = [
            pa.array(ids[nodes]),
            pa.array([x.tobytes() for x in queries_of[: len(nodes)]], pa.binary()),
            pa.array([q[a:b].tobytes() for a, b in zip(first, last)], pa.binary()),
            pa.array([score[a:b].tobytes() for a, b in zip(first, last)], pa.binary()),
        ]
        yield pa.RecordBatch.from_arrays(columns, schema=MET_FIELDS)


def _bytes(column: np.ndarray, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """The arrays of a column one after the other, and their sizes."""
    sizes = np.array([len(x) for x in column], np.int64) // np.dtype(kind).itemsize
    return np.frombuffer(b"".join(column), kind), sizes


def _beam(settings: Settings):
    """The nearest nodes seen; those that enter are to be expanded."""

    def run(box: _Inbox) -> Iterator[tuple]:
        parts = [box.all(kind, np.int32, np.int64, np.float64) for kind in (BEAM, SCORED)]
        late = np.r_[np.zeros(len(parts[0][0]), bool), np.ones(len(parts[1][0]), bool)]
        q, node, score = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((node, score, q))
        order = order[_ranked(q[order]) < settings.beam]
        yield _message(box.to, BEAM, q[order], node[order], score[order], ~late[order], n=late[order].sum())

    return run


def walk(starts: DataFrame, nodes: DataFrame, graph: DataFrame, work: Work, settings: Settings, top: int) -> DataFrame:
    """(q, node, score): the ``top`` nearest nodes that each start node's greedy search finds, itself included."""
    size, dim = _shape(nodes)
    blocks = _blocks(size, dim, settings)
    codes = work.save(_codes(nodes.select("node", "vec"), blocks), "walk-codes")
    links = work.save(_links(graph, blocks, settings), "links")
    queries = work.save(starts.select("q").distinct().join(nodes, starts.q == nodes.node).select("q", "vec"), "queries")
    # the vectors of the queries that walk together are sent to all tasks
    turns = -(-queries.count() * dim // (2 * HELD))
    found = queries.select("q", F.col("q").alias("node"), F.lit(0.0).alias("score")).filter("false")
    for turn in range(turns):
        some = queries.filter(F.pmod(F.xxhash64("q"), F.lit(turns)) == turn)
        own = "walk" if turns == 1 else f"walk-{turn}"
        found = found.unionByName(_walk(some, codes, links, work, settings, top, blocks, own))
    return found


def _walk(queries: DataFrame, codes: DataFrame, links: DataFrame, work: Work, settings: Settings, top: int, blocks: int, own: str) -> DataFrame:
    held = queries.toArrow()
    spark = queries.sparkSession
    ids = held["q"].to_numpy()
    order = np.argsort(ids)
    ids, vectors = ids[order], _matrix(held["vec"].combine_chunks())[order] if len(ids) else np.zeros((0, 1))
    shared = spark.sparkContext.broadcast((ids, vectors))

    def known(node: np.ndarray, q: np.ndarray) -> Iterator[tuple]:
        block = _dealt(node, blocks)
        order = np.argsort(block, kind="stable")
        block, node, q = block[order], node[order], q[order]
        first = np.flatnonzero(_ranked(block) == 0)
        for a, b in zip(first, np.r_[first[1:], len(block)]):
            queries_of, sizes = _bytes(q[a:b], np.int32)
            yield _message(block[a], SEEN, queries_of, node[a:b], sizes)

    def scored(node: np.ndarray, q: np.ndarray, score: np.ndarray) -> Iterator[tuple]:
        (q, sizes), (score, _) = _bytes(q, np.int32), _bytes(score, np.float64)
        yield from _messages(SCORED, q // BEAMS, q, np.repeat(node, sizes), score)

    def measure(table: pa.Table) -> pa.Table:
        return pa.Table.from_batches(list(_measure(_Inbox(table), shared.value[1])), MET_FIELDS)

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                q, node, score, _ = _Inbox(pa.Table.from_batches([batch.slice(i, 1)])).all(BEAM, np.int32, np.int64, np.float64, np.bool_)
                near = _ranked(q) < top
                yield pa.RecordBatch.from_arrays([pa.array(shared.value[0][q[near]]), pa.array(node[near]), pa.array(score[near])], ["q", "node", "score"])

    def begun(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            q = [x.tobytes() for x in np.searchsorted(shared.value[0], ids).astype(np.int32)]
            score = [np.zeros(1).tobytes()] * len(q)
            yield pa.RecordBatch.from_arrays([pa.array(ids), *(pa.array(x, pa.binary()) for x in (q, q, score))], schema=MET_FIELDS)

    state = work.save(queries.select("q").mapInArrow(begun, MET), f"{own}-0")
    beam = work.save(_by_block(_beam(settings), _send(state.select("node", "entered", "score"), scored)), f"{own}-beam-0")
    for i in count(1):
        front = _each_block(beam, _front(blocks, settings))
        reached = _by_block(_reach(blocks), front, links)
        met = _gathered(reached, codes, _send(state.select("node", "q"), known)).applyInArrow(measure, MET)
        state = work.save(met, f"{own}-{i}")
        enter = _send(state.select("node", "entered", "score").filter(F.length("entered") > 0), scored)
        beam = work.save(_by_block(_beam(settings), beam, enter), f"{own}-beam-{i}")
        work.drop(f"{own}-{i - 1}", f"{own}-beam-{i - 1}")
        if not beam.agg(F.sum("n").alias("n")).first()["n"]:
            break
    return beam.mapInArrow(opened, "q long, node long, score double")


def search(
    rows: DataFrame,
    is_query: Column,
    work: Work,
    key: str = "vec_id",
    vector: str = "embedding",
    nearest: int = 10,
    settings: Settings = Settings(),
) -> DataFrame:
    """query_id, rank, vec_id and score of the ``nearest`` other rows of every query; ``is_query`` is a condition on ``id``."""
    vectors = work.save(usable(rows, key, vector), "vectors")
    nodes = work.save(vectors.groupBy("vec").agg(F.min("id").alias("node")).select("node", "vec"), "nodes")
    members = work.save(vectors.join(nodes, "vec").select("node", "id"), "members")
    graph = build(nodes, work, settings)
    asked = members.filter(is_query)
    found = walk(asked.select(F.col("node").alias("q")).distinct(), nodes, graph, work, settings, nearest + 1)
    found = work.save(found, "found")
    # of a node's members only the first can be among the nearest, one more for the query itself
    first = W.partitionBy("node").orderBy("id")
    few = members.withColumn("r", F.row_number().over(first)).filter(F.col("r") <= nearest + 1).drop("r")
    pairs = asked.select(F.col("node").alias("q"), F.col("id").alias("query_id")).join(found, "q").join(few, "node")
    order = W.partitionBy("query_id").orderBy("score", "id")
    ranked = pairs.filter("query_id != id").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= nearest)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("vec_id"), "score")
