"""Near-duplicate documents by SimHash fingerprints, searched with the pigeonring principle.

A fingerprint has 64 bits; a bit is 1 if it is set in over half of the XXH64 values (seed 42) of a text's word shingles, repeats
included.  Documents are linked when their fingerprints differ in at most ``DISTANCE`` bits.

The bits are cut into a ring of ``SEGMENTS`` consecutive segments.  If two fingerprints differ in at most D bits, there is a segment
from which every chain of l consecutive segments around the ring holds at most l * D / SEGMENTS differing bits (pigeonring,
strong form).  With 4 bits on 5 segments the budgets of chains of 1 to 5 segments are 0, 1, 2, 3 and 4 bits.

1. Equal fingerprints form one class, so exact copies cost one row and no pair.
2. Every class and start gives one key: the start and the first ``chain`` segments from it.  Differences that the budgets
   allow inside these segments are reached by probes: keys with those bits changed.  Of a pair that differs in them, only the
   side whose lowest differing bit is 1 probes, so a pair meets once per start.
3. Keys that hold one row are dropped by a map-side count.  The rows of a key are dealt into blocks of ``BLOCK`` rows, and
   each pair of blocks is a unit of its own, so that no task holds a whole hot key.
4. Inside a unit the remaining chains are summed segment by segment; a pair that exceeds a budget is dropped before the full
   Hamming check.  A unit returns the links that join its rows (a spanning forest), never one row per pair.
5. Components of the links name each document by its smallest reachable id.

``chain`` is 2, and 3 beyond ``WIDE`` classes, where two segments (26 bits) would meet too many strangers; both give the same rows.

Defined results: null, empty and word-free texts have fingerprint zero and are linked like any other; texts with fewer words
than a shingle have one, their whole sequence; rows without an id take part and get the component of their class, which is null
if no row of the component has an id; repeated rows share a component; an empty table gives no rows; other columns, whatever
their names, are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from monthgrain.llm import textkernel as tk
from monthgrain.llm.components import components
from monthgrain.llm.work import Work

SHINGLE = 4
DISTANCE = 4
SEGMENTS = 5
SEED = 42
#: Rows of a key that one block holds; a unit compares two blocks.
BLOCK = 2048
#: Classes from which keys take three segments.
WIDE = 1 << 24
_U = np.uint64


def bounds(segments: int = SEGMENTS) -> list[tuple[int, int]]:
    """(lowest bit, width) of every segment of the ring."""
    edges = [64 * i // segments for i in range(segments + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def budget(length: int) -> int:
    """Differing bits that a chain of ``length`` segments may hold."""
    return length * DISTANCE // SEGMENTS


def fingerprints(column: pa.Array, shingle: int = SHINGLE) -> np.ndarray:
    """Fingerprint of every text of a block; null counts as empty."""
    data, offsets = tk.flat(column)
    n = len(offsets) - 1
    out = np.zeros(n, _U)
    start, end, owner = tk.words(data, offsets)
    if not len(start):
        return out
    # the words of the block in one line, each followed by one space: a shingle is a slice of it
    length = end - start
    place = np.cumsum(length + 1) - (length + 1)
    line = np.full(int(place[-1] + length[-1] + 1), 0x20, np.uint8)
    line[np.arange(int(length.sum())) + np.repeat(np.arange(len(start)), length)] = tk.lowered(
        data[np.arange(int(length.sum())) + np.repeat(start - (np.cumsum(length) - length), length)]
    )
    words_of = np.bincount(owner, minlength=n)
    first_word = np.cumsum(words_of) - words_of
    count = np.where(words_of > 0, np.maximum(words_of - shingle + 1, 1), 0)
    begin = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first_word, count)
    last = np.minimum(begin + shingle, np.repeat(first_word + words_of, count)) - 1
    raw, digest = line.tobytes(), xxhash.xxh64_intdigest
    hashes = np.fromiter(
        (digest(raw[a:b], SEED) for a, b in zip(place[begin].tolist(), (place[last] + length[last]).tolist())), _U, len(begin)
    )
    total = np.zeros((n, 64), np.int64)
    of = np.repeat(np.arange(n), count)
    for i in range(0, len(hashes), 1 << 15):
        part, who = hashes[i : i + (1 << 15)], of[i : i + (1 << 15)]
        bits = np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        head = np.flatnonzero(np.concatenate([[True], who[1:] != who[:-1]]))
        total[who[head]] += np.add.reduceat(bits, head, axis=0, dtype=np.int64)
    majority = 2 * total > count[:, None]
    return np.packbits(majority, axis=1, bitorder="little").view("<u8").reshape(n).astype(_U)


def _marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block in tk.blocks(batches, "text"):
        yield pa.RecordBatch.from_arrays(
            [block.column(0), pa.array(fingerprints(block.column(1)).view(np.int64))], ["doc_id", "fp"]
        )


def changes(start: int, chain: int) -> np.ndarray:
    """Every set of differing bits that the budgets allow inside the first ``chain`` segments from ``start``, none excluded."""
    ring = bounds()
    found = [[0]]
    for k in range(1, chain):
        low, width = ring[(start + k) % SEGMENTS]
        own = [0] + [sum(1 << (low + b) for b in bits) for w in range(1, budget(k + 1) + 1) for bits in combinations(range(width), w)]
        found.append([a | b for a in found[-1] for b in own if (a | b).bit_count() <= budget(k + 1)])
    return np.array(sorted(found[-1]), _U)


def _keys(chain: int):
    """(key, probe, fp): the own key of every start, and the keys one allowed change away."""
    ring = bounds()
    plans = []
    for start in range(SEGMENTS):
        inside = sum(((1 << width) - 1) << low for low, width in (ring[(start + k) % SEGMENTS] for k in range(chain)))
        masks = changes(start, chain)
        masks = masks[masks > 0]
        plans.append((_U(inside), masks, masks & (~masks + _U(1))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 4096):
                fp = batch.column(0).slice(i, 4096).to_numpy(zero_copy_only=False).view(_U)
                for start, (inside, masks, lowest) in enumerate(plans):
                    own = fp & inside
                    row, which = np.nonzero((fp[:, None] & lowest[None, :]) != 0)
                    key = np.concatenate([own, own[row] ^ masks[which]])
                    key = tk.mix(key ^ _U(0x9E3779B97F4A7C15 * (start + 1) & 0xFFFFFFFFFFFFFFFF))  # a bijection per start
                    probe = np.repeat(np.array([False, True]), [len(fp), len(row)])
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(key.view(np.int64)),
                            pa.array(np.full(len(key), start, np.int8)),
                            pa.array(probe),
                            pa.array(np.concatenate([fp, fp[row]]).view(np.int64)),
                        ],
                        ["key", "start", "probe", "fp"],
                    )

    return run


def viable(left: np.ndarray, right: np.ndarray, start: int) -> np.ndarray:
    """Which pairs keep within the budget of every chain from ``start``, then within the full distance."""
    ring = bounds()
    differ = left ^ right
    alive = np.arange(len(differ))
    spent = np.zeros(len(differ), np.int64)
    for k in range(SEGMENTS):
        low, width = ring[(start + k) % SEGMENTS]
        part = (differ[alive] >> _U(low)) & _U((1 << width) - 1)
        spent = spent + np.bitwise_count(part)
        keep = spent <= budget(k + 1)
        alive, spent = alive[keep], spent[keep]
    return alive[np.bitwise_count(differ[alive]) <= DISTANCE]


class _Forest:
    """Smallest member of every set of joined places."""

    def __init__(self, n: int) -> None:
        self.parent = np.arange(n)

    def root(self, x: np.ndarray) -> np.ndarray:
        up = self.parent[x]
        while True:
            above = self.parent[up]
            if (above == up).all():
                return up
            up = above

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            x, y = self.root(a), self.root(b)
            apart = x != y
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(self.parent, np.maximum(x, y), np.minimum(x, y))


def _linked(fp: np.ndarray, probe: np.ndarray, side: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between the rows of one unit: rows with side 0 or 2 are compared with those of side 1 or 2."""
    order = np.argsort(probe, kind="stable")
    fp, probe, side = fp[order], probe[order], side[order]
    own = int(np.count_nonzero(~probe))  # own keys first: two probes are never compared
    members, place = np.unique(fp, return_inverse=True)
    forest = _Forest(len(members))
    step = max(1, (1 << 20) // max(own, 1))
    for i in range(0, len(fp), step):
        rows = np.arange(i, min(i + step, len(fp)))
        a, b = np.nonzero((rows[:, None] > np.arange(own)[None, :]) & (side[rows][:, None] + side[None, :own] != 0) & ~((side[rows][:, None] == 1) & (side[None, :own] == 1)))
        a = rows[a]
        good = viable(fp[a], fp[b], start)
        forest.join(place[a[good]], place[b[good]])
    root = forest.root(np.arange(len(members)))
    child = np.flatnonzero(root != np.arange(len(members)))
    return members[child], members[root[child]]


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by unit to links; a unit's rows may span batches."""
    held: list[tuple[np.ndarray, ...]] = []
    unit = None

    def done() -> pa.RecordBatch:
        probe, side, fp = (np.concatenate([h[k] for h in held]) for k in range(3))
        a, b = _linked(fp, probe, side, unit[0])
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        start, key, x, y, probe, side, fp = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(7))
        head = np.ones(batch.num_rows, bool)
        head[1:] = (key[1:] != key[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1]) | (start[1:] != start[:-1])
        edges = np.append(np.flatnonzero(head), batch.num_rows)
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
            name = (int(start[a]), int(key[a]), int(x[a]), int(y[a]))
            if name != unit:
                if held:
                    yield done()
                held, unit = [], name
            held.append((probe[a:b], side[a:b], fp[a:b].view(_U)))
    if held:
        yield done()


def links(classes: DataFrame, work: Work, chain: int | None = None, block: int = 0) -> DataFrame:
    """(a, b): links that join all fingerprints of ``classes`` (fp, distinct) within the distance."""
    block = block or BLOCK
    if chain is None:
        chain = 3 if classes.count() > WIDE else 2
    keys = classes.select("fp").mapInArrow(_keys(chain), "key long, start byte, probe boolean, fp long")
    own = F.count_if(~F.col("probe"))
    counted = keys.groupBy("key", "start").agg(F.count("*").alias("n"), own.alias("own")).filter("n > 1 and own > 0")
    rows = keys.join(work.save(counted, "keys"), ["key", "start"])
    blocks: Column = F.ceil(F.col("n") / block)
    dealt = rows.withColumns({"blocks": blocks, "own_block": F.pmod(F.xxhash64("fp", "probe"), blocks)})
    # one unit per pair of blocks (x <= y): side 2 is both, 0 the first, 1 the second
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    paired = dealt.select("start", "key", "probe", "fp", "own_block", other).select(
        "start",
        "key",
        F.least("own_block", "other").alias("x"),
        F.greatest("own_block", "other").alias("y"),
        "probe",
        F.when(F.col("own_block") == F.col("other"), 2).when(F.col("own_block") < F.col("other"), 0).otherwise(1).cast("byte").alias("side"),
        "fp",
    )
    units = paired.repartition("start", "key", "x", "y").sortWithinPartitions("start", "key", "x", "y")
    return work.save(units.mapInArrow(_units, "a long, b long").distinct(), "links")


def near_duplicates(docs: DataFrame, work: Work, key: str = "doc_id", text: str = "text", chain: int | None = None) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id (smallest id reachable), one row per document."""
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    marked = work.save(rows.mapInArrow(_marked, "doc_id long, fp long"), "fingerprints")
    classes = work.save(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    labels = components(links(classes, work, chain), work).select(F.col("node").alias("fp"), "label")
    named = classes.join(labels, "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    named = work.save(named, "named")
    least = named.groupBy("label").agg(F.min("least").alias("component_id"))
    found = named.join(least, "label").select("fp", "component_id")
    hexadecimal = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return marked.join(found, "fp").select("doc_id", hexadecimal.alias("fingerprint"), "component_id")
