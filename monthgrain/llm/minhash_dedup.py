"""Near-duplicate documents by HyperMinHash.

A document is the set of its distinct word shingles.  One hash per shingle fills a row of registers: the bucket comes from the
hash, the register keeps the leading-zero count and the next ``MANTISSA`` bits of the smallest value in the bucket.

1. Documents with equal sets form one class (128-bit set digest), so exact copies cost one row each and no pair.
2. Bands of registers are hashed to keys.  Empty registers borrow from the next filled one in a fixed random order, which
   gives every register the collision chance of the Jaccard similarity also for short texts.
3. Stars: in every bucket of equal keys the smallest class is compared with each other one, never all with all; in buckets
   of more than ``SMALL`` members three more classes are.
4. A pair is estimated from its registers, corrected for chance collisions, and dropped only if ``SIGMAS`` standard
   deviations under the threshold; the rest is confirmed on the full sets of the texts.
5. Rest: buckets whose members are still in different components are finished block by block.  Their members are dealt into
   blocks of about ``BLOCK`` classes of like set size that met the same star; two blocks form a unit if a bucket has members in
   both and their sizes can reach the threshold.  A unit holds the full sets of its members, counts what every two of them share
   inside the task, and returns only links that join two components: no row per pair is ever made.  Nothing is capped.

With ``bands`` x ``rows`` registers, two documents at the threshold *t* share no band with chance (1 - t**rows)**bands: 2e-10
at 0.85 with 38 x 5, 1e-11 at 0.8 with 48 x 4.

Defined results: null or empty texts have no shingles and are linked with nothing; texts with fewer words than a shingle have
one, their whole sequence; a null id never names a component: its row gets the component of its class or null, and is not kept;
repeated rows share a component (rows that repeat the smallest id are all kept); an empty table gives no rows; other columns
are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from monthgrain.llm import textkernel as tk
from monthgrain.llm.components import components
from monthgrain.llm.work import Work

MANTISSA = 10
EMPTY = 0xFFFF
SIGMAS = 6
SMALL = 32
#: Classes of one block; a unit verifies two blocks.
BLOCK = 256
SKETCH = "doc_id long, text_hash long, n_shingles long, c binary, registers binary"
_U = np.uint64


@dataclass(frozen=True)
class Settings:
    """Words per shingle, similarity in per cent, and how registers are banded."""

    shingle: int = 5
    percent: int = 80
    bands: int = 48
    rows: int = 4

    @property
    def registers(self) -> int:
        return self.bands * self.rows


DEFAULT = Settings()
#: The contract of op7.
CONTRACT = Settings(shingle=3, percent=85, bands=38, rows=5)


def compressed(values: np.ndarray) -> np.ndarray:
    """Leading-zero count (6 bits) and mantissa of 64-bit values, in order of the values' descending size."""
    part, exponent = np.frexp((values >> _U(11)).astype(np.float64))
    zeros = np.minimum(53 - exponent, 62)
    mantissa = np.maximum(((part * 2 - 1) * (1 << MANTISSA)).astype(np.int64), 0)
    return (zeros.astype(np.int64) << MANTISSA | mantissa).astype(np.uint16)


def sketch(of: np.ndarray, value: np.ndarray, n: int, registers: int) -> np.ndarray:
    """One row of registers per text; ``of`` and ``value`` sorted as ``shingle_sets`` gives them."""
    out = np.full((n, registers), EMPTY, np.uint16)
    if len(of):
        bucket = ((value >> _U(32)) * _U(registers) >> _U(32)).astype(np.int64)  # grows with the value: still sorted
        cell = of * registers + bucket
        first = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
        least = np.minimum.reduceat(tk.mix(value ^ _U(0xA5A5A5A5A5A5A5A5)), first)
        out.reshape(-1)[cell[first]] = compressed(least)
    return out


_orders: dict[int, np.ndarray] = {}


def densified(registers: np.ndarray) -> np.ndarray:
    """Empty registers take the first filled one in their own fixed random order of all registers."""
    n, m = registers.shape
    if m not in _orders:
        _orders[m] = np.random.default_rng(m).permuted(np.tile(np.arange(m, dtype=np.int32), (m, 1)), axis=1)
    out = registers.copy()
    row, column = np.nonzero(registers == EMPTY)
    alive = (registers != EMPTY).any(1)[row]
    row, column = row[alive], column[alive]
    for t in range(m):
        if not len(row):
            break
        found = registers[row, _orders[m][column, t]]
        hit = found != EMPTY
        out[row[hit], column[hit]] = found[hit]
        row, column = row[~hit], column[~hit]
    return out


def band_keys(registers: np.ndarray, settings: Settings) -> np.ndarray:
    """One 64-bit key per text and band; texts are not empty."""
    full = densified(registers).reshape(len(registers), settings.bands, settings.rows).astype(_U)
    key = np.tile(tk.mix(np.arange(1, settings.bands + 1, dtype=_U)), (len(registers), 1))
    for i in range(settings.rows):
        key = tk.mix(key * _U(0x9E3779B97F4A7C15) + full[:, :, i])
    return key


def chance(n_a: np.ndarray, n_b: np.ndarray, registers: int) -> np.ndarray:
    """Probability that two unrelated filled registers agree: sum over their cells of the product of both chances."""
    a, b = (np.maximum(x, 1).astype(float) / registers for x in (n_a, n_b))
    level = np.arange(54)
    high, low = np.exp2(-level.astype(float)), np.exp2(-level - 1.0)
    both = (a + b)[:, None]
    mass = np.exp(-both * low) - np.exp(-both * high)
    width = low / (1 << MANTISSA)
    filled = (1 - np.exp(-a)) * (1 - np.exp(-b))
    return (a * b / (a + b) * (mass * width).sum(1)) / filled


def estimate(left: np.ndarray, right: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Collision-corrected Jaccard similarity of register rows, and how many registers it rests on."""
    filled = (left != EMPTY) | (right != EMPTY)
    used = np.maximum(filled.sum(1), 1)
    share = ((left == right) & filled).sum(1) / used
    both = ((left != EMPTY) & (right != EMPTY)).sum(1) / used
    by_chance = chance(n_a, n_b, left.shape[1]) * both
    return np.clip((share - by_chance) / (1 - by_chance), 0, 1), used


def _sketched(settings: Settings):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in tk.blocks(batches, "text"):
            of, value = tk.shingle_sets(*tk.flat(block.column(2)), settings.shingle)
            n = block.num_rows
            rows = sketch(of, value, n, settings.registers)
            count = np.bincount(of, minlength=n)
            yield pa.RecordBatch.from_arrays(
                [
                    block.column(0),
                    block.column(1),
                    pa.array(count.astype(np.int64)),
                    digests(of, value, n),
                    pa.array([r.tobytes() for r in rows], pa.binary()),
                ],
                ["doc_id", "text_hash", "n_shingles", "c", "registers"],
            )

    return run


def digests(of: np.ndarray, value: np.ndarray, n: int) -> pa.Array:
    """128-bit digest of each set: sums of two independent mixes of its members."""
    parts = np.zeros((n, 2), _U)
    if len(of):
        first = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
        for k, salt in enumerate((0x243F6A8885A308D3, 0x13198A2E03707344)):
            parts[of[first], k] = np.add.reduceat(tk.mix(tk.mix(value ^ _U(salt)) + _U(salt)), first)
    return pa.array([p.tobytes() for p in parts], pa.binary())


def _banded(settings: Settings):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000)
                rows = np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint16).reshape(-1, settings.registers)
                keys = band_keys(rows, settings)
                c = part.column(0).take(pa.array(np.repeat(np.arange(len(rows)), settings.bands)))
                yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1).view(np.int64)), c], ["key", "c"])

    return run


def _likely(settings: Settings):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        threshold = settings.percent / 100
        for batch in batches:
            if not batch.num_rows:
                continue
            sides = [
                np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint16).reshape(-1, settings.registers) for i in (2, 3)
            ]
            n_a, n_b = (batch.column(i).to_numpy() for i in (4, 5))
            near, used = estimate(*sides, n_a, n_b)
            slack = SIGMAS * np.sqrt(threshold * (1 - threshold) / used)
            fits = 100 * np.minimum(n_a, n_b) >= settings.percent * np.maximum(n_a, n_b)  # sizes alone can rule a pair out
            keep = pa.array((near >= threshold - slack) & fits)
            yield batch.select([0, 1]).filter(keep)

    return run


def _confirmed(settings: Settings):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in tk.blocks(batches, "text_a", tk.BLOCK_BYTES // 2):
            (of_a, a), (of_b, b) = (tk.shingle_sets(*tk.flat(block.column(i)), settings.shingle) for i in (2, 3))
            n = block.num_rows
            of, value = np.concatenate([of_a, of_b]), np.concatenate([a, b])
            shared = np.bincount(of[tk.repeated(of, value) == 2], minlength=n)  # each side is a set: twice means in both
            union = np.bincount(of, minlength=n) - shared
            yield block.select([0, 1]).filter(pa.array(100 * shared >= settings.percent * union))

    return run


def _texts(settings: Settings):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in tk.blocks(batches, "text"):
            of, value = tk.shingle_sets(*tk.flat(block.column(0)), settings.shingle)
            yield pa.RecordBatch.from_arrays([digests(of, value, block.num_rows), block.column(0)], ["c", "text"])

    return run


def _sets(settings: Settings):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in tk.blocks(batches, "text"):
            of, value = tk.shingle_sets(*tk.flat(block.column(0)), settings.shingle)
            count = np.bincount(of, minlength=block.num_rows)
            ends = np.concatenate([[0], np.cumsum(count)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(value.view(np.int64)))
            columns = [digests(of, value, block.num_rows), pa.array(count.astype(np.int32)), lists]
            yield pa.RecordBatch.from_arrays(columns, ["c", "n", "shingles"])

    return run


def overlaps(member: np.ndarray, shingle: np.ndarray, n: int) -> np.ndarray:
    """How many shingles every two of ``n`` members share; (member, shingle) are distinct rows."""
    shared = np.zeros((n, n), np.int64)
    known, number, often = np.unique(shingle, return_inverse=True, return_counts=True)
    common = often[number] > 1
    member, number = member[common], np.unique(number[common], return_inverse=True)[1]
    order = np.argsort(number, kind="stable")
    member, number = member[order], number[order]
    for low in range(0, int(number[-1]) + 1 if len(number) else 0, 4096):
        a, b = np.searchsorted(number, [low, low + 4096])
        held = np.zeros((n, min(4096, int(number[-1]) + 1 - low)), np.float32)  # counts up to 4096: exact
        held[member[a:b], number[a:b] - low] = 1
        shared += (held @ held.T).astype(np.int64)
    return shared


def joining(c: np.ndarray, label: np.ndarray, size: np.ndarray, shared: np.ndarray, percent: int) -> list[tuple[bytes, bytes]]:
    """Pairs over the threshold, as many as are needed to join the components of their members."""
    union = size[:, None] + size[None, :] - shared
    near = (100 * shared >= percent * union) & (label[:, None] != label[None, :])
    parent: dict[bytes, bytes] = {}

    def root(x: bytes) -> bytes:
        while parent.get(x, x) != x:
            parent[x] = parent.get(parent[x], parent[x])
            x = parent[x]
        return x

    out = []
    for i, j in zip(*(x.tolist() for x in np.nonzero(np.triu(near, 1)))):
        x, y = root(label[i]), root(label[j])
        if x != y:
            parent[max(x, y)] = min(x, y)
            out.append((min(c[i], c[j]), max(c[i], c[j])))
    return out


def _verified(settings: Settings):
    """Rows sorted by unit to the links that join components; a unit's rows may span batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        unit = None

        def links() -> pa.RecordBatch:
            seen, members = set(), []
            for row in held:
                if row[0] not in seen:  # two blocks of one hash are one
                    seen.add(row[0])
                    members.append(row)
            size = np.array([len(m[2]) for m in members])
            shared = overlaps(np.repeat(np.arange(len(members)), size), np.concatenate([m[2] for m in members]), len(members))
            c, label = (np.array([m[k] for m in members], object) for k in (0, 1))
            found = joining(c, label, size, shared, settings.percent)
            return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.binary()) for k in (0, 1)], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (batch.column(i).to_numpy() for i in (0, 1))
            edges = np.flatnonzero(np.concatenate([[True], (x[1:] != x[:-1]) | (y[1:] != y[:-1]), [True]]))
            c, label, lists = batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4)
            flat = lists.flatten().to_numpy()
            ends = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))])
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
                if (x[a], y[a]) != unit:
                    if held:
                        yield links()
                    held, unit = [], (x[a], y[a])
                held += [(c[i], label[i], flat[ends[i] : ends[i + 1]]) for i in range(a, b)]
        if held:
            yield links()

    return run


class _Linker:
    """Candidate pairs to confirmed links, for one table of documents."""

    def __init__(self, docs: DataFrame, settings: Settings, work: Work) -> None:
        self.settings, self.work = settings, work
        self.docs = docs
        hashed = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
        self.members = work.save(hashed.mapInArrow(_sketched(settings), SKETCH), "sketch")
        full = self.members.filter("n_shingles > 0 and doc_id is not null")
        classes = full.groupBy("c").agg(
            F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n"), F.first("registers").alias("registers")
        )
        self.classes = work.save(classes, "classes")

    def _texts(self, needed: DataFrame) -> DataFrame:
        """Texts under the smallest id of each class in ``needed`` (c); who uses them takes the digest again, so that another
        text under the same id cannot stand in."""
        ids = self.classes.join(needed, "c", "left_semi").select("doc_id")
        return self.docs.filter("doc_id is not null").join(ids, "doc_id", "left_semi").select("text")

    def links(self, pairs: DataFrame, name: str) -> DataFrame:
        """Confirmed pairs (a, b) of classes."""
        s, classes, work = self.settings, self.classes, self.work
        side = lambda x: classes.select(F.col("c").alias(x), F.col("registers").alias(f"r_{x}"), F.col("n").alias(f"n_{x}"))
        seen = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "r_a", "r_b", "n_a", "n_b")
        likely = work.save(seen.mapInArrow(_likely(s), "a binary, b binary"), f"{name}-likely")
        needed = likely.select(F.explode(F.array("a", "b")).alias("c")).distinct()
        texts = self._texts(needed).mapInArrow(_texts(s), "c binary, text string").join(needed, "c", "left_semi")
        texts = work.save(texts, f"{name}-texts")
        text = lambda x: texts.select(F.col("c").alias(x), F.col("text").alias(f"text_{x}"))
        both = likely.join(text("a"), "a").join(text("b"), "b").select("a", "b", "text_a", "text_b")
        links = work.save(both.mapInArrow(_confirmed(s), "a binary, b binary").distinct(), f"{name}-links")
        work.drop(f"{name}-likely", f"{name}-texts")
        return links

    def run(self) -> DataFrame:
        """(node, label) of linked classes."""
        s, work = self.settings, self.work
        keys = self.classes.select("c", "registers").mapInArrow(_banded(s), "key long, c binary").distinct()
        shared = keys.groupBy("key").agg(F.min("c").alias("star"), F.count("*").alias("size")).filter("size > 1")
        members = work.save(keys.join(shared, "key"), "buckets")
        stars = work.save(self._stars(members), "stars")
        first = self.links(stars, "star")
        labels = components(first, work, "star-components")
        rest = self._rest(members, labels)
        if rest is None or rest.isEmpty():
            return labels
        return components(first.unionByName(rest), work, "all-components")

    def _stars(self, members: DataFrame) -> DataFrame:
        """Pairs (a < b) of every bucket member with the bucket's star; large buckets have three more stars.

        A group of near copies can hold members just under the threshold to one star but over it to another.
        """
        by = F.xxhash64("c")
        large = members.filter(F.col("size") > SMALL)
        more = large.groupBy("key").agg(F.array(F.max("c"), F.min_by("c", by), F.max_by("c", by)).alias("stars"))
        again = large.join(more, "key").select(F.explode("stars").alias("star"), "c")
        both = members.select("star", "c").unionByName(again).filter("star != c")
        return both.select(F.least("star", "c").alias("a"), F.greatest("star", "c").alias("b")).distinct()

    def _rest(self, members: DataFrame, labels: DataFrame) -> DataFrame | None:
        """Links (a, b) that join the components that a bucket still holds apart, verified block by block."""
        work, percent = self.work, self.settings.percent
        named = labels.withColumnsRenamed({"node": "c"})
        rows = members.select("key", "star", "c").join(named, "c", "left")
        rows = work.save(rows.select("key", "star", "c", F.coalesce("label", "c").alias("label")), "labelled")
        state = rows.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y")).filter("x != y").select("key")
        mixed = work.save(rows.join(state, "key"), "mixed")
        if mixed.isEmpty():
            return None
        placed = work.save(mixed.groupBy("c").agg(F.min("star").alias("group"), F.first("label").alias("label")), "placed")
        sets = self._texts(placed.select("c")).mapInArrow(_sets(self.settings), "c binary, n int, shingles array<long>")
        sets = sets.join(placed, "c").dropDuplicates(["c"])
        # sets can reach the threshold only within one step of size
        step = F.floor(F.log("n") / F.log(F.lit(100 / percent))).cast("int")
        sets = work.save(sets.withColumn("step", step), "sets")
        counted = sets.groupBy("group", "step").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
        block = F.xxhash64("group", "step", F.pmod(F.xxhash64("c"), F.col("blocks")))
        dealt = sets.join(counted, ["group", "step"]).select("c", "label", "shingles", "step", block.alias("block"))
        dealt = work.save(dealt, "dealt")
        spots = mixed.select("key", "c").join(dealt.select("c", "block", "step"), "c").select("key", "block", "step").distinct()
        spots = work.save(spots, "spots")
        side = lambda x: spots.select("key", F.col("block").alias(f"block_{x}"), F.col("step").alias(f"step_{x}"))
        met = side("a").join(side("b"), "key").filter("block_a <= block_b and abs(step_a - step_b) <= 1")
        units = work.save(met.select("block_a", "block_b").distinct(), "units")
        each = units.select("block_a", "block_b", F.explode(F.array_distinct(F.array("block_a", "block_b"))).alias("block"))
        held = each.join(dealt.drop("step"), "block").select("block_a", "block_b", "c", "label", "shingles")
        held = held.repartition("block_a", "block_b").sortWithinPartitions("block_a", "block_b")
        return work.save(held.mapInArrow(_verified(self.settings), "a binary, b binary").distinct(), "rest-links")


def _grouped(docs: DataFrame, work: Work, settings: Settings) -> DataFrame:
    """doc_id, text_hash, n_shingles, c and component_id of every row of ``docs`` (doc_id, text)."""
    linker = _Linker(docs, settings, work)
    labels = linker.run()
    members = linker.members.select("doc_id", "text_hash", "n_shingles", "c")
    full = members.filter("n_shingles > 0").join(labels.withColumnRenamed("node", "c"), "c", "left")
    full = full.withColumn("label", F.coalesce("label", "c"))
    least = full.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    found = full.join(least, "label").drop("label")
    bare = members.filter("n_shingles = 0").withColumn("component_id", F.col("doc_id"))
    return found.unionByName(bare)


def near_duplicates(
    docs: DataFrame, work: Work, settings: Settings = DEFAULT, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id reachable) and kept, one row per document."""
    rows = _grouped(docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")), work, settings)
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False))
    return rows.select("doc_id", "n_shingles", "component_id", kept.alias("kept"))


def deduplicate(docs: DataFrame, work: Work, settings: Settings = DEFAULT, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents with one row left of each component, all columns as they are.

    Rows without words stay.  Of rows that repeat id and text one stays; a row without an id stays if nothing with an id is
    in its component, one of equal ones.
    """
    rows = _grouped(docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")), work, settings)
    stays = F.when(F.col("doc_id").isNull(), F.col("component_id").isNull()).otherwise(F.col("doc_id") == F.col("component_id"))
    stays = work.save(rows.filter(stays | (F.col("n_shingles") == 0)).select("doc_id", "text_hash", "n_shingles", "c"), "stays")
    names = stays.groupBy("doc_id", "text_hash").agg(F.max("n_shingles").alias("n"), F.count("*").alias("copies"))
    names = work.save(names.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "n", "copies"), "names")
    keyed = docs.withColumns({"_id_": F.col(key).cast("long"), "_hash_": F.xxhash64(text)})
    kept = keyed.join(names.select("_id", "_hash"), F.col("_id_").eqNullSafe(F.col("_id")) & (F.col("_hash_") == F.col("_hash")), "left_semi")
    again = names.filter("n > 0 and (copies > 1 or _id is null)")
    if again.isEmpty():
        return kept.drop("_id_", "_hash_")
    # few rows: those that repeat another's id and text, or have no id
    match = F.col("_id_").eqNullSafe(F.col("_id")) & (F.col("_hash_") == F.col("_hash"))
    alone = kept.join(again.select("_id", "_hash"), match, "left_anti")
    one = kept.join(again.select("_id", "_hash"), match, "left_semi").dropDuplicates(["_id_", "_hash_"])
    return alone.unionByName(one).drop("_id_", "_hash_")
