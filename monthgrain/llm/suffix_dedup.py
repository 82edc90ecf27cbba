"""Removal of byte strings of ``LENGTH`` bytes that occur more than once in the corpus, through suffix arrays.

Every window of ``LENGTH`` bytes has a seed: the leftmost smallest hash among its substrings of ``GRAM`` bytes.  Equal windows
have equal seeds, so:

1. Seeds are counted over the corpus; a window whose seed occurs once cannot repeat.
2. Windows in a row with one seed form a segment.  Equal segments are counted by content hash before anything else, so a
   passage that very many documents share is one segment with a count, and all its windows repeat.
3. A seed with several different segments needs the suffix array.  One copy of each segment is cut from its document and
   parted in two by where the seed lies, keyed by 132 shared bytes; Spark deals the parts out by that key and sorts them,
   and a task gathers whole groups into shards of about ``SHARD_BYTES`` and runs the external induced sort over each: windows
   whose suffixes share ``LENGTH`` bytes with a neighbour repeat.  A group beyond that size is one shard of its own; only the
   queues of its sort go to disk.
4. Repeated windows go back to the segments' places, are merged per document and cut out.

Seeds, counts and segments cover all texts.  Not done yet: the parts of one key are gathered in one task and held in memory, with
the arrays of their sort, so a passage with very many different surroundings is bounded by a task's memory.

Defined results: null and empty texts have no bytes; texts under ``LENGTH`` bytes keep all; matches never cross texts; repeated
rows are documents that repeat each other; null ids and ties do no harm (a row is known by its id and text); an empty table
gives no rows; other columns are kept by ``deduplicate`` and left out by ``report``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from monthgrain.llm import textkernel as tk
from monthgrain.llm.induced_sort import repeated_positions
from monthgrain.llm.work import Work

LENGTH = 200
GRAM = 64
SHARD_BYTES = 4 << 20
_U = np.uint64


def _sliding_first_min(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the leftmost minimum of every ``width`` values in a row."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    packed = (values & _U(0xFFFFFFFF00000000)) | np.arange(len(values), dtype=_U)
    padded = np.full(-(-len(packed) // width) * width, _U(0xFFFFFFFFFFFFFFFF))
    padded[: len(packed)] = packed
    grid = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(grid, axis=1).reshape(-1)
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return (np.minimum(back[:n], ahead[width - 1 : width - 1 + n]) & _U(0xFFFFFFFF)).astype(np.int64)


def segments(data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Text, first window, number of windows, seed place, seed hash and content hash of every segment of a block."""
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < length:
        return none, none, none, none, none, none
    sums = tk.prefix(data)
    starts = np.arange(n - gram + 1)
    seed = _sliding_first_min(tk.range_hash(sums, starts, starts + gram), length - gram + 1)
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    inside = np.flatnonzero(np.arange(n - length + 1) + length <= offsets[owner[: n - length + 1] + 1])
    if not len(inside):
        return none, none, none, none, none, none
    place, of = seed[inside], owner[inside]
    head = np.ones(len(inside), bool)
    head[1:] = (place[1:] != place[:-1]) | (of[1:] != of[:-1])
    first = np.flatnonzero(head)
    count = np.diff(first, append=len(inside))
    begin, at = inside[first], place[first]
    seeds = tk.range_hash(sums, at, at + gram)
    content = tk.range_hash(sums, begin, begin + count - 1 + length)
    return of[first], begin, count, at, seeds, content


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(_U).view(np.int64))


def _seeds(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in tk.blocks(batches, "text"):
            seeds = segments(*tk.flat(block.column(0)), length, gram)[4]
            value, count = np.unique(seeds, return_counts=True)
            yield pa.RecordBatch.from_arrays([_signed(value), pa.array(count)], ["seed", "n"])

    return run


def _segments(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in tk.blocks(batches, "text"):
            data, offsets = tk.flat(block.column(2))
            of, begin, count, _, seeds, content = segments(data, offsets, length, gram)
            row = pa.array(of)
            place = begin - offsets[of]
            yield pa.RecordBatch.from_arrays(
                [block.column(0).take(row), block.column(1).take(row), _signed(seeds), _signed(content)]
                + [pa.array(place), pa.array(count.astype(np.int32))],
                ["k1", "k2", "seed", "content", "place", "windows"],
            )

    return run


def _parts(length: int, gram: int):
    """Cut the listed segments out of their documents; windows with the seed far right and far left go separate ways."""
    half = (length - gram) // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            held = 0
            for text, wanted in zip(batch.column(0), batch.column(1)):
                data = np.frombuffer(text.as_py().encode("utf-8"), np.uint8)
                sums = tk.prefix(data)
                for w in wanted.as_py():
                    begin, count = w["place"], w["windows"]
                    seed = begin + count - 1 + int(_seed_of(sums, begin + count - 1, length, gram))
                    # windows up to ``far`` hold ``half`` bytes before the seed, the others as many and more behind it
                    far = min(count, max(0, seed - half - begin + 1))
                    for side, a, b in ((0, 0, far), (1, far, count)):
                        if a < b:
                            shared = (seed - half, seed + gram) if side == 0 else (seed, seed + gram + length - gram - half)
                            key = tk.range_hash(sums, *(np.array([x]) for x in shared))[0] + _U(side)
                            body = data[begin + a : begin + b - 1 + length].tobytes()
                            out.append((int(key.view(np.int64)), w["seed"], w["content"], w["n"], a, b - a, body))
                            held += len(body)
                if held > tk.BLOCK_BYTES:
                    yield _part_batch(out)
                    out, held = [], 0
            if out:
                yield _part_batch(out)

    return run


def _seed_of(sums: np.ndarray, window: int, length: int, gram: int) -> int:
    """Place of the seed in one window."""
    at = window + np.arange(length - gram + 1)
    return int(np.argmin(tk.range_hash(sums, at, at + gram) >> _U(32)))


PARTS = "key long, seed long, content long, n long, first int, windows int, body binary"


def _part_batch(rows: list[tuple]) -> pa.RecordBatch:
    types = (*[pa.int64()] * 4, pa.int32(), pa.int32(), pa.binary())
    names = [x.split()[0] for x in PARTS.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)


FOUND = "seed long, content long, start int, stop int"


def _sorted(length: int, shard_bytes: int):
    """Windows that repeat, as ranges in their segments; input sorted by key.

    Equal parts of different segments repeat as a whole; one of each kind goes into the shard, and only if its group holds a
    part that is still open, one that occurs once.
    """
    names = [x.split()[0] for x in FOUND.split(", ")]
    types = (pa.int64(), pa.int64(), pa.int32(), pa.int32())

    def ranges(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * 4, types)], names)

    def shard(rows: list[tuple]) -> pa.RecordBatch:
        bodies = [np.frombuffer(r[6], np.uint8) for r in rows]
        symbols = np.ones(sum(len(b) + 1 for b in bodies), np.uint16)
        at, begins = 0, []
        for body in bodies:
            symbols[at : at + len(body)] = body
            symbols[at : at + len(body)] += 2
            begins.append(at)
            at += len(body) + 1
        flags = repeated_positions(symbols, length)
        out = []
        for begin, r in zip(begins, rows):
            step = np.diff(np.concatenate([[0], flags[begin : begin + r[5]].view(np.int8), [0]]))
            for a, b in zip(np.flatnonzero(step == 1).tolist(), np.flatnonzero(step == -1).tolist()):
                out.append((r[1], r[2], r[4] + a, r[4] + b - 1 + length))
        return ranges(out)

    def settle(group: list[tuple], whole: list[tuple]) -> list[tuple]:
        """What of a group needs the suffix array; the rest is known at once."""
        if len(group) == 1:
            return []
        kinds: dict[bytes, list[tuple]] = {}
        for r in group:
            kinds.setdefault(r[6], []).append(r)
        for same in kinds.values():
            if len(same) > 1:
                whole += [(r[1], r[2], r[4], r[4] + r[5] - 1 + length) for r in same if r[3] == 1]
        open_ends = any(len(same) == 1 and same[0][3] == 1 for same in kinds.values())
        return [same[0] for same in kinds.values()] if open_ends and len(kinds) > 1 else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, rows, whole, held = [], [], [], 0
        for batch in batches:
            for r in zip(*(c.to_pylist() for c in batch.columns)):
                if group and group[0][0] != r[0]:
                    new = settle(group, whole)
                    rows += new
                    held += sum(len(x[6]) for x in new)
                    group = []
                    if held > shard_bytes:
                        yield shard(rows)
                        rows, held = [], 0
                    if len(whole) > 10_000:
                        yield ranges(whole)
                        whole = []
                group.append(r)
        rows += settle(group, whole) if group else []
        yield ranges(whole)
        if rows:
            yield shard(rows)

    return run


def _row_keys(key: Column, text: Column) -> tuple[Column, Column]:
    return F.xxhash64(key).alias("k1"), F.xxhash64(text).alias("k2")


def repeated_ranges(docs: DataFrame, key: str, text: str, work: Work, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(k1, k2, ranges) of every document with repeated windows; ranges are (start, stop) in bytes, unmerged."""
    source = docs.select(*_row_keys(F.col(key), F.col(text)), F.col(text).alias("text")).filter(F.octet_length("text") >= length)
    counts = source.select("text").mapInArrow(_seeds(length, gram), "seed long, n long")
    often = counts.groupBy("seed").agg(F.sum("n").alias("n")).filter("n > 1").select("seed")
    often = work.save(often, "seeds")
    schema = "k1 long, k2 long, seed long, content long, place long, windows int"
    placed = work.save(source.mapInArrow(_segments(length, gram), schema).join(often, "seed"), "segments")
    copy = F.min(F.struct("k1", "k2", "place", "windows")).alias("copy")
    distinct = work.save(placed.groupBy("seed", "content").agg(F.count("*").alias("n"), copy), "distinct")
    several = distinct.groupBy("seed").agg(F.count("*").alias("kinds")).filter("kinds > 1").select("seed")
    wanted = distinct.join(several, "seed").select("copy.*", "seed", "content", "n")
    listed = wanted.groupBy("k1", "k2").agg(F.collect_list(F.struct("place", "windows", "seed", "content", "n")).alias("wanted"))
    # equal rows share their keys: one of them is enough to cut from
    texts = source.join(listed, ["k1", "k2"]).groupBy("k1", "k2").agg(F.first("text").alias("text"), F.first("wanted").alias("wanted"))
    parts = work.save(texts.select("text", "wanted").mapInArrow(_parts(length, gram), PARTS), "parts")
    dealt = parts.repartition(F.col("key")).sortWithinPartitions("key")
    found = dealt.mapInArrow(_sorted(length, SHARD_BYTES), FOUND)
    whole = distinct.filter("n > 1").select("seed", "content", F.lit(0).alias("start"), (F.col("copy.windows") - 1 + length).alias("stop"))
    alone = distinct.filter("n = 1").select("seed", "content")
    ranges = work.save(whole.unionByName(found.join(alone, ["seed", "content"])), "ranges")
    there = placed.select("k1", "k2", "seed", "content", "place").join(ranges, ["seed", "content"])
    spots = there.select("k1", "k2", (F.col("place") + F.col("start")).alias("start"), (F.col("place") + F.col("stop")).alias("stop"))
    spots = spots.distinct().groupBy("k1", "k2").agg(F.collect_list(F.struct("start", "stop")).alias("ranges"))
    out = work.save(spots, "spots")
    work.drop("seeds", "segments", "distinct", "parts", "ranges")
    return out


def _merged(ranges) -> list[tuple[int, int]]:
    """Maximal runs of a list of (start, stop)."""
    out: list[tuple[int, int]] = []
    for start, stop in sorted((r["start"], r["stop"]) for r in ranges or ()):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], stop))
        else:
            out.append((start, stop))
    return out


def _kept(text: str | None, ranges) -> tuple[bytes, bytes, int]:
    raw = (text or "").encode("utf-8")
    runs, at, pieces = _merged(ranges), 0, []
    for start, stop in runs:
        pieces.append(raw[at:start])
        at = stop
    pieces.append(raw[at:])
    return raw, b"".join(pieces), len(runs)


def _reported(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    for block in tk.blocks(batches, "text"):
        rows = [_kept(t, r) for t, r in zip(block.column(1).to_pylist(), block.column(2).to_pylist())]
        n_bytes = [len(raw) for raw, _, _ in rows]
        removed = [len(raw) - len(kept) for raw, kept, _ in rows]
        columns = [pa.array(c, pa.int64()) for c in (n_bytes, removed, [n for _, _, n in rows])]
        digest = pa.array([hashlib.sha256(kept).hexdigest() for _, kept, _ in rows], pa.string())
        yield pa.RecordBatch.from_arrays([block.column(0), *columns, digest], names)


def _with_ranges(docs: DataFrame, key: str, text: str, work: Work, length: int) -> DataFrame:
    spots = repeated_ranges(docs, key, text, work, length)
    keyed = docs.withColumns(dict(zip(("_k1", "_k2"), _row_keys(F.col(key), F.col(text)))))
    spots = spots.withColumnsRenamed({"k1": "_k1", "k2": "_k2", "ranges": "_ranges"})
    return keyed.join(spots, ["_k1", "_k2"], "left")


def report(docs: DataFrame, work: Work, key: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the digest of what remains, one row per document."""
    docs = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    rows = _with_ranges(docs, "doc_id", "text", work, length).select("doc_id", "text", "_ranges")
    longs = [StructField(n, LongType(), False) for n in ("n_bytes", "n_removed", "n_spans")]
    schema = StructType([docs.schema["doc_id"], *longs, StructField("kept_sha256", StringType(), False)])
    return rows.mapInArrow(_reported, schema)


def _cut(text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in tk.blocks(batches, text):
            at, spots = block.schema.get_field_index(text), block.schema.get_field_index("_ranges")
            clean = [
                t if not r else _kept(t, r)[1].decode("utf-8", "ignore")
                for t, r in zip(block.column(at).to_pylist(), block.column(spots).to_pylist())
            ]
            columns = [pa.array(clean, pa.string()) if i == at else block.column(i) for i in range(block.num_columns) if i != spots]
            yield pa.RecordBatch.from_arrays(columns, [n for n in block.schema.names if n != "_ranges"])

    return run


def deduplicate(docs: DataFrame, work: Work, key: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """The documents without repeated bytes; a character of which only a part remains goes too."""
    rows = _with_ranges(docs, key, text, work, length).select(*docs.columns, "_ranges")
    return rows.mapInArrow(_cut(text), docs.schema)
