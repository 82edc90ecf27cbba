"""Vectorised text helpers that run inside Spark tasks.

A block of texts is one flat UTF-8 byte array plus offsets.  Words are the runs of bytes outside 0x20 and 0x09-0x0D; UTF-8
never uses those bytes inside a longer character, so byte runs equal code-point runs.  Hashes are polynomials modulo the prime
2**61 - 1 over prefix sums, mixed to full avalanche, so that every word, line or window costs one subtraction.  (Modulo a power
of two, two Thue-Morse strings of some thousand characters collide whatever the base; a prime field has no such pair.)
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_U = np.uint64
_PRIME = (1 << 61) - 1
_BASE = 0x9E3779B97F4A7C15 | 1
_POINT = 0x0C5D1B2F7A49E36D % _PRIME
_INVERSE = pow(_POINT, -1, _PRIME)
_M, _LOW32, _LOW29 = _U(_PRIME), _U((1 << 32) - 1), _U((1 << 29) - 1)
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes of text that one block holds; a longer text is a block of its own.
BLOCK_BYTES = 1 << 20
#: Values that one step of the arithmetic holds, so that its temporaries stay in the processor's cache.
_CACHED = 1 << 14
_powers = {}


def _folded(x: np.ndarray) -> np.ndarray:
    """Values below 2**61 + 8 that are congruent to ``x``."""
    return (x & _M) + (x >> _U(61))


def _shifted(x: np.ndarray) -> np.ndarray:
    """x * 2**32 modulo the prime, for x below 2**62, as a value below 2**61 + 2**33."""
    return (x >> _U(29)) + ((x & _LOW29) << _U(32))


def _reduced(x: np.ndarray) -> np.ndarray:
    x = _folded(x)
    return x - _M * (x >= _M)


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products modulo the prime, by 32-bit limbs."""
    a_high, a_low, b_high, b_low = a >> _U(32), a & _LOW32, b >> _U(32), b & _LOW32
    middle = a_high * b_low + a_low * b_high
    return _reduced((a_high * b_high << _U(3)) + _shifted(middle) + _folded(a_low * b_low))


def powers(base: int, n: int) -> np.ndarray:
    """base**0 … base**(n-1) modulo the prime, kept per worker and grown by doubling."""
    known = _powers.get(base)
    if known is None or len(known) < n:
        size = max(n, BLOCK_BYTES + 1)
        known = np.empty(size, _U)
        known[0] = 1
        filled = 1
        while filled < size:
            step = min(filled, size - filled)
            known[filled : filled + step] = times(known[:step], np.array([pow(base, filled, _PRIME)], _U))
            filled += step
        _powers[base] = known
    return known[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (the public SplitMix64 constants)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def prefix(data: np.ndarray) -> np.ndarray:
    """Prefix sums of (symbol + 1) * point**i; the hash of any range follows from two of them.

    Both limbs of the powers are summed in rows short enough for 64 bits; the totals of the rows before are added afterwards.
    """
    n = len(data)
    out = np.zeros(n + 1, _U)
    if not n:
        return out
    row = min(1 << max(31 - (int(data.max()) + 1).bit_length(), 4), 1 << 12)
    point = powers(_POINT, n)
    for begin in range(0, n, _CACHED):
        end = min(begin + _CACHED, n)
        rows = -(-(end - begin) // row)
        value = np.zeros(rows * row, _U)
        value[: end - begin] = data[begin:end]
        value[: end - begin] += _U(1)
        part = np.zeros(rows * row, _U)
        part[: end - begin] = point[begin:end]
        high = np.cumsum((value * (part >> _U(32))).reshape(rows, row), axis=1)
        low = np.cumsum((value * (part & _LOW32)).reshape(rows, row), axis=1)
        sums = _folded(_shifted(_folded(high)) + _folded(low))
        total = sums[:, -1]
        carry = np.concatenate([out[begin : begin + 1], total[:-1]])
        carried = _folded(_shifted(_folded(np.cumsum(carry >> _U(32)))) + _folded(np.cumsum(carry & _LOW32)))
        out[begin + 1 : end + 1] = _reduced(sums + carried[:, None]).reshape(-1)[: end - begin]
    return out


def range_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    out = np.empty(len(start), _U)
    back = powers(_INVERSE, len(sums))
    for i in range(0, len(start), _CACHED):
        a, b = start[i : i + _CACHED], end[i : i + _CACHED]
        out[i : i + _CACHED] = mix(times(_reduced(sums[b] + (_M - sums[a])), back[a]))
    return out


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.large_binary()
    column = column.cast(pa.large_string()).cast(kind) if pa.types.is_string(column.type) else column.cast(kind)
    if column.null_count:
        column = column.fill_null(b"")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, ends - ends[0]


def blocks(batches: Iterator[pa.RecordBatch], text: str, size: int = 0) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the texts of one piece hold about ``size`` bytes; a longer text stands alone."""
    size = size or BLOCK_BYTES
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        lengths = np.diff(flat(column)[1])
        start, held = 0, 0
        for i, n in enumerate(lengths.tolist()):
            if held and held + n > size:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        if start < len(lengths):
            yield batch.slice(start)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of every word; words never cross texts."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, none
    inside = ~_SEPARATOR[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    start = np.flatnonzero(inside & (~before | edge[:n]))
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    end = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return start, end, np.searchsorted(offsets, start, "right") - 1


def windows(word_hash: np.ndarray, owner: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Index of the first word and hash of every run of ``size`` words inside one text."""
    if len(word_hash) < size:
        return np.zeros(0, np.int64), np.zeros(0, _U)
    count = len(word_hash) - size + 1
    first = np.flatnonzero(owner[:count] == owner[size - 1 :])
    value = np.zeros(len(first), _U)
    for k in range(size):
        value = mix(value * _U(_BASE) + word_hash[first + k])
    return first, value


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case, everything else as it is."""
    return np.where((data >= 65) & (data <= 90), data | 32, data).astype(np.uint8)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Text number and hash of each distinct shingle, sorted by both.

    A text with fewer than ``size`` words but at least one has its whole word sequence as one shingle.
    """
    low = lowered(data)
    start, end, owner = words(low, offsets)
    hashed = range_hash(prefix(low), start, end)
    first, value = windows(hashed, owner, size)
    of = owner[first]
    per_text = np.bincount(owner, minlength=len(offsets) - 1)
    short = np.flatnonzero((per_text > 0) & (per_text < size))
    if len(short):
        begin = np.searchsorted(owner, short)
        whole = np.zeros(len(short), _U)
        for k in range(size - 1):
            has = per_text[short] > k
            whole[has] = mix(whole[has] * _U(_BASE) + hashed[begin[has] + k])
        whole = mix(whole + _U(size) + per_text[short].astype(_U))
        of, value = np.concatenate([of, short]), np.concatenate([value, whole])
    order = np.lexsort((value, of))
    of, value = of[order], value[order]
    if len(of):
        keep = np.ones(len(of), bool)
        keep[1:] = (of[1:] != of[:-1]) | (value[1:] != value[:-1])
        of, value = of[keep], value[keep]
    return of, value


def per_text(values: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Sum of whole numbers by text."""
    return np.bincount(owner, weights=values, minlength=n).astype(np.int64)


def repeated(owner: np.ndarray, value: np.ndarray) -> np.ndarray:
    """For each (owner, value), in the given order: 0 alone, 1 the first of several, 2 a later one."""
    order = np.lexsort((value, owner))
    o, v = owner[order], value[order]
    same = np.zeros(len(o), bool)
    same[1:] = (o[1:] == o[:-1]) & (v[1:] == v[:-1])
    follows = np.zeros(len(o), bool)
    follows[:-1] = same[1:]
    out = np.zeros(len(o), np.int8)
    out[order] = np.where(same, 2, np.where(follows, 1, 0))
    return out


class KnownRuns:
    """Ids of the distinct words that a task has met, by hash.

    New words become a sorted run of their own; a run is merged into the one before unless that is over four times as long, so that a word is copied
    a logarithmic number of times while the table grows.
    """

    def __init__(self, kind: type) -> None:
        self.runs: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.ids = np.zeros(1 << 10, kind)
        self.used = 0

    def __len__(self) -> int:
        return sum(len(keys) for keys, _, _ in self.runs)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of each word begin, and how many they are; -1 for a word that is not known."""
        begin, count = np.zeros(len(keys), np.int64), np.full(len(keys), -1, np.int64)
        for known, start, size in self.runs:
            place = np.minimum(np.searchsorted(known, keys), len(known) - 1)
            hit = np.flatnonzero(known[place] == keys)
            begin[hit], count[hit] = start[place[hit]], size[place[hit]]
        return begin, count

    def add(self, keys: np.ndarray, count: np.ndarray, flat: np.ndarray) -> None:
        """New distinct keys, none of them known, with their ids one after the other."""
        if not len(keys):
            return
        if self.used + len(flat) > len(self.ids):
            grown = np.empty(2 * (self.used + len(flat)), self.ids.dtype)
            grown[: self.used] = self.ids[: self.used]
            self.ids = grown
        self.ids[self.used : self.used + len(flat)] = flat
        run = (keys, self.used + np.cumsum(count) - count, count)
        self.used += len(flat)
        merge = True
        while merge:
            order = np.argsort(run[0], kind="stable")
            run = tuple(column[order] for column in run)
            merge = bool(self.runs) and len(self.runs[-1][0]) <= 4 * len(run[0])
            if merge:
                run = tuple(np.concatenate(pair) for pair in zip(self.runs.pop(), run))
        self.runs.append(run)

    def expand(self, begin: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Ids of a sequence of words, given as ``find`` tells them."""
        before = np.cumsum(count) - count
        return self.ids[np.arange(int(count.sum())) + np.repeat(begin - before, count)]
