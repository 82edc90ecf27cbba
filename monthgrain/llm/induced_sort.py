"""External induced suffix sorting with common-prefix values, vectorised.

Suffixes are sorted by their first ``depth`` symbols, and every one carries the common prefix it shares with its neighbour,
capped at ``depth`` (at most 255).  As in the two-stage induced sort, only suffixes at leftmost-S positions are sorted directly,
by naming their substrings and then recursively naming pairs of names; the L suffixes are induced from them in ascending,
the S suffixes from those in descending order.

The priority queue of an induction is monotone: tuples (position, common prefix) enter the bucket of their first symbol in
final order.  So it is one queue per symbol, and queues beyond ``memory`` bytes go to disk, chunk by chunk; the common prefix
of two induced neighbours is one more than the minimum over the sources between them, a range minimum inside a chunk and a
running minimum per symbol across chunks.
"""

from __future__ import annotations

import os
import tempfile
from collections import deque
from collections.abc import Callable, Iterator

import numpy as np

from monthgrain.llm import textkernel as tk

SYMBOLS = 258  # end, separator, 256 bytes
CHUNK = 1 << 17
MEMORY = 128 << 20


class Queues:
    """A first-in-first-out queue of (positions, common prefixes) per symbol, on disk beyond ``memory`` bytes."""

    def __init__(self, folder: str, memory: int) -> None:
        self.folder, self.memory, self.held, self.files = folder, memory, 0, 0
        self.queues: list[deque] = [deque() for _ in range(SYMBOLS)]

    def push(self, symbol: int, positions: np.ndarray, common: np.ndarray) -> None:
        if self.held + positions.nbytes > self.memory:
            self.files += 1
            path = f"{self.folder}/{id(self)}-{self.files}.npy"
            with open(path, "wb") as out:
                np.save(out, positions)
                np.save(out, common)
            self.queues[symbol].append(path)
        else:
            self.held += positions.nbytes
            self.queues[symbol].append((positions, common))

    def _take(self, queue: deque, newest: bool) -> tuple[np.ndarray, np.ndarray]:
        item = queue.pop() if newest else queue.popleft()
        if isinstance(item, str):
            with open(item, "rb") as file:
                loaded = np.load(file), np.load(file)
            os.remove(item)
            return loaded
        self.held -= item[0].nbytes
        return item

    def pop(self, symbol: int, newest: bool = False) -> tuple[np.ndarray, np.ndarray] | None:
        """What waits at one end of a queue, about a chunk of it, as one batch in queue order."""
        queue, items, size = self.queues[symbol], [], 0
        while queue and size < CHUNK:
            items.append(self._take(queue, newest))
            size += len(items[-1][0])
        if len(items) < 2:
            return items[0] if items else None
        positions, common = zip(*(reversed(items) if newest else items))
        return np.concatenate(positions), np.concatenate(common)


def _chunks(positions: np.ndarray, common: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for i in range(0, len(positions), CHUNK):
        yield positions[i : i + CHUNK], common[i : i + CHUNK]


def _range_minima(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Minimum of values[start..end], both inclusive, by a sparse table."""
    table, step = [values], 1
    while 2 * step <= len(values):
        table.append(np.minimum(table[-1][:-step], table[-1][step:]))
        step *= 2
    level = np.frexp((end - start + 1).astype(np.float64))[1] - 1
    out = np.empty(len(start), values.dtype)
    for k in np.unique(level).tolist():
        at = level == k
        out[at] = np.minimum(table[k][start[at]], table[k][end[at] - (1 << k) + 1])
    return out


class InducedSort:
    """``found(positions, common)`` gets every bucket's suffixes in order, chunk by chunk.

    ``common[i]`` is the prefix shared with the suffix before it in the pass; a suffix meets its neighbour on the other side
    as that one's predecessor.
    """

    def __init__(self, text: np.ndarray, depth: int, folder: str, memory: int = MEMORY) -> None:
        # text: symbols 1 (separator) to 257; the end symbol 0 is added here
        self.text = np.append(text.astype(np.uint16), np.uint16(0))
        self.n, self.depth, self.folder, self.memory = len(self.text), depth, folder, memory
        t = self.text
        differs = np.flatnonzero(t[1:] != t[:-1])
        following = differs[np.minimum(np.searchsorted(differs, np.arange(self.n)), len(differs) - 1)] if len(differs) else np.zeros(self.n, int)
        self.is_s = t[following] < t[np.minimum(following + 1, self.n - 1)]
        self.is_s[-1] = True
        self.run = np.minimum(following - np.arange(self.n) + 1, 255).astype(np.uint8)  # equal symbols from here
        self.run[-1] = 1
        self.leftmost = np.flatnonzero(self.is_s[1:] & ~self.is_s[:-1]) + 1

    def _named(self) -> np.ndarray:
        """Ranks of the leftmost-S substrings by content, up to ``depth`` symbols."""
        at = self.leftmost
        length = np.minimum(np.diff(at, append=self.n - 1) + 1, self.depth)
        code = self.text.astype(np.uint64) * np.uint64(2) + self.is_s.astype(np.uint64)
        padded = np.append(code, np.zeros(4, np.uint64))
        name = np.zeros(len(at), np.int64)
        active, step = np.arange(len(at)), 0
        while len(active):
            begin = at[active] + 4 * step
            left = length[active] - 4 * step
            key = np.zeros(len(active), np.uint64)
            for k in range(4):
                symbol = padded[np.minimum(begin + k, self.n)]
                key = key << np.uint64(16) | np.where(left > k, symbol, np.uint64(0))
            # refine the names of the active: order by the name so far, then by the next four symbols
            order = np.lexsort((key, name[active]))
            sorted_name, sorted_key = name[active][order], key[order]
            first = np.ones(len(order), bool)
            first[1:] = sorted_name[1:] != sorted_name[:-1]
            new = first.copy()
            new[1:] |= sorted_key[1:] != sorted_key[:-1]
            place = np.flatnonzero(first)[np.cumsum(first) - 1]
            # a name is the number of substrings before it; equal substrings keep the first one's
            start = np.flatnonzero(new)[np.cumsum(new) - 1]
            name[active[order]] = sorted_name + (start - place)
            size = np.bincount(np.cumsum(new) - 1)[np.cumsum(new) - 1]
            go_on = (size > 1) & (left[order] > 4)
            active, step = active[order][go_on], step + 1
        return name

    def _sorted_leftmost(self) -> tuple[np.ndarray, np.ndarray]:
        """Leftmost-S suffixes in order, and what each shares with the one before."""
        rank, covered, n = self._named(), 2, len(self.leftmost)
        reach = 1
        while covered < self.depth and n > 1:
            follow = np.zeros(n, np.int64)
            follow[: n - reach] = rank[reach:] + 1 if reach < n else 0
            pair = rank * (n + 1) + follow
            order = np.argsort(pair)
            new = np.ones(n, bool)
            new[1:] = pair[order][1:] != pair[order][:-1]
            start = np.flatnonzero(new)[np.cumsum(new) - 1]
            rank = np.empty(n, np.int64)
            rank[order] = start
            if new.all():
                break
            reach, covered = reach * 2, covered * 2
        order = self.leftmost[np.argsort(rank, kind="stable")]
        return order, self._shared(order)

    def _shared(self, order: np.ndarray) -> np.ndarray:
        """Capped common prefix of neighbours, by binary search over hashes of ranges."""
        sums = tk.prefix(self.text)
        a, b = order[:-1], order[1:]
        low, high = np.zeros(len(a), np.int64), np.minimum(self.depth, self.n - np.maximum(a, b))
        while len(a) and (low < high).any():
            middle = (low + high + 1) // 2
            same = tk.range_hash(sums, a, a + middle) == tk.range_hash(sums, b, b + middle)
            low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
        return np.concatenate([[0], low]).astype(np.uint8)

    def _induce(self, queues: Queues, since: np.ndarray, positions: np.ndarray, common: np.ndarray, want_s: bool) -> None:
        """Push the predecessors of a chunk of sources; ``since``: minimum since a symbol was last induced."""
        before = positions - 1
        picked = np.flatnonzero((positions > 0) & (self.is_s[before] == want_s))
        symbol = self.text[before[picked]]
        order = np.argsort(symbol, kind="stable")
        picked, symbol = picked[order], symbol[order]
        if len(picked):
            starts = np.flatnonzero(np.concatenate([[True], symbol[1:] != symbol[:-1]]))
            begin = np.zeros(len(picked), np.int64)
            begin[1:] = picked[:-1] + 1
            begin[starts] = 0
            shared = _range_minima(common, begin, picked).astype(np.int64)
            shared[starts] = np.minimum(shared[starts], since[symbol[starts]])
            shared = np.minimum(shared + 1, self.depth).astype(np.uint8)
            for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(picked)]):
                queues.push(int(symbol[s]), before[picked[s:e]], shared[s:e])
        # what lies behind the last source of each symbol
        lowest = int(common.min()) if len(common) else self.depth
        rest = np.minimum.accumulate(common[::-1])[::-1].astype(np.int64)
        behind = np.minimum(since, lowest)
        if len(picked):
            ends = np.append(starts[1:], len(picked)) - 1
            after = picked[ends] + 1
            behind[symbol[ends]] = np.where(after < len(common), rest[np.minimum(after, len(common) - 1)], self.depth)
        since[:] = behind

    def run_all(self, found: Callable[[np.ndarray, np.ndarray], None], meets: Callable[[int, int, int], None]) -> None:
        """``found`` as above; ``meets(a, b, common)`` for the L and the S suffix that touch inside a bucket."""
        order, shared = self._sorted_leftmost()
        heads = self.text[order]
        bounds = np.searchsorted(heads, np.arange(SYMBOLS + 1))
        up, kept = Queues(self.folder, self.memory), Queues(self.folder, self.memory)
        largest_l = np.full(SYMBOLS, -1, np.int64)
        since = np.zeros(SYMBOLS, np.int64)
        for c in range(SYMBOLS):
            first = True
            while (item := up.pop(c)) is not None:
                positions, common = item[0], item[1].copy()
                if first:
                    common[0], first = 0, False
                found(positions, common)
                kept.push(c, positions, common)
                largest_l[c] = positions[-1]
                self._induce(up, since, positions, common, False)
            for positions, common in _chunks(order[bounds[c] : bounds[c + 1]], shared[bounds[c] : bounds[c + 1]]):
                common = common.copy()
                if positions[0] == order[bounds[c]]:
                    common[0] = 0 if first else min(self.run[largest_l[c]], self.run[positions[0]], self.depth)
                    first = False
                self._induce(up, since, positions, common, False)
        down = Queues(self.folder, self.memory)
        since[:] = 0
        for c in range(SYMBOLS - 1, -1, -1):
            last = -1
            while (item := down.pop(c)) is not None:
                positions, common = item[0], item[1].copy()
                if last < 0:
                    common[0] = 0
                last = int(positions[-1])
                found(positions, common)
                self._induce(down, since, positions, common, True)
            ahead = 0
            while (item := kept.pop(c, newest=True)) is not None:  # L suffixes, largest first
                positions, ascending = item
                common = np.empty_like(ascending)
                common[0], common[1:] = ahead, ascending[:0:-1]
                ahead = int(ascending[0])
                positions = positions[::-1]
                if last >= 0:
                    common[0] = min(self.run[positions[0]], self.run[last], self.depth)
                    meets(int(positions[0]), last, int(common[0]))
                    last = -1
                self._induce(down, since, positions, common, True)


def repeated_positions(text: np.ndarray, depth: int, memory: int = MEMORY) -> np.ndarray:
    """Flags of the positions whose next ``depth`` symbols occur at another position too.

    ``text`` holds symbols 1 to 257; the caller sees to it that separators (1) never lie inside a wanted range.
    """
    flags = np.zeros(len(text) + 1, bool)
    before = {"at": -1}

    def found(positions: np.ndarray, common: np.ndarray) -> None:
        same = common >= depth
        flags[positions[same]] = True
        previous = np.concatenate([[before["at"]], positions[:-1]])[same]
        flags[previous[previous >= 0]] = True
        before["at"] = int(positions[-1])

    def meets(a: int, b: int, common: int) -> None:
        if common >= depth:
            flags[[a, b]] = True

    with tempfile.TemporaryDirectory() as folder:  # the task's own scratch space, gone with it
        InducedSort(text, depth, folder, memory).run_all(found, meets)
    return flags[:-1]
