"""Cost-balanced packing of token sequences.

Each task packs shards of about ``SHARD_TOKENS`` tokens.  A shard of *T* tokens gets ``T // capacity`` full sequences, and for the
rest one sequence per power of two in its binary form, which needs no padding.  Documents are taken by descending estimated
cost, ``linear * tokens + quadratic * tokens**2`` (attention stays inside a document), and each goes to the lowest-cost
sequence that still has room; what does not fit goes on in the next such sequence.  Every sequence ends full, so there is no
padding at all, and since tokens never leave the task that made them, nothing is shuffled, whatever a source holds.

Tokens come from a public vocabulary file.  Its pre-tokeniser never joins text across white space, nor letters with other
plain characters, so every distinct run is encoded once per worker and looked up after that; ids equal those of the whole text.

Defined results: a null or empty text is the end token alone; null ids, repeated rows and ties are packed like any other
row; an empty table gives no rows; extra columns are left out.  Sequence ids are unique over the job: partition and number.
"""

from __future__ import annotations

import heapq
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from monthgrain.llm import textkernel as tk

CAPACITY = 4096
END_TOKEN = 2
TOKENIZER = "word_bpe_49k.json"
SHARD_TOKENS = 2_000_000
#: Estimated cost of a token (projections) and of a pair of tokens (attention), in units of the first.
LINEAR, QUADRATIC = 1.0, 1.0 / 4096
#: Distinct runs that the per-task table holds before it starts anew; speed only.
KNOWN_RUNS = 1_000_000


_LETTER = np.zeros(256, np.uint8)
_LETTER[[*range(65, 91), *range(97, 123)]] = 1
_LEAD = np.zeros(256, bool)
_LEAD[0xC3:0xC9] = True  # U+00C0 to U+023F: letters that NFC keeps, but for the two signs below
_PLAIN = np.zeros(256, bool)
_PLAIN[0x21:0x7F] = True
_PLAIN[0x27] = False  # contractions join letters and apostrophe


def runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes with A-Z lowered, and start, end and text of the pieces that the pre-tokeniser never joins.

    White space always parts them.  A stretch of plain ASCII and Latin letters is also parted between letters and other
    characters; one with anything else (apostrophes, other scripts, marks, possible special tokens) stays whole and as it is.
    """
    start, end, owner = tk.words(data, offsets)
    if not len(start):
        return data, start, end, owner
    low, n = tk.lowered(data), len(data)
    follows = np.zeros(n, bool)
    follows[1:] = _LEAD[data[:-1]]
    good = _PLAIN[data] | _LEAD[data] | (follows & (data >= 0x80) & (data < 0xC0))
    bad = np.flatnonzero(~good & ~((data == 32) | ((data >= 9) & (data <= 13))))
    pair = data[:-1].astype(np.uint16) << 8 | data[1:]
    odd = np.flatnonzero(np.isin(pair, [0xC397, 0xC3B7, 0xC4B0, 0x3C7C]))  # U+00D7, U+00F7, U+0130, "<|"
    whole = np.unique(np.searchsorted(start, np.concatenate([bad, odd]), "right") - 1)
    letter = _LETTER[data] | _LEAD[data] | follows
    change = np.flatnonzero(letter[1:] != letter[:-1]) + 1
    stretch = np.searchsorted(start, change, "right") - 1
    keep = (stretch >= 0) & (change > start[stretch]) & (change < end[stretch]) & ~np.isin(stretch, whole)
    begins, ends = np.zeros(n + 1, bool), np.zeros(n + 1, bool)
    begins[start] = ends[end] = begins[change[keep]] = ends[change[keep]] = True
    for w in whole.tolist():
        low[start[w] : end[w]] = data[start[w] : end[w]]
    start = np.flatnonzero(begins)
    return low, start, np.flatnonzero(ends), np.searchsorted(offsets, start, "right") - 1


class RunEncoder:
    """Token ids of texts by table look-up of their runs; a run is encoded when it is first met."""

    _of: dict = {}

    @classmethod
    def of(cls, tokenizer: str) -> RunEncoder:
        """One table per worker process, shared by the tasks it runs."""
        if tokenizer not in cls._of:
            cls._of[tokenizer] = cls(tokenizer)
        return cls._of[tokenizer]

    def __init__(self, tokenizer: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        if not os.path.isabs(tokenizer):
            import public_tokenizers

            tokenizer = public_tokenizers.path(tokenizer)
        self.tokenizer = Tokenizer.from_file(tokenizer)
        vocabulary = self.tokenizer.get_vocab()
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)
        self.closes[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.known = tk.KnownRuns(np.uint32)

    def _ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and their number per text.

        Letter runs go in as one spaced line; a token that closes a word parts them, and if there is not one per run, each is encoded alone.
        """
        line = self.tokenizer.encode_batch_fast([" ".join(texts)], add_special_tokens=False)[0].ids
        flat = np.array(line, np.uint32)
        ends = np.flatnonzero(self.closes[flat]) + 1
        if len(ends) == len(texts) and ends[-1] == len(flat):
            return flat, np.diff(ends, prepend=0)
        return self._alone(texts)

    def _alone(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        count = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter((i for ids in found for i in ids), np.uint32, int(count.sum())), count

    def _learn(self, keys: np.ndarray, texts: list[str]) -> None:
        letters = np.fromiter((t.isalpha() for t in texts), bool, len(texts))
        flats, counts, order = [], [], []
        for places, encode in ((np.flatnonzero(letters), self._ids), (np.flatnonzero(~letters), self._alone)):
            for i in range(0, len(places), 500):
                part = places[i : i + 500]
                flat, count = encode([texts[k] for k in part])
                flats.append(flat)
                counts.append(count)
                order.append(part)
        self.known.add(keys[np.concatenate(order)], np.concatenate(counts), np.concatenate(flats))

    def encode(self, data: np.ndarray, offsets: np.ndarray, end_token: int) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids, each text closed by ``end_token``, and where each text begins."""
        data, start, end, owner = runs(data, offsets)
        keys, first, which = np.unique(tk.range_hash(tk.prefix(data), start, end), return_index=True, return_inverse=True)
        if len(self.known) > KNOWN_RUNS:
            self.known = tk.KnownRuns(np.uint32)
        begin, count = self.known.find(keys)
        new = count < 0
        if new.any():
            raw = data.tobytes()
            ask = first[new]
            self._learn(keys[new], [raw[a:b].decode("utf-8", "replace") for a, b in zip(start[ask].tolist(), end[ask].tolist())])
            begin[new], count[new] = self.known.find(keys[new])
        n = len(offsets) - 1
        count = count[which]
        flat = self.known.expand(begin[which], count)
        sizes = np.bincount(owner, weights=count, minlength=n).astype(np.int64) + 1
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        out = np.full(bounds[-1], end_token, np.uint32)
        # the texts before have added one end token each
        out[np.arange(len(flat)) + np.repeat(owner, count)] = flat
        return out, bounds


def place(lengths: np.ndarray, capacity: int, linear: float, quadratic: float) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of every piece of one shard."""
    full, rest = divmod(int(lengths.sum()), capacity)
    rooms = [capacity] * full + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]
    used = [0] * len(rooms)
    lowest = [(0.0, i) for i in range(len(rooms))]
    pieces = []
    for doc in np.argsort(-lengths, kind="stable").tolist():
        start, left = 0, int(lengths[doc])
        while left:
            cost, sequence = heapq.heappop(lowest)
            take = min(left, rooms[sequence] - used[sequence])
            pieces.append((doc, start, take, sequence, used[sequence]))
            used[sequence] += take
            start, left = start + take, left - take
            if used[sequence] < rooms[sequence]:
                heapq.heappush(lowest, (cost + linear * take + quadratic * take * take, sequence))
    return pieces


def _pack(tokenizer: str, capacity: int, end_token: int, linear: float, quadratic: float, shard_tokens: int, with_ids: bool):
    def shard(keys: list[pa.Array], ids: list[np.ndarray], lengths: list[np.ndarray], base: int) -> tuple[pa.RecordBatch, int]:
        key, flat, sizes = pa.concat_arrays(keys), np.concatenate(ids), np.concatenate(lengths)
        begin = np.cumsum(sizes) - sizes
        doc, start, length, sequence, offset = np.array(place(sizes, capacity, linear, quadratic), np.int64).reshape(-1, 5).T
        spans = list(zip((begin[doc] + start).tolist(), length.tolist()))
        crc = np.fromiter((zlib.crc32(flat[a : a + n]) for a, n in spans), np.int64, len(spans))
        columns = [key.take(pa.array(doc)), *(pa.array(x) for x in (start, length, crc, sizes[doc], sequence + base, offset))]
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        if with_ids:
            columns.append(pa.array([flat[a : a + n].astype(np.int32) for a, n in spans], pa.list_(pa.int32())))
            names.append("ids")
        return pa.RecordBatch.from_arrays(columns, names), base + int(sequence.max()) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = RunEncoder.of(tokenizer)
        base = TaskContext.get().partitionId() << 40
        keys, ids, lengths, held = [], [], [], 0
        for block in tk.blocks(batches, "text"):
            flat, bounds = encoder.encode(*tk.flat(block.column(1)), end_token)
            keys.append(block.column(0))
            ids.append(flat)
            lengths.append(np.diff(bounds))
            held += len(flat)
            if held >= shard_tokens:
                out, base = shard(keys, ids, lengths, base)
                yield out
                keys, ids, lengths, held = [], [], [], 0
        if held:
            yield shard(keys, ids, lengths, base)[0]

    return run


def pack(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    tokenizer: str = TOKENIZER,
    capacity: int = CAPACITY,
    end_token: int = END_TOKEN,
    linear: float = LINEAR,
    quadratic: float = QUADRATIC,
    shard_tokens: int = SHARD_TOKENS,
    with_ids: bool = False,
) -> DataFrame:
    """One row per piece: document, place in the document, checksum, sequence and place there; the ids on demand.

    ``tokenizer`` is a path or the name of a public vocabulary file.
    """
    source = docs.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text"))
    names = ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
    fields = [source.schema["doc_id"], *(StructField(n, LongType(), False) for n in names)]
    if with_ids:
        fields.append(StructField("ids", ArrayType(IntegerType(), False), False))
    run = _pack(tokenizer, capacity, end_token, linear, quadratic, shard_tokens, with_ids)
    return source.mapInArrow(run, StructType(fields))
