"""SentencePiece encoding and decoding by a batched numpy Viterbi search.

A vocabulary file gives pieces and scores; ids are those of the segmentation with the greatest sum of scores (the unigram
reading of the file, whatever algorithm trained it), of equal sums the one with the longer last piece.  The one vocabulary at
hand was trained by merging: the library's merge order can give other ids on a word, and both decode to the same text.

Text becomes the file's normal form (a leading and every space is U+2581; this file changes nothing else), which is cut
wherever no piece holds the two characters that meet.  No piece crosses a cut, so equal words share one search: distinct
words of a block are grouped by length and advance together.  The hashes of all their substrings of one width probe the sorted
hashes of the pieces at once; then, end by end, a maximum over the widths keeps scores and backpointers of all words.  Time and
memory grow with the length of a word, however long.  Characters no piece covers cost the smallest score less ten and become
their UTF-8 bytes.

Defined results: null encodes to null and decodes to null, empty to an empty list and back; null ids, repeated rows and extra
columns are kept as they are (columns named like the output are replaced); an empty table gives no rows.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from monthgrain.llm import textkernel as tk

MODEL = "piece_bpe_32k.model"
SPACE = "▁"
UNKNOWN_PENALTY = 10.0
KNOWN_WORDS = 1_500_000
#: Code points whose neighbourhoods are kept as a table; the others are searched.
COMMON = 1024
IDS_TOGETHER = 200_000
#: Words of one length that advance together.
TOGETHER = 4096
#: Cells (end, width, word) of one look-up table.
CELLS = 1 << 16
#: Bits below those that the bitmap of the piece keys is indexed by.
_LEADING = np.uint64(64 - 20)
_U = np.uint64
_STEP = _U(0x9E3779B97F4A7C15 | 1)


def _path(model: str) -> str:
    if os.path.isabs(model):
        return model
    import public_tokenizers

    return public_tokenizers.path(model)


class Pieces:
    """Vocabulary in arrays, one per worker process."""

    _of: dict = {}

    @classmethod
    def of(cls, model: str) -> Pieces:
        if model not in cls._of:
            cls._of[model] = cls(model)
        return cls._of[model]

    def __init__(self, model: str) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=_path(model))
        self.size = sp.get_piece_size()
        self.texts = [sp.id_to_piece(i) for i in range(self.size)]
        self.byte_of = {i: int(self.texts[i][3:5], 16) for i in range(self.size) if sp.is_byte(i)}
        self.byte_id = np.zeros(256, np.int32)
        for i, b in self.byte_of.items():
            self.byte_id[b] = i
        special = [sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) for i in range(self.size)]
        mark, hidden = SPACE.encode(), {i for i in range(self.size) if sp.is_control(i)}
        self.bytes_of = [b"" if i in hidden else t.encode().replace(mark, b" ") for i, t in enumerate(self.texts)]
        for i, b in self.byte_of.items():
            self.bytes_of[i] = bytes([b])
        normal = [i for i in range(self.size) if not special[i]]
        keys = np.array([self.key(self.texts[i]) for i in normal], _U)
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], np.array(normal, np.int32)[order]
        self.scores = np.array([sp.get_score(i) for i in normal], np.float64)[order]
        self.unknown = float(self.scores.min()) - UNKNOWN_PENALTY
        self.longest = max(len(self.texts[i]) for i in normal)
        # neighbours that some piece holds together; elsewhere a text may be cut
        pairs = {(ord(t[k]), ord(t[k + 1])) for t in (self.texts[i] for i in normal) for k in range(len(t) - 1)}
        self.joined = np.sort(np.array([x << 21 | y for x, y in pairs], np.int64))
        self.common = np.zeros((COMMON, COMMON), bool)
        for x, y in pairs:
            if x < COMMON and y < COMMON:
                self.common[x, y] = True
        self.likely = np.zeros(1 << (64 - int(_LEADING)), bool)
        self.likely[(self.keys >> _LEADING).astype(np.int64)] = True
        self.known = tk.KnownRuns(np.int32)

    @staticmethod
    def key(text: str) -> int:
        value = 0
        for c in text:
            value = (value * int(_STEP) + ord(c) + 1) % (1 << 64)
        return int(tk.mix(np.array([value], _U) ^ _U(len(text)))[0])

    def _table(self, codes: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
        """Scores and ids of the pieces that end at ``low`` … ``high`` - 1, one row per width, the longest first.

        All substrings of one width are hashed and looked up at once; a bitmap of the keys' leading bits spares most searches.
        """
        n, widest = codes.shape[1], self.longest
        first = max(0, low - widest)
        score = np.full((high - low, widest, n), -np.inf)
        ids = np.full((high - low, widest, n), -1, np.int32)
        score[:, widest - 1] = self.unknown  # a character alone may be unknown
        rolled = np.zeros((high - first, n), _U)
        for width in range(1, min(widest, high - 1 - first) + 1):
            starts = high - first - width
            rolled = rolled[:starts] * _STEP + codes[first + width - 1 : first + width - 1 + starts] + _U(1)
            skip = max(0, low - width - first)
            value = tk.mix(rolled[skip:] ^ _U(width))
            at, who = np.nonzero(self.likely[(value >> _LEADING).astype(np.int64)])
            asked = value[at, who]
            place = np.minimum(np.searchsorted(self.keys, asked), len(self.keys) - 1)
            hit = self.keys[place] == asked
            at, who, place = at[hit] + (skip + first + width - low), who[hit], place[hit]
            score[at, widest - width, who] = self.scores[place]
            ids[at, widest - width, who] = self.ids[place]
        return score, ids

    def viterbi(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of words of one length, given as rows of code points, and their number per word."""
        n, length = words.shape
        codes = np.ascontiguousarray(words.T).astype(_U)
        widest = self.longest
        best = np.full((widest + length + 1, n), -np.inf)
        best[widest] = 0
        width = np.zeros((length + 1, n), np.int32)
        piece = np.full((length + 1, n), -1, np.int32)
        step = max(1, CELLS // (widest * n))
        row = np.zeros((step, n), np.intp)
        for low in range(1, length + 1, step):
            high = min(low + step, length + 1)
            score, ids = self._table(codes, low, high)
            for end in range(low, high):
                # starts in ascending order: of equal sums the earliest, that is the longest last piece, is found first
                sums = score[end - low] + best[end : end + widest]
                sums.argmax(axis=0, out=row[end - low])
                sums.max(axis=0, out=best[end + widest])
            width[low:high] = widest - row[: high - low]
            piece[low:high] = np.take_along_axis(ids, row[: high - low, None], axis=1)[:, 0]
        ends = np.zeros((length + 1, n), bool)
        ends[length] = True
        if n == 1:
            back, end = width[:, 0].tolist(), length
            while end:
                end -= back[end]
                ends[end] = True
        for end in range(length, 0, -1) if n > 1 else ():
            who = np.flatnonzero(ends[end])
            ends[end - width[end, who], who] = True
        who, end = np.nonzero(ends[1:].T)
        chosen = piece[end + 1, who]
        size = np.ones(len(chosen), np.int64)
        unknown = np.flatnonzero(chosen < 0)
        spelt = [self.byte_id[np.frombuffer(chr(c).encode("utf-8"), np.uint8)] for c in words[who[unknown], end[unknown]].tolist()]
        size[unknown] = [len(x) for x in spelt]
        flat = np.repeat(chosen, size)
        if spelt:
            flat[flat < 0] = np.concatenate(spelt)
        return flat, np.bincount(who, weights=size, minlength=n).astype(np.int64)

    def _learn(self, keys: np.ndarray, codes: np.ndarray, start: np.ndarray, end: np.ndarray) -> None:
        """Search new distinct words, equal lengths together, and add them to the table."""
        length = end - start
        flats, counts, order = [], [], []
        for n in np.unique(length).tolist():
            same = np.flatnonzero(length == n)
            together = max(1, min(TOGETHER, (1 << 21) // n))
            for i in range(0, len(same), together):
                part = same[i : i + together]
                flat, count = self.viterbi(codes[start[part][:, None] + np.arange(n)])
                flats.append(flat)
                counts.append(count)
                order.append(part)
        self.known.add(keys[np.concatenate(order)], np.concatenate(counts), np.concatenate(flats))

    def encode(self, texts: list[str | None]) -> list[np.ndarray | None]:
        """Ids of each text of a block; all words of the block are cut and looked up together."""
        forms = [SPACE + t.replace(" ", SPACE) if t else "" for t in texts]
        codes = np.frombuffer("".join(forms).encode("utf-32-le", "surrogatepass"), np.uint32)
        none = np.zeros(0, np.int32)
        if not len(codes):
            return [None if t is None else none for t in texts]
        ends = np.cumsum([len(f) for f in forms])
        cut = np.ones(len(codes), bool)
        left, right = codes[:-1], codes[1:]
        plain = (left < COMMON) & (right < COMMON)
        cut[1:][plain] = ~self.common[left[plain], right[plain]]
        rare = np.flatnonzero(~plain)
        pair = left[rare].astype(np.int64) << 21 | right[rare]
        at = np.minimum(np.searchsorted(self.joined, pair), len(self.joined) - 1)
        cut[1:][rare] = self.joined[at] != pair
        cut[ends[ends < len(codes)]] = True
        start = np.flatnonzero(cut)
        end = np.append(start[1:], len(codes))
        keys, first, which = np.unique(tk.range_hash(tk.prefix(codes), start, end), return_index=True, return_inverse=True)
        if len(self.known) > KNOWN_WORDS:
            self.known = tk.KnownRuns(np.int32)
        begin, count = self.known.find(keys)
        new = count < 0
        if new.any():
            self._learn(keys[new], codes, start[first[new]], end[first[new]])
            begin[new], count[new] = self.known.find(keys[new])
        count = count[which]
        flat = self.known.expand(begin[which], count)
        bounds = np.concatenate([[0], np.cumsum(count)])[np.searchsorted(start, np.concatenate([[0], ends]))]
        return [None if t is None else flat[a:b] for t, a, b in zip(texts, bounds.tolist(), bounds[1:].tolist())]

    def decode(self, ids: list[int] | None) -> str | None:
        if ids is None:
            return None
        text = b"".join([self.bytes_of[i] for i in ids]).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


def _small(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """Pieces of batches with about ``IDS_TOGETHER`` ids."""
    for batch in batches:
        lengths = batch.column(batch.schema.get_field_index(column)).value_lengths().fill_null(0).to_pylist()
        start, held = 0, 0
        for i, n in enumerate(lengths):
            if held and held + n > IDS_TOGETHER:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        if start < len(lengths):
            yield batch.slice(start)


def _mapped(column: str, keep: list[str], name: str, kind: pa.DataType, model: str, encoding: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces.of(model)
        for batch in tk.blocks(batches, column) if encoding else _small(batches, column):
            values = batch.column(batch.schema.get_field_index(column)).to_pylist()
            done = pieces.encode(values) if encoding else [pieces.decode(v) for v in values]
            columns = [batch.column(batch.schema.get_field_index(c)) for c in keep]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(done, kind)], [*keep, name])

    return run


def encode(rows: DataFrame, text: str = "text", out: str = "ids", model: str = MODEL, keep: list[str] | None = None) -> DataFrame:
    """``keep`` (by default all other columns) and the ids of every text."""
    keep = [c for c in (keep or rows.columns) if c != out]
    schema = StructType([*rows.select(*keep).schema.fields, StructField(out, ArrayType(IntegerType(), False))])
    source = rows.select(*dict.fromkeys([*keep, text]))
    return source.mapInArrow(_mapped(text, keep, out, pa.list_(pa.int32()), model, True), schema)


def decode(rows: DataFrame, ids: str = "ids", out: str = "text", model: str = MODEL, keep: list[str] | None = None) -> DataFrame:
    """``keep`` (by default all other columns) and the text of every list of ids."""
    keep = [c for c in (keep or rows.columns) if c != out]
    schema = StructType([*rows.select(*keep).schema.fields, StructField(out, StringType())])
    source = rows.select(*dict.fromkeys([*keep, ids]))
    return source.mapInArrow(_mapped(ids, keep, out, pa.string(), model, False), schema)
