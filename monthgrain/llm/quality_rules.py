"""Rule bitmask ledger: every rule is evaluated once, policies are applied to stored bits.

``ledger`` reads each whole text once and adds the measurements and ``fail_bits``: bit *i* is set when rule *i* of ``RULES``
fails.  A policy version is a mask over those bits, so applying another version, or removing one rule from it, needs no text:
``apply_policy`` is one bitwise AND per row and ``ablation`` one aggregation over the distinct bit patterns.

Defined results: a null or empty text has no words and fails ``few_words``; null ids, repeated rows and ties are kept as they
are (one result row per input row, in no given order); an empty table gives an empty ledger; columns of the input that carry
a name of the ledger are replaced by the ledger's.  A text is read whole; memory follows the longest text, not the table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from monthgrain.llm import textkernel as tk

#: Measurements of one text, all whole numbers.
MEASURES = (
    "n_words",
    "word_chars",
    "n_symbols",
    "n_lines",
    "n_dup_lines",
    "n_repeat_words",
    "n_upper_words",
    "n_exclamations",
)


@dataclass(frozen=True)
class Rule:
    """``fails`` is a SQL condition over the measurements."""

    name: str
    fails: str


#: A rule's place is its bit for good: append, never reorder.
RULES = (
    Rule("few_words", "n_words < 50"),
    Rule("repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    Rule("symbols", "10 * n_symbols > n_words"),
    Rule("duplicate_lines", "10 * n_dup_lines > 4 * n_lines"),
    Rule("upper_case", "10 * n_upper_words > 5 * n_words"),
    Rule("exclamations", "10 * n_exclamations > 3 * n_words"),
    Rule("short_words", "word_chars < 2 * n_words"),
    Rule("long_words", "word_chars > 12 * n_words"),
)
BASE = ("few_words", "repeated_windows")
#: Policy versions: the rules that reject a text.
POLICIES = {
    "v1": BASE,
    "v2": tuple(r.name for r in RULES),
}
DEFAULT_POLICY = "v2"


def mask(rules: tuple[str, ...]) -> int:
    place = {r.name: i for i, r in enumerate(RULES)}
    return sum(1 << place[name] for name in set(rules))


_BYTE = np.arange(256)
_SYMBOL = np.isin(_BYTE, list(b"#*$%&|<>"))
_UPPER = (_BYTE >= 65) & (_BYTE <= 90)
_LOWER = (_BYTE >= 97) & (_BYTE <= 122)
_CONTINUED = (_BYTE >= 0x80) & (_BYTE < 0xC0)


def measure_block(column: pa.Array) -> dict[str, np.ndarray]:
    """The measurements of a block of texts, vectorised over all its bytes."""
    data, offsets = tk.flat(column)
    n = len(offsets) - 1
    start, end, owner = tk.words(data, offsets)
    sums = tk.prefix(data)

    def by_text(flags: np.ndarray) -> np.ndarray:
        total = np.zeros(len(data) + 1, np.int64)
        np.cumsum(flags, out=total[1:])
        return total[offsets[1:]] - total[offsets[:-1]]

    def in_words(flags: np.ndarray) -> np.ndarray:
        total = np.zeros(len(data) + 1, np.int64)
        np.cumsum(flags, out=total[1:])
        return total[end] - total[start]

    chars = in_words(~_CONTINUED[data])
    shout = (in_words(_UPPER[data]) > 0) & (in_words(_LOWER[data]) == 0)
    # lines: between text starts and line feeds; a line counts if it holds a word
    feeds = np.flatnonzero(data == 10)
    bounds = np.sort(np.concatenate([offsets[:-1], feeds + 1]))
    of = np.searchsorted(offsets, bounds, "right") - 1
    bounds = np.unique(bounds[(of < n) & (of >= 0)]) if n else bounds
    bounds = bounds[bounds < len(data)]
    of = np.searchsorted(offsets, bounds, "right") - 1
    stop = np.minimum(np.append(bounds[1:], len(data)), offsets[of + 1]) if len(bounds) else bounds
    stop = np.where((stop > bounds) & (data[np.maximum(stop - 1, 0)] == 10), stop - 1, stop) if len(bounds) else stop
    full = np.searchsorted(start, stop) > np.searchsorted(start, bounds)
    line_of, line_hash = of[full], tk.range_hash(sums, bounds[full], stop[full])
    later = tk.repeated(line_of, line_hash) == 2
    # words inside a window of three that occurs twice or more in its text
    first, value = tk.windows(tk.range_hash(sums, start, end), owner, 3)
    again = first[tk.repeated(owner[first], value) > 0]
    covered = np.zeros(len(start) + 3, bool)
    for k in range(3):
        covered[again + k] = True
    return {
        "n_words": np.bincount(owner, minlength=n),
        "word_chars": tk.per_text(chars, owner, n),
        "n_symbols": by_text(_SYMBOL[data]),
        "n_lines": np.bincount(line_of, minlength=n),
        "n_dup_lines": np.bincount(line_of[later], minlength=n),
        "n_repeat_words": np.bincount(owner[covered[: len(start)]], minlength=n),
        "n_upper_words": tk.per_text(shout, owner, n),
        "n_exclamations": by_text(data == 33),
    }


def _measure(text: str, keep: list[str], names: pa.Schema | None = None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in tk.blocks(batches, text):
            found = measure_block(block.column(block.schema.get_field_index(text)))
            columns = [block.column(block.schema.get_field_index(c)) for c in keep]
            columns += [pa.array(found[m].astype(np.int64)) for m in MEASURES]
            yield pa.RecordBatch.from_arrays(columns, [*keep, *MEASURES])

    return run


def fail_bits() -> Column:
    bits = F.lit(0).cast("long")
    for i, rule in enumerate(RULES):
        bits = bits + F.when(F.expr(rule.fails), F.lit(1 << i)).otherwise(F.lit(0)).cast("long")
    return bits


def ledger(docs: DataFrame, text: str = "text", keep_text: bool = False) -> DataFrame:
    """One row per document: its columns (the text only on demand), the measurements and ``fail_bits``."""
    taken = {*MEASURES, "fail_bits"}
    keep = [c for c in docs.columns if c not in taken and (keep_text or c != text)]
    source = docs.select(*dict.fromkeys([*keep, text]))
    schema = StructType([f for f in source.schema.fields if f.name in keep])
    schema = StructType([*schema.fields, *(StructField(m, LongType(), False) for m in MEASURES)])
    return source.mapInArrow(_measure(text, keep), schema).withColumn("fail_bits", fail_bits())


def apply_policy(rows: DataFrame, version: str = DEFAULT_POLICY) -> DataFrame:
    """Add ``base_failed`` and ``kept`` from the stored bits; the base always rejects."""
    failed = lambda names: F.col("fail_bits").bitwiseAND(F.lit(mask(names))) != 0
    return rows.withColumns({"base_failed": failed(BASE), "kept": ~failed((*BASE, *POLICIES[version]))})


def ablation(rows: DataFrame, version: str = DEFAULT_POLICY) -> DataFrame:
    """What each rule of a policy does: rows it fails, rows that only it fails, rows kept without it.

    Rows are first reduced to their distinct bit patterns (at most 2**rules), combined map-side.
    """
    whole = mask(POLICIES[version])
    patterns = rows.groupBy(F.col("fail_bits").bitwiseAND(F.lit(whole)).alias("bits")).agg(F.count("*").alias("n"))
    rules = [(i, r.name) for i, r in enumerate(RULES) if whole >> i & 1]
    each = F.array(*(F.struct(F.lit(name).alias("rule"), F.lit(1 << i).cast("long").alias("bit")) for i, name in rules))
    spread = patterns.select("bits", "n", F.inline(each))
    hit = F.col("bits").bitwiseAND(F.col("bit")) != 0
    alone = F.col("bits") == F.col("bit")
    count = lambda when: F.coalesce(F.sum(F.when(when, F.col("n"))), F.lit(0)).cast("long")
    return spread.groupBy("rule").agg(
        count(hit).alias("n_failed"),
        count(alone).alias("n_only"),
        count(alone | (F.col("bits") == 0)).alias("n_kept_without"),
    )
