"""Quality classifier: an interpolated modified Kneser-Ney n-gram model over characters, trained on trusted text.

Characters are code points, all of them kept apart.  An n-gram is its last symbol and its context, the symbols before that one
as a number of 21 bits each.  One pass counts, per task and then by shuffled sums, how often every n-gram of the corpus occurs in
trusted text; those that never do are kept with count 0, as they need a probability too.

The model is a chain of joins between tables sharded by context: counts of an order join the totals of their contexts, the
three discounts of the order and the probabilities of the order below.  The lowest order is interpolated with equal shares of all
characters of the corpus.  The finished table grows with the corpus and stays sharded: documents are packed in runs and dealt into blocks
of ``BLOCK`` bytes, the distinct n-grams of each block are joined with the table, and the probabilities found return to their block.

Texts fall into two folds by their hash.  Each fold has a model, and a document is measured by the model of the other fold, so
no text is measured by a model that it trained.  A language's threshold is a quantile of the perplexities of its trusted
documents, which are held out that way; a language without any takes the quantile of all.  ``kept`` is false above it.

Defined results: null or empty texts have no symbols, a null perplexity and are not kept; a null language is a language of its own;
null ids are never trusted; repeated rows, ties and repeated labels (any good label counts) do no harm; where only
one fold has trusted text, its model measures all; without trusted text every document is kept, with null perplexity; an empty table gives no rows; other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from monthgrain.llm import textkernel as tk
from monthgrain.llm.work import Work

ORDER = 4
#: Of a code point, and of the pad before a text, which is no code point.
BITS = 21
PAD = 0x110000
#: Share of trusted documents of a language that its threshold keeps; on the labels of sf0.1 the share of junk rejected plus
#: the share of clean text kept is largest here (README).
QUANTILE = 0.985
FOLDS = 2
#: Bytes of text that share one look-up table, and those that are measured at a time.
BLOCK, PIECE = 8 << 20, 2 << 20
#: Bytes of text that are packed, and so dealt, together.
PACK = 1 << 18
FOUND = "context long, symbol long"


def _code_points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code point of every character and the place of its first byte."""
    at = np.flatnonzero((data & 0xC0) != 0x80)
    point = data[at].astype(np.int32)
    long = np.flatnonzero(point >= 0xC0)
    lead = point[long]
    for size, first, last in ((2, 0xC0, 0xDF), (3, 0xE0, 0xEF), (4, 0xF0, 0xFF)):
        some = long[(lead >= first) & (lead <= last)]
        some = some[at[some] + size <= len(data)]
        value = point[some] & (0x7F >> size)
        for k in range(1, size):
            value = value << 6 | (data[at[some] + k] & 0x3F)
        point[some] = np.minimum(value, PAD - 1)
    return point, at


def ngrams(data: np.ndarray, offsets: np.ndarray, order: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Code of the n-gram that ends at each character, its text, and the characters that codes number; a text starts after order - 1 pads.

    There is one piece, unless the texts hold so many characters that codes need more than 63 bits.
    """
    point, at = _code_points(data)
    begins = np.searchsorted(at, offsets)
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(begins))
    place = np.arange(len(point)) + (order - 1) * (owner + 1)
    padded = np.full(len(point) + (order - 1) * (len(offsets) - 1), PAD, np.int32)
    padded[place] = point
    number = np.zeros(PAD + 1, np.int64)
    most = 1 << 63 // order
    step = len(point) if len(_alphabet(padded)) < most else most // order - 1
    for first in range(0, len(point), step or 1):
        end = place[first : first + step] - place[first]
        known = padded[place[first] - order + 1 : place[first] + end[-1] + 1]
        alphabet = _alphabet(known)
        number[alphabet] = np.arange(len(alphabet))
        local = number[known]
        code = local[: len(local) - order + 1]
        for k in range(1, order):
            code = code * len(alphabet) + local[k : len(local) - order + 1 + k]
        yield code[end], owner[first : first + step], alphabet


def _alphabet(points: np.ndarray) -> np.ndarray:
    seen = np.zeros(PAD + 1, bool)
    seen[points] = True
    return np.flatnonzero(seen)


def parts(code: np.ndarray, alphabet: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Context and last symbol of n-grams, in code points."""
    code, symbol = np.divmod(code, len(alphabet))
    context = np.zeros(len(code), np.int64)
    for k in range(order - 1):
        code, one = np.divmod(code, len(alphabet))
        context |= alphabet[one] << BITS * k
    return context, alphabet[symbol]


def _counts(order: int):
    """(context, symbol, n0, n1) per piece: counts in the trusted text of each fold; ``fold`` is null where a text is not trusted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in tk.blocks(batches, "text", PIECE):
            trusted = block.column(1).fill_null(-1).to_numpy(zero_copy_only=False)
            for code, owner, alphabet in ngrams(*tk.flat(block.column(0)), order):
                seen, fold = np.unique(code), trusted[owner]
                columns = [*parts(seen, alphabet, order)]
                for k in range(FOLDS):
                    value, count = np.unique(code[fold == k], return_counts=True)
                    total = np.zeros(len(seen), np.int64)
                    total[np.searchsorted(seen, value)] = count
                    columns.append(total)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["context", "symbol", *(f"n{k}" for k in range(FOLDS))])

    return run


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(task, no, texts): runs of rows with about ``PACK`` bytes of text, compressed together; ``no`` counts those of a task."""
    task, no = TaskContext.get().partitionId(), 0
    for piece in tk.blocks(batches, "text", PACK):
        out = pa.BufferOutputStream()
        with pa.ipc.new_stream(out, piece.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
            stream.write_batch(piece)
        yield pa.RecordBatch.from_arrays([pa.array([task]), pa.array([no]), pa.array([out.getvalue().to_pybytes()], pa.binary())], ["task", "no", "texts"])
        no += 1


def _unpacked(packs: pa.Table) -> list[pa.RecordBatch]:
    """The rows of a block, in pieces as large as they may be."""
    batches = [batch for pack in packs["texts"] for batch in pa.ipc.open_stream(pack.as_buffer())]
    return pa.Table.from_batches(batches).combine_chunks().to_batches() if batches else []


def _wanted(order: int):
    """The distinct n-grams of a block of documents."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        pieces = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for block in tk.blocks(_unpacked(table), "text", PIECE):
            texts = tk.flat(block.column(block.schema.get_field_index("text")))
            pieces += [parts(np.unique(code), alphabet, order) for code, _, alphabet in ngrams(*texts, order)]
        context, symbol = (np.concatenate(column) for column in zip(*pieces))
        by = np.lexsort((symbol, context))
        context, symbol = context[by], symbol[by]
        new = np.ones(len(context), bool)
        new[1:] = (context[1:] != context[:-1]) | (symbol[1:] != symbol[:-1])
        context, symbol = context[new], symbol[new]
        block = np.full(len(context), key[0].as_py(), np.int64)
        return pa.table({"block": block, "context": context, "symbol": symbol})

    return run


def _discounts(counts: DataFrame) -> Column:
    """Modified Kneser-Ney discount of a count, from how many n-grams of its order occur once to four times."""
    sums = [F.sum(F.when(F.col("n") == i, 1).otherwise(0)).alias(f"n{i}") for i in (1, 2, 3, 4)]
    n1, n2, n3, n4 = (float(x or 0) for x in counts.agg(*sums).first())
    y = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
    one = 1 - 2 * y * n2 / n1 if n1 else 0.5
    two = 2 - 3 * y * n3 / n2 if n2 else 1.0
    more = 3 - 4 * y * n4 / n3 if n3 else 1.5
    bounded = [min(max(d, 0.05), i - 0.05) for i, d in ((1, one), (2, two), (3, more))]
    n = F.col("n")
    return F.when(n == 1, bounded[0]).when(n == 2, bounded[1]).when(n > 2, bounded[2]).otherwise(0.0)


def chain(counts: DataFrame, work: Work, order: int, bits: int = BITS, symbols: int | None = None, label: str = "") -> DataFrame:
    """(context, symbol, p): probability of every n-gram in ``counts`` (context, symbol, n), given its context.

    The counts of a lower order are continuation counts: in how many different symbols its n-grams are preceded.  ``symbols``:
    how many there are; if not given, those of the table.
    """
    shorter = lambda k: F.col("context").bitwiseAND(F.lit((1 << bits * (k - 1)) - 1))
    orders = {order: counts}
    for k in range(order - 1, 0, -1):
        continued = orders[k + 1].groupBy(shorter(k).alias("context"), "symbol").agg(F.sum(F.when(F.col("n") > 0, 1).otherwise(0)).alias("n"))
        orders[k] = work.save(continued, f"{label}order-{k}")
    uniform = 1.0 / (symbols or max(1, orders[1].count()))
    below = None
    for k in range(1, order + 1):
        table = orders[k].withColumn("d", _discounts(orders[k]))
        context = table.groupBy("context").agg(F.sum("n").cast("double").alias("total"), F.sum("d").alias("mass"))
        joined = table.join(context, "context")
        if below is None:
            lower = joined.withColumn("lower", F.lit(uniform))
        else:
            under = below.select(F.col("context").alias("suffix"), "symbol", F.col("p").alias("lower"))
            lower = joined.withColumn("suffix", shorter(k - 1)).join(under, ["suffix", "symbol"])
        known = (F.col("n") - F.col("d") + F.col("mass") * F.col("lower")) / F.col("total")
        p = F.when(F.col("total") > 0, known).otherwise(F.col("lower"))
        below = work.save(lower.select("context", "symbol", p.alias("p")), f"{label}probability-{k}")
    return below


def train(counts: DataFrame, work: Work, order: int = ORDER, label: str = "", bits: int = 6) -> DataFrame:
    """(code, logp): natural log probability of every n-gram in ``counts`` (code, n), given its first symbols.

    For alphabets of ``2**bits`` symbols whose n-grams fit into one number.
    """
    symbol = F.col("code").bitwiseAND(F.lit((1 << bits) - 1))
    model = chain(counts.select(F.shiftright("code", bits).alias("context"), symbol.alias("symbol"), "n"), work, order, bits, 1 << bits, label)
    return model.select((F.shiftleft("context", bits) + F.col("symbol")).alias("code"), F.log("p").cast("float").alias("logp"))


def _scored(order: int):
    """Perplexity of each text of a block under the model that its fold did not train."""

    def run(packs: pa.Table, model: pa.Table) -> pa.Table:
        contexts, row = np.unique(model["context"].to_numpy(), return_inverse=True)
        keys = row << BITS | model["symbol"].to_numpy()
        by = np.argsort(keys)
        keys = keys[by]
        logs = np.stack([model[f"logp{k}"].to_numpy()[by] for k in range(FOLDS)])
        out = []
        for block in tk.blocks(_unpacked(packs), "text", PIECE):
            named = lambda c: block.column(block.schema.get_field_index(c))  # noqa: B023, E731
            # a null text has no characters, so its fold plays no part
            fold = named("fold").fill_null(0).to_numpy(zero_copy_only=False)
            n, total = np.zeros(block.num_rows, np.int64), np.zeros(block.num_rows)
            for code, owner, alphabet in ngrams(*tk.flat(named("text")), order):
                distinct, which = np.unique(code, return_inverse=True)
                context, symbol = parts(distinct, alphabet, order)
                found = logs[:, np.searchsorted(keys, np.searchsorted(contexts, context) << BITS | symbol)]
                n += np.bincount(owner, minlength=block.num_rows)
                total += np.bincount(owner, weights=found[1 - fold[owner], which], minlength=block.num_rows)
            value = np.exp(-total / np.maximum(n, 1))
            columns = [named("doc_id"), named("lang"), pa.array(n), pa.array(value, mask=n == 0)]
            out.append(pa.RecordBatch.from_arrays(columns, ["doc_id", "lang", "n_symbols", "perplexity"]))
        schema = pa.schema([("doc_id", pa.int64()), ("lang", pa.string()), ("n_symbols", pa.int64()), ("perplexity", pa.float64())])
        return pa.Table.from_batches(out).cast(schema) if out else schema.empty_table()

    return run


def _perplexities(docs: DataFrame, fold: Column, model: DataFrame) -> DataFrame:
    """doc_id, lang, n_symbols and perplexity; ``model`` has context, symbol and logp by fold."""
    held = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # texts travel packed, or their exchange alone would fill most of the disk that the query may take
    packs = docs.withColumns({"doc_id": F.col("doc_id").cast("long"), "fold": fold}).mapInArrow(_packed, "task long, no long, texts binary")
    block = F.pmod(F.xxhash64("task", "no"), F.lit(max(1, held // BLOCK)))
    # both readers below share this one exchange of the texts
    dealt = packs.select(block.alias("block"), "texts").repartition("block")
    wanted = dealt.groupBy("block").applyInArrow(_wanted(ORDER), f"block long, {FOUND}")
    found = wanted.join(model, ["context", "symbol"]).select("block", *model.columns)
    schema = "doc_id long, lang string, n_symbols long, perplexity double"
    return dealt.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(_scored(ORDER), schema)


def score(
    docs: DataFrame, labels: DataFrame, work: Work, key: str = "doc_id", text: str = "text", lang: str = "lang", quantile: float = QUANTILE
) -> DataFrame:
    """doc_id, lang, n_symbols, perplexity, threshold and kept; ``labels`` (key, quality): 1 marks trusted text."""
    docs = docs.select(F.col(key).alias("doc_id"), F.col(lang).alias("lang"), F.col(text).alias("text"))
    good = labels.filter("quality = 1").select(F.col(key).alias("doc_id")).filter("doc_id is not null").distinct()
    good = good.withColumn("trusted", F.lit(True))
    # a merge join at every size: the labels grow with the documents, and one plan makes the disk it needs foreseeable
    fold = F.pmod(F.xxhash64("text"), F.lit(FOLDS)).cast("int")
    texts = docs.select("doc_id", "text").join(good.hint("merge"), "doc_id", "left").select("text", F.when(F.col("trusted"), fold).alias("fold"))
    counted = texts.mapInArrow(_counts(ORDER), f"{FOUND}, n0 long, n1 long")
    counted = counted.groupBy("context", "symbol").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    counted = work.save(counted, "counts")
    trained = [k for k in range(FOLDS) if not counted.filter(f"n{k} > 0").isEmpty()]
    if not trained:
        bare = docs.select("doc_id", "lang", F.lit(None).cast("long").alias("n_symbols"), F.lit(None).cast("double").alias("perplexity"))
        return bare.withColumns({"threshold": F.lit(None).cast("double"), "kept": F.lit(True)})
    models = [chain(counted.select("context", "symbol", F.col(f"n{k}").alias("n")), work, ORDER, label=f"fold-{k}-") for k in trained]
    log = lambda k: models[k].select("context", "symbol", F.log("p").cast("float").alias(f"logp{abs(k)}"))
    model = work.save(log(0).join(log(-1), ["context", "symbol"]), "model")
    rows = work.save(_perplexities(docs, fold, model), "scores")
    trusted = rows.join(good, "doc_id", "left_semi").filter("perplexity is not null")
    # percentile_approx merges bounded sketches, however many documents a language has
    cut = lambda: F.percentile_approx("perplexity", quantile, 10_000)
    by_lang = trusted.groupBy("lang").agg(cut().alias("own"))
    overall = trusted.agg(cut().alias("t")).first()["t"]
    by_lang = by_lang.withColumnRenamed("lang", "of")
    judged = rows.join(by_lang, rows.lang.eqNullSafe(by_lang.of), "left")
    judged = judged.withColumn("threshold", F.coalesce("own", F.lit(overall).cast("double")))
    kept = F.coalesce((F.col("perplexity") <= F.col("threshold")) | F.col("threshold").isNull(), F.lit(False)) & (F.col("n_symbols") > 0)
    return judged.withColumn("kept", kept).select("doc_id", "lang", "n_symbols", "perplexity", "threshold", "kept")
