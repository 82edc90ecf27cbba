"""Source divergence audit: how far the term distribution of each source is from the other sources of its language.

1. One pass over the texts counts, per task and then by shuffled sums, how often each term occurs in each group (language, source) and
   in how many of its documents: the sparse document vectors, summed by group.  A document is in one group, so a language's document
   counts are the sums over its groups.
2. Per language a ``CountVectorizer`` with ``minDF`` 3 and the largest integer as ``vocabSize`` keeps every term that at least
   three documents hold.  It is given the counted terms, each in as many documents as hold it, three at most, rather than the texts
   again.  Its vocabulary lives on the driver, so it must be bounded: where a language has more than ``TERMS`` kept terms,
   they are dealt into shards by hash and each shard has a vectorizer of its own.  Shards share no term, so sums over shards are exact.
3. The counts are joined with the vocabularies, which leaves those of the kept terms.
4. Shares are whole numbers: p = 1 + floor(10^9 * (count + 1) / (N + V)).
5. Pairs of sources are evaluated sparsely.  With p0 the share of a term that a source lacks, the sum over all V terms of
   f(p, q) = floor((p - q)^2 / q) is V * f(p0, q0), plus corrections for terms that one side holds (these depend on the count
   alone, so they are taken from each source's table of equal counts), plus corrections for terms that both hold.  The last
   are added up inside tasks, over blocks of terms, into one row per pair and block: never one row per pair and term.

Numbers stay in 64 bits: p is at most 10^9 + 1; sums of f over a language stay below 10^18 + 10^9 * V; counts go through decimals.

Defined results: null texts, languages and sources are read as empty strings; a text without terms adds nothing, but its group
occurs; a language without kept terms has pairs of value 0 and no terms; repeated rows count as documents of their own; a
language with one source has no pairs; an empty table gives no rows; other columns, whatever their names, are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.ml.feature import CountVectorizer
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from monthgrain.llm import textkernel as tk
from monthgrain.llm.work import Work

NO_TERM = "0"
MIN_DOCUMENTS = 3
MAX_INTEGER = (1 << 31) - 1
SCALE = 1_000_000_000
TOP = 200
#: Kept terms that one vocabulary may hold.
TERMS = 1 << 20
#: Terms that one document of a vectorizer holds, about.
LISTED = 1 << 10
_OUTSIDE = np.ones(256, bool)
_OUTSIDE[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
#: Vectorizers that are fitted at a time.
TOGETHER = 4


def _fitted(held: DataFrame, no: int, shard: int, shards: int, work: Work) -> str:
    """Folder of the vectorizer of one language and shard; ``held`` (lang_no, item, df) has the terms and how many documents hold them."""
    own = held.filter(F.col("lang_no") == no)
    if shards > 1:
        own = own.filter(F.pmod(F.xxhash64("item"), F.lit(shards)) == shard)
    # the vectorizer only asks whether a term is in MIN_DOCUMENTS documents, so each term is in as many as it has, that number at most
    copy = F.explode(F.sequence(F.lit(1), F.least("df", F.lit(MIN_DOCUMENTS)).cast("int"))).alias("copy")
    some = own.select("item", F.pmod(F.xxhash64("item", F.lit(no)), F.lit(TERMS // LISTED + 1)).alias("part"), copy)
    listed = some.groupBy("part", "copy").agg(F.collect_list("item").alias("terms")).select("terms")
    # a vectorizer refuses an empty vocabulary: documents of a word that no text can hold keep one entry in it
    padding = held.sparkSession.createDataFrame([([NO_TERM],)] * MIN_DOCUMENTS, "terms array<string>")
    vectorizer = CountVectorizer(inputCol="terms", outputCol="vector", minDF=float(MIN_DOCUMENTS), vocabSize=MAX_INTEGER)
    path = work.path(f"vectorizer-{no}-{shard}")
    vectorizer.fit(listed.unionByName(padding)).save(path)
    return path


def _block_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang_no, group, item, n, df): how often each term is in a block's texts of a group, and in how many of them."""
    for block in tk.blocks(batches, "text", 1 << 21):
        lang, group = (block.column(i).to_numpy(zero_copy_only=False) for i in range(2))
        data, offsets = tk.flat(block.column(2))
        start, end, owner = tk.words(np.where(_OUTSIDE[data], 0x20, 0x61).astype(np.uint8), offsets)
        data = tk.lowered(data)
        value = tk.range_hash(tk.prefix(data), start, end)
        value = tk.mix(value + tk.mix(group.astype(np.uint64))[owner])
        order = np.argsort(value, kind="stable")  # texts of a term stay in order
        value, text = value[order], owner[order]
        head = np.ones(len(value), bool)
        head[1:] = value[1:] != value[:-1]
        fresh = head.copy()
        fresh[1:] |= text[1:] != text[:-1]
        at = np.flatnonzero(head)
        n = np.diff(np.append(at, len(value)))
        df = np.add.reduceat(fresh, at, dtype=np.int64) if len(at) else n
        first, of = order[at], text[at]
        columns = [pa.array(lang[of].astype(np.int32)), pa.array(group[of]), _strings(data, start[first], end[first]), pa.array(n), pa.array(df)]
        yield pa.RecordBatch.from_arrays(columns, ["lang_no", "group", "item", "n", "df"])


def _strings(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum(end - start)])
    at = np.arange(ends[-1]) + np.repeat(start - ends[:-1], end - start)
    buffers = [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data[at])]
    return pa.Array.from_buffers(pa.string(), len(start), buffers)


def _counts(rows: DataFrame) -> DataFrame:
    """(lang_no, group, item, n, df): occurrences of every term in a group, and how many of its documents hold it, in one pass over the texts."""
    found = rows.select("lang_no", "group", "text").mapInArrow(_block_counts, "lang_no int, group long, item string, n long, df long")
    return found.groupBy("lang_no", "group", "item").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))


def _held(counts: DataFrame) -> DataFrame:
    """(lang_no, item, df): the terms that enough documents of a language hold."""
    return counts.groupBy("lang_no", "item").agg(F.sum("df").alias("df")).filter(F.col("df") >= MIN_DOCUMENTS)


def _shards(rows: DataFrame) -> dict[int, int]:
    """Vectorizers that each language needs, from the number of terms that it keeps, counted over all documents.

    ``rows``: lang_no and text, or the terms as ``_held`` gives them.
    """
    held = rows if "df" in rows.columns else _held(_counts(rows.withColumn("group", F.col("lang_no").cast("long"))))
    seen = held.groupBy("lang_no").agg(F.count("*").alias("n")).collect()
    # hashes deal terms a little unevenly
    return {r.lang_no: 1 + int(r.n * 1.1) // TERMS for r in seen}


def _vocabularies(held: DataFrame, jobs: list, work: Work) -> DataFrame:
    """(lang_no, term, item): the numbered terms of all vectorizers, written once."""
    spark = held.sparkSession
    with ThreadPoolExecutor(TOGETHER) as pool:
        run = inheritable_thread_target(spark)(lambda job: _fitted(held, *job, work))
        paths = list(pool.map(run, jobs))
    words = spark.createDataFrame([], "lang_no int, term long, item string")
    for k, ((no, _, _), path) in enumerate(zip(jobs, paths)):
        named = spark.read.schema("vocabulary array<string>").parquet(f"{path}/data").select(F.posexplode("vocabulary").alias("i", "item"))
        named = named.select(F.lit(no).alias("lang_no"), (F.lit(k * (1 << 32)) + F.col("i")).alias("term"), "item")
        words = words.unionByName(named.filter(F.col("item") != NO_TERM))
    return work.save(words, "vocabulary")


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (count + 1) / (total + terms)); counts whose product leaves 64 bits go through decimals."""
    top, bottom = count + 1, total + terms
    short = F.call_function("div", top * SCALE, bottom)
    long = F.call_function("div", top.cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)"), bottom.cast("decimal(20,0)"))
    return 1 + F.when(count < 9_000_000_000, short).otherwise(long.cast("long"))


def gap(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def _both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Corrections for terms that both sources hold, added up per block of terms.

    Rows (lang_no, term number, source number, p, p0), sorted by term: with H the holders of a term, every pair of them adds
    f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0).
    """
    held = None

    def of_language(no: int, rows: list[np.ndarray]) -> pa.RecordBatch:
        term, source, p, p0 = rows
        head = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]]))
        size = np.diff(np.append(head, len(term)))
        numbers, local = np.unique(source, return_inverse=True)
        width = len(numbers)
        sums = np.zeros(width * width, np.int64)
        for n in np.unique(size[size > 1]).tolist():
            first = head[size == n]
            step = max(1, (1 << 18) // (n * n))
            for i in range(0, len(first), step):
                at = first[i : i + step, None] + np.arange(n)
                a, b, a0, b0 = p[at][:, :, None], p[at][:, None, :], p0[at][:, :, None], p0[at][:, None, :]
                part = (a - b) ** 2 // b - (a - b0) ** 2 // b0 - (a0 - b) ** 2 // b + (a0 - b0) ** 2 // b0
                key = local[at][:, :, None] * width + local[at][:, None, :]
                np.add.at(sums, key.reshape(-1), part.reshape(-1))
        s, t = np.divmod(np.flatnonzero(sums), width)
        apart = s != t
        s, t = s[apart], t[apart]
        columns = [np.full(len(s), no), numbers[s], numbers[t]]
        return pa.RecordBatch.from_arrays([*(pa.array(c.astype(np.int32)) for c in columns), pa.array(sums[s * width + t])], ["lang_no", "s", "t", "both"])

    def added(rows: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        edges = np.flatnonzero(np.concatenate([[True], rows[0][1:] != rows[0][:-1], [True]]))
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
            yield of_language(int(rows[0][a]), [r[a:b] for r in rows[1:]])

    for batch in batches:
        rows = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(5)]
        if held is not None:
            rows = [np.concatenate(pair) for pair in zip(held, rows)]
        if not len(rows[0]):
            continue
        # the last term may go on in the next batch
        last = int(np.searchsorted(-((rows[1] == rows[1][-1]) & (rows[0] == rows[0][-1])).astype(np.int8)[::-1], 0, "left"))
        cut = len(rows[0]) - last
        held = [r[cut:] for r in rows]
        if cut:
            yield from added([r[:cut] for r in rows])
    if held is not None and len(held[0]):
        yield from added(held)


def audit(docs: DataFrame, work: Work, top: int = TOP) -> DataFrame:
    """lang, source, part (``pair`` or ``term``), item, value and rank."""
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    texts = docs.select(blank("lang").alias("lang"), blank("source").alias("source"), blank("text").alias("text"))
    groups = work.save(texts.select("lang", "source").distinct(), "sources")
    one = W.partitionBy("lang").orderBy("source")
    numbered = groups.withColumns({"lang_no": F.dense_rank().over(W.orderBy("lang")) - 1, "s": F.row_number().over(one) - 1})
    numbered = work.save(numbered.withColumn("group", F.col("lang_no").cast("long") * (1 << 32) + F.col("s")), "numbered")
    rows = texts.join(numbered.select("lang", "source", "lang_no", "group"), ["lang", "source"])
    counts = work.save(_counts(rows), "counts")
    held = work.save(_held(counts), "held")
    shards = _shards(held)
    jobs = [(no, shard, n) for no, n in sorted(shards.items()) for shard in range(n)]
    if not jobs:  # no language keeps a term: one vectorizer for each language
        jobs = [(r.lang_no, 0, 1) for r in numbered.select("lang_no").distinct().orderBy("lang_no").collect()]
    vocabulary = _vocabularies(held, jobs, work)
    sums = work.save(counts.join(vocabulary, ["lang_no", "item"]).select("group", "term", "n"), "sums")
    work.drop("counts", "held")
    kept = vocabulary.groupBy("lang_no").agg(F.count("*").alias("terms"))
    totals = sums.groupBy("group").agg(F.sum("n").alias("total"))
    groups = numbered.join(totals, "group", "left").join(kept, "lang_no", "left").fillna(0, ["total", "terms"])
    p0 = F.when(F.col("terms") > 0, share(F.lit(0).cast("long"), F.col("total"), F.greatest("terms", F.lit(1)))).otherwise(1)
    groups = work.save(groups.withColumn("p0", p0), "groups")
    whole = sums.groupBy("term").agg(F.sum("n").alias("n_all"))
    all_total = groups.groupBy("lang_no").agg(F.sum("total").alias("all_total"))
    counted = sums.join(groups, "group").withColumn("p", share(F.col("n"), F.col("total"), F.col("terms")))
    counted = work.save(counted.select("lang_no", "term", "source", "lang", "s", "n", "p", "p0", "terms"), "counted")

    # pairs
    side = lambda x: groups.select("lang_no", *(F.col(c).alias(f"{c}_{x}") for c in ("s", "source", "p0")))
    pair = groups.select("lang_no", "lang", "terms", F.col("s").alias("s_a"), F.col("source").alias("source_a"), F.col("p0").alias("p0_a"))
    pair = pair.join(side("b"), "lang_no").filter("s_a != s_b")
    equal = counted.groupBy("lang_no", "s", "p", "p0").agg(F.count("*").alias("k"))
    one = equal.select("lang_no", F.col("s").alias("s_a"), "p", F.col("p0").alias("p0_a"), "k").join(side("b"), "lang_no").filter("s_a != s_b")
    left = F.sum(F.col("k") * (gap(F.col("p"), F.col("p0_b")) - gap(F.col("p0_a"), F.col("p0_b")))).alias("left")
    right = F.sum(F.col("k") * (gap(F.col("p0_b"), F.col("p")) - gap(F.col("p0_b"), F.col("p0_a")))).alias("right")
    corrections = one.groupBy("lang_no", "s_a", "s_b").agg(left, right)
    forward = corrections.select("lang_no", "s_a", "s_b", "left")
    back = corrections.select("lang_no", F.col("s_a").alias("s_b"), F.col("s_b").alias("s_a"), "right")
    holders = counted.select("lang_no", "term", "s", "p", "p0")
    holders = holders.repartition("lang_no", "term").sortWithinPartitions("lang_no", "term")
    both = holders.mapInArrow(_both, "lang_no int, s int, t int, both long").groupBy("lang_no", "s", "t").agg(F.sum("both").alias("both"))
    both = both.withColumnsRenamed({"s": "s_a", "t": "s_b"})
    keys = ["lang_no", "s_a", "s_b"]
    joined = pair.join(forward, keys, "left").join(back, keys, "left").join(both, keys, "left").fillna(0, ["left", "right", "both"])
    value = F.col("terms") * gap(F.col("p0_a"), F.col("p0_b")) + F.col("left") + F.col("right") + F.col("both")
    pairs = joined.select("lang", F.col("source_a").alias("source"), F.lit("pair").alias("part"), F.col("source_b").alias("item"), value.alias("value"))

    # terms
    language = vocabulary.join(whole, "term").join(all_total, "lang_no").select("term", "item", "n_all", "all_total")
    q = share(F.col("n_all"), F.col("all_total"), F.col("terms"))
    far = counted.join(language, "term").withColumn("q", q).filter("p > q").withColumn("value", gap(F.col("p"), F.col("q")))
    terms = far.select("lang", "source", F.lit("term").alias("part"), "item", "value")
    rank = F.row_number().over(W.partitionBy("lang", "source", "part").orderBy(F.col("value").desc(), "item"))
    ranked_terms = terms.withColumn("rank", rank).filter(F.col("rank") <= top)
    return pairs.withColumn("rank", rank).unionByName(ranked_terms)
