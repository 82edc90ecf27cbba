"""Training-data pipeline over ``documents``: rule ledger, near duplicates, repeated passages, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that the caller writes as Parquet and gives to the next stage.  All
but the last return the columns of ``docs``; ``n_chars``, where there is one, follows the text.  Null or empty texts fail the
rules and go; an empty table passes through every stage.

A stage's working tables are removed when the next stage begins, since its result is written by then.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from monthgrain.llm import minhash_dedup, packing, pii, quality_rules, suffix_dedup
from monthgrain.llm.work import Work

_open: list[Work] = []


def _work(spark: SparkSession, label: str) -> Work:
    while _open:
        _open.pop().close()
    _open.append(Work(spark, label))
    return _open[-1]


def _recount(docs: DataFrame) -> DataFrame:
    if "n_chars" not in docs.columns:
        return docs
    kind = docs.schema["n_chars"].dataType
    length = F.when(F.col("text").isNotNull(), F.char_length("text")).otherwise(F.col("n_chars"))
    return docs.withColumn("n_chars", length.cast(kind))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("text"))
    judged = quality_rules.apply_policy(quality_rules.ledger(rows))
    return judged.filter("kept").select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays (five words, similarity 0.8)."""
    return minhash_dedup.deduplicate(docs, _work(spark, "pipeline-near"), minhash_dedup.DEFAULT)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 200 bytes that occur again, in the same or another document, are cut out of every text."""
    return _recount(suffix_dedup.deduplicate(docs, _work(spark, "pipeline-passages")))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data are replaced by their kind."""
    return _recount(pii.redact(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining texts in full sequences."""
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality),
    ("minhash_near_dedup", near_duplicates),
    ("suffix_array_dedup", repeated_passages),
    ("pii", personal_data),
    ("packing", packed),
]
#: Near duplicates, suffix arrays, estimated reliabilities and token ids are beyond SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table; what each stage returns is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    results = Work(spark, "pipeline")
    for i, (name, stage) in enumerate(STAGES[:-1]):
        docs = results.save(stage(spark, docs, sf_dir), f"{i}-{name}")
        if i:
            results.drop(f"{i - 1}-{STAGES[i - 1][0]}")
    return STAGES[-1][1](spark, docs, sf_dir)
