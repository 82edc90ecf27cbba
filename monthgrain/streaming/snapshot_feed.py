"""Load staging snapshots as they arrive.

The file source remembers which staging files were loaded; each micro-batch becomes one load. Its number is the
batch number counted from the checkpoint's first load, which is kept beside the checkpoint and begins after
every load that the table held then. A batch replayed after a failure replaces its own folder with the same
rows; a stream started over with a new checkpoint never touches the folders of an earlier one.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StringType, StructField, StructType

from monthgrain.sources.bond import NO_NULL_TOKEN
from monthgrain.sources.ledger import LoadedTable


def first_load(table: LoadedTable, checkpoint: str) -> int:
    """Load number of batch 0 of this checkpoint: the one written down, else one past the table's last."""
    spark, place = table.spark, f"{checkpoint.rstrip('/')}.first_load"
    try:
        return spark.read.schema("n bigint").json(place).first().n
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
    last = table.versions().agg(F.max("load_seq").alias("n")).first().n
    first = 0 if last is None else last + 1
    spark.createDataFrame([(first,)], "n bigint").coalesce(1).write.json(place)
    return first


def follow_staging(
    spark: SparkSession,
    staging_root: str,
    columns: Sequence[str],
    typed: Callable[[DataFrame], DataFrame],
    table: LoadedTable,
    checkpoint: str,
    files_per_load: int = 1,
) -> StreamingQuery:
    """Load every staging file not loaded yet, in arrival order, then stop (``availableNow``).

    One file per load keeps the rule that the later load wins. Raise ``files_per_load`` only where
    files of one load cannot share a key, such as the parts of a single snapshot.
    """
    schema = StructType([StructField(c, StringType()) for c in columns])
    arriving = (
        spark.readStream.schema(schema)
        .option("header", True)
        .option("nullValue", NO_NULL_TOKEN)
        .option("recursiveFileLookup", True)
        .option("maxFilesPerTrigger", files_per_load)
        .csv(staging_root)
    )
    first = first_load(table, checkpoint)
    return (
        arriving.writeStream.foreachBatch(lambda batch, number: table.append(typed(batch), first + number))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
