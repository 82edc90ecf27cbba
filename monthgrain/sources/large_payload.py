"""One very large JSON payload read by many tasks.

A payload is one JSON object whose ``items`` array holds nearly all of it.  Spark's JSON source gives such a file to one task and all
its items to one row.  Here the text source splits the file by byte ranges and cuts it at every closing brace; what a
fragment means depends on whether it begins inside a string, and at which depth, so both are carried through a prefix scan:

1. every fragment is measured for both cases: its quotes, and the brackets that lie outside strings;
2. quotes and depths are added up along each byte range, then along the ranges of a file (one small row per range);
3. a brace outside strings that leads back to depth two ends an item; the fragments of an item are put together again and
   parsed, strictly.

What is left of the text without its items is the payload's frame; it is parsed as a whole, so a file that is cut short, or
whose other fields hold objects inside arrays or deeper, ends the job instead of giving wrong rows.  A byte range is bounded by
``spark.sql.files.maxPartitionBytes``, an item by itself; compressed files are read by one task each, with the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from monthgrain.session import durable
from monthgrain.sources.rent import ITEM_TYPE, RAW_PAYLOAD_TYPE

#: Brackets around an item: the payload's object and its array.
ITEM_DEPTH = 2
STRICT = {"mode": "FAILFAST"}


def _count(text: Column, kept: str) -> Column:
    """How many characters of ``text`` belong to the class ``kept``."""
    return F.length(F.regexp_replace(text, f"[^{kept}]", ""))


def _delta(clean: Column, quotes: Column, inside: int) -> Column:
    """Change of depth by a fragment and its closing brace, if it begins inside (1) or outside (0) a string."""
    bare = F.regexp_replace(F.concat(F.lit('"' * inside), clean), '"[^"]*("|$)', "")
    closed = F.when((quotes + inside) % 2 == 0, 1).otherwise(0)
    return _count(bare, r"\[{") - _count(bare, r"\]") - closed


def _fragments(spark: SparkSession, path: str) -> DataFrame:
    """Fragments in order (file, range, place), with what they change in either case."""
    meta = F.col("_metadata")
    raw = spark.read.option("lineSep", "}").text(path).select(
        "value",
        meta["file_path"].alias("file"),
        meta["file_name"].alias("source_snapshot"),
        meta["file_size"].alias("size"),
        meta["file_block_start"].alias("range"),
        F.monotonically_increasing_id().alias("place"),
    )
    clean = F.regexp_replace("value", r"(?s)\\.", "")  # no valid escape ends at a brace, so none spans two fragments
    raw = raw.withColumn("quotes", _count(clean, '"'))
    return raw.withColumns({f"delta_{s}": _delta(clean, F.col("quotes"), s) for s in (0, 1)})


def _along(rows: DataFrame) -> DataFrame:
    """Add to every fragment whether its closing brace ends an item."""
    here = W.partitionBy("file", "range").orderBy("place")
    earlier = here.rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("before", F.coalesce(F.sum("quotes").over(earlier), F.lit(0)) % 2)
    case = lambda start: F.when((F.col("before") + start) % 2 == 0, F.col("delta_0")).otherwise(F.col("delta_1"))
    totals = rows.groupBy("file", "range").agg(
        F.sum("quotes").alias("quotes"), F.sum(case(0)).alias("depth_0"), F.sum(case(1)).alias("depth_1")
    )
    ranges = W.partitionBy("file").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    totals = totals.withColumn("start", F.coalesce(F.sum("quotes").over(ranges), F.lit(0)) % 2)
    own = F.when(F.col("start") == 0, F.col("depth_0")).otherwise(F.col("depth_1"))
    totals = totals.withColumn("depth", F.coalesce(F.sum(own).over(ranges), F.lit(0)))
    rows = rows.join(totals.select("file", "range", "start", "depth"), ["file", "range"])
    rows = rows.withColumn("delta", case(F.col("start")))
    after = F.col("depth") + F.sum("delta").over(here.rowsBetween(W.unboundedPreceding, 0))
    outside = (F.col("start") + F.col("before") + F.col("quotes")) % 2 == 0
    return rows.withColumn("ends", F.when(outside & (after == ITEM_DEPTH), 1).otherwise(0))


def scan_large_payloads(spark: SparkSession, path: str, raw_items: bool = False) -> DataFrame:
    """Like ``rent.scan_payloads`` on files of one payload each, but one row per item: ``items`` holds that item alone.

    A payload without items has one row with its empty ``items``.
    """
    kept = ["file", "source_snapshot", "size", "range", "place", "value", "ends"]
    rows = durable(_along(_fragments(spark, path)).select(*kept), "fragments")
    here = W.partitionBy("file", "range").orderBy("place").rowsBetween(W.unboundedPreceding, -1)
    ranges = W.partitionBy("file").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    totals = rows.groupBy("file", "range").agg(F.sum("ends").alias("ends"))
    totals = totals.select("file", "range", F.coalesce(F.sum("ends").over(ranges), F.lit(0)).alias("offset"))
    numbered = rows.join(totals, ["file", "range"])
    numbered = numbered.withColumn("no", F.col("offset") + F.coalesce(F.sum("ends").over(here), F.lit(0)))
    parts = F.sort_array(F.collect_list(F.struct("range", "place", "value")))
    joined = numbered.groupBy("file", "source_snapshot", "no").agg(
        F.array_join(F.transform(parts, lambda p: p["value"]), "}").alias("text"),
        F.max("ends").alias("whole"),
        F.max("size").alias("size"),
    )
    # the file's last fragment has a brace after it only if the bytes say so
    length = rows.groupBy("file").agg(F.sum(F.octet_length("value") + 1).alias("bytes"))
    joined = joined.join(length, "file")
    closed = (F.col("whole") == 1) | (F.col("bytes") <= F.col("size"))
    joined = joined.withColumn("text", F.concat("text", F.when(closed, "}").otherwise("")))
    opening = r'(?s)^(.*?"items"\s*:\s*\[)\s*(\{.*)$'
    first = (F.col("no") == 0) & (F.col("whole") == 1)
    broken = F.raise_error(F.concat(F.lit("MALFORMED payload "), F.col("source_snapshot")))
    apart = (F.col("whole") == 1) & ~F.col("text").rlike(r"^\s*,\s*\{")
    later = F.when(apart, broken.cast("string")).otherwise(F.regexp_replace("text", r"^\s*,\s*", ""))
    item = F.when(first, F.regexp_extract("text", opening, 2)).otherwise(later)
    joined = joined.withColumns({"head": F.when(first, F.regexp_extract("text", opening, 1)), "item": item})
    joined = durable(joined.select("file", "source_snapshot", "no", "whole", "text", "head", "item"), "items")
    frames = joined.where("no = 0 or whole = 0").groupBy("file", "source_snapshot").agg(
        F.max("head").alias("head"), F.max(F.when(F.col("whole") == 0, F.col("text"))).alias("tail")
    )
    # a file that ends with its last item has no tail and cannot be parsed
    frame = F.from_json(F.concat(F.coalesce("head", F.lit("")), F.coalesce("tail", F.lit(""))), RAW_PAYLOAD_TYPE, STRICT)
    frames = frames.withColumn("frame", frame)
    out = frames.join(joined.where("whole = 1").select("file", "item"), "file", "left")
    if raw_items:
        value = F.when(F.try_parse_json("item").isNull(), broken.cast("string")).otherwise(F.col("item"))
    else:
        value = F.from_json("item", ITEM_TYPE, STRICT)
    kind = "array<string>" if raw_items else f"array<{ITEM_TYPE.simpleString()}>"
    none = F.when(F.col("frame.items").isNotNull(), F.array().cast(kind))
    whole = F.when(F.size("frame.items") > 0, broken.cast(kind))  # entries that are no objects
    return out.select(
        "frame.areaDefinition",
        "frame.periodCovered",
        F.when(F.col("item").isNotNull(), F.array(value)).otherwise(F.coalesce(whole, none)).alias("items"),
        "source_snapshot",
    )
