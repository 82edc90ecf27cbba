"""WARC archives: pages become transactions of records, and records become one nested row per capture again.

Writing: every page is a request, a response or revisit, and a metadata record; request and metadata name the main record in
``WARC-Concurrent-To``, a revisit names the response it repeats in ``WARC-Refers-To``.  Files are written by Spark's own text
writer (the record separator is its line separator), so they land wherever Spark can write, in gzip, at most
``RECORDS_PER_FILE`` records each; payloads are shuffled only if the table of repeated payloads is too large to broadcast.

Reading: files are streamed record by record by their ``Content-Length``.  ``assemble`` joins the records of a transaction
through their concurrent-to identifiers, in either direction and over one step between (metadata that names the request).

Defined results: null html is an empty payload; records with equal identifiers (repeated rows) stay as many captures; equal
payloads under ``MIN_REVISIT`` bytes are all responses; a null page_id never serves as, and never becomes, a revisit; rows
that tie on the smallest page_id of a payload are all responses; an empty table writes no records and reads none back; other
columns of the input are left out.
"""

from __future__ import annotations

import gzip
import hashlib
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, MapType, StringType, StructField, StructType

from monthgrain.llm.work import Work

MIN_REVISIT = 100
RECORDS_PER_FILE = 60_000
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Pages carry no capture time; WARC demands one.
CAPTURE_DATE = "1970-01-01T00:00:00Z"
CRLF = "\r\n"
RECORD_SCHEMA = StructType(
    [
        StructField("record_id", StringType()),
        StructField("record_type", StringType()),
        StructField("concurrent_to", ArrayType(StringType())),
        StructField("refers_to", StringType()),
        StructField("target_uri", StringType()),
        StructField("headers", MapType(StringType(), StringType())),
        StructField("payload_bytes", LongType()),
        StructField("payload_digest", StringType()),
        StructField("payload", BinaryType()),
    ]
)


def _uri() -> Column:
    return F.regexp_replace(F.coalesce("url", F.lit("")), r"[\x00-\x20\x7f]", "%20")


def first_copies(pages: DataFrame) -> DataFrame:
    """Digest, smallest page_id (of equal ones the smallest URI) of every payload that occurs again and may be revisited."""
    known = pages.filter("page_id is not null").select("page_id", _uri().alias("uri"), F.coalesce("html", F.lit("")).alias("p"))
    counted = known.filter(F.octet_length("p") >= MIN_REVISIT).groupBy(F.sha2("p", 256).alias("digest"))
    found = counted.agg(F.min(F.struct("page_id", "uri")).alias("first"), F.count("*").alias("n")).filter("n > 1")
    return found.select("digest", F.col("first.page_id").alias("first_id"), F.col("first.uri").alias("first_uri"))


def _urn(*parts: Column) -> Column:
    """A stable UUID, so that a retried task writes the same identifiers."""
    h = F.sha2(F.concat_ws("\n", *(F.coalesce(p.cast("string"), F.lit("?")) for p in parts)), 256)
    groups = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *groups), F.lit(">"))


def _record(kind: str | Column, record_id: Column, body: Column, *fields: tuple[str, Column]) -> Column:
    """Header lines (those with a value), an empty line, the block."""
    lines = [F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), kind if isinstance(kind, Column) else F.lit(kind))]
    lines += [F.concat(F.lit("WARC-Record-ID: "), record_id), F.lit(f"WARC-Date: {CAPTURE_DATE}")]
    lines += [F.concat(F.lit(f"{name}: "), value) for name, value in fields]  # null: concat_ws leaves the line out
    lines.append(F.concat(F.lit("Content-Length: "), F.octet_length(body).cast("string")))
    return F.concat(F.concat_ws(CRLF, *lines), F.lit(CRLF + CRLF), body)


def write_pages(pages: DataFrame, path: str, firsts: DataFrame, records_per_file: int = RECORDS_PER_FILE) -> None:
    """Three records per page; ``firsts`` from ``first_copies`` says which pages are revisits."""
    source = pages.select("page_id", _uri().alias("uri"), F.coalesce("html", F.lit("")).alias("html"))
    source = source.withColumn("digest", F.sha2("html", 256)).join(firsts, "digest", "left")
    revisit = F.coalesce(F.col("page_id") != F.col("first_id"), F.lit(False))
    main = _urn(F.lit("main"), F.col("page_id"), F.col("digest"), F.col("uri"))
    original = _urn(F.lit("main"), F.col("first_id"), F.col("digest"), F.col("first_uri"))
    named = source.withColumns({"revisit": revisit, "main_id": main, "original": F.when(revisit, original)})
    head = lambda length: F.concat(
        F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), length.cast("string"), F.lit(CRLF * 2)
    )
    http = head(F.octet_length("html"))
    block = F.when(F.col("revisit"), http).otherwise(F.concat(http, F.col("html")))
    uri_field = ("WARC-Target-URI", F.when(F.col("uri") != "", F.col("uri")))
    digest = ("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest")))
    to_main = ("WARC-Concurrent-To", F.col("main_id"))
    target = F.regexp_extract("uri", r"^[^/]*//[^/?#]*([^#]*)", 1)
    ask = F.concat(F.lit("GET "), F.when(F.startswith(target, F.lit("/")), target).otherwise(F.concat(F.lit("/"), target)))
    host = F.regexp_extract("uri", r"^[^/]*//([^/?#]*)", 1)
    request = _record(
        "request",
        _urn(F.lit("request"), F.col("main_id"), F.col("uri")),
        F.concat(ask, F.lit(f" HTTP/1.1{CRLF}Host: "), host, F.lit(CRLF * 2)),
        uri_field,
        to_main,
        ("Content-Type", F.lit("application/http; msgtype=request")),
    )
    answer = _record(
        F.when(F.col("revisit"), F.lit("revisit")).otherwise(F.lit("response")),
        F.col("main_id"),
        block,
        uri_field,
        digest,
        ("WARC-Refers-To", F.col("original")),
        ("WARC-Profile", F.when(F.col("revisit"), F.lit(REVISIT_PROFILE))),
        ("Content-Type", F.lit("application/http; msgtype=response")),
    )
    about = _record(
        "metadata",
        _urn(F.lit("metadata"), F.col("main_id"), F.col("uri")),
        F.concat(F.lit("page-id: "), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(CRLF)),
        uri_field,
        to_main,
        ("Content-Type", F.lit("application/warc-fields")),
    )
    lines = named.select(F.explode(F.array(request, answer, about)).alias("value"))
    out = lines.write.option("compression", "gzip").option("lineSep", CRLF * 2)
    out.option("maxRecordsPerFile", records_per_file).text(path)


def _parse(stream, with_payload: bool) -> Iterator[tuple]:
    while line := stream.readline():
        if not line.startswith(b"WARC/"):
            if line.strip():
                raise ValueError(f"not a WARC record: {line[:60]!r}")
            continue
        fields: dict[str, str] = {}
        concurrent = []
        while (line := stream.readline()).strip():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            name, value = name.strip().lower(), value.strip()
            if name == "warc-concurrent-to":
                concurrent.append(value)
            else:
                fields[name] = value
        block = stream.read(int(fields["content-length"]))
        kind = fields.get("warc-type")
        headers, payload = {}, block
        if kind in ("request", "response", "revisit") and fields.get("content-type", "").startswith("application/http"):
            head, _, payload = block.partition(b"\r\n\r\n")
            first, *rest = head.decode("utf-8", "replace").split("\r\n")
            headers = {"": first} | {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in rest)}
        elif fields.get("content-type") == "application/warc-fields":
            pairs = (x.partition(":") for x in block.decode("utf-8", "replace").split("\r\n") if x)
            headers, payload = {k.strip().lower(): v.strip() for k, _, v in pairs}, b""
        yield (
            fields.get("warc-record-id"),
            kind,
            concurrent,
            fields.get("warc-refers-to"),
            fields.get("warc-target-uri"),
            list(headers.items()),
            len(payload),
            hashlib.sha256(payload).hexdigest(),
            payload if with_payload else None,
        )


def _records(with_payload: bool, batch_bytes: int = 8 << 20):
    types = [pa.string(), pa.string(), pa.list_(pa.string()), pa.string(), pa.string(), pa.map_(pa.string(), pa.string())]
    types += [pa.int64(), pa.string(), pa.binary()]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = [pa.array(x, t) for x, t in zip(zip(*rows), types)]
        return pa.RecordBatch.from_arrays(columns, RECORD_SCHEMA.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for files in batches:
            for content in files.column(0):
                rows, held = [], 0
                with gzip.GzipFile(fileobj=io.BytesIO(content.as_buffer())) as raw, io.BufferedReader(raw, 1 << 18) as stream:
                    for row in _parse(stream, with_payload):
                        rows.append(row)
                        held += 300 + (row[6] if with_payload else 0)
                        if held > batch_bytes:
                            yield batch(rows)
                            rows, held = [], 0
                if rows:
                    yield batch(rows)

    return run


def read_records(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """Every record of the gzip archives under ``path``; payloads are hashed whole and kept on demand."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    return files.mapInArrow(_records(with_payload), RECORD_SCHEMA)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: main record id, response (or revisit, with what it repeats), request, metadata.

    Equal records (repeated captures) are counted first and given back as often at the end, so the joins stay one to one.
    """
    main = records.filter(F.col("record_type").isin("response", "revisit"))
    other = records.filter(F.col("record_type").isin("request", "metadata"))
    body = F.struct("record_id", "record_type", "target_uri", "headers", "payload_bytes", "payload_digest", "payload", "refers_to")
    mains = main.groupBy("record_id").agg(
        F.first(body).alias("response"), F.first("concurrent_to").alias("names"), F.count("*").alias("copies")
    )
    part = F.struct("record_id", "target_uri", "headers", "payload_bytes", "payload")
    parts = other.groupBy("record_id", "record_type").agg(F.first(part).alias("part"), F.first("concurrent_to").alias("names"))
    named = parts.select("record_id", "record_type", "part", F.explode("names").alias("main_id"))
    # a main record may name its parts, and metadata may name the request instead of the main record
    by_main = mains.select(F.explode("names").alias("record_id"), F.col("record_id").alias("main_id"))
    turned = parts.join(by_main, "record_id").select("record_id", "record_type", "part", "main_id")
    asked = named.unionByName(turned).filter("record_type = 'request'").join(mains.select(F.col("record_id").alias("main_id")), "main_id")
    request_main = asked.select(F.col("record_id").alias("main_id"), F.col("main_id").alias("of")).distinct()
    over = named.filter("record_type = 'metadata'").join(request_main, "main_id")
    links = named.unionByName(turned).unionByName(over.select("record_id", "record_type", "part", F.col("of").alias("main_id")))
    # of several requests or metadata records of one capture, the one with the smallest identifier
    pick = lambda kind: F.min_by(F.when(F.col("record_type") == kind, F.col("part")), F.when(F.col("record_type") == kind, F.col("record_id")))
    sides = links.groupBy("main_id").agg(pick("request").alias("request"), pick("metadata").alias("metadata"))
    joined = mains.join(sides, mains.record_id == sides.main_id, "left")
    nested = joined.select("record_id", "response", "request", "metadata", "copies")
    return nested.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).drop("copies", "copy")


def captures(pages: DataFrame, work: Work, with_payload: bool = True, records_per_file: int = RECORDS_PER_FILE) -> DataFrame:
    """Write ``pages`` as archives, read them back, assemble them and resolve revisits to the payload they repeat.

    Adds page_id, payload_bytes, payload_digest, record_type and refers_to to the nested columns.
    """
    firsts = work.save(first_copies(pages), "first_copies")
    write_pages(pages, work.path("warc"), firsts, records_per_file)
    # archives are parsed once, and records joined once: both tables are read by several branches
    records = work.save(read_records(pages.sparkSession, work.path("warc"), with_payload), "records")
    nested = work.save(assemble(records), "captures")
    page = F.expr("try_cast(metadata.headers['page-id'] as bigint)")
    flat = nested.withColumns({"page_id": page, "original_id": F.col("response.refers_to")})
    originals = flat.filter("response.record_type = 'response'").groupBy(F.col("record_id").alias("original_id")).agg(
        F.min("page_id").alias("original_page"),
        F.first("response.payload_bytes").alias("original_bytes"),
        F.first("response.payload_digest").alias("original_digest"),
    )
    # responses need no look-up: only revisits meet the originals, so their lack of a reference is no hot key
    revisits = flat.filter("response.record_type = 'revisit'").join(originals, "original_id", "left")
    plain = flat.filter("response.record_type = 'response'")
    seen = revisits.unionByName(plain, allowMissingColumns=True)
    return seen.select(
        "page_id",
        F.coalesce("original_bytes", "response.payload_bytes").alias("payload_bytes"),
        F.coalesce("original_digest", "response.payload_digest").alias("payload_digest"),
        F.col("response.record_type").alias("record_type"),
        F.when(F.col("response.record_type") == "revisit", F.col("original_page")).alias("refers_to"),
        "request",
        "response",
        "metadata",
    )
