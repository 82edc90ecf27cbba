"""URL filter: a trie over reversed host labels and path segments, with longest-match precedence.

A rule is (host, path, verdict): it fits its host and every subdomain when the URL's path starts with the rule's.  Among the
fitting rules the one with the longest host and path wins; of two equal rules with different verdicts, block wins.

The trie is broadcast only while the rules number at most ``MAX_BROADCAST_RULES``, counted before; beyond that ``judge`` joins:
every URL offers its host suffixes and path prefixes that end where some rule of equal length may end, and Spark joins
those keys with the rules.  Both ways give the same rows.

Defined results: a null URL or one without ``://`` has an empty host and path and gets the default verdict; null ids,
repeated rows and extra columns do no harm (one row per input row: id, host, path, rule, verdict); an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StringType, StructField, StructType

MAX_BROADCAST_RULES = 100_000
RULE_SCHEMA = "rule_host string, rule_path string, rule_verdict string"
#: The contract's rules.
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)


def ascii_lower(value: Column) -> Column:
    return F.translate(value, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host and path as the contract defines them."""
    text = F.coalesce(url, F.lit(""))
    at = F.instr(text, "://")
    rest = F.when(at > 0, F.substring(text, at + 3, F.length(text))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    after = F.substring(rest, F.length(host) + 1, F.length(rest))
    return ascii_lower(host), F.regexp_extract(after, r"^[^?#]*", 0)


class Trie:
    """Nested dictionaries: reversed host labels, then a path trie of segments per host node.

    A path node keeps under ``""`` the last, possibly partial segments of rules: a URL segment fits if it starts with one.
    """

    def __init__(self, rules: list[tuple[str, str, str]]) -> None:
        self.root: dict = {}
        for host, path, verdict in sorted(rules, key=lambda r: r[2] == "block"):  # block last: it replaces an equal allow
            node = self.root
            for label in reversed(host.split(".")):
                node = node.setdefault("." + label, {})
            *whole, last = path.split("/")
            node = node.setdefault("paths", {})
            for segment in whole:
                node = node.setdefault("/" + segment, {})
            node.setdefault("", {})[last] = (host + path, verdict)

    @staticmethod
    def _deepest(node: dict, segments: list[str]) -> tuple[str, str] | None:
        best = None
        for i, segment in enumerate(segments):
            ends = node.get("")
            if ends:  # the rest of the path starts with a rule's last segment
                fits = [last for last in ends if segment.startswith(last)]
                if fits:
                    best = ends[max(fits, key=len)]
            node = node.get("/" + segment) if i < len(segments) - 1 else None
            if node is None:
                break
        return best

    def find(self, host: str, path: str) -> tuple[str, str] | None:
        segments, node, best = path.split("/"), self.root, None
        for label in reversed(host.split(".")):
            node = node.get("." + label)
            if node is None:
                break
            found = self._deepest(node["paths"], segments) if "paths" in node else None
            if found and (best is None or len(found[0]) >= len(best[0])):
                best = found
        return best


def _by_trie(shared, keep: list[str], default: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = shared.value
        for batch in batches:
            hosts = batch.column(batch.schema.get_field_index("host")).to_pylist()
            paths = batch.column(batch.schema.get_field_index("path")).to_pylist()
            found = [trie.find(h, p) or (None, default) for h, p in zip(hosts, paths)]
            columns = [batch.column(batch.schema.get_field_index(c)) for c in keep]
            columns += [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, [*keep, "rule", "verdict"])

    return run


def _by_join(urls: DataFrame, rules: DataFrame, default: str) -> DataFrame:
    """Exact for any number of rules: keys of the lengths that rules have, joined and reduced to the longest."""
    rules = rules.groupBy("rule_host", "rule_path").agg(F.max("rule_verdict").alias("rule_verdict"))  # block > allow
    # each host's own rules grow only with the rules of that host; a URL probes one key per host suffix
    labels = F.split("host", r"\.")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")
    )
    lengths = rules.groupBy("rule_host").agg(F.collect_set(F.length("rule_path")).alias("lengths"))
    probes = urls.select("row", "path", F.explode(suffixes).alias("rule_host")).join(lengths, "rule_host")
    probes = probes.select("row", "rule_host", F.col("path").alias("full"), F.explode("lengths").alias("n"))
    probes = probes.filter(F.length("full") >= F.col("n")).select(
        "row", "rule_host", F.substring("full", F.lit(1), F.col("n")).alias("rule_path")
    )
    hits = probes.join(rules, ["rule_host", "rule_path"])
    name = F.concat("rule_host", "rule_path")
    best = hits.groupBy("row").agg(
        F.max(F.struct(F.length(name).alias("n"), F.length("rule_host").alias("h"), name.alias("rule"), "rule_verdict")).alias("b")
    )
    return urls.join(best, "row", "left").withColumns(
        {"rule": F.col("b.rule"), "verdict": F.coalesce(F.col("b.rule_verdict"), F.lit(default))}
    )


def judge(
    pages: DataFrame,
    rules: DataFrame,
    key: str = "page_id",
    url: str = "url",
    default: str = "allow",
    max_broadcast: int = MAX_BROADCAST_RULES,
) -> DataFrame:
    """id, host, path, rule and verdict of every row of ``pages``."""
    host, path = url_parts(F.col(url))
    rules = rules.filter("rule_host is not null and rule_path is not null and rule_verdict is not null")
    bounded = rules.limit(max_broadcast + 1).collect()  # the size check: one row more than a broadcast may hold
    if len(bounded) <= max_broadcast:
        urls = pages.select(F.col(key).alias("id"), host.alias("host"), path.alias("path"))
        shared = pages.sparkSession.sparkContext.broadcast(Trie([tuple(r) for r in bounded]))
        texts = [StructField(c, StringType()) for c in ("rule", "verdict")]
        schema = StructType([*urls.schema.fields, *texts])
        out = urls.mapInArrow(_by_trie(shared, ["id", "host", "path"], default), schema)
    else:
        # equal URLs share their verdict, so the join runs once per distinct (host, path)
        urls = pages.select(F.col(key).alias("id"), host.alias("host"), path.alias("path"))
        distinct = urls.select("host", "path").distinct().withColumn("row", F.struct("host", "path"))
        judged = _by_join(distinct, rules, default).select("host", "path", "rule", "verdict")
        out = urls.join(judged, ["host", "path"]).select("id", "host", "path", "rule", "verdict")
    return out.withColumnRenamed("id", key)
