"""Connected components of a table of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from monthgrain.llm.work import Work

MAX_ROUNDS = 60


def components(links: DataFrame, work: Work, name: str = "components") -> DataFrame:
    """(node, label) for every linked node; the label is the smallest node of its component.

    ``links`` has columns a and b; repeated, reversed and self links do no harm, links with null are left out.  Every round is
    a partial minimum per node and a join with it, so a node with very many links is never gathered in one place; rounds are
    written to the shared folder, which keeps the lineage one round deep.
    """
    ordered = F.least("a", "b"), F.greatest("a", "b")
    edges = links.filter("a is not null and b is not null and a != b")
    edges = work.save(edges.select(ordered[1].alias("u"), ordered[0].alias("v")).distinct(), f"{name}-0")
    before = None
    for i in range(1, MAX_ROUNDS):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        larger = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        larger = larger.filter("u != v").distinct()
        down = larger.groupBy("u").agg(F.min("v").alias("m"))
        smaller = larger.join(down, "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("x"))
        smaller = smaller.select(F.col("x.v").alias("u"), F.col("x.m").alias("v")).filter("u != v").distinct()
        edges = work.save(smaller, f"{name}-{i}")
        work.drop(f"{name}-{i - 1}")
        after = tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
        if after == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("label"))
        before = after
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
