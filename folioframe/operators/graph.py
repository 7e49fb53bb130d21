"""Connected components as iterated aggregations, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import written


def stars(edges: DataFrame) -> DataFrame:
    """(node, centre): the least node of its component for every node with an edge (u, v) to another.

    In turn every node hands its larger neighbours, then its smaller ones, to the least of them.  Rounds grow with
    the logarithm of the longest path; each is written, which ends the lineage.
    """
    now, mark = written(edges.where("u > v").distinct(), "edges"), None
    while True:
        seen = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if seen == mark or not seen[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("centre"))
        mark = seen
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("least")).select("u", F.least("u", "least").alias("least"))
        large = written(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("least").alias("v")).distinct(), "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("least"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("least").alias("v")).where("u > v")
        now = written(small.unionByName(least.withColumnRenamed("least", "v")).distinct(), "small-star")


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, component): the least node of each node's component; ``edges`` (a, b) may go either way, repeat, or be loops."""
    placed = stars(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")))
    found = placed.withColumnRenamed("node", "at")
    return nodes.join(found, F.col("node") == F.col("at"), "left").select("node", F.coalesce("centre", "node").alias("component"))
