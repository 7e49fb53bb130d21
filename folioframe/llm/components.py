"""Connected components of a distributed edge list, by alternating large and small stars.

Every step is an aggregation with map-side combining and an equi-join on the node;
the join's key is the node's complement, so that both sides are exchanged for the join
itself and Spark can split the partition of a hub.  Each step ends in a table in the
shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _least_neighbour(edges: DataFrame) -> DataFrame:
    """(key, least): for each node ``u`` the least of it and its neighbours ``v``."""
    least = edges.groupBy("u").agg(F.min("v").alias("v"))
    return least.select(F.bitwise_not("u").alias("key"), F.least("u", "v").alias("least"))


def _joined(edges: DataFrame, least: DataFrame) -> DataFrame:
    return edges.withColumn("key", F.bitwise_not("u")).join(least, "key")


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node reachable, for every node of ``edges`` (long columns a, b).

    Edges may repeat, in either direction; loops count for nothing; rows with a null are left
    out.  No edges give no rows.
    """
    now = written(
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
        .distinct(),
        "edges",
    )
    mark = None
    while True:
        seen = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if seen == mark or not seen[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select("v", "v").distinct())
        mark = seen
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = written(
            _joined(both, _least_neighbour(both)).where("v > u").select(F.col("v").alias("u"), F.col("least").alias("v")).distinct(),
            "large-star",
        )
        small = _joined(large, _least_neighbour(large)).select(F.col("v").alias("u"), F.col("least").alias("v"))
        own = large.groupBy("u").agg(F.min("v").alias("v"))
        now = written(small.where("u <> v").unionByName(own).distinct(), "small-star")
