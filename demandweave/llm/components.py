"""Connected components of an edge table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandweave.session import stored


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node with an edge; the component is its smallest node.

    ``edges`` has long columns a and b. Each round replaces a node's edges by edges to its smallest
    neighbour; a node's smallest neighbour is found before the shuffle as far as a task sees it, and a hub
    only meets its edges in joins that adaptive execution may split. Rounds grow with the logarithm of the
    longest path. No edges give no rows.
    """
    now = stored(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    before = None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == before:
            break
        before = mark
        # large star: every neighbour above a node goes to the least of the node and its neighbours
        all_ways = _both(now)
        least = all_ways.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = all_ways.filter("b > a").join(least, "a").select(F.col("m").alias("a"), "b").filter("a <> b").distinct()
        # small star: a node and its neighbours below it go to the least of these
        large = stored(large, "edges")
        low = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(low, "b").select(F.col("m"), "a").filter("m <> a").select(F.col("m").alias("a"), F.col("a").alias("b"))
        now = stored(small.unionByName(low.select(F.col("m").alias("a"), "b")).distinct(), "edges")
    found = now.groupBy("b").agg(F.min("a").alias("component")).withColumnRenamed("b", "node")
    return found.unionByName(now.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
