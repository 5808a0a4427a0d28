"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import remove, stored


def components(links: DataFrame) -> DataFrame:
    """links (a, b): undirected. Returns (node, root) for every node with a link; root is the smallest node.

    Each round replaces links by links to the smallest neighbour and is written to the shared folder; no node's
    neighbours are gathered, only their minimum; a node with very many is a skewed join, which Spark splits. The number
    of rounds grows with the logarithm of the nodes; they end when all links are stars.
    """
    edges, path = stored(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.hint("merge").join(low, "u").filter("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.hint("merge").join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").filter("u <> v").distinct()
        old, (edges, path) = path, stored(small, "edges")
        remove(links.sparkSession, old)
        # a star: every node is the end of one link, or the root of links
        ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("up")), F.struct(F.col("v").alias("node"), F.lit(0).alias("up")))).alias("e")).select("e.*")
        if ends.groupBy("node").agg(F.sum("up").alias("up"), F.min("up").alias("root")).filter("up > 1 or (up = 1 and root = 0)").isEmpty():
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
