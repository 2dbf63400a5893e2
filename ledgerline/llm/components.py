"""Connected components of a graph given as pairs, by alternating large and small stars.

Each round replaces the edges by fewer, shorter ones, using aggregations by node (map-side combined) and
equi-joins; no node's neighbours are ever collected. The number of rounds grows with the logarithm of the
longest path. Edges are written to the shared folder after each round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import written


BROADCAST_BYTES = 16 * 1024 * 1024
NODE_BYTES = 48


def connected_components(pairs: DataFrame) -> DataFrame:
    """(node, component) of all nodes in pairs (a, b); a component is named by its least node."""
    edges = (pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct())
    edges = written(edges, "edges")
    size, mark = edges.count(), None

    def side(least: DataFrame) -> DataFrame:
        # a row for each node, so at most two for each edge
        return F.broadcast(least) if 2 * size * NODE_BYTES <= BROADCAST_BYTES else least

    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # large star: greater neighbours to the least of a node and its neighbours
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = (both.join(side(least), "u").filter(F.col("v") > F.col("u"))
                 .select(F.col("v").alias("u"), F.col("m").alias("v")))
        # small star: smaller neighbours and the node itself to the least neighbour
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(side(least), "u").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
                 .unionByName(least.select("u", F.col("m").alias("v"))).filter("u > v").distinct())
        edges = written(small, "edges")
        row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if (row["n"], row["s"]) == (size, mark):
            break
        size, mark = row["n"], row["s"]
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
