"""Connected components by alternating large-star and small-star steps.

Each step is one aggregation over the edges; the number of steps grows with
the logarithm of the graph's longest shortest path. Hot nodes (a star with a
third of all rows) cost no more than their edges: the groups are reduced by
partial aggregation and joined back, never collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkmill.session import cut


def _least_neighbour(edges: DataFrame) -> DataFrame:
    """u, m: the smallest id among u and all its neighbours."""
    return edges.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))


def connected_components(edges: DataFrame, a: str, b: str, max_rounds: int = 40) -> DataFrame:
    """node, component: the smallest node id of the node's component, by Spark's order of the ids' type.

    edges holds one row per link in columns a and b. Rows with a null end give
    no link; the other end is still a node. Self-links and repeated rows are allowed. An empty table gives
    no rows. A graph that has not settled after max_rounds raises RuntimeError instead of returning a wrong result.
    """
    e = edges.select(F.col(a).alias("x"), F.col(b).alias("y"))
    nodes = e.select(F.explode(F.array("x", "y")).alias("node")).where("node IS NOT NULL").distinct()
    links = cut(e.where("x IS NOT NULL AND y IS NOT NULL AND x <> y").select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).distinct())
    before = None
    for _ in range(max_rounds):
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # large star: connect every larger neighbour to the least neighbour
        large = both.join(_least_neighbour(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: connect every smaller neighbour and the node itself to the least
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        links = cut(small)
        now = links.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components have not settled after {max_rounds} rounds")
    return nodes.join(links.select(F.col("u").alias("node"), F.col("v").alias("component")), "node", "left").select("node", F.coalesce("component", "node").alias("component"))
