"""Distributed connected components by alternating large-star and small-star steps.

Edges and labels stay in DataFrames; the driver sees two sums an iteration. A step links a
node's neighbours to its smallest neighbour, so that no task needs a node's whole
neighbourhood at once: the smallest neighbour is an aggregate with map-side combine, and
the join back is split by adaptive execution where a node is hot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import cut_and_release


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``(node, component)`` for every node of ``edges (a, b)``; the component is its smallest node.

    Nodes are of any orderable type. Null ends and loops add nothing but the node itself.
    """
    nodes = edges.select(F.explode(F.array("a", "b")).alias("node")).where("node is not null").distinct()
    links = cut_and_release(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    for _ in range(max_rounds):
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("low").alias("b")), F.struct("a", F.col("low").alias("b")))).alias("e")).select("e.a", "e.b").where("a <> b").distinct()
        links = cut_and_release(small)
        now = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components have not settled in {max_rounds} rounds")
    roots = links.groupBy("a").agg(F.min("b").alias("root"))
    return nodes.join(roots, nodes["node"] == roots["a"], "left").select("node", F.coalesce("root", "node").alias("component"))
