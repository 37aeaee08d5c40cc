"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colscope.llm.common import cut


def _star(neighbours: DataFrame, large: bool) -> DataFrame:
    """Link every neighbour v of u to the least of u's neighbourhood; the large step only v above u."""
    # written out, so that the join reads it as it is and may split the rows of a node with very many neighbours
    least = cut(neighbours.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), F.least("u", "m").alias("m")))
    joined = neighbours.join(least, neighbours["u"] == least["c"])
    pairs = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    if not large:
        pairs = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select(F.col("c").alias("u"), F.col("m").alias("v")))
    return pairs.where(F.col("u") != F.col("v")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (u, v): root is the least node that links reach.

    Each step is an aggregation and a join on node; no node's neighbours are ever gathered in one row. Steps end when the
    edges form stars. Self links are allowed, and give a node that is its own root if it has no others.
    """
    nodes = edges.select(F.col("u").alias("node")).unionAll(edges.select(F.col("v").alias("node"))).distinct()
    now = cut(edges.select("u", "v").where(F.col("u") != F.col("v")).distinct())
    before = None
    while True:
        mark = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if mark == before:
            break
        before = mark
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct()
        wide = _star(both, large=True)
        down = wide.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        now = cut(_star(down, large=False))
    return nodes.join(now.select(F.col("u").alias("node"), F.col("v").alias("root")), "node", "left").select("node", F.coalesce("root", "node").alias("root"))
