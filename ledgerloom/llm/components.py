"""Connected components by alternating large-star and small-star steps, each a join on narrow rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .store import written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Large star: larger neighbours of u go to u's smallest neighbour. Small star: the others and u itself do."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges.select("u", "v")
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    joined = both.join(least, "u")
    if large:
        moved = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = joined.select(F.explode(F.array_distinct(F.array("u", "v"))).alias("u"), F.col("m").alias("v"))
    return moved.where(F.col("u") != F.col("v")).distinct()


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node in a link; component is its smallest reachable node.

    Links may repeat and point both ways; a link with a null end or of a node with itself says nothing. An empty
    table gives an empty one. Each round writes its edges to the shared folder, so a lost executor costs one round;
    only a count and a sum of each round reach the driver. The number of rounds grows with the logarithm of the
    longest chain, not with the size of a group.
    """
    edges = links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    edges = written(edges, "edges")
    seen = None
    while True:
        edges = written(_star(_star(edges, True), False), "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen or not now[0]:
            break
        seen = now
    roots = edges.select(F.col("v").alias("node")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))
