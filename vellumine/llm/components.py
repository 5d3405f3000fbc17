"""Connected components of an edge table by alternating large-star and small-star steps."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """edges: a, b (any orderable type). node, root: root is the least node that node reaches.

    Nodes without an edge don't appear. A node's neighbours are never gathered: a minimum is aggregated
    per node and joined back, so a node of very many links is dealt out by the join.
    """
    edges = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    for _ in range(most_rounds):
        # Large star: each neighbour above a node hangs on to the least of the node's neighbourhood.
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        large = both.join(least, F.col("a") == F.col("u")).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # Small star: a node and its lower neighbours hang on to the least of them.
        least = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), "m")
        down = large.join(least, F.col("a") == F.col("u"))
        small = down.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
        before, edges = edges, written(small.where("a <> b").distinct(), "edges")
        discard(before)
        # At the fixed point the table is a set of stars: every node has one edge, and no root has one of its own.
        nodes, rows = edges.agg(F.count_distinct("a"), F.count(F.lit(1))).first()
        if nodes == rows and edges.join(edges.select(F.col("b").alias("root")), F.col("a") == F.col("root"), "left_semi").isEmpty():
            break
    else:
        raise RuntimeError(f"no fixed point after {most_rounds} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
