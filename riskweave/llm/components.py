"""Connected components of an edge table by hooking and pointer doubling; nothing but counts reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, staged


def components(edges: DataFrame) -> DataFrame:
    """node, root: for each node of edges (a, b), the smallest node that it is connected with.

    Each round, a node points to its smallest neighbour (or itself), pointers are doubled until they end in roots, and
    the edges are drawn between roots instead; edges within a tree go. The trees are written to the shared folder
    after each step, so a lost executor costs one step.
    """
    edges = staged(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter(F.col("a") != F.col("b")).distinct(), "edges")
    found = staged(edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct().select("node", F.col("node").alias("root")), "found")
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        last = up = staged(both.groupBy(F.col("a").alias("node")).agg(F.min(F.least("a", "b")).alias("up")), "pointers")
        while True:
            over = up.select(F.col("node").alias("n"), F.col("up").alias("over"))
            doubled = staged(up.join(over, up["up"] == over["n"]).select("node", F.col("over").alias("up"), (F.col("over") != F.col("up")).alias("moved")), "pointers")
            moved = not doubled.filter("moved").isEmpty()
            discard(last)
            last, up = doubled, doubled.select("node", "up")
            if not moved:
                break
        old = found, edges
        found = staged(found.join(up.select(F.col("node").alias("n"), "up"), F.col("root") == F.col("n"), "left").select("node", F.coalesce("up", "root").alias("root")), "found")
        to = lambda c: up.select(F.col("node").alias(f"{c}_node"), F.col("up").alias(f"{c}_up"))
        moved = edges.join(to("a"), F.col("a") == F.col("a_node")).join(to("b"), F.col("b") == F.col("b_node")).select("a_up", "b_up").filter(F.col("a_up") != F.col("b_up"))
        edges = staged(moved.select(F.least("a_up", "b_up").alias("a"), F.greatest("a_up", "b_up").alias("b")).distinct(), "edges")
        discard(last, *old)
    return found
