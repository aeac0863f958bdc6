"""Connected components by alternating star operations, wholly in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

#: Rows that one task writes of a round's tables at least, if there are as many.
TASK_ROWS = 100_000


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) for every node of edges(a, b); component is the smallest node it can reach.

    Each round points every larger neighbour of a node, then every smaller one, at the smallest
    neighbour. Minima are aggregated before they are shuffled, so a hub costs one row a task; the join
    back is on the node, where adaptive execution can split a hub's edges. Rounds grow with the
    logarithm of a component's size. Self-loops and repeated edges are ignored; no edges, no rows.
    A round's tables are written by as many tasks as the edges ask for, however many partitions a shuffle
    has: each task has pages and files of its own, which cost more than few rows do.
    """
    now = scratch.table(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen = None
    while True:
        n, total = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if n == 0 or (n, total) == seen:
            break
        seen, tasks = (n, total), -(-n // TASK_ROWS)
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = scratch.table(large.coalesce(tasks), "large")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        after = scratch.table(small.coalesce(tasks), "small")
        scratch.drop(now, large)
        now = after
    leaves = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return leaves.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
