"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import Steps


def components(edges: DataFrame, steps: Steps, name: str) -> DataFrame:
    """node, component (the least node of its component) for every node of edges (a, b).

    Large and small stars by turns: each node hands its neighbours to its least one, until every node hangs on the
    least node of its component. Rounds grow with the logarithm of the longest path. All work is grouping and joining;
    minima are taken before the shuffle, so a node with many neighbours costs one row per task.
    """
    low, high = F.least("a", "b").alias("b"), F.greatest("a", "b").alias("a")
    current = steps.table(edges.where("a != b").select(high, low).distinct(), f"{name}-0")
    seen, turn = None, 0
    while True:
        state = current.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("sum")).first()
        if state == seen or not state["n"]:
            return current.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
                current.select("b", "b").distinct()).distinct()
        seen = state
        both = current.select("a", "b").union(current.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        large = steps.table(large, f"{name}-large-{turn}")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", "m")).distinct()
        turn += 1
        old, current = current, steps.table(small, f"{name}-{turn}")
        steps.drop(f"{name}-{turn - 1}", f"{name}-large-{turn - 1}")
