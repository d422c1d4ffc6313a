"""Connected components of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelake.llm.tables import Steps


def components(edges: DataFrame, steps: Steps, name: str) -> DataFrame:
    """node, component (its smallest node) for every node of an edge (a, b); nodes are 64-bit numbers.

    Each round connects the larger neighbours of every node, then the smaller ones, to the smallest it knows (two joins with per-node
    minima, which are combined before the shuffle). It ends when all edges point to the smallest node of their component, after a
    number of rounds of the order of the logarithm of the longest path. Edges stay no more than nodes; none reaches the driver.
    """
    tree = steps.write(f"{name}-0", edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    known, rounds = None, 0
    while True:
        both = tree.select("a", "b").union(tree.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").union(down.select("a", F.col("m").alias("b")))
        rounds += 1
        tree = steps.write(f"{name}-{rounds}", small.distinct())
        mark = tree.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        steps.drop(f"{name}-{rounds - 1}")
        if known == mark:
            break
        known = mark
    return tree.groupBy("a").agg(F.min("b").alias("component")).select(F.col("a").alias("node"), "component").union(
        tree.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
