"""Connected components of an edge table by alternating large-star and small-star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_tables, stored


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges: u, v. Each node's neighbours are tied to the least of it and them: all larger ones (large), or all smaller ones and itself."""
    if large:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    if large:
        out = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = both.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.filter("u <> v").distinct()


def connected_components(edges: DataFrame, most_rounds: int = 60) -> tuple[DataFrame, str]:
    """node, component (the least node reachable) of every node with an edge u-v between different nodes; and the path of the table that holds it.

    Each round halves paths at least and ends in a written table, so a lost executor costs one round. A hub's neighbours are spread by a join
    that adaptive execution can split, and its minimum is pre-aggregated; no group meets in one task.
    """
    now, path = stored(edges.select("u", "v").filter("u <> v").distinct(), "edges")
    for _ in range(most_rounds):
        new, new_path = stored(_star(_star(now, True), False), "edges")
        # a star's edges go from each node to the least of its component: done when no node is on both sides, or has two centres
        state = new.groupBy("u").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").limit(1).count()
        done = state == 0 and new.join(new.select(F.col("v").alias("u")).distinct(), "u", "left_semi").limit(1).count() == 0
        drop_tables(now.sparkSession, [path])
        now, path = new, new_path
        if done:
            nodes = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
            return nodes.union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()), path
    raise RuntimeError("components did not settle")
