"""Connected components of links kept as a table."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved, skew_join


def local_components(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest node that each of the nodes 0..n-1 reaches over links a-b."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while True:
            jump = new[new]
            if (jump == new).all():
                break
            new = jump
        if (new == label).all():
            return label
        label = new


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for each node that is not its component's smallest, from links (a, b) of longs in any order.

    Alternating large-star and small-star rounds; each round ends in a table in the shared folder. Every link stays in the cluster; a node with very many links is summed by partial aggregation and joined with skew splitting. Null ends are left out.
    """
    edges = saved(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    for _ in range(most_rounds):
        if is_star(edges):
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = skew_join(both, low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = skew_join(large, low, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        edges = saved(small.where("a <> b").distinct(), "links")
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")


def is_star(edges: DataFrame) -> bool:
    """Has each node one link, to a node without one?"""
    ends = edges.select(F.col("a").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("b").alias("n"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    by_node = ends.groupBy("n").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return by_node.where("up > 1 OR up = 1 AND down = 1").isEmpty()
