"""Connected components of a graph that no one machine holds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cluster import dropped, placed


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node reachable from each node that has an edge, by its order as a long.

    Alternating large-star and small-star steps (Kiveris et al. 2014): each round
    moves every node's neighbours to the smallest of them, until every node has
    one edge and it leads to a root. The number of rounds grows with the logarithm of the longest path.
    Minima are aggregates, summed before the shuffle; a hub's neighbours meet its
    minimum in a sort-merge join, whose hot keys Spark splits. Each round's edges
    are written, so a lost executor costs no earlier round, and those of the
    round before are then deleted.

    ``edges`` has columns a and b, in any direction and any number of times;
    loops and nulls are passed over.
    """
    current, path = placed(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where(F.col("a") != F.col("b")).distinct(), "edges")
    for _ in range(most_rounds):
        if not current.groupBy("a").agg(F.count("*").alias("n")).where(F.col("n") > 1).take(1) and not current.join(current.select(F.col("a").alias("b")), "b", "left_semi").take(1):
            return current.select(F.col("a").alias("node"), F.col("b").alias("root"))
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large, star = placed(large.where(F.col("a") != F.col("b")).distinct(), "large-star")
        root = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(root, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(root.select("a", F.col("m").alias("b")))
        before = path
        current, path = placed(small.where(F.col("a") != F.col("b")).distinct(), "small-star")
        for gone in (before, star):
            dropped(edges.sparkSession, gone)
    raise RuntimeError(f"no end after {most_rounds} rounds")
