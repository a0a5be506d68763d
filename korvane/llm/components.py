"""Connected components of a graph given as a table of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import discard, materialize


def connected_components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b): root is the smallest node of its component.

    Each round replaces the links by links to smaller nodes: first every node's larger neighbours are linked to its
    smallest neighbour, then its smaller ones. Links stay at most as many, rounds grow with the logarithm of the
    longest path, and every round is a written table. Self links are allowed; null ends are dropped.
    """
    now = links.where("a is not null and b is not null").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = materialize(now, "links")
    nodes_alone = now.where("a = b").select(F.col("a").alias("node"), F.col("b").alias("root"))
    now = now.where("a > b")
    state = None
    for _ in range(max_rounds):
        both = now.select("a", "b").unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        before, now = now, materialize(small, "links")
        if hasattr(before, "_korvane_path"):
            discard(before)
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == state:
            break
        state = seen
    else:
        raise RuntimeError(f"no end after {max_rounds} rounds")
    ends = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return ends.unionByName(ends.select(F.col("root").alias("node"), "root")).unionByName(nodes_alone).groupBy("node").agg(F.min("root").alias("root"))
