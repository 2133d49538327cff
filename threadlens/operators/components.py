"""Connected components of a distributed link table, by alternating large-star and small-star contraction.

Every step is an aggregation and an equi join; no links or components reach the driver, only two sums by which a fixed
point is recognised. Aggregates are stored before they are joined, so that the join is one of two plain exchanges, which
Spark can split where a node has very many links.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import settled


def components(links: DataFrame, store: Callable[[DataFrame], DataFrame] = settled, most_rounds: int = 60) -> DataFrame:
    """``links`` (a, b of any one ordered type) to (node, root): the smallest node reachable, for each node that has a link."""

    def large_star(links: DataFrame) -> DataFrame:
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = store(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")))
        return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()

    def small_star(links: DataFrame) -> DataFrame:
        down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = store(down.groupBy("a").agg(F.min("b").alias("m")))
        near = down.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        return near.union(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()

    links = store(links.select("a", "b").where("a <> b").distinct())
    before = None
    for _ in range(most_rounds):
        links = store(small_star(store(large_star(links))))
        now = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"no fixed point after {most_rounds} rounds")
    roots = links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)
