"""Connected components of a distributed link table, by alternating large-star and small-star contraction.

Every step is an aggregation and an equi join; no links or components reach the driver, only two sums by which a
fixed point is recognised. Aggregates are stored before they are joined, so that the join is one of two plain exchanges,
which Spark can split where a node has very many links. Each round is written to the shared folder, so that a lost executor
costs one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage


def _large_star(links: DataFrame) -> DataFrame:
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = stage(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")), "least")
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = stage(down.groupBy("a").agg(F.min("b").alias("m")), "least")
    joined = down.join(least, "a")
    return (
        joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        .union(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
    )


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``links`` (a, b: long) to (node, root): the smallest node reachable, for each node that has a link."""
    links = stage(links.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b").distinct(), "links")
    before = None
    for _ in range(most_rounds):
        links = stage(_small_star(stage(_large_star(links), "large")), "links")
        now = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"no fixed point after {most_rounds} rounds")
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).union(links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
