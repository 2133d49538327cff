"""Mentions to a ranked list of titles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def histogram(df: DataFrame, by: list[str], key: str, name: str, n: Column | None = None) -> DataFrame:
    """(by, name: map of ``key`` to its count, or the sum of ``n``), in two steps of partial aggregation."""
    each = df.groupBy(*by, key).agg((F.sum(n) if n is not None else F.count("*")).alias("_n"))
    return each.groupBy(*by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(key, "_n")))).alias(name))


def rank(mentions: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(canonical, kind, commenters, mentions, confidence, methods, example_comment, example_author, variants) for each
    title (of each of ``by``): distinct authors, or mentions where no author is known; the shortest example of at least 25
    characters; up to six spellings."""
    keys = [*by, "canonical"]
    length = F.char_length("text")
    shortest = F.struct(length < 25, length, F.col("seq"))
    spelling = F.nullif(F.trim("raw"), F.lit(""))
    base = mentions.groupBy(*keys).agg(
        F.first("kind").alias("kind"), F.count_distinct(F.nullif("author", F.lit(""))).alias("authors"), F.count("*").alias("mentions"),
        F.round(F.avg("score"), 1).alias("confidence"), F.min_by(F.struct("text", "author"), shortest).alias("example"), F.collect_set(F.struct(F.lower(spelling).alias("low"), spelling.alias("raw"))).alias("spellings"),
    )
    named = base.join(histogram(mentions, keys, "method", "methods"), keys)
    return named.select(
        *keys, "kind", F.when(F.col("authors") > 0, F.col("authors")).otherwise(F.col("mentions")).alias("commenters"), "mentions", "confidence", "methods",
        F.col("example.text").alias("example_comment"), F.col("example.author").alias("example_author"),
        F.slice(F.transform(F.array_sort(F.filter("spellings", lambda s: s["raw"].isNotNull())), lambda s: s["raw"]), 1, 6).alias("variants"),
    )


def ordered(ranked: DataFrame, top: int | None = None) -> DataFrame:
    out = ranked.orderBy(F.desc("commenters"), F.desc("mentions"), "canonical")
    return out.limit(top) if top else out
