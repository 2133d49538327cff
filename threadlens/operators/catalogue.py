"""A catalogue's index tables: aliases, acronyms, alias trigrams, and names without their spaces."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T


@dataclass
class Catalogue:
    """titles (canonical, kind, year, aliases), alias (key, canonical), acronym (key, canonical; unique ones only),
    trigram (tri, key), glued (glued, key); and the words of the longest alias."""

    titles: DataFrame
    alias: DataFrame
    acronym: DataFrame
    trigram: DataFrame
    glued: DataFrame
    longest: int


def _first(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(W.partitionBy(key).orderBy(*order))).where("_n = 1").drop("_n")


def index(rows: DataFrame) -> Catalogue:
    """Tables over ``rows`` (prio, canonical, kind, aliases, year): the last row of a name holds, the first of an alias."""
    titles = rows.withColumn("_n", F.row_number().over(W.partitionBy("canonical").orderBy(F.desc("prio")))).where("_n = 1").drop("_n")
    names = rows.select("prio", "canonical", F.posexplode(F.array_prepend("aliases", F.col("canonical"))).alias("at", "name")).withColumn("key", T.fold(F.col("name"))).where("key <> ''")
    alias = _first(names, "key", ["prio", "at"]).select("key", "canonical", "prio", "at").cache()  # every other table and pass reads it
    acronyms = rows.select("canonical", T.acronym(T.fold(F.col("canonical"))).alias("key")).where("char_length(key) >= 2").distinct()
    unique = acronyms.groupBy("key").agg(F.count("*").alias("n"), F.min("canonical").alias("canonical")).where("n = 1").drop("n")
    trigram = alias.select(F.explode(T.trigrams(F.col("key"))).alias("tri"), "key")
    glued = alias.where("instr(key, ' ') > 0").withColumn("glued", F.replace("key", F.lit(" "), F.lit(""))).where("char_length(glued) >= 6")
    longest = alias.agg(F.max(F.size(F.split("key", " ")))).first()[0] or 1
    return Catalogue(titles.drop("prio"), alias.select("key", "canonical"), unique, trigram, _first(glued, "glued", ["prio", "at"]).select("glued", "key"), longest)


def kind_and_year(df: DataFrame, cat: Catalogue) -> DataFrame:
    """``df`` (canonical, ...) with kind ("unknown" if absent) and year."""
    return df.join(cat.titles.select("canonical", "kind", "year"), "canonical", "left").withColumn("kind", F.coalesce("kind", F.lit("unknown")))
