"""A comment view over the star-schema tables, the same expression in Spark and in SQL, on which queries can be checked."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: As common table expressions: titled (orders with the part of their first line) and c (comments).
SQL = """
    titled AS (SELECT o.*, p.p_name AS title FROM orders o JOIN (SELECT l_orderkey, min(l_partkey) AS l_partkey FROM lineitem WHERE l_linenumber = 1 GROUP BY l_orderkey) l ON l.l_orderkey = o.o_orderkey JOIN part p ON p.p_partkey = l.l_partkey),
    c AS (SELECT o_custkey % 50 AS video_id, o_orderkey AS comment_id, o_custkey AS author, CAST(floor(o_totalprice) AS BIGINT) % 500 AS likes, title,
                 CASE o_orderkey % 6 WHEN 0 THEN 'movie name: ' || title || ' on Netflix' WHEN 1 THEN 'it''s called ' || title || '!' WHEN 2 THEN '"' || title || '" is peak'
                      WHEN 3 THEN 'La serie se llama ' || title WHEN 4 THEN 'what is the name of this?' ELSE 'first!!' END AS text FROM titled)"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def titled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with ``title``: the part of their first line."""
    first = table(spark, sf_dir, "lineitem").where("l_linenumber = 1").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min("l_partkey").alias("p_partkey"))
    part = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("title"))
    return table(spark, sf_dir, "orders").join(first, "o_orderkey").join(part, "p_partkey").drop("p_partkey")


def comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(video_id, comment_id, author, likes, title, text)."""
    t, kind = F.col("title"), F.col("o_orderkey") % 6
    text = (
        F.when(kind == 0, F.concat(F.lit("movie name: "), t, F.lit(" on Netflix"))).when(kind == 1, F.concat(F.lit("it's called "), t, F.lit("!")))
        .when(kind == 2, F.concat(F.lit('"'), t, F.lit('" is peak'))).when(kind == 3, F.concat(F.lit("La serie se llama "), t))
        .when(kind == 4, "what is the name of this?").otherwise("first!!")
    )
    return titled(spark, sf_dir).select((F.col("o_custkey") % 50).alias("video_id"), F.col("o_orderkey").alias("comment_id"), F.col("o_custkey").alias("author"), (F.floor("o_totalprice").cast("long") % 500).alias("likes"), "title", text.alias("text"))


def threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The view in the schema of comment files, for the library's operators."""
    c = comments(spark, sf_dir)
    s = lambda x: F.col(x).cast("string")
    return c.select(s("video_id").alias("video_id"), F.col("comment_id").alias("seq"), s("comment_id").alias("id"), s("author").alias("author"), "text", "likes")


def catalogue_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct part names as a catalogue, in alphabetical order."""
    names = table(spark, sf_dir, "part").groupBy(F.col("p_name").alias("canonical")).agg(F.min("p_partkey").cast("int").alias("prio"), F.min("p_type").alias("kind"))
    return names.select("prio", "canonical", "kind", F.array().cast("array<string>").alias("aliases"), F.lit(None).cast("int").alias("year"))
