"""Readers: comment files, catalogues, video metadata, title-database payloads, sweep results.

Each has an explicit schema. A comment file is an array whose elements are texts or objects; missing ids and authors are
``c<i>`` and ``user<i>``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import seed

CATALOGUE = "prio int, canonical string, kind string, aliases array<string>, year int"
COMMENTS = "video_id string, seq long, id string, author string, text string, likes long"
SWEEP = (
    "vid string, query string, title string, asked long, views long, n_comments long, langs map<string, long>, "
    "answers array<struct<title: string, conf: string, sources: array<string>, commenters: long, likes: long, alternates: array<struct<name: string, kind: string>>>>"
)
ANILIST = "array<struct<id: string, type: string, format: string, countryOfOrigin: string, title: struct<english: string, romaji: string, native: string>, synonyms: array<string>, startDate: struct<year: int>, popularity: long, siteUrl: string>>"
MANGADEX = "array<struct<id: string, title: map<string, string>, altTitles: array<map<string, string>>, lang: string, year: int>>"
WIKIPEDIA = "array<struct<title: string, index: int, description: string, disambiguation: boolean, redirects: array<string>>>"
ENTITY = "source string, id string, name string, names array<string>, kind string, country string, year int, url string, spanish boolean, rank int, searched boolean, popularity long"


def comments(spark: SparkSession, path: str) -> DataFrame:
    """Comment files under ``path`` (one video a file, named after it)."""
    raw = spark.read.text(path, wholetext=True).withColumn("video_id", F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.json)?$", 1))
    each = raw.select("video_id", F.posexplode(F.from_json("value", "array<string>")).alias("seq", "item"))
    return comment_rows(each)


def comment_rows(each: DataFrame) -> DataFrame:
    """(video_id, seq, item: JSON of an element) as comments."""
    o = F.from_json("item", "id string, author string, text string, likes long")
    is_object = F.col("item").startswith("{")
    n = F.col("seq").cast("string")
    return each.select(
        "video_id", F.col("seq").cast("long"), F.coalesce(F.when(is_object, o["id"]), F.concat(F.lit("c"), n)).alias("id"),
        F.coalesce(F.when(is_object, o["author"]), F.concat(F.lit("user"), n)).alias("author"),
        F.when(is_object, F.coalesce(o["text"], F.lit(""))).otherwise(F.col("item")).alias("text"), F.coalesce(F.when(is_object, o["likes"]), F.lit(0)).alias("likes"),
    )


def thread_rows(pages: DataFrame) -> DataFrame:
    """Pages of an API's comment threads (video_id, page, item: array of (id, author, text, likes, replies)) as comments
    in order: each top comment, then its replies."""
    thread = pages.select("video_id", "page", F.posexplode("item").alias("at", "t"))
    top = F.struct(*(F.col("t")[c].alias(c) for c in ("id", "author", "text", "likes")))
    flat = thread.select("video_id", "page", "at", F.posexplode(F.concat(F.array(top), F.coalesce(F.col("t")["replies"], F.array().cast("array<struct<id:string,author:string,text:string,likes:bigint>>")))).alias("reply", "c"))
    seq = F.col("page").cast("long") * 1_000_000_000 + F.col("at") * 100_000 + F.col("reply")
    return flat.select("video_id", seq.alias("seq"), "c.id", "c.author", "c.text", F.coalesce("c.likes", F.lit(0)).alias("likes"))


def limited(comments: DataFrame, limit: int, page_size: int = 100) -> DataFrame:
    """Whole pages of at most ``page_size`` until ``limit`` comments are reached, by each comment's ``page`` number."""
    pages = comments.groupBy("video_id", "page").agg(F.count("*").alias("n"))
    from pyspark.sql import Window as W

    before = F.coalesce(F.sum("n").over(W.partitionBy("video_id").orderBy("page").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return comments.join(pages.withColumn("before", before).where(F.col("before") < limit).select("video_id", "page"), ["video_id", "page"])


def catalogue(spark: SparkSession, path: str | None = None, after: DataFrame | None = None) -> DataFrame:
    """The built-in catalogue, or a JSON one; rows of ``after`` come first."""
    if path is None:
        own = spark.createDataFrame(seed.rows(), CATALOGUE)
    else:
        fields = "array<struct<canonical: string, kind: string, aliases: array<string>, year: int>>"
        rows = spark.read.text(path, wholetext=True).select(F.posexplode(F.from_json("value", fields, {"mode": "FAILFAST"})).alias("prio", "t"))
        own = rows.select("prio", "t.canonical", "t.kind", F.coalesce("t.aliases", F.array().cast("array<string>")).alias("aliases"), "t.year")
    if after is None:
        return own
    shift = F.col("prio") + (after.agg(F.max("prio")).first()[0] or 0) + 1
    return after.unionByName(own.withColumn("prio", shift.cast("int")))


def video_meta(payload: DataFrame) -> DataFrame:
    """API payloads (video_id, payload: JSON) as id, title, channel, description, tags, comment_count; a video that the
    API does not have has no row."""
    schema = "items array<struct<snippet: struct<title: string, channelTitle: string, description: string, tags: array<string>>, statistics: struct<commentCount: string>>>"
    item = F.get(F.from_json("payload", schema)["items"], F.lit(0))
    snippet = item["snippet"]
    return payload.where(item.isNotNull()).select(
        F.col("video_id").alias("id"), F.coalesce(snippet["title"], F.lit("")).alias("title"), F.coalesce(snippet["channelTitle"], F.lit("")).alias("channel"),
        F.coalesce(snippet["description"], F.lit("")).alias("description"), F.coalesce(snippet["tags"], F.array().cast("array<string>")).alias("tags"),
        F.coalesce(item["statistics"]["commentCount"].cast("int"), F.lit(0)).alias("comment_count"),
    )


def sweep(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SWEEP).json(path, multiLine=True)


def error_text(code: Column) -> Column:
    """What to tell a person about an API's error."""
    known = {"commentsDisabled": "comments are off for this video", "videoNotFound": "no such video", "quotaExceeded": "the day's quota is used up"}
    out = F.lit("the video could not be read")
    for k, v in known.items():
        out = F.when(code == k, v).otherwise(out)
    return out
