"""Names that visitors give for videos: what is shown of them, beside answers and by itself, and how they are kept.

Names are a table (video_id, folded, name, count, db, first, last), one row a folded name of a video; ``db`` is what a
database knows of the name, or null. A name is shown once two people gave it or a database knows it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import text as T

# Fixed values, on which results depend.
TWO_GUESSES = r"(?iU)\s+or\s+|\s*/\s*|\s*,\s*"
L_FOR_I = r"(?U)\bl(?=[^aeiouyl\W]|l)"

BY = ["video_id", "folded"]


def spellings(name: Column) -> Column:
    """What to ask a database for: the name and each of two guesses typed at once, also with a capital I for an l that no
    vowel follows."""
    parts = F.transform(F.split(name, TWO_GUESSES), lambda p: F.regexp_replace(p, r"^[ ,-]+|[ ,-]+$", ""))
    every = F.concat(F.array(name), F.filter(parts, lambda p: (F.char_length(p) >= 2) & (p != name)))
    return F.array_distinct(F.flatten(F.transform(every, lambda p: F.array(p, F.regexp_replace(p, L_FOR_I, "I")))))


def is_shown() -> Column:
    return (F.col("count") >= 2) | ((F.col("count") >= 1) & F.col("db").isNotNull())


def with_names(answers: DataFrame, names: DataFrame, others: int = 3) -> DataFrame:
    """``answers`` (video_id, title, confidence, also_called, db_name), one row a video, with ``community``: how many people
    gave the answer's name, and ``others``: the most given of the other shown names. A video without an answer takes the
    most given shown name (``from_community``), surely if two people gave it and a database knows it."""
    entry = names.select("video_id", "folded", "name", "count", "db", "first")
    own = answers.select("video_id", F.explode(F.array_distinct(F.concat(F.array("title", "db_name"), F.coalesce("also_called", F.array().cast("array<string>"))))).alias("called"))
    called = own.where("called is not null").select("video_id", T.fold(F.col("called")).alias("folded"), F.lit(True).alias("known")).distinct()
    seen = entry.join(answers.select("video_id", F.col("title").isNotNull().alias("answered")), "video_id").join(called, BY, "left")
    usable = F.when(F.col("answered") & F.col("known").isNotNull(), True).otherwise(is_shown())
    best = W.partitionBy("video_id", "match").orderBy(F.desc("count"), "first", "folded")
    seen = seen.withColumn("match", F.col("answered") & F.col("known").isNotNull()).where(usable).withColumn("n", F.row_number().over(best))
    # the first of the names that mean the answer is its own; the rest of those count as others do
    head = F.when(F.col("answered"), F.col("match") & (F.col("n") == 1)).otherwise(F.col("n") == 1)
    seen = seen.withColumn("head", head).where(F.col("head") | is_shown())
    place = W.partitionBy("video_id", "head").orderBy(F.desc("count"), "first", "folded")
    few = seen.withColumn("m", F.row_number().over(place)).where(F.col("m") <= others)
    rest = F.array_sort(F.collect_list(F.when(~F.col("head"), F.struct("m", "name", "count"))))
    said = few.groupBy("video_id").agg(
        F.max(F.when(F.col("head"), F.col("count"))).alias("community"), F.max(F.when(F.col("head"), F.col("name"))).alias("given"),
        F.bool_or(F.col("head") & F.col("db").isNotNull()).alias("sure"), F.transform(rest, lambda x: F.struct(x["name"].alias("title"), x["count"].alias("count"))).alias("others"),
    )
    taken = F.col("title").isNull() & F.col("given").isNotNull()
    confidence = F.when(taken, F.when((F.col("community") >= 2) & F.col("sure"), "high").otherwise("medium")).otherwise(F.col("confidence"))
    out = answers.join(said, "video_id", "left").withColumns({"confidence": confidence, "from_community": taken, "title": F.coalesce("title", "given")})
    return out.withColumn("others", F.coalesce("others", F.array().cast("array<struct<title:string,count:bigint>>"))).drop("given", "sure")


def names_page(names: DataFrame, top: int = 300) -> DataFrame:
    """The newest names first, with whether others see them."""
    at = F.greatest(F.coalesce("last", "first"), F.col("first"))
    return names.select(at.alias("at"), "video_id", "name", "count", "db", is_shown().alias("shown")).orderBy(F.desc("at"), "video_id", "name").limit(top)


def rechecked(names: DataFrame, found: DataFrame) -> DataFrame:
    """``names`` after another look: those that no database knew and ``found`` (video_id, folded, better, db) does take the
    database's name, and add to the row of that name."""
    new = found.select(*BY, "better", F.col("db").alias("new_db"))
    both = names.join(new, BY, "left").withColumn("takes", F.col("db").isNull() & F.col("better").isNotNull())
    both = both.withColumns({"folded": F.when(F.col("takes"), T.fold(F.col("better"))).otherwise(F.col("folded")), "name": F.when(F.col("takes"), F.col("better")).otherwise(F.col("name")), "db": F.when(F.col("takes"), F.col("new_db")).otherwise(F.col("db"))})
    return both.groupBy(*BY).agg(
        F.min_by("name", F.struct("takes", "first", "name")).alias("name"), F.sum("count").alias("count"), F.min_by("db", F.struct(F.col("db").isNull(), "takes", "first")).alias("db"),
        F.min("first").alias("first"), F.max("last").alias("last"),
    )


def names_restarted(held: DataFrame, saved: DataFrame) -> DataFrame:
    """Two copies of the names after a restart: of each name the row with the larger count, the held one where equal."""
    both = held.withColumn("_old", F.lit(0)).unionByName(saved.withColumn("_old", F.lit(-1)))
    rest = [c for c in held.columns if c not in BY]
    return both.groupBy(*BY).agg(F.max_by(F.struct(*rest), F.struct("count", "_old")).alias("r")).select(*BY, "r.*").select(*held.columns)


def stats_page(counts: DataFrame, fields: list[str], days: int = 60) -> DataFrame:
    """Daily counters (day, field, n) as one row a day, newest first, under the sums of all days and of the last seven
    recorded ones."""
    by_day = counts.groupBy("day").pivot("field", fields).agg(F.sum("n"))
    by_day = by_day.select("day", *(F.coalesce(F.col(f"`{f}`"), F.lit(0)).cast("long").alias(f) for f in fields))
    sums = [F.coalesce(F.sum(f"`{f}`"), F.lit(0)).alias(f) for f in fields]
    last = by_day.orderBy(F.desc("day")).limit(7).agg(*sums).select(F.lit("Last 7 days").alias("day"), *fields, F.lit(1).alias("_part"))
    total = by_day.agg(*sums).select(F.lit("All time").alias("day"), *fields, F.lit(0).alias("_part"))
    newest = by_day.orderBy(F.desc("day")).limit(days).withColumn("_part", F.lit(2))
    return total.unionByName(last).unionByName(newest).orderBy("_part", F.desc("day")).drop("_part")


def current(spark: SparkSession, folder: str, schema) -> DataFrame:
    """The newest version of a table that ``write_behind`` keeps; empty before the first."""
    versions = _versions(spark, folder)
    return spark.read.schema(schema).parquet(f"{folder}/v={versions[-1]}") if versions else spark.createDataFrame([], schema)


def _versions(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the versions that were written to their end."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/v=*/_SUCCESS")
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path) or []
    return sorted(int(s.getPath().getParent().getName()[2:]) for s in found)


def write_behind(stream: DataFrame, folder: str, schema, merge: Callable[[DataFrame, DataFrame], DataFrame], every: str | None = "30 seconds") -> StreamingQuery:
    """Keeps a table up to date with a stream: ``merge(table, batch)`` is written once a batch, for a burst of rows at a time
    (without ``every``: for what is at hand). A batch that is tried again starts from the version before it, so that it
    counts once; the two newest versions stay."""

    def work(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = [v for v in _versions(spark, folder) if v < number]
        table = spark.read.schema(schema).parquet(f"{folder}/v={before[-1]}") if before else spark.createDataFrame([], schema)
        merge(table, batch).write.mode("overwrite").parquet(f"{folder}/v={number}")
        for v in before[:-1]:
            old = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/v={v}")
            old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)

    trigger = {"processingTime": every} if every else {"availableNow": True}
    return stream.writeStream.foreachBatch(work).option("checkpointLocation", f"{folder}/checkpoint").trigger(**trigger).start()
