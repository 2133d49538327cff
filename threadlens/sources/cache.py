"""The title-database cache as a table: (source, key, payload), one Parquet folder partitioned by source.

A cached empty answer is a row with an empty payload; a failed request is no row, and so is asked again.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "key string, payload string, source string"


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path)


def from_json(spark: SparkSession, path: str, source: str) -> DataFrame:
    """A JSON object of answers by key."""
    raw = spark.read.text(path, wholetext=True)
    return raw.select(F.explode(F.from_json("value", "map<string, string>")).alias("key", "payload")).withColumn("source", F.lit(source))


def missing(wanted: DataFrame, cache: DataFrame) -> DataFrame:
    """Rows of ``wanted`` (source, key) that the cache has no answer for, once each."""
    return wanted.select("source", "key").distinct().join(cache.select("source", "key"), ["source", "key"], "left_anti")


def merged(cache: DataFrame, new: DataFrame) -> DataFrame:
    """``cache`` with ``new`` rows, which replace those of equal key."""
    return cache.join(new.select("source", "key"), ["source", "key"], "left_anti").select("source", "key", "payload").unionByName(new.select("source", "key", "payload"))


def save(table: DataFrame, path: str) -> str:
    """Write a new version beside the old ones; returns its folder, which replaces the old when the caller takes it up."""
    folder = f"{path}/version={uuid.uuid4().hex}"
    table.write.partitionBy("source").parquet(folder)
    return folder


def batches(keys: DataFrame, size: int = 50) -> DataFrame:
    """``keys`` (source, key) with a batch id, at most ``size`` keys each. Hash buckets are numbered within, so no
    source's keys meet in one task."""
    from pyspark.sql import Window as W

    buckets = F.pmod(F.xxhash64("key"), F.lit(200))
    w = W.partitionBy("source", "bucket").orderBy("key")
    numbered = keys.withColumn("bucket", buckets).withColumn("n", F.floor((F.row_number().over(w) - 1) / size))
    return numbered.withColumn("batch", F.concat_ws("-", "source", "bucket", "n")).drop("bucket", "n")
