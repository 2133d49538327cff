"""Titles in a video's own metadata: the title bar, hashtags split back into words, tags, and the description."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from ..functions import lexicon as L
from ..functions import patterns as P
from ..functions import text as T
from .catalogue import Catalogue

LONGEST_WORD = 16


def best_split(glued: str, zipf: dict[str, float]) -> list[str]:
    """The split into words of the greatest summed score: log10(zipf / 10), or -6 - 0.6 a letter if unknown. Of equal sums
    the one whose last word is longest wins."""
    value, back = [0.0], [0]
    for end in range(1, len(glued) + 1):
        options = []
        for start in range(max(0, end - LONGEST_WORD), end):
            z = zipf.get(glued[start:end], 0.0)
            options.append((value[start] + (math.log10(z / 10) if z > 0 else -6.0 - 0.6 * (end - start)), -start))
        top = max(options)
        value.append(top[0])
        back.append(-top[1])
    out, at = [], len(glued)
    while at:
        out.append(glued[back[at] : at])
        at = back[at]
    return out[::-1]


def segment(tags: DataFrame, cat: Catalogue, freq: DataFrame) -> DataFrame:
    """(tag, words, known) of distinct lower-case hashtags: as the catalogue spells them, else split by word frequency. Each
    tag's substrings meet the frequency table in an equi join, so a table of any size is used whole."""
    tags = tags.select("tag").distinct()
    known = tags.join(cat.glued.withColumnRenamed("glued", "tag"), "tag").select("tag", F.split("key", " ").alias("words"), F.lit(True).alias("known"))
    rest = tags.join(cat.glued.withColumnRenamed("glued", "tag"), "tag", "left_anti")
    size = F.char_length("tag")
    begins = rest.where(size > 0).select("tag", F.explode(F.sequence(F.lit(1), size)).alias("i"))
    lengths = F.sequence(F.lit(1), F.least(F.lit(LONGEST_WORD), F.char_length("tag") - F.col("i") + 1))
    parts = begins.select("tag", F.explode(F.transform(lengths, lambda n: F.substring(F.col("tag"), F.col("i"), n))).alias("word")).distinct()
    found = parts.join(freq.where("zipf > 0").select("word", "zipf"), "word").groupBy("tag").agg(F.collect_list("word").alias("_words"), F.collect_list("zipf").alias("_zipf"))

    @F.pandas_udf(ArrayType(StringType()))
    def split(tag: pd.Series, word: pd.Series, zipf: pd.Series) -> pd.Series:
        return pd.Series([best_split(t, {} if w is None else dict(zip(w, z))) for t, w, z in zip(tag, word, zipf)])

    guessed = rest.join(found, "tag", "left").select("tag", split("tag", "_words", "_zipf").alias("words"), F.lit(False).alias("known"))
    return known.union(guessed)


def candidates(meta: DataFrame, cat: Catalogue, freq: DataFrame) -> DataFrame:
    """(video_id, text, source, confidence, ord) of ``meta`` (id, title, description, tags): distinct by folded text, the
    first of each; ``ord`` is the place by decreasing confidence."""
    meta = meta.select(F.col("id").alias("video_id"), *(F.coalesce(c, F.lit("")).alias(c) for c in ("title", "description")), "tags")
    bar = meta.select("video_id", F.posexplode(F.split("title", P.TITLE_BAR)).alias("pos", "raw")).withColumn("text", T.meta_clean(F.col("raw"))).where("text <> ''")
    bar = bar.withColumn("f", T.fold(F.col("text"))).withColumn("confidence", T.title_score(F.col("text"), F.col("f"))).where("confidence > 0")
    bar = bar.select("video_id", F.lit(0).alias("stage"), "pos", "text", F.lit("title").alias("source"), "confidence")

    tags = meta.select("video_id", F.posexplode(F.regexp_extract_all(F.concat_ws(" ", "title", "description"), F.lit(P.HASHTAG), F.lit(1))).alias("pos", "raw")).withColumn("tag", F.lower("raw"))
    tags = tags.where(~T.is_in(F.col("tag"), L.GENERIC_TAGS) & (F.char_length("tag") >= 6))
    solo = cat.alias.where("instr(key, ' ') = 0 and char_length(key) >= 5").select(F.col("key").alias("tag"), F.lit(True).alias("solo"))
    tags = tags.join(solo, "tag", "left").join(segment(tags, cat, freq), "tag")
    words_ = tags.select("tag", F.explode("words").alias("word")).distinct().join(freq, "word", "left").groupBy("tag").agg(F.collect_set(F.when(F.col("zipf") >= 2.5, F.col("word"))).alias("common"))
    tags = tags.join(words_, "tag").withColumn("phrase", F.array_join("words", " ")).withColumn("f", T.fold(F.col("phrase")))
    w, n = F.col("words"), F.size("words")
    common = F.size(F.filter(w, lambda x: F.array_contains("common", x)))
    stray = F.exists(w, lambda x: (F.char_length(x) == 1) & ~x.isin("a", "i"))
    generic = T.is_descriptor(F.col("f")) | F.forall(w, lambda x: T.is_in(x, L.GENERIC_TAGS))
    split_ok = (n >= 2) & ~generic
    score = F.when(F.col("solo") | (split_ok & F.col("known")), 0.95).when(split_ok & ~stray & (common >= F.greatest(F.lit(2), n - 1)), F.lit(0.7) - F.when(T.looks_like_person(F.col("f")), 0.45).otherwise(0.0))
    tags = tags.withColumn("confidence", score).where("confidence is not null")
    tags = tags.select("video_id", F.lit(1).alias("stage"), "pos", F.when(F.col("solo"), F.col("tag")).otherwise(F.col("phrase")).alias("text"), F.lit("hashtag").alias("source"), "confidence")

    own = meta.select("video_id", F.posexplode(F.slice("tags", 1, 20)).alias("pos", "raw")).withColumn("text", T.meta_clean(F.col("raw")))
    own = own.where((F.col("text") != "") & ~T.is_in(F.lower("text"), L.GENERIC_TAGS) & (F.size(T.words_of(F.col("text"))) >= 2))
    own = own.select("video_id", F.lit(2).alias("stage"), "pos", "text", F.lit("tag").alias("source"), F.lit(0.4).alias("confidence"))

    lines = meta.select("video_id", F.posexplode(F.slice(F.split("description", "\n"), 1, 3)).alias("pos", "raw")).withColumn("text", T.meta_clean(F.col("raw")))
    lines = lines.where(F.char_length("text").between(3, 70)).withColumn("f", T.fold(F.col("text"))).withColumn("confidence", T.title_score(F.col("text"), F.col("f")))
    lines = lines.where("confidence >= 0.7").select("video_id", F.lit(3).alias("stage"), "pos", "text", F.lit("description").alias("source"), (F.col("confidence") * 0.8).alias("confidence"))

    every = bar.union(tags).union(own).union(lines).withColumn("folded", T.fold(F.col("text"))).where("folded <> ''")
    one = every.withColumn("_n", F.row_number().over(W.partitionBy("video_id", "folded").orderBy("stage", "pos"))).where("_n = 1")
    return one.withColumn("ord", F.row_number().over(W.partitionBy("video_id").orderBy(F.desc("confidence"), "stage", "pos"))).drop("_n", "stage", "pos")


def labelled(meta: DataFrame) -> DataFrame:
    """(video_id, name, ord): names behind a label ("Title : ...") in the title or the description's first lines."""
    text = F.concat_ws("\n", F.coalesce("title", F.lit("")), F.coalesce("description", F.lit("")))
    lines = meta.select(F.col("id").alias("video_id"), F.posexplode(F.slice(F.split(text, r"\r?\n"), 1, 40)).alias("line", "raw"))
    parts = lines.select("video_id", "line", F.posexplode(F.split("raw", r"\s[|/]\s")).alias("part", "raw"))
    edge = " \\t.,;:!\\-–—\"'“”‘’"
    name = T.collapse(T.strip_edges(F.regexp_replace(F.regexp_extract(F.trim("raw"), P.LABEL, 1), P.LABEL_CUT, ""), edge))
    found = parts.withColumn("name", name).where(F.char_length("name").between(2, 80) & (F.size(F.split("name", " ")) <= 12) & ~F.col("name").rlike(P.NOT_A_NAME) & F.col("name").rlike(T.LETTERS_2))
    found = found.withColumn("folded", T.fold(F.col("name")))
    one = found.withColumn("_n", F.row_number().over(W.partitionBy("video_id", "folded").orderBy("line", "part"))).where("_n = 1")
    return one.withColumn("ord", F.row_number().over(W.partitionBy("video_id").orderBy("line", "part"))).select("video_id", "name", "folded", "ord")


def uploader_names(meta: DataFrame, found: DataFrame) -> DataFrame:
    """(video_id, name, ord): pieces of the title bar before hashtags, then the five best metadata ``candidates`` but tags."""
    head = F.get(F.split(F.coalesce("title", F.lit("")), r"\s#"), F.lit(0))
    bar = meta.select(F.col("id").alias("video_id"), F.posexplode(F.split(head, P.UPLOADER_SPLIT)).alias("pos", "raw"))
    name = T.collapse(T.strip_edges(F.regexp_replace(F.regexp_replace("raw", P.NOT_TEXT, " "), P.UPLOADER_NOISE, ""), " \\-–—:!.,\"'"))
    bar = bar.select("video_id", F.lit(0).alias("stage"), "pos", name.alias("name")).where(F.size(T.words_of(F.col("name"))).between(1, 16) & F.col("name").rlike(T.LETTERS_2))
    rest = found.where("ord <= 5 and source <> 'tag'").select("video_id", F.lit(1).alias("stage"), F.col("ord").alias("pos"), F.regexp_replace("text", P.LABEL_PREFIX, "").alias("name"))
    every = bar.union(rest).withColumn("folded", T.fold(F.col("name"))).where("folded <> ''")
    one = every.withColumn("_n", F.row_number().over(W.partitionBy("video_id", "folded").orderBy("stage", "pos"))).where("_n = 1")
    return one.withColumn("ord", F.row_number().over(W.partitionBy("video_id").orderBy("stage", "pos"))).select("video_id", "name", "folded", "ord")
