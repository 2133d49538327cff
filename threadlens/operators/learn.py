"""New catalogue entries from a sweep's answers, and scores of extracted against expected titles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions import similarity as S
from ..functions import text as T
from ..functions.lineage import settled
from . import report, words
from .catalogue import Catalogue
from .cluster import led


def learned(sweep: DataFrame, cat: Catalogue, freq: DataFrame) -> DataFrame:
    """(canonical, kind, aliases) of titles that comments named often enough and that are no ordinary English."""
    a = sweep.select(F.explode("answers").alias("a")).select("a.*")
    has = lambda p: F.exists("sources", lambda s: F.startswith(s, F.lit(p)))
    a = a.where(has("comments") & ((F.col("commenters") >= 3) | (has("metadata") & (F.col("commenters") >= 2))))
    a = T.with_group_key(a.withColumn("name", T.title_clean(F.col("title"))), "name", "key").where("char_length(key) >= 3").where(F.size(F.split("key", " ")) <= 7)
    common = a.select("key").distinct().join(freq.withColumnRenamed("word", "key"), "key").where("zipf >= 3.0 and instr(key, ' ') = 0").select("key")
    a = words.with_ambiguity(a.join(common, "key", "left_anti"), freq, "name").where("ambiguity < 5.0").transform(settled)
    names = a.groupBy("key", "name").agg(F.count("*").alias("n"))
    total = names.groupBy("key").agg(F.sum("n").alias("videos"), F.sum("n").alias("commenters"), F.lit(False).alias("confirmed"), F.lit(None).cast("map<string,bigint>").alias("entities"))
    total = settled(total)
    # the more often named of two leads, then the one earlier in the alphabet
    place = lambda c: total.select(F.col("key").alias(c), F.struct((-F.col("videos")).alias("less"), "key").alias(f"{c}_at"))
    pairs = report.merge_pairs(total).join(place("a"), "a").join(place("b"), "b").where("a_at < b_at").where(S.can_reach(F.col("a"), F.col("b"), 90.0))
    into = settled(led(pairs.where(S.ratio("a", "b") >= 90).select("a", F.col("a_at").alias("at"), "b"), []).select(F.col("b").alias("key"), F.col("leader").alias("into")))
    joined = lambda df: df.join(into, "key", "left").withColumn("key", F.coalesce("into", "key")).drop("into")
    names = joined(names).groupBy("key", "name").agg(F.sum("n").alias("n"))
    new = names.join(cat.alias.select("key"), "key", "left_anti")
    display = report.display_form(new, freq)
    alts = a.select("key", F.explode("alternates").alias("x")).withColumn("name", T.title_clean(F.col("x.name"))).where(T.alternate_is_clean(F.col("name")))
    alts = joined(alts.select("key", "name")).groupBy("key", "name").agg(F.count("*").alias("n")).join(display, "key")
    alts = report.is_variant(T.with_group_key(alts, "name", "akey"), "name", "title").where("akey <> key and (n >= 2 or variant)").select("key", "name", "n")
    spelled = new.join(display, "key").where("name <> title").select("key", "name", "n")
    top = lambda df, k: df.groupBy("key").agg(F.slice(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("less"), "name"))), lambda x: x["name"]), 1, k).alias("names"))
    every = top(alts, 6).union(top(spelled, 3)).select("key", F.explode("names").alias("name"))
    every = T.with_group_key(T.with_group_key(every.join(display, "key"), "name", "a"), "title", "b").where("a <> b").groupBy("key").agg(F.array_sort(F.collect_set("name")).alias("aliases"))
    return display.join(every, "key", "left").select(F.col("title").alias("canonical"), F.lit("unknown").alias("kind"), F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases"))


def scores(got: DataFrame, wanted: DataFrame, by: list[str]) -> DataFrame:
    """(tp, fp, fn, p, r, f) of distinct ``got`` against ``wanted`` rows (by..., title), micro-averaged; without anything
    found p is 1, without anything wanted r is 1."""
    keys = [*by, "title"]
    both = got.select(*keys).distinct().withColumn("g", F.lit(1)).join(wanted.select(*keys).distinct().withColumn("w", F.lit(1)), keys, "full")
    n = both.agg(F.count_if(F.col("g").isNotNull() & F.col("w").isNotNull()).alias("tp"), F.count_if(F.col("w").isNull()).alias("fp"), F.count_if(F.col("g").isNull()).alias("fn"))
    p = F.when(F.col("tp") + F.col("fp") == 0, 1.0).otherwise(F.col("tp") / (F.col("tp") + F.col("fp")))
    r = F.when(F.col("tp") + F.col("fn") == 0, 1.0).otherwise(F.col("tp") / (F.col("tp") + F.col("fn")))
    return n.withColumns({"p": p, "r": r}).withColumn("f", F.when(F.col("p") + F.col("r") == 0, 0.0).otherwise(2 * F.col("p") * F.col("r") / (F.col("p") + F.col("r"))))


def accuracy(got: DataFrame, wanted: DataFrame) -> DataFrame:
    """(n, top1, ceiling) of ranked names (video_id, rank, title) against one wanted title a video: the share of videos whose
    first, or any, name is it."""
    g, w = T.with_group_key(got, "title", "k"), T.with_group_key(wanted.withColumnRenamed("title", "wanted"), "wanted", "wk")
    hit = w.join(g, "video_id", "left").groupBy("video_id").agg(F.max(((F.col("k") == F.col("wk")) & (F.col("rank") == 1)).cast("int")).alias("first"), F.max((F.col("k") == F.col("wk")).cast("int")).alias("any"))
    return hit.agg(F.count("*").alias("n"), F.avg(F.coalesce("first", F.lit(0))).alias("top1"), F.avg(F.coalesce("any", F.lit(0))).alias("ceiling"))


def changed(before: DataFrame, after: DataFrame) -> DataFrame:
    """(video_id, before, after) where two runs' first answers differ."""
    b, a = (df.where("rank = 1").select("video_id", F.col("title").alias(n)) for df, n in ((before, "before"), (after, "after")))
    return b.join(a, "video_id", "full").where(~F.col("before").eqNullSafe(F.col("after")))
