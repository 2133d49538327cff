"""The one-video answer, for many videos at once: a priority union of candidates, each checked against the title database.

Order of preference: (1) a name stated in comments that is not a mere guess; (2) a name the uploader labelled; (3) a name
one person stated that a database knows; (4) something else the uploader wrote that a database knows; (5) a catalogue
title that people mentioned. Candidates get (step, ord), and the first acceptable one of each video is its answer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import similarity as S
from ..functions import text as T
from ..functions.lineage import settled
from . import discover, metadata, titledb

PROBES = 6


def mentioning(comments: DataFrame, names: DataFrame) -> DataFrame:
    """Rows of ``comments`` joined to the ``names`` (video_id, name) that they contain as whole words. A comment's n-grams
    are joined to the names, so no name is tried against every comment."""
    folded = comments.withColumn("_w", T.fold(F.regexp_replace(F.coalesce("text", F.lit("")), P.ZERO_WIDTH, ""))).withColumn("_w", T.words_of(F.col("_w")))
    keyed = names.withColumn("_key", T.fold(F.col("name"))).where("_key <> ''").withColumn("_n", F.size(F.split("_key", " ")))
    most = keyed.agg(F.max("_n")).first()[0] or 1
    grams = folded.select("video_id", "seq", F.explode(F.array_distinct(F.transform(T.ngrams(F.col("_w"), most), lambda g: g["gram"]))).alias("_key"))
    hit = grams.join(keyed, ["video_id", "_key"]).select("video_id", "seq", "name").distinct()
    return hit.join(comments, ["video_id", "seq"])


def about_songs(answers: DataFrame, comments: DataFrame) -> DataFrame:
    """(video_id, name): names half of whose comments, or the comments they reply to, talk of music."""
    body = discover.bodies(comments)
    parents = body.select("video_id", F.col("id").alias("parent"), F.col("text").alias("parent_text"))
    found = mentioning(body, answers.select("video_id", F.col("title").alias("name"))).withColumn("parent", discover.parent_id(F.col("id"))).join(parents, ["video_id", "parent"], "left")
    song = F.col("text").rlike(P.SONG) | F.coalesce(F.col("parent_text").rlike(P.SONG), F.lit(False))
    return found.groupBy("video_id", "name").agg(F.count("*").alias("n"), F.count_if(song).alias("songs")).where("songs * 2 >= n").select("video_id", "name")


def trimmed(c: Column, n: int = 280) -> Column:
    t = F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), P.ZERO_WIDTH, ""))
    return F.when(F.char_length(t) <= n, t).otherwise(F.concat(F.rtrim(F.left(t, F.lit(n - 1))), F.lit("…")))


def evidence(names: DataFrame, comments: DataFrame, top: int = 2) -> DataFrame:
    """(video_id, place, text, likes, question): of each video, the comments that name its answer (``names``: video_id,
    name): replies to a question first, then by likes; questions that repeat the name do not count."""
    body = discover.bodies(comments)
    parents = body.select("video_id", F.col("id").alias("parent"), F.col("text").alias("parent_text"), F.col("body").alias("parent_body"), F.lit(True).alias("is_reply"))
    found = mentioning(body, names).dropDuplicates(["video_id", "seq"]).where(~(T.is_question(F.col("body")) & F.contains("text", F.lit("?"))))
    found = found.withColumn("parent", discover.parent_id(F.col("id"))).join(parents, ["video_id", "parent"], "left")
    asked = F.coalesce(T.is_question(F.col("parent_body")), F.lit(False))
    text = F.when(F.col("is_reply"), discover.without_handle(F.col("text"))).otherwise(F.col("text"))
    order = W.partitionBy("video_id").orderBy((~asked).cast("int"), F.desc("likes"), "seq")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= top).select("video_id", "place", trimmed(text).alias("text"), "likes", F.when(asked, trimmed(F.col("parent_text"))).alias("question"))


def note(confidence: Column, said: Column, in_meta: Column) -> Column:
    """The sentence that says how sure an answer is."""
    people = F.concat(said.cast("string"), F.when(said == 1, " person").otherwise(" people"))
    named = F.concat(people, F.lit(" named it in the comments"))
    high = F.when((said > 0) & in_meta, F.concat(named, F.lit(", and it matches what the uploader wrote."))).when(said > 0, F.concat(named, F.lit("."))).otherwise("The uploader wrote it, and it matches a known title.")
    medium = F.when(said > 0, F.concat(named, F.lit(". Likely, but worth a quick check."))).otherwise("The uploader wrote it. Likely, but nobody in the comments confirmed it.")
    return F.when(confidence == "high", high).when(confidence == "medium", medium).otherwise("Only a guess from what the uploader wrote. Nobody in the comments confirmed it.")


def contexts(meta: DataFrame) -> DataFrame:
    """(video_id, context, segments, live): what a video's metadata says it should be."""
    text = F.concat_ws(" ", "title", F.array_join("tags", " "), F.left(F.coalesce("description", F.lit("")), F.lit(400)))
    out = meta.select(F.col("id").alias("video_id"), text.alias("context")).withColumn("segments", T.segments_of(F.col("context")))
    return out.withColumn("live", titledb.live_action(F.col("segments"), F.col("context")))


def confirmed(candidates: DataFrame, meta: DataFrame, cache: DataFrame) -> DataFrame:
    """``candidates`` (video_id, title, ...) with the title database's verdict (status, entity)."""
    keyed = candidates.select("video_id", "title").distinct().join(contexts(meta), "video_id").withColumnRenamed("video_id", "vid")
    chosen = titledb.choose(keyed, titledb.lookup(keyed.select("title"), cache)).select(F.col("vid").alias("video_id"), "title", "status", "entity")
    return candidates.join(chosen, ["video_id", "title"], "left")


def find(answers: DataFrame, comments: DataFrame, meta: DataFrame, cat, freq: DataFrame, cache: DataFrame) -> DataFrame:
    """(video_id, title, shown, confidence, note, step, status, also): one row for each video with an acceptable answer.
    ``answers`` as from ``analyze``."""
    labels = settled(metadata.labelled(meta))
    metas = settled(metadata.candidates(meta, cat, freq))
    music = about_songs(answers, comments).withColumnRenamed("name", "title")
    own = answers.join(music, ["video_id", "title"], "left_anti").withColumn("folded", T.fold(F.col("title")))
    has = lambda p: F.exists("sources", lambda s: F.startswith(s, F.lit(p)))
    spoken = has("comments") | ((F.col("confidence") == "high") & (F.col("commenters") > 0))
    own = own.withColumns({"spoken": spoken, "in_meta": has("metadata")})
    named = labels.groupBy("video_id").agg(F.collect_set("folded").alias("labels"))
    own = own.join(named, "video_id", "left")
    # a labelled name that differs ends the first step at the first answer that is not sure
    conflict = (F.col("confidence") != "high") & F.col("labels").isNotNull() & ~F.array_contains("labels", F.col("folded"))
    stop = F.max((F.col("spoken") & (conflict | (F.col("confidence") == "low"))).cast("int")).over(W.partitionBy("video_id").orderBy("rank"))
    own = settled(own.withColumn("stopped", stop))
    base = ["video_id", "title", "confidence", "commenters", "in_meta", "alternates"]
    none = [F.lit("medium").alias("confidence"), F.lit(0).cast("long").alias("commenters"), F.lit(True).alias("in_meta"), F.array().cast("array<struct<name: string, kind: string>>").alias("alternates")]
    low = own.where("spoken and confidence = 'low'").withColumn("_n", F.row_number().over(W.partitionBy("video_id").orderBy("rank"))).where("_n <= 2")
    passing = own.where("not spoken and commenters > 0 and confidence <> 'low'").withColumn("_n", F.row_number().over(W.partitionBy("video_id").orderBy("rank"))).where("_n = 1")
    uploader = metadata.uploader_names(meta, metas)
    steps = [
        own.where("spoken and stopped = 0").select(F.lit(1).alias("step"), F.col("rank").alias("ord"), *base),
        labels.where("ord <= 2").select(F.lit(2).alias("step"), "ord", "video_id", F.col("name").alias("title"), *none),
        low.select(F.lit(3).alias("step"), F.col("rank").alias("ord"), *base),
        uploader.select(F.lit(4).alias("step"), "ord", "video_id", F.col("name").alias("title"), *none),
        passing.select(F.lit(5).alias("step"), F.col("rank").alias("ord"), *base),
    ]
    every = steps[0]
    for s in steps[1:]:
        every = every.unionByName(s)
    checked = confirmed(settled(every), meta, cache)
    probe = F.row_number().over(W.partitionBy("video_id").orderBy("step", "ord"))
    ok, no = F.col("status") == "confirmed", F.coalesce(F.col("status") == "contradicted", F.lit(False))
    good = F.when(F.col("step") == 1, ~no | (F.col("confidence") == "high")).when(F.col("step") == 3, ok).when(F.col("step") == 4, ok & (F.col("probe") <= PROBES)).otherwise(~no)
    first = checked.withColumn("probe", probe).where(good).withColumn("_n", F.row_number().over(W.partitionBy("video_id").orderBy("step", "ord"))).where("_n = 1")
    return _presented(first)


def _presented(first: DataFrame) -> DataFrame:
    e, ok = F.col("entity"), F.col("status") == "confirmed"
    out = first.withColumn("_a", T.fold(e["name"])).withColumn("_b", T.fold(F.col("title"))).withColumn("_close", S.token_set_ratio("_a", "_b"))
    plain = F.when(F.col("title") == F.lower("title"), F.try_element_at(T.title_forms(F.col("title")), F.lit(-1))).otherwise(F.col("title"))
    database = F.concat(F.lit("it's a real "), F.lower(titledb.kind_label(e["kind"], e["country"], e["spanish"])), F.lit(" on "), titledb._map(e["source"], titledb.SOURCE_NAME, e["source"]))
    said = note(F.col("confidence"), F.col("commenters"), F.col("in_meta"))
    people = F.concat(F.col("commenters").cast("string"), F.when(F.col("commenters") == 1, " person").otherwise(" people"))
    text = (
        F.when(F.col("step") == 2, F.concat(F.lit("The uploader named it in the video's description"), F.when(ok, F.concat(F.lit(", and "), database, F.lit("."))).otherwise(". No database has it yet, so check it.")))
        .when(F.col("step") == 3, F.concat(people, F.lit(" named it in the comments and "), database, F.lit(". Worth a quick check.")))
        .when(F.col("step") == 4, F.concat(F.lit("The uploader wrote it and "), database, F.lit(". Nobody in the comments confirmed it.")))
        .otherwise(said)
    )
    sure = F.when(F.col("step") == 1, F.col("confidence")).when((F.col("step") == 2) & ok, "high").otherwise("medium")
    also = F.slice(F.array_distinct(F.concat(F.transform("alternates", lambda a: a["name"]), F.coalesce(F.filter(e["names"], lambda n: F.char_length(n) <= 60), F.array().cast("array<string>")))), 1, 6)
    shown = F.when(ok & (F.col("_close") >= 50), e["name"]).otherwise(plain)
    return out.select("video_id", "title", shown.alias("shown"), sure.alias("confidence"), text.alias("note"), "step", F.coalesce("status", F.lit("unconfirmed")).alias("status"), F.array_except(also, F.array(shown)).alias("also"))
