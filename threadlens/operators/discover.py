"""Titles stated in comments without a catalogue: the slots of phrasings people use, bare replies under a question,
clustered by spelling and ranked by how many stated them outright."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions import patterns as P
from ..functions import text as T
from ..functions.lineage import settled
from . import words
from .rank import histogram

COMMENT = ["video_id", "seq"]
EXAMPLE = 110


def bodies(comments: DataFrame) -> DataFrame:
    return comments.withColumns({"text": F.coalesce("text", F.lit("")), "likes": F.coalesce("likes", F.lit(0)), "author": F.coalesce("author", F.lit(""))}).withColumn("body", T.clean(F.col("text")))


def frame_slots(body: DataFrame, frames: list[tuple[str, str]], column: str = "body", held: list[tuple[str, ...]] | None = None) -> DataFrame:
    """(video_id, seq, frame, frame_no, match_no, raw): the first group of every match of every frame. ``held``: words of which
    each match of a frame holds one; a frame is only tried on comments that do, and as a row of its own, so that the
    generated code has one pattern match in place of one for each frame."""
    # what a match in any case takes for i, s and k is these letters here
    plain = F.translate(F.lower(F.translate(column, "İı", "ii")), "ſ", "s")
    some = lambda words_: F.greatest(*(F.contains("_plain", F.lit(w)) for w in words_)) if len(words_) > 1 else F.contains("_plain", F.lit(words_[0]))
    row = lambda i, name, p: F.struct(F.lit(name).alias("frame"), F.lit(i).alias("frame_no"), F.lit(p).alias("_pattern"))
    each = F.array(*(F.when(some(held[i]), row(i, name, p)) if held else row(i, name, p) for i, (name, p) in enumerate(frames)))
    tried = body.select(*COMMENT, column, plain.alias("_plain")).select(*COMMENT, column, F.inline(F.array_compact(each)))
    return tried.select(*COMMENT, "frame", "frame_no", F.posexplode(F.regexp_extract_all(column, F.col("_pattern"), F.lit(1))).alias("match_no", "raw"))


def slots(hits: DataFrame) -> DataFrame:
    """Hits with their cleaned slot and its folded form; empty and junk slots go."""
    out = hits.withColumn("slot", T.clean_slot(F.col("raw"))).where("slot <> ''").withColumn("folded", T.fold(F.col("slot")))
    return out.where(~T.is_junk(F.col("folded")))


def parent_id(c: Column) -> Column:
    return F.when(F.instr(c, ".") > 0, F.substring_index(c, ".", 1))


def replies(body: DataFrame) -> DataFrame:
    """Replies with their parent's text and likes, by an equi join on (video, parent id)."""
    parents = body.select("video_id", F.col("id").alias("parent"), F.col("text").alias("parent_text"), F.col("body").alias("parent_body"), F.col("likes").alias("parent_likes"))
    return body.withColumn("parent", parent_id(F.col("id"))).where("parent is not null").join(parents, ["video_id", "parent"])


def without_handle(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, P.ZERO_WIDTH, ""), P.rx(P.REPLY_HANDLE, False), "")


def thread_answers(body: DataFrame, freq: DataFrame) -> DataFrame:
    """(video_id, seq, frame, frame_no, match_no, slot, folded): short bare replies to a question that name something."""
    asked = replies(body).where(T.is_question(F.col("parent_body"))).withColumn("reply", without_handle(F.col("text")))
    told = asked.where(~T.is_question(T.clean(F.col("reply"))) & ~F.contains("reply", F.lit("?"))).withColumn("raw", F.col("reply"))
    found = slots(told.select(*COMMENT, "raw"))
    w = T.words_of(T.collapse(F.col("slot")))
    first = F.get(w, F.lit(0))
    fine = (F.size(w).between(1, 7)) & F.col("slot").rlike(T.LETTERS_2) & ~F.contains("slot", F.lit(",")) & ~F.col("slot").rlike(P.CHATTER)
    found = found.where(fine & ((F.char_length(first) > 1) | F.lower(first).isin("a", "i")))
    plain = words.with_ambiguity(found, freq, "slot").where((F.col("ambiguity") < 4.0) | T.is_title_case(F.col("slot")))
    return plain.select(*COMMENT, F.lit("replyto").alias("frame"), F.lit(len(P.FRAMES)).alias("frame_no"), F.lit(0).alias("match_no"), "slot", "folded")


def hits(body: DataFrame, freq: DataFrame) -> DataFrame:
    """(video_id, seq, frame, ord, slot, folded): every stated slot; thread answers come after all frames of a video."""
    stated = slots(frame_slots(body.where("body <> ''"), P.FRAMES, held=P.FRAME_WORDS)).where((F.col("frame") != "premedia") | T.is_title_case(F.col("slot")))
    columns = [*COMMENT, "frame", "frame_no", "match_no", "slot", "folded"]
    every = stated.select(*columns).union(thread_answers(body, freq).select(*columns))
    return every.withColumn("late", (F.col("frame") == "replyto").cast("int"))


def is_strong(frame: Column) -> Column:
    return F.startswith(frame, F.lit("lang:")) | T.is_in(frame, L.STRONG_FRAMES)


def demand(comments: DataFrame) -> DataFrame:
    """(video_id, asked, asked_likes): comments that ask for the name, and their likes."""
    asks = T.is_question(F.col("body"))
    return bodies(comments).groupBy("video_id").agg(F.count_if(asks).alias("asked"), F.coalesce(F.sum(F.when(asks, F.col("likes"))), F.lit(0)).alias("asked_likes"))


def summarise(led: DataFrame, body: DataFrame, least_strong: int = 1) -> DataFrame:
    """Clusters (video_id, leader) of hits as (title, commenters, likes, strength, frames, example, variants)."""
    by = ["video_id", "leader"]
    full = led.join(body.select(*COMMENT, "id", "author", "likes", "text"), COMMENT)
    first = F.min(F.struct("late", "seq", "frame_no", "match_no"))
    spelled = full.groupBy(*by, "slot").agg(F.sum("likes").alias("n"), first.alias("first"))
    spellings = spelled.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("less"), "first", "slot"))).alias("s"))
    # a comment's likes count once for a cluster, however often it names it
    likes = full.dropDuplicates([*by, "id"]).groupBy(*by).agg(F.sum("likes").alias("likes"))
    order = F.struct(F.col("likes"), -F.col("late"), -F.col("seq"), -F.col("frame_no"), -F.col("match_no"))
    main = full.groupBy(*by).agg(
        F.count_distinct("author").alias("commenters"), F.count_if(is_strong(F.col("frame"))).alias("strength"),
        F.left(F.max_by("text", order), F.lit(EXAMPLE)).alias("example"), first.alias("first"),
    ).where(F.col("strength") >= least_strong)
    out = main.join(likes, by).join(histogram(full, by, "frame", "frames"), by).join(spellings, by)
    return out.select(
        "video_id", F.get("s", F.lit(0))["slot"].alias("title"), "commenters", "likes", "strength", "frames", "example",
        F.transform(F.slice("s", 1, 5), lambda x: x["slot"]).alias("variants"), "first",
    )


def discover(comments: DataFrame, freq: DataFrame, least_strong: int = 1) -> DataFrame:
    """Titles stated in each video's comments, with ``rank`` by strength, commenters and likes."""
    from .cluster import with_leader

    body = bodies(comments).cache()
    led = settled(with_leader(settled(hits(body, freq)), "video_id", "folded", ["late", "seq", "frame_no", "match_no"]))
    found = summarise(led, body, least_strong)
    best = W.partitionBy("video_id").orderBy(F.desc("strength"), F.desc("commenters"), F.desc("likes"), "first")
    return found.withColumn("rank", F.row_number().over(best)).drop("first")


def language_of(c: Column) -> Column:
    """A comment's language by the script it is in, as far as scripts tell; "en/other" for Latin ones."""
    scripts = (("ko", r"[\x{AC00}-\x{D7AF}\x{1100}-\x{11FF}]"), ("ja", r"[\x{3040}-\x{30FF}]"), ("zh", r"[\x{4E00}-\x{9FFF}]"), ("ru", r"[\x{0400}-\x{04FF}]"), ("ar", r"[\x{0600}-\x{06FF}]"),
               ("hi", r"[\x{0900}-\x{097F}]"), ("th", r"[\x{0E00}-\x{0E7F}]"))
    out = F.lit("en/other")
    for name, pattern in reversed(scripts):
        out = F.when(c.rlike(pattern), name).otherwise(out)
    return out
