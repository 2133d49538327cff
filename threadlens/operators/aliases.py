"""Alternate names: those that comments state, and those that the catalogue lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions import patterns as P
from ..functions import text as T
from . import discover
from .catalogue import Catalogue


def stated(comments: DataFrame) -> DataFrame:
    """(video_id, name, kind, commenters, example, ord) of the names stated as another name, by folded form: the first
    spelling, kind and comment, and the distinct authors."""
    body = discover.bodies(comments).where("body <> ''")
    found = discover.frame_slots(body, P.ALIAS_FRAMES)
    found = found.withColumn("name", T.clean_slot(F.regexp_replace("raw", P.rx(P.LEAD_HANDLE, False), " "))).withColumn("folded", T.fold(F.col("name")))
    w, f = T.words_of(T.collapse(F.col("name"))), F.col("folded")
    balanced = [F.char_length(F.regexp_replace("name", f"[^\\{a}]", "")) == F.char_length(F.regexp_replace("name", f"[^\\{b}]", "")) for a, b in ("()", "[]")]
    fine = (F.char_length(f) >= 3) & ~F.forall(T.words_of(f), lambda x: T.is_in(x, L.ALIAS_STOP)) & ~F.contains("name", F.lit("@")) & ~F.contains(F.lower("name"), F.lit("http"))
    found = found.where(fine & F.size(w).between(1, 5) & balanced[0] & balanced[1]).join(body.select("video_id", "seq", "author", "body"), ["video_id", "seq"])
    ord_ = F.struct("seq", "frame_no", "match_no")
    out = found.groupBy("video_id", "folded").agg(F.min_by(F.struct("name", F.col("frame").alias("kind"), F.left("body", F.lit(110)).alias("example")), ord_).alias("f"), F.count_distinct("author").alias("commenters"), F.min(ord_).alias("ord"))
    return out.select("video_id", "f.name", "f.kind", "commenters", "f.example", "ord")


def of_catalogue(titles: DataFrame, cat: Catalogue) -> DataFrame:
    """(title, name, at) of the listed aliases of each title (title) that the catalogue knows, but for the title itself."""
    keyed = titles.select("title").distinct().withColumn("key", T.fold(F.col("title")))
    listed = keyed.join(cat.alias, "key").join(cat.titles.select("canonical", "aliases"), "canonical").select("title", "key", F.posexplode("aliases").alias("at", "name"))
    return listed.withColumn("folded", T.fold(F.col("name"))).where("folded <> key").select("title", "name", "at")
