"""The demand report: which titles many videos' answers name, over a sweep of videos (schema ``readers.SWEEP``)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions import similarity as S
from ..functions import text as T
from ..functions.lineage import settled
from . import titledb, words
from .cluster import merge_order, similar
from .components import components
from .rank import histogram

TYPO, SURE_TYPO, VARIANT = 90.0, 96.0, 85.0
#: The zipf frequency from which a word is an ordinary one.
ORDINARY = 3.0


def weight(tier: Column) -> Column:
    out = F.lit(0.0)
    for name, value in L.TIER_WEIGHT.items():
        out = F.when(tier == name, value).otherwise(out)
    return out


def extended(title: Column, video_title: Column) -> Column:
    """A title of up to three words with the number that follows it in the video's own title."""
    literal = F.concat(F.lit(r"(?iU)\b\Q"), title, F.lit(r"\E\s+(\d{1,4})\b"))
    number = F.call_function("regexp_extract", F.coalesce(video_title, F.lit("")), literal, F.lit(1))
    words_ = F.size(T.words_of(T.collapse(title)))
    return F.when((words_ <= 3) & (title != "") & (number != "") & ~F.endswith(title, number), F.concat_ws(" ", title, number)).otherwise(title)


def answers_of(sweep: DataFrame, floor: float = 0.5) -> DataFrame:
    """(vid, ..., top, shown, key): each video's first answer, if its tier reaches ``floor`` and it is a title."""
    top = F.get("answers", F.lit(0))
    out = sweep.withColumn("top", top).where(F.col("top").isNotNull() & (weight(F.coalesce(F.col("top")["conf"], F.lit("low"))) >= floor))
    out = out.withColumn("shown", T.title_clean(F.col("top")["title"])).withColumn("folded", T.fold(F.col("shown")))
    out = out.where(~T.is_descriptor(F.col("folded")) & ~F.forall(T.words_of(F.col("folded")), lambda w: T.is_in(w, L.FUNCTION_WORDS)))
    out = T.with_group_key(out, "shown", "key").where(F.char_length("key") >= 3).drop("folded")
    return T.with_group_key(out.withColumn("shown", extended(F.col("shown"), F.col("title"))), "shown", "key")


def display_form(names: DataFrame, freq: DataFrame, by: str = "key") -> DataFrame:
    """(by, title): of ``names`` (by, name, n), the best-cased, most real and most frequent spelling, first letter raised."""
    scored = names.join(words.lexical_share(names, freq), "name")
    order = F.struct(T.case_score(F.col("name")), T.starts_upper(F.col("name")).cast("int"), "lexical", "n", F.char_length("name"), "name")
    best = scored.groupBy(by).agg(F.max_by("name", order).alias("title"))
    first = F.left("title", F.lit(1))
    return best.withColumn("title", F.when(first == F.lower(first), F.concat(F.upper(first), F.substr("title", F.lit(2)))).otherwise(F.col("title")))


def is_variant(pairs: DataFrame, a: str, b: str, name: str = "variant") -> DataFrame:
    """``pairs`` with whether two names spell the same words: equal without spaces, an acronym, or a ratio of 85."""
    out = T.with_group_key(T.with_group_key(pairs, a, "_a"), b, "_b").withColumn("_fa", F.replace(T.fold(F.col(a)), F.lit(" "), F.lit("")))
    w = T.words_of(F.col("_b"))
    letters = F.array_join(F.transform(w, lambda x: F.left(x, F.lit(1))), "")
    glued = lambda c: F.replace(c, F.lit(" "), F.lit(""))
    out = out.withColumn("_r", S.ratio("_a", "_b"))
    yes = (glued("_a") == glued("_b")) | ((F.size(w) >= 2) & (F.col("_fa") == letters)) | (F.col("_r") >= VARIANT)
    return out.withColumn(name, (F.col("_a") != "") & (F.col("_b") != "") & yes).drop("_a", "_b", "_fa", "_r")


def rows(answers: DataFrame, freq: DataFrame) -> DataFrame:
    """One row a key: sums, the mean tier, merged maps of genres, languages and entities, spellings, alternates, display."""
    base = answers.groupBy("key").agg(
        F.count("*").alias("videos"), F.sum(F.coalesce(F.col("top")["commenters"], F.lit(0))).alias("commenters"), F.sum(F.coalesce(F.col("top")["likes"], F.lit(0))).alias("likes"),
        F.sum(F.coalesce("asked", F.lit(0))).alias("demand"), F.sum(F.coalesce("views", F.lit(0))).alias("views"), F.round(F.avg(weight(F.col("top")["conf"])), 2).alias("confidence"),
        F.max(F.col("entity").isNotNull()).alias("confirmed"),
    )
    genres = histogram(answers.withColumn("genre", T.genre_of(F.col("query"))), ["key"], "genre", "genres")
    languages = histogram(answers.select("key", F.explode("langs").alias("lang", "n")), ["key"], "lang", "languages", F.col("n"))
    entities = histogram(answers.where("entity is not null").withColumn("eid", F.col("entity.id")), ["key"], "eid", "entities")
    spelled = answers.groupBy("key", F.col("shown").alias("name")).agg(F.count("*").alias("n"))
    display = display_form(spelled, freq)
    ordered = lambda name, at: F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("less"), name))), lambda x: x[at])
    alts = answers.select("key", F.explode("top.alternates").alias("a")).withColumn("name", T.title_clean(F.col("a.name"))).where(T.alternate_is_clean(F.col("name")))
    alts = T.with_group_key(alts, "name", "akey").where("akey <> '' and akey <> key").groupBy("key", "name", "akey").agg(F.count("*").alias("n"))
    works = answers.where("entity is not null").groupBy("key", F.col("entity.id").alias("id")).agg(F.count("*").alias("n"), F.first("entity").alias("e"))
    chosen = works.groupBy("key").agg(F.max_by("e", F.struct("n", "id")).alias("e"))
    named = database_names(answers, works, spelled)
    display = display.join(named.select("key", "official"), "key", "left").select("key", F.coalesce("official", "title").alias("title"))
    variants = spelled.join(display, "key").where("name <> title").groupBy("key").agg(ordered("name", "name").alias("variants"))
    alts = is_variant(alts.join(display, "key"), "name", "title")
    alts = database_alternates(alts, works, chosen, display)
    out = base
    for part in (genres, languages, entities, display, variants, alts, chosen):
        out = out.join(part, "key", "left")
    e = F.col("e")
    return out.select(
        "key", "title", "videos", "commenters", "likes", "demand", "views", "confidence", "genres", "languages", "entities", "confirmed",
        F.coalesce("variants", F.array().cast("array<string>")).alias("variants"), F.coalesce("alternates", F.array().cast("array<string>")).alias("alternates"),
        F.when(F.col("confirmed"), titledb.kind_label(e["kind"], e["country"], e["spanish"])).alias("kind"), F.when(F.col("confirmed"), e["year"]).alias("year"), F.when(F.col("confirmed"), e["url"]).alias("url"),
    )


def _match(a: Column, b: Column) -> Column:
    """Whether two group keys name one work: equal, equal without spaces, or long and almost equal."""
    glued = lambda c: F.replace(c, F.lit(" "), F.lit(""))
    return (a == b) | (glued(a) == glued(b))


def _matched(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """``pairs`` whose group keys ``a`` and ``b`` name one work; the ratio is a call into Python, for long ones only."""
    same = pairs.where(_match(F.col(a), F.col(b)))
    long = pairs.where(~_match(F.col(a), F.col(b)) & (F.char_length(a) >= titledb.FUZZY_LENGTH) & (F.char_length(b) >= titledb.FUZZY_LENGTH) & S.can_reach(F.col(a), F.col(b), titledb.FUZZY))
    return same.unionByName(long.where(S.ratio(a, b) >= titledb.FUZZY))


def database_names(answers: DataFrame, works: DataFrame, spelled: DataFrame) -> DataFrame:
    """(key, official) of confirmed rows: the database's most frequent name for the work; where nobody wrote that one, the
    name of the database's that the most frequent spelling is; capitals taken from a spelling, or one by word."""
    most = answers.where("entity is not null").groupBy("key", F.col("entity.name").alias("name")).agg(F.count("*").alias("n"))
    most = settled(most.groupBy("key").agg(F.max_by("name", F.struct("n", "name")).alias("primary")))
    written = settled(T.with_group_key(spelled.join(most.select("key"), "key", "left_semi"), "name", "said"))
    as_entity = most.select(F.col("key").alias("title_key"), F.lit("").alias("id"), F.col("primary").alias("name"), F.array().cast("array<string>").alias("names"))
    own = titledb.name_keys(as_entity).select(F.col("title_key").alias("row"), F.col("key").alias("known"))
    used = _matched(written.join(own, F.col("row") == F.col("key")), "said", "known").select("key", F.lit(True).alias("used")).distinct()
    first = written.groupBy("key").agg(F.max_by("said", F.struct("n", "name")).alias("said"))
    each = works.select("key", "id", "n", F.posexplode("e.names").alias("at", "name")).where(F.col("name").rlike(r"^\p{ASCII}+$"))
    parts = titledb.name_keys(each.select(F.concat_ws("\x01", "key", "id", F.col("at").cast("string")).alias("title_key"), "id", "name", F.array().cast("array<string>").alias("names"))).select("title_key", F.col("key").alias("known"))
    each = each.withColumn("title_key", F.concat_ws("\x01", "key", "id", F.col("at").cast("string"))).join(parts, "title_key").join(first, "key")
    other = _matched(each, "said", "known").groupBy("key").agg(F.min_by(F.trim("name"), F.struct((-F.col("n")).alias("less"), "id", "at")).alias("other"))
    out = most.join(used, "key", "left").join(other, "key", "left").select("key", F.when(F.col("used"), F.col("primary")).otherwise(F.coalesce("other", "primary")).alias("official"))
    out = T.with_group_key(out, "official", "okey")
    mixed = written.where(~T.is_upper(F.col("name")) & (F.col("name") != F.lower("name"))).select("key", F.col("said").alias("okey"), "n", "name")
    cased = mixed.groupBy("key", "okey").agg(F.max_by("name", F.struct("n", "name")).alias("cased"))
    loud = T.is_upper(F.col("official")) & (F.char_length("official") > 3)
    return out.join(cased, ["key", "okey"], "left").select("key", F.when(loud, F.coalesce("cased", F.initcap("official"))).otherwise(F.col("official")).alias("official"))


def database_alternates(alts: DataFrame, works: DataFrame, chosen: DataFrame, display: DataFrame) -> DataFrame:
    """(key, alternates) of ``alts`` (key, name, akey, n, variant): for confirmed rows the chosen work's own name, the names
    that the database knows or that respell the title, and a romanised one; for others names that recur or respell. One
    entry a name, in its best-cased spelling."""
    confirmed = works.select("key").distinct().withColumn("works", F.lit(True))
    keys = titledb.name_keys(works.select(F.col("key").alias("title_key"), "id", F.col("e.name").alias("name"), F.col("e.names").alias("names"))).select(F.col("title_key").alias("key"), F.col("key").alias("akey"), F.lit(True).alias("known")).distinct()
    seen = alts.join(keys, ["key", "akey"], "left").join(confirmed, "key", "left")
    keep = F.when(F.col("works"), F.coalesce("known", F.lit(False)) | F.col("variant")).otherwise((F.col("n") >= 2) | F.col("variant"))
    seen = seen.where(keep).select("key", "name", "akey", F.lit(1).alias("turn"), "n")
    own = T.with_group_key(display, "title", "tkey").select("key", "tkey")
    named = T.with_group_key(chosen.select("key", F.col("e.name").alias("name")), "name", "akey").select("key", "name", "akey", F.lit(0).alias("turn"), F.lit(0).cast("long").alias("n"))
    roman = works.where("e.source = 'anilist'").select("key", "id", F.col("n").alias("m"), F.get("e.names", F.lit(1)).alias("name")).where(F.col("name").rlike(r"^\p{ASCII}+$") & (F.size(T.words_of(T.collapse(F.col("name")))) <= 6))
    roman = T.with_group_key(roman, "name", "akey").join(own, "key").where("akey <> tkey").groupBy("key").agg(F.max_by(F.struct("name", "akey"), F.struct("m", "id")).alias("x"))
    every = seen.unionByName(named).unionByName(roman.select("key", "x.name", "x.akey", F.lit(2).alias("turn"), F.lit(0).cast("long").alias("n")))
    every = every.join(own, "key").where("akey <> tkey and akey <> ''").withColumn("case", T.case_score(F.col("name")))
    place = F.struct("turn", (-F.col("n")).alias("less"), "name")
    one = every.groupBy("key", "akey").agg(F.min(place).alias("place"), F.max_by("name", F.struct("case", (-F.col("turn")).alias("t"), "n", "name")).alias("name"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("place", "name"))), lambda x: x["name"])
    return one.groupBy("key").agg(F.slice(ordered, 1, 5).alias("alternates"))


def merge_pairs(table: DataFrame) -> DataFrame:
    """(a, b) keys of rows that may name one work: a shared entity, or a ratio of 90 (96 if both are confirmed), with equal
    numbers in them."""
    r = table.select("key", "confirmed", F.map_keys(F.coalesce("entities", F.create_map().cast("map<string,bigint>"))).alias("ids"), F.regexp_extract_all("key", F.lit(r"\d+"), F.lit(0)).alias("digits"))
    ids = r.select("key", F.explode("ids").alias("id"))
    shared = ids.join(ids.select(F.col("key").alias("other"), "id"), "id").where("key <> other").select("key", "other", F.lit(True).alias("work")).distinct()
    near = settled(similar(r, [], "key", TYPO).select(F.col("a").alias("key"), F.col("b").alias("other"), "ratio"))
    near = near.unionByName(near.select(F.col("other").alias("key"), F.col("key").alias("other"), "ratio"))
    every = near.join(shared, ["key", "other"], "full").join(r, "key").join(r.select(F.col("key").alias("other"), F.col("confirmed").alias("other_confirmed"), F.col("digits").alias("other_digits")), "other")
    ok = F.coalesce("work", F.lit(False)) | (F.coalesce("ratio", F.lit(0.0)) >= SURE_TYPO) | (~(F.col("confirmed") & F.col("other_confirmed")) & F.col("ratio").isNotNull())
    return every.where((F.col("digits") == F.col("other_digits")) & (F.char_length("other") >= 6) & ok).select(F.col("key").alias("a"), F.col("other").alias("b"))


def merged(table: DataFrame) -> DataFrame:
    """``table`` with rows of one work merged into the strongest. Only rows that pair with another go through the ordered
    step, each connected component of them by itself; the rest of the table is untouched by it."""
    table = settled(table)
    pairs = settled(merge_pairs(table))
    own = components(pairs)
    some = own.join(table.select(F.col("key").alias("node"), "videos", "commenters"), "node")
    linked = some.select("root", F.col("node").alias("key"), "videos", "commenters").join(pairs.groupBy(F.col("a").alias("key")).agg(F.collect_set("b").alias("others")), "key", "left")

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["videos", "commenters", "key"], ascending=[False, False, True])
        links = {(key, other) for key, others in zip(pdf["key"], pdf["others"]) if others is not None for other in others}
        return pd.DataFrame(list(merge_order(pdf, links).items()), columns=["key", "into"])

    into = linked.groupBy("root").applyInPandas(work, "key string, into string")
    return _combine(table.join(into, "key", "left").withColumn("into", F.coalesce("into", "key")))


def _combine(t: DataFrame) -> DataFrame:
    """Rows summed by ``into``; the row of that key gives the names, unless only another is confirmed."""
    maps = {}
    for name, key in (("genres", "g"), ("languages", "l"), ("entities", "e")):
        maps[name] = histogram(t.select("into", F.explode(name).alias(key, "n")), ["into"], key, name, F.col("n"))
    own = F.struct(F.col("confirmed").cast("int"), (F.col("key") == F.col("into")).cast("int"), F.col("videos"))
    out = t.groupBy("into").agg(
        *(F.sum(c).alias(c) for c in ("videos", "commenters", "likes", "demand", "views")), F.max("confirmed").alias("confirmed"),
        F.max_by(F.struct("title", "kind", "year", "url"), own).alias("best"), F.max_by(F.struct("confidence", "variants"), (F.col("key") == F.col("into")).cast("int")).alias("main"),
        F.array_sort(F.collect_list(F.when(F.col("key") != F.col("into"), F.col("title")))).alias("others"), F.slice(F.array_distinct(F.flatten(F.collect_list("alternates"))), 1, 5).alias("alternates"),
    )
    for part in maps.values():
        out = out.join(part, "into", "left")
    return out.select(F.col("into").alias("key"), "best.title", "videos", "commenters", "likes", "demand", "views", "main.confidence", "genres", "languages", "entities", "confirmed", F.concat("main.variants", "others").alias("variants"), "alternates", "best.kind", "best.year", "best.url")


def build(sweep: DataFrame, freq: DataFrame, cache: DataFrame | None = None, floor: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """(rows, rejected): ranked report rows, and answers that every database contradicts and no comment states."""
    found = answers_of(sweep, floor).cache()
    if cache is None:
        entity = f"struct<{', '.join(x.replace(' ', ': ', 1) for x in ENTITY_FIELDS)}>"
        checked = found.withColumn("entity", F.lit(None).cast(entity)).withColumn("status", F.lit("unconfirmed"))
    else:
        context = F.concat_ws(" ", F.coalesce("query", F.lit("")), F.coalesce("title", F.lit("")))
        videos = found.select("vid", F.col("shown").alias("title"), T.segments_of(context).alias("segments"), context.alias("context"))
        videos = videos.withColumn("live", titledb.live_action(F.col("segments"), F.col("context"))).drop("context")
        chosen = titledb.choose(videos, titledb.lookup(videos.select("title"), cache)).select("vid", F.col("title").alias("shown"), "entity", "status")
        checked = found.join(chosen, ["vid", "shown"])
    stated = F.exists("top.sources", lambda s: F.startswith(s, F.lit("comments")))
    drop = (F.col("status") == "contradicted") & ~stated
    kept = settled(checked.where(~drop))
    if cache is not None:
        kept = T.with_group_key(kept.withColumn("_name", F.col("entity.name")), "_name", "_ekey")
        kept = kept.withColumn("key", F.when(F.col("entity.primary"), F.col("_ekey")).otherwise(F.col("key"))).drop("_name", "_ekey")
    table = merged(rows(kept, freq)).where("commenters >= 1")
    if cache is not None:
        # an ordinary word that no database knows is no title
        plain = freq.where(F.col("zipf") >= ORDINARY).select(F.col("word").alias("tkey"), F.lit(True).alias("plain"))
        table = T.with_group_key(table, "title", "tkey").join(plain, "tkey", "left").where("confirmed or plain is null").drop("tkey", "plain")
    ranked = table.withColumn("rank", F.row_number().over(W.partitionBy("confirmed").orderBy(F.desc("videos"), F.desc("commenters"), F.desc("likes"), "key")))
    return ranked, checked.where(drop).select("vid", "shown", "query")


ENTITY_FIELDS = "source string, id string, name string, names array<string>, kind string, country string, year int, url string, spanish boolean, rank int, searched boolean, popularity bigint, primary boolean".split(", ")


def totals(sweep: DataFrame, ranked: DataFrame | None = None) -> DataFrame:
    """One row of totals over all videos; with the report's rows also ``distinct_titles``: the confirmed ones, or all if none
    could be confirmed."""
    high = F.coalesce(F.get("answers", F.lit(0))["conf"] == "high", F.lit(False))
    asked = F.coalesce("asked", F.lit(0))
    foreign = F.aggregate(F.map_entries(F.coalesce("langs", F.create_map().cast("map<string,bigint>"))), F.lit(0).cast("long"), lambda s, x: s + F.when(x["key"] != "en/other", x["value"]).otherwise(0))
    out = sweep.agg(
        F.count("*").alias("videos"), F.sum(F.coalesce("n_comments", F.lit(0))).alias("comments"), F.sum(asked).alias("people_asking"), F.count_if(asked > 0).alias("videos_with_demand"),
        F.count_if(high).alias("videos_answered_high"), F.count_if((asked > 0) & ~high).alias("demand_gap"), F.coalesce(F.sum(foreign), F.lit(0)).alias("non_english_comments"),
    )
    if ranked is None:
        return out
    n = F.when(F.count_if("confirmed") > 0, F.count_if("confirmed")).otherwise(F.count("*"))
    return out.join(ranked.agg(n.alias("distinct_titles")).withColumn("_one", F.lit(1)), F.lit(1) == F.col("_one")).drop("_one")


def languages(sweep: DataFrame, top: int = 12) -> DataFrame:
    """(lang, comments, reach, comments_rank, reach_rank): comments by language, and the videos with three or more of a language
    other than English; the ``top`` languages by either, with the ranks (no more than a few languages are ranked)."""
    each = sweep.select("vid", F.explode("langs").alias("lang", "n"))
    reach = F.count_if((F.col("lang") != "en/other") & (F.col("n") >= 3))
    counted = each.groupBy("lang").agg(F.sum("n").alias("comments"), reach.alias("reach"))
    place = lambda c: F.row_number().over(W.orderBy(F.desc(c), "lang"))
    ranked = counted.withColumns({"comments_rank": place("comments"), "reach_rank": F.when(F.col("reach") > 0, place("reach"))})
    return ranked.where((F.col("comments_rank") <= top) | (F.col("reach_rank") <= top)).orderBy("comments_rank")


def gap(sweep: DataFrame, top: int = 10) -> DataFrame:
    """The videos most asked about without a sure answer."""
    high = F.coalesce(F.get("answers", F.lit(0))["conf"] == "high", F.lit(False))
    return sweep.where((F.coalesce("asked", F.lit(0)) > 0) & ~high).orderBy(F.desc("asked"), "vid").limit(top).select("title", "asked")


def by_genre(sweep: DataFrame) -> DataFrame:
    return sweep.groupBy(T.genre_of(F.col("query")).alias("genre")).agg(F.count("*").alias("videos"))


def by_kind(ranked: DataFrame) -> DataFrame:
    return ranked.where("confirmed").groupBy("kind").agg(F.sum("videos").alias("videos"))
