"""Catalogue mentions in comments: candidate spans, resolution to a title, contextual evidence, one mention a comment.

Every step is a join or an expression over all comments at once. What a text mentions depends on it alone, so it is found
once for each distinct text; spans are resolved once for each distinct key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions import patterns as P
from ..functions import similarity as S
from ..functions import text as T
from ..functions.lineage import sent, settled, texts_of
from . import words
from .catalogue import Catalogue

LEAST_FUZZY_LENGTH = 5
FUZZY_RATIO = 88.0
AMBIGUOUS = 2.2
BAR = 2
FLOOR = -2
COMMENT = ["video_id", "seq"]


def cleaned(comments: DataFrame) -> DataFrame:
    """Comments with their cleaned text (``body``), its folded form and words; those left empty go."""
    out = comments.withColumn("body", T.clean(F.coalesce("text", F.lit("")))).where("body <> ''")
    out = out.withColumn("folded", T.fold(F.col("body"))).withColumn("words", T.words_of(F.col("folded")))
    return out.cache()  # every branch of candidates and the evidence read it


def _matches(body: DataFrame, branch: int, pattern: str, group: int) -> DataFrame:
    found = body.select(*COMMENT, F.posexplode(F.regexp_extract_all("body", F.lit(pattern), F.lit(group))).alias("pos", "span"))
    return found.select(*COMMENT, F.lit(branch).alias("branch"), F.col("pos").cast("long").alias("pos"), "span")


def grams(body: DataFrame, longest: int) -> DataFrame:
    """(video_id, seq, n, at, gram) of all runs of up to ``longest`` folded words."""
    return body.select(*COMMENT, F.inline(T.ngrams(F.col("words"), longest)))


def blocked(keys: DataFrame, cat: Catalogue, shared: int) -> DataFrame:
    """(key, alias) pairs that share ``shared`` trigrams or more, by one equi join on trigrams."""
    own = keys.select("key", F.explode(T.trigrams(F.col("key"))).alias("tri"))
    return own.join(cat.trigram.withColumnRenamed("key", "alias"), "tri").groupBy("key", "alias").agg(F.count("*").alias("n")).where(F.col("n") >= shared).select("key", "alias")


def candidates(body: DataFrame, cat: Catalogue) -> DataFrame:
    """(video_id, seq, branch, pos, span) in order: quoted, after a cue, exact n-grams (longest first), tokens in
    capitals, n-grams that block against an alias."""
    gram = grams(body, cat.longest).cache()
    known = gram.join(cat.alias.select(F.col("key").alias("gram")), "gram", "left_semi")
    exact = known.select(*COMMENT, F.lit(2).alias("branch"), ((F.lit(cat.longest) - F.col("n")) * 1_000_000 + F.col("at")).cast("long").alias("pos"), F.col("gram").alias("span"))
    loose = gram.where((F.char_length("gram") >= LEAST_FUZZY_LENGTH) & ~F.forall(F.split("gram", " "), lambda w: T.is_in(w, L.STOPLIKE)))
    loose = loose.join(cat.alias.select(F.col("key").alias("gram")), "gram", "left_anti")
    near = blocked(loose.select(F.col("gram").alias("key")).distinct(), cat, 3).select(F.col("key").alias("gram")).distinct()
    fuzzy = loose.join(near, "gram").select(*COMMENT, F.lit(4).alias("branch"), (F.col("n") * 1_000_000 + F.col("at")).cast("long").alias("pos"), F.col("gram").alias("span"))
    return (
        _matches(body, 0, P.QUOTED_SPAN, 1).union(_matches(body, 1, P.rx(P.CUE_AFTER), 1)).union(exact)
        .union(_matches(body, 3, P.rx(P.CAPS_TOKEN, False), 0)).union(fuzzy)
    )


def resolve(keys: DataFrame, cat: Catalogue, freq: DataFrame) -> DataFrame:
    """(key, canonical, method, score) of the distinct ``keys`` that name a title: exactly, else by a unique acronym, else
    by the best alias at a ratio of 88 or more (ties to the first in the alphabet), for spans that are not plain English."""
    keys = keys.select("key").distinct().where((F.col("key") != "") & ~T.is_in(F.col("key"), L.STOPLIKE)).cache()
    exact = keys.join(cat.alias, "key").select("key", "canonical", F.lit("exact").alias("method"), F.lit(100.0).alias("score"))
    rest = keys.join(cat.alias, "key", "left_anti").withColumn("glued", F.replace("key", F.lit(" "), F.lit("")))
    short = rest.where("char_length(glued) between 2 and 6").join(cat.acronym.withColumnRenamed("key", "glued"), "glued")
    acronym = short.select("key", "canonical", F.lit("acronym").alias("method"), F.lit(95.0).alias("score"))
    rest = rest.join(acronym.select("key"), "key", "left_anti").where(F.char_length("key") >= LEAST_FUZZY_LENGTH)
    rest = words.with_ambiguity(rest.select("key"), freq, "key").where(F.col("ambiguity") < AMBIGUOUS).cache()
    pairs = blocked(rest.select("key"), cat, 2).where(S.can_reach(F.col("key"), F.col("alias"), FUZZY_RATIO)).withColumn("score", S.ratio("key", "alias")).where(F.col("score") >= FUZZY_RATIO)
    best = pairs.withColumn("_n", F.row_number().over(W.partitionBy("key").orderBy(F.desc("score"), "alias"))).where("_n = 1")
    length = F.abs(F.char_length("alias") - F.char_length("key")) <= F.greatest(F.lit(4.0), 0.4 * F.char_length("alias"))
    count = F.abs(F.size(F.split("alias", " ")) - F.size(F.split("key", " "))) <= 1
    fuzzy = best.where(length & count).join(cat.alias.withColumnRenamed("key", "alias"), "alias").select("key", "canonical", F.lit("fuzzy").alias("method"), "score")
    return exact.union(acronym).union(fuzzy)


def _any_word(words_: Column, values) -> Column:
    return F.exists(words_, lambda w: T.is_in(w, values))


def next_word(words_: Column, span: Column) -> Column:
    """The word after the first occurrence of the span's words."""
    n = F.size(span)
    at = F.filter(F.when(F.size(words_) >= n, F.sequence(F.lit(1), F.size(words_) - n + 1)).otherwise(F.array().cast("array<int>")), lambda i: F.slice(words_, i, n) == span)
    return F.get(words_, F.get(at, F.lit(0)) - 1 + n)


def evidence(pairs: DataFrame, freq: DataFrame) -> DataFrame:
    """``pairs`` (key, body, words, ...) with ``evidence`` (without the companion's) and ``reasons``.

    A folded key is letters, digits and spaces, so a pattern may be built from it as it is."""
    span, body, words_ = F.split("key", " "), F.col("body"), F.col("words")
    glued = F.replace("key", F.lit(" "), F.lit(""))
    first = F.call_function("regexp_extract", body, F.concat(F.lit(r"(?iU)\b"), glued, F.lit(r"\b")), F.lit(0))
    caps = (F.char_length(glued) <= 6) & T.is_upper(first)
    spaced = F.concat(F.lit(r"(?iU)\b"), F.array_join(span, r"[\s\-_'’]*"), F.lit(r"\b"))
    capitalised = ~T.is_shouting(body) & F.exists(F.regexp_extract_all(body, spaced, F.lit(0)), T.starts_upper)
    inner = F.concat(F.regexp_extract_all(body, F.lit(P.PAIRED_QUOTE), F.lit(1)), F.regexp_extract_all(body, F.lit(P.PAIRED_QUOTE), F.lit(2)))
    follows = pairs.withColumn("_next", next_word(words_, span)).withColumn("_quotes", F.array_join(inner, " _ "))
    quotes = follows.select("_quotes").distinct().where("_quotes <> ''").withColumn("_folded_quotes", T.fold(F.col("_quotes")))
    follows = follows.join(quotes, "_quotes", "left")
    known = tuple(dict.fromkeys(L.FUNCTION_WORDS + L.VERB_WORDS + L.MEDIA_WORDS + L.CUE_WORDS + L.SERIAL_WORDS + L.DOMAIN_WORDS))
    follows = settled(follows)
    follows = follows.join(words.known(follows, freq, "_next").select(F.col("word").alias("_next"), F.col("zipf").alias("_zipf")), "_next", "left")
    compound = F.col("_next").isNotNull() & ~T.is_in(F.col("_next"), known) & ~F.col("_next").rlike(r"^\p{Nd}+$") & (F.coalesce("_zipf", F.lit(0.0)) >= 1.5)
    signs = [
        (caps, 3, F.lit("acronym-form")), (~caps & capitalised, 3, F.lit("capitalised")), (_any_word(words_, L.MEDIA_WORDS), 2, F.lit("media-word")),
        (_any_word(words_, L.CUE_WORDS), 2, F.lit("cue")), (F.coalesce(F.contains("_folded_quotes", F.col("key")), F.lit(False)), 3, F.lit("quoted")),
        (_any_word(words_, L.DOMAIN_WORDS), 2, F.lit("domain")), (body.rlike(P.YEAR_IN_BRACKETS), 2, F.lit("year")),
        (body.rlike(P.BY_AUTHOR), 2, F.lit("author")), (compound, -3, F.concat(F.lit("compound:"), F.col("_next"))),
    ]
    total = sum((F.when(c, points).otherwise(0) for c, points, _ in signs), F.lit(0))
    out = follows.withColumns({"evidence": total, "reasons": F.array_compact(F.array(*(F.when(c, why) for c, _, why in signs)))})
    return out.drop("_next", "_zipf", "_quotes", "_folded_quotes")


def accepted(df: DataFrame) -> DataFrame:
    """``df`` (video_id, seq, method, ambiguity, evidence, ...) that pass, after a companion's two points: a title of the
    comment that passes by itself in distinctive wording, exactly or by acronym."""
    bar = F.when(F.col("ambiguity") >= AMBIGUOUS, BAR).otherwise(FLOOR)
    alone = F.col("method").isin("exact", "acronym") & (F.col("ambiguity") < AMBIGUOUS) & (F.col("evidence") >= bar)
    out = df.withColumn("anchored", F.max(alone.cast("int")).over(W.partitionBy(*COMMENT)) == 1)
    out = out.withColumn("evidence", F.col("evidence") + F.when(F.col("anchored"), 2).otherwise(0))
    out = out.withColumn("reasons", F.when(F.col("anchored"), F.array_append("reasons", F.lit("companion-title"))).otherwise(F.col("reasons")))
    return out.where(F.col("evidence") >= bar)


def mentions(comments: DataFrame, cat: Catalogue, freq: DataFrame) -> DataFrame:
    """(video_id, seq, id, author, text, raw, canonical, kind, method, score, ambiguity, evidence, reasons): one a comment
    and title, the first candidate that passes."""
    texts = texts_of(comments)
    each = settled(_mentions(texts, cat, freq).join(texts.select("seq", F.col("text").alias("said")), "seq").drop("seq", "video_id"))
    said = comments.select(*COMMENT, "id", "author", F.col("text").alias("said")).join(sent(each), "said")
    return said.select(*COMMENT, "id", "author", *each.drop("said").columns)


def _mentions(texts: DataFrame, cat: Catalogue, freq: DataFrame) -> DataFrame:
    body = cleaned(texts)
    spans = T.with_span_key(candidates(body, cat)).cache()
    found = settled(spans.join(resolve(spans, cat, freq), "key"))
    context = body.select(*COMMENT, "body", "words")
    pairs = found.select(*COMMENT, "key").distinct().join(context, COMMENT)
    weighed = settled(words.with_ambiguity(evidence(pairs, freq), freq, "key"))
    ready = found.select(*COMMENT, "key", "branch", "pos", "canonical", "method", "score").join(weighed, [*COMMENT, "key"])
    one = W.partitionBy(*COMMENT, "canonical").orderBy("branch", "pos", "key")
    out = accepted(ready).withColumn("_n", F.row_number().over(one)).where("_n = 1").join(cat.titles.select("canonical", "kind"), "canonical")
    return out.select(*COMMENT, F.col("body").alias("text"), F.col("key").alias("raw"), "canonical", "kind", "method", "score", F.round("ambiguity", 2).alias("ambiguity"), "evidence", "reasons")
