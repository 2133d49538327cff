"""Text functions: Column to Column. All are native expressions but the first half of ``fold``, which needs Unicode
decomposition and case folding and is an Arrow UDF that goes through a batch in small slices."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from . import lexicon as L
from . import patterns as P

_EDGE = re.compile(r"^[^\w(\[]+|[^\w)\]]+$")
LETTERS_2 = r"[\p{L}]{2}"


def _fold_one(text: str | None) -> str | None:
    if text is None:
        return None
    if text.isascii():
        return text.lower()
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)).casefold()


#: Texts that are Python's strings at one time, of a batch of any size.
SLICE = 64


@F.arrow_udf(StringType())
def _decomposed(texts: pa.Array) -> pa.Array:
    done = []
    for at in range(0, len(texts), SLICE):
        some = texts.slice(at, SLICE)
        odd = pc.invert(pc.string_is_ascii(some)).fill_null(False)
        done.append(pc.replace_with_mask(pc.ascii_lower(some), odd, pa.array(map(_fold_one, some.filter(odd).to_pylist()), some.type)))
    return pa.concat_arrays(done) if done else texts


def collapse(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def fold(c: Column) -> Column:
    """The key of every join on names: decomposed, without marks, case-folded, punctuation as space, spaces collapsed."""
    return collapse(F.regexp_replace(_decomposed(c), r"(?U)[^\p{L}\p{N}_\s]", " "))


def fold_ascii(c: Column) -> Column:
    """``fold`` of text that is known to be ASCII, as a native expression."""
    return collapse(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}_\s]", " "))


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once: inside a lambda, an expression would be computed for every element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def words_of(c: Column) -> Column:
    """The words of a collapsed text; none for an empty one."""
    return F.when(c == "", F.array().cast("array<string>")).otherwise(F.split(c, " "))


def is_in(c: Column, values) -> Column:
    return c.isin(*values)


def clean(c: Column) -> Column:
    """A comment without links, times, emoji and markup."""
    for pattern in (P.rx(P.URL, False), P.rx(P.TIMESTAMP, False), P.EMOJI):
        c = F.regexp_replace(c, pattern, " ")
    for old, new in (("<br>", " "), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        c = F.replace(c, F.lit(old), F.lit(new))
    return collapse(c)


def is_question(c: Column) -> Column:
    return c.rlike(P.QUESTION)


def trim_words(words: Column, junk) -> Column:
    """``words`` from the first to the last that is not junk, joined by a space."""
    return let(words, lambda w: _trimmed(w, junk))


def _trimmed(words: Column, junk) -> Column:
    at = F.filter(F.when(F.size(words) > 0, F.sequence(F.lit(1), F.size(words))).otherwise(F.array().cast("array<int>")), lambda i: ~junk(F.get(words, i - 1)))
    return F.when(F.size(at) == 0, "").otherwise(F.array_join(F.slice(words, F.get(at, F.lit(0)), F.try_element_at(at, F.lit(-1)) - F.get(at, F.lit(0)) + 1), " "))


def without_article(c: Column) -> Column:
    return F.regexp_replace(c, "^(?:" + "|".join(L.LEADING_ARTICLES) + ") ", "")


def strip_noise(folded: Column) -> Column:
    """A folded span without a leading article, and without media and function words at its ends."""
    return trim_words(words_of(without_article(folded)), lambda w: is_in(w, L.MEDIA_WORDS + L.EDGE_FUNCTION) | (F.char_length(w) == 1))


def without_serial(c: Column) -> Column:
    return F.regexp_replace(c, P.rx(L.SERIAL_NOISE), " ")


def with_span_key(df: DataFrame, column: str = "span", name: str = "key") -> DataFrame:
    """``df`` with a span's look-up key. (The folded text is a column first: a Python UDF cannot be part of a lambda.)"""
    return df.withColumn("_folded", fold(without_serial(F.col(column)))).withColumn(name, strip_noise(F.col("_folded"))).drop("_folded")


def trigrams(c: Column) -> Column:
    """Distinct character trigrams of the text without spaces; shorter texts are their own."""
    t = F.replace(c, F.lit(" "), F.lit(""))
    n = F.char_length(t)
    return F.when(n >= 3, F.array_distinct(F.transform(F.sequence(F.lit(1), n - 2), lambda i: F.substr(t, i, F.lit(3))))).when(n > 0, F.array(t)).otherwise(F.array().cast("array<string>"))


def ngrams(words: Column, most: int) -> Column:
    """All runs of 1 to ``most`` words as (n, at, gram)."""
    return let(words, lambda w: _ngrams(w, most))


def _ngrams(words: Column, most: int) -> Column:
    size = F.size(words)
    return F.when(size > 0, F.flatten(F.transform(
        F.sequence(F.lit(1), F.least(F.lit(most), size)),
        lambda n: F.transform(F.sequence(F.lit(0), size - n), lambda i: F.struct(n.alias("n"), i.alias("at"), F.array_join(F.slice(words, i + 1, n), " ").alias("gram"))),
    ))).otherwise(F.array().cast("array<struct<n: int, at: int, gram: string>>"))


def acronym(folded: Column) -> Column:
    return F.array_join(F.transform(F.filter(words_of(folded), lambda w: ~is_in(w, L.ACRONYM_SKIP)), lambda w: F.left(w, F.lit(1))), "")


def starts_upper(w: Column) -> Column:
    first = F.left(w, F.lit(1))
    return (first == F.upper(first)) & (first != F.lower(first))


def is_upper(c: Column) -> Column:
    return (c == F.upper(c)) & (c != F.lower(c))


def is_shouting(c: Column) -> Column:
    letters = F.regexp_replace(c, r"[^\p{L}]", "")
    upper = F.regexp_replace(letters, r"[^\p{Lu}]", "")
    return (F.char_length(letters) >= 8) & (F.char_length(upper) / F.char_length(letters) > 0.7)


def strip_edges(c: Column, characters: str) -> Column:
    return F.regexp_replace(c, f"^[{characters}]+|[{characters}]+$", "")


def clean_slot(c: Column) -> Column:
    """What a frame caught, cut where the title ends; empty if more than eight words are left."""
    s = F.regexp_replace(F.regexp_replace(c, P.SLOT_EMOJI, " "), "^[#@ ]+", "")
    s = F.regexp_replace(strip_edges(F.regexp_replace(s, P.SLOT_TRAIL, ""), P.SLOT_EDGE), r"(?U)\s+", " ")
    return F.when(F.size(words_of(F.trim(s))) > 8, "").otherwise(s)


def is_title_case(c: Column) -> Column:
    """Every significant word capitalised, not ending in a minor word; or all in capitals."""
    w = words_of(F.trim(c))
    big = F.filter(w, lambda x: ~is_in(F.lower(x), L.MINOR_WORDS))
    last = strip_edges(F.lower(F.try_element_at(w, F.lit(-1))), ".,!?")
    return F.when(F.size(w) == 0, False).when(is_upper(c), True).otherwise((F.size(big) > 0) & ~is_in(last, L.MINOR_WORDS) & F.forall(big, starts_upper))


def is_junk(folded: Column) -> Column:
    """Chatter, questions and fragments, by a slot's folded form."""
    w = words_of(folded)
    bare = trim_words_left(w, lambda x: is_in(x, L.DETERMINERS))
    all_junk = lambda a: F.forall(a, lambda x: is_in(x, L.JUNK_SLOTS))
    left = (F.size(bare) > 0) & (F.size(bare) < F.size(w)) & (is_in(F.array_join(bare, " "), L.JUNK_SLOTS) | all_junk(bare))
    return left | (F.char_length(folded) < 3) | is_in(folded, L.JUNK_SLOTS) | F.exists(w, lambda x: is_in(x, L.QUESTION_WORDS)) | all_junk(w)


def trim_words_left(words: Column, junk) -> Column:
    at = F.filter(F.when(F.size(words) > 0, F.sequence(F.lit(1), F.size(words))).otherwise(F.array().cast("array<int>")), lambda i: ~junk(F.get(words, i - 1)))
    return F.when(F.size(at) == 0, F.array().cast("array<string>")).otherwise(F.slice(words, F.get(at, F.lit(0)), F.size(words)))


def is_descriptor(folded: Column) -> Column:
    """A genre ("turkish series"), not a title."""
    w, glued = words_of(folded), F.replace(folded, F.lit(" "), F.lit(""))
    known = is_in(folded, L.GENERIC_TAGS) | is_in(glued, L.GENERIC_TAGS + L.FORM_WORDS)
    mixed = F.exists(w, lambda x: is_in(x, L.NATIONALITY)) & F.forall(w, lambda x: is_in(x, L.NATIONALITY + L.FORM_WORDS))
    return (F.size(w) >= 1) & (F.size(w) <= 3) & (known | mixed)


def looks_like_person(folded: Column) -> Column:
    w = words_of(folded)
    return (F.size(w) >= 2) & (F.size(w) <= 4) & is_in(F.get(w, F.lit(0)), L.FAMILY_NAMES)


def title_score(c: Column, folded: Column) -> Column:
    """How much a span of metadata reads like a work's name, from 0 to 1."""
    w = words_of(F.trim(c))
    n, caps = F.size(w), F.size(F.filter(w, starts_upper))
    score = F.lit(0.5) + F.when(caps >= F.greatest(F.lit(1), n - 2), 0.25).otherwise(0.0) + F.when(c.rlike(r"[?!]$"), 0.05).otherwise(0.0)
    score = score + F.when(n >= 2, 0.1).otherwise(0.0) - F.when(looks_like_person(folded), 0.45).otherwise(0.0)
    return F.when((n < 1) | (n > 9) | (F.char_length(c) < 3) | is_descriptor(folded), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)))


def meta_clean(c: Column) -> Column:
    for pattern in (P.EMOJI, P.HASHTAG, P.META_NOISE):
        c = F.regexp_replace(c, pattern, " ")
    return strip_edges(F.regexp_replace(c, r"(?U)\s+", " "), " \\-–—|:;,.!?\"'")


def case_score(c: Column) -> Column:
    """-1 empty, 0 all capitals, 1 all lower, 3 every word capitalised, 2 else."""
    w = words_of(collapse(c))
    lower = (c == F.lower(c)) & (c != F.upper(c))
    return F.when(F.size(w) == 0, -1).when(is_upper(c), 0).when(lower, 1).when(F.forall(w, starts_upper), 3).otherwise(2)


def _title_clean_one(text: str | None) -> str | None:
    if text is None:
        return None
    t = _EDGE.sub("", text.strip())
    while t and t[-1] in ")]" and t.count(t[-1]) > t.count("(" if t[-1] == ")" else "["):
        t = t[:-1].rstrip()
    return t


@F.pandas_udf(StringType())
def title_clean(texts: pd.Series) -> pd.Series:
    """A title without the punctuation left at its ends, unbalanced closing brackets included."""
    return texts.map(_title_clean_one)


def bare_title(c: Column) -> Column:
    """What is folded for the group key."""
    return F.regexp_replace(title_clean(c), "['’]", "")


def group_key(folded: Column) -> Column:
    """The key that two spellings of one work share, of a folded ``bare_title``: no article, no media words at the end."""
    w = words_of(without_article(folded))
    at = F.filter(F.when(F.size(w) > 0, F.sequence(F.lit(1), F.size(w))).otherwise(F.array().cast("array<int>")), lambda i: ~is_in(F.get(w, i - 1), L.MEDIA_WORDS))
    keep = F.coalesce(F.try_element_at(at, F.lit(-1)), F.lit(1))
    return F.when(F.size(w) == 0, "").otherwise(F.array_join(F.slice(w, F.lit(1), keep), " "))


def with_group_key(df: DataFrame, column: str, name: str) -> DataFrame:
    return df.withColumn("_folded", fold(bare_title(F.col(column)))).withColumn(name, group_key(F.col("_folded"))).drop("_folded")


def alternate_is_clean(c: Column) -> Column:
    w = words_of(collapse(c))
    return (F.size(w) >= 1) & (F.size(w) <= 5) & (F.char_length(c) >= 2) & ~c.rlike(r"[\d@/]") & ~F.exists(w, lambda x: x.rlike(r"^\p{L}$"))


def genre_of(c: Column) -> Column:
    q, out = F.lower(F.coalesce(c, F.lit(""))), F.lit("Other")
    for key, name in reversed(L.GENRES):
        out = F.when(q.contains(key), name).otherwise(out)
    return out


def segments_of(c: Column) -> Column:
    q = F.lower(F.coalesce(c, F.lit("")))
    return F.array_distinct(F.array_compact(F.array(*(F.when(q.contains(k), F.lit(v)) for k, v in L.GENRES))))


def video_id(c: Column) -> Column:
    """The eleven-character id of a video's address; null if there is none."""
    return F.when(c.rlike(r"^[A-Za-z0-9_-]{11}$"), c).otherwise(F.nullif(F.regexp_extract(c, P.VIDEO_ID, 1), F.lit("")))


def title_forms(c: Column) -> Column:
    """The one or two spellings an encyclopedia article would have."""
    small = ("a", "an", "the", "of", "in", "on", "at", "to", "for", "and", "or", "but", "by", "with", "from", "as", "vs")
    t = collapse(c)
    w = words_of(t)
    smart = F.array_join(F.transform(w, lambda x, i: F.when((i > 0) & is_in(F.lower(x), small), F.lower(x)).otherwise(F.concat(F.upper(F.left(x, F.lit(1))), F.substr(x, F.lit(2))))), " ")
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.array(F.concat(F.upper(F.left(t, F.lit(1))), F.substr(t, F.lit(2))), smart)))


def first_match_kind(c: Column, pairs) -> Column:
    """The value of the first pair whose key the lower-cased text contains; null if none."""
    low, out = F.lower(c), F.lit(None).cast("string")
    for key, value in reversed(pairs):
        out = F.when(low.contains(key), value).otherwise(out)
    return out
