"""Word frequency as a table (word, zipf), and what is derived from it: how ordinary a span's wording is."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions import text as T
from ..functions.lineage import sent, settled


def frequencies(texts: DataFrame, column: str = "text") -> DataFrame:
    """(word, zipf) of a corpus: log10 of a word's count in a thousand million words."""
    counts = texts.select(F.explode(T.words_of(T.fold(F.col(column)))).alias("word")).where("word <> ''").groupBy("word").agg(F.count("*").alias("n"))
    counts = settled(counts)  # the total and every look-up read it
    total = counts.agg(F.sum("n")).scalar()
    return counts.select("word", F.log10(F.col("n") * 1e9 / total).alias("zipf"))


def known(each: DataFrame, freq: DataFrame, column: str = "word") -> DataFrame:
    """The rows of ``freq`` for the words of ``each``: an inner join, in which the smaller side is the one sent."""
    return freq.join(sent(settled(each.select(F.col(column).alias("word")).where("word is not null").distinct())), "word")


def ambiguity(spans: DataFrame, freq: DataFrame, column: str = "span") -> DataFrame:
    """(span, ambiguity) of the distinct ``spans``: the rarest content word's frequency, less 1.2 for each further content
    word; without content words, the commonest word's frequency. Unknown words have frequency zero."""
    distinct = spans.select(F.col(column).alias("span")).distinct().withColumn("_folded", T.fold(F.col("span")))
    each = settled(distinct.select("span", F.explode_outer(T.words_of(F.col("_folded"))).alias("word")))
    content = F.col("word").isNotNull() & ~T.is_in(F.col("word"), tuple(dict.fromkeys(L.TITLE_STOPWORDS + L.FUNCTION_WORDS + L.VERB_WORDS)))
    z = F.coalesce("zipf", F.lit(0.0))
    found = each.join(known(each, freq), "word", "left").groupBy("span").agg(
        F.count_if(content).alias("n"), F.min(F.when(content, z)).alias("rarest"), F.max(F.when(F.col("word").isNotNull(), z)).alias("most")
    )
    return found.select("span", F.when(F.col("n") > 0, F.col("rarest") - 1.2 * (F.col("n") - 1)).otherwise(F.coalesce("most", F.lit(0.0))).alias("ambiguity"))


def with_ambiguity(df: DataFrame, freq: DataFrame, column: str) -> DataFrame:
    return df.join(ambiguity(df, freq, column).withColumnRenamed("span", column), column, "left")


def lexical_share(names: DataFrame, freq: DataFrame, column: str = "name") -> DataFrame:
    """(name, lexical): the share of a name's alphabetic words that the frequency table knows."""
    each = names.select(F.col(column).alias("name")).distinct().withColumn("_folded", T.fold(F.col("name")))
    each = each.select("name", F.explode_outer(F.filter(T.words_of(F.col("_folded")), lambda w: w.rlike(r"^\p{L}+$"))).alias("word"))
    known = each.join(freq.where("zipf > 0"), "word", "left")
    return known.groupBy("name").agg(F.coalesce(F.count("zipf") / F.nullif(F.count("word"), F.lit(0)), F.lit(0.0)).alias("lexical"))
