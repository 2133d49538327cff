"""Hashed word n-gram multinomials: the features and counts that the quality rules and the quality classifier share.

A text's features are its lower-cased (A-Z) words, hashed into ``WORDS`` buckets, and the pairs of neighbouring words,
hashed into ``PAIRS`` further ones. Words and pairs are two multinomials, each normalised by itself. Counts are summed per
task before any shuffle, so what is moved is at most one number per bucket, task and model, and what the driver gets is one
per bucket and model, however long the texts are and however many.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, hashes, kth_key, mix, ordered, rows_of, slices, stage, unordered, words

WORDS = 1 << 20
PAIRS = 1 << 18
BUCKETS = WORDS + PAIRS
#: A word speaks against a text if it is in so many toxic documents, and in so many times more than clean ones suggest.
LEAST_TOXIC = 3
MORE_TOXIC = 8
#: How far below the threshold a toxic text's score is put; beyond what Gumbel noise makes up for.
REJECT = 1.0
#: Features of ratio one that every text is given, so that short texts score near zero.
PRIOR = 20
#: Longs of the filter of labelled ids, which is broadcast.
FILTER_WORDS = 1 << 20


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row offsets into the features, and the features' buckets. A row of n words has max(0, 2n - 1) features: word,
    pair with the next word, word, ..., word."""
    offsets, codes, distinct = words(texts, lower=True)
    h = hashes(distinct)
    n = np.diff(offsets)
    both = np.empty(2 * len(codes), np.int64)
    both[0::2] = (h & np.uint64(WORDS - 1)).astype(np.int64)[codes]
    if len(codes):
        h = h[codes]
        both[1:-1:2] = WORDS + (mix(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:]) & np.uint64(PAIRS - 1)).astype(np.int64)
    keep = np.ones(len(both), bool)
    keep[2 * offsets[1:][n > 0] - 1] = False
    return np.concatenate([[0], np.cumsum(np.maximum(0, 2 * n - 1))]), both[keep]


def counts(docs: DataFrame, weights: list[str]) -> np.ndarray:
    """For each of the boolean columns ``weights`` of ``docs``, how often each bucket occurs in its rows' texts:
    an array of shape (len(weights), BUCKETS)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(weights), BUCKETS), np.int64)
        for batch in batches:
            for part in slices(batch, most=4 << 20):
                offsets, found = features(part.column("text"))
                size = np.diff(offsets)
                for i, w in enumerate(weights):
                    on = np.repeat(np.asarray(part.column(w).fill_null(False)), size)
                    total[i] += np.bincount(found[on], minlength=BUCKETS)
        give_back()
        some = np.flatnonzero(total.any(0))
        yield pa.record_batch([pa.array(some.astype(np.int32)), *(pa.array(t[some]) for t in total)], names=["bucket", *(f"n{i}" for i in range(len(weights)))])

    names = [f"n{i}" for i in range(len(weights))]
    got = docs.select("text", *weights).mapInArrow(work, "bucket int, " + ", ".join(f"{n} long" for n in names))
    summed = got.groupBy("bucket").agg(*(F.sum(n).alias(n) for n in names)).toArrow()  # at most one row per bucket
    out = np.zeros((len(weights), BUCKETS), np.int64)
    for i, n in enumerate(names):
        out[i, summed["bucket"].to_numpy()] = summed[n].to_numpy()
    return out


def log_ratio(target: np.ndarray, raw: np.ndarray, smooth: float = 1.0) -> np.ndarray:
    """log p_target - log p_raw of each bucket. Both multinomials are smoothed additively, the raw one by ``smooth`` times
    the ratio of the totals, so that a bucket with no evidence has the ratio one."""
    out = np.zeros(BUCKETS)
    for part in (slice(0, WORDS), slice(WORDS, BUCKETS)):
        t, r = target[part], raw[part]
        if t.sum() and r.sum():
            out[part] = np.log(t + smooth) - np.log(r * (t.sum() / r.sum()) + smooth)
    return out


def sums(offsets: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The sum of each row's values."""
    total = np.concatenate([[0.0], np.cumsum(values)])
    return total[offsets[1:]] - total[offsets[:-1]]


def score(texts: pa.Array, ratio: np.ndarray) -> np.ndarray:
    """The log-likelihood ratio of each text, normalised for length: the mean over its features and ``PRIOR`` neutral ones.
    Zero for texts without words."""
    offsets, found = features(texts)
    return sums(offsets, ratio[found].astype(np.float64)) / (PRIOR + np.diff(offsets))


def word_documents(docs: DataFrame, weights: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """For each of the boolean columns ``weights`` of ``docs``, the number of its rows, and in how many of them each word
    bucket occurs: shapes (len(weights),) and (len(weights), WORDS)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(weights), WORDS + 1), np.int64)
        for batch in batches:
            for part in slices(batch, most=4 << 20):
                offsets, found = features(part.column("text"))
                word = found < WORDS
                key = np.unique(rows_of(offsets)[word] * WORDS + found[word])
                for i, w in enumerate(weights):
                    on = np.asarray(part.column(w).fill_null(False)).astype(bool)
                    total[i, :WORDS] += np.bincount((key % WORDS)[on[key // WORDS]], minlength=WORDS)
                    total[i, WORDS] += on.sum()
        give_back()
        some = np.flatnonzero(total.any(0))
        yield pa.record_batch([pa.array(some.astype(np.int32)), *(pa.array(t[some]) for t in total)], names=["bucket", *(f"n{i}" for i in range(len(weights)))])

    names = [f"n{i}" for i in range(len(weights))]
    got = docs.select("text", *weights).mapInArrow(work, "bucket int, " + ", ".join(f"{n} long" for n in names))
    summed = got.groupBy("bucket").agg(*(F.sum(n).alias(n) for n in names)).toArrow()  # at most one row per bucket
    out = np.zeros((len(weights), WORDS + 1), np.int64)
    for i, n in enumerate(names):
        out[i, summed["bucket"].to_numpy()] = summed[n].to_numpy()
    return out[:, WORDS], out[:, :WORDS]


def evidence(size: np.ndarray, documents: np.ndarray) -> np.ndarray:
    """How much each bucket's word speaks against a text, zero or more, from the numbers of clean and toxic documents and
    in how many of them it is. Words that are in few toxic documents, but in clean ones hardly ever, count too."""
    out = np.zeros(BUCKETS)
    if size.all():
        clean, toxic = documents[0] * (size[1] / size[0]), documents[1]
        telling = (toxic >= LEAST_TOXIC) & (toxic >= MORE_TOXIC * clean)
        out[:WORDS][telling] = np.log(toxic[telling] / (clean[telling] + 0.2))
    return out


def against(texts: pa.Array, weight: np.ndarray) -> np.ndarray:
    """The sum of the evidence of each text's distinct words, divided by the square root of its number of words."""
    offsets, found = features(texts)
    at = np.flatnonzero(weight[found])
    key = np.unique(rows_of(offsets)[at] * BUCKETS + found[at])
    total = np.bincount(key // BUCKETS, weight[key % BUCKETS], minlength=len(texts))
    return total / np.sqrt(1 + (np.diff(offsets) + 1) // 2)


@dataclass
class Model:
    """Log ratio by bucket with the least score kept, and evidence of toxic text by bucket with the most of it kept."""

    ratio: np.ndarray
    threshold: float
    toxic: np.ndarray
    most: float

    def score(self, texts: pa.Array) -> np.ndarray:
        """``score``, but below the threshold by REJECT or more where the evidence against a text is more than allowed."""
        value = score(texts, self.ratio)
        return np.where(against(texts, self.toxic) > self.most, np.minimum(value, self.threshold) - REJECT, value)


def quantiles(texts: DataFrame, ratio: np.ndarray, toxic: np.ndarray, share: float) -> tuple[float, float] | None:
    """Of the scores of ``texts`` and of the evidence against them, those that ``share`` of the texts are below, or above; None
    without texts. Found by radix selection over stored numbers, of which none are gathered."""
    shared = texts.sparkSession.sparkContext.broadcast((ratio, toxic))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, most=4 << 20):
                column = part.column("text")
                yield pa.record_batch([pa.array(ordered(score(column, shared.value[0]))), pa.array(ordered(against(column, shared.value[1])))], names=["score", "toxic"])

    got = stage(texts.select("text").mapInArrow(work, "score long, toxic long"), "scores")
    n = got.count()
    if not n:
        return None
    lost = int(share * n)
    return unordered(kth_key(got, "score", n - lost)), unordered(kth_key(got, "toxic", lost + 1))


def labelled_rows(docs: DataFrame, known: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) joined with ``known`` (doc_id once each, flags) by a shuffle, of tables of any size. Before that
    a bit for each hash of a known id, of which there are at most 64 * FILTER_WORDS, sorts out most other texts: those moved
    are the known ones and some by chance, which the join drops."""
    key = F.xxhash64(F.col("doc_id").cast("long"), F.lit(15))
    place = {"_word": F.pmod(key, F.lit(FILTER_WORDS)).cast("int"), "_bit": F.shiftrightunsigned(key, 58).cast("int")}
    bits = known.select("doc_id").withColumns(place).groupBy("_word").agg(F.bit_or(F.expr("shiftleft(1L, _bit)")).alias("_bits"))
    some = docs.withColumns(place).join(F.broadcast(bits), "_word").where("shiftright(_bits, _bit) & 1 = 1").select(*docs.columns)
    return some.join(known.hint("merge"), "doc_id")


def model(docs: DataFrame, labels: DataFrame, held: int = 5, clean_loss: float = 0.005) -> Model:
    """The model from all of ``docs`` as the raw corpus and, as the trusted target, all those labelled quality 1 and toxic 0;
    their words are compared with those of all that are labelled toxic. One labelled document in ``held`` (by hash of its id)
    is kept out of all counts of labelled ones; of all trusted ones of these, the threshold is the ``clean_loss`` quantile of
    the scores, and at most zero, and the same share may have more evidence of toxic text than is allowed. Without labels
    every ratio and the threshold are zero."""
    good = F.min(F.coalesce((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0), F.lit(False))).alias("_clean")
    bad = F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("_toxic")
    out = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(held)) == 0
    known = labels.where("doc_id is not null").groupBy("doc_id").agg(good, bad).withColumn("_out", out).where("_clean or (_toxic and not _out)")
    labelled = stage(labelled_rows(docs.select("doc_id", "text"), known).drop("doc_id"), "labelled")
    counted = labelled.where("not _out")
    ratio = log_ratio(counts(counted, ["_clean"])[0], counts(docs.withColumn("_raw", F.lit(True)), ["_raw"])[0]).astype(np.float32)
    toxic = evidence(*word_documents(counted, ["_clean", "_toxic"])).astype(np.float32)
    found = quantiles(labelled.where("_out"), ratio, toxic, clean_loss)
    return Model(ratio, min(0.0, found[0]), toxic, found[1]) if found else Model(ratio, 0.0, toxic, float("inf"))
