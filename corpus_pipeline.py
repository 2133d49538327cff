"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; ``run`` writes each result as
Parquet in the shared folder and reads it back as the next one's documents. All but the last return the columns of
``documents``; ``n_chars`` follows a text that a stage changed.

1. quality: importance resampling; documents that it rejects go.
2. near_duplicates: SimHash over five-word shingles; of each group of documents linked by a Jaccard similarity of 0.8 or
   more, the one with the smallest id stays.
3. substrings: words under a repeated 35-word window go, and documents of which nothing is left.
4. personal_data: spans found are masked by their kind.
5. packing: the documents' pieces, with their places in sequences of 4096 tokens.

Defined cases: a null text is scored, compared and packed like an empty one and stays null until it is packed; of empty and
of repeated rows one stays; null ids are allowed, and a document with an id stays before one without; ties go to the
smallest id; texts of any length are worked on whole; further columns, also such as the stages themselves add, pass through
the first four stages; an empty table gives no rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadlens.llm import packing, pii, resample, rlz, simhash
from threadlens.llm.common import delete, release, scratch_count, shared_dir, table
from threadlens.llm.queries import vocabulary

_last: list[int] = []


def _stage(work):
    """A stage of its own scratch tables: those of the stage before are deleted, whose result has been stored. Columns that
    the stage does not read have names of their own meanwhile, with which what it adds cannot clash."""

    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if _last:
            release(_last.pop())
        _last.append(scratch_count())
        own = [c if c in ("doc_id", "text", "n_chars") else f"_column_{i}" for i, c in enumerate(docs.columns)]
        out = work(spark, docs.toDF(*own), sf_dir)
        return out.toDF(*docs.columns) if out.columns == own else out

    return run_stage


def _changed(docs: DataFrame, out: DataFrame) -> DataFrame:
    """``out`` with n_chars after its new texts, where ``docs`` has that column."""
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


@_stage
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return resample.sample(docs, table(spark, sf_dir, "labels")).select(*docs.columns)


@_stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.near_copies(docs)


@_stage
def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = rlz.remove(docs).where("n_removed = 0 or n_removed < n_words")
    return _changed(docs, found.withColumn("text", F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text"))))


@_stage
def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _changed(docs, pii.redact(docs))


@_stage
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, vocabulary("word_bpe_49k.json"))


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("substrings", substrings),
    ("personal_data", personal_data),
    ("packing", packed),
]

#: Fingerprints, the tagger and the tokenizer have no SQL form; tests/llm/test_pipeline.py has a brute-force one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    before = None
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{folder}/{name}")
        docs = spark.read.schema(out.schema).parquet(f"{folder}/{name}")
        if before:
            delete(spark, f"{folder}/{before}")
        before = name
    release(_last.pop())
    return docs
