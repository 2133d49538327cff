"""Quality rules: text statistics, and a hashed n-gram log-likelihood ratio between a trusted target and the raw corpus.

The ratio is of two multinomials over hashed words and word pairs (``hashed``), normalised for length, and a document is
kept if it reaches one threshold. The rule is deterministic: the same tables give the same verdicts in any partitioning.

Defined cases: a null text has no words and fails the base rules; repeated rows get equal verdicts; documents without
labels, null labels and null ids are part of the raw corpus only; further columns of the input are ignored. An empty
table gives no rows; without labels every document that passes the base rules is kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import rows_of, slices, words
from .hashed import model

#: Characters that count as symbols; a fixed value.
SYMBOLS = r"[#*$%&|<>]"
LEAST_WORDS = 50
MOST_REPEATED = 50
_SPACE = " \t\r\x0b\x0c"


def repeated_words(offsets: np.ndarray, codes: np.ndarray, size: int = 3) -> np.ndarray:
    """For each row, how many of its words lie in a window of ``size`` words that the row has twice or more."""
    n = len(codes)
    if n < size:
        return np.zeros(len(offsets) - 1, np.int64)
    row = rows_of(offsets)
    gram, base = codes[: n - size + 1], int(codes.max()) + 1
    for i in range(1, size):
        if int(gram.max()) >= (1 << 62) // base:
            gram = np.unique(gram, return_inverse=True)[1]
        gram = gram * base + codes[i : n - size + 1 + i]
    at = np.flatnonzero(row[: n - size + 1] == row[size - 1 :])
    order = at[np.lexsort((gram[at], row[at]))]
    same = (gram[order[1:]] == gram[order[:-1]]) & (row[order[1:]] == row[order[:-1]])
    again = np.zeros(len(order), bool)
    again[1:] |= same
    again[:-1] |= same
    edge = np.zeros(n + 1, np.int64)
    edge[order[again]] += 1
    edge[order[again] + size] -= 1
    covered = np.concatenate([[0], np.cumsum(np.cumsum(edge[:-1]) > 0)])
    return covered[offsets[1:]] - covered[offsets[:-1]]


def statistics(texts: pa.Array) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each text."""
    offsets, codes, distinct = words(texts)

    def total(of_word: pa.Array) -> np.ndarray:
        s = np.concatenate([[0], np.cumsum(np.asarray(of_word).astype(np.int64)[codes])])
        return s[offsets[1:]] - s[offsets[:-1]]

    dup = []
    for text in texts.to_pylist():
        lines = [x for x in (text or "").split("\n") if x.strip(_SPACE)]
        dup.append(len(lines) - len(set(lines)))
    return {
        "n_words": np.diff(offsets),
        "word_chars": total(pc.utf8_length(distinct)),
        "n_symbols": total(pc.count_substring_regex(distinct, SYMBOLS)),
        "n_dup_lines": np.array(dup, np.int64),
        "n_repeat_words": repeated_words(offsets, codes),
    }


def judge(docs: DataFrame, labels: DataFrame, clean_loss: float = 0.005) -> DataFrame:
    """(doc_id, the statistics, base_failed, score, kept) for every row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model(docs, labels, clean_loss=clean_loss))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, most=4 << 20):
                s = statistics(part.column("text"))
                failed = (s["n_words"] < LEAST_WORDS) | (100 * s["n_repeat_words"] > MOST_REPEATED * s["n_words"])
                value = shared.value.score(part.column("text"))
                columns = [part.column("doc_id").cast(pa.int64()), *map(pa.array, s.values()), pa.array(failed), pa.array(value), pa.array(~failed & (value >= shared.value.threshold))]
                yield pa.record_batch(columns, names=["doc_id", *s, "base_failed", "score", "kept"])

    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, score double, kept boolean"
    return docs.select("doc_id", "text").mapInArrow(work, schema)
