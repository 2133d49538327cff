"""Best-fit packing of tokenised documents into fixed-length training sequences, as vector bin packing.

A piece of ``L`` tokens needs the vector (L tokens, 1 document, L*L attention cost) of a sequence's capacities. Pieces
are taken by decreasing length, and each goes to the open sequence in which it fits under every constraint and after
which the weighted norm of the residual vector is least (``rule="norm"``), or with which its weighted dot product is
greatest (``rule="dot"``); a new sequence is opened only if it fits in none.

The need of a piece depends on its length alone, so the packing of a corpus depends on the histogram of lengths alone:
at most ``capacity`` numbers, which the driver gets. Open sequences with equal contents form one class, so that the plan
takes time and memory that depend on the number of lengths, not of documents, and is as good as packing piece by
piece: under the norm rule the sequence that has just got a piece is the fullest in which the next of that length fits,
so equal pieces fill one sequence of a class after another (the dot rule is held to the same order). A plan is a list of runs: ranks g0, g0+1, ... among the pieces of one length go to sequences first,
first + 1, ..., ``k`` in each. Every piece then finds its place from its length and its rank among the pieces of that
length: its rank within its task, plus how many such pieces earlier tasks have. No piece is sorted or moved to another
by the packing itself, so a length that a third of the corpus shares costs no more than any other.

Defined cases: null and empty texts are one piece, the end token; a document longer than the capacity is cut in pieces
of full length, the last of which may be shorter; ties and repeated rows are packed as pieces of their own; null ids are
allowed; further columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import IdCache, slices, stage, words


@dataclass(frozen=True)
class Limits:
    """Capacities of a sequence. With the defaults, only tokens bind: as many documents as tokens, and the attention
    cost of one document over the whole sequence. ``weights`` are of the normalised residuals, in this order."""

    tokens: int = 4096
    documents: int | None = None
    attention: int | None = None
    weights: tuple[float, float, float] = (1.0, 1e-4, 1e-4)
    rule: str = "norm"

    @property
    def longest(self) -> int:
        return min(self.tokens, isqrt(self.cost))

    @property
    def count(self) -> int:
        return self.documents or self.tokens

    @property
    def cost(self) -> int:
        return self.attention or self.tokens**2


@dataclass
class Plan:
    """Runs by length: columns length, g0, first, k, offset, sorted by length and g0; and the number of sequences."""

    runs: np.ndarray
    sequences: int = 0
    begins: np.ndarray = field(init=False)

    def __post_init__(self):
        self.begins = np.searchsorted(self.runs[:, 0], np.arange(self.runs[:, 0].max(initial=0) + 2))

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sequence, offset) of the pieces of these lengths and ranks."""
        seq, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
        order = np.argsort(length, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(length[order])) + 1) if len(order) else []:
            own = self.runs[self.begins[length[part[0]]] : self.begins[length[part[0]] + 1]]
            run = own[np.searchsorted(own[:, 1], rank[part], "right") - 1]
            j = rank[part] - run[:, 1]
            seq[part] = run[:, 2] + j // run[:, 3]
            offset[part] = run[:, 4] + j % run[:, 3] * length[part]
        return seq, offset


def plan(histogram: dict[int, int], limits: Limits = Limits()) -> Plan:
    """The packing of ``histogram[length]`` pieces of each length."""
    cap = np.array([limits.tokens, limits.count, limits.cost], np.float64)
    weight = np.array(limits.weights)
    left = np.zeros((0, 3), np.int64)  # residuals of each class of open sequences
    first, size = np.zeros(0, np.int64), np.zeros(0, np.int64)
    runs, made = [], 0
    for length in sorted(histogram, reverse=True):
        if length > limits.longest:
            raise ValueError(f"a piece of {length} tokens fits in no sequence")
        need, n, rank = np.array([length, 1, length * length]), histogram[length], 0
        live = left[:, 0] > 0
        left, first, size = left[live], first[live], size[live]
        score = _score(left, need, cap, weight, limits.rule)
        while n:
            best = int(np.argmin(score)) if len(score) else -1
            if best < 0 or not np.isfinite(score[best]):
                k = int((np.array([limits.tokens, limits.count, limits.cost]) // need).min())
                bins, start = -(-n // k), made
                rows = [(np.array([limits.tokens, limits.count, limits.cost]), made, bins)]
                made += bins
            else:
                k = int((left[best] // need).min())
                bins, start = min(int(size[best]), -(-n // k)), int(first[best])
                rows = [(left[best], start, int(size[best]))]
                left, first, size, score = (np.delete(x, best, 0) for x in (left, first, size, score))
            before, _, have = rows[0]
            runs.append((length, rank, start, k, limits.tokens - before[0]))
            full, rest = min(bins, n // k), 0
            if full < bins:
                rest = n - full * k
            parts = [(before - k * need, start, full), (before - rest * need, start + full, 1 if rest else 0), (before, start + bins, have - bins)]
            parts = [p for p in parts if p[2]]
            left = np.concatenate([left, np.array([p[0] for p in parts]).reshape(-1, 3)])
            first, size = np.append(first, [p[1] for p in parts]).astype(np.int64), np.append(size, [p[2] for p in parts]).astype(np.int64)
            # a sequence that has just got all it can take fits no more of this length
            score = np.append(score, _score(left[len(score) :], need, cap, weight, limits.rule))
            n -= full * k + rest
            rank += full * k + rest
    table = np.array(runs, np.int64).reshape(-1, 5)
    return Plan(table[np.lexsort((table[:, 1], table[:, 0]))], made)


def _score(left: np.ndarray, need: np.ndarray, cap: np.ndarray, weight: np.ndarray, rule: str) -> np.ndarray:
    fits = (left >= need).all(1)
    if rule == "dot":
        value = -((left / cap) * (need / cap) * weight).sum(1)
    else:
        value = (weight * ((left - need) / cap) ** 2).sum(1)
    return np.where(fits, value, np.inf)


@lru_cache(2)
def word_ids(path: str) -> IdCache:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    return IdCache(lambda words: [e.ids for e in library.encode_batch(words, add_special_tokens=False)])


def encode(texts: pa.Array, path: str, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Row offsets into the ids, and the ids (uint32), of each whole text with the end token after it. The vocabulary
    drops white space before it splits, so each distinct word is encoded once."""
    offsets, codes, distinct = words(texts)
    known = word_ids(path)
    begin, size = known.of(distinct)
    return known.gather(offsets, begin[codes], size[codes], end)


def pieces(docs: DataFrame, path: str, longest: int = 4096, end: int = 1, ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, task, rank[, ids]): rank counts the pieces of that length in the task."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seen = TaskContext.get().partitionId(), np.zeros(longest + 1, np.int64)
        for batch in batches:
            for part in slices(batch):
                offsets, tokens = encode(part.column("text"), path, end)
                total = np.diff(offsets)
                each = -(-total // longest)
                row = np.repeat(np.arange(len(total)), each)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(each) - each, each)
                start = piece * longest
                length = np.minimum(longest, total[row] - start)
                at, raw = 4 * (offsets[row] + start), memoryview(tokens.astype("<u4").tobytes())
                crc = [zlib.crc32(raw[a:b]) for a, b in zip(at.tolist(), (at + 4 * length).tolist())]
                order = np.argsort(length, kind="stable")
                sizes = length[order]
                new = np.concatenate([[True], np.diff(sizes) != 0]) if len(sizes) else np.zeros(0, bool)
                rank = np.empty(len(row), np.int64)
                rank[order] = seen[sizes] + np.arange(len(sizes)) - np.maximum.accumulate(np.where(new, np.arange(len(sizes)), 0))
                np.add.at(seen, length, 1)
                columns = [part.column("doc_id").cast(pa.int64()).take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(np.full(len(row), task, np.int32)), pa.array(rank)]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "task", "rank"]
                if ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.append((offsets[row] + start), offsets[-1]).astype(np.int32)), pa.array(tokens.astype(np.int32))))
                    names.append("ids")
                yield pa.record_batch(columns, names=names)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, rank long" + ", ids array<int>" * ids
    return docs.select("doc_id", "text").mapInArrow(work, schema)


def pack(docs: DataFrame, path: str, limits: Limits = Limits(), end: int = 1, ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset[, ids]) for every piece of every document."""
    made = stage(pieces(docs, path, limits.longest, end, ids), "pieces")
    counts = made.groupBy("task", "length").agg(F.count("*").alias("n"))
    earlier = counts.withColumn("before", F.sum("n").over(W.partitionBy("length").orderBy("task")) - F.col("n"))
    histogram = {r["length"]: r["n"] for r in made.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most limits.longest rows
    found = made.sparkSession.sparkContext.broadcast(plan(histogram, limits))
    ranked = made.join(earlier.select("task", "length", "before"), ["task", "length"]).withColumn("rank", F.col("rank") + F.col("before"))
    keep = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * ids]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seq, offset = found.value.place(np.asarray(batch.column("length")), np.asarray(batch.column("rank")))
            yield pa.record_batch([*(batch.column(c) for c in keep), pa.array(seq), pa.array(offset)], names=[*keep, "sequence_id", "offset"])

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * ids + ", sequence_id long, offset long"
    return ranked.mapInArrow(work, schema)
