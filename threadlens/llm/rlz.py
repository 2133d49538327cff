"""Exact substring deduplication by relative Lempel-Ziv parsing against an index of the whole corpus.

The corpus is its own reference, cut into blocks. A block is what one seed selects: every run of windows (``window``
consecutive words of one document) whose smallest hashed ``seed``-word gram is that gram, as a piece of its document. Equal
windows have equal seeds, so all windows that could match a part of a piece lie in the block of that piece's seed, and
parsing a document's pieces against their blocks is parsing the document against every block of the corpus.

1. *Cut.* A document is cut into its pieces. Of equal pieces one goes on, with their number: a passage that is copied a
   million times is one piece in its block's reference. A block with a single piece holds nothing to match.
2. *Index.* A block's reference is the concatenation of its distinct pieces, indexed by the ranks of all its substrings of
   1, 2, 4, ... words up to the longest piece (prefix doubling), which give the order of its suffixes; the longest match of
   a suffix elsewhere in the reference is that with a neighbour in this order.
3. *Parse.* Each piece is factored greedily from left to right: the longest match at a place, if it has ``window`` words or
   more, is a factor, and the parse goes on behind it; else one word is a literal. A piece of which there are two or more is
   one factor. A window that lies across a factor's end is in no factor, so the windows that begin in a factor's last
   ``window`` - 1 words are looked up by themselves. The factors and these windows are the duplicate spans.
4. *Hot blocks.* A block of more than ``most`` distinct pieces (a passage that begins or ends in as many contexts) is cut
   anew by the longest seeds there are, whole windows: such a block's pieces are single windows, which match if they are
   equal, so counting them by hash, summed per task before the shuffle, parses them. Each block, hot or not, is exact.

Comparing goes by two independent 64-bit hashes (a seed's and a piece's or window's) or by words' hashes. Joins are equi
joins whose skewed sides Spark may split; equal rows are counted, not paired.

Defined cases: null text has no words; fewer words than ``window`` have no window; texts of any length are parsed whole, in
memory in proportion to the longest; repeated rows are copies of each other like any other texts; null ids are allowed;
further columns pass through ``duplicate_spans`` and ``remove`` unchanged (columns named like the added ones are replaced).
An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Rolling, give_back, hashes, mix, rows_of, slices, stage, words

WINDOW = 35
SEED = 8
#: Distinct pieces of a block that are indexed together, and words that a task indexes at once.
MOST = 20_000
INDEXED = 1_000_000


def leftmost_minimum(x: np.ndarray, width: int) -> np.ndarray:
    """For each i, the position of the leftmost smallest of x[i : i + width]."""
    at, have = np.arange(len(x)), 1
    while have < width:
        step = min(have, width - have)
        a, b = at[: len(at) - step], at[step:]
        at = np.where(x[b] < x[a], b, a)
        have += step
    return at


def pieces(offsets: np.ndarray, h: np.ndarray, window: int = WINDOW, seed: int = SEED) -> tuple[np.ndarray, ...]:
    """(first window, number of windows, seed hash) of each piece of the concatenated rows of words."""
    none = np.zeros(0, np.int64)
    if len(h) < window:
        return none, none, np.zeros(0, np.uint64)
    gram = mix(Rolling(h).every(seed))
    at = leftmost_minimum(gram, window - seed + 1)
    row = rows_of(offsets)
    v = np.flatnonzero(row[: len(h) - window + 1] == row[window - 1 :])
    if not len(v):
        return none, none, np.zeros(0, np.uint64)
    first = np.flatnonzero(np.concatenate([[True], (np.diff(at[v]) != 0) | (np.diff(v) != 1)]))
    return v[first], np.diff(np.append(first, len(v))), gram[at[v[first]]]


def _keyed(docs: DataFrame) -> DataFrame:
    """A key for each row: rows that share it have the same id and text, so the same result."""
    return docs.withColumns({"_k1": F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)), "_k2": F.xxhash64("text")})


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _parse(keyed: DataFrame, window: int, seed: int) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                offsets, codes, distinct = words(part.column("text"))
                start, n, gram = pieces(offsets, hashes(distinct)[codes], window, seed)
                whole = mix(Rolling(hashes(distinct, 1)[codes]).of(start, start + n + window - 1) + n.astype(np.uint64)) if len(start) else gram
                row = np.searchsorted(offsets, start, "right") - 1
                keys = (part.column(c).take(pa.array(row)) for c in ("_k1", "_k2"))
                yield pa.record_batch([_signed(gram), _signed(whole), *keys, pa.array((start - offsets[row]).astype(np.int32)), pa.array(n.astype(np.int16))], names=["seed", "piece", "_k1", "_k2", "start", "n"])
        give_back()

    return keyed.select("_k1", "_k2", "text").mapInArrow(work, "seed long, piece long, _k1 long, _k2 long, start int, n short")


def _asked(asked: DataFrame, window: int, make, schema: str) -> DataFrame:
    """``make(part, offsets, codes, distinct, row, flat)`` of the pieces that ``asked`` (_k1, _k2, text, at: array of structs)
    asks for: ``flat`` has the structs' fields, ``row`` each struct's row."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                at = part.column("at")
                flat = at.flatten()
                yield make(part, *words(part.column("text")), rows_of(np.asarray(at.offsets)), flat)
        give_back()

    return asked.select("_k1", "_k2", "text", "at").mapInArrow(work, schema)


def _numbers(flat: pa.Array, *names: str) -> list[np.ndarray]:
    return [np.asarray(flat.field(n)).astype(np.int64) for n in names]


def _texts(asked: DataFrame, window: int) -> DataFrame:
    """The asked pieces with the hashes of their words."""

    def make(part, offsets, codes, distinct, row, flat):
        start, n = _numbers(flat, "start", "n")
        size = n + window - 1
        end = np.cumsum(size)
        begin = offsets[row] + start
        h = hashes(distinct)[codes][np.repeat(begin - (end - size), size) + np.arange(int(size.sum()))] if len(n) else np.zeros(0, np.uint64)
        data = pa.Array.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(np.concatenate([[0], 8 * end]).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(h))])
        keys = [part.column(k).take(pa.array(row)) for k in ("_k1", "_k2")]
        return pa.record_batch([*(flat.field(x) for x in ("seed", "piece")), *keys, *(flat.field(x) for x in ("start", "n", "c")), data.cast(pa.binary())], names=["seed", "piece", "_k1", "_k2", "start", "n", "c", "words"])

    return _asked(asked, window, make, "seed long, piece long, _k1 long, _k2 long, start int, n short, c long, words binary")


def _windows(asked: DataFrame, window: int) -> DataFrame:
    """Each window of the asked pieces, by its hash."""

    def make(part, offsets, codes, distinct, row, flat):
        start, n, c = _numbers(flat, "start", "n", "c")
        each = np.repeat(np.arange(len(n)), n)
        p = start[each] + np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n)
        begin = offsets[row[each]] + p
        w = mix(Rolling(hashes(distinct, 2)[codes]).of(begin, begin + window)) if len(each) else np.zeros(0, np.uint64)
        keys = (part.column(k).take(pa.array(row[each])) for k in ("_k1", "_k2"))
        return pa.record_batch([flat.field("seed").take(pa.array(each)), _signed(w), *keys, pa.array(p.astype(np.int32)), pa.array(c[each])], names=["seed", "w", "_k1", "_k2", "p", "c"])

    return _asked(asked, window, make, "seed long, w long, _k1 long, _k2 long, p int, c long")


def longest_matches(block: np.ndarray, offsets: np.ndarray, h: np.ndarray, c: np.ndarray) -> np.ndarray:
    """For each word of the concatenated pieces, the words of the longest match of what begins there, up to the piece's end,
    with what begins elsewhere in its block's reference. ``c``: of pieces that occur twice or more, all matches."""
    n, size = len(h), np.diff(offsets)
    piece = rows_of(offsets)
    left = offsets[1:][piece] - np.arange(n)
    # ranks of the first word, of the first 2, 4, ... words; what is shorter ranks by itself, as its end differs from any word
    order = np.lexsort((h, block[piece]))
    new = np.concatenate([[False], (h[order][1:] != h[order][:-1]) | (block[piece][order][1:] != block[piece][order][:-1])]) if n else np.zeros(0, bool)
    rank = np.empty(n, np.int64)
    rank[order] = np.cumsum(new)
    ranks, length = [rank], 1
    while length < size.max(initial=0):
        after = np.where(left > length, np.append(ranks[-1], np.zeros(length, np.int64))[np.minimum(np.arange(n) + length, n + length - 1)], -1)
        key = ranks[-1] * (n + 1) + after + 1
        order = np.argsort(key, kind="stable")
        new = np.concatenate([[False], key[order][1:] != key[order][:-1]])
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(new)
        ranks.append(rank)
        length *= 2

    def common(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Words that the suffixes at i and j have in common."""
        out, most = np.zeros(len(i), np.int64), np.minimum(left[i], left[j])
        for k in range(len(ranks) - 1, -1, -1):
            step = 1 << k
            fits = out + step <= most
            a, b = np.where(fits, i + out, 0), np.where(fits, j + out, 0)
            out += step * (fits & (ranks[k][a] == ranks[k][b]))
        return out

    # a whole piece is equal to another one's end or nothing, and distinct pieces are not equal: neighbours tell the longest
    order = np.argsort(ranks[-1], kind="stable")
    same = block[piece][order[1:]] == block[piece][order[:-1]]
    with_next = np.where(same, common(order[:-1], order[1:]), 0)
    out = np.zeros(n, np.int64)
    out[order[:-1]] = with_next
    out[order[1:]] = np.maximum(out[order[1:]], with_next)
    return np.where(c[piece] > 1, left, out)


def factors(offsets: np.ndarray, match: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(piece, first word in it, words) of the greedy parse's factors of ``window`` words or more, and of the runs of windows
    across a factor's end that match by themselves."""
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    # where the next place is that a factor can begin at, from each word on
    can = np.append(np.where(match >= window, np.arange(len(match)), len(match)), len(match))
    following = np.minimum.accumulate(can[::-1])[::-1]
    piece = np.arange(len(offsets) - 1)
    at = following[offsets[:-1]]
    while True:
        go = at < offsets[1:][piece]
        piece, at = piece[go], at[go]
        if not len(piece):
            break
        end = at + match[at]
        found.append((piece, at - offsets[piece], match[at]))
        at = following[end]
    if not found:
        return (np.zeros(0, np.int64),) * 3
    piece, first, size = (np.concatenate(x) for x in zip(*found))
    # windows that begin in a factor's last words
    many = np.minimum(window - 1, np.diff(offsets)[piece] - (first + size))
    each = np.repeat(np.arange(len(piece)), many)
    begin = (first + size - window + 1)[each] + np.arange(len(each)) - np.repeat(np.cumsum(many) - many, many)
    hit = (begin >= 0) & (match[offsets[piece[each]] + np.maximum(begin, 0)] >= window)
    across, begin = piece[each[hit]], begin[hit]
    run = np.flatnonzero(np.concatenate([[True], (np.diff(across) != 0) | (np.diff(begin) != 1)])) if len(across) else np.zeros(0, np.int64)
    count = np.diff(np.append(run, len(across)))
    return np.concatenate([piece, across[run]]), np.concatenate([first, begin[run]]), np.concatenate([size, count + window - 1])


def _matched(texts: DataFrame, window: int) -> DataFrame:
    """The spans (_k1, _k2, start, n windows) of the pieces' factors; a task indexes some blocks at a time, each whole."""

    def parsed(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held).combine_chunks()
        column = t["words"].chunk(0).cast(pa.large_binary())
        at = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, 8 * column.offset)
        h = np.frombuffer(column.buffers()[2], np.uint8)[at[0] : at[-1]].view(np.uint64)
        offsets = (at - at[0]) // 8
        match = longest_matches(t["seed"].to_numpy(), offsets, h, t["c"].to_numpy())
        piece, first, size = factors(offsets, match, window)
        one = pa.array(piece)
        start = t["start"].to_numpy()[piece] + first
        return pa.record_batch([*(t[k].chunk(0).take(one) for k in ("_k1", "_k2")), pa.array(start.astype(np.int32)), pa.array((size - window + 1).astype(np.int16))], names=["_k1", "_k2", "start", "n"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, last = [], 0, None
        for batch in batches:
            # rows that are repeated have asked for the same pieces: one answer is enough
            both = [np.asarray(batch.column(k)) for k in ("seed", "piece")]
            new = np.concatenate([[True], (both[0][1:] != both[0][:-1]) | (both[1][1:] != both[1][:-1])])[: batch.num_rows]
            if batch.num_rows:
                new[0] = last != (both[0][0], both[1][0])
                last = both[0][-1], both[1][-1]
            if not new.all():
                batch = batch.filter(pa.array(new))
            if not batch.num_rows:
                continue
            seed = np.asarray(batch.column("seed"))
            edge = np.concatenate([[0], np.flatnonzero(np.diff(seed)) + 1, [len(seed)]])
            total = np.concatenate([[0], np.cumsum(np.asarray(pc.binary_length(batch.column("words"))).astype(np.int64) // 8)])
            done = 0
            for a, b in zip(edge[:-1].tolist(), edge[1:].tolist()):
                # a block may go on from the last batch or into the next one
                goes_on = a == 0 and held and held[-1].column("seed")[-1].as_py() == seed[0]
                if size + total[a] - total[done] >= INDEXED and not goes_on:
                    if a > done:
                        held.append(batch.slice(done, a - done))
                    yield parsed(held)
                    held, size, done = [], 0, a
            held.append(batch.slice(done))
            size += int(total[-1] - total[done])
        if held:
            yield parsed(held)
        held = None
        give_back()

    dealt = texts.repartition("seed").sortWithinPartitions("seed", "piece")
    return dealt.mapInArrow(work, "_k1 long, _k2 long, start int, n short")


def duplicate_spans(docs: DataFrame, window: int = WINDOW, seed: int = SEED, most: int = MOST) -> DataFrame:
    """``docs`` (doc_id, text, ...) with ``windows``: array<struct<start, n>>, the runs of repeated windows by first word,
    unordered and possibly overlapping; null where there is none."""
    docs = docs.drop("windows", "_k1", "_k2")
    keyed, keys = _keyed(docs), ["_k1", "_k2"]
    parsed = stage(_parse(keyed, window, seed), "pieces")
    blocks = parsed.groupBy("seed").agg(F.count("*").alias("c"), F.min("piece").alias("low"), F.max("piece").alias("high")).where("c > 1")
    # stored first: a join of two plain exchanges is one whose hot seeds Spark can split
    blocks = stage(blocks.select("seed", (F.col("low") == F.col("high")).alias("alike")), "blocks")
    known = stage(parsed.join(blocks, "seed"), "known")
    distinct = known.where("not alike").groupBy("seed", "piece").agg(F.count("*").alias("c"), F.min(F.struct(*keys, "start", "n")).alias("one"))
    distinct = stage(distinct.select("seed", "piece", "c", "one.*"), "distinct")
    # pieces that occur twice or more are factors as they are: all of a block of one kind, and those counted in the others
    repeated = distinct.where("c > 1").select("seed", "piece", F.lit(True).alias("again"))
    whole = known.join(repeated, ["seed", "piece"], "left").where("alike or again").select(*keys, "start", "n")
    hot = distinct.groupBy("seed").agg(F.count("*").alias("b")).where(F.col("b") > most).select("seed")
    hot = stage(hot, "hot")
    one = F.struct("seed", "piece", "start", "n", "c")
    rows = keyed.select(*keys, "text")

    def asked(pieces: DataFrame) -> DataFrame:
        return rows.join(pieces.groupBy(*keys).agg(F.collect_list(one).alias("at")), keys)

    spans = whole.union(_matched(_texts(asked(distinct.join(hot, "seed", "left_anti")), window), window))
    if not hot.isEmpty():
        checked = stage(_windows(asked(distinct.join(hot, "seed", "left_semi")), window), "windows")
        again = stage(checked.groupBy("seed", "w").agg(F.sum("c").alias("t")).where("t > 1").select("seed", "w"), "again")
        spans = spans.union(checked.join(again, ["seed", "w"], "left_semi").select(*keys, F.col("p").alias("start"), F.lit(1).cast("short").alias("n")))
    # as sets: repeated rows have the same key and the same spans, which then go to each of them
    spans = spans.groupBy(*keys).agg(F.collect_set(F.struct("start", "n")).alias("windows"))
    return keyed.join(spans, keys, "left").drop(*keys)


def cut(text: bytes, starts: np.ndarray, n: np.ndarray, window: int = WINDOW) -> tuple[int, int, bytes]:
    """(words, words removed, kept words joined by one space) of a text of which the given windows repeat."""
    w = text.split()
    if not len(starts):
        return len(w), 0, b" ".join(w)
    edge = np.zeros(len(w) + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + n + window - 1, -1)
    keep = np.cumsum(edge[:-1]) == 0
    return len(w), int(len(w) - keep.sum()), b" ".join(compress(w, keep.tolist()))


def remove(docs: DataFrame, window: int = WINDOW, seed: int = SEED, texts: bool = True, most: int = MOST) -> DataFrame:
    """``docs`` with n_words, n_removed, kept_sha256 and, if ``texts``, kept: the words under no repeated window."""
    found = duplicate_spans(docs.drop("n_words", "n_removed", "kept_sha256", "kept"), window, seed, most)
    plain = found if texts else found.select("doc_id", "text", "windows")
    through = [c for c in plain.columns if c != "windows"] if texts else ["doc_id"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column("windows")
            flat, offsets = at.flatten(), np.asarray(at.offsets)
            start, n = (np.asarray(flat.field(i)).astype(np.int64) for i in range(2))
            base, out = int(offsets[0]), []
            null = np.asarray(at.is_null())
            for i, text in enumerate(batch.column("text").cast(pa.large_binary())):
                a, b = (0, 0) if null[i] else (offsets[i] - base, offsets[i + 1] - base)
                size, gone, kept = cut(text.as_py() or b"", start[a:b], n[a:b], window)
                out.append((size, gone, hashlib.sha256(kept).hexdigest(), kept if texts else None))
            size, gone, digest, kept = map(list, zip(*out)) if out else ([], [], [], [])
            extra = [pa.array(size, pa.int64()), pa.array(gone, pa.int64()), pa.array(digest, pa.string())]
            if texts:
                extra.append(pa.array(kept, pa.binary()).cast(pa.string()))
            yield pa.record_batch([*(batch.column(c) for c in through), *extra], names=[*through, "n_words", "n_removed", "kept_sha256", *["kept"] * texts])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema if f.name in through)
    return plain.mapInArrow(work, f"{schema}, n_words long, n_removed long, kept_sha256 string" + ", kept string" * texts)
