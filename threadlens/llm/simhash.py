"""SimHash near-duplicates: 64-bit fingerprints of word shingles, linked by a binary trie joined with itself.

Only distinct fingerprints are joined, so a group of exact copies of any size is one node. Two fingerprints within
``budget`` = 3 bits agree on at least one of four 16-bit blocks. For each block the fingerprints are rotated so that it
leads, dealt by the block's value, and each task joins the binary trie over its own fingerprints with itself: a pair of
nodes is followed while the bits that differ on the two paths stay within the budget (none in the leading block, which
the task's fingerprints share), and a pair of subtrees is taken whole once the bits left cannot exceed it. A task
reports links to a representative of each of its clusters rather than pairs, and components over those links give the
groups.

*Near copies* (``near_copies``: five-word shingles, a similarity of 0.8) differ in more bits than blocks could bear. There a
text is dealt by each of ``TURNS`` smallest hashes of its shingles, of which two texts of Jaccard similarity s share one
with probability s (all but 0.2 % of the pairs at 0.8 meet); each task joins the trie over a bucket's fingerprints with
itself, closest pairs first, and skips node pairs whose texts are linked already, so that a group of n copies costs far less
than its pairs. Pairs within the budget whose sketches agree with the similarity are candidates; of these a bucket gives a
spanning forest, the most similar first, and another one of those in which the sketches show a little less. Candidates whose
shingle sets have the similarity, counted exactly, are links. Hashes, bits and sketches may miss links, so a lossless join
follows over what they left apart (``apart``): in any one order of all shingles, two sets of Jaccard similarity s share one
of their first n - ceil(s * n) + 1, so texts are dealt by each of these; sizes, places in the order and parity maps rule out
only pairs that cannot have the similarity, and the rest are counted exactly. One text of each component of links stays,
that of the smallest id.

Defined cases: a null or word-less text has fingerprint zero and links like any other; a text with fewer words than a
shingle is one shingle; texts of any length are read whole; null ids keep their rows and take their component's smallest
non-null id (null if there is none); of repeated rows ``representatives`` and ``near_copies`` keep one. Other columns of the
input are ignored, or passed on by the latter two. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Rolling, give_back, hashes, mix, rows_of, slices, stage, whole_groups, words
from .components import components

BUDGET = 3
BLOCKS = 4
#: A block value with more fingerprints than this is cut into parts of this size, and each pair of parts is one task's.
HOT = 1 << 20
#: Rows that a task joins together, but for those of one block, which it holds whole.
CHUNK = 1 << 19

#: Near copies: shingle hashes by which a text is dealt, and those by which buckets of more than CROWDED texts are dealt once
#: more; what is beyond PART then is cut into parts, and each pair of parts is one task's.
TURNS = 4
MINIMA = 8
CROWDED = 20_000
PART = 1 << 16
#: Differing bits: 9.7 on average at a similarity of 0.8, and three standard deviations more.
NEAR_BUDGET = 18
#: Hashes of a sketch, and how far below the similarity what it shows may be: two standard deviations.
SKETCH = 64
SLACK = 0.1
#: Texts of which shingles are counted to put frequent ones last, how often such a one occurs in them, and how many there may be.
#: Any order is right; this one keeps groups small.
ORDER_TEXTS = 20_000
ORDER_LEAST = 4
ORDER_MOST = 1 << 18
#: Bits of a parity map, and texts of one shingle that a task compares with each other or with as many.
PARITY = 1024
SHARE = 4096
#: Node pairs that are walked together.
FRONTIER = 1 << 20


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """One text's fingerprint; ``fingerprints`` does the same for a column."""
    w = text.lower().split()
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + shingle]), 42) for i in range(max(1, len(w) - shingle + 1))]
    return _vote(np.array(h, np.uint64))


def _vote(h: np.ndarray) -> int:
    """Bits set in more than half of the hashes."""
    total = np.zeros(64, np.int64)
    for i in range(0, len(h), 65536):
        part = h[i : i + 65536]
        total += np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * total > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fp: long, text_hash) for every row of ``docs``."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh64_intdigest
        for batch in batches:
            out = []
            for part in slices(batch):
                for text in part.column("text").cast(pa.large_binary()).to_pylist():
                    w = (text or b"").lower().split()
                    if len(w) > shingle == 3:
                        out.append(_vote(np.fromiter((digest(b"%b %b %b" % x, 42) for x in zip(w, w[1:], w[2:])), np.uint64, len(w) - 2)))
                    else:
                        out.append(fingerprint(b" ".join(w), shingle))
            yield pa.record_batch([batch.column("doc_id").cast(pa.int64()), pa.array(np.array(out, np.uint64).view(np.int64)), batch.column("text_hash")], names=["doc_id", "fp", "text_hash"])

    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).mapInArrow(work, "doc_id long, fp long, text_hash long")


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def trie_links(keys: np.ndarray, budget: int = BUDGET, fixed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Links (i, j) between sorted distinct uint64 ``keys`` whose components are those of all pairs within ``budget``
    bits, the first ``fixed`` of which must agree. The binary trie over the keys is implicit: a node is the range of
    keys that share a prefix."""
    none = np.zeros(0, np.int64)
    if len(keys) < 2:
        return none, none
    lo1, hi1, lo2, hi2, diff = (np.array([x], np.int64) for x in (0, len(keys), 0, len(keys), 0))
    left, right = [none], [none]
    for bit in range(63, -1, -1):
        whole = np.full(len(diff), False) if 63 - bit < fixed else bit + 1 <= budget - diff
        for a, b, c, d in zip(lo1[whole], hi1[whole], lo2[whole], hi2[whole]):
            every = np.unique(np.concatenate([np.arange(a, b), np.arange(c, d)]))
            left.append(np.full(len(every) - 1, every[0]))
            right.append(every[1:])
        # both nodes hold one key: the rest of the path needs no walking
        single = ~whole & (hi1 - lo1 == 1) & (hi2 - lo2 == 1)
        i, j = lo1[single], lo2[single]
        near = _popcount(keys[i] ^ keys[j]) <= budget
        near &= (keys[i] ^ keys[j]) >> np.uint64(64 - fixed) == 0 if fixed else True
        left.append(i[near])
        right.append(j[near])
        go = ~whole & ~single
        lo1, hi1, lo2, hi2, diff = lo1[go], hi1[go], lo2[go], hi2[go], diff[go]
        if not len(diff):
            break
        one = np.uint64(1) << np.uint64(bit)
        below = ~(one | (one - np.uint64(1)))
        mid1 = np.clip(np.searchsorted(keys, (keys[lo1] & below) | one), lo1, hi1)
        mid2 = np.clip(np.searchsorted(keys, (keys[lo2] & below) | one), lo2, hi2)
        same = lo1 == lo2
        branch = [
            (lo1, mid1, lo2, mid2, diff),
            (mid1, hi1, mid2, hi2, diff),
            (lo1, mid1, mid2, hi2, diff + 1),
            tuple(x[~same] for x in (mid1, hi1, lo2, mid2, diff + 1)),
        ]
        lo1, hi1, lo2, hi2, diff = (np.concatenate(x) for x in zip(*branch))
        go = (lo1 < hi1) & (lo2 < hi2) & (diff <= (0 if 63 - bit < fixed else budget)) & ~((lo1 == lo2) & (hi1 - lo1 == 1))
        lo1, hi1, lo2, hi2, diff = lo1[go], hi1[go], lo2[go], hi2[go], diff[go]
    # pairs parted at the last bit, by a node that held two keys: every node is one key now
    left.append(lo1)
    right.append(lo2)
    return np.concatenate(left), np.concatenate(right)


def local_roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest index linked to each of 0..n-1, directly or through others."""
    root = np.arange(n)
    while True:
        a, b = root[i], root[j]
        apart = a != b
        if not apart.any():
            return root
        np.minimum.at(root, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
        while (root[root] != root).any():
            root = root[root]


def links(distinct: DataFrame, budget: int = BUDGET, hot: int = HOT) -> DataFrame:
    """``distinct`` (fp: long, once each) to links (a, b) with the components of all pairs within ``budget`` bits."""
    width = 64 // BLOCKS
    if budget >= BLOCKS:
        raise ValueError(f"a budget of {budget} bits needs more than {BLOCKS} blocks")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # many blocks together: keys that differ in the leading block never meet
        for some in whole_groups(batches, ["turn", "block", "low", "high"], CHUNK):
            turn, fp = some["turn"].to_numpy(), some["fp"].to_numpy().view(np.uint64)
            for k in np.unique(turn).tolist():
                x, s = fp[turn == k], np.uint64(width * k)
                # a fingerprint of a hot block comes once for each pair of parts
                keys = np.unique((x << s) | (x >> (np.uint64(64) - s)) if k else x)
                i, j = trie_links(keys, budget=budget, fixed=width)
                root = local_roots(len(keys), i, j)
                back = (keys >> s) | (keys << (np.uint64(64) - s)) if k else keys
                linked = root != np.arange(len(keys))
                yield pa.record_batch([pa.array(back[linked].view(np.int64)), pa.array(back[root[linked]].view(np.int64))], names=["a", "b"])

    turns = F.explode(F.sequence(F.lit(0), F.lit(BLOCKS - 1)))
    dealt = distinct.select("fp", turns.alias("turn")).withColumn("block", F.expr(f"shiftrightunsigned(fp, 64 - {width} * (turn + 1)) & {(1 << width) - 1}"))
    # at most BLOCKS << width block values, so their counts may be broadcast
    parts = dealt.groupBy("turn", "block").count().where(F.col("count") > hot).select("turn", "block", F.ceil(F.col("count") / hot).cast("int").alias("parts"))
    dealt = dealt.join(F.broadcast(parts), ["turn", "block"], "left").withColumn("own", F.when(F.col("parts").isNull(), 0).otherwise(F.expr("cast(pmod(xxhash64(fp, 7), parts) as int)")))
    pair = F.struct(F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("parts"), F.lit(1)) - 1))).withColumn("pair", pair)
    group = ["turn", "block", "low", "high"]
    dealt = dealt.select("turn", "block", "pair.low", "pair.high", "fp").repartition(*group).sortWithinPartitions(*group)
    return dealt.mapInArrow(work, "a long, b long")


def _rooted(docs: DataFrame, shingle: int, budget: int) -> DataFrame:
    """(doc_id, fp, text_hash, root, component_id) for every row of ``docs``; root: a fingerprint of the group."""
    fps = stage(fingerprints(docs, shingle), "fingerprints")
    distinct = stage(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = components(links(distinct.select("fp"), budget)).select(F.col("node").alias("fp"), "root")
    rooted = stage(distinct.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")), "rooted")
    least = stage(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "least")
    named = stage(rooted.join(least, "root").select("fp", "root", "component_id"), "named")
    return fps.join(named, "fp")


def groups(docs: DataFrame, shingle: int = 3, budget: int = BUDGET) -> DataFrame:
    """(doc_id, fp, component_id) for every row of ``docs``: the smallest doc_id reachable over links of at most
    ``budget`` differing bits."""
    return _rooted(docs, shingle, budget).select("doc_id", "fp", "component_id")


def representatives(docs: DataFrame, shingle: int = 3, budget: int = BUDGET) -> DataFrame:
    """One row of ``docs`` for each group: that of the smallest id (of several, that of the smallest text hash; of
    repeated rows, any). A group without ids keeps the row of the smallest text hash."""
    own = _rooted(docs, shingle, budget).where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    id_key = {"_id": F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)), "_null": F.col("doc_id").isNull()}
    kept = own.groupBy("root", "doc_id").agg(F.min("text_hash").alias("_text")).withColumns(id_key).select("_id", "_null", "_text")
    keys = ["_id", "_null", "_text"]
    # the join leaves its result dealt and sorted by the keys, so that dropping repeated rows takes no further shuffle
    return docs.withColumns(id_key | {"_text": F.xxhash64("text")}).join(kept, keys).dropDuplicates(keys).select(*docs.columns)


# ---- near copies


def shingles(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, hash) of the distinct shingles of each text in order, and a hash of each text's whole sequence of words."""
    offsets, codes, distinct = words(texts, lower=True)
    n = np.diff(offsets)
    whole = mix(Rolling(hashes(distinct, 1)[codes]).of(offsets[:-1], offsets[1:]) ^ n.astype(np.uint64))
    rolling = Rolling(hashes(distinct)[codes])
    many = np.where(n >= size, n - size + 1, np.minimum(n, 1))
    row = np.repeat(np.arange(len(n)), many)
    start = offsets[row] + np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
    h = mix(rolling.of(start, np.minimum(start + size, offsets[row + 1])) + np.uint64(size)) if len(row) else np.zeros(0, np.uint64)
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    new = np.concatenate([[True], (np.diff(row) != 0) | (h[1:] != h[:-1])])[: len(h)]
    return row[new], h[new], whole


def frequent(docs: DataFrame, shingle: int, texts: int = ORDER_TEXTS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes in order, and counts, of shingles that occur in several of about ``texts`` texts."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, most=2 << 20):
                yield pa.record_batch([pa.array(shingles(part.column("text"), shingle)[1].view(np.int64))], names=["h"])
        give_back()

    n, some = docs.count(), docs.select("text")
    if n > texts:
        some = some.where(F.pmod(F.xxhash64("text", F.lit(17)), F.lit(1 << 30)) < int((1 << 30) * texts / n))
    got = some.dropDuplicates(["text"]).mapInArrow(work, "h long").groupBy("h").count().where(F.col("count") >= ORDER_LEAST)
    got = got.orderBy(F.desc("count"), "h").limit(ORDER_MOST).toArrow()
    h, count = got["h"].to_numpy().view(np.uint64), got["count"].to_numpy()
    by = np.argsort(h)
    return h[by], count[by]


def prefixes(row: np.ndarray, h: np.ndarray, count: np.ndarray, similarity: float, often: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Of sets of ``count`` hashes each, how many come first and which: no two sets of the similarity lack a common one."""
    known, times = often
    rank = np.zeros(len(h), np.int64)
    if len(known) and len(h):
        at = np.minimum(np.searchsorted(known, h), len(known) - 1)
        rank = np.where(known[at] == h, times[at], 0)
    h = h[np.lexsort((h, rank, row))]
    first = np.where(count > 0, count - np.ceil(similarity * count - 1e-6).astype(np.int64) + 1, 0)
    begin = np.cumsum(count) - count
    return first, h[np.repeat(begin - (np.cumsum(first) - first), first) + np.arange(int(first.sum()))]


def parities(row: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    """Of each of n sets, a map of PARITY bits: whether the number of its hashes at the bit is odd. Two maps differ in no more
    bits than the sets have hashes that the other lacks."""
    odd = np.bincount(row * PARITY + (h & np.uint64(PARITY - 1)).astype(np.int64), minlength=n * PARITY).astype(np.uint8) & 1
    return np.packbits(odd.reshape(n, PARITY), axis=1)


def sketches(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, often: tuple[np.ndarray, np.ndarray] | None = None) -> DataFrame:
    """(doc_id, text_hash, w: the words' hash, fp: of the set of shingles, minima: its smallest hashes by MINIMA orders, sketch:
    the high halves of its SKETCH smallest hashes, size: of the set, first: its ``prefixes``, parity: its map) for every row
    of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(often or (np.zeros(0, np.uint64), np.zeros(0, np.int64)))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, most=2 << 20):
                row, h, whole = shingles(part.column("text"), shingle)
                n = part.num_rows
                count = np.bincount(row, minlength=n)
                begin = np.cumsum(count) - count
                some = np.flatnonzero(count)
                fp, minima = np.zeros(n, np.uint64), np.zeros((n, MINIMA), np.uint64)
                if len(some):
                    at = begin[some]
                    for bit in range(64):
                        ones = np.add.reduceat(((h >> np.uint64(bit)) & np.uint64(1)).astype(np.int64), at)
                        fp[some] |= (2 * ones > count[some]).astype(np.uint64) << np.uint64(bit)
                    for k in range(MINIMA):
                        minima[some, k] = np.minimum.reduceat(mix(h + np.uint64(0x9E3779B97F4A7C15 * (k + 1) & ((1 << 64) - 1))), at)
                kept = np.minimum(count, SKETCH)
                take = np.repeat(begin - (np.cumsum(kept) - kept), kept) + np.arange(int(kept.sum()))
                low = (h[take] >> np.uint64(32)).astype("<u4")
                ends = np.concatenate([[0], 4 * np.cumsum(kept)]).astype(np.int32)
                sketch = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(low))])
                lists = pa.ListArray.from_arrays(np.arange(0, MINIMA * n + 1, MINIMA, dtype=np.int32), pa.array(minima.view(np.int64).ravel()))
                many, first = prefixes(row, h, count, similarity, shared.value)
                firsts = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(many)]).astype(np.int32), pa.array(first.view(np.int64)))
                maps = np.arange(0, PARITY // 8 * n + 1, PARITY // 8, dtype=np.int32)
                parity = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(maps), pa.py_buffer(parities(row, h, n))])
                columns = [part.column("doc_id").cast(pa.int64()), part.column("text_hash"), pa.array(whole.view(np.int64)), pa.array(fp.view(np.int64)), lists, sketch, pa.array(count), firsts, parity]
                yield pa.record_batch(columns, names=["doc_id", "text_hash", "w", "fp", "minima", "sketch", "size", "first", "parity"])
        give_back()

    schema = "doc_id long, text_hash long, w long, fp long, minima array<long>, sketch binary, size long, first array<long>, parity binary"
    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).mapInArrow(work, schema)


def shown_similarity(a: np.ndarray, b: np.ndarray, pad: int = (1 << 32) - 1) -> np.ndarray:
    """Of pairs of sketches (n, SKETCH), padded by the largest number, the Jaccard similarity that they show: exact where a set
    is no larger than a sketch."""
    both = np.sort(np.concatenate([a, b], 1), 1)
    there = both != pad
    twice = np.zeros(both.shape, bool)
    twice[:, 1:] = (both[:, 1:] == both[:, :-1]) & there[:, 1:]
    rank = np.cumsum(there & ~twice, 1)
    full = (a[:, -1] != pad) | (b[:, -1] != pad)
    size = np.where(full, np.minimum(rank[:, -1], a.shape[1]), rank[:, -1])
    common = (twice & (rank <= size[:, None])).sum(1)
    return np.where(size > 0, common / np.maximum(size, 1), 1.0)


def _halves(keys: np.ndarray, lo: np.ndarray, hi: np.ndarray, bit: int) -> np.ndarray:
    """Where the keys of each range, which are in order and agree above the bit, begin to have it."""
    lo, hi = lo.copy(), hi.copy()
    one = np.uint64(bit)
    while (open_ := np.flatnonzero(lo < hi)).size:
        mid = (lo[open_] + hi[open_]) >> 1
        has = (keys[mid] >> one) & np.uint64(1) == 1
        hi[open_[has]] = mid[has]
        lo[open_[~has]] = mid[~has] + 1
    return lo


def near_pairs(keys: np.ndarray, begin: np.ndarray, end: np.ndarray, budget: int, label: np.ndarray, bit: int = 63, frontier=None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j) of keys of the same range within ``budget`` bits, in order in each range from ``begin`` to ``end``, but for
    those that agree in ``label``; of equal keys, only enough to link them. The ranges' tries are walked in pairs of nodes."""
    change = np.concatenate([[0], np.cumsum(label[1:] != label[:-1])])
    lo1, hi1, lo2, hi2, diff = frontier or (begin, end, begin, end, np.zeros(len(begin), np.int64))
    while len(diff):
        alike = (change[hi1 - 1] == change[lo1]) & (change[hi2 - 1] == change[lo2]) & (label[lo1] == label[lo2])
        single = ~alike & (hi1 - lo1 == 1) & (hi2 - lo2 == 1)
        if single.any():
            i, j = lo1[single], lo2[single]
            near = _popcount(keys[i] ^ keys[j]) <= budget
            yield i[near], j[near]
        lo1, hi1, lo2, hi2, diff = (x[~alike & ~single] for x in (lo1, hi1, lo2, hi2, diff))
        if bit < 0:
            # equal keys on either side: each one with the first of the other side and with its neighbour
            same = lo1 == lo2
            for a, b, c in ((lo1, lo2, hi2), (lo2[~same], lo1[~same], hi1[~same])):
                each = np.repeat(np.arange(len(a)), c - b)
                j = b[each] + np.arange(len(each)) - np.repeat(np.cumsum(c - b) - (c - b), c - b)
                i = a[each]
                yield i[i != j], j[i != j]
                yield j[j > b[each]] - 1, j[j > b[each]]
            return
        if len(diff) > FRONTIER:
            for cut in range(0, len(diff), FRONTIER // 4):
                yield from near_pairs(keys, begin, end, budget, label, bit, tuple(x[cut : cut + FRONTIER // 4] for x in (lo1, hi1, lo2, hi2, diff)))
            return
        mid1, mid2 = _halves(keys, lo1, hi1, bit), _halves(keys, lo2, hi2, bit)
        cross = lo1 != lo2
        branch = [
            (lo1, mid1, lo2, mid2, diff),
            (mid1, hi1, mid2, hi2, diff),
            (lo1, mid1, mid2, hi2, diff + 1),
            tuple(x[cross] for x in (mid1, hi1, lo2, mid2, diff + 1)),
        ]
        lo1, hi1, lo2, hi2, diff = (np.concatenate(x) for x in zip(*branch))
        go = (lo1 < hi1) & (lo2 < hi2) & (diff <= budget) & ~((lo1 == lo2) & (hi1 - lo1 == 1))
        lo1, hi1, lo2, hi2, diff = (x[go] for x in (lo1, hi1, lo2, hi2, diff))
        bit -= 1


def forest(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(label, edges): of edges (i, j), best first, which join what ``label`` (each one's smallest fellow) has apart, without
    circles; and the labels with them."""
    label, chosen = label.copy(), [np.zeros(0, np.int64)]
    edge = np.arange(len(i))
    while True:
        a, b = label[i[edge]], label[j[edge]]
        apart = a != b
        edge, a, b = edge[apart], a[apart], b[apart]
        if not len(edge):
            return label, np.concatenate(chosen)
        # each label takes one edge to a smaller one: no circles
        high, first = np.unique(np.maximum(a, b), return_index=True)
        chosen.append(edge[first])
        label[high] = np.minimum(a, b)[first]
        while (label[label] != label).any():
            label = label[label]


def near_edges(keys: np.ndarray, begin: np.ndarray, end: np.ndarray, sketch: np.ndarray, budget: int, similarity: float, slack: float = SLACK) -> tuple[np.ndarray, np.ndarray]:
    """Candidates (i, j) among the keys of each range: a forest of pairs within ``budget`` bits whose sketches show the
    similarity, closest first, and one of pairs that show less by no more than ``slack``."""
    label, out, less = np.arange(len(keys)), [], []
    for most in [b for b in (2, 5, 9, 13) if b < budget] + [budget]:
        for i, j in near_pairs(keys, begin, end, most, label.copy()):
            for cut in range(0, len(i), 1 << 15):
                a, b = i[cut : cut + (1 << 15)], j[cut : cut + (1 << 15)]
                apart = label[a] != label[b]
                a, b = a[apart], b[apart]
                shown = shown_similarity(sketch[a], sketch[b])
                by = np.argsort(-shown, kind="stable")
                a, b, shown = a[by], b[by], shown[by]
                fits = int((shown >= similarity).sum())
                label, edge = forest(label, a[:fits], b[:fits])
                out.append((a[edge], b[edge]))
                maybe = slice(fits, int((shown >= similarity - slack).sum()))
                _, edge = forest(label, a[maybe], b[maybe])
                less.append((a[maybe][edge], b[maybe][edge], shown[maybe][edge]))
    a, b, shown = (np.concatenate([x[k] for x in less]) if less else np.zeros(0, np.int64) for k in range(3))
    by = np.argsort(-shown, kind="stable")
    _, edge = forest(label, a[by], b[by])
    out.append((a[by][edge], b[by][edge]))
    return tuple(np.concatenate([x[k] for x in out]) for k in (0, 1))


def candidates(texts: DataFrame, similarity: float, budget: int = NEAR_BUDGET, crowded: int = CROWDED, part: int = PART) -> DataFrame:
    """``texts`` (w once each, fp, minima, sketch) to candidates (a, b) between words' hashes, the smaller one first."""
    turns = texts.select("w", "fp", "minima", "sketch", F.explode(F.sequence(F.lit(0), F.lit(TURNS - 1))).alias("turn")).withColumn("key", F.expr("minima[turn]"))
    light = texts.select(F.explode(F.slice("minima", 1, TURNS)).alias("key"))
    # crowded buckets are few: a text is in TURNS of them at most
    many = stage(light.groupBy("key").count().where(F.col("count") > crowded).select("key"), "crowded")
    again = F.expr(f"filter(sequence(0, {MINIMA - 1}), k -> k <> turn)")
    rows = turns.join(many.withColumn("crowded", F.lit(True)), "key", "left").withColumn("sub", F.explode(F.when(F.col("crowded"), again).otherwise(F.array(F.lit(-1)))))
    rows = rows.withColumn("bucket", F.xxhash64("turn", "key", "sub", F.expr("if(sub < 0, 0L, minima[sub])"))).select("bucket", "w", "fp", "sketch", "crowded")
    parts = stage(rows.where("crowded").groupBy("bucket").count().where(F.col("count") > part).select("bucket", F.ceil(F.col("count") / part).cast("int").alias("parts")), "parts")
    rows = rows.join(parts, "bucket", "left").withColumn("own", F.when(F.col("parts").isNull(), 0).otherwise(F.expr("cast(pmod(xxhash64(w, 7), parts) as int)")))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).withColumns({"low": F.least("own", "other"), "high": F.greatest("own", "other")})

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = ["bucket", "low", "high"]
        for some in whole_groups(batches, group, CHUNK // 4):
            columns = [some[c].to_numpy() for c in group]
            new = np.concatenate([[True], *([np.any([c[1:] != c[:-1] for c in columns], 0)])])
            begin = np.flatnonzero(new)
            end = np.append(begin[1:], len(new))
            more = end - begin > 1
            if not more.any():
                continue
            at = np.flatnonzero(np.repeat(more, end - begin))
            size = (end - begin)[more]
            w, keys = some["w"].to_numpy()[at], some["fp"].to_numpy().view(np.uint64)[at]
            held = some["sketch"].take(pa.array(at)).combine_chunks().cast(pa.large_binary())
            length = np.asarray(pc.binary_length(held)).astype(np.int64) // 4
            values = np.frombuffer(held.buffers()[2], np.uint32) if held.buffers()[2] is not None else np.zeros(0, np.uint32)
            offsets = np.frombuffer(held.buffers()[1], np.int64, len(held) + 1, 8 * held.offset) // 4
            sketch = np.full((len(at), SKETCH), (1 << 32) - 1, np.uint32)
            row = np.repeat(np.arange(len(at)), length)
            sketch[row, np.arange(len(row)) - np.repeat(np.cumsum(length) - length, length)] = values[offsets[0] : offsets[-1]]
            # each bucket's keys in order, which they are not by their rows
            order = np.lexsort((keys, np.repeat(np.arange(len(size)), size)))
            w, keys, sketch = w[order], keys[order], sketch[order]
            end = np.cumsum(size)
            i, j = near_edges(keys, end - size, end, sketch, budget, similarity)
            yield pa.record_batch([pa.array(np.minimum(w[i], w[j])), pa.array(np.maximum(w[i], w[j]))], names=["a", "b"])
        give_back()

    dealt = rows.select("bucket", "low", "high", "w", "fp", "sketch").repartition("bucket", "low", "high").sortWithinPartitions("bucket", "low", "high")
    return dealt.mapInArrow(work, "a long, b long")


def _sets(docs: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """(w, set) of ``wanted`` (w, own: a row's keys): the set of shingles of that row's text, as 32-bit hashes."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, most=2 << 20):
                row, h, _ = shingles(part.column("text"), shingle)
                at = np.searchsorted(row, np.arange(part.num_rows + 1)).astype(np.int32)
                yield pa.record_batch([part.column("w"), pa.ListArray.from_arrays(pa.array(at), pa.array((h >> np.uint64(32)).astype(np.uint32).view(np.int32)))], names=["w", "set"])
        give_back()

    keys = ["_id", "_null", "_text"]
    rows = _row_keys(docs).select(*keys, "text").join(wanted.select("w", "own.*"), keys).select("w", "text")
    return rows.mapInArrow(work, "w long, set array<int>")


def _row_keys(docs: DataFrame) -> DataFrame:
    return docs.withColumns({"_id": F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)), "_null": F.col("doc_id").isNull(), "_text": F.xxhash64("text")})


def possible(begin: np.ndarray, end: np.ndarray, root: np.ndarray, own: np.ndarray, size: np.ndarray, place: np.ndarray, parity: np.ndarray, similarity: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs (i, j) of the same range and of different roots and parts that may have the similarity, and how far their maps
    differ, by their sizes. ``place``: that of the range's shingle in each one's order; pairs whose first common shingle it is
    are found."""
    group = np.repeat(np.arange(len(begin)), end - begin)
    # those of the root that is most frequent in a range come last there, and need not be paired with each other
    by = np.lexsort((root, group))
    new = np.concatenate([[True], (np.diff(group[by]) != 0) | (np.diff(root[by]) != 0)])
    run = np.cumsum(new) - 1
    length = np.bincount(run)
    most = np.zeros(len(begin), np.int64)
    np.maximum.at(most, group[by][new], length)
    chief = np.flatnonzero(length == most[group[by][new]])
    _, one = np.unique(group[by][new][chief], return_index=True)
    last = np.zeros(len(by), bool)
    last[by] = np.isin(run, chief[one])
    order = np.lexsort((last, group))
    many = np.where(last[order], 0, end[group] - np.arange(len(order)) - 1)
    total, k = np.concatenate([[0], np.cumsum(many)]), 0
    while k < len(order):
        to = max(k + 1, int(np.searchsorted(total, total[k] + FRONTIER, "right")) - 1)
        each = np.repeat(np.arange(k, to), many[k:to])
        j = order[each + 1 + np.arange(len(each)) - (total[each] - total[k])]
        i, k = order[each], to
        apart = (root[i] != root[j]) & (own[i] != own[j])
        i, j = i[apart], j[apart]
        least = np.ceil(similarity / (1 + similarity) * (size[i] + size[j]) - 1e-6)
        enough = np.minimum(size[i] - place[i], size[j] - place[j]) >= least
        i, j, least = i[enough], j[enough], least[enough]
        for cut in range(0, len(i), 1 << 16):
            a, b = i[cut : cut + (1 << 16)], j[cut : cut + (1 << 16)]
            differ = _popcount(parity[a] ^ parity[b]).sum(1, dtype=np.int64)
            both = size[a] + size[b]
            near = differ <= both - 2 * least[cut : cut + (1 << 16)]
            yield a[near], b[near], differ[near] / both[near]


def apart(texts: DataFrame, similarity: float, share: int = SHARE) -> DataFrame:
    """``texts`` (w once each, root, size, first, parity) to all pairs (a, b) of different roots that may have the similarity,
    with their roots (low, high) and how far they differ."""
    group = ["token", "part", "with"]

    def several(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in whole_groups(batches, ["token"], CHUNK):
            token, root = some["token"].to_numpy(), some["root"].to_numpy()
            begin = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
            more = np.minimum.reduceat(root, begin) != np.maximum.reduceat(root, begin)
            yield from some.filter(pa.array(np.repeat(more, np.diff(np.append(begin, len(token)))))).combine_chunks().to_batches()
        give_back()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in whole_groups(batches, group, CHUNK // 4):
            columns = [some[c].to_numpy() for c in group]
            begin = np.flatnonzero(np.concatenate([[True], np.any([c[1:] != c[:-1] for c in columns], 0)]))
            end = np.append(begin[1:], len(columns[0]))
            # rows of a pair of parts meet those of the other; those of one part, each other
            own = np.where(columns[1] == columns[2], np.arange(len(columns[0])), -1 - some["own"].to_numpy().astype(np.int64))
            w, root = some["w"].to_numpy(), some["root"].to_numpy()
            parity = np.frombuffer(b"".join(some["parity"].to_pylist()), np.uint64).reshape(-1, PARITY // 64)
            for i, j, differ in possible(begin, end, root, own, some["size"].to_numpy(), some["place"].to_numpy(), parity, similarity):
                low, high = (f(x[i], x[j]) for x in (root,) for f in (np.minimum, np.maximum))
                yield pa.record_batch([pa.array(np.minimum(w[i], w[j])), pa.array(np.maximum(w[i], w[j])), pa.array(low), pa.array(high), pa.array(differ)], names=["a", "b", "low", "high", "differ"])
        give_back()

    dealt = texts.select("w", "root", "size", F.posexplode("first").alias("place", "token")).repartition("token").sortWithinPartitions("token")
    rows = stage(dealt.mapInArrow(several, dealt.schema), "shared")
    rows = rows.join(texts.select("w", "parity"), "w")
    parts = stage(rows.groupBy("token").count().where(F.col("count") > share).select("token", F.ceil(F.col("count") / share).cast("int").alias("parts")), "parts")
    rows = rows.join(parts, "token", "left").withColumn("own", F.when(F.col("parts").isNull(), 0).otherwise(F.expr("cast(pmod(xxhash64(w, 7), parts) as int)")))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).withColumns({"part": F.least("own", "other"), "with": F.greatest("own", "other")})
    rows = rows.select(*group, "w", "root", "own", "size", "place", "parity").repartition(*group).sortWithinPartitions(*group)
    return rows.mapInArrow(work, "a long, b long, low long, high long, differ double").groupBy("a", "b", "low", "high").agg(F.min("differ").alias("differ"))


def _sets_of(docs: DataFrame, texts: DataFrame, pairs: DataFrame, shingle: int) -> DataFrame:
    """(w, set) of the texts of ``pairs``."""
    ends = pairs.select(F.col("a").alias("w")).union(pairs.select(F.col("b").alias("w"))).distinct()
    return stage(_sets(docs, texts.select("w", "own").join(ends, "w"), shingle).dropDuplicates(["w"]), "sets")


def _alike(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Those of ``pairs`` (a, b, ...) whose sets have the similarity."""
    # stored: joins of plain exchanges, which Spark can split where a text has very many candidates
    left = stage(pairs.join(sets.withColumnsRenamed({"w": "a", "set": "of_a"}), "a"), "left")
    both = left.join(sets.withColumnsRenamed({"w": "b", "set": "of_b"}), "b")
    shared = F.size(F.array_intersect("of_a", "of_b"))
    return both.where(shared >= F.lit(similarity) * (F.size("of_a") + F.size("of_b") - shared)).drop("of_a", "of_b")


def near_copies(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, budget: int = NEAR_BUDGET) -> DataFrame:
    """The rows of ``docs`` that stay: one of each group of texts linked by a Jaccard similarity of ``similarity`` or more."""
    keys, docs = ["_id", "_null", "_text"], docs.drop("_id", "_null", "_text")
    rows = stage(sketches(docs, shingle, similarity, frequent(docs, shingle)), "sketches")
    own = F.min(F.struct(F.col("doc_id").isNull().alias("_null"), F.coalesce("doc_id", F.lit(-1)).alias("_id"), F.col("text_hash").alias("_text"))).alias("own")
    texts = stage(rows.groupBy("w").agg(own, *(F.first(c).alias(c) for c in ("fp", "minima", "sketch", "size", "first", "parity"))), "texts")
    pairs = stage(candidates(texts, similarity, budget).distinct(), "candidates")
    found = components(_alike(pairs, _sets_of(docs, texts, pairs, shingle), similarity).select("a", "b")).withColumnsRenamed({"node": "w"})
    linked = stage(texts.drop("fp", "minima", "sketch").join(found, "w", "left").withColumn("root", F.coalesce("root", "w")), "linked")
    # what is left apart: of two groups the closest pair first, and the others only if that is no link
    missed = stage(apart(linked, similarity), "apart")
    sets = _sets_of(docs, texts, missed, shingle)
    best = missed.groupBy("low", "high").agg(F.min(F.struct("differ", "a", "b")).alias("best")).select("low", "high", "best.a", "best.b")
    links = stage(_alike(best, sets, similarity).select("low", "high"), "links")
    rest = missed.join(links, ["low", "high"], "left_anti").join(best.select("a", "b"), ["a", "b"], "left_anti").select("low", "high", "a", "b")
    links = links.union(_alike(rest, sets, similarity).select("low", "high"))
    joined = components(links.select(F.col("low").alias("a"), F.col("high").alias("b"))).select(F.col("node").alias("root"), F.col("root").alias("all"))
    kept = linked.select("own", "root").join(joined, "root", "left").groupBy(F.coalesce("all", "root").alias("root")).agg(F.min("own").alias("own")).select("own.*")
    return _row_keys(docs).join(kept.select(*keys), keys).dropDuplicates(keys).select(*docs.columns)
