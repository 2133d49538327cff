"""An n-gram language model in an Elias-Fano trie of memory-mapped levels, trained and queried over a whole corpus.

*Model.* With N training tokens, V distinct ones and D the discount,

    P1(w)    = (c(w) + a) / (N + a (V + 1))
    Pk(w|h)  = max(c(hw) - D, 0) / c(h) + B(h) Pk-1(w|h'),   B(h) = 1 - sum over stored w of (c(hw) - D) / c(h)

where h' is h without its first word. Every n-gram is counted; those that occur ``least`` times or more (by default: all)
are stored, and what the others and the discount leave is the back-off weight B(h), so that each distribution sums to one.
A context that is not stored has weight one.

*Levels.* Level 1 has the words' 64-bit hashes in order (a word's id is its place) and counts. Level k has, in order, the
children of each context, a context being a node of level k - 1: monotone pointers, by context, to its first child, and
the children's words, monotone when each context's are set off by what precedes them; both Elias-Fano coded. From level 3
on a child is not named by its word's id but by its place among the children of the context without its first word (a
smaller number): a query finds the shorter n-gram first and then searches the context's children for that place. Each
node has its smoothed probability and each context its back-off weight, as 16-bit steps of a logarithm; counts, which only
the next level's training needs, are bytes with a list of the larger ones.

*Training.* Level by level, one pass over the corpus each. How often a context occurs is known from the level before, and
bounds how many children it has; so the level is dealt beforehand, by ranges of contexts that occur about ``SHARD`` times
together, and a context that alone occurs more often is dealt by ranges of its children's words. Counts are summed per
task, go through one shuffle as packed bytes, and the task that gets a range merges it and writes its shard, one file in
the shared folder; nothing else is stored. The parts of a split context are finished by a second short job, which knows
the context's whole mass. Workers map the files they need. The driver holds one line a shard.

Defined cases: null text is empty, and a text is followed by one end token; texts of any length are scored whole; a null
id is hashed as empty text, so held out; repeated rows train and are scored like others; further columns are ignored. An
empty table gives no rows; where nothing is left for training, N is 0, every word is unknown and P1 is uniform.
"""

from __future__ import annotations

import uuid
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import elias_fano
from .common import filesystem, give_back, hashes, load_arrays, save_arrays, scratch_path, slices, words

ADD = 0.1
DISCOUNT = 0.75
#: log10 steps of stored probabilities and weights.
STEP = 1 / 4096
#: The end token's string; no word can be equal to it.
END = "\n"
#: Occurrences that a shard stands for, about, and so the most nodes it can have.
SHARD = 1_500_000
#: Shards of level 1 at most, and for each task that reads.
WORD_SHARDS = 4096
#: Rows of counts a task gathers before it passes them on.
GATHER = 1_500_000
#: Bytes of text that are worked on together.
SLICE = 8 << 20
#: Shards a worker keeps open: mapped ones, and ones it had to read.
OPEN, READ = 4096, 32


def quantise(p: np.ndarray) -> np.ndarray:
    return np.minimum(65535, np.round(-np.log10(np.maximum(p, 1e-16)) / STEP)).astype(np.uint16)


def pack(*arrays: np.ndarray) -> bytes:
    """Non-negative numbers, byte by byte: all lowest bytes, then all second ones, as far as the largest number goes."""
    out = []
    for x in arrays:
        x = np.ascontiguousarray(x).astype("<u8")
        size = max(1, (int(x.max(initial=0)).bit_length() + 7) // 8)
        out += [bytes([size]), x.view(np.uint8).reshape(-1, 8)[:, :size].T.tobytes()]
    return b"".join(out)


def unpack(data: bytes, n: int, arrays: int) -> list[np.ndarray]:
    out, at = [], 0
    for _ in range(arrays):
        size = data[at]
        x = np.zeros((n, 8), np.uint8)
        x[:, :size] = np.frombuffer(data, np.uint8, n * size, at + 1).reshape(size, n).T
        out.append(x.view("<u8").ravel().astype(np.int64))
        at += 1 + n * size
    return out


def starts_of(x: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64)


@dataclass
class Words:
    """Level 1, one line a shard: file, words before it, first hash."""

    files: list[str]
    base: np.ndarray
    first: np.ndarray
    size: int


class Level:
    """One line a shard: file ("" where it has no nodes), nodes before it, and the context it begins with. Neighbours that
    begin with the same context are the parts of that one, dealt by its children's words."""

    def __init__(self, context: np.ndarray, words: int):
        self.context, self.words = context, words
        first = starts_of(context)
        self.leader = np.repeat(first, np.diff(np.append(first, len(context))))
        self.parts = np.repeat(np.diff(np.append(first, len(context))), np.diff(np.append(first, len(context))))
        self.files: list[str] = []
        self.base, self.size = np.zeros(len(context), np.int64), 0

    def fill(self, lines: dict[int, tuple[str, int]]) -> None:
        """``lines``: file and number of nodes by shard."""
        self.files = [lines[i][0] if i in lines else "" for i in range(len(self.context))]
        sizes = np.array([lines[i][1] if i in lines else 0 for i in range(len(self.context))], np.int64)
        self.base, self.size = np.cumsum(sizes) - sizes, int(sizes.sum())

    def shard(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        at = np.maximum(np.searchsorted(self.context, context, "right") - 1, 0)
        split = np.flatnonzero(self.parts[at] > 1)
        at[split] = self.leader[at[split]] + word[split] * self.parts[at[split]] // self.words
        return at


class Shard:
    def __init__(self, folder: str, name: str):
        a = load_arrays(folder, name)
        pick = lambda p: elias_fano.EliasFano({k[len(p) :]: x for k, x in a.items() if k.startswith(p)})
        self.first, self.contexts, self.n = (int(x) for x in a["head"])
        self.pointers, self.values = pick("p_"), pick("v_")
        self.prob, self.backoff, self.arrays = a["prob"], a["backoff"], a

    def counts(self) -> np.ndarray:
        out = self.arrays["count"].astype(np.int64)
        out[self.arrays["at"]] = self.arrays["large"]
        return out

    def bounds(self, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first child, child after the last, offset of the values) of the contexts, which the shard must span."""
        lo, hi = self.pointers.access(c - self.first), self.pointers.access(c - self.first + 1)
        return lo, hi, np.where(lo > 0, self.values.access(np.maximum(lo - 1, 0)) + 1, 0)


def by_shard(shard: np.ndarray) -> Iterator[tuple[int, np.ndarray | slice]]:
    """Each shard with the places of its items; slices where these are in order."""
    if (shard[1:] >= shard[:-1]).all():
        first = starts_of(shard)
        for a, b in zip(first.tolist(), [*first[1:].tolist(), len(shard)]):
            yield int(shard[a]), slice(a, b)
        return
    order = np.argsort(shard.astype(np.uint16) if shard.max() < 1 << 16 else shard, kind="stable")  # 16 bits: in linear time
    for s, m in by_shard(shard[order]):
        yield s, order[m]


class Model:
    """Reader of the levels so far; lives in each worker."""

    def __init__(self, folder: str, words: Words, levels: list[Level], total: int, add: float):
        self.folder, self.words, self.levels, self.total, self.add = folder, words, levels, total, add
        self.open: OrderedDict[str, object] = OrderedDict()
        self.most = OPEN if isinstance(filesystem(folder)[0], pafs.LocalFileSystem) else READ

    def p1(self, count: np.ndarray) -> np.ndarray:
        return (count + self.add) / (self.total + self.add * (self.words.size + 1))

    def _file(self, name: str, make=Shard):
        if name not in self.open:
            self.open[name] = make(self.folder, name)
            if len(self.open) > self.most:
                self.open.popitem(last=False)
        self.open.move_to_end(name)
        return self.open[name]

    def look_up(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(id or -1, count) of words by ascending hash."""
        ids, count = np.full(len(h), -1, np.int64), np.zeros(len(h), np.int64)
        if not self.words.files:
            return ids, count
        for s, m in by_shard(np.searchsorted(self.words.first, h, "right") - 1):
            if s >= 0:
                a = self._file(self.words.files[s], load_arrays)
                at = np.minimum(np.searchsorted(a["hash"], h[m]), len(a["hash"]) - 1)
                hit = a["hash"][at] == h[m]
                ids[m], count[m] = np.where(hit, self.words.base[s] + at, -1), np.where(hit, a["count"][at], 0)
        return ids, count

    def uses(self, k: int, node: np.ndarray) -> np.ndarray:
        """The counts of nodes of level k."""
        out = np.zeros(len(node), np.int64)
        base = self.words.base if k == 1 else self.levels[k - 2].base
        for s, m in by_shard(np.searchsorted(base, node, "right") - 1):
            if k == 1:
                out[m] = self._file(self.words.files[s], load_arrays)["count"][node[m] - base[s]]
            else:
                out[m] = self._file(self.levels[k - 2].files[s]).counts()[node[m] - base[s]]
        return out

    def children(self, k: int, context: np.ndarray, place: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of (context, place) in ascending order, the nodes of level k, or -1, by successor search among the context's
        children; and the nodes' probabilities, or else the contexts' back-off weights, in steps."""
        level, out, steps = self.levels[k - 2], np.full(len(context), -1, np.int64), np.zeros(len(context), np.uint16)
        for s, m in by_shard(level.shard(context, word)):
            own = context[m]
            if not level.files[s]:
                if level.parts[s] > 1:
                    steps[m] = self.weights(k, own)
                continue
            part, new = self._file(level.files[s]), starts_of(own)
            c = own[new]
            there = (c >= part.first) & (c < part.first + part.contexts)
            c = np.where(there, c, part.first)
            lo, hi, offset = part.bounds(c)
            hi = np.where(there, hi, -1)
            size = np.diff(np.append(new, len(own)))
            at, equal = part.values.find(np.repeat(offset, size) + place[m])
            hit = equal & (at < np.repeat(hi, size)) & (at >= np.repeat(lo, size))
            out[m] = np.where(hit, level.base[s] + at, -1)
            steps[m] = np.where(hit, part.prob[np.where(hit, at, 0)], np.repeat(np.where(there, part.backoff[c - part.first], 0), size))
        return out, steps

    def weights(self, k: int, context: np.ndarray) -> np.ndarray:
        """Back-off weights of contexts (nodes of level k - 1) in steps, zero for those without stored children."""
        level, out = self.levels[k - 2], np.zeros(len(context), np.uint16)
        shard = np.searchsorted(level.context, context, "right") - 1
        for s, m in by_shard(shard):
            s = level.leader[s] + next((i for i in range(level.parts[s]) if level.files[level.leader[s] + i]), 0)
            if level.files[s]:
                part = self._file(level.files[s])
                own = context[m] - part.first
                there = (own >= 0) & (own < part.contexts)
                out[m] = np.where(there, part.backoff[np.where(there, own, 0)], 0)
        return out

    def firsts(self, k: int, context: np.ndarray) -> np.ndarray:
        """The first child's node of level k of ascending contexts that have children; any number for others."""
        level, first = self.levels[k - 2], np.zeros(len(context), np.int64)
        for s, m in by_shard(level.leader[np.maximum(np.searchsorted(level.context, context, "right") - 1, 0)]):
            first[m] = level.base[s]
            if level.files[s] and level.parts[s] == 1:
                part = self._file(level.files[s])
                first[m] += part.pointers.access(np.clip(context[m] - part.first, 0, part.contexts))
        return first


_models: dict[str, Model] = {}


def _model(spec: tuple) -> Model:
    """The worker's reader; kept from task to task."""
    key = f"{spec[0]} {len(spec[2])}"
    if key not in _models:
        _models.clear()
        _models[key] = Model(*spec)
    return _models[key]


@dataclass
class Tokens:
    """The tokens of a slice of rows, each row's end token included."""

    offsets: np.ndarray
    ids: np.ndarray
    counts: np.ndarray
    first: np.ndarray
    codes: np.ndarray
    known: np.ndarray  # the id of each code
    logs: np.ndarray  # log10 of P1 of each code


def _coded(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row offsets, codes that ascend with the hash, and hashes by code; the end token is not among the codes."""
    offsets, codes, distinct = words(texts, lower=True)
    h = np.append(hashes(distinct), np.uint64(xxhash.xxh64_intdigest(END)))
    order = np.argsort(h)
    place = np.empty(len(h), np.int64)
    place[order] = np.arange(len(h))
    return offsets, np.append(place[codes], place[-1]), h[order]


def tokens(texts: pa.Array, model: Model) -> Tokens:
    offsets, codes, h = _coded(texts)
    ids, counts = model.look_up(h)
    codes = np.insert(codes[:-1], offsets[1:], codes[-1])
    offsets = offsets + np.arange(len(offsets))
    first = np.zeros(len(codes), bool)
    first[offsets[:-1]] = True
    return Tokens(offsets, ids[codes], counts[codes], first, codes, ids, np.log10(model.p1(counts)))


def distinct(context: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, starts): an order by context and place, and where in it each distinct pair begins."""
    width = int(place.max(initial=0)) + 1
    if (int(context.max(initial=0)) + 1) * width < 1 << 63:
        key = context * width + place
        order = np.argsort(key)
        return order, starts_of(key[order])
    order = np.lexsort((place, context))
    new = (np.diff(context[order]) != 0) | (np.diff(place[order]) != 0)
    return order, np.flatnonzero(np.concatenate([[True], new]))


def climb(model: Model, t: Tokens, visit=None) -> tuple[list[np.ndarray], list[np.ndarray], list[np.ndarray]]:
    """For k = 1, 2, ..., the node of level k that ends at each token, or -1; from k = 2 on, what ``children`` says of it in
    steps, and whether it was asked. ``visit(context, place, word, steps, order, starts)`` gets what the next level's look-ups
    would ask for: of the tokens that have them, the context, the place among its children, the word and the shorter n-gram's
    probability in steps (level 3 on), and how to put these in order."""
    nodes, values, asked = [t.ids], [np.zeros(0, np.uint16)], [np.zeros(0, bool)]
    # how many tokens of its row stand before each
    depth = np.arange(len(t.ids)) - np.repeat(t.offsets[:-1], np.diff(t.offsets))
    for k in range(2, len(model.levels) + 3):
        if k > len(model.levels) + 1 and not visit:
            break
        context = np.full(len(t.ids), -1, np.int64)
        context[1:] = nodes[-1][:-1]
        has = (context >= 0) & (nodes[-1] >= 0) & (depth >= k - 1)
        at = np.flatnonzero(has)
        context, place = context[at], nodes[-1][at]
        if k > 2 and len(at):
            # the shorter n-gram's place among the children of its own context, which ends one token earlier
            if k == 3:
                some = np.flatnonzero(t.known >= 0)  # ids ascend with the codes
                first = np.zeros(len(t.known), np.int64)
                first[some] = model.firsts(2, t.known[some])
                place = place - first[t.codes[at - 1]]
            else:
                one, inverse = np.unique(nodes[-2][at - 1], return_inverse=True)
                place = place - model.firsts(k - 1, one)[inverse]
        order, starts = distinct(context, place)
        if k > len(model.levels) + 1:
            visit(context, place, t.ids[at], values[-1][at] if k > 2 else None, order, starts)
            break
        one = order[starts]
        found, steps = model.children(k, context[one], place[one], t.ids[at[one]])
        size, to = np.diff(np.append(starts, len(order))), at[order]
        nodes.append(np.full(len(t.ids), -1, np.int64))
        values.append(np.zeros(len(t.ids), np.uint16))
        nodes[-1][to], values[-1][to] = np.repeat(found, size), np.repeat(steps, size)
        asked.append(has)
    return nodes, values, asked


def _merge(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """Distinct (context, place) of parts (context, place, n, ...) in order, with the sums of n."""
    if len(parts) == 1:
        return parts[0]
    columns = [np.concatenate([p[i] for p in parts]) for i in range(len(parts[0]))]
    order, starts = distinct(columns[0], columns[1])
    n = np.add.reduceat(columns[2][order], starts) if len(starts) else columns[2]
    one = order[starts]
    return columns[0][one], columns[1][one], n, *(c[one] for c in columns[3:])


BLOBS = "bucket int, rows int, data binary"


def _blobs(parts: tuple[np.ndarray, ...], bucket: np.ndarray) -> pa.RecordBatch:
    """Counts (context, place, n, ...) in order, and the ascending shard of each, as one row a shard, contexts as differences."""
    cut = starts_of(bucket)
    ends = [*cut[1:].tolist(), len(bucket)]
    gap = np.concatenate([parts[0][:1], np.diff(parts[0])])
    gap[cut] = parts[0][cut]
    data = [pack(gap[a:b], *(p[a:b] for p in parts[1:])) for a, b in zip(cut.tolist(), ends)]
    return pa.record_batch([pa.array(bucket[cut].astype(np.int32)), pa.array(np.diff(np.append(cut, len(bucket))).astype(np.int32)), pa.array(data, pa.binary())], names=["bucket", "rows", "data"])


def _gathered(batches: Iterator[pa.RecordBatch], count, deal) -> Iterator[pa.RecordBatch]:
    """``count`` of each slice, summed over a task as far as GATHER rows go, and dealt by ``deal`` of the columns."""

    def passed_on(held):
        got = _merge(held)
        bucket = deal(got)
        if not (bucket[1:] >= bucket[:-1]).all():  # parts of a split context, from level 3 on
            order = np.argsort(bucket, kind="stable")
            got, bucket = tuple(x[order] for x in got), bucket[order]
        return _blobs((*got[:3], *got[4:]), bucket)  # without the word

    held, rows = [], 0
    for batch in batches:
        for part in slices(batch, most=SLICE):
            held.append(count(part.column("text")))
            rows += len(held[-1][0])
            if rows >= GATHER:
                yield passed_on(held)
                held, rows = [], 0
    if rows:
        yield passed_on(held)
    held = None
    give_back()


def _shards(training: DataFrame, count, deal, shards: int, columns: int, write, schema: str) -> list:
    """Count, shuffle once, and ``write(shard, merged columns)`` each shard; the lines that it returns."""
    parts = training.select("text").mapInArrow(lambda it: _gathered(it, count, deal), BLOBS)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = -1, []
        for batch in batches:
            for bucket, rows, data in zip(*(batch.column(c).to_pylist() for c in ("bucket", "rows", "data"))):
                if bucket != at and held:
                    yield from write(at, _merge(held))
                    held = []
                at = bucket
                gap, *rest = unpack(data, rows, columns)
                held.append((np.cumsum(gap), *rest))
        if held:
            yield from write(at, _merge(held))
        held = None
        give_back()

    # a task has one shard at a time in memory, so that it does not matter how many it gets
    return parts.repartition(shards, "bucket").sortWithinPartitions("bucket").mapInArrow(work, schema).collect()  # one row a shard


def _count_words(texts: pa.Array) -> tuple[np.ndarray, ...]:
    offsets, codes, h = _coded(texts)
    n = np.bincount(codes[:-1], minlength=len(h))
    n[codes[-1]] += len(offsets) - 1
    some = np.flatnonzero(n)
    # the hash in two halves, as the numbers of a context and a place are signed
    return (h[some] >> np.uint64(32)).astype(np.int64), (h[some] & np.uint64(0xFFFFFFFF)).astype(np.int64), n[some], some


def _first_level(training: DataFrame, folder: str) -> tuple[Words, int]:
    """Level 1, and the number of training tokens."""
    run, shards = uuid.uuid4().hex[:8], max(1, min(WORD_SHARDS, training.rdd.getNumPartitions()))

    def write(shard: int, got: tuple[np.ndarray, ...]) -> Iterator[pa.RecordBatch]:
        name, h = f"{run}-1-{shard:06d}", (got[0].astype(np.uint64) << np.uint64(32)) | got[1].astype(np.uint64)
        save_arrays(folder, name, {"hash": h, "count": got[2].astype(np.uint32 if got[2].max() < 1 << 32 else np.int64)})
        yield pa.record_batch([pa.array([x]) for x in (name, len(h), int(got[2].sum()))], names=["file", "n", "total"])

    rows = _shards(training, _count_words, lambda got: got[0] * shards >> 32, shards, 3, write, "file string, n long, total long")
    rows = sorted(rows, key=lambda r: r["file"])
    sizes = np.array([r["n"] for r in rows], np.int64)
    # shard i has the hashes from i / shards of their range on
    first = np.array([-(-(int(r["file"][-6:]) << 32) // shards) << 32 for r in rows], np.uint64)
    return Words([r["file"] for r in rows], np.cumsum(sizes) - sizes, first, int(sizes.sum())), sum(r["total"] for r in rows)


def ranges(uses: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(first, parts) of ranges of contexts that occur ``uses`` times, of about ``most`` occurrences each; a context that
    alone occurs more often is a range by itself, of several parts."""
    large = uses > most
    total = np.cumsum(np.where(large, 0, uses)) // most
    new = np.concatenate([[True], (np.diff(total) != 0) | large[1:] | large[:-1]])
    first = np.flatnonzero(new)
    return first, np.where(large[first], -(-uses[first] // most), 1)


def _dealt(training: DataFrame, spec: tuple) -> Level:
    """The shards of the next level, empty yet: ranges of contexts, none of which goes beyond a shard of the last level."""
    folder, words_, levels = spec[:3]
    files, base = (words_.files, words_.base) if not levels else (levels[-1].files, levels[-1].base)
    most = SHARD

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, before in zip(batch.column("file").to_pylist(), batch.column("base").to_pylist()):
                first, parts = ranges(load_arrays(folder, name)["count"].astype(np.int64) if not levels else Shard(folder, name).counts(), most)
                yield pa.record_batch([pa.array(first + before), pa.array(parts)], names=["context", "parts"])

    lines = [(f, int(b)) for f, b in zip(files, base) if f]
    spark = training.sparkSession
    rows = spark.createDataFrame(lines, "file string, base long").repartition(max(1, min(len(lines), 1000)), "file").mapInArrow(work, "context long, parts long").toArrow() if lines else None
    context, parts = (rows[c].to_numpy() for c in ("context", "parts")) if lines else (np.zeros(0, np.int64),) * 2
    order = np.argsort(context)
    return Level(np.repeat(context[order], parts[order]), words_.size)


def _save(folder: str, name: str, model: Model, k: int, got: tuple[np.ndarray, ...], discount: float, mass: float | None, last: bool) -> None:
    """A shard's file, from its (context, place, n, steps of the shorter n-gram's probability)."""
    context, place, n = got[:3]
    start = starts_of(context)
    own, size = context[start], np.diff(np.append(start, len(context)))
    uses = model.uses(k - 1, own)
    total = np.add.reduceat(n - discount, start) if mass is None else np.array([mass])
    backoff = np.maximum(1 - total / uses, 1e-9)
    shorter = model.p1(model.uses(1, place)) if k == 2 else 10 ** (-STEP * got[3])
    prob = np.maximum(n - discount, 0) / np.repeat(uses, size) + np.repeat(backoff, size) * shorter
    first, contexts = int(own[0]), int(own[-1] - own[0]) + 1
    pointers, weights = np.zeros(contexts + 1, np.int64), np.zeros(contexts, np.uint16)
    pointers[own - first + 1] = size
    weights[own - first] = quantise(backoff)
    top = place[start + size - 1] + 1
    values = place + np.repeat(np.cumsum(top) - top, size)
    arrays = {"head": np.array([first, contexts, len(n)]), "prob": quantise(prob), "backoff": weights}
    if not last:
        at = np.flatnonzero(n > 255)
        arrays |= {"count": np.minimum(n, 255).astype(np.uint8), "at": at, "large": n[at]}
    arrays |= {f"p_{c}": x for c, x in elias_fano.encode(np.cumsum(pointers), len(n) + 1).items()}
    arrays |= {f"v_{c}": x for c, x in elias_fano.encode(values, int(top.sum())).items()}
    save_arrays(folder, name, arrays)


def _next_level(training: DataFrame, spec: tuple, discount: float, least: int, last: bool) -> Level:
    k, folder, run = len(spec[2]) + 2, spec[0], uuid.uuid4().hex[:8]
    level = _dealt(training, spec)
    if not len(level.context):
        return level

    def count(texts: pa.Array) -> tuple[np.ndarray, ...]:
        """context, place, n, word and, from level 3 on, the steps of the shorter n-gram's probability."""
        model, found = _model(spec), []

        def visit(context, place, word, steps, order, starts):
            one = order[starts]
            found.append((context[one], place[one], np.diff(np.append(starts, len(order))), word[one]))
            if k > 2:
                found[0] += (steps[one].astype(np.int64),)

        climb(model, tokens(texts, model), visit)
        return found[0]

    def write(shard: int, got: tuple[np.ndarray, ...]) -> Iterator[pa.RecordBatch]:
        keep = got[2] >= least
        got = got if keep.all() else tuple(x[keep] for x in got)
        if len(got[0]):
            name = f"{run}-{k}-{shard:09d}"
            split = bool(level.parts[shard] > 1)
            if split:
                save_arrays(folder, f"{name}-raw", {str(i): x for i, x in enumerate(got)})
            else:
                _save(folder, name, _model(spec), k, got, discount, None, last)
            columns = (shard, name, len(got[0]), float((got[2] - discount).sum()))
            yield pa.record_batch([pa.array([x]) for x in columns], names=["shard", "file", "n", "mass"])

    rows = _shards(training, count, lambda got: level.shard(got[0], got[3]), len(level.context), 3 + (k > 2), write, "shard long, file string, n long, mass double")
    level.fill({r["shard"]: (r["file"], r["n"]) for r in rows})
    split = [(r["file"], r["shard"], r["mass"]) for r in rows if level.parts[r["shard"]] > 1]
    if split:
        whole: dict[int, float] = {}
        for _, shard, mass in split:
            whole[int(level.leader[shard])] = whole.get(int(level.leader[shard]), 0.0) + mass

        def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for name, mass in zip(batch.column("file").to_pylist(), batch.column("mass").to_pylist()):
                    raw = load_arrays(folder, f"{name}-raw")
                    _save(folder, name, _model(spec), k, tuple(raw[str(i)] for i in range(len(raw))), discount, mass, last)
                    yield pa.record_batch([pa.array([name])], names=["file"])
            give_back()

        parts = training.sparkSession.createDataFrame([(f, whole[int(level.leader[i])]) for f, i, _ in split], "file string, mass double")
        parts.repartition(min(len(split), 1000), "file").mapInArrow(finish, "file string").count()
        store, base = filesystem(folder)
        for f, _, _ in split:
            store.delete_file(f"{base}/{f}-raw")
    return level


def train(training: DataFrame, order: int = 3, least: int = 1, discount: float = DISCOUNT, add: float = ADD, folder: str | None = None) -> tuple:
    """The model of all rows of ``training`` (text): (folder, words, levels, tokens, add), which ``Model`` opens."""
    folder = folder or scratch_path(training.sparkSession, "ngrams")
    first, total = _first_level(training, folder)
    levels: list[Level] = []
    while len(levels) < order - 1 and (levels[-1] if levels else first).size:
        levels.append(_next_level(training, (folder, first, list(levels), total, add), discount, least, len(levels) == order - 2))
    return folder, first, [v for v in levels if v.size], total, add


def log_probs(model: Model, t: Tokens) -> np.ndarray:
    """log10 probability of each token given those before it in its row."""
    out, (nodes, values, asked) = t.logs[t.codes], climb(model, t)
    for k in range(2, len(nodes) + 1):
        node, step = nodes[k - 1], -STEP * values[k - 1]
        out = np.where(node >= 0, step, out + step)
        # the weight of a context whose look-up could not be asked, as the shorter n-gram is not stored
        context = np.full(len(out), -1, np.int64)
        context[1:] = nodes[k - 2][:-1]
        back = np.flatnonzero((context >= 0) & ~asked[k - 1] & ~t.first)
        if len(back):
            out[back] -= STEP * model.weights(k, context[back])
    return out


def score(docs: DataFrame, spec: tuple) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row of ``docs`` (doc_id, text, held_out)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            model = _model(spec)
            for part in slices(batch, most=SLICE):
                t = tokens(part.column("text"), model)
                add = lambda x: np.add.reduceat(x, t.offsets[:-1]) if len(x) else x  # noqa: E731  every row has a token
                columns = [part.column("doc_id").cast(pa.int64()), part.column("held_out"), pa.array(np.diff(t.offsets)), pa.array(add((t.counts > 0).astype(np.int64)))]
                columns += [pa.array(np.full(part.num_rows, model.total, np.int64)), pa.array(add(t.logs[t.codes])), pa.array(add(log_probs(model, t)))]
                yield pa.record_batch(columns, names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])
                del t, columns
        give_back()

    return docs.mapInArrow(work, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def split(docs: DataFrame) -> DataFrame:
    """(doc_id, text, held_out): held out are ids whose text's CRC-32 is divisible by ten."""
    return docs.select("doc_id", "text", (F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 10 == 0).alias("held_out"))


def learn_and_score(docs: DataFrame, order: int = 3, least: int = 1) -> DataFrame:
    parts = split(docs)
    return score(parts, train(parts.where("not held_out"), order, least))
