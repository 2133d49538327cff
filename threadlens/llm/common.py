"""Shared pieces of the training-data operators: scratch tables, word splitting and vectorised hashing.

Words are the maximal runs of ``[^\\x20\\x09-\\x0D]`` throughout; ``words()`` splits a whole Arrow column at once and
returns one code per word plus the distinct words, so that anything costly (hashing, encoding, look-ups) is done once
for each distinct word of a batch instead of once for each occurrence.
"""

from __future__ import annotations

import ctypes
import json
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Texts are worked on in slices of about this many bytes, however many rows Spark puts in a batch.
SLICE_BYTES = 8 << 20

_scratch: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or one of our own where that is unset and the master is local
    (tests). On more than one machine it must be set."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="threadlens-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch_path(spark: SparkSession, what: str) -> str:
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    _scratch.append((spark, path))
    return path


def stage(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, and outlives any executor."""
    spark = df.sparkSession
    path = scratch_path(spark, what)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def scratch_count() -> int:
    return len(_scratch)


def delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def release(start: int = 0) -> None:
    """Delete the scratch tables made from the ``start``-th on. Call it when the results that read them are stored."""
    for spark, path in _scratch[start:]:
        delete(spark, path)
    del _scratch[start:]


def slices(batch: pa.RecordBatch, column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of a batch whose texts take about ``most`` bytes; a longer text is a part by itself. Parts are
    copies: some Arrow kernels (ascii_lower) misread arrays that start within another."""
    size = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0)).astype(np.int64)
    cut, start = np.cumsum(size) // most, 0
    for end in [*(np.flatnonzero(np.diff(cut)) + 1).tolist(), batch.num_rows]:
        if end > start:
            yield batch if end - start == batch.num_rows else batch.take(pa.array(np.arange(start, end)))
        start = end


def whole_groups(batches: Iterator[pa.RecordBatch], columns: list[str], most: int) -> Iterator[pa.Table]:
    """Consecutive rows, in tables of about ``most`` or of one group: rows that agree in ``columns``, by which the rows are in
    order, stay together."""
    held, rows, last = [], 0, None
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        key = [np.asarray(batch.column(c)) for c in columns]
        new = np.zeros(n, bool)
        for i, k in enumerate(key):
            new[1:] |= k[1:] != k[:-1]
            new[0] |= last is None or k[0] != last[i]
        last, cuts, done = [k[-1] for k in key], np.flatnonzero(new), 0
        while (i := int(np.searchsorted(cuts, done + max(0, most - rows)))) < len(cuts):
            cut = int(cuts[i])
            if cut > done:
                held.append(batch.slice(done, cut - done))
            if held:
                yield pa.Table.from_batches(held)
            held, rows, done = [], 0, cut
        held.append(batch.slice(done))
        rows += n - done
    if held:
        yield pa.Table.from_batches(held)


def words(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Row offsets into the words, a code for each word, and the distinct words by code. Null texts have no words.
    ``lower`` folds A-Z only."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    values, offsets = lists.values, np.asarray(lists.offsets).astype(np.int64)
    full = np.asarray(pc.greater(pc.binary_length(values), 0))
    if not full.all():
        values, offsets = values.filter(pa.array(full)), np.concatenate([[0], np.cumsum(full)])[offsets]
    coded = values.dictionary_encode()
    return offsets, np.asarray(coded.indices).astype(np.int64), coded.dictionary


#: Odd multipliers, one for each seed.
_BASES = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)
_LONG = 256
_PART = 1 << 17


_power_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 of i below n or more; one table a base, which grows."""
    if base not in _power_tables or len(_power_tables[base][0]) < n:
        size = 1 << max(10, n.bit_length())
        up, down = np.full(size, base, np.uint64), np.full(size, pow(base, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        _power_tables[base] = np.cumprod(up), np.cumprod(down)
    return _power_tables[base]


def give_back() -> None:
    """Return freed memory to the system: a worker that waits for its next task should not hold its last one's."""
    _power_tables.clear()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


class Rolling:
    """Polynomial hashes modulo 2**64 of any range of a sequence of numbers, from one prefix sum."""

    def __init__(self, h: np.ndarray, base: int = _BASES[0]):
        self.up, down = _powers(base, len(h) + 1)
        self.sums = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(h * down[: len(h)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.up[np.maximum(end - 1, 0)]

    def every(self, k: int) -> np.ndarray:
        n = max(0, len(self.sums) - k)
        return (self.sums[k:] - self.sums[:n]) * self.up[k - 1 : k - 1 + n]


def hashes(distinct: pa.Array, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each string (independent ones by seed 0, 1, 2): a polynomial of its bytes and length, mixed; XXH64
    for strings of more than 256 bytes, which could be built to collide."""
    if not len(distinct):
        return np.zeros(0, np.uint64)
    distinct = distinct.cast(pa.large_string())
    _, offsets, data = distinct.buffers()
    at = np.frombuffer(offsets, np.int64)[distinct.offset : distinct.offset + len(distinct) + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    at = at - at[0]
    size, out = np.diff(at), np.zeros(len(distinct), np.uint64)
    # in parts, so that the table of powers stays small
    cut = [0, *(np.flatnonzero(np.diff(at[:-1] // _PART)) + 1).tolist(), len(distinct)]
    for i, j in zip(cut, cut[1:]):
        j -= at[j] - at[i] > 2 * _PART  # then the last one is long
        part = Rolling(raw[at[i] : at[j]].astype(np.uint64) + np.uint64(1), _BASES[seed]).of(at[i:j] - at[i], at[i + 1 : j + 1] - at[i])
        out[i:j] = mix(mix(part ^ np.uint64(_BASES[seed])) + size[i:j].astype(np.uint64))
    for i in np.flatnonzero(size > _LONG).tolist():
        out[i] = xxhash.xxh64_intdigest(raw[at[i] : at[i + 1]].tobytes(), seed)
    return out


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on uint64 that spreads every input bit (the public splitmix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def rows_of(offsets: np.ndarray) -> np.ndarray:
    """For each word, the row it belongs to."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def ordered(x: np.ndarray) -> np.ndarray:
    """Doubles as longs in the same order."""
    bits = (x + 0.0).view(np.int64)
    return np.where(bits < 0, bits ^ np.int64((1 << 63) - 1), bits)


def unordered(x: int) -> float:
    """The double of which ``ordered`` makes this long."""
    return float(np.array([x if x >= 0 else x ^ ((1 << 63) - 1)], np.int64).view(np.float64)[0])


def kth_key(keys: DataFrame, column: str, k: int) -> int | None:
    """The k-th greatest of a column of longs, or None if there are fewer than k."""
    keys = keys.select(F.col(column).bitwiseXOR(F.lit(-(1 << 63))).alias("_u"))  # the order of unsigned numbers
    prefix, left = None, k
    for shift in (48, 32, 16, 0):
        part = keys if prefix is None else keys.where(F.shiftrightunsigned("_u", shift + 16) == prefix)
        got = part.groupBy((F.shiftrightunsigned("_u", shift).bitwiseAND(0xFFFF)).alias("digit")).count().collect()  # at most 65,536 rows
        for digit, n in sorted(((r["digit"], r["count"]) for r in got), reverse=True):
            if left <= n:
                prefix = digit if prefix is None else (prefix << 16) | digit
                break
            left -= n
        else:
            return None
    return prefix - (1 << 63)


class IdCache:
    """Token ids of strings, learned from ``learn`` (strings to lists of ids) once and then found by a 128-bit hash in
    sorted arrays, some 50 bytes a string. The arrays are emptied when they would hold more than ``most`` strings."""

    def __init__(self, learn: Callable[[list[str]], list[list[int]]], most: int = 1_200_000):
        self.learn, self.most = learn, most
        self.clear()

    def clear(self) -> None:
        self.key = self.check = np.zeros(0, np.uint64)
        self.begin, self.size = np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0

    def _add(self, strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
        sizes = []
        for i in range(0, len(strings), 8192):
            made = self.learn(strings[i : i + 8192])
            sizes += map(len, made)
            new = np.fromiter(chain.from_iterable(made), np.uint32, sum(map(len, made)))
            while self.used + len(new) > len(self.flat):
                self.flat = np.concatenate([self.flat, np.zeros(len(self.flat), np.uint32)])
            self.flat[self.used : self.used + len(new)] = new
            self.used += len(new)
        size = np.array(sizes, np.int32)
        stop = self.used - int(size.sum()) + np.cumsum(size, dtype=np.int64)
        return stop - size, size

    def of(self, distinct: pa.Array | list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(begin in ``flat``, size) of the ids of each of the distinct strings."""
        if len(self.key) + len(distinct) > self.most:
            self.clear()
        strings = distinct if isinstance(distinct, list) else distinct.to_pylist()
        both = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, strings)), ">u8").astype(np.uint64).reshape(-1, 2)
        key, check = both[:, 0].copy(), both[:, 1].copy()
        at = np.minimum(np.searchsorted(self.key, key), max(0, len(self.key) - 1))
        known = (self.key[at] == key) & (self.check[at] == check) if len(self.key) else np.zeros(len(key), bool)
        new = np.flatnonzero(~known)
        begin, size = np.empty(len(key), np.int64), np.empty(len(key), np.int32)
        begin[known], size[known] = self.begin[at[known]], self.size[at[known]]
        if len(new):
            begin[new], size[new] = self._add([strings[i] for i in new.tolist()])
            by = new[np.argsort(key[new])]
            place = np.searchsorted(self.key, key[by])
            self.key, self.check, self.begin, self.size = (np.insert(old, place, x[by]) for old, x in ((self.key, key), (self.check, check), (self.begin, begin), (self.size, size)))
        return begin, size

    def gather(self, offsets: np.ndarray, begin: np.ndarray, size: np.ndarray, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Row offsets into the ids, and the ids, of rows of strings of which each has ``size`` ids from ``begin`` on. With
        ``end``, each row's ids are followed by that one."""
        within = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
        from_ = np.arange(within[-1]) - np.repeat(within[:-1] - begin, size)
        starts = within[offsets]
        if end is None:
            return starts, self.flat[from_]
        rows = np.diff(starts)
        starts = starts + np.arange(len(offsets))
        out = np.full(starts[-1], end, np.uint32)
        out[np.arange(within[-1]) + np.repeat(np.arange(len(rows)), rows)] = self.flat[from_]
        return starts, out


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """The store of a folder's address and the path there; Hadoop's spellings of a scheme are known to Arrow by plain ones."""
    uri = re.sub(r"^s3[an]://", "s3://", uri)
    uri = re.sub(r"^file:/+|^/+", "file:///", uri)
    return pafs.FileSystem.from_uri(uri)


def save_arrays(folder: str, name: str, arrays: dict[str, np.ndarray]) -> None:
    """One file of named arrays, put in place when complete, so that a task may be run again or twice."""
    store, base = filesystem(folder)
    store.create_dir(base, recursive=True)
    head, at = {}, 0
    for k, x in arrays.items():
        head[k] = [x.dtype.str, len(x), at]
        at += -(-x.nbytes // 64) * 64
    text = json.dumps(head).encode()
    text += b" " * (-(len(text) + 8) % 64)
    hidden = f"{base}/_writing-{name}-{uuid.uuid4().hex}"
    with store.open_output_stream(hidden) as f:
        f.write(len(text).to_bytes(8, "little") + text)
        for x in arrays.values():
            f.write(memoryview(np.ascontiguousarray(x)).cast("B") if len(x) else b"")
            f.write(bytes(-x.nbytes % 64))
    store.move(hidden, f"{base}/{name}")


def load_arrays(folder: str, name: str) -> dict[str, np.ndarray]:
    """The arrays of a file: mapped into memory where the folder is mounted, read otherwise."""
    store, base = filesystem(folder)
    if isinstance(store, pafs.LocalFileSystem):
        data = np.asarray(np.memmap(f"{base}/{name}", np.uint8, "r"))  # a plain view of the mapping
    else:
        with store.open_input_file(f"{base}/{name}") as f:
            data = np.frombuffer(f.read(), np.uint8)
    size = int.from_bytes(data[:8].tobytes(), "little")
    head, body = json.loads(data[8 : 8 + size].tobytes()), data[8 + size :]
    return {k: body[at : at + n * np.dtype(kind).itemsize].view(kind) for k, (kind, n, at) in head.items()}
