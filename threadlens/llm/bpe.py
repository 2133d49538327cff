"""Byte-level byte-pair encoding and decoding of whole texts, with ids equal to those of the vocabulary's library.

A pre-token's symbols form a doubly linked list, and the possible merges a priority queue ordered by (rank, position).
The best entry is taken; it is stale, and skipped, if either of its symbols has since been merged into another. A merge
rewrites the left symbol, unlinks the right one and queues the two new neighbours. Decoding concatenates the vocabulary
strings of the ids as bytes and reads them as UTF-8 (malformed parts become U+FFFD).

Texts are encoded by chunk, a chunk being a space and what follows up to the next: where every chunk starts and ends
with something other than white space, no pre-token crosses from one to the next. Each distinct chunk is encoded once
for as long as a worker's memory holds it (a bounded number of chunks). Other texts, and those with an added token's
string in them, are pre-split as a whole.

Defined cases: null text is empty; an empty text has no tokens; rows are independent, so repeated rows, ties and further
columns change nothing (columns named like the added ones are replaced). An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import IdCache, slices

#: The library's pre-tokenizer pattern; a fixed value.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
REMEMBER = 200_000


def byte_symbols() -> list[str]:
    """The character that stands for each byte in the vocabulary: itself if printable, else the next from U+0100 on."""
    shown = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    spare = iter(range(256, 512))
    return [chr(b if b in shown else next(spare)) for b in range(256)]


class ByteBPE:
    def __init__(self, path: str, remember: int = REMEMBER):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        symbol = byte_symbols()
        of = {s: b for b, s in enumerate(symbol)}
        self.byte_id = [vocab[s] for s in symbol]
        self.merges = {}
        for rank, (a, b) in enumerate(spec["model"]["merges"]):
            self.merges[vocab[a], vocab[b]] = rank, vocab[a + b]
        self.strings = {i: bytes(of[c] for c in s) for s, i in vocab.items() if all(c in of for c in s)}
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings |= {i: s.encode() for s, i in self.added.items()}
        self.find = regex.compile(PATTERN).findall
        self.special = regex.compile("(" + "|".join(map(regex.escape, self.added)) + ")") if self.added else None
        self.remember = remember
        every = [self.strings.get(i, b"") for i in range(max(self.strings) + 1)]
        self.string_size = np.array([len(x) for x in every], np.int64)
        self.string_begin = np.cumsum(self.string_size) - self.string_size
        self.string_flat = np.frombuffer(b"".join(every), np.uint8)
        self.cache = IdCache(lambda strings: [self.encode(s) for s in strings], most=1_500_000)
        self.tokens: dict[str, list[int]] = {}

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one pre-token."""
        ids = [self.byte_id[b] for b in piece]
        n = len(ids)
        if n < 2:
            return ids
        merges, queue = self.merges, []
        after, before = list(range(1, n)) + [-1], list(range(-1, n - 1))
        for i in range(n - 1):
            if m := merges.get((ids[i], ids[i + 1])):
                queue.append((m[0], i, ids[i], ids[i + 1], m[1]))
        heapq.heapify(queue)
        while queue:
            _, i, left, right, new = heapq.heappop(queue)
            j = after[i]
            if ids[i] != left or j < 0 or ids[j] != right:
                continue  # stale
            ids[i], ids[j] = new, -1
            k = after[i] = after[j]
            if k >= 0:
                before[k] = i
                if m := merges.get((new, ids[k])):
                    heapq.heappush(queue, (m[0], i, new, ids[k], m[1]))
            if (h := before[i]) >= 0 and (m := merges.get((ids[h], new))):
                heapq.heappush(queue, (m[0], h, ids[h], new, m[1]))
        return [x for x in ids if x >= 0]

    def _plain(self, text: str) -> list[int]:
        out, known = [], self.tokens
        for token in self.find(text):
            if (ids := known.get(token)) is None:
                if len(known) >= self.remember:
                    known.clear()
                ids = self.merge(token.encode())
                if len(token) < 64:
                    known[token] = ids
            out += ids
        return out

    def encode(self, text: str) -> list[int]:
        if self.special is None:
            return self._plain(text)
        out = []
        for i, part in enumerate(self.special.split(text)):
            out += [self.added[part]] if i % 2 else self._plain(part)
        return out

    def decode_bytes(self, ids: list[int]) -> bytes:
        strings = self.strings
        return b"".join([strings[i] for i in ids])

    def decode(self, ids: list[int]) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")

    def round_trip(self, text: str) -> tuple[bytes, bytes]:
        """The ids as little-endian unsigned 32-bit integers, and the bytes that decoding concatenates."""
        ids = self.encode(text)
        return np.array(ids, "<u4").tobytes(), self.decode_bytes(ids)

    def column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Row offsets into the ids, and the ids, of each whole text (null: none)."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        lists = pc.split_pattern(texts, " ")
        offsets = np.asarray(lists.offsets).astype(np.int64)
        coded = lists.values.dictionary_encode()
        codes, strings = np.asarray(coded.indices).astype(np.int64), coded.dictionary.to_pylist()
        odd = np.fromiter((not s or s[0].isspace() or s[-1].isspace() or any(a in s for a in self.added) for s in strings), bool, len(strings))
        odd_row = np.diff(np.concatenate([[0], np.cumsum(odd[codes])])[offsets]) > 0
        # a text's first chunk has no space before it; odd texts are encoded as a whole instead
        own = np.unique(codes[offsets[:-1][~odd_row]])
        whole = texts.filter(pa.array(odd_row)).to_pylist()
        begin, size = self.cache.of([" " + s for s in strings] + [strings[i] for i in own.tolist()])
        first = offsets[:-1]
        n = len(strings)
        used = codes.copy()
        used[first[~odd_row]] = n + np.searchsorted(own, codes[first[~odd_row]])
        size = np.append(size, 0)
        begin = np.append(begin, 0)
        used[np.repeat(odd_row, np.diff(offsets))] = len(size) - 1
        starts, ids = self.cache.gather(offsets, begin[used], size[used])
        if not whole:
            return starts, ids
        parts, it = np.split(ids, starts[1:-1]), iter(whole)
        parts = [np.array(self.encode(next(it)), np.uint32) if o else p for o, p in zip(odd_row.tolist(), parts)]
        return np.concatenate([[0], np.cumsum([len(p) for p in parts])]), np.concatenate(parts)

    def decode_column(self, starts: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row offsets into the bytes, and the bytes, of rows of ids."""
        size = self.string_size[ids]
        stop = np.concatenate([[0], np.cumsum(size)])
        return stop[starts], self.string_flat[np.arange(stop[-1]) - np.repeat(stop[:-1] - self.string_begin[ids], size)]


def _valid(text: memoryview) -> bool:
    try:
        str(text, "utf-8")
        return True
    except UnicodeDecodeError:
        return False


@lru_cache(2)
def codec(path: str) -> ByteBPE:
    return ByteBPE(path)


def encode(docs: DataFrame, path: str, full: bool = True) -> DataFrame:
    """``docs`` (doc_id, text, ...) with n_tokens, ids_sha256, decoded_sha256 and, if ``full``, ids: array<long> and decoded."""
    docs = docs.drop("n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded")
    plain = docs if full else docs.select("doc_id", "text")
    through = plain.columns if full else ["doc_id"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path)
        for batch in batches:
            for part in slices(batch):
                starts, found = bpe.column(part.column("text"))
                at, back = bpe.decode_column(starts, found)
                raw, back = memoryview(found.astype("<u4", copy=False)).cast("B"), memoryview(back)
                h, d, texts = [], [], []
                for a, b, x, y in zip((4 * starts).tolist(), (4 * starts[1:]).tolist(), at.tolist(), at[1:].tolist()):
                    h.append(hashlib.sha256(raw[a:b]).hexdigest())
                    text = back[x:y]
                    if not _valid(text):
                        text = bytes(text).decode("utf-8", "replace").encode()
                    d.append(hashlib.sha256(text).hexdigest())
                    if full:
                        texts.append(bytes(text))
                extra = [pa.array(np.diff(starts)), pa.array(h, pa.string()), pa.array(d, pa.string())]
                if full:
                    extra += [pa.LargeListArray.from_arrays(pa.array(starts), pa.array(found.astype(np.int64))).cast(pa.list_(pa.int64())), pa.array(texts, pa.binary()).cast(pa.string())]
                names = ["n_tokens", "ids_sha256", "decoded_sha256", *["ids", "decoded"] * full]
                yield pa.record_batch([*(part.column(c) for c in through), *extra], names=[*through, *names])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema if f.name in through)
    return plain.mapInArrow(work, f"{schema}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<long>, decoded string" * full)


def decode(tokens: DataFrame, path: str) -> DataFrame:
    """``tokens`` (ids: array<long>, ...) with ``decoded``; a null array decodes to null."""

    @F.pandas_udf("string")
    def text(ids):
        bpe = codec(path)
        return ids.map(lambda x: None if x is None else bpe.decode(list(x)))

    return tokens.withColumn("decoded", text("ids"))
