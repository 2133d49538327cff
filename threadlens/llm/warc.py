"""WARC archives: a writer with revisit records, and a reader that salvages damaged archives.

*Writing.* Each task writes archives of a gzip member per record to a folder that all executors and later readers share,
each under a temporary name that is renamed when complete, so that a retried or speculative task replaces whole files by
equal ones; beyond ``ROLL`` bytes the next archive begins. Of pages with equal payloads of at least ``least_bytes`` bytes,
one with the largest id is a response and the others are revisits of it, without the payload. Which one of several rows
of that id is decided before writing, for all tasks together.

*Reading.* ``scan`` walks an archive through a buffer of a few MB, whatever the archive's size, in time linear in it. A
member is sound if it inflates with a correct checksum, starts with a version line, has as many bytes as its header says
and the payload its digest names; it is inflated piece by piece, and payloads that are not asked for are not held. After
a failed check the reader searches on for the next offset at which a gzip member, or an uncompressed record's version
line, begins and passes the same checks; what lies between is a quarantined gap, logged with its offset, length and
reason. Everything sound after a gap is recovered. A reader task gets one archive.

Defined cases: a null payload is empty; empty payloads, below or at ``least_bytes``, are records like any other; of
repeated ids with equal payloads one is the response and the others revisit it, those with different payloads are
separate records; a null id is smaller than any other; payloads and archives may have any size; further columns are
ignored; an empty table writes no archive and reads as no records.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import filesystem, scratch_path, stage

VERSION = b"WARC/1.1"
LEAST_BYTES = 0
_MAGIC = b"\x1f\x8b\x08"
_START = re.compile(rb"\x1f\x8b\x08|WARC/1\.[01]\r\n")
#: Bytes of an archive after which the next one begins.
ROLL = 1 << 30
#: Bytes read from a file together, and inflated together.
CHUNK = 4 << 20
INFLATE = 1 << 20


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


@dataclass
class Record:
    """``payload`` is None where it was not asked for; ``size`` is that of the record's body."""

    kind: str
    headers: dict[str, str]
    payload: bytes | None
    size: int
    offset: int


@dataclass
class Gap:
    offset: int
    length: int
    reason: str


def record_bytes(headers: dict[str, str], body: bytes) -> bytes:
    head = b"".join(f"{k}: {v}\r\n".encode() for k, v in headers.items())
    return b"%b\r\n%bContent-Length: %d\r\n\r\n%b\r\n\r\n" % (VERSION, head, len(body), body)


def member(record: bytes, level: int = 1) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(record) + z.flush()


class Source:
    """A file's bytes by offset, through one buffer."""

    def __init__(self, file: pa.NativeFile):
        self.file, self.size, self.base, self.held = file, file.size(), 0, b""

    def at(self, offset: int, n: int) -> memoryview:
        """``n`` bytes, or fewer at the end of the file."""
        n = max(0, min(n, self.size - offset))
        if not self.base <= offset <= offset + n <= self.base + len(self.held):
            self.file.seek(offset)
            self.base, self.held = offset, self.file.read(max(n, CHUNK))
        return memoryview(self.held)[offset - self.base : offset - self.base + n]


class _Member:
    """The inflated bytes of the gzip member at an offset, piece by piece."""

    def __init__(self, source: Source, at: int):
        self.source, self.next, self.step, self.end, self.z = source, at, 1 << 14, None, zlib.decompressobj(31)

    def more(self) -> bytes:
        while self.end is None:
            given = self.z.unconsumed_tail
            if not given:
                given = self.source.at(self.next, self.step)
                self.next, self.step = self.next + len(given), min(2 * self.step, 1 << 18)
            try:
                out = self.z.decompress(given, INFLATE)
            except zlib.error as e:
                raise ValueError(f"gzip: {str(e)[-60:]}") from None
            if self.z.eof:
                self.end = self.next - len(self.z.unused_data)
            elif not out and not len(given):
                raise ValueError("gzip member without end")
            if out:
                return out
        return b""


class _Plain:
    """The bytes from an offset on, piece by piece."""

    def __init__(self, source: Source, at: int):
        self.source, self.next, self.step = source, at, 1 << 14

    def more(self) -> bytes:
        out = bytes(self.source.at(self.next, self.step))
        self.next, self.step = self.next + len(out), min(2 * self.step, 1 << 18)
        return out


class _Pull:
    """Lines and byte counts out of pieces; ``used``: how many bytes have been taken."""

    def __init__(self, more):
        self.more, self.held, self.at, self.used = more, b"", 0, 0

    def _fill(self) -> bool:
        new = self.more()
        self.held, self.at = self.held[self.at :] + new, 0
        return bool(new)

    def line(self) -> bytes:
        pieces, last = [], b""
        while (stop := self.held.find(b"\r\n", self.at)) < 0:
            # all but a last \r, which may begin the line's end, is put aside: a long line is looked through once
            keep = len(self.held) - self.held.endswith(b"\r")
            pieces.append(self.held[self.at : max(self.at, keep)])
            self.at = max(self.at, keep)
            if not self._fill():
                raise ValueError("header without end")
        last = self.held[self.at : stop]
        self.at = stop + 2
        out = b"".join([*pieces, last])
        self.used += len(out) + 2
        return out

    def some(self, n: int) -> bytes:
        """Up to ``n`` bytes, none only at the end."""
        if self.at == len(self.held):
            self._fill()
        out = self.held[self.at : self.at + n]
        self.at, self.used = self.at + len(out), self.used + len(out)
        return out

    def done(self) -> bool:
        return self.at == len(self.held) and not self._fill()


def _record(pull: _Pull, offset: int, keep: bool, ends=None) -> Record:
    """The next record. ``ends(n)``: whether a record may end ``n`` bytes on from here. ValueError says what is wrong."""
    if pull.line() not in (b"WARC/1.1", b"WARC/1.0"):
        raise ValueError("no version line")
    headers = {}
    while line := pull.line():
        name, colon, value = line.partition(b": ")
        if not colon:
            raise ValueError("malformed header line")
        headers[name.decode("utf-8", "replace")] = value.decode("utf-8", "replace")
    if not re.fullmatch("[0-9]{1,18}", headers.get("Content-Length", "")):
        raise ValueError("no content length")
    size = left = int(headers["Content-Length"])
    if ends and not ends(size):
        raise ValueError("length does not match the content")
    sha, body = hashlib.sha1(), []
    while left:
        if not (piece := pull.some(left)):
            raise ValueError("length does not match the content")
        sha.update(piece)
        if keep:
            body.append(piece)
        left -= len(piece)
    tail = b""
    while len(tail) < 4 and (piece := pull.some(4 - len(tail))):
        tail += piece
    if tail != b"\r\n\r\n":
        raise ValueError("length does not match the content")
    kind = headers.get("WARC-Type", "")
    if kind == "response" and "sha1:" + base64.b32encode(sha.digest()).decode() != headers.get("WARC-Payload-Digest"):
        raise ValueError("payload digest differs")
    return Record(kind, headers, b"".join(body) if keep else None, size, offset)


def _sound(source: Source, at: int, keep: bool) -> tuple[list[Record], int]:
    """The records of the member or plain record at ``at``, and the offset after it."""
    if source.at(at, 3) != _MAGIC:
        if source.at(at, 5) != b"WARC/":
            raise ValueError("no version line")
        pull = _Pull(_Plain(source, at).more)
        found = _record(pull, at, keep, lambda n: source.at(at + pull.used + n, 4) == b"\r\n\r\n")
        return [found], at + pull.used
    member = _Member(source, at)
    pull, records = _Pull(member.more), []
    while not pull.done():
        records.append(_record(pull, at, keep))
    if not records:
        raise ValueError("empty member")
    return records, member.end


def _next_start(source: Source, at: int) -> int:
    """The next offset from ``at`` on at which a member or record may begin, or the end of the file."""
    while at < source.size:
        part = source.at(at, 1 << 20)
        if found := _START.search(part):
            return at + found.start()
        if at + len(part) >= source.size:
            break
        at += len(part) - 9
    return source.size


def scan(data: bytes | Source, keep: bool = True) -> Iterator[Record | Gap]:
    """Sound records and quarantined gaps of an archive, in order; with payloads if ``keep``."""
    source = data if isinstance(data, Source) else Source(pa.BufferReader(data))
    at, bad, reason = 0, -1, ""
    while at < source.size:
        try:
            records, end = _sound(source, at, keep)
        except ValueError as e:
            if bad < 0:
                bad, reason = at, str(e)
            at = _next_start(source, at + 1)
            continue
        if bad >= 0:
            yield Gap(bad, at - bad, reason)
            bad = -1
        yield from records
        at = end
    if bad >= 0:
        yield Gap(bad, source.size - bad, reason)


def plan(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """``pages`` (page_id, url, html) as (page_id, url, payload: null for revisits, size, sha, refers_to, is_revisit)."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long"), "url", payload.alias("payload"))
    keyed = rows.withColumns({"sha": F.unhex(F.sha1("payload")), "size": F.octet_length("payload").cast("long")})
    # only digests that occur twice or more need a decision; n: rows in all, twins: several rows of the largest id
    ids = keyed.where(F.col("size") >= least_bytes).groupBy("sha", "page_id").agg(F.count("*").alias("c"))
    largest = F.max(F.struct(F.col("page_id").isNotNull().alias("known"), "page_id", "c"))
    shared = ids.groupBy("sha").agg(largest.alias("l"), F.sum("c").alias("n")).where("n > 1")
    shared = stage(shared.select("sha", F.col("l.page_id").alias("first"), (F.col("l.c") > 1).alias("twins")), "shared")
    told = keyed.join(shared, "sha", "left").withColumn("own", F.col("twins").isNotNull() & F.col("page_id").eqNullSafe(F.col("first")))
    is_revisit = F.col("twins").isNotNull() & ~F.col("own")
    if not shared.where("twins").isEmpty():
        # rows alike in digest and id: stored with a number each, of which the smallest is the response's
        twins = keyed.join(shared.where("twins"), "sha").where(F.col("page_id").eqNullSafe(F.col("first")))
        twins = stage(twins.withColumn("key", F.monotonically_increasing_id()), "twins")
        least = stage(twins.groupBy("sha").agg(F.min("key").alias("least")), "least")
        told = told.where("not (own and twins)").withColumn("is_revisit", is_revisit)
        told = told.unionByName(twins.join(least, "sha").withColumns({"own": F.lit(True), "is_revisit": F.expr("key <> least")}).select(*told.columns))
    else:
        told = told.withColumn("is_revisit", is_revisit)
    return told.select("page_id", "url", F.when(~F.col("is_revisit"), F.col("payload")).alias("payload"), "size", "sha", F.when(F.col("is_revisit"), F.col("first")).alias("refers_to"), "is_revisit")


def write(pages: DataFrame, folder: str, least_bytes: int = LEAST_BYTES, roll: int = ROLL) -> DataFrame:
    """Write ``pages`` to archives in ``folder``; (archive, records, bytes) of each, by running the job."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = filesystem(folder)
        task, done, n, size, out, name, hidden = TaskContext.get().partitionId(), 0, 0, 0, None, "", ""

        def closed() -> pa.RecordBatch:
            out.close()
            store.move(hidden, f"{base}/{name}")
            return pa.record_batch([pa.array([name]), pa.array([n]), pa.array([size])], names=["archive", "records", "bytes"])

        for batch in batches:
            for page, url, payload, length, sha, first, revisit in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "size", "sha", "refers_to", "is_revisit"))):
                if out is None:
                    store.create_dir(base, recursive=True)
                    name, n, size = f"part-{task:06d}-{done:04d}.warc.gz", 0, 0
                    hidden = f"{base}/_writing-{name}-{uuid.uuid4().hex}"
                    out = store.open_output_stream(hidden)
                headers = {"WARC-Type": "revisit" if revisit else "response", "WARC-Record-ID": f"<urn:page:{'' if page is None else page}>", "WARC-Payload-Digest": f"sha1:{base64.b32encode(sha).decode()}", "WARC-Payload-Length": str(length)}
                if url is not None:
                    headers["WARC-Target-URI"] = re.sub(r"[\r\n]+", " ", url)
                if revisit:
                    headers["WARC-Refers-To"] = f"<urn:page:{'' if first is None else first}>"
                raw = member(record_bytes(headers, b"" if revisit else payload))
                out.write(raw)
                n, size = n + 1, size + len(raw)
                if size >= roll:
                    yield closed()
                    out, done = None, done + 1
        if out is not None:
            yield closed()

    return plan(pages, least_bytes).mapInArrow(work, "archive string, records long, bytes long")


SCHEMA = "archive string, offset long, kind string, page_id long, url string, refers_to long, payload_bytes long, payload_digest string, payload binary, gap_bytes long, reason string"


def read(archives: DataFrame, folder: str, payloads: bool = True, strict: bool = False) -> DataFrame:
    """Records and gaps (kind "gap") of ``archives`` (archive: name in ``folder``), one row each. With ``strict``, a gap is an
    error: for archives that have just been written."""

    def page(value: str | None) -> int | None:
        found = re.fullmatch(r"<urn:page:(-?\d+)>", value or "")
        return int(found[1]) if found else None

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = filesystem(folder)
        names = [f.split()[0] for f in SCHEMA.split(", ")]
        schema = pa.schema([pa.field(f.split()[0], {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[f.split()[1]]) for f in SCHEMA.split(", ")])
        for batch in batches:
            for name in batch.column("archive").to_pylist():
                rows, held = [], 0
                with store.open_input_file(f"{base}/{name}") as f:
                    for x in scan(Source(f), keep=payloads):
                        if isinstance(x, Gap):
                            if strict:
                                raise RuntimeError(f"{name}: {x.length} bytes at {x.offset} are damaged: {x.reason}")
                            row = (name, x.offset, "gap", None, None, None, None, None, None, x.length, x.reason)
                        else:
                            h = x.headers
                            size = h.get("WARC-Payload-Length", "")
                            row = (name, x.offset, x.kind, page(h.get("WARC-Record-ID")), h.get("WARC-Target-URI"), page(h.get("WARC-Refers-To")), int(size) if size.isdigit() else x.size,
                                   h.get("WARC-Payload-Digest", "").removeprefix("sha1:"), x.payload, None, None)
                        rows.append(row)
                        held += len(row[8] or b"")
                        if len(rows) >= 10_000 or held > 16 << 20:
                            yield pa.record_batch([pa.array(c, schema.field(i).type) for i, c in enumerate(zip(*rows))], names=names)
                            rows, held = [], 0
                if rows:
                    yield pa.record_batch([pa.array(c, schema.field(i).type) for i, c in enumerate(zip(*rows))], names=names)

    return archives.select("archive").mapInArrow(work, SCHEMA)


def round_trip(spark: SparkSession, pages: DataFrame, least_bytes: int = LEAST_BYTES, payloads: bool = False, roll: int = ROLL) -> DataFrame:
    """Write ``pages`` to archives in the shared folder and read them back."""
    folder = scratch_path(spark, "archives")
    written = stage(write(pages, folder, least_bytes, roll), "written")
    # an archive a task: a fixed number of ranges of names, which Spark does not merge
    return read(written.select("archive").repartitionByRange(max(1, written.count()), "archive"), folder, payloads, strict=True)
