"""WARC archives: writing, reading back, and an index of captures in global order.

Each page becomes one record (WARC 1.1, its own gzip member) in an archive of its task; archives are rows of a
table in the shared folder, as segments of whole records, and ``archive_file`` joins one to a .warc.gz. Of pages with equal payloads of at
least ``REVISIT_BYTES`` the one with the smallest id is a response, the others are revisits of it without a payload.

The index is merged externally: the captures of an archive's segment are sorted where they are read back, which makes a run; all runs
are dealt to ranges of (URL key, time, id), and a loser tree merges the k runs of a range. Ranges follow each other, so the
histories are in global order. Ranges hold about ``RANGE_ROWS`` captures each, however often one URL was captured.

Cases: null html has an empty payload; a null URL gives a record without a target and an empty URL key. Rows that share
the smallest id of a payload are all responses. Null ids are written as such, never referred to. Payloads of any length are
written whole. Captures without a time column get a time from their id. Extra columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut, prepare, stored

REVISIT_BYTES = 100
#: Bytes of an archive and of a segment, before the record that ends it.
ARCHIVE, SEGMENT = 64 << 20, 1 << 20
#: Captures of a range of the merge, about: what a task holds of all its runs.
RANGE_ROWS = 100_000
_EPOCH = datetime(2024, 1, 1, tzinfo=timezone.utc)
_YEAR = 365 * 86400
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"


def _urn(page) -> str:
    return f"<urn:page:{'none' if page is None else page}>"


def record(page, url: str | None, payload: bytes, size: int, digest: str, refers_to, when: str) -> bytes:
    """One record as a gzip member; a revisit's payload is left out, its length and digest are those of the whole."""
    block = _HTTP % size + (payload if refers_to is None else b"")
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_urn(page)}", f"WARC-Date: {when}"]
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(f"%{ord(c):02X}" if ord(c) < 32 or c == "\x7f" else c for c in url))
    head.append(f"WARC-Payload-Digest: sha256:{digest}")
    if refers_to is not None:
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {_urn(refers_to)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    squeeze = zlib.compressobj(1, zlib.DEFLATED, 31)
    return squeeze.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + squeeze.flush()


def records(segment: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """Offset, length, header fields and block of each record of a run of gzip members."""
    at = 0
    while at < len(segment):
        member = zlib.decompressobj(31)
        whole = member.decompress(segment[at:] if at else segment) + member.flush()
        size = len(segment) - at - len(member.unused_data)
        head, _, rest = whole.partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at {at}")
        fields = dict(x.split(": ", 1) for x in lines[1:])
        yield at, size, fields, rest[: int(fields["Content-Length"])]
        at += size


def url_key(url: str | None) -> str:
    """The key that sorts captures of a site together: host parts in reverse order, then the rest, lower-cased."""
    m = re.match(r"[^:/?#]*://([^/?#]*)([^#]*)", url or "")
    if not m:
        return (url or "").lower()
    host = m[1].lower().rpartition("@")[2].split(":")[0]
    return ",".join(reversed(host.removeprefix("www.").split("."))) + ")" + (m[2].lower() or "/")


class LoserTree:
    """Merges sorted runs: each inner node keeps the loser of its match, the winner goes up; a step replays one path."""

    def __init__(self, runs: list[Iterator], key):
        self.runs, self.key = runs, key
        self.k = max(1, len(runs))
        self.heads = [self._pull(i) for i in range(len(runs))] or [None]
        self.losers = [-1] * self.k
        for i in range(self.k):
            self._replay(i)

    def _pull(self, i: int):
        row = next(self.runs[i], None)
        return None if row is None else (self.key(row), i, row)

    def _less(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return y is None if x is not None and y is None else x is not None and x[:2] < y[:2]

    def _replay(self, i: int) -> None:
        at = (i + self.k) // 2
        while at > 0:
            other = self.losers[at]
            if other < 0:  # the tree is being filled: the first to come waits
                self.losers[at] = i
                return
            if self._less(other, i):
                self.losers[at], i = i, other
            at //= 2
        self.losers[0] = i

    def __iter__(self):
        while (head := self.heads[self.losers[0]]) is not None:
            yield head[2]
            i = self.losers[0]
            self.heads[i] = self._pull(i)
            self._replay(i)


def write(pages: DataFrame, page: str = "page_id", url: str = "url", html: str = "html", captured: str | None = None) -> DataFrame:
    """Writes all pages to archives in the shared folder; returns their table (archive, segment, offset, data)."""
    prepare(pages.sparkSession)
    at = F.col(captured).cast("long") if captured else F.lit(None).cast("long")
    rows = pages.select(F.col(page).cast("long").alias("page"), F.col(url).alias("url"), F.encode(F.coalesce(F.col(html), F.lit("")), "UTF-8").alias("payload"), at.alias("at"))
    rows = rows.withColumn("digest", F.sha2("payload", 256)).withColumn("size", F.length("payload"))
    firsts = rows.where(F.col("size") >= REVISIT_BYTES).groupBy("digest").agg(F.min("page").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1 and first is not null").select("digest", "first")
    rows = rows.join(cut(firsts), "digest", "left")
    rows = rows.select("page", "url", "payload", "at", "digest", "size", F.when(F.coalesce(F.col("page") != F.col("first"), F.lit(True)), F.col("first")).alias("refers"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number, segment, offset = TaskContext.get().partitionId(), 0, 0, 0
        held: list[bytes] = []
        size = 0

        def out():
            return pa.RecordBatch.from_arrays([pa.array([f"part-{task:06d}-{number:04d}.warc.gz"]), pa.array([segment], pa.int32()), pa.array([offset], pa.int64()), pa.array([b"".join(held)], pa.binary())], names=["archive", "segment", "offset", "data"])

        for b in batches:
            for row in zip(*[c.to_pylist() for c in b.columns]):
                p, u, payload, when, digest, n, refers = row
                seconds = when if when is not None else (p or 0) % _YEAR
                stamp = (_EPOCH + timedelta(seconds=seconds) if when is None else datetime.fromtimestamp(when, timezone.utc)).strftime("%Y-%m-%dT%H:%M:%SZ")
                held.append(record(p, u, payload, n, digest, refers, stamp))
                size += len(held[-1])
                if size >= SEGMENT:
                    yield out()
                    segment, offset, held, size = segment + 1, offset + size, [], 0
                    if offset >= ARCHIVE:
                        number, segment, offset = number + 1, 0, 0
        if held:
            yield out()

    return stored(rows.mapInArrow(run, "archive string, segment int, offset bigint, data binary"), "warc", "none")


def archive_file(archives: DataFrame, name: str) -> bytes:
    """One archive as the bytes of a .warc.gz file."""
    return b"".join(bytes(r.data) for r in archives.where(F.col("archive") == name).orderBy("segment").collect())


_CAPTURE = "url_key string, captured string, page_id bigint, url string, record_type string, payload_digest string, payload_bytes bigint, refers_to bigint, archive string, offset bigint, length bigint, run string, place int"
_KINDS = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int32()]
_NAMES = [x.split()[0] for x in _CAPTURE.split(", ")]


def _id(urn: str | None):
    name = urn[len("<urn:page:") : -1] if urn else "none"
    return None if name == "none" else int(name)


def read(archives: DataFrame) -> DataFrame:
    """The captures that the archives hold, each record parsed and its payload's digest computed and compared. Those of a segment
    come out sorted, as a run with their places in it."""
    prepare(archives.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for archive, segment, base, data in zip(*[c.to_pylist() for c in b.columns]):
                found = []
                for at, size, f, block in records(data):
                    head, _, payload = block.partition(b"\r\n\r\n")
                    n = int(re.search(rb"\r\nContent-Length: (\d+)", head)[1])
                    digest, kind, url = f["WARC-Payload-Digest"].removeprefix("sha256:"), f["WARC-Type"], f.get("WARC-Target-URI")
                    if kind == "response" and (len(payload) != n or hashlib.sha256(payload).hexdigest() != digest):
                        raise ValueError(f"{archive}: the payload at {base + at} isn't what its header says")
                    found.append((url_key(url), f["WARC-Date"], _id(f["WARC-Record-ID"]), url, kind, digest, n, _id(f.get("WARC-Refers-To")), archive, base + at, size))
                found = [(*row, f"{archive}#{segment}", k) for k, row in enumerate(sorted(found, key=_order))]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*found), _KINDS)], names=_NAMES)

    return archives.select("archive", "segment", "offset", "data").mapInArrow(run, _CAPTURE)


def _order(row: tuple):
    return row[0], row[1], row[2] is not None, row[2] or 0, row[9]


def merged(captures: DataFrame) -> DataFrame:
    """All captures in global order of URL key, time and page: the sorted runs of segments, merged range by range."""
    prepare(captures.sparkSession)
    runs = cut(captures)  # finding the ranges' borders reads the captures once more
    ranges = runs.repartitionByRange(max(1, -(-runs.count() // RANGE_ROWS)), "url_key", "captured", "page_id", "offset")
    ranges = ranges.sortWithinPartitions("run", "place")  # a run's captures come together again, in the order they were written in

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, list[pa.RecordBatch]] = {}
        for b in batches:
            names = b.column(11).to_pylist()
            begin = 0
            for k in range(1, len(names) + 1):
                if k == len(names) or names[k] != names[begin]:
                    found.setdefault(names[begin], []).append(b.slice(begin, k - begin))
                    begin = k

        def rows(parts):
            for p in parts:
                yield from zip(*[c.to_pylist() for c in p.columns])

        out = []
        for row in LoserTree([rows(p) for p in found.values()], _order):
            out.append(row)
            if len(out) == 4096:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out), _KINDS)], names=_NAMES)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out), _KINDS)], names=_NAMES)

    return ranges.mapInArrow(run, _CAPTURE).drop("run", "place")
