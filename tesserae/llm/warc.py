"""WARC archives: writing, reading back, and an index merged from sorted runs.

Write: equal payloads of at least `min_revisit` bytes are stored once, by the page with the
smallest id; the others become revisit records that refer to it. Which those are is settled from
ids and digests alone; payloads move once, by page id, so a payload that a third of all pages share
makes no task larger. Each task writes gzip members to files of its own in the archive folder; the
manifest has the files of the attempts that succeeded, so a lost executor leaves no double records.

Read: tasks stream the files of the manifest member by member, check every stored payload against
its digest, and give each file's captures as a run sorted by URL key, time and id.

Merge: runs are cut into ranges of (URL key, time, id) of about `ROWS_A_RANGE` rows; in each range a
loser tree merges what the runs have there, which is held packed and read through one cursor a run,
so the table is one globally ordered capture history. A URL with very many captures spans several
ranges.

Null html: an empty payload. Null url: no target header and an empty key. Null ids are larger than
all others, and rows that repeat an id keep its fate: all rows of the smallest id are responses.
Control characters of a URL are percent-encoded in the archive. Payloads of any length are stored
whole. Only page_id, url and html are read, so other columns may have any name. An empty table
makes no archive.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator
from datetime import UTC, datetime, timedelta

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import forget, keep, long_id, new_path, row_batch
from .text import raw

MIN_REVISIT = 100
FILE_BYTES = 32 << 20
ROWS_A_RANGE = 200_000
_LAST = (1 << 63) - 1
_EPOCH = datetime(2020, 1, 1, tzinfo=UTC)
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def capture_time(page_id: int | None) -> str:
    """Pages have no time of their own: a second per id from a fixed day on (a day of seconds a year at most)."""
    return (_EPOCH + timedelta(seconds=(page_id or 0) % 86_400_000)).strftime("%Y-%m-%dT%H:%M:%SZ")


def url_key(url: str | None) -> str:
    """The URL with its host reversed and in front, lower-cased, as capture indexes sort it."""
    if not url:
        return ""
    rest = url.split("://", 1)[-1]
    cut = min((i for i in (rest.find(c) for c in "/?#") if i >= 0), default=len(rest))
    host, path = rest[:cut].lower(), rest[cut:].split("#", 1)[0].lower()
    return ",".join(reversed(host.removeprefix("www.").split("."))) + ")" + (path or "/")


def _header_value(text: str) -> bytes:
    return "".join(f"%{ord(c):02X}" if ord(c) < 32 or ord(c) == 127 else c for c in text).encode()


def _urn(page_id: int | None) -> bytes:
    return f"<urn:page:{'' if page_id is None else page_id}>".encode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, digest: str) -> bytes:
    """One WARC record, uncompressed."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + payload if refers_to is None else http
    head = [b"WARC/1.1", b"WARC-Type: " + (b"response" if refers_to is None else b"revisit"), b"WARC-Record-ID: " + _urn(page_id), b"WARC-Date: " + capture_time(page_id).encode()]
    if url is not None:
        head.append(b"WARC-Target-URI: " + _header_value(url))
    head.append(b"WARC-Payload-Digest: sha256:" + digest.encode())
    if refers_to is not None:
        head += [b"WARC-Profile: " + _PROFILE.encode(), b"WARC-Refers-To: " + _urn(refers_to)]
    head += [b"Content-Type: application/http; msgtype=response", b"Content-Length: %d" % len(block)]
    return b"\r\n".join(head) + b"\r\n\r\n" + block + b"\r\n\r\n"


def members(read: Callable[[int], bytes], size: int = 1 << 20) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, content) of the gzip members of a file, streamed."""
    at, data, offset = 0, read(size), 0
    while data:
        unzip, out, used = zlib.decompressobj(31), [], 0
        while True:
            out.append(unzip.decompress(data))
            used += len(data) - len(unzip.unused_data)
            if unzip.eof:
                data = unzip.unused_data or read(size)
                break
            data = read(size)
            if not data:
                raise ValueError(f"the member at {offset} is cut short")
        at = offset + used
        yield offset, used, b"".join(out)
        offset = at


def parse(content: bytes) -> dict:
    """The fields of one record; a stored payload that does not match its digest is an error."""
    head, _, rest = content.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError(f"not a WARC record: {lines[0]!r}")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    if len(block) != int(fields["Content-Length"]) or rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("the record's length is wrong")
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(next(x.split(b": ")[1] for x in http.split(b"\r\n") if x.startswith(b"Content-Length")))
    digest, kind = fields["WARC-Payload-Digest"].removeprefix("sha256:"), fields["WARC-Type"]
    if kind == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"the payload of {fields['WARC-Record-ID']} does not match its digest")
    number = lambda urn: int(x) if (x := urn[len("<urn:page:") : -1]) else None
    return {
        "page_id": number(fields["WARC-Record-ID"]), "url": fields.get("WARC-Target-URI"), "captured": fields["WARC-Date"], "payload_bytes": size, "payload_digest": digest,
        "record_type": kind, "refers_to": number(fields["WARC-Refers-To"]) if kind == "revisit" else None, "payload": payload if kind == "response" else None,
    }


class LoserTree:
    """Merges sorted iterators: each pop replays one path of the tournament, log2 k comparisons."""

    def __init__(self, runs: list[Iterator]):
        self.runs = [iter(r) for r in runs]
        k = len(self.runs)
        self.heads = [next(r, None) for r in self.runs]
        self.losers = [-1] * max(1, k)
        for leaf in range(k):
            self._replay(leaf)

    def _before(self, a: int, b: int) -> bool:
        """Whether run a's head comes before run b's; an ended run comes last, equal heads go by run."""
        x, y = self.heads[a], self.heads[b]
        if x is None or y is None:
            return y is None and (x is not None or a < b)
        return (x, a) < (y, b)

    def _replay(self, leaf: int) -> None:
        winner, node = leaf, (leaf + len(self.runs)) // 2
        while node > 0:
            held = self.losers[node]
            if held < 0:  # the first to come waits for its opponent
                self.losers[node] = winner
                return
            if self._before(held, winner):
                self.losers[node], winner = winner, held
            node //= 2
        self.losers[0] = winner

    def __iter__(self) -> Iterator:
        if not self.runs:
            return
        while (out := self.heads[self.losers[0]]) is not None:
            yield out
            winner = self.losers[0]
            self.heads[winner] = next(self.runs[winner], None)
            self._replay(winner)


def _id(column: str = "page_id") -> Column:
    return F.coalesce(F.col(column).cast("long"), F.lit(_LAST))


def write_archives(pages: DataFrame, path: str | None = None, min_revisit: int = MIN_REVISIT, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes one record per row of pages (page_id, url, html) into gzip WARC files below `path`.

    Returns the manifest: file, records."""
    path = path or new_path(pages.sparkSession, "warc")
    html = F.coalesce(F.col("html"), F.lit(""))
    ids = pages.select(_id().alias("page_id"), F.sha2(html.cast("binary"), 256).alias("digest"), F.octet_length(html).alias("size"))
    ids = keep(ids.where(F.col("size") >= min_revisit).select("page_id", "digest"), "digests")
    shared = ids.groupBy("digest").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last")).where("first < last").select("digest", "first")
    again = ids.join(shared, "digest").where("page_id > first").select("page_id", "digest", "first").distinct()
    rows = pages.select(_id().alias("page_id"), "url", html.alias("html"), F.sha2(html.cast("binary"), 256).alias("digest"))
    rows = rows.join(again, ["page_id", "digest"], "left").select("page_id", "url", "html", "digest", "first")
    schema = pa.schema([("file", pa.string()), ("records", pa.int64())])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = fs.FileSystem.from_uri(path)
        task = TaskContext.get()
        files, out, size, n = [], None, 0, 0
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                for page_id, url, payload, digest, first in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), raw(part.column(2)), part.column(3).to_pylist(), part.column(4).to_pylist(), strict=True):
                    if out is None:
                        store.create_dir(folder, recursive=True)
                        name = f"{folder}/{task.partitionId():07d}-{task.taskAttemptId()}-{len(files)}.warc.gz"
                        out, size, n = store.open_output_stream(name, compression=None), 0, 0
                    zipper = zlib.compressobj(5, zlib.DEFLATED, 31)
                    data = zipper.compress(record(None if page_id == _LAST else page_id, url, payload, first, digest)) + zipper.flush()
                    out.write(data)
                    size, n = size + len(data), n + 1
                    if size >= file_bytes:
                        out.close()
                        files.append((name, n))
                        out = None
        if out is not None:
            out.close()
            files.append((name, n))
        if files:
            yield row_batch(schema, file=[f for f, _ in files], records=[k for _, k in files])

    manifest = keep(rows.mapInArrow(write, "file string, records long"), "manifest")
    forget(ids)
    return manifest.withColumn("store", F.lit(path))


_CAPTURE = "page_id long, url string, captured string, payload_bytes long, payload_digest string, record_type string, refers_to long"
_RUN = f"run string, seq long, url_key string, {_CAPTURE}, offset long, length long"
_FIELDS = ["page_id", "url", "captured", "payload_bytes", "payload_digest", "record_type", "refers_to"]
_TYPES = {"page_id": pa.int64(), "url": pa.string(), "captured": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64()}


def _order(x: dict) -> tuple:
    return x["url_key"], x["captured"], _LAST if x["page_id"] is None else x["page_id"], x["offset"]


def read_archives(manifest: DataFrame, payloads: bool = False) -> DataFrame:
    """All captures of the files, each file's as a sorted run (run, seq); `payloads` adds the stored bytes as html."""
    kinds = [("run", pa.string()), ("seq", pa.int64()), ("url_key", pa.string()), *_TYPES.items(), ("offset", pa.int64()), ("length", pa.int64())] + [("html", pa.binary())] * payloads
    schema = pa.schema(kinds)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, path in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                store, _ = fs.FileSystem.from_uri(path)
                rows = []
                with store.open_input_stream(file, compression=None) as f:
                    for offset, length, content in members(f.read):
                        x = parse(content)
                        x |= {"url_key": url_key(x["url"]), "offset": offset, "length": length, "run": file, "html": x.pop("payload") if payloads else x.pop("payload") and None}
                        rows.append(x)
                rows.sort(key=_order)
                for i in range(0, len(rows), 2000):
                    part = rows[i : i + 2000]
                    yield row_batch(schema, seq=np.arange(i, i + len(part)), **{k: [x[k] for x in part] for k, _ in kinds if k != "seq"})

    return manifest.select("file", "store").repartition(max(1, manifest.count()), "file").mapInArrow(read, _RUN + ", html binary" * payloads)


def merge_index(runs: DataFrame) -> DataFrame:
    """The runs as one table, globally ordered by URL key, time and id: partitions are consecutive ranges, each in order."""
    runs = keep(runs, "runs")
    ranges = max(1, -(-runs.count() // ROWS_A_RANGE))
    by_range = runs.repartitionByRange(ranges, "url_key", "captured", _id()).sortWithinPartitions("run", "seq")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        rows = pa.Table.from_batches(held)
        names = rows["run"].combine_chunks().dictionary_encode()
        names = (names.combine_chunks() if isinstance(names, pa.ChunkedArray) else names).indices.to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(names[1:] != names[:-1]) + 1).tolist(), len(rows)]
        out: list[int] = []
        for x in LoserTree([_cursor(rows, a, b) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]):
            out.append(x[1])
            if len(out) == 2000:
                yield from rows.take(pa.array(out)).combine_chunks().to_batches()
                out = []
        if out:
            yield from rows.take(pa.array(out)).combine_chunks().to_batches()

    return by_range.mapInArrow(merge, _RUN)


def _cursor(rows: pa.Table, a: int, b: int) -> Iterator[_Keyed]:
    """A run's rows as (order, place), a thousand keys at a time; the rows themselves stay packed."""
    for i in range(a, b, 1000):
        part = rows.slice(i, min(1000, b - i))
        keys = zip(*(part[c].to_pylist() for c in ("url_key", "captured", "page_id", "offset")), strict=True)
        for j, (key, captured, page, offset) in enumerate(keys, i):
            yield _Keyed(((key, captured, _LAST if page is None else page, offset), j))


class _Keyed(tuple):
    """A row that compares by its order alone."""

    def __lt__(self, other) -> bool:
        return self[0] < other[0]

    def __eq__(self, other) -> bool:
        return self[0] == other[0]

    __hash__ = None


def archive(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Writes `pages`, reads the archives back and merges their index: page_id, payload_bytes, payload_digest,
    record_type, refers_to and where each capture is, one row per page, in capture order."""
    return merge_index(read_archives(write_archives(pages, path)))


ORACLE_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY digest) AS first FROM p)
SELECT page_id, n AS payload_bytes, digest AS payload_digest, CASE WHEN n >= 100 AND page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND page_id > first THEN first END AS refers_to
FROM f
"""
