"""Substring dedup: Rabin-Karp hashes of every window of `window` words, counted in shards.

Every window has a 64-bit hash, and an independent second one that picks its shard, so windows
meet only if all 64 bits and the shard agree. Shards grow with the text up to `MAX_SHARDS`, and a
partition of the shuffle, of which there are at most `MAX_PARTITIONS`, holds consecutive numbers of
them, dealt by number and not by its hash, so that no partition gets several where others get none.

1. Each task sorts the hashes of a few million windows and keeps, for each, the smallest doc_id of
   its own documents. Its other holders are known to be repeats at once. What is shuffled is
   therefore one entry per hash and task, however often a window occurs, and it goes as packed
   arrays: 8 bytes of hash and 1 to 8 of doc_id step, not as a row per window.
2. A partition reads its shards one after the other, as Spark's sort delivers them. A shard sorts
   its hashes, `PASS_WINDOWS` at a time, each pass those of one residue; entries of a document above
   the smallest one are repeats.
3. Repeats go, packed by ranges of documents, to where they are gathered per document, are written
   to the shared folder and joined to the texts, whose repeated windows merge into maximal removal
   intervals.

Null or empty text: no words. Null ids count as one document larger than all others; rows that
repeat an id are one document, and lose the same windows. Texts shorter than a window lose
nothing; texts of any length are taken whole. Only doc_id and text are read, so other columns may
have any name. Empty tables stay empty.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_first_column, keep, row_batch
from .text import PLAIN, RUN_BASES, U64, Words, raw, run_hashes, runs_within, slices

WINDOW = 13
#: Windows that a task sorts at a time, and text bytes for each shard.
TASK_WINDOWS = 1_000_000
SHARD_BYTES = 12 << 20
#: Bounds that hold at any size: shuffle blocks grow with the input, not with its square.
MAX_SHARDS = 1 << 18
MAX_PARTITIONS = 1 << 14
#: Windows of a shard that are sorted at a time.
PASS_WINDOWS = 4_000_000

_LAST = (1 << 63) - 1
_WIDTHS = (np.uint8, np.uint16, np.uint32, np.uint64)
_SCHEMA = pa.schema([("shard", pa.int32()), ("part", pa.int32()), ("payload", pa.binary())])


def document_id() -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("doc_id")


def pack(hashes: np.ndarray, ids: np.ndarray) -> bytes:
    """Entries, ids ascending: count, width, first id, id steps in as few bytes as the largest needs, hashes."""
    steps = np.diff(ids).astype(U64)
    width = next(k for k, t in enumerate(_WIDTHS) if not len(steps) or steps.max() <= np.iinfo(t).max)
    return np.array([len(ids), width, ids[0]], np.int64).tobytes() + hashes.tobytes() + steps.astype(_WIDTHS[width]).tobytes()


def unpack(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    n, width, first = np.frombuffer(data, np.int64, 3)
    hashes = np.frombuffer(data, U64, n, 24)
    steps = np.frombuffer(data, _WIDTHS[width], n - 1, 24 + 8 * n)
    return hashes, np.concatenate(([first], first + np.cumsum(steps.astype(np.int64))))


def _by_part(hashes: np.ndarray, ids: np.ndarray, parts: int) -> Iterator[tuple[int, bytes]]:
    """Distinct (document, hash) entries, packed by the part of their document."""
    part = ids % parts
    order = np.lexsort((hashes, ids, part))
    hashes, ids, part = hashes[order], ids[order], part[order]
    new = np.r_[True, (hashes[1:] != hashes[:-1]) | (ids[1:] != ids[:-1])]
    hashes, ids, part = hashes[new], ids[new], part[new]
    cuts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
    for a, b in zip(cuts, np.r_[cuts[1:], len(ids)], strict=True):
        yield int(part[a]), pack(hashes[a:b], ids[a:b])


def _local(hashes: np.ndarray, second: np.ndarray, ids: np.ndarray, shards: int) -> Iterator[pa.RecordBatch]:
    """One entry per distinct window for its shard, and the repeats among these documents."""
    order = np.argsort(hashes)
    h, g, d = hashes[order], second[order], ids[order]
    same = h[1:] == h[:-1]
    if (same & (g[1:] != g[:-1])).any():  # two windows of one first hash
        order = np.lexsort((second, hashes))
        h, g, d = hashes[order], second[order], ids[order]
        same = (h[1:] == h[:-1]) & (g[1:] == g[:-1])
    starts = np.flatnonzero(np.r_[True, ~same])
    first = np.minimum.reduceat(d, starts)
    later = d > np.repeat(first, np.diff(np.r_[starts, len(d)]))
    rows: list[tuple[int, int | None, bytes]] = []
    if later.any():  # these pass through the shards as they are
        rows += [(part, part, p) for part, p in _by_part(h[later], d[later], shards)]
    h, shard = h[starts], (g[starts] % U64(shards)).astype(np.int64)
    order = np.lexsort((first, shard))
    h, shard, first = h[order], shard[order], first[order]
    cuts = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]])
    rows += [(int(shard[a]), None, pack(h[a:b], first[a:b])) for a, b in zip(cuts, np.r_[cuts[1:], len(h)], strict=True)]
    for i in range(0, len(rows), 1000):
        s, part, payload = zip(*rows[i : i + 1000], strict=True)
        yield row_batch(_SCHEMA, shard=s, part=part, payload=payload)


def _windows(texts: list[bytes], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Both hashes of all windows, and how many each text has."""
    words = Words(texts, PLAIN)
    h = words.hashes()
    at, counts = runs_within(words.first, window)
    if not len(at):
        return np.zeros(0, U64), np.zeros(0, U64), counts
    return run_hashes(h, window, RUN_BASES[0])[at], run_hashes(h, window, RUN_BASES[1])[at], counts


def repeats(docs: DataFrame, window: int = WINDOW, shards: int | None = None) -> DataFrame:
    """doc_id (null ids as the largest long), keys: packed hashes of a document's windows that a smaller one has."""
    given = docs.select(document_id(), "text")
    if shards is None:
        shards = min(MAX_SHARDS, max(8, -(-(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // SHARD_BYTES)))
    partitions = min(shards, MAX_PARTITIONS)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        n = 0
        for batch in batches:
            texts, ids = raw(batch.column(1)), batch.column(0).to_numpy()
            for a, b in slices(texts):
                h, g, counts = _windows(texts[a:b], window)
                held.append((h, g, np.repeat(ids[a:b], counts)))
                n += len(h)
                if n >= TASK_WINDOWS:
                    yield from _local(*map(np.concatenate, zip(*held, strict=True)), shards)
                    held, n = [], 0
        if n:
            yield from _local(*map(np.concatenate, zip(*held, strict=True)), shards)

    def counted(batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        payloads: list[bytes] = []
        for batch in batches:
            known = pc.is_valid(batch.column(1))
            if pc.any(known).as_py():
                yield batch.filter(known).select(["part", "payload"])
            payloads += batch.column(2).filter(pc.invert(known)).to_pylist()
        passes = max(1, -(-sum(int(np.frombuffer(x, np.int64, 1)[0]) for x in payloads) // PASS_WINDOWS))
        for k in range(passes if payloads else 0):
            entries = [unpack(x) for x in payloads]
            if passes > 1:
                entries = [(h[own], d[own]) for h, d in entries for own in [h % U64(passes) == k]]
            h, d = np.concatenate([x[0] for x in entries]), np.concatenate([x[1] for x in entries])
            if not len(h):
                continue
            order = np.argsort(h)
            h, d = h[order], d[order]
            starts = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
            later = d > np.repeat(np.minimum.reduceat(d, starts), np.diff(np.r_[starts, len(d)]))
            if later.any():
                part, payload = zip(*_by_part(h[later], d[later], shards), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(payload, pa.binary())], names=["part", "payload"])

    def gathered(batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries = [unpack(x) for b in batches for x in b.column(1).to_pylist()]
        h, d = np.concatenate([x[0] for x in entries]), np.concatenate([x[1] for x in entries])
        order = np.argsort(d, kind="stable")
        h, d = h[order], d[order]
        cuts = np.flatnonzero(np.r_[True, d[1:] != d[:-1]])
        for i in range(0, len(cuts), 1000):
            at = np.r_[cuts[i : i + 1001], len(d)][: min(1000, len(cuts) - i) + 1]
            yield pa.RecordBatch.from_arrays([pa.array(d[at[:-1]]), pa.array([h[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary())], names=["doc_id", "keys"])

    entries = given.mapInArrow(hashed, "shard int, part int, payload binary").repartitionById(partitions, "shard").sortWithinPartitions("shard")
    later = entries.mapInArrow(by_first_column(counted), "part int, payload binary").repartitionById(partitions, "part").sortWithinPartitions("part")
    return keep(later.mapInArrow(by_first_column(gathered), "doc_id long, keys binary"), "repeats")


def intervals(text: bytes, keys: bytes | None, window: int = WINDOW) -> tuple[list[bytes], list[tuple[int, int]]]:
    """The text's words, and the maximal intervals of words to remove."""
    words = text.split()
    if not keys or len(words) < window:
        return words, []
    h = _windows([text], window)[0]
    at = np.flatnonzero(np.isin(h, np.frombuffer(keys, U64)))
    cuts = np.flatnonzero(np.r_[True, np.diff(at) > window])
    return words, [(int(at[a]), int(at[b - 1]) + window) for a, b in zip(cuts, np.r_[cuts[1:], len(at)], strict=True)] if len(at) else []


def _cut(words: list[bytes], spans: list[tuple[int, int]]) -> list[bytes]:
    out, at = [], 0
    for a, b in spans:
        out += words[at:a]
        at = b
    return out + words[at:] if spans else words


def dedup_substrings(docs: DataFrame, window: int = WINDOW, shards: int | None = None) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, spans (flat starts and ends); one row per document."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("spans", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {f.name: [] for f in schema if f.name != "doc_id"}
            for text, keys in zip(raw(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                words, spans = intervals(text, keys, window)
                out["n_words"].append(len(words))
                out["n_removed"].append(sum(b - a for a, b in spans))
                out["kept_sha256"].append(hashlib.sha256(b" ".join(_cut(words, spans))).hexdigest())
                out["spans"].append([x for s in spans for x in s])
            yield row_batch(schema, doc_id=batch.column(0), **out)

    found = repeats(docs, window, shards)
    left = docs.select(F.col("doc_id").cast("long").alias("given"), document_id(), "text")
    return left.join(found, "doc_id", "left").select("given", "text", "keys").mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string, spans array<long>")


def strip_substrings(docs: DataFrame, window: int = WINDOW, shards: int | None = None) -> DataFrame:
    """doc_id, text: what is left, words joined by one space where something went, else the text as it was."""

    @F.pandas_udf("string")
    def left(texts, keys):
        import pandas as pd

        out = []
        for t, k in zip(texts, keys, strict=True):
            words, spans = intervals((t or "").encode(), k, window)
            out.append(b" ".join(_cut(words, spans)).decode() if spans else t)
        return pd.Series(out, dtype=object)

    rows = docs.select(F.col("doc_id").cast("long").alias("given"), document_id(), "text")
    return rows.join(repeats(docs, window, shards), "doc_id", "left").select(F.col("given").alias("doc_id"), left("text", "keys").alias("text"))


ORACLE_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w)),
f AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY k) < doc_id AS gone FROM win),
g AS (SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(range(i, i + 13)) AS p FROM f WHERE gone)),
p AS (SELECT doc_id, generate_subscripts(ws, 1) AS p, unnest(ws) AS word FROM w),
k AS (SELECT p.doc_id, count(g.p) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY p.p) FILTER (WHERE g.p IS NULL), '') AS kept FROM p LEFT JOIN g ON g.doc_id = p.doc_id AND g.p = p.p GROUP BY p.doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN k USING (doc_id)
"""
