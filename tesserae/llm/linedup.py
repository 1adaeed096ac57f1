"""Reversible line dedup: sharded cuckoo filters backed by exact reference counts.

A `LineIndex` is a folder of tables:

* refs (h, g, doc_id): which document holds which line key, once each; (h, g) is the key's
  128-bit hash. Dealt by key and document, so a line that a third of all documents share spreads.
* counts (h, g, first_doc, last_doc, refs): the exact reference counts, summed before the shuffle.
* filters (shard, slots): a cuckoo filter of the shard's keys, one print per key.
* late (h, g, doc_id): references to a key that a smaller document holds, whose lines go.

`add` sends references to the filters first. A task keeps, of those to one key, the smallest
document's; the others are late for certain. What is kept goes to the key's shard, smallest document
first, so a hot line is one row per task. A reference whose key its filter does not hold is the
first of its key, is entered, and needs no look-up; only those that the filter may know are looked
up in the exact counts, which tell false alarms and a document added late that is smaller than the
holders before it. `remove` takes documents out again: counts fall, a key whose count falls to
zero leaves its filter, and the late references of what they shared are found anew, so `add` then
`remove` restores what was there before.

Every change writes tables of its own and then a small file `vN.json` that names the tables of
version N, so a change that fails leaves nothing that counts; `LineIndex(spark, path)` opens the last
version. An added version only appends to refs, counts and late.

Key of a line: stripped of `[\\x20\\x09-\\x0D]` and A-Z lower-cased; shorter than `min_chars` code
points: none. A key held by several documents keeps its lines in the smallest doc_id.

Null or empty text: one empty line, no key. Null ids count as one document larger than all
others; rows that repeat an id are one document, and lose the same keys. Lines and texts of any
length are taken whole. `dedup_lines` reads doc_id and text only; `strip_lines` carries all other
columns, whatever their names. Empty tables stay empty.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import forget, keep, list_files, new_path, put_text, remove, row_batch, write
from .cuckoo import CuckooFilter
from .text import _SPACES, U64, mix64, raw

MIN_CHARS = 10
#: References that a task looks through at a time, and the most partitions that shards are dealt to.
TASK_REFS = 500_000
MAX_PARTITIONS = 1 << 14
_LAST = (1 << 63) - 1
_KEYS = "h long, g long, doc_id long"


def document_id() -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("doc_id")


def line_key(line: bytes, min_chars: int = MIN_CHARS) -> tuple[int, int] | None:
    line = line.strip(_SPACES)
    if len(line) < min_chars or (len(line) < 4 * min_chars and len(line.decode()) < min_chars):
        return None
    h = xxhash.xxh3_128_intdigest(line.lower())
    return (h & _M64) - _HALF, (h >> 64) - _HALF


_M64, _HALF = (1 << 64) - 1, 1 << 63


def references(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """h, g, doc_id of every line key of every document, once each."""
    schema = pa.schema([("h", pa.int64()), ("g", pa.int64()), ("doc_id", pa.int64())])

    def run(batches):
        for batch in batches:
            hs, gs, ids = [], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), raw(batch.column(1)), strict=True):
                keys = {line_key(x, min_chars) for x in text.split(b"\n")} - {None}
                hs += [k[0] for k in keys]
                gs += [k[1] for k in keys]
                ids += [doc_id] * len(keys)
            yield row_batch(schema, h=hs, g=gs, doc_id=ids)

    return docs.select(document_id(), "text").mapInArrow(run, _KEYS).dropDuplicates()


def _print_key(h: np.ndarray, g: np.ndarray) -> np.ndarray:
    return mix64(h.view(U64)) ^ g.view(U64)


def _cuts(*columns: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin, of sorted columns."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


_PASSED = pa.schema([("part", pa.int32()), ("sure", pa.bool_()), ("shard", pa.int32()), ("kind", pa.int8()), ("h", pa.int64()), ("g", pa.int64()), ("doc_id", pa.int64()), ("slots", pa.binary())])
_PASSED_SQL = "part int, sure boolean, shard int, kind byte, h long, g long, doc_id long, slots binary"
_SLOTS, _ROOM, _REF = 0, 1, 2


def _nominate(refs: DataFrame, shards: int) -> DataFrame:
    """refs -> one row per key and task for its shard, and `sure` ones, later than that, dealt by document."""

    def run(batches):
        held: list[tuple[np.ndarray, ...]] = []

        def rows():
            h, g, d = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.lexsort((d, g, h))
            h, g, d = h[order], g[order], d[order]
            sure = np.ones(len(h), bool)
            sure[_cuts(h, g)] = False
            shard = (g.view(U64) % U64(shards)).astype(np.int32)
            part = np.where(sure, (mix64(d.view(U64)) >> U64(33)).astype(np.int32), shard)
            for i in range(0, len(h), 50_000):
                n = slice(i, i + 50_000)
                kind = np.full(len(h[n]), _REF, np.int8)
                yield row_batch(_PASSED, part=part[n], sure=sure[n], shard=shard[n], kind=kind, h=h[n], g=g[n], doc_id=d[n], slots=pa.nulls(len(kind), pa.binary()))

        n = 0
        for batch in batches:
            held.append(tuple(batch.column(k).to_numpy() for k in range(3)))
            n += batch.num_rows
            if n >= TASK_REFS:
                yield from rows()
                held, n = [], 0
        if n:
            yield from rows()

    return refs.select("h", "g", "doc_id").mapInArrow(run, _PASSED_SQL)


def _filtered(batches):
    """Rows sorted by shard, its filter first, then room to make, then references by document: those that the filter
    may know (`kind` _REF) and, after each shard, its filter with the others entered (_SLOTS). Sure ones pass."""
    at, held = None, CuckooFilter()

    def filter_row():
        return row_batch(_PASSED, part=[at], sure=[False], shard=[at], kind=[_SLOTS], h=[None], g=[None], doc_id=[None], slots=[held.to_bytes()])

    for batch in batches:
        sure = batch.column(1).to_numpy(zero_copy_only=False)
        if sure.any():
            yield batch.filter(batch.column(1))
            batch = batch.filter(pa.array(~sure))
        shard, kind = batch.column(2).to_numpy(), batch.column(3).to_numpy()
        ends = [*_cuts(shard, kind).tolist(), batch.num_rows] if batch.num_rows else []
        for a, b in zip(ends[:-1], ends[1:], strict=True):
            if shard[a] != at:
                if at is not None:
                    yield filter_row()
                at, held = int(shard[a]), None
            if kind[a] == _SLOTS:
                held = CuckooFilter.from_bytes(batch.column(7)[a].as_py())
            elif kind[a] == _ROOM:
                room = batch.column(4)[a].as_py()
                if held is None:
                    held = CuckooFilter(room)
                held.reserve(room)
            else:
                held = held or CuckooFilter(b - a)
                h, g = batch.column(4).slice(a, b - a).to_numpy(), batch.column(5).slice(a, b - a).to_numpy()
                keys = _print_key(h, g)
                order = np.lexsort((g, h))  # stable: of one key the smallest document comes first
                first = np.zeros(b - a, bool)
                first[order[_cuts(h[order], g[order])]] = True
                known = ~first | held.contains(keys)
                held.insert(keys[~known])
                if known.any():
                    yield batch.slice(a, b - a).filter(pa.array(known))
    if at is not None:
        yield filter_row()


_TABLES = ("refs", "counts", "filters", "late")


class LineIndex:
    def __init__(self, spark: SparkSession, path: str | None = None, shards: int = 64, min_chars: int = MIN_CHARS):
        """Opens the last version at `path`, if there is one, with its own settings, or starts an empty index.

        `shards`: filters; take so many that a shard's keys fit a task (about 10 million)."""
        self.spark, self.path = spark, (path or new_path(spark, "line-index")).rstrip("/")
        self.version, self.parts = 0, {name: [] for name in _TABLES}
        self.shards, self.min_chars = shards, min_chars
        found = [int(m[1]) for f in list_files(spark, self.path) if (m := re.fullmatch(r"v(\d+)\.json", f))]
        if found:
            self.version = max(found)
            told = json.loads("".join(r.value for r in spark.read.text(f"{self.path}/v{self.version}.json").collect()))
            self.shards, self.min_chars, self.parts = told["shards"], told["min_chars"], told["parts"]

    _SCHEMAS = {"refs": "h long, g long, doc_id long", "counts": "h long, g long, first_doc long, last_doc long, refs long", "filters": "shard int, slots binary", "late": "h long, g long, doc_id long"}

    def _read(self, name: str) -> DataFrame:
        paths = [f"{self.path}/{p}" for p in self.parts[name]]
        return self.spark.read.schema(self._SCHEMAS[name]).parquet(*paths) if paths else self.spark.createDataFrame([], self._SCHEMAS[name])

    def refs(self) -> DataFrame:
        return self._read("refs")

    def counts(self) -> DataFrame:
        """Exact counts: each version has those of its own references, which are summed here."""
        counts = self._read("counts")
        if len(self.parts["counts"]) < 2:
            return counts
        return counts.groupBy("h", "g").agg(F.min("first_doc").alias("first_doc"), F.max("last_doc").alias("last_doc"), F.sum("refs").alias("refs"))

    def filters(self) -> DataFrame:
        return self._read("filters")

    def _shard(self):
        return F.expr(f"cast(pmod(cast(g AS decimal(20, 0)) + CASE WHEN g < 0 THEN 18446744073709551616BD ELSE 0BD END, {self.shards}) AS int)").alias("shard")

    def _part(self, name: str, df: DataFrame) -> str:
        part = f"{name}-{uuid.uuid4().hex}"
        write(df, f"{self.path}/{part}")
        return part

    def _commit(self, parts: dict[str, list[str]]) -> None:
        before, self.parts = self.parts, parts
        told = {"shards": self.shards, "min_chars": self.min_chars, "parts": parts}
        put_text(self.spark, f"{self.path}/v{self.version + 1}.json", json.dumps(told))
        self.version += 1
        for name in _TABLES:
            for part in set(before[name]) - set(parts[name]):
                remove(self.spark, f"{self.path}/{part}")

    @staticmethod
    def _count(refs: DataFrame) -> DataFrame:
        return refs.groupBy("h", "g").agg(F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"), F.count("*").alias("refs"))

    def maybe_known(self, keys: DataFrame) -> DataFrame:
        """`keys` (h, g, ...) with `known`: false where the shard's filter rules the key out."""
        fields = [f"{n} {t}" for n, t in keys.dtypes]

        def probe(left, right):
            h, g = left["h"].to_numpy(), left["g"].to_numpy()
            known = CuckooFilter.from_bytes(right["slots"][0].as_py()).contains(_print_key(h, g)) if right.num_rows else np.zeros(len(h), bool)
            return left.drop_columns(["shard"]).append_column("known", pa.array(known))

        cogroup = keys.withColumn("shard", self._shard()).groupBy("shard").cogroup(self.filters().groupBy("shard"))
        return cogroup.applyInArrow(probe, ", ".join([*fields, "known boolean"]))

    def add(self, docs: DataFrame) -> LineIndex:
        """Takes in documents that are not in the index yet (those that are change nothing)."""
        new = references(docs, self.min_chars)
        if self.version:
            new = new.join(self.refs(), ["h", "g", "doc_id"], "left_anti")
        refs = self._part("refs", new)
        new = self.spark.read.schema(self._SCHEMAS["refs"]).parquet(f"{self.path}/{refs}")
        counts = self._part("counts", self._count(new))
        gained = self.spark.read.schema(self._SCHEMAS["counts"]).parquet(f"{self.path}/{counts}")

        # Through the filters: what they may know, and the filters as they are afterwards.
        other = lambda df, kind, h, slots: df.select(F.col("shard").alias("part"), F.lit(False).alias("sure"), "shard", F.lit(kind).cast("byte").alias("kind"), h.alias("h"), F.lit(None).cast("long").alias("g"), F.lit(None).cast("long").alias("doc_id"), slots.alias("slots"))
        room = gained.groupBy(self._shard()).count()
        passing = _nominate(new, self.shards).unionByName(other(room, _ROOM, F.col("count"), F.lit(None).cast("binary")))
        passing = passing.unionByName(other(self.filters(), _SLOTS, F.lit(None).cast("long"), F.col("slots")))
        passing = passing.repartitionById(min(self.shards, MAX_PARTITIONS), "part").sortWithinPartitions("sure", "shard", "kind", "doc_id")
        passed = keep(passing.mapInArrow(_filtered, _PASSED_SQL), "probed")
        filters = self._part("filters", passed.where(F.col("kind") == _SLOTS).select("shard", "slots"))

        # The exact counts judge only what the filters may know.
        asked = passed.where((F.col("kind") == _REF) & ~F.col("sure")).select("h", "g", "doc_id")
        merged = self._merged(counts)
        late = passed.where("sure").select("h", "g", "doc_id")
        late = late.unionByName(asked.join(merged.where("first_doc < last_doc"), ["h", "g"]).where("doc_id > first_doc").select("h", "g", "doc_id"))
        if self.version:  # holders that a smaller new document takes the place of
            moved = self.counts().join(gained.select("h", "g", F.col("first_doc").alias("new_first")), ["h", "g"]).where("first_doc > new_first")
            late = late.unionByName(moved.select("h", "g", F.col("first_doc").alias("doc_id")))
        late = self._part("late", late)
        self._commit({"refs": [*self.parts["refs"], refs], "counts": [*self.parts["counts"], counts], "filters": [filters], "late": [*self.parts["late"], late]})
        forget(passed)
        return self

    def _merged(self, part: str) -> DataFrame:
        """The counts with a part that is written but not committed yet."""
        with_part = LineIndex.__new__(LineIndex)
        with_part.spark, with_part.path, with_part.parts = self.spark, self.path, {**self.parts, "counts": [*self.parts["counts"], part]}
        return with_part.counts()

    def remove(self, ids: DataFrame) -> LineIndex:
        """Takes documents (doc_id) out again; what they alone held leaves the counts and the filters."""
        ids = ids.select(document_id()).distinct()
        gone = self.refs().join(ids, "doc_id", "left_semi")
        touched = keep(gone.select("h", "g").distinct(), "touched")
        refs = self._part("refs", self.refs().join(ids, "doc_id", "left_anti").select("h", "g", "doc_id"))
        left = self.spark.read.schema(self._SCHEMAS["refs"]).parquet(f"{self.path}/{refs}")
        still = left.join(touched, ["h", "g"], "left_semi")
        recounted = keep(self._count(still), "recounted")
        counts = self._part("counts", self.counts().join(touched, ["h", "g"], "left_anti").unionByName(recounted))
        dead = touched.join(recounted, ["h", "g"], "left_anti").select(self._shard(), "h", "g")

        def shrink(left, right):
            if not left.num_rows:
                return left
            held = CuckooFilter.from_bytes(left["slots"][0].as_py())
            held.delete(_print_key(right["h"].to_numpy(), right["g"].to_numpy()))
            return pa.table({"shard": left["shard"], "slots": pa.array([held.to_bytes()], pa.binary())})

        filters = self._part("filters", self.filters().groupBy("shard").cogroup(dead.groupBy("shard")).applyInArrow(shrink, "shard int, slots binary"))
        again = still.join(recounted.where("first_doc < last_doc"), ["h", "g"]).where("doc_id > first_doc").select("h", "g", "doc_id")
        late = self._part("late", self._read("late").join(touched, ["h", "g"], "left_anti").unionByName(again))
        self._commit({"refs": [refs], "counts": [counts], "filters": [filters], "late": [late]})
        forget(touched)
        forget(recounted)
        return self

    def drops(self) -> DataFrame:
        """doc_id, keys: the h of the keys whose lines each document loses; documents that lose none have no row."""
        return self._read("late").groupBy("doc_id").agg(F.collect_list("h").alias("keys"))


def keep_lines(text: bytes, keys: list[int] | None, min_chars: int = MIN_CHARS) -> tuple[bytes, int, int]:
    """The text without lines of these keys, its number of lines, and how many went."""
    if not keys:
        return text, text.count(b"\n") + 1, 0
    lines, gone = text.split(b"\n"), set(keys)
    kept = [x for x in lines if (k := line_key(x, min_chars)) is None or k[0] not in gone]
    return b"\n".join(kept), len(lines), len(lines) - len(kept)


def dedup_lines(docs: DataFrame, index: LineIndex | None = None) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256; one row per document. `index`: one that holds these documents."""
    index = index or LineIndex(docs.sparkSession, shards=_shards(docs)).add(docs)
    schema = pa.schema([("doc_id", pa.int64()), ("n_lines", pa.int64()), ("n_dropped", pa.int64()), ("kept_sha256", pa.string())])

    def run(batches):
        for batch in batches:
            n, dropped, sha = [], [], []
            for text, keys in zip(raw(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                kept, lines, gone = keep_lines(text, keys, index_min)
                n.append(lines)
                dropped.append(gone)
                sha.append(hashlib.sha256(kept).hexdigest())
            yield row_batch(schema, doc_id=batch.column(0), n_lines=n, n_dropped=dropped, kept_sha256=sha)

    index_min = index.min_chars
    left = docs.select(F.col("doc_id").cast("long").alias("given"), document_id(), "text")
    return left.join(index.drops(), "doc_id", "left").select("given", "text", "keys").mapInArrow(run, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")


def strip_lines(docs: DataFrame, index: LineIndex | None = None, drop_emptied: bool = False) -> DataFrame:
    """`docs`, all columns, with the kept lines as text (null stays null) and n_chars, if there, as its length.

    `drop_emptied`: documents that lose lines and have no word left go."""
    index = index or LineIndex(docs.sparkSession, shards=_shards(docs)).add(docs)
    index_min = index.min_chars

    @F.pandas_udf("string")
    def kept(texts, keys):
        import pandas as pd

        return pd.Series([t if t is None or k is None else keep_lines(t.encode(), list(k), index_min)[0].decode() for t, k in zip(texts, keys, strict=True)], dtype=object)

    kept = kept.asNondeterministic()  # worked out once, though a filter and the result both read it
    row = docs.select(F.struct(*docs.columns).alias("row"), document_id())
    text = row.join(index.drops(), "doc_id", "left").select("row", kept("row.text", "keys").alias("new"), F.col("keys").isNotNull().alias("cut"))
    if drop_emptied:
        text = text.where(~F.col("cut") | F.col("new").rlike(r"[^\x20\x09-\x0D]"))
    size = lambda c: F.char_length("new").cast(docs.schema[c].dataType).alias(c)
    return text.select(*[F.col("new").alias(c) if c == "text" else size(c) if c == "n_chars" else F.col(f"row.{c}").alias(c) for c in docs.columns])


def _shards(docs: DataFrame) -> int:
    """One filter for each 256 MB of text."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(8, -(-size // (256 << 20)))


ORACLE_SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
k AS (
  SELECT doc_id, line, pos, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key, min(doc_id) AS first_doc FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1),
d AS (SELECT k.*, f.first_doc IS NOT NULL AND k.doc_id > f.first_doc AS gone FROM k LEFT JOIN f ON k.key = f.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM d GROUP BY doc_id
"""
