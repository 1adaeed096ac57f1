"""Near-duplicate documents by circulant MinHash, banding and exact Jaccard verification.

Shingles are hashed to 64 bits; one permutation of a 32-bit universe spreads them, and a second
one, circularly shifted by k, gives the k-th coordinate. `bands` of `rows` coordinates are the
bucket keys: with 24 of 3, two documents of similarity 0.8 share a bucket but for a chance of
(1 - 0.8**3)**24 = 3e-8.

1. Exact copies (equal shingle sets) fold into one set before any bucket is formed.
2. In each bucket every set is compared with the bucket's centre, the set that meets most others;
   what that links is joined into components.
3. In rounds, each bucket that still holds several components compares one member of each, drawn
   anew, with one of the bucket's largest component, and what that links joins components. A set
   is compared at most once a bucket and round, so a family costs so much per member however many
   members it has, and after a few rounds it meets as one component. Rounds end when few comparisons
   link, or after `ROUNDS`.
4. What is left apart is settled by prefix filtering, which loses nothing: in one global order of
   shingles by frequency, rarest first, the first shingle that two similar sets share must leave
   enough of both behind it. So a set is met only through its rarest shingles, only by sets of a size
   that its place there allows, and only by sets of another component. Of those that meet, the ones
   whose parity sketches differ in more bits than similar sets differ in shingles go at once. Nothing
   is capped: members of a family that are a little too different to link meet as pairs here, as
   rows of a few numbers, and are seldom compared in full.
5. Every candidate is verified on the full sets, and components are joined again.

Null, empty and wordless texts have an empty set and no links; texts shorter than a shingle have
their whole sequence as one. Null ids are larger than all others, and a component of null ids only
has a null id. Rows that repeat an id are documents of their own. Texts of any length are taken
whole. `near_duplicates` reads doc_id and text only; `keep_first` carries all other columns, whatever
their names. Empty tables stay empty.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, keep, long_id, row_batch
from .graph import components
from .text import LOWER, U64, Words, mix64, raw, run_hashes, slices

SHINGLE = 5
THRESHOLD = 80
BANDS, ROWS = 24, 3
#: Sizes of sets are told apart in steps of this ratio where they are joined on them.
SIZE_STEP = 1.02
#: Most rounds inside buckets; one that links fewer than one in so many pairs is the last.
ROUNDS, WORTHWHILE = 6, 50
#: Words of 64 bits in a set's parity sketch.
SKETCH = 4
_LAST = (1 << 63) - 1
_U32 = np.uint32


def _permute(x: np.ndarray) -> np.ndarray:
    """A permutation of 32-bit values (the finaliser of MurmurHash3)."""
    x = x ^ (x >> _U32(16))
    x *= _U32(0x85EBCA6B)
    x ^= x >> _U32(13)
    x *= _U32(0xC2B2AE35)
    x ^= x >> _U32(16)
    return x


def shingle_sets(texts: list[bytes], n: int) -> list[np.ndarray]:
    """Each text's distinct shingles of `n` words, as sorted hashes."""
    words = Words(texts, LOWER)
    h = words.hashes()
    g = run_hashes(h, n)
    out = []
    for a, b in zip(words.first[:-1], words.first[1:], strict=True):
        if b - a >= n:
            out.append(np.unique(g[a : b - n + 1]))
        else:  # the whole sequence, told from a shingle by its length
            out.append(mix64(run_hashes(h[a:b], int(b - a)) + U64(b - a)) if b > a else h[:0])
    return out


def signatures(sets: list[np.ndarray], k: int) -> np.ndarray:
    """`k` circulant MinHash coordinates of each set; no set may be empty."""
    flat = np.concatenate(sets)
    starts = np.cumsum([0] + [len(s) for s in sets[:-1]])
    spread = _permute((flat & U64(0xFFFFFFFF)).astype(_U32) ^ _U32(0x2545F491))
    out = np.empty((len(sets), k), _U32)
    for j in range(k):
        out[:, j] = np.minimum.reduceat(_permute(spread - _U32(j)), starts)
    return out


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key per band; the band's number is part of it."""
    out = np.empty((len(sig), bands), U64)
    for b in range(bands):
        key = np.full(len(sig), b + 1, U64)
        for c in range(b * rows, (b + 1) * rows):
            key = mix64(key * U64(0x9E3779B97F4A7C15) + sig[:, c])
        out[:, b] = key
    return out


def _signed(df: DataFrame, shingle: int, bands: int, rows: int) -> DataFrame:
    """doc_id, text_key -> doc_id, text_key, n, sid (digest of the set), keys."""
    schema = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("n", pa.int64()), ("sid", pa.binary()), ("keys", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = raw(batch.column(1))
            n, sid, keys = [], [], []
            for a, b in slices(texts):
                sets = shingle_sets(texts[a:b], shingle)
                full = [s for s in sets if len(s)]
                held = iter(band_keys(signatures(full, bands * rows), bands, rows).view(np.int64).tolist()) if full else iter(())
                for s in sets:
                    n.append(len(s))
                    sid.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                    keys.append(next(held) if len(s) else [])
            yield row_batch(schema, doc_id=batch.column(0), text_key=batch.column(2), n=n, sid=sid, keys=keys)

    return df.mapInArrow(run, "doc_id long, text_key long, n long, sid binary, keys array<long>")


def _sketch(hashes: np.ndarray) -> np.ndarray:
    """Parity of the set's hashes in each of 64 * SKETCH places: two sets differ in at least as many elements as bits."""
    place = (hashes >> U64(40)) % U64(64 * SKETCH)
    return np.packbits(np.bincount(place.astype(np.int64), minlength=64 * SKETCH).astype(np.uint8) & 1).view(np.int64)


_SKETCH = [f"k{i}" for i in range(SKETCH)]


def _shingles_of(docs: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """wanted (s, doc_id, text_key) -> (s, shingles, k0..): sorted hashes, packed, and the sketch."""
    schema = pa.schema([("s", pa.int64()), ("shingles", pa.binary()), *((k, pa.int64()) for k in _SKETCH)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, out, sketches = raw(batch.column(1)), [], [np.zeros((0, SKETCH), np.int64)]
            for a, b in slices(texts):
                sets = shingle_sets(texts[a:b], shingle)
                out += [x.tobytes() for x in sets]
                sketches.append(np.stack([_sketch(x) for x in sets]))
            bits = np.concatenate(sketches)
            yield row_batch(schema, s=batch.column(0), shingles=out, **{k: bits[:, i] for i, k in enumerate(_SKETCH)})

    # One document stands for each set; id and text key find its row, or equal ones.
    d = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("doc_id"), F.xxhash64("text").alias("text_key"), "text")
    rows = d.join(wanted.withColumn("doc_id", F.coalesce("doc_id", F.lit(_LAST))), ["doc_id", "text_key"]).select("s", "text")
    return rows.mapInArrow(run, "s long, shingles binary, " + ", ".join(f"{k} long" for k in _SKETCH)).dropDuplicates(["s"])


def _linked(pairs: DataFrame, shingles: DataFrame, threshold: int) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= threshold * union, on the full sets."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, U64), np.frombuffer(y, U64)
                if len(x) > len(y):
                    x, y = y, x
                at = np.searchsorted(y, x)
                at[at == len(y)] = 0
                both = int((y[at] == x).sum())
                ok.append(100 * both >= threshold * (len(x) + len(y) - both))
            yield row_batch(schema, a=batch.column(0).filter(pa.array(ok)), b=batch.column(1).filter(pa.array(ok)))

    one = shingles.select(F.col("s").alias("a"), F.col("shingles").alias("x"))
    two = shingles.select(F.col("s").alias("b"), F.col("shingles").alias("y"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _fits(n: str, m: str, threshold: int):
    """Whether sets of these sizes can be that similar."""
    return 100 * F.least(n, m) >= threshold * F.greatest(n, m)


def _prefixes(members: DataFrame, shingles: DataFrame, threshold: int) -> DataFrame:
    """(key, s, n, c, at) by shingle: each set's rarest ones, so many that similar sets share one, and its place."""
    schema = pa.schema([("s", pa.int64()), ("n", pa.int64()), ("c", pa.int64()), ("key", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.frombuffer(x, np.int64) for x in batch.column(3).to_pylist()]
            times = [len(x) for x in sets]
            cols = [np.repeat(batch.column(k).to_numpy(), times) for k in range(3)]
            for i in range(0, sum(times), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(c[i : i + 50_000]) for c in (*cols, np.concatenate(sets))], schema=schema)

    every = keep(members.join(shingles.select("s", "shingles"), "s").select("s", "n", "c", "shingles").mapInArrow(run, "s long, n long, c long, key long"), "shingles")
    df = every.groupBy("key").agg(F.count("*").alias("df")).where("df > 1")
    # A shingle of one set only meets nothing, but takes its place in the order.
    rank = F.row_number().over(Window.partitionBy("s").orderBy("df", "key"))
    placed = every.join(df, "key", "left").withColumn("df", F.coalesce("df", F.lit(1))).withColumn("at", rank - 1)
    return placed.where((F.col("at") <= F.expr(f"n - ({threshold} * n + 99) div 100")) & (F.col("df") > 1)).select("key", "s", "n", "c", "at")


def _size_class(n: Column) -> Column:
    return F.floor(F.log(n) / F.lit(math.log(SIZE_STEP))).cast("int")


def _meetings(prefixes: DataFrame, sketches: DataFrame, threshold: int) -> DataFrame:
    """Pairs (a, b) of different components that may be that similar, found at the shingles they share. `sketches`: s, k0...

    Of a pair x is the smaller set, of size m, and y the larger, of size n. With t the threshold their
    overlap is at least t / (1 + t) * (m + n), and at most what is left of either from that shingle on.
    So x has it among its first m - 2t / (1 + t) * m places, and from y's place a bound on m follows.
    They differ in at most (1 - t) / (1 + t) * (m + n) shingles, so in no more bits of their sketches."""
    t, u = threshold, 100 + threshold
    by_key = prefixes.groupBy("key").agg(F.min("c").alias("low"), F.max("c").alias("high"))
    several = by_key.where("low < high").select("key")
    entries = prefixes.join(several, "key")
    main = entries.groupBy("key").agg(F.mode("c").alias("main"))  # pairs inside the largest component are never formed
    entries = keep(entries.join(main, "key").join(sketches, "s"), "entries")
    x = entries.where(F.expr(f"at <= n - ({2 * t} * n + {u - 1}) div {u}"))
    x = x.select("key", _size_class(F.col("n")).alias("size"), F.col("s").alias("xs"), F.col("n").alias("m"), F.col("c").alias("xc"), F.col("at").alias("i"), "main", *[F.col(k).alias(f"x{k}") for k in _SKETCH])
    most = F.least(F.col("n"), F.expr(f"((n - at) * {u}) div {t} - n"))
    y = entries.withColumn("least", F.expr(f"({t} * n + 99) div 100")).withColumn("most", most).where("most >= least")
    y = y.select("key", F.explode(F.sequence(_size_class(F.col("least")), _size_class(F.col("most")))).alias("size"), F.col("s").alias("ys"), "n", F.col("c").alias("yc"), F.col("at").alias("j"), F.col("main").alias("ymain"), *[F.col(k).alias(f"y{k}") for k in _SKETCH])
    bits = F.expr(" + ".join(f"bit_count(x{k} ^ y{k})" for k in _SKETCH))
    fits = (F.col("xc") != F.col("yc")) & (F.col("m") <= F.col("n")) & F.expr(f"100 * m >= {t} * n AND {u} * least(m - i, n - j) >= {t} * (m + n)")
    fits &= bits * u <= (100 - t) * (F.col("m") + F.col("n"))
    met = x.join(y.where("yc != ymain"), ["key", "size"]).where(fits).select("xs", "ys")
    met = met.unionByName(x.where("xc != main").join(y.where("yc = ymain"), ["key", "size"]).where(fits).select("xs", "ys"))
    return met.select(F.least("xs", "ys").alias("a"), F.greatest("xs", "ys").alias("b")).distinct()


def _inside(members: DataFrame, part: DataFrame) -> DataFrame:
    """Buckets' sets with their components: key, s, n, c."""
    labels = part.select(F.col("node").alias("s"), "component")
    return members.join(labels, "s", "left").select("key", "s", "n", F.coalesce("component", "s").alias("c"))


def _several(inside: DataFrame) -> DataFrame:
    """The buckets that hold several components."""
    return inside.groupBy("key").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low < high").select("key")


def _tries(inside: DataFrame, turn: int, threshold: int) -> DataFrame:
    """Pairs (a, b): in each bucket one member of each component, by a hash of the turn, with one of the largest."""
    drawn = F.struct(F.xxhash64("s", "key", F.lit(turn)).alias("at"), "s", "n")
    one = keep(inside.join(_several(inside), "key").groupBy("key", "c").agg(F.count("*").alias("k"), F.min(drawn).alias("x")), "drawn")
    main = one.groupBy("key").agg(F.max_by(F.struct("c", "x"), F.struct("k", "c")).alias("main"))
    met = one.join(main, "key").where("c != main.c").select(F.col("x.s").alias("s"), F.col("x.n").alias("n"), F.col("main.x.s").alias("t"), F.col("main.x.n").alias("m"))
    return met.where(_fits("n", "m", threshold)).select(F.least("s", "t").alias("a"), F.greatest("s", "t").alias("b")).distinct()


def _joined(part: DataFrame, links: DataFrame) -> DataFrame:
    """`part` (node, component) after joining the components that `links` (a, b) connect."""
    label = lambda c: F.coalesce(F.col(f"p{c}.component"), F.col(f"e.{c}")).alias(c)
    met = links.alias("e").join(part.alias("pa"), F.col("e.a") == F.col("pa.node"), "left").join(part.alias("pb"), F.col("e.b") == F.col("pb.node"), "left")
    tops = components(met.select(label("a"), label("b")))
    ends = links.select(F.col("a").alias("node")).unionByName(links.select(F.col("b").alias("node"))).distinct()
    nodes = part.unionByName(ends.join(part, "node", "left_anti").select("node", F.col("node").alias("component")))
    tops = tops.select(F.col("node").alias("component"), F.col("component").alias("top"))
    return keep(nodes.join(tops, "component", "left").select("node", F.coalesce("top", "component").alias("component")), "components")


def _grouped(docs: DataFrame, shingle: int, threshold: int, bands: int, rows: int) -> DataFrame:
    """doc_id, text_key, n, component_id, first_key (the text key of the component's first document); a row per document."""
    signed = keep(_signed(docs.select(long_id("doc_id"), "text", F.xxhash64("text").alias("text_key")), shingle, bands, rows), "signed")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_key"))
    sets = signed.where("n > 0").groupBy("sid", "n", "keys").agg(first.alias("f"))
    sets = keep(sets.select(F.monotonically_increasing_id().alias("s"), "sid", "n", "keys", F.col("f.doc_id").alias("doc_id"), F.col("f.text_key").alias("text_key")), "sets")

    in_band = sets.select("s", "n", F.explode("keys").alias("key"))
    shared = in_band.groupBy("key").agg(F.count("*").alias("k")).where("k > 1")
    members = keep(in_band.join(shared, "key"), "members")
    # A bucket's centre is the set that meets most others over all its buckets: in a family of
    # copies, one near the original, so that one comparison each joins most of the family.
    degree = members.groupBy("s").agg(F.sum("k").alias("degree"))
    centres = members.select("key", "s").join(degree, "s").groupBy("key").agg(F.max_by("s", "degree").alias("rep"))
    reps = sets.select(F.col("s").alias("rep"), F.col("n").alias("rep_n"))
    pairs = members.join(centres, "key").where("s != rep").select("rep", "s", "n").distinct().join(reps, "rep").where(_fits("n", "rep_n", threshold))
    pairs = keep(pairs.select(F.least("rep", "s").alias("a"), F.greatest("rep", "s").alias("b")).distinct(), "pairs")
    wanted = members.select("s").distinct().join(sets.select("s", "doc_id", "text_key"), "s")
    shingles = keep(_shingles_of(docs, wanted, shingle), "shingle-sets")
    links = keep(_linked(pairs, shingles, threshold), "links")
    compared, scratch = pairs, [members, pairs, shingles, links]
    part = components(links)

    for turn in range(ROUNDS):
        tries = keep(_tries(_inside(members, part), turn, threshold).join(compared, ["a", "b"], "left_anti"), "pairs")
        found = keep(_linked(tries, shingles, threshold), "links")
        scratch += [tries, found]
        compared, part = compared.unionByName(tries), _joined(part, found)
        if found.count() * WORTHWHILE <= tries.count():
            break

    # What buckets left apart.
    inside = keep(_inside(members, part), "inside")
    open_sets = inside.join(_several(inside), "key").select("s", "n", "c").distinct()
    prefixes = keep(_prefixes(open_sets, shingles, threshold), "prefixes")
    more = _meetings(prefixes, shingles.select("s", *_SKETCH), threshold).join(compared, ["a", "b"], "left_anti")
    extra = keep(_linked(more, shingles, threshold), "links")
    final = _joined(part, extra).withColumnRenamed("node", "s")

    held = final.join(sets.select("s", "doc_id", "text_key"), "s")
    least = held.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_key")).alias("f"))
    linked = held.join(least, "component").select("s", "f")
    own = lambda c: F.when(F.col("f").isNotNull(), F.col(f"f.{c}")).otherwise(F.col(c))
    by_set = sets.select("s", "sid", "doc_id", "text_key").join(linked, "s", "left").select("sid", own("doc_id").alias("component_id"), own("text_key").alias("first_key"))
    by_set = keep(by_set, "components")
    for t in (*scratch, inside, prefixes, extra):
        forget(t)
    out = signed.select("doc_id", "text_key", "n", "sid").join(by_set, "sid", "left")
    alone = F.col("n") == 0
    return out.select("doc_id", "text_key", "n", F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), F.when(alone, F.col("text_key")).otherwise(F.col("first_key")).alias("first_key"))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, threshold: int = THRESHOLD, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept; one row per document. `threshold`: in hundredths."""
    kept = F.col("doc_id").eqNullSafe(F.col("component_id"))
    return _grouped(docs, shingle, threshold, bands, rows).select("doc_id", F.col("n").alias("n_shingles"), "component_id", kept.alias("kept"))


def keep_first(docs: DataFrame, shingle: int = SHINGLE, threshold: int = THRESHOLD, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """The rows of `docs`, all columns, that are the first document of their group; rows that repeat id and text are one."""
    found = _grouped(docs, shingle, threshold, bands, rows)
    first = found.where(F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("text_key") == F.col("first_key")))
    first = first.select(F.coalesce("doc_id", F.lit(_LAST)).alias("id"), F.col("text_key").alias("key")).distinct()
    rows_of = docs.select(F.struct(*docs.columns).alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("id"), F.xxhash64("text").alias("key"))
    return rows_of.join(first, ["id", "key"]).dropDuplicates(["id", "key"]).select(*[F.col(f"row.{c}").alias(c) for c in docs.columns])
