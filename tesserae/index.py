"""The engine's front: build, search, related chunks, expansion, incremental updates, persistence."""

from __future__ import annotations

import json
import os
import tempfile
import time
from collections import OrderedDict

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import store
from .config import DEFAULT, EPOCH, EngineConfig
from .functions import embedding as E
from .operators import chunking, incremental, lexical, ranking, results, vector
from .plans import query as Q
from .sources import files, repos
from .streaming import changes

_CHUNK = ["chunk_ord", "content", "file_path", "start_line", "end_line", "language"]


class SearchIndex:
    """Tables of one corpus. Searching never changes them; updates make a new set."""

    def __init__(self, spark: SparkSession, tables: dict[str, DataFrame], backend, content: list[str], root: str | None = None, config: EngineConfig = DEFAULT):
        self.spark, self.tables, self.backend, self.content, self.root, self.config = spark, tables, backend, list(content), root, config
        self.loaded, self.folder = False, None
        self.listed: DataFrame | None = None
        self.counts: DataFrame | None = None

    # Building

    @classmethod
    def from_chunks(cls, chunks: DataFrame, backend=None, vectors: DataFrame | None = None, content: list[str] | None = None, root: str | None = None, listed: DataFrame | None = None, config: EngineConfig = DEFAULT) -> SearchIndex:
        """`chunks` as in `schemas.CHUNK`; `vectors` (chunk_ord, vector of unit length), else the backend embeds them."""
        spark, backend = chunks.sparkSession, backend or E.HashEmbedder()
        chunks = chunks.select(*_CHUNK)
        if chunks.isEmpty():
            raise ValueError("no chunks to index")
        vectors = E.embed(chunks, backend, config=config) if vectors is None else vectors.select("chunk_ord", F.col("vector").cast("array<float>").alias("vector"))
        held = vectors if config.float_vectors else vector.quantized(vectors)
        counts = lexical.term_counts(chunks).cache()
        documents = lexical.document_stats(chunks, counts)
        tables = {
            "chunks": ranking.chunk_meta(chunks), "postings": lexical.postings(counts, documents), "terms": lexical.term_stats(counts), "documents": documents,
            "corpus": lexical.corpus_stats(documents), "vectors": held, "files": listed if listed is not None else spark.createDataFrame([], "file_path string, mtime_ms long"),
        }
        index = cls(spark, tables, backend, content or ["code"], root, config)
        index.counts = counts
        return index

    @classmethod
    def from_path(cls, spark: SparkSession, path: str, content: list[str] | None = None, backend=None, cache: str | None = None, config: EngineConfig = DEFAULT) -> SearchIndex:
        """A folder's index; with `cache`, one stored there that still fits is brought up to date instead."""
        repos.check_workspace(path, config)
        root, content, backend = os.path.abspath(path), content or ["code"], backend or E.HashEmbedder()
        if not os.path.isdir(root):
            raise FileNotFoundError(path)
        folder = f"{cache}/{store.cache_key(root)}" if cache else None
        if folder and store.valid(spark, folder, backend.model, content, _storage(config), backend.dimensions, root):
            index = cls.load(spark, folder, backend, config)
            index.refresh()
            return index
        listed = files.listing(spark, root, content, config)
        chunks = _numbered(_chunks_of(listed, root, config))
        index = cls.from_chunks(chunks, backend, content=content, root=root, listed=listed.select("file_path", "mtime_ms"), config=config)
        index.listed = listed
        if folder:
            index.save(folder)
        return index

    @classmethod
    def from_git(cls, spark: SparkSession, url: str, cache: str, content: list[str] | None = None, backend=None, ref: str | None = None, config: EngineConfig = DEFAULT) -> SearchIndex:
        """A clone's index; it is stored, and the clone deleted."""
        content, backend = content or ["code"], backend or E.HashEmbedder()
        folder = f"{cache}/{store.cache_key(repos.source_key(url, ref))}"
        if not store.valid(spark, folder, backend.model, content, _storage(config)):
            with repos.cloned(url, ref, config) as root:
                listed = files.listing(spark, root, content, config)
                index = cls.from_chunks(_numbered(_chunks_of(listed, root, config)), backend, content=content, listed=listed.select("file_path", "mtime_ms"), config=config)
                index.save(folder)
        return cls.load(spark, folder, backend, config)

    @classmethod
    def from_source(cls, spark: SparkSession, source: str, cache: str | None = None, **options) -> SearchIndex:
        if repos.is_git_url(source):
            return cls.from_git(spark, source, cache or tempfile.mkdtemp(prefix="tesserae-cache-"), **options)
        return cls.from_path(spark, source, cache=cache, **options)

    # Persistence

    def save(self, folder: str) -> None:
        """Writes the tables as a new version of the folder and goes on with what is stored there."""
        vectors = self.tables["vectors"]
        dims = vectors.select(F.size("vector" if "vector" in vectors.columns else "codes").alias("n")).first()
        meta = store.Meta(EPOCH, self.root, int(time.time()), self.backend.model, dims.n if dims else 0, tuple(self.content), _storage(self.config))
        store.save(self.spark, folder, self.tables, meta)
        self.tables, self.folder = store.load(self.spark, folder)[0], folder
        if self.counts is not None:  # nothing reads them any more
            self.counts.unpersist()
            self.counts = None

    def save_to_cache(self, cache: str, force: bool = False) -> bool:
        """Stores the index under its source's key, unless it was loaded from there and has not changed."""
        if self.loaded and not force:
            return False
        self.save(f"{cache}/{store.cache_key(self.root or '')}")
        self.loaded = True
        return True

    @classmethod
    def load(cls, spark: SparkSession, folder: str, backend=None, config: EngineConfig = DEFAULT) -> SearchIndex:
        tables, meta = store.load(spark, folder)
        index = cls(spark, tables, backend or E.HashEmbedder(), list(meta.content), meta.root_path, config)
        index.loaded, index.folder = True, folder
        return index

    def cache(self) -> SearchIndex:
        """Keeps the tables in memory (spilling to disk) for repeated searches."""
        self.tables = {k: v.persist() for k, v in self.tables.items()}
        return self

    def file_status(self) -> dict[str, int]:
        """How many of the listed files were indexed, empty or too large, and unreadable, at the last build."""
        if self.listed is None:
            return {}
        return files.status_counts(files.read_files(self.listed, self.config)).first().asDict()

    def memory_bytes(self) -> int:
        v = self.tables["vectors"]
        int8 = "codes" in v.columns
        r = v.agg(F.count("*").alias("n"), F.max(F.size("codes" if int8 else "vector")).alias("d")).first()
        return r.n * (r.d or 0) + 4 * r.n if int8 else 4 * r.n * (r.d or 0)

    # Searching

    def rank(self, plans: DataFrame, query_vectors: DataFrame, languages: list[str] | None = None, paths: list[str] | None = None, rerank: bool | None = None, strict: bool = False, most: int | None = None) -> DataFrame:
        """query_id, chunk_ord, score, rank for a table of plans and their vectors (query_id, vector).

        `most`: the largest number of candidates and of results of a plan, if known."""
        t = self.tables
        allowed = lexical.selector(t["chunks"], languages, paths)
        if most is None:
            most = plans.agg(F.greatest(F.max("candidates"), F.max("top_k"))).first()[0]
        if most is None:
            return self.spark.createDataFrame([], "query_id long, chunk_ord long, score double, rank int")
        # The bound of all plans cuts before rows of a query meet, each plan's own afterwards.
        candidates = plans.select("query_id", "candidates")
        own = lambda hits: hits.join(candidates, "query_id").where("rank <= candidates").select("query_id", "chunk_ord", "score", "rank")
        words = own(lexical.top_k(lexical.bm25(plans, t["postings"], t["terms"], t["corpus"], allowed, self.config), most))
        near = own(vector.nearest(t["vectors"], query_vectors, most, allowed, self.config))
        fused = ranking.fuse(near, words, plans, self.config)
        if rerank is None:
            rerank = "code" in self.content
        if not rerank:
            return ranking.plain_top(fused, t["chunks"], plans)
        pool = t["chunks"].join(allowed, "chunk_ord", "left_semi") if strict and allowed is not None else t["chunks"]
        entries = ranking.entry_candidates(pool, plans, most, self.config) if self.config.improvements else None
        scores = ranking.boosted(fused, t["chunks"], plans, self.config, entries)
        if strict and allowed is not None:
            scores = scores.join(allowed, "chunk_ord", "left_semi")
        return ranking.saturated(scores, t["chunks"], plans, self.config)

    def batch_search(self, queries: DataFrame, top_k: int = 10, alpha: float | None = None, **options) -> DataFrame:
        """queries (query_id, text) -> hits with their chunks, best first within a query."""
        plans = Q.analysed(queries, top_k, alpha, self.config).cache()
        vectors = E.embed(plans.select("query_id", "text"), self.backend, "query_id", "text", self.config)
        return self._with_chunks(self.rank(plans, vectors, **options), plans)

    def search(self, query: str, top_k: int = 10, alpha: float | None = None, **options) -> DataFrame:
        if not query or not query.strip():
            return self._with_chunks(self.spark.createDataFrame([], "query_id long, chunk_ord long, score double, rank int"), self.spark.createDataFrame([], Q.SCHEMA))
        plan = Q.analyse(0, query, top_k, alpha, self.config)
        plans = self.spark.createDataFrame([plan], Q.SCHEMA).coalesce(1)
        v = [float(x) for x in E.embed_texts(self.backend, [query], self.config)[0]]
        return self._with_chunks(self.rank(plans, self.spark.createDataFrame([(0, v)], "query_id long, vector array<double>"), most=max(plan["candidates"], top_k), **options), plans)

    def _with_chunks(self, hits: DataFrame, plans: DataFrame) -> DataFrame:
        shown = self.tables["chunks"].select(*_CHUNK)
        return hits.join(shown, "chunk_ord").join(plans.select("query_id", "text", "match_terms"), "query_id").orderBy("query_id", "rank")

    def answer(self, query: str, top_k: int | None = None, **options) -> dict:
        """One query's payload: best chunk per file, snippets, relative scores."""
        from .config import clamp_top_k

        hits = ranking.dedupe_by_file(self.search(query, clamp_top_k(top_k), **options))
        row = results.payload(hits, self.root, self.config.snippets, self.config).first()
        return json.loads(row.json) if row else {"query": query, "results": []}

    def chunk_at(self, path: str, line: int) -> DataFrame:
        wanted = self.spark.createDataFrame([(0, repos.indexed_path(path, self.root), line)], "request_id long, file_path string, line int")
        return results.resolve(self.tables["chunks"].select(*_CHUNK), wanted)

    def expand_payload(self, path: str, line: int, before: int = 1, after: int = 1) -> dict:
        """The chunk at a line and its neighbours as one answer."""
        wanted = repos.indexed_path(path, self.root)
        row = results.expand_payload(self.expand(path, line, before, after), self.root).first()
        found = json.loads(row.json) if row else {"chunk_count": 0, "anchor": None, "chunks": []}
        return {"file_path": wanted or path, "line": line, "chunk_count": found["chunk_count"], "anchor": found.get("anchor"), "chunks": found["chunks"]}

    def expand(self, path: str, line: int, before: int = 1, after: int = 1) -> DataFrame:
        wanted = self.spark.createDataFrame([(0, repos.indexed_path(path, self.root), line)], "request_id long, file_path string, line int")
        return results.expand(self.tables["chunks"].select(*_CHUNK), wanted, before, after).orderBy("offset")

    def find_related(self, path: str, line: int, top_k: int = 5, exclude_same_file: bool = False) -> DataFrame:
        """Chunks nearest to the one at a line, of its language, without itself."""
        source = self.chunk_at(path, line).first()
        if source is None:
            return self.spark.createDataFrame([], "chunk_ord long, score double, rank int")
        v = [float(x) for x in E.embed_texts(self.backend, [source.content], self.config)[0]]
        asked = self.spark.createDataFrame([(0, v)], "query_id long, vector array<double>")
        allowed = lexical.selector(self.tables["chunks"], [source.language] if source.language else None)
        own = self.tables["chunks"].where(F.col("file_path") == source.file_path).count() if exclude_same_file else 1
        near = vector.nearest(self.tables["vectors"], asked, top_k + own, allowed, self.config)
        near = near.where(F.col("chunk_ord") != source.chunk_ord).join(self.tables["chunks"].select(*_CHUNK), "chunk_ord")
        if exclude_same_file:
            near = near.where(F.col("file_path") != source.file_path)
        return near.orderBy("rank").limit(top_k).drop("query_id")

    # Updating

    def apply(self, paths: list[str]) -> bool:
        """Re-reads files (relative paths): their chunks go, and come again from what is there now. Only they are embedded.

        The result is written as a new version, of the index's folder or of one of its own, and read from there: an
        index has the same short plans however often it was updated, and a stream that stops finds its last state."""
        if not self.root:
            raise ValueError("an index without a local folder cannot be updated")
        paths = sorted({p.replace("\\", "/") for p in paths if not changes.is_ignored(p)})
        if not paths:
            return False
        spark, t = self.spark, self.tables
        changed = spark.createDataFrame([(p,) for p in paths], "file_path string")
        now = files.listing(spark, self.root, self.content, self.config)
        fresh = _numbered(_chunks_of(now.join(changed, "file_path", "left_semi"), self.root, self.config, entries="package.json" in paths))
        chunks = incremental.apply_changes(t["chunks"].select(*_CHUNK), changed, fresh)
        if chunks.isEmpty():
            raise ValueError("the update would leave an empty index")
        old = t["chunks"].join(changed, "file_path", "left_semi").select("chunk_ord")
        added = chunks.join(t["chunks"].select("chunk_ord"), "chunk_ord", "left_anti")
        vectors = E.embed(added, self.backend, config=self.config)
        held = t["vectors"].join(old, "chunk_ord", "left_anti").select(*t["vectors"].columns)
        held = held.unionByName(vectors if self.config.float_vectors else vector.quantized(vectors))
        gone = t["postings"].join(old, "chunk_ord", "left_anti")
        counts = gone.select("chunk_ord", "term", "tf").unionByName(lexical.term_counts(added)).cache()
        documents = lexical.document_stats(chunks, counts)
        state = now.select("file_path", "mtime_ms")
        self.tables = {"chunks": ranking.chunk_meta(chunks), "postings": lexical.postings(counts, documents), "terms": lexical.term_stats(counts), "documents": documents, "corpus": lexical.corpus_stats(documents), "vectors": held, "files": state}
        self.save(self.folder or store.scratch(spark, "index"))
        counts.unpersist()
        self.loaded = False
        return True

    def refresh(self) -> list[str]:
        """Brings the index in step with its folder; the paths that had changed."""
        if not self.root or not os.path.isdir(self.root):
            return []
        now = files.listing(self.spark, self.root, self.content, self.config).select("file_path", "mtime_ms")
        paths = [r.file_path for r in incremental.changes(self.tables["files"], now).collect()]
        self.apply(paths)
        return paths

    def watch(self, state: str):
        """A streaming query that applies file changes as they come; `processAllAvailable()` waits for them."""
        known = {r.file_path: r.mtime_ms for r in self.tables["files"].toLocalIterator()}
        stream = changes.read_changes(self.spark, self.root, f"{state}/seen", self.content, known)
        return changes.follow(stream, self.apply, f"{state}/checkpoint")


class IndexCache:
    """A few open indexes by source; the oldest goes first."""

    def __init__(self, spark: SparkSession, folder: str, config: EngineConfig = DEFAULT):
        self.spark, self.folder, self.config = spark, folder, config
        self.held: OrderedDict[str, SearchIndex] = OrderedDict()
        self.streams: dict[str, object] = {}

    def get(self, source: str, ref: str | None = None, **options) -> SearchIndex:
        if not repos.is_allowed(source, self.config):
            raise ValueError(f"not an allowed source: {source}")
        repos.check_workspace(source, self.config)
        key = repos.source_key(source, ref)
        if key in self.held:
            if key in self.streams:
                self.streams[key].processAllAvailable()  # changes made before this call are seen by it
            else:
                self.held[key].refresh()
            return self.held[key]
        more = {"ref": ref} if repos.is_git_url(source) else {}
        index = SearchIndex.from_source(self.spark, source, self.folder, config=self.config, **more, **options)
        self.held[key] = index
        while len(self.held) > self.config.cached_indexes:
            self._drop(next(iter(self.held)))
        return index

    def watch(self, source: str, state: str, **options) -> SearchIndex:
        """The source's index, kept in step by a stream; `get` waits for what the stream has to do."""
        index = self.get(source, **options)
        key = repos.source_key(source, None)
        if key not in self.streams:
            self.streams[key] = index.watch(state)
        return index

    def _drop(self, key: str) -> None:
        self.held.pop(key, None)
        if key in self.streams:
            self.streams.pop(key).stop()

    def clear(self, source: str, ref: str | None = None) -> None:
        key = repos.source_key(source, ref)
        self._drop(key)
        store.delete(self.spark, f"{self.folder}/{store.cache_key(key)}")


def _storage(config: EngineConfig) -> str:
    return "float" if config.float_vectors else "int8"


def _chunks_of(listed: DataFrame, root: str, config: EngineConfig, entries: bool = True) -> DataFrame:
    read = files.read_files(listed, config).where("status = 'valid'")
    chunks = chunking.chunk_files(read, config)
    found = files.entry_chunks(root) if entries else []
    extra = listed.sparkSession.createDataFrame([(*r, 1 << 40, 0) for r in found], chunks.schema)
    return chunks.unionByName(extra)


def numbered_by(rows: DataFrame, part: Column, order: list[str]) -> DataFrame:
    """`rows` with chunk_ord from 0 in the order of `part`, then `order`.

    Rows are counted per part and numbered within it, so no task sees them all; only parts are in one place."""
    sizes = rows.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    base = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = rows.withColumn("part", part).join(sizes.select("part", base.alias("base")), "part")
    nth = F.row_number().over(Window.partitionBy("part").orderBy(*order))
    return placed.withColumn("chunk_ord", (F.col("base") + nth - 1).cast("long")).drop("part", "base")


def _numbered(chunks: DataFrame) -> DataFrame:
    """chunk_ord in file order, a thousand files a part."""
    return numbered_by(chunks, F.floor(F.col("file_seq") / 1000), ["file_seq", "span_start"]).select(*_CHUNK)
