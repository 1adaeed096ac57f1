"""Exact nearest neighbours over float or int8 vectors.

The vectors are scanned once for all queries: each Arrow batch meets `TILE` queries at a time in a
matrix product, and a task keeps every query's best k rows over all its batches, which is all that
leaves it. The query matrix is broadcast if it has no more than `EngineConfig.query_block` rows; a
larger query table is taken in blocks of that size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, EngineConfig
from ..functions import vectors as V
from .lexical import top_k


TILE = 512


def quantized(vectors: DataFrame) -> DataFrame:
    """chunk_ord, vector -> chunk_ord, codes, scale (single precision, as stored)."""
    return vectors.select("chunk_ord", V.codes_of("vector").alias("codes"), V.scale_of("vector").cast("float").alias("scale"))


def _matrix(column: pa.Array, kind: type) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(kind)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _blocks(queries: DataFrame, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    ids, rows = [], []
    for r in queries.select("query_id", "vector").toLocalIterator():
        ids.append(r.query_id)
        rows.append(r.vector)
        if len(ids) == size:
            yield np.array(ids, np.int64), np.array(rows, np.float64)
            ids, rows = [], []
    if ids:
        yield np.array(ids, np.int64), np.array(rows, np.float64)


class _Best:
    """The k best rows of each query so far: by score, then by the smaller chunk."""

    def __init__(self, queries: int, k: int):
        self.k, self.scores, self.ords = k, np.full((queries, k), -np.inf), np.full((queries, k), np.iinfo(np.int64).max)

    def add(self, at: int, dots: np.ndarray, ords: np.ndarray) -> None:
        n = slice(at, at + len(dots))
        scores = np.concatenate([self.scores[n], dots], 1)
        chunks = np.concatenate([self.ords[n], np.broadcast_to(ords, dots.shape)], 1)
        pick = np.argpartition(-scores, self.k - 1, 1)[:, : self.k]
        worst = np.take_along_axis(scores, pick, 1).min(1, keepdims=True)
        # Where more rows share the k-th score than there are places, the smaller chunks take them.
        for q in np.flatnonzero((scores >= worst).sum(1) > self.k):
            tied = np.flatnonzero(scores[q] >= worst[q])
            pick[q] = tied[np.lexsort((chunks[q][tied], -scores[q][tied]))[: self.k]]
        self.scores[n], self.ords[n] = np.take_along_axis(scores, pick, 1), np.take_along_axis(chunks, pick, 1)

    def rows(self, a: int, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        scores, ords = self.scores[a:b], self.ords[a:b]
        q, j = np.nonzero(scores > -np.inf)
        return q + a, scores[q, j], ords[q, j]


def nearest(vectors: DataFrame, queries: DataFrame, k: int, selector: DataFrame | None = None, config: EngineConfig = DEFAULT) -> DataFrame:
    """query_id, chunk_ord, score (cosine), rank: the k nearest chunks of every query (query_id, vector).

    `vectors`: chunk_ord with vector (unit length) or with codes and scale."""
    if k < 1:
        raise ValueError(f"k must be at least 1: {k}")
    int8 = "codes" in vectors.columns
    held = vectors if selector is None else vectors.join(selector, "chunk_ord", "left_semi")
    # Every task puts out k rows a query: no more tasks than run at once, or what they put out grows with the square of the table.
    held = held.select("chunk_ord", *(["codes", "scale"] if int8 else ["vector"])).coalesce(vectors.sparkSession.sparkContext.defaultParallelism)
    schema = pa.schema([("query_id", pa.int64()), ("chunk_ord", pa.int64()), ("score", pa.float64())])
    spark, found = vectors.sparkSession, None
    for ids, rows in _blocks(queries, config.query_block):
        if int8:
            top = np.abs(rows).max(1)
            scale = np.where(top > 0, top / 127, 1.0)
            rows = np.clip(np.floor(rows / scale[:, None] + 0.5), -127, 127)
        else:
            scale = np.ones(len(rows))
        sent = spark.sparkContext.broadcast((ids, rows, scale))

        def scan(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            ids, rows, scale = sent.value
            best = _Best(len(ids), k)
            for batch in batches:
                if not batch.num_rows:
                    continue
                ords = batch.column(0).to_numpy()
                matrix = _matrix(batch.column(1), np.float64)
                own = batch.column(2).to_numpy().astype(np.float64) if int8 else None
                for a in range(0, len(ids), TILE):
                    dots = rows[a : a + TILE] @ matrix.T  # whole numbers for codes: exact
                    if int8:
                        dots = dots * scale[a : a + TILE, None] * own
                    best.add(a, dots, ords)
            for a in range(0, len(ids), TILE):
                q, d, o = best.rows(a, a + TILE)
                yield pa.RecordBatch.from_arrays([pa.array(ids[q]), pa.array(o), pa.array(d)], schema=schema)

        part = held.mapInArrow(scan, "query_id long, chunk_ord long, score double")
        found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], "query_id long, chunk_ord long, score double, rank int")
    return top_k(found, k)


def dense_scores(vectors: DataFrame, query: list[float]) -> DataFrame:
    """chunk_ord, score of one query by column expressions alone."""
    q = F.array(*[F.lit(float(x)) for x in query])
    if "codes" in vectors.columns:
        return vectors.select("chunk_ord", (V.code_dot("codes", V.codes_of(q)) * V.scale_of(q) * F.col("scale").cast("double")).alias("score"))
    return vectors.select("chunk_ord", V.dot("vector", q).alias("score"))
