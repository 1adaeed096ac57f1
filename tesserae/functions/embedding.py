"""Embedding backends: windows, batches, pooling; a local hash embedder and an HTTP one.

A backend is any object with `model`, `dimensions` and `embed(texts) -> list of raw vectors`; it is
sent to the tasks, so it must pickle.
"""

from __future__ import annotations

import hashlib
import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, EngineConfig
from ..plans.query import tokenize

# Answers worth another try.
RETRIED = (429, 500, 502, 503, 504)


def split_windows(text: str, size: int = 1300, overlap: int = 120) -> list[str]:
    """`vectors.windows` of one text."""
    step = max(64, size - overlap)
    return [text[i * step : i * step + size] for i in range(max(0, -(-(len(text) - size) // step)) + 1)]


def sanitize(text: str, backslashes: str = "preserve") -> str:
    """No lone surrogates; backslashes kept, made four, or turned into slashes."""
    text = text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")
    return {"preserve": text, "quad": text.replace("\\", "\\" * 4), "strip": text.replace("\\", "/")}[backslashes]


def unit(v: np.ndarray) -> np.ndarray:
    n = np.sqrt((v * v).sum())
    return v if n == 0 else v / n


def pool(vectors: list[np.ndarray]) -> np.ndarray:
    """One unit vector: the mean of the raw window vectors."""
    return unit(vectors[0] if len(vectors) == 1 else np.mean(vectors, 0))


def vectors_of(data: list[dict], expected: int, dimensions: int | None = None) -> list[np.ndarray]:
    """A response's vectors by index, checked; int8 payloads become floats."""
    if len(data) != expected or sorted(x["index"] for x in data) != list(range(expected)):
        raise ValueError(f"expected {expected} embeddings with distinct indices")
    out: list[np.ndarray] = [None] * expected
    for x in data:
        e = x["embedding"]
        v = (np.array(e["values"], float) - e.get("zero_point", 0)) * e["scale"] if isinstance(e, dict) else np.array(e, float)
        if len(v) != (dimensions or len(v)):
            raise ValueError(f"expected {dimensions} dimensions, got {len(v)}")
        out[x["index"]] = v
        dimensions = len(v)
    return out


@dataclass
class HashEmbedder:
    """Signed feature hashing of identifier parts: deterministic, local, no model."""

    dimensions: int = 256
    model: str = "hash"

    def embed(self, texts: list[str]) -> list[np.ndarray]:
        out = []
        for text in texts:
            v = np.zeros(self.dimensions)
            for t in tokenize(text):
                h = int.from_bytes(hashlib.blake2b(t.encode(), digest_size=8).digest(), "little")
                v[h % self.dimensions] += 1 if h >> 63 else -1
            out.append(v)
        return out


class HttpError(Exception):
    def __init__(self, status: int, body: str):
        super().__init__(f"{status}: {body[:200]}")
        self.status, self.body = status, body


@dataclass
class HttpEmbedder:
    """An OpenAI-compatible endpoint. `send(payload) -> response` may be replaced, for tests or other transports."""

    url: str
    model: str
    dimensions: int | None = None
    key: str = ""
    retries: int = 4
    send: Callable[[dict], dict] | None = None
    sleep: Callable[[float], None] = time.sleep
    stats: dict[str, int] = field(default_factory=lambda: dict.fromkeys(("requests", "texts", "chars", "retries", "splits", "errors", "total_ms", "max_ms"), 0))

    def _post(self, payload: dict) -> dict:
        if self.send:
            return self.send(payload)
        request = urllib.request.Request(self.url, json.dumps(payload).encode(), {"Content-Type": "application/json", "Authorization": f"Bearer {self.key}"})
        try:
            with urllib.request.urlopen(request, timeout=60) as r:
                return json.load(r)
        except urllib.error.HTTPError as e:
            raise HttpError(e.code, e.read().decode(errors="replace")) from e

    def _request(self, texts: list[str]) -> list[np.ndarray]:
        payload = {"model": self.model, "input": texts} | ({"dimensions": self.dimensions} if self.dimensions else {})
        for attempt in range(self.retries + 1):
            try:
                self.stats["requests"] += 1
                return self._timed(payload, texts)
            except HttpError as e:
                if e.status not in RETRIED or attempt == self.retries:
                    self.stats["errors"] += 1
                    raise
                self.stats["retries"] += 1
                self.sleep(min(250 * 2**attempt, 4000) / 1000)
        raise AssertionError

    def _timed(self, payload: dict, texts: list[str]) -> list[np.ndarray]:
        began = time.perf_counter()
        try:
            return vectors_of(self._post(payload)["data"], len(texts), self.dimensions)
        finally:
            ms = (time.perf_counter() - began) * 1000
            self.stats["total_ms"] += ms
            self.stats["max_ms"] = max(self.stats["max_ms"], ms)

    def embed(self, texts: list[str]) -> list[np.ndarray]:
        """A batch that is too large is halved; so is a single text, whose halves' vectors are pooled: always one vector per text."""
        self.stats["texts"] += len(texts)
        self.stats["chars"] += sum(map(len, texts))
        try:
            return self._request(texts)
        except HttpError as e:
            if e.status != 413 or (len(texts) == 1 and len(texts[0]) <= 128):
                raise
        self.stats["splits"] += 1
        if len(texts) > 1:
            half = len(texts) // 2
            return self.embed(texts[:half]) + self.embed(texts[half:])
        half = len(texts[0]) // 2
        return [np.mean(self.embed([texts[0][:half], texts[0][half:]]), 0)]


def embed_texts(backend, texts: list[str], config: EngineConfig = DEFAULT) -> list[np.ndarray]:
    """One unit vector per text: windows in batches, pooled."""
    parts = [split_windows(sanitize(t, config.backslashes), config.window_chars, config.window_overlap) for t in texts]
    flat = [w for p in parts for w in p]
    raw = [v for i in range(0, len(flat), config.embed_batch) for v in backend.embed(flat[i : i + config.embed_batch])]
    out, at = [], 0
    for p in parts:
        out.append(pool(raw[at : at + len(p)]))
        at += len(p)
    return out


@dataclass
class Probe:
    """What a first request to a backend tells."""

    valid: bool
    message: str
    status: int | None = None
    dimensions: int | None = None


def probe(backend) -> Probe:
    """Sends one short text: whether the backend answers, may be used, and gives the dimensions it should."""
    try:
        found = backend.embed(["validation"])
    except HttpError as e:
        refused = e.status in (401, 403)
        return Probe(False, "the key was refused" if refused else f"the backend answered {e}", e.status)
    except OSError as e:
        return Probe(False, f"the backend cannot be reached: {e}")
    except (ValueError, KeyError, TypeError) as e:
        return Probe(False, f"the answer cannot be read: {e}", 200)
    n = len(found[0]) if found else 0
    if not n:
        return Probe(False, "the answer is empty", 200)
    if backend.dimensions not in (None, n):
        return Probe(False, f"expected {backend.dimensions} dimensions, got {n}", 200, n)
    return Probe(True, "the key is valid", 200, n)


#: What a backend counts, summed over all tasks by `embed_profile`.
COUNTERS = ("requests", "texts", "chars", "retries", "splits", "errors", "total_ms", "max_ms")


def embed_profile(rows: DataFrame, backend, key: str = "chunk_ord", text: str = "content", config: EngineConfig = DEFAULT) -> DataFrame:
    """One row, COUNTERS: what embedding every row's text costs. Counters travel as rows, as changes that tasks make to a
    backend are lost with them; a task that is run again counts once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            reset_stats(backend)
            began = time.perf_counter()
            texts = batch[text].fillna("").tolist()
            embed_texts(backend, texts, config)
            ms = (time.perf_counter() - began) * 1000
            told = dict(getattr(backend, "stats", {}))
            told = {"requests": 0, "texts": len(texts), "chars": sum(map(len, texts)), "retries": 0, "splits": 0, "errors": 0, "total_ms": ms, "max_ms": ms} | told
            yield pd.DataFrame([{c: float(told[c]) for c in COUNTERS}])

    told = rows.select(key, text).mapInPandas(run, ", ".join(f"{c} double" for c in COUNTERS))
    return told.agg(*[(F.max if c == "max_ms" else F.sum)(c).alias(c) for c in COUNTERS])


def reset_stats(backend) -> None:
    for name in getattr(backend, "stats", {}):
        backend.stats[name] = 0


def embed(rows: DataFrame, backend, key: str = "chunk_ord", text: str = "content", config: EngineConfig = DEFAULT) -> DataFrame:
    """key, vector of every row's text; tasks embed their own rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield pd.DataFrame({key: batch[key], "vector": [v.astype("float32").tolist() for v in embed_texts(backend, batch[text].fillna("").tolist(), config)]})

    return rows.select(key, text).mapInPandas(run, f"{key} long, vector array<float>")
