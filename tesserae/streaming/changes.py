"""File changes as a stream.

Spark's file source tells only of new paths. This source lists the tree in each micro-batch and
emits new, modified and deleted files; its offset is a number, and what was seen at each offset is a
file of its own, so offsets stay small for large trees.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

from ..functions.paths import extensions
from ..sources.files import IGNORED_DIRS, walk

SCHEMA = "file_path string, mtime_ms long, op string"


def is_ignored(path: str | None) -> bool:
    """Whether a change below an ignored folder can be skipped."""
    return not path or any(p in IGNORED_DIRS for p in path.replace("\\", "/").split("/"))


def snapshot(root: str, content: list[str]) -> dict[str, int]:
    out = {}
    for path in walk(root, extensions(content)):
        try:
            out[os.path.relpath(path, root).replace(os.sep, "/")] = int(os.stat(path).st_mtime * 1000)
        except OSError:
            continue
    return out


def difference(before: dict[str, int], after: dict[str, int]) -> list[tuple[str, int | None, str]]:
    out = [(p, m, "new" if p not in before else "modified") for p, m in after.items() if before.get(p) != m]
    return sorted(out + [(p, None, "deleted") for p in before if p not in after])


class _Reader(SimpleDataSourceStreamReader):
    def __init__(self, options: dict):
        self.root = os.path.abspath(options["path"])
        self.content = options.get("content", "code").split(",")
        self.state = options["state"]
        self.known = options.get("known")

    def _file(self, n: int) -> str:
        return f"{self.state}/{n}.json"

    def _seen(self, n: int) -> dict[str, int]:
        try:
            with open(self._file(n)) as f:
                return json.load(f)
        except OSError:
            return {}

    def initialOffset(self) -> dict:
        os.makedirs(self.state, exist_ok=True)
        if not os.path.exists(self._file(0)):
            self._store(0, json.loads(self.known) if self.known else {})
        return {"n": 0}

    def _store(self, n: int, seen: dict[str, int]) -> None:
        temporary = f"{self._file(n)}.{uuid.uuid4().hex}"
        with open(temporary, "w") as f:
            json.dump(seen, f)
        os.replace(temporary, self._file(n))

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        n = start["n"]
        seen, now = self._seen(n), snapshot(self.root, self.content)
        rows = difference(seen, now)
        if not rows:
            return iter(()), {"n": n}
        self._store(n + 1, now)
        return iter(rows), {"n": n + 1}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter(difference(self._seen(start["n"]), self._seen(end["n"])))

    def commit(self, end: dict) -> None:
        for n in range(max(0, end["n"] - 50), end["n"] - 1):
            if os.path.exists(self._file(n)):
                os.remove(self._file(n))


class FileChanges(DataSource):
    """Format `file_changes`. Options: path, state (a folder for what was seen), content (default code), known (JSON of path to mtime)."""

    @classmethod
    def name(cls) -> str:
        return "file_changes"

    def schema(self) -> str:
        return SCHEMA

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return _Reader(dict(self.options))


def read_changes(spark: SparkSession, root: str, state: str, content: list[str] | None = None, known: dict[str, int] | None = None) -> DataFrame:
    spark.dataSource.register(FileChanges)
    reader = spark.readStream.format("file_changes").option("path", root).option("state", state).option("content", ",".join(content or ["code"]))
    return (reader.option("known", json.dumps(known)) if known is not None else reader).load()


def follow(changes: DataFrame, apply: Callable[[list[str]], None], checkpoint: str):
    """Starts a query that hands each micro-batch's paths to `apply`, one batch at a time; a failed batch comes again."""

    def batch(df: DataFrame, _: int) -> None:
        paths = [r.file_path for r in df.select("file_path").distinct().collect()]  # one batch of file changes
        if paths:
            apply(paths)

    return changes.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).start()
