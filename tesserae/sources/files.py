"""Source trees as tables of files.

The tree is listed on the driver (folders are few next to their bytes, and pruned ones are never
entered); what is read is spread over tasks. Spark's own file sources are not used, as they hide
names that begin with `_` or `.`.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULT, EngineConfig
from ..functions import paths as P

# Folders that are never entered.
IGNORED_DIRS = (
    ".git", ".hg", ".svn", "__pycache__", "node_modules", ".venv", "venv", ".tox", ".mypy_cache", ".pytest_cache", ".ruff_cache", ".cache", ".tesserae", ".next", "dist", "build", ".eggs",
)
IGNORE_FILES = (".gitignore", ".indexignore")


class IgnoreRules:
    """The patterns of one folder's ignore files; the last one that fits decides."""

    def __init__(self, lines: list[str]):
        self.rules = [r for r in map(self._rule, lines) if r]

    @staticmethod
    def _rule(line: str) -> tuple[re.Pattern, bool, bool] | None:
        line = line.rstrip("\r\n")
        line = line if line.endswith("\\ ") else line.rstrip(" ")
        if not line or line.startswith("#"):
            return None
        keep, line = line.startswith("!"), line.removeprefix("!")
        only_dirs, line = line.endswith("/"), line.rstrip("/")
        if not line:
            return None
        anchored = "/" in line
        return re.compile(("" if anchored else "(?:.*/)?") + IgnoreRules._regex(line.lstrip("/")) + r"\Z", re.S), only_dirs, keep

    @staticmethod
    def _regex(glob: str) -> str:
        out, i = [], 0
        while i < len(glob):
            c = glob[i]
            if glob.startswith("**/", i) and (i == 0 or glob[i - 1] == "/"):
                out.append("(?:.*/)?")
                i += 3
            elif glob.startswith("/**", i) and i + 3 == len(glob):
                out.append("/.*")
                i += 3
            elif c == "*":
                while glob.startswith("*", i + 1):
                    i += 1
                out.append("[^/]*")
                i += 1
            elif c == "?":
                out.append("[^/]")
                i += 1
            elif c == "[" and (end := glob.find("]", i + 2)) > 0:
                body = glob[i + 1 : end]
                out.append("[" + ("^" + body[1:] if body[0] in "!^" else body).replace("\\", "\\\\") + "]")
                i = end + 1
            elif c == "\\" and i + 1 < len(glob):
                out.append(re.escape(glob[i + 1]))
                i += 2
            else:
                out.append(re.escape(c))
                i += 1
        return "".join(out)

    def _fits(self, path: str, is_dir: bool) -> bool:
        ignored = False
        for pattern, only_dirs, keep in self.rules:
            if (is_dir or not only_dirs) and pattern.match(path):
                ignored = not keep
        return ignored

    def ignores(self, path: str, is_dir: bool = False) -> bool:
        """`path` relative to the folder; what is below an ignored folder is ignored too."""
        parts = path.split("/")
        return any(self._fits("/".join(parts[:i]), True) for i in range(1, len(parts))) or self._fits(path, is_dir)


def _rules_of(folder: str) -> IgnoreRules | None:
    lines: list[str] = []
    for name in IGNORE_FILES:
        try:
            with open(f"{folder}/{name}", encoding="utf-8", errors="replace") as f:
                lines += f.read().split("\n")
        except OSError:
            pass
    return IgnoreRules(lines) if lines else None


def walk(root: str, extensions: list[str]) -> Iterator[str]:
    """Paths of regular files of these extensions, by name; unreadable folders are skipped, links not followed.

    Any folder's rules that ignore a path settle it: those of folders below cannot bring it back."""
    wanted = {e.lower() for e in extensions}

    def inside(folder: str, above: list[tuple[str, IgnoreRules]]) -> Iterator[str]:
        try:
            entries = sorted(os.scandir(folder), key=lambda e: e.name)
        except OSError:
            return
        own = _rules_of(folder)
        rules = [*above, (folder, own)] if own else above
        ignored = lambda path, is_dir: any(r.ignores(os.path.relpath(path, base).replace(os.sep, "/"), is_dir) for base, r in rules)
        for e in entries:
            if e.is_dir(follow_symlinks=False):
                if e.name not in IGNORED_DIRS and not ignored(e.path, True):
                    yield from inside(e.path, rules)
            elif e.is_file(follow_symlinks=False) and not ignored(e.path, False):
                ext = "." + e.name.rsplit(".", 1)[1].lower() if "." in e.name else ""
                if e.name.lower() == "dockerfile" or ext in wanted:
                    yield e.path

    yield from inside(root, [])


def listing(spark: SparkSession, root: str, content: list[str] | None = None, config: EngineConfig = DEFAULT) -> DataFrame:
    """file_seq, file_path (relative), abs_path, mtime_ms of every file to index."""
    root = os.path.abspath(root)
    rows = []
    for path in walk(root, P.extensions(content or ["code"])):
        if config.max_index_files is not None and len(rows) >= config.max_index_files:
            raise ValueError(f"more than {config.max_index_files} files to index below {root}")
        try:
            mtime = int(os.stat(path).st_mtime * 1000)
        except OSError:
            mtime = -1
        rows.append((len(rows), os.path.relpath(path, root).replace(os.sep, "/"), path, mtime))
    return spark.createDataFrame(rows, "file_seq long, file_path string, abs_path string, mtime_ms long")


def read_files(listed: DataFrame, config: EngineConfig = DEFAULT) -> DataFrame:
    """Adds content (UTF-8, broken bytes replaced), size, status (valid, empty, too_large, error) and language."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sizes, texts = [], []
            for path in batch["abs_path"]:
                size, text = -1, None
                try:
                    size = os.path.getsize(path)
                    if size <= config.max_file_bytes:
                        with open(path, "rb") as f:
                            text = f.read().decode("utf-8", "replace")
                except OSError:
                    size = -1
                sizes.append(size)
                texts.append(text)
            yield batch.assign(size=sizes, content=texts)

    schema = "file_seq long, file_path string, abs_path string, mtime_ms long, size long, content string"
    # One task per core at least, however few files there are.
    spread = listed.repartition(listed.sparkSession.sparkContext.defaultParallelism, "file_seq")
    read = spread.select("file_seq", "file_path", "abs_path", "mtime_ms").mapInPandas(run, schema)
    status = F.when(F.col("size") < 0, "error").otherwise(P.file_status(F.col("size"), F.coalesce("content", F.lit("")), config.max_file_bytes, config.blank_check_bytes))
    return read.withColumn("status", status).withColumn("language", P.language("file_path"))


def status_counts(files: DataFrame) -> DataFrame:
    """One row: indexed, empty_or_skipped, file_errors."""
    return files.agg(F.count_if(F.col("status") == "valid").alias("indexed"), F.count_if(F.col("status").isin("empty", "too_large")).alias("empty_or_skipped"), F.count_if(F.col("status") == "error").alias("file_errors"))


def package_entry(text: str) -> str | None:
    """The synthetic chunk that tells a package's entry points, from its package.json."""
    try:
        pkg = json.loads(text)
    except ValueError:
        return None
    if not isinstance(pkg, dict):
        return None
    lines, bins = [P.PACKAGE_ENTRY], pkg.get("bin")
    if isinstance(bins, str):
        lines.append(f"bin: {bins}")
    elif isinstance(bins, dict):
        lines += [f"bin {k}: {v}" for k, v in bins.items()]
    types = pkg.get("types") if pkg.get("types") is not None else pkg.get("typings")
    lines += [f"{k}: {v}" for k, v in (("main", pkg.get("main")), ("types", types)) if isinstance(v, str)]
    return "\n".join(lines) + "\n" if len(lines) > 1 else None


def entry_chunks(root: str) -> list[tuple[str, str, int, int, str]]:
    """(content, file_path, start_line, end_line, language) of the root package, if it has entry points."""
    try:
        with open(f"{root}/package.json", encoding="utf-8") as f:
            text = package_entry(f.read())
    except OSError:
        return []
    return [(text, "package.json", 1, text.count("\n"), "json")] if text else []
