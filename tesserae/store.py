"""An index on disk: a folder of Parquet tables, with the metadata written last as the mark that it is whole.

Layout: <folder>/v<N>/{chunks,postings,terms,documents,corpus,vectors,files}/ and <folder>/v<N>/meta/.
Postings are ranged and sorted by term, so a query's terms skip most files and row groups; a term
that very many chunks have spans several files.
"""

from __future__ import annotations

import hashlib
import json
import os
import tempfile
import uuid
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import EPOCH

TABLES = ("chunks", "postings", "terms", "documents", "corpus", "vectors", "files")


@dataclass(frozen=True)
class Meta:
    epoch: str
    root_path: str | None
    created: int
    model: str
    dimensions: int
    content: tuple[str, ...]
    storage: str  # int8 or float


def cache_key(source: str) -> str:
    return hashlib.sha256(source.encode()).hexdigest()


def _fs(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _fs(spark, path)
    return fs.exists(at)


def delete(spark: SparkSession, path: str) -> None:
    fs, at = _fs(spark, path)
    fs.delete(at, True)


def versions(spark: SparkSession, folder: str) -> list[int]:
    fs, at = _fs(spark, folder)
    if not fs.exists(at):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(at)]
    return sorted(int(n[1:]) for n in names if n.startswith("v") and n[1:].isdigit())


def missing(spark: SparkSession, folder: str, version: int) -> list[str]:
    """Members that a version lacks; the metadata is the last to come."""
    return [t for t in (*TABLES, "meta") if not exists(spark, f"{folder}/v{version}/{t}/_SUCCESS")]


def newest(spark: SparkSession, folder: str) -> int | None:
    return next((v for v in reversed(versions(spark, folder)) if not missing(spark, folder, v)), None)


def save(spark: SparkSession, folder: str, tables: dict[str, DataFrame], meta: Meta) -> int:
    """Writes a new version; readers of the one before are not disturbed, older ones go."""
    held = versions(spark, folder)
    version = (held[-1] if held else 0) + 1
    for name in TABLES:
        df = tables[name]
        if name == "postings":
            df = df.repartitionByRange("term", "chunk_ord").sortWithinPartitions("term", "chunk_ord")
        df.write.mode("overwrite").parquet(f"{folder}/v{version}/{name}")
    row = asdict(meta) | {"content": list(meta.content)}
    spark.createDataFrame([(json.dumps(row),)], "meta string").coalesce(1).write.mode("overwrite").parquet(f"{folder}/v{version}/meta")
    for old in held[:-1]:
        delete(spark, f"{folder}/v{old}")
    return version


def load(spark: SparkSession, folder: str) -> tuple[dict[str, DataFrame], Meta]:
    version = newest(spark, folder)
    if version is None:
        raise FileNotFoundError(f"no complete index in {folder}")
    at = f"{folder}/v{version}"
    row = json.loads(spark.read.parquet(f"{at}/meta").first().meta)
    return {t: spark.read.parquet(f"{at}/{t}") for t in TABLES}, Meta(**(row | {"content": tuple(row["content"])}))


def matches(meta: Meta, model: str, content: list[str], storage: str, dimensions: int | None = None) -> bool:
    """`dimensions`: what the backend gives, if that is known."""
    return meta.model == model and set(meta.content) == set(content) and meta.storage == storage and dimensions in (None, meta.dimensions)


def present(spark: SparkSession, folder: str, root: str) -> bool:
    """Whether a local root and all files that the stored index lists are still there."""
    if not os.path.isdir(root):
        return False
    files = load(spark, folder)[0]["files"].select("file_path")
    return all(os.path.exists(f"{root}/{r.file_path}") for r in files.toLocalIterator())


def valid(spark: SparkSession, folder: str, model: str, content: list[str], storage: str, dimensions: int | None = None, root: str | None = None) -> bool:
    """Whether a stored index can serve; one of another epoch is deleted.

    `root`: the folder it must be of. Files that changed or went since are no hindrance: an index is
    brought in step when it is opened (`present` tells whether all are there)."""
    if newest(spark, folder) is None:
        return False
    _, meta = load(spark, folder)
    if meta.epoch != EPOCH:
        delete(spark, folder)
        return False
    if root is not None and meta.root_path is not None and (os.path.abspath(meta.root_path) != os.path.abspath(root) or not os.path.isdir(root)):
        return False
    return matches(meta, model, content, storage, dimensions)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder where driver and executors both write: below spark.checkpoint.dir, or for a local master a temporary one."""
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        shared = "file://" + tempfile.mkdtemp(prefix="tesserae-")
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def import_postings(exported: DataFrame) -> DataFrame:
    """The exchange form (term, postings) read back: term, chunk_ord, tf, dl."""
    rows = exported.select("term", F.explode("postings").alias("chunk_ord", "tf"))
    lengths = rows.groupBy("chunk_ord").agg(F.sum("tf").alias("dl"))
    return rows.join(lengths, "chunk_ord").select("term", "chunk_ord", "tf", "dl")


def export_postings(postings: DataFrame) -> DataFrame:
    """term, postings as one map chunk_ord -> tf, and df: the exchange form of an index."""
    return postings.groupBy("term").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("chunk_ord", "tf")))).alias("postings"), F.count("*").alias("df"))
