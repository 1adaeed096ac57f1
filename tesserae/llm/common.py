"""What the operators share: scratch tables in the cluster's shared folder, and Arrow mapping."""

from __future__ import annotations

import contextlib
import contextvars
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Scratch tables by who made them; "" where nobody said.
_made: dict[str, list[str]] = {}
_owner: contextvars.ContextVar[str] = contextvars.ContextVar("owner", default="")


@contextlib.contextmanager
def owned_by(owner: str) -> Iterator[None]:
    """Scratch tables made inside, in this thread, belong to `owner`, for `release`."""
    before = _owner.set(owner)
    try:
        yield
    finally:
        _owner.reset(before)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or for a local master a temporary one."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tesserae-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _made.setdefault(_owner.get(), []).append(path)
    return path


@contextlib.contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A session setting for the queries that run inside."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shuffles_removed(spark: SparkSession) -> contextlib.AbstractContextManager[None]:
    """Shuffle files of queries that run inside go as soon as these end."""
    return setting(spark, _CLEANUP, "true")


#: In a local folder Hadoop starts a `chmod` for each new file and each checksum file beside it, from the executor's JVM.
#: Scratch tables have no such files: Parquet's own page checksums, which any store keeps, are verified instead.
_PLAIN = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true", "parquet.page.write-checksum.enabled": "true"}
_VERIFIED = {"parquet.page.verify-checksum.enabled": "true"}


def write(df: DataFrame, path: str, options: dict[str, str] | None = None) -> None:
    """Writes `df` as Parquet; its shuffle files go as soon as it is written, as nothing reads them again."""
    with shuffles_removed(df.sparkSession):
        df.write.options(**options or {}).parquet(path)


def keep(df: DataFrame, name: str) -> DataFrame:
    """Writes `df` to the shared folder and reads it back: later stages neither repeat it nor depend on its executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    write(df, path, _PLAIN)
    return spark.read.schema(df.schema).options(**_VERIFIED).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    with contextlib.suppress(Exception):
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    for paths in _made.values():
        if path in paths:
            paths.remove(path)


def _file_system(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def list_files(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, none if there is no such folder."""
    files, at = _file_system(spark, path)
    return [f.getPath().getName() for f in files.listStatus(at)] if files.exists(at) else []


def put_text(spark: SparkSession, path: str, text: str) -> None:
    """Writes a small file that is there whole or not at all; one that is there already is an error."""
    files, at = _file_system(spark, path)
    half = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.tmp")
    out = files.create(half)
    out.write(bytearray(text.encode()))
    out.close()
    if not files.rename(half, at):
        raise FileExistsError(path)


def forget(df: DataFrame) -> None:
    """Removes the scratch table that `keep` returned, once all that reads it has run."""
    for f in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        for path in [p for paths in _made.values() for p in paths]:
            if f.split(":", 1)[-1].lstrip("/") == path.split(":", 1)[-1].lstrip("/"):
                remove(df.sparkSession, path)


def release(spark: SparkSession, owner: str = "") -> None:
    """Removes the owner's scratch tables. Results that are not yet written read them: write those first."""
    for path in list(_made.get(owner, ())):
        remove(spark, path)


_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Has the session hand texts to Python some megabytes at a time, unless its configuration says otherwise.

    Rows of texts are large, and by default ten thousand of them travel together: each of a worker's copies
    of a batch, and the JVM's, would be tens of megabytes."""
    if not spark.sparkContext.getConf().contains(_BATCH):
        spark.conf.set(_BATCH, str(BATCH_BYTES))


def long_id(name: str) -> Column:
    return F.col(name).cast("long").alias(name)


def map_arrow(df: DataFrame, f: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """`f` on each Arrow batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield f(batch)

    return df.mapInArrow(run, schema)


def by_first_column(f: Callable[[list[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """`f` on the rows of each value of the first column, by which rows come sorted; one value is held at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for batch in batches:
            s = batch.column(0).to_numpy()
            cuts = np.flatnonzero(np.r_[True, s[1:] != s[:-1]]).tolist() if len(s) else []
            for a, b in zip(cuts, [*cuts[1:], len(s)], strict=True):
                if held and s[a] != at:
                    yield from f(held)
                    held = []
                at = s[a]
                held.append(batch.slice(a, b - a))
        if held:
            yield from f(held)

    return run


def row_batch(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if not isinstance(columns[f.name], pa.Array) else columns[f.name].cast(f.type) for f in schema], schema=schema)
