"""Keeping an index in step with its files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def changes(stored: DataFrame, listed: DataFrame) -> DataFrame:
    """stored and listed (file_path, mtime_ms) -> file_path, op (new, modified, deleted); unchanged files have no row."""
    both = stored.alias("s").join(listed.alias("l"), F.col("s.file_path") == F.col("l.file_path"), "full")
    op = F.when(F.col("s.file_path").isNull(), "new").when(F.col("l.file_path").isNull(), "deleted").when(~F.col("s.mtime_ms").eqNullSafe(F.col("l.mtime_ms")), "modified")
    return both.select(F.coalesce("l.file_path", "s.file_path").alias("file_path"), op.alias("op")).where("op IS NOT NULL")


def apply_changes(chunks: DataFrame, changed: DataFrame, fresh: DataFrame) -> DataFrame:
    """Drops all chunks of changed paths (file_path) and adds the fresh ones, which get the next numbers.

    Both need a `chunk_ord`; those of `fresh` count from 0."""
    kept = chunks.join(changed.select("file_path").distinct(), "file_path", "left_anti").select(*chunks.columns)
    top = chunks.agg((F.coalesce(F.max("chunk_ord"), F.lit(-1)) + 1).alias("next"))
    added = fresh.crossJoin(F.broadcast(top)).withColumn("chunk_ord", F.col("chunk_ord") + F.col("next")).select(*chunks.columns)
    return kept.unionByName(added)
