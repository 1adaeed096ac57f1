"""From raw documents to a training mix, in five stages.

Each stage gets the documents that the one before it kept, and returns documents with the same
columns; the last returns the mix, one row per repetition with `copy` and `words`. `run` writes
each stage as Parquet to the shared folder and reads it again, so a stage starts from files, not
from the plans before it; its scratch tables go when the next one starts, and its own folder when
the next one is written. The folder that the last stage reads goes with `common.release(spark)`.

1. quality_rules: documents that the rules reject go.
2. line_dedup: lines of ten code points or more that several documents share stay in the one with
   the smallest doc_id. A document that loses all its wording goes.
3. near_dedup: of each group of near-duplicates the smallest doc_id stays.
4. decontamination: documents of which a twentieth or more is inside benchmark windows go.
5. source_mixing: sources are repeated or sampled to their target weights; empty documents are in
   no mix.

Null or empty texts have no words, so the first stage rejects them; called on its own, a later stage
keeps them (line_dedup, near_dedup, decontamination) or leaves them out of the mix (source_mixing).
Null ids are larger than all others. Rows that repeat an id are one document to line_dedup, which
strips the same lines from each; near_dedup keeps one of rows that repeat id and text; the other
stages judge row by row. Ties are settled by the smallest doc_id. Other columns, whatever their
names, are carried along. An empty table gives an empty table. Texts are read whole at any length.
"""

from __future__ import annotations

import contextvars
import functools
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tesserae.llm import decontam, linedup, minhash, mixing, quality
from tesserae.llm.common import new_path, owned_by, release, remove, small_batches


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: The run that this thread is in: its stages share scratch tables, which other runs leave alone.
_run: contextvars.ContextVar[str] = contextvars.ContextVar("run", default="pipeline")


def _after(stage: Stage) -> Stage:
    """A stage whose predecessor is written: the scratch tables of the run so far can go."""

    @functools.wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        small_batches(spark)
        release(spark, _run.get())
        with owned_by(_run.get()):
            return stage(spark, docs, sf_dir)

    return run_stage


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    _run.set(f"pipeline-{uuid.uuid4().hex}")  # results of earlier runs may still be unwritten
    return quality.filter_quality(docs)


@_after
def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return linedup.strip_lines(docs, drop_emptied=True)


@_after
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.keep_first(docs)


@_after
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@_after
def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.sample(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("source_mixing", source_mixing),
]

#: Suffix arrays and near-duplicate groups are not expressible in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of `sf_dir`."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        path = new_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            remove(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
