"""The ten queries `opN_<name>` over whole tables; `oracle_sql` has those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontam, hmm, licenses, linedup, minhash, mixing, quality, substr, urlfilter, warc
from .common import small_batches


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"), shingle=4)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linedup.dedup_lines(_table(spark, sf_dir, "documents"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substr.dedup_substrings(_table(spark, sf_dir, "documents")).drop("spans")


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.filter_urls(_table(spark, sf_dir, "pages"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(_table(spark, sf_dir, "documents"))


def op6_hmm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.score(_table(spark, sf_dir, "documents"))


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    captures = warc.archive(_table(spark, sf_dir, "pages"))
    return captures.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.digest(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_minhash_near_dedup, op2_line_dedup, op3_substring_dedup, op4_url_filters, op5_quality_rules, op6_hmm_scoring, op7_source_mixing, op8_license_scan, op9_warc, op10_benchmark_decontamination)}


def oracle_sql() -> dict[str, str]:
    """None for 1, 5, 6 and 8: components, suffix arrays, models and automata; tests compare those with brute force."""
    return {
        "op2_line_dedup": linedup.ORACLE_SQL,
        "op3_substring_dedup": substr.ORACLE_SQL,
        "op4_url_filters": urlfilter.ORACLE_SQL,
        "op7_source_mixing": mixing.ORACLE_SQL,
        "op9_warc": warc.ORACLE_SQL,
        "op10_benchmark_decontamination": decontam.ORACLE_SQL,
    }
