"""BM25 over a postings table.

Postings are long rows (term, chunk_ord, tf, dl), with the chunk's length in each, so scoring joins
query terms with postings only. Document frequencies are summed once at index time. Corpus size
and mean length are global: filters drop rows but do not change them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, EngineConfig
from ..functions import text as T


#: Query terms up to which they are broadcast, and different ones up to which they are listed in a filter.
MOST_TERMS = 20_000
LISTED_TERMS = 300


def term_counts(chunks: DataFrame, enrich: bool = True) -> DataFrame:
    """chunk_ord, term, tf.

    Texts are dealt by chunk before they are cut, which moves less than their terms would, and spreads inputs of
    few files; counts, lengths and their join are by chunk too, so nothing is dealt again."""
    body = T.enriched("content", "file_path") if enrich else F.col("content")
    parts = int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = chunks.select("chunk_ord", body.alias("body")).repartition(parts, "chunk_ord")
    raw = dealt.select("chunk_ord", F.explode(T.raw_tokens("body")).alias("raw"))
    return raw.select("chunk_ord", F.explode(T.split_identifier("raw")).alias("term")).groupBy("chunk_ord", "term").agg(F.count("*").alias("tf"))


def document_stats(chunks: DataFrame, counts: DataFrame) -> DataFrame:
    """chunk_ord, dl; chunks without tokens have length 0."""
    lengths = counts.groupBy("chunk_ord").agg(F.sum("tf").alias("dl"))
    return chunks.select("chunk_ord").join(lengths, "chunk_ord", "left").select("chunk_ord", F.coalesce("dl", F.lit(0)).cast("long").alias("dl"))


def corpus_stats(documents: DataFrame) -> DataFrame:
    """One row: n, avgdl."""
    return documents.agg(F.count("*").alias("n"), F.coalesce(F.avg("dl"), F.lit(0.0)).alias("avgdl"))


def postings(counts: DataFrame, documents: DataFrame) -> DataFrame:
    return counts.join(documents, "chunk_ord").select("term", "chunk_ord", "tf", "dl")


def term_stats(counts: DataFrame) -> DataFrame:
    return counts.groupBy("term").agg(F.count("*").alias("df"))


def bm25(plans: DataFrame, held: DataFrame, terms: DataFrame, corpus: DataFrame, selector: DataFrame | None = None, config: EngineConfig = DEFAULT) -> DataFrame:
    """query_id, chunk_ord, score > 0, for every chunk that has a term of the query.

    `held`: postings, `terms`: term_stats, `corpus`: corpus_stats; `selector`: chunk_ord allowed.

    The queries' terms are counted first. Up to `MOST_TERMS` of them are sent to the postings, which then stay
    where they are; and up to `LISTED_TERMS` different ones are filters that reach the scan, where stored postings,
    which are sorted by term, skip all other files and row groups. A larger batch meets the postings by a join."""
    pairs = plans.select("query_id", F.explode("terms").alias("term"))
    told = pairs.select("term").limit(MOST_TERMS + 1).collect()
    few = len(told) <= MOST_TERMS
    names = {r.term for r in told}
    if few and len(names) <= LISTED_TERMS:
        held, terms = (df.where(F.col("term").isin(*sorted(names))) for df in (held, terms))
    sent = F.broadcast if few else (lambda df: df)
    asked = terms.join(sent(pairs), "term").join(F.broadcast(corpus))  # one row
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    asked = asked.select("query_id", "term", idf.alias("idf"), F.when(F.col("avgdl") > 0, F.col("avgdl")).otherwise(1.0).alias("avgdl"))
    hits = held.join(sent(asked), "term")
    if selector is not None:
        hits = hits.join(selector, "chunk_ord", "left_semi")
    part = F.col("idf") * (F.col("tf") * (config.k1 + 1)) / (F.col("tf") + config.k1 * (1 - config.b + config.b * F.col("dl") / F.col("avgdl")))
    return hits.groupBy("query_id", "chunk_ord").agg(F.sum(part).alias("score")).where("score > 0")


def top_k(scores: DataFrame, k: str | int, order: str = "score", ascending: bool = False) -> DataFrame:
    """The best k rows of each query with `rank` from 1; ties go to the smaller chunk."""
    by = F.col(order).asc() if ascending else F.col(order).desc()
    ranked = scores.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(by, "chunk_ord")))
    return ranked.where(F.col("rank") <= (F.col(k) if isinstance(k, str) else k))


def selector(chunks: DataFrame, languages: list[str] | None = None, paths: list[str] | None = None) -> DataFrame | None:
    """Chunks of any of the languages or paths; None (all) without filters or if nothing fits."""
    if not languages and not paths:
        return None
    fits = F.lit(False)
    if languages:
        fits |= F.col("language").isin(*languages)
    if paths:
        fits |= F.col("file_path").isin(*paths)
    found = chunks.where(fits).select("chunk_ord")
    return None if found.isEmpty() else found
