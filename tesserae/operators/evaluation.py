"""Retrieval quality: hits against relevance judgements."""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator, Sequence

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def path_matches(a: Column, b: Column) -> Column:
    slash = lambda c: F.replace(c, F.lit("\\"), F.lit("/"))
    x, y = slash(a), slash(b)
    return (x == y) | F.endswith(x, F.concat(F.lit("/"), y)) | F.endswith(y, F.concat(F.lit("/"), x))


def overlaps(start: Column, end: Column, target_start: Column, target_end: Column) -> Column:
    return target_start.isNull() | target_end.isNull() | ~((end < target_start) | (start > target_end))


def target_ranks(hits: DataFrame, targets: DataFrame) -> DataFrame:
    """hits (query_id, rank, file_path, start_line, end_line), targets (query_id, target_id, path, start_line, end_line): each target's first rank.

    Paths that match end in the same name, so hits and targets meet by query and name."""
    name = lambda c: F.element_at(F.split(F.replace(c, F.lit("\\"), F.lit("/")), "/"), -1)
    h, t = hits.withColumn("name", name(F.col("file_path"))).alias("h"), targets.withColumn("name", name(F.col("path"))).alias("t")
    met = (F.col("h.query_id") == F.col("t.query_id")) & (F.col("h.name") == F.col("t.name"))
    met &= path_matches(F.col("h.file_path"), F.col("t.path")) & overlaps(F.col("h.start_line"), F.col("h.end_line"), F.col("t.start_line"), F.col("t.end_line"))
    return t.join(h, met, "left").groupBy("t.query_id", "t.target_id").agg(F.min("h.rank").alias("rank"))


def ndcg(ranks: DataFrame, k: int) -> DataFrame:
    """ranks (query_id, target_id, rank or null) -> query_id, ndcg: each rank counts once, the ideal has min(k, targets) hits."""
    n = ranks.groupBy("query_id").agg(F.count("*").alias("n"))
    gain = ranks.where(F.col("rank") <= k).select("query_id", "rank").distinct().groupBy("query_id").agg(F.sum(1 / F.log2(F.col("rank") + 1)).alias("dcg"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.lit(k), F.col("n")).cast("int")), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1.0))
    return n.join(gain, "query_id", "left").select("query_id", (F.coalesce("dcg", F.lit(0.0)) / ideal).alias("ndcg"))


def hit_metrics(ranks: DataFrame, k: int) -> DataFrame:
    """query_id, recall, hit, reciprocal_rank, found at k."""
    inside = F.col("rank") <= k
    return ranks.groupBy("query_id").agg(
        (F.count_if(inside) / F.count("*")).alias("recall"),
        F.max(F.coalesce(inside, F.lit(False)).cast("int")).alias("hit"),
        F.coalesce(1 / F.min(F.when(inside, F.col("rank"))), F.lit(0.0)).alias("reciprocal_rank"),
        F.count_if(inside).alias("found"),
    )


def percentiles(values: DataFrame, column: str, by: list[str] | None = None) -> DataFrame:
    """Exact p50 and p90 with linear interpolation."""
    return values.groupBy(*(by or [])).agg(F.percentile(column, F.lit(0.5)).alias("p50"), F.percentile(column, F.lit(0.9)).alias("p90"), F.count("*").alias("n"))


def winner(recall_a: Column, rank_a: Column, recall_b: Column, rank_b: Column) -> Column:
    """Which of two engines did better on a query: found at all, then first rank."""
    return F.when(recall_a & ~recall_b, "a").when(~recall_a & recall_b, "b").when(~recall_a & ~recall_b, "none").when(rank_a < rank_b, "a").when(rank_b < rank_a, "b").otherwise("tie")


def category(query: Column) -> Column:
    low = F.lower(query)
    return F.when(~F.trim(query).contains(" "), "symbol").when(low.startswith("how "), "architecture").otherwise("semantic")


def quality(hits: DataFrame, specs: DataFrame) -> DataFrame:
    """query_id, false_positive, content_match.

    hits: query_id, file_path, content; specs: query_id, reject (paths that must not come), needle (text that some
    hit must hold, or null: any will do)."""
    met = specs.join(hits, "query_id", "left")
    bad = F.coalesce(F.array_contains("reject", F.col("file_path")), F.lit(False))
    holds = F.col("needle").isNull() | F.coalesce(F.contains("content", "needle"), F.lit(False))
    return met.groupBy("query_id").agg(F.max(bad).alias("false_positive"), F.max(holds).alias("content_match"))


def summary(metrics: DataFrame, by: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Means of metrics over groups (by repository, language or category; none: over all), with `n`."""
    return metrics.groupBy(*by).agg(F.count("*").alias("n"), *[F.avg(F.col(c).cast("double")).alias(c) for c in columns])


def wins(pairs: DataFrame, a: str, b: str, by: Sequence[str] = (), margin: float = 0.0005) -> DataFrame:
    """How often each of two metrics is ahead by more than the margin: a_wins, b_wins, ties."""
    ahead, behind = F.col(a) > F.col(b) + margin, F.col(b) > F.col(a) + margin
    return pairs.groupBy(*by).agg(F.count_if(ahead).alias("a_wins"), F.count_if(behind).alias("b_wins"), F.count_if(~ahead & ~behind).alias("ties"))


def span_overlap(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """file_path, overlap: the mean over a file's expected spans (file_path, start, end) of the best overlap ratio with an actual one."""
    e, a = expected.alias("e"), actual.alias("a")
    shared = F.greatest(F.lit(0), F.least("e.end", "a.end") - F.greatest("e.start", "a.start"))
    union = F.greatest("e.end", "a.end") - F.least("e.start", "a.start")
    ratio = F.coalesce(F.when(F.col("a.file_path").isNotNull() & (union > 0), shared / union), F.lit(0.0))
    best = e.join(a, F.col("e.file_path") == F.col("a.file_path"), "left").groupBy("e.file_path", "e.start", "e.end").agg(F.max(ratio).alias("best"))
    return best.groupBy("file_path").agg(F.avg("best").alias("overlap"))


def keywords(query: Column, most: int = 6) -> Column:
    """The longest words of a query that are not stop words, the first of equals first."""
    words = F.transform(F.regexp_extract_all(query, F.lit("[a-zA-Z_][a-zA-Z0-9_-]*"), F.lit(0)), F.lower)
    words = F.array_distinct(F.filter(words, lambda w: (F.length(w) >= 3) & ~w.isin(*T.STOPWORDS)))
    placed = F.transform(words, lambda w, i: F.struct((-F.length(w)).alias("size"), i.alias("at"), w.alias("word")))
    return F.slice(F.transform(F.array_sort(placed), lambda x: x["word"]), 1, most)


def _grep_counts(chunks: DataFrame, asked: list[tuple[int, list[str]]]) -> DataFrame:
    """query_id, file_path, m: matches in each chunk of any of a query's keywords. Texts are searched once for all keywords."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        wanted: dict[str, list[int]] = {}
        for k, (_, words) in enumerate(asked):
            for w in words:
                wanted.setdefault(w, []).append(k)
        trie = ahocorasick.Automaton()
        for w in wanted:
            trie.add_word(w, w)
        trie.make_automaton()
        patterns = [re.compile("|".join(map(re.escape, words)), re.I | re.ASCII) for _, words in asked]
        for batch in batches:
            rows = []
            for path, text in zip(batch["file_path"], batch["content"].fillna(""), strict=True):
                found = {w for _, w in trie.iter(text.lower())}
                for k in {k for w in found for k in wanted[w]}:
                    if n := len(patterns[k].findall(text)):
                        rows.append((asked[k][0], path, n))
            yield pd.DataFrame(rows, columns=["query_id", "file_path", "m"])

    return chunks.select("file_path", "content").mapInPandas(scan, "query_id long, file_path string, m long")


def grep_rank(chunks: DataFrame, queries: DataFrame, top_k: int = 10, block: int = 1000) -> DataFrame:
    """Keyword-search baseline: chunks (file_path, content), queries (query_id, text) -> query_id, rank, file_path, matches, words.

    Any of a query's keywords counts, without case; files rank by matches, then by path. Queries are sent
    out `block` at a time, and only what matches leaves the scan of the texts."""
    asked = queries.select(F.col("query_id").cast("long").alias("query_id"), keywords(F.col("text")).alias("words")).where(F.size("words") > 0)
    held, parts = [], []
    for r in asked.toLocalIterator():
        held.append((r.query_id, list(r.words)))
        if len(held) == block:
            parts.append(_grep_counts(chunks, held))
            held = []
    counted = functools.reduce(DataFrame.unionByName, [*parts, _grep_counts(chunks, held)] if held or not parts else parts)
    files = counted.groupBy("query_id", "file_path").agg(F.sum("m").alias("matches"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("matches"), "file_path"))
    return files.withColumn("rank", rank).where(F.col("rank") <= top_k).join(asked, "query_id").select("query_id", "rank", "file_path", "matches", "words")


def grep_output(chunks: DataFrame, ranked: DataFrame, context: int = 2, lines: int = 3) -> DataFrame:
    """`ranked` (of `grep_rank`) with `output`, the first `lines` matching lines of each file with `context` lines around
    them, numbered, and `tokens`, what that costs to read. chunks: file_path, start_line, content."""
    pattern = F.concat(F.lit("(?i)"), F.array_join(F.transform("words", lambda w: F.replace(w, F.lit("-"), F.lit("\\-"))), "|"))
    files = chunks.join(ranked.select("file_path").distinct(), "file_path", "left_semi")
    texts = files.select("file_path", "start_line", F.posexplode(F.split("content", "\n")).alias("i", "line"))
    texts = texts.groupBy("file_path", (F.col("start_line") + F.col("i")).alias("n")).agg(F.max("line").alias("line"))
    found = texts.join(ranked.select("query_id", "file_path", pattern.alias("pattern")), "file_path").withColumn("hit", F.regexp_like("line", F.col("pattern")))
    in_file = Window.partitionBy("query_id", "file_path").orderBy("n")
    found = found.withColumn("kept", F.col("hit") & (F.count_if("hit").over(in_file) <= lines))
    shown = found.withColumn("near", F.max("kept").over(in_file.rangeBetween(-context, context))).where("near")
    gap = F.lag("n").over(in_file) < F.col("n") - 1
    shown = shown.withColumn("row", F.concat(F.when(gap, "--\n").otherwise(""), F.col("n").cast("string"), F.when(F.col("kept"), ":").otherwise("-"), F.col("line")))
    output = shown.groupBy("query_id", "file_path").agg(F.array_sort(F.collect_list(F.struct("n", "row"))).alias("rows"))
    output = output.select("query_id", "file_path", F.array_join(F.transform("rows", lambda r: r["row"]), "\n").alias("output"))
    return ranked.join(output, ["query_id", "file_path"], "left").withColumn("tokens", T.estimate_tokens("output"))
