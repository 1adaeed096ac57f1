"""From hits to answers: snippets, neighbours, lookups, payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, EngineConfig
from ..functions import text as T


def line_score(line: Column, terms: Column) -> Column:
    low = F.lower(line)
    return F.size(F.filter(terms, lambda t: low.contains(t)))


def anchor_offset(content: Column, terms: Column) -> Column:
    """0-based line that holds most of the terms; the first of equals."""
    scores = F.transform(F.split(content, "\n"), lambda x: line_score(x, terms))
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def snippets(hits: DataFrame, config: EngineConfig = DEFAULT) -> DataFrame:
    """Hits (content, start_line, end_line, match_terms, ...) cut to the lines around the anchor."""
    n = config.snippet_lines
    lines = F.split("content", "\n")
    s = hits.withColumn("anchor", anchor_offset(F.col("content"), F.col("match_terms"))).withColumn("n_lines", F.size(lines))
    s = s.withColumn("from", F.greatest(F.lit(0), F.col("anchor") - n)).withColumn("to", F.least(F.col("n_lines"), F.col("anchor") + n + 1))
    s = s.withColumn("truncated", (F.col("from") > 0) | (F.col("to") < F.col("n_lines")))
    s = s.withColumns({"full_start_line": F.col("start_line"), "full_end_line": F.col("end_line"), "anchor_line": F.col("start_line") + F.col("anchor")})
    s = s.withColumn("content", F.when(F.col("truncated"), F.array_join(F.slice(lines, F.col("from") + 1, F.col("to") - F.col("from")), "\n")).otherwise(F.col("content")))
    s = s.withColumn("end_line", F.when(F.col("truncated"), F.col("full_start_line") + F.col("to") - 1).otherwise(F.col("end_line")))
    return s.withColumn("start_line", F.col("full_start_line") + F.when(F.col("truncated"), F.col("from")).otherwise(0)).drop("anchor", "n_lines", "from", "to")


def resolve(chunks: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (request_id, file_path, line) -> the chunk that holds the line; one that does not merely end there comes first."""
    met = wanted.join(chunks, "file_path").where("line BETWEEN start_line AND end_line")
    first = Window.partitionBy("request_id").orderBy((F.col("line") < F.col("end_line")).desc(), "chunk_ord")
    return met.withColumn("nth", F.row_number().over(first)).where("nth = 1").drop("nth")


def expand(chunks: DataFrame, wanted: DataFrame, before: int = 1, after: int = 1) -> DataFrame:
    """wanted (request_id, file_path, line) -> the chunk there and its neighbours in the file, `offset` from it."""
    anchors = resolve(chunks, wanted).select("request_id", "file_path", F.col("start_line").alias("anchor_start"), F.col("end_line").alias("anchor_end"))
    files = chunks.join(anchors.select("file_path").distinct(), "file_path", "left_semi")
    nth = F.row_number().over(Window.partitionBy("file_path").orderBy("start_line", "chunk_ord"))
    placed = files.withColumn("nth", nth)
    spot = placed.join(anchors, "file_path").where("start_line = anchor_start AND end_line = anchor_end").groupBy("request_id", "file_path").agg(F.min("nth").alias("at"))
    near = placed.join(spot, "file_path").withColumn("offset", F.col("nth") - F.col("at"))
    return near.where(F.col("offset").between(-before, after)).drop("nth", "at")


def _chunk(root: str | None, *more: Column) -> Column:
    path = F.concat(F.lit(root.rstrip("/") + "/"), F.col("file_path")) if root else None
    return F.struct("content", "file_path", "start_line", "end_line", "language", T.location(path if root else "file_path", "start_line", "end_line").alias("location"), *([path.alias("absolute_path")] if root else []), *more)


def expand_payload(expanded: DataFrame, root: str | None = None) -> DataFrame:
    """request_id, json of `expand`'s rows: chunk_count, the chunk at the line as anchor, and all chunks in order."""
    row = F.struct("offset", _chunk(root).alias("chunk"))
    grouped = expanded.groupBy("request_id").agg(F.array_sort(F.collect_list(row)).alias("all"))
    anchor = F.get(F.filter("all", lambda x: x["offset"] == 0), F.lit(0))["chunk"]
    return grouped.select("request_id", F.to_json(F.struct(F.size("all").alias("chunk_count"), anchor.alias("anchor"), F.transform("all", lambda x: x["chunk"]).alias("chunks"))).alias("json"))


def payload(hits: DataFrame, root: str | None = None, snippet: bool = True, config: EngineConfig = DEFAULT) -> DataFrame:
    """query_id, json: the answer to each query, scores relative to its best hit.

    `hits`: query_id, text (the query), match_terms, rank, score and the chunk's columns."""
    s = hits.withColumn("best", F.max("score").over(Window.partitionBy("query_id")))
    s = snippets(s, config) if snippet else s.withColumns({"truncated": F.lit(False), "anchor_line": F.lit(None).cast("int"), "full_start_line": F.lit(None).cast("int"), "full_end_line": F.lit(None).cast("int")})
    cut = lambda c: F.when(F.col("truncated"), F.col(c)).alias(c)
    chunk = _chunk(root, F.when(F.col("truncated"), True).alias("truncated"), cut("anchor_line"), cut("full_start_line"), cut("full_end_line"))
    entry = F.struct("rank", F.struct(chunk.alias("chunk"), T.relevance_percent(F.col("score"), F.col("best")).alias("score")).alias("hit"))
    grouped = s.groupBy("query_id", "text").agg(F.array_sort(F.collect_list(entry)).alias("all"))
    return grouped.select("query_id", F.to_json(F.struct(F.col("text").alias("query"), F.transform("all", lambda x: x["hit"]).alias("results"))).alias("json"))
