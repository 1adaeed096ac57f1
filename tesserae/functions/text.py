"""Identifiers, tokens, paths and lines as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
TOKEN = r"[a-zA-Z_][a-zA-Z0-9_]*"
CAMEL = r"[A-Z]+(?=[A-Z][a-z])|[A-Z]?[a-z]+|[A-Z]+|[0-9]+"
STOPWORDS = "a an and are as at be by do does for from has have how if in is it not of on or the to was what when where which who why with".split()


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def raw_tokens(text: Column | str) -> Column:
    return F.regexp_extract_all(_col(text), F.lit(TOKEN), F.lit(0))


def split_identifier(token: Column | str) -> Column:
    """[lower-cased token, its parts...], parts only where there are two or more."""
    t = _col(token)
    low = F.lower(t)
    snake = F.filter(F.split(low, "_"), lambda x: x != "")
    camel = F.transform(F.regexp_extract_all(t, F.lit(CAMEL), F.lit(0)), F.lower)
    parts = F.when(t.contains("_"), snake).otherwise(camel)
    plain = t.rlike(r"^[A-Z]?[a-z]+\z")  # most words: nothing to split, no list is built
    return F.when(plain, F.array(low)).otherwise(F.when(F.size(parts) >= 2, F.concat(F.array(low), parts)).otherwise(F.array(low)))


def tokens(text: Column | str) -> Column:
    return F.flatten(F.transform(raw_tokens(text), split_identifier))


def basename(path: Column | str) -> Column:
    return F.element_at(F.split(_col(path), "/"), -1)


def stem(path: Column | str) -> Column:
    return F.regexp_replace(basename(path), r"(?<=.)\.[^.]+\z|^\.[^.]+\z", "")


def parent(path: Column | str) -> Column:
    """Name of the folder that holds the file; empty at the top."""
    parts = F.split(_col(path), "/")
    return F.when(F.size(parts) >= 2, F.element_at(parts, -2)).otherwise("")


def last_dirs(path: Column | str, n: int = 3) -> Column:
    parts = F.split(_col(path), "/")
    dirs = F.filter(F.slice(parts, 1, F.size(parts) - 1), lambda x: ~x.isin("", ".", ".."))
    return F.slice(dirs, F.greatest(F.lit(1), F.size(dirs) - (n - 1)), n)


def enriched(content: Column | str, path: Column | str) -> Column:
    """What lexical search indexes: content, the stem twice, and the last three folders."""
    return F.concat_ws(" ", _col(content), stem(path), stem(path), F.array_join(last_dirs(path), " "))


def count_newlines(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))


def line_range(source: Column | str, start: Column, end: Column) -> tuple[Column, Column]:
    """1-based first and last line of the half-open span [start, end)."""
    s = _col(source)
    return count_newlines(F.substring(s, F.lit(1), start)) + 1, count_newlines(F.substring(s, F.lit(1), end - 1)) + 1


def estimate_tokens(text: Column | str) -> Column:
    return F.floor(F.length(_col(text)) / 4)


def location(path: Column | str, start: Column | str, end: Column | str) -> Column:
    return F.concat(_col(path), F.lit(":"), _col(start).cast("string"), F.lit("-"), _col(end).cast("string"))


def chunk_key(path: Column | str, start: Column | str, end: Column | str) -> Column:
    return F.concat_ws(":", _col(path), _col(start).cast("string"), _col(end).cast("string"))


def relevance_percent(score: Column, best: Column) -> Column:
    return F.when(best <= 0, "0%").otherwise(F.concat(F.floor(score / best * 100 + 0.5).cast("string"), F.lit("%")))
