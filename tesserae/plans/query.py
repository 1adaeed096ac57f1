"""What a query asks for, worked out before any data is read.

`analyse` is plain Python on one text; `analysed` maps it over a table of queries, so one search
and a large batch run the same plan.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULT, EngineConfig, resolve_alpha
from ..functions.text import STOPWORDS

# Patterns and word lists.
_SYMBOL = re.compile(r"(?:[A-Za-z_][A-Za-z0-9_]*(?:(?:::|\\|->|\.)[A-Za-z_][A-Za-z0-9_]*)+|_[A-Za-z0-9_]*|[A-Za-z][A-Za-z0-9]*[A-Z_][A-Za-z0-9_]*|[A-Z][A-Za-z0-9]*)", re.ASCII)
# Camel case; its first word may be one capital (XHandler), which plurals of abbreviations (IDs, APIs) are told from.
_EMBEDDED = re.compile(r"\b(?:[A-Z][a-z][a-zA-Z0-9]*[A-Z][a-zA-Z0-9]*|[A-Z]{2}[a-z]{2}[a-zA-Z0-9]*|[a-z][a-zA-Z0-9]*[A-Z][a-zA-Z0-9]+)\b", re.ASCII)
_LOCATION = re.compile(r"\b(where(?:'s| is)?|entry\s*point|bootstrap|starts?|live[s]?|located|defined|wiring)\b", re.I | re.ASCII)
_ENTRY = re.compile(r"\b(entry\s*point|bootstrap|starts?|wiring|command\s*line)\b", re.I | re.ASCII)
_INTEGRATION = re.compile(r"\b(install|uninstall|hook|agent|configure|setup)\b", re.I | re.ASCII)
SEPARATORS = ("::", "\\", "->", ".")
DEFINITION_WORDS = ("class", "module", "defmodule", "def", "interface", "struct", "enum", "trait", "type", "func", "function", "object", "abstract class", "data class", "fn", "fun", "package", "namespace", "protocol", "record", "typedef")
SQL_DEFINITION_WORDS = ("CREATE TABLE", "CREATE VIEW", "CREATE PROCEDURE", "CREATE FUNCTION")
HINTS = ("command", "handler", "router", "routing", "middleware", "model", "channel", "request", "response", "dispatch", "pipeline")
GENERIC_STEMS = (
    "route", "routes", "router", "routing", "handler", "middleware", "channel", "model", "models", "request", "response", "utils", "util", "server", "client", "application", "dispatch",
    "core", "lib", "main", "mod", "test", "tests", "schema", "config", "helper", "helpers", "engine", "pipeline", "plug", "plugs", "command", "commands", "index",
)

_WORD = re.compile(r"[a-zA-Z_][a-zA-Z0-9_]*")
_HYPHENATED = re.compile(r"[a-zA-Z_][a-zA-Z0-9_-]*")
_CAMEL = re.compile(r"[A-Z]+(?=[A-Z][a-z])|[A-Z]?[a-z]+|[A-Z]+|[0-9]+")


def split_identifier(token: str) -> list[str]:
    low = token.lower()
    parts = [p for p in low.split("_") if p] if "_" in low else [p.lower() for p in _CAMEL.findall(token)]
    return [low, *parts] if len(parts) >= 2 else [low]


def tokenize(text: str) -> list[str]:
    return [p for t in _WORD.findall(text) for p in split_identifier(t)]


def is_symbol(query: str) -> bool:
    return bool(_SYMBOL.fullmatch(query.strip()))


def symbol_names(query: str) -> list[str]:
    """The last part of a qualified name, and the whole query if it differs."""
    whole = query.strip()
    for sep in SEPARATORS:
        if sep in query:
            last = query.split(sep)[-1].strip()
            return [last] if last == whole else [last, whole]
    return [whole]


def is_location(query: str) -> bool:
    return bool(_LOCATION.search(query))


def is_entry_point(query: str) -> bool:
    return bool(_ENTRY.search(query))


def is_integration(query: str) -> bool:
    return bool(_INTEGRATION.search(query))


def definition_patterns(names: list[str]) -> tuple[str, str]:
    """Regular expressions (one with case, one without) for a definition of any of the names; both engines read them."""
    if not names:
        return "", ""
    escaped = "|".join(re.sub(r"([.*+?^${}()|\[\]\\])", r"\\\1", n) for n in sorted(names, key=len, reverse=True))
    tail = rf")\s+(?:[A-Za-z_][A-Za-z0-9_]*(?:\.|::))*(?:{escaped})(?:\s|[<({{:\[;]|$)"
    words = "|".join(w.replace(" ", r"\s+") for w in DEFINITION_WORDS)
    return rf"(?m)(?:^|\s)(?:{words}{tail}", rf"(?im)(?:^|\s)(?:{'|'.join(SQL_DEFINITION_WORDS)}{tail}"


def match_terms(query: str) -> list[str]:
    """Words that anchor a snippet."""
    found = dict.fromkeys(t for t in tokenize(query) if len(t) >= 3 and t not in STOPWORDS)
    found |= dict.fromkeys(w for x in _HYPHENATED.findall(query) if len(w := x.lower()) >= 3 and w not in STOPWORDS)
    return list(found)


def exact_stem_words(query: str, generic: bool = False) -> list[str]:
    words = dict.fromkeys(w.lower() for w in _HYPHENATED.findall(query) if len(w) > 2)
    return [w for w in words if generic or w not in GENERIC_STEMS]


SCHEMA = (
    "query_id long, text string, top_k int, alpha double, candidates int, terms array<string>, symbol boolean, names array<string>, names_low array<string>, "
    "def_pattern string, sql_pattern string, keywords array<string>, exact_words array<string>, words array<string>, location boolean, entry_point boolean, integration boolean, "
    "hints array<string>, match_terms array<string>"
)


def analyse(query_id: int, text: str | None, top_k: int = 10, alpha: float | None = None, config: EngineConfig = DEFAULT, known_names: Iterable[str] = ()) -> dict:
    if top_k < 1:
        raise ValueError(f"top_k must be at least 1: {top_k}")
    text = text or ""
    symbol = is_symbol(text)
    names = list(dict.fromkeys([*(symbol_names(text) if symbol else _EMBEDDED.findall(text)), *known_names]))
    general, sql = definition_patterns(names)
    where = config.improvements and is_location(text)
    return {
        "query_id": query_id, "text": text, "top_k": top_k, "alpha": resolve_alpha(symbol, alpha, config),
        "candidates": top_k * (config.location_candidate_factor if where else config.candidate_factor),
        "terms": list(dict.fromkeys(tokenize(text))), "symbol": symbol, "names": names, "names_low": [n.lower() for n in names], "def_pattern": general, "sql_pattern": sql,
        "keywords": list(dict.fromkeys(w.lower() for w in _WORD.findall(text) if len(w) > 2 and w.lower() not in STOPWORDS)),
        "exact_words": exact_stem_words(text), "words": list(dict.fromkeys(w.lower() for w in _HYPHENATED.findall(text))),
        "location": is_location(text), "entry_point": is_entry_point(text), "integration": is_integration(text),
        "hints": [h for h in HINTS if h in text.lower()], "match_terms": match_terms(text),
    }


def plans(spark: SparkSession, queries: list[tuple[int, str]], top_k: int = 10, alpha: float | None = None, config: EngineConfig = DEFAULT) -> DataFrame:
    rows = [analyse(i, t, top_k, alpha, config) for i, t in queries if t and t.strip()]
    return spark.createDataFrame(rows, SCHEMA).coalesce(1)  # a list is small: one partition needs no exchange


def analysed(queries: DataFrame, top_k: int = 10, alpha: float | None = None, config: EngineConfig = DEFAULT) -> DataFrame:
    """A table of queries (query_id, text) -> their plans; blank queries have none.

    A column known_names (array) adds symbols that the asker knows to those found in the text.
    """
    known = "known_names" if "known_names" in queries.columns else "CAST(NULL AS ARRAY<STRING>) AS known_names"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            asked = zip(batch["query_id"].tolist(), batch["text"], batch["known_names"], strict=True)
            rows = [analyse(i, t, top_k, alpha, config, () if names is None else names) for i, t, names in asked if t and t.strip()]
            yield pd.DataFrame(rows, columns=[c.strip().split(" ")[0] for c in SCHEMA.split(", ")])

    return queries.selectExpr("cast(query_id as long) query_id", "text", known).mapInPandas(run, SCHEMA)


def alike(queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Queries (query_id, text and, if given, known_names) -> one of each kind, its smallest query_id; and every query's kind.

    Queries of one text and the same known names have one plan but for the number, and what depends on the plan alone
    need be looked for only once a kind. The second table is (query_id, kind)."""
    if "known_names" in queries.columns:
        queries = queries.withColumn("known_names", F.coalesce("known_names", F.array().cast("array<string>")))
    key = [c for c in queries.columns if c != "query_id"]
    kinds = queries.where("text IS NOT NULL").groupBy(*key).agg(F.min("query_id").alias("query_id"))
    return kinds, queries.join(kinds.withColumnRenamed("query_id", "kind"), key).select("query_id", "kind")


def of_members(rows: DataFrame, members: DataFrame) -> DataFrame:
    """Rows of each kind's one query -> the same of every query of the kind (`members`: query_id, kind)."""
    return members.join(rows.withColumnRenamed("query_id", "kind"), "kind").drop("kind")
