"""Cutting files into chunks: at definitions where a language is known, else at lines.

The cutting itself is a scan with a state, so it runs as plain Python over Arrow batches, one
file's text at a time; files spread over tasks. Line chunks also exist as a column expression.
Offsets count code points.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, EngineConfig

Span = tuple[int, int]

_LINE = re.compile(r"[^\r\n]*(?:\r\n|\n|\r)|[^\r\n]+\Z")
_LINE_SQL = r"[^\r\n]*(?:\r\n|\n|\r)|[^\r\n]+\z"
STRUCTURAL = ("python", "go", "typescript", "javascript", "cpp", "c")

# Lines that begin a declaration.
_PY_DECL, _PY_DEF = re.compile(r"(async\s+def|def|class)\b"), re.compile(r"(async\s+def|def)\b")
_CPP_TYPE = r"(?:template\s*<[^>]*>\s*)?(?:class|struct|namespace|enum(?:\s+class)?)\b"
_DECL = {
    "go": r"\s*(func\b|type\b.*\b(struct|interface)\b)",
    "cpp": rf"\s*(?:{_CPP_TYPE}|(?!(?:if|for|while|switch|catch|return|sizeof|static_assert|else|do)\b)(?:[\w:~<>,*&]+\s+)+\w+\s*\([^;{{}}]*\)\s*(?:const)?\s*(?:override)?(?:\s*=\s*0)?)",
    "c": r"^\s*(?:struct|enum|union|typedef)\b|(?!(?:if|for|while|switch|return|sizeof|else|do)\b)(?:[\w:*\s]+\s+)+\w+\s*\([^;{}]*\)",
    "script": r"\s*(export\s+)?(async\s+function\b|function\b|class\b|interface\b|type\b|(?:const|let|var)\s+[A-Za-z_$][\w$]*\s*=\s*(?:async\s*)?(?:\([^)]*\)|[A-Za-z_$][\w$]*)(?:\s*:\s*[^=]+)?\s*=>)",
}
_DECLARES = {k: (re.compile(v, re.ASCII).search if k == "c" else re.compile(v, re.ASCII).match) for k, v in _DECL.items()}
_TYPES = {"cpp": re.compile(rf"\s*(?:{_CPP_TYPE})", re.ASCII), "c": re.compile(r"\s*(?:struct|enum|union)\b", re.ASCII)}


def lines_of(source: str) -> list[tuple[int, int, str]]:
    """(start, end, text without its break) of each line; breaks belong to their line."""
    return [(m.start(), m.end(), m.group().rstrip("\r\n")) for m in _LINE.finditer(source)]


def pack(spans: list[Span], target: int) -> list[Span]:
    """Joins neighbours while their own lengths sum to the target at most; gaps inside are swallowed, not counted."""
    out: list[Span] = []
    start = end = size = 0
    for a, b in spans:
        if out and size + (b - a) <= target:
            end, size = b, size + (b - a)
            out[-1] = (start, end)
        else:
            start, end, size = a, b, b - a
            out.append((start, end))
    return out


def line_spans(source: str, target: int) -> list[Span]:
    return pack([(a, b) for a, b, _ in lines_of(source)], target)


def _indent(text: str) -> int:
    return len(text) - len(text.lstrip(" \t"))


def _block_end(texts: list[str], at: int, indent: int) -> int:
    """Last line before the next one that is not deeper; blank lines and comments do not end a block."""
    for j in range(at + 1, len(texts)):
        body = texts[j].strip()
        if body and not body.startswith("#") and _indent(texts[j]) <= indent:
            return j - 1
    return len(texts) - 1


def _python_units(lines: list[tuple[int, int, str]]) -> list[Span]:
    texts = [x[2] for x in lines]
    span = lambda i, j: (lines[i][0], lines[j][1])
    units: list[Span] = []
    heads = [i for i, t in enumerate(texts) if _PY_DECL.match(t.strip())]
    for i in heads:
        indent, end = _indent(texts[i]), _block_end(texts, i, _indent(texts[i]))
        if texts[i].strip().startswith("class "):
            methods = [j for j in range(i + 1, end + 1) if _PY_DEF.match(texts[j].strip()) and _indent(texts[j]) > indent]
            ends = [_block_end(texts, j, _indent(texts[j])) for j in methods]
            # The class's own lines go with its first method.
            units += [span(i, ends[0])] + [span(a, b) for a, b in zip(methods[1:], ends[1:], strict=True)] if methods else [span(i, end)]
        elif indent == 0:
            first = i
            while first and texts[first - 1].strip().startswith("@"):
                first -= 1
            units.append(span(first, end))
    if heads and lines[heads[0]][0] > 0:
        units.append((0, lines[heads[0]][0]))
    return units


def _close(source: str, at: int) -> int:
    """Where the brace that opens at `at` is closed, or -1."""
    depth = 0
    for m in re.compile("[{}]").finditer(source, at):
        depth += 1 if m.group() == "{" else -1
        if depth == 0:
            return m.end()
    return -1


def _brace_units(source: str, lines: list[tuple[int, int, str]], language: str, reach: int) -> list[Span]:
    declares, types = _DECLARES.get(language, _DECLARES["script"]), _TYPES.get(language)
    heads = [i for i, (_, _, t) in enumerate(lines) if declares(t) and (types is None or _indent(t) == 0 or types.match(t))]
    units: list[Span] = []
    for i in heads:
        start = lines[i][0]
        limit = lines[i + reach][1] if i + reach < len(lines) else len(source)
        opened = source.find("{", start, limit)
        end = _close(source, opened) if opened >= 0 else -1
        if end > start:
            end = re.compile(r"[; \t]*\n?").match(source, end).end()
            units.append((start, end))
    if heads and lines[heads[0]][0] > 0:
        units.append((0, lines[heads[0]][0]))
    return units


def structural_spans(source: str, language: str | None, target: int, reach: int = 60) -> list[Span] | None:
    """Spans at declarations, or None where the language or the text has none."""
    if language not in STRUCTURAL:
        return None
    lines = lines_of(source)
    units = _python_units(lines) if language == "python" else _brace_units(source, lines, language, reach)
    return pack(sorted(set(units)), target) if units else ([] if not lines else None)


def tree_spans(node, target: int, config: EngineConfig = DEFAULT) -> list[Span]:
    """Spans of a syntax tree, any whose nodes have start, end and children; deep or small nodes are not opened."""

    def cut(n, depth: int) -> list[Span]:
        kids = list(n.children)
        if not kids or n.end - n.start < config.ast_min_chars or depth > config.ast_max_depth:
            return [(n.start, n.end)]
        out: list[Span] = []
        start = end = None
        size = 0
        for k in kids:
            length = k.end - k.start
            if length > target:
                if start is not None:
                    out.append((start, end))
                    start, size = None, 0
                out += cut(k, depth + 1)
            elif start is not None and size + length > target:
                out.append((start, end))
                start, end, size = k.start, k.end, length
            else:
                start, end, size = k.start if start is None else start, k.end, size + length
        return out + ([(start, end)] if start is not None else [])

    return pack(cut(node, 0), target)


def parser_for(path: str | None, language: str | None, config: EngineConfig = DEFAULT) -> Callable | None:
    """The registered parser of a file: by its extension, as for dialects, else by its language."""
    known = dict(config.parsers)
    extension = "." + path.rsplit(".", 1)[-1].lower() if path and "." in path else None
    return known.get(extension) or known.get(language)


def chunk_spans(source: str, language: str | None, config: EngineConfig = DEFAULT, path: str | None = None) -> list[Span]:
    """Spans by syntax tree where a parser is registered and succeeds, else at declarations, else by lines."""
    if not source.strip():
        return []
    if parse := parser_for(path, language, config):
        try:
            tree = parse(source)
        except Exception:  # a parser that fails on a text leaves it to the other ways
            tree = None
        if tree is not None and (spans := tree_spans(tree, config.chunk_chars, config)):
            return sorted(set(spans))
    found = structural_spans(source, language, config.chunk_chars, config.brace_search_lines)
    return line_spans(source, config.chunk_chars) if found is None else found


def chunk_files(files: DataFrame, config: EngineConfig = DEFAULT) -> DataFrame:
    """files (file_seq, file_path, language, content) -> content, file_path, start_line, end_line, language, file_seq, span_start."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for seq, path, lang, text in zip(batch["file_seq"], batch["file_path"], batch["language"], batch["content"], strict=True):
                lang, text = (lang if isinstance(lang, str) else None), text or ""
                for a, b in chunk_spans(text, lang, config, path):
                    rows.append((text[a:b], path, text.count("\n", 0, a) + 1, text.count("\n", 0, max(a, b - 1)) + 1, lang, seq, a))
            yield pd.DataFrame(rows, columns=["content", "file_path", "start_line", "end_line", "language", "file_seq", "span_start"])

    schema = "content string, file_path string, start_line int, end_line int, language string, file_seq long, span_start int"
    return files.select("file_seq", "file_path", "language", "content").mapInPandas(run, schema)


def line_spans_column(source: Column | str, target: int) -> Column:
    """`line_spans` as a column: array of (start, end); a fold over the lines' lengths."""
    s = F.col(source) if isinstance(source, str) else source
    sizes = F.transform(F.regexp_extract_all(s, F.lit(_LINE_SQL), F.lit(0)), F.length)
    kind = "struct<spans:array<struct<start:int,end:int>>,size:int,at:int>"
    none = F.struct(F.array().cast("array<struct<start:int,end:int>>").alias("spans"), F.lit(0).alias("size"), F.lit(0).alias("at")).cast(kind)

    def step(acc: Column, n: Column) -> Column:
        last = F.element_at(acc["spans"], -1)
        fresh = F.struct(acc["at"].alias("start"), (acc["at"] + n).alias("end"))
        grow = (F.size(acc["spans"]) > 0) & (acc["size"] + n <= target)
        grown = F.concat(F.slice(acc["spans"], F.lit(1), F.size(acc["spans"]) - 1), F.array(F.struct(last["start"].alias("start"), (acc["at"] + n).alias("end"))))
        spans = F.when(grow, grown).otherwise(F.concat(acc["spans"], F.array(fresh)))
        return F.struct(spans.alias("spans"), F.when(grow, acc["size"] + n).otherwise(n).alias("size"), (acc["at"] + n).alias("at")).cast(kind)

    return F.aggregate(sizes, none, step)["spans"]
