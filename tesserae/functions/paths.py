"""Languages, path penalties and entry points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import _col, basename

# Languages and their file extensions.
EXTENSION_LANGUAGE = {
    ".py": "python",
    ".pyi": "python",
    ".js": "javascript",
    ".mjs": "javascript",
    ".cjs": "javascript",
    ".jsx": "javascript",
    ".ts": "typescript",
    ".tsx": "typescript",
    ".mts": "typescript",
    ".cts": "typescript",
    ".go": "go",
    ".rs": "rust",
    ".java": "java",
    ".kt": "kotlin",
    ".kts": "kotlin",
    ".c": "c",
    ".h": "cpp",
    ".cpp": "cpp",
    ".cc": "cpp",
    ".cxx": "cpp",
    ".hpp": "cpp",
    ".hh": "cpp",
    ".hxx": "cpp",
    ".h++": "cpp",
    ".cs": "csharp",
    ".rb": "ruby",
    ".php": "php",
    ".swift": "swift",
    ".scala": "scala",
    ".clj": "clojure",
    ".cljs": "clojure",
    ".ex": "elixir",
    ".exs": "elixir",
    ".erl": "erlang",
    ".hs": "haskell",
    ".lua": "lua",
    ".sh": "bash",
    ".bash": "bash",
    ".zsh": "bash",
    ".fish": "fish",
    ".sql": "sql",
    ".r": "r",
    ".R": "r",
    ".dart": "dart",
    ".zig": "zig",
    ".vue": "vue",
    ".svelte": "svelte",
    ".md": "markdown",
    ".mdx": "markdown",
    ".rst": "rst",
    ".txt": "text",
    ".json": "json",
    ".yaml": "yaml",
    ".yml": "yaml",
    ".toml": "toml",
    ".ini": "ini",
    ".cfg": "ini",
    ".xml": "xml",
    ".html": "html",
    ".css": "css",
    ".scss": "scss",
    ".less": "less",
    ".dockerfile": "dockerfile",
}
DOC_EXTENSIONS = {".md", ".mdx", ".rst", ".txt"}
CONFIG_EXTENSIONS = {".json", ".yaml", ".yml", ".toml", ".ini", ".cfg", ".xml"}
NOT_CODE = {"markdown", "rst", "text", "json", "yaml", "toml", "ini", "xml", "html"}
CONTENT_TYPES = ("code", "docs", "config")

# Paths that count less, with their factors.
TEST_FILE = (
    r"(?:^|/)(?:test_[^/]*\.py|[^/]*_test\.py|[^/]*_test\.go|[^/]*Tests?\.java|[^/]*Test\.php|[^/]*_spec\.rb|[^/]*_test\.rb|[^/]*\.test\.[jt]sx?|[^/]*\.spec\.[jt]sx?"
    r"|[^/]*Tests?\.kt|[^/]*Spec\.kt|[^/]*Tests?\.swift|[^/]*Spec\.swift|[^/]*Tests?\.cs|test_[^/]*\.cpp|[^/]*_test\.cpp|test_[^/]*\.c|[^/]*_test\.c|[^/]*Spec\.scala"
    r"|[^/]*Suite\.scala|[^/]*Test\.scala|[^/]*_test\.dart|test_[^/]*\.dart|[^/]*_spec\.lua|[^/]*_test\.lua|test_[^/]*\.lua|test_helpers?[^/]*\.[A-Za-z0-9_]+)"
)
TEST_DIR = r"(?:^|/)(?:tests?|__tests__|spec|testing)(?:/|\z)"
COMPAT_DIR = r"(?:^|/)(?:compat|_compat|legacy)(?:/|\z)"
EXAMPLE_DIR = r"(?:^|/)(?:_?examples?|docs?_src)(?:/|\z)"
REEXPORTS = ("__init__.py", "package-info.java")
STRONG, MODERATE, MILD = 0.3, 0.5, 0.7
INSTALLER = r"(?:^|/)installer(?:/|\z)"
ENTRY_CONTENT = r"#!/usr/bin|(?:^|\n)\s*(?:async\s+)?function\s+main\s*\(|(?:^|\n)\s*if\s*\(\s*require\.main\s*===\s*module"
PACKAGE_ENTRY = "[package entry]"


def extensions(types: list[str]) -> list[str]:
    """File extensions of content types, sorted."""
    held = {"code": {e for e, lang in EXTENSION_LANGUAGE.items() if lang not in NOT_CODE}, "docs": DOC_EXTENSIONS, "config": CONFIG_EXTENSIONS}
    return sorted(set().union(*(held.get(t, set()) for t in types)))


def resolve_content(types: list[str]) -> list[str]:
    return list(CONTENT_TYPES) if "all" in types else [t for t in types if t in CONTENT_TYPES]


def extension(path: Column | str) -> Column:
    """Last extension in lower case; a leading dot starts none."""
    return F.lower(F.regexp_extract(basename(path), r"^.+?(\.[^.]*)\z", 1))


def language(path: Column | str) -> Column:
    known = F.create_map(*[F.lit(x) for kv in EXTENSION_LANGUAGE.items() for x in kv])
    return F.when(F.lower(basename(path)) == "dockerfile", "dockerfile").otherwise(F.element_at(known, extension(path)))


def penalty(path: Column | str) -> Column:
    p = F.regexp_replace(_col(path), r"\\", "/")
    part = lambda cond, factor: F.when(cond, F.lit(factor)).otherwise(F.lit(1.0))
    out = part(p.rlike(TEST_FILE + r"\z") | p.rlike(TEST_DIR), STRONG) * part(basename(p).isin(*REEXPORTS), MODERATE)
    return out * part(p.rlike(COMPAT_DIR), STRONG) * part(p.rlike(EXAMPLE_DIR), STRONG) * part(p.rlike(r"\.d\.ts\z"), MILD)


def is_package_entry(content: Column | str) -> Column:
    return _col(content).startswith(PACKAGE_ENTRY)


def is_entry_point(content: Column | str) -> Column:
    return is_package_entry(content) | _col(content).rlike(ENTRY_CONTENT)


def is_installer(path: Column | str) -> Column:
    return F.regexp_replace(_col(path), r"\\", "/").rlike(INSTALLER)


def file_status(size: Column, text: Column, max_bytes: int = 1_000_000, blank_below: int = 128) -> Column:
    return F.when(size > max_bytes, "too_large").when((size < blank_below) & text.rlike(r"^\s*\z"), "empty").otherwise("valid")
