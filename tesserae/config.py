"""All tunables in one place; library code reads no environment variables."""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass


@dataclass(frozen=True)
class EngineConfig:
    k1: float = 1.5
    b: float = 0.75
    rrf_k: int = 60
    candidate_factor: int = 5
    location_candidate_factor: int = 10
    alpha_symbol: float = 0.3
    alpha_text: float = 0.5
    definition_boost: float = 3.0
    stem_boost: float = 1.0
    coherence_boost: float = 0.2
    embedded_scale: float = 0.5
    embedded_stem_min: int = 4
    exact_stem_boost: float = 0.75
    location_boost: float = 2.5
    package_entry_boost: float = 0.75
    installer_penalty: float = 0.35
    saturation_decay: float = 0.5
    improvements: bool = True
    chunk_chars: int = 1500
    ast_min_chars: int = 50
    ast_max_depth: int = 500
    brace_search_lines: int = 60
    max_file_bytes: int = 1_000_000
    blank_check_bytes: int = 128
    window_chars: int = 1300
    window_overlap: int = 120
    embed_batch: int = 32
    snippet_lines: int = 15
    snippets: bool = True
    float_vectors: bool = False
    max_index_files: int | None = None
    clone_timeout_s: int = 60
    allow_http_git: bool = False
    workspace_root: str | None = None
    cached_indexes: int = 10
    #: Most query vectors that are broadcast at a time.
    query_block: int = 20_000
    #: How backslashes reach an embedding backend: preserve, quad (four of each) or strip (as slashes).
    backslashes: str = "preserve"
    #: Parsers by file extension or language: source -> a tree of nodes with start, end, children, or None.
    parsers: tuple[tuple[str, Callable], ...] = ()


DEFAULT = EngineConfig()
EPOCH = "0.1"


def resolve_alpha(is_symbol: bool, alpha: float | None, config: EngineConfig = DEFAULT) -> float:
    if alpha is None:
        return config.alpha_symbol if is_symbol else config.alpha_text
    if not 0 <= alpha <= 1:
        raise ValueError(f"alpha must be between 0 and 1: {alpha}")
    return float(alpha)


_COMMENT = re.compile(r'''"(?:\\.|[^"\\])*(?:"|\Z)|'(?:\\.|[^'\\])*(?:'|\Z)|//[^\n]*|/\*.*?(?:\*/|\Z)''', re.S)


def strip_comments(text: str) -> str:
    """JSON without line and block comments; what looks like one inside a string stays."""
    return _COMMENT.sub(lambda m: "" if m[0][0] == "/" else m[0], text)


def whole_number(given: Mapping[str, str], names: Sequence[str], fallback: int | None = None, least: int = 1) -> int | None:
    """The first of `names` that `given` (settings by name, such as an environment) has as a number, not below `least`."""
    for name in names:
        try:
            n = float(given.get(name, "").strip() or "nan")
        except ValueError:
            continue
        if math.isfinite(n) and int(n) >= least:
            return int(n)
    return fallback


def first_setting(given: Mapping[str, str], names: Sequence[str], fallback: str) -> str:
    return next((v for n in names if (v := given.get(n, "").strip())), fallback)


def clamp_top_k(top_k: float | None, default: int = 3, most: int = 10) -> int:
    if top_k is None or top_k != top_k or top_k in (float("inf"), float("-inf")) or top_k < 1:
        return default
    return min(int(top_k), most)
