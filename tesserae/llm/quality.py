"""Quality rules, the main one on repetition found with a suffix array.

The suffix array is one of words: it sorts the suffixes of each text by prefix doubling, many
texts at a time, and goes on only with suffixes that still share a prefix with another one of
their text. Neighbours in it give, by descent through the doubling ranks, their longest common
prefix. The longest one at a position bounds the maximal repeated run of words (the
longest-common-prefix interval) that starts there, so the union of those spans is what repeats
cover. One array gives both the runs of three words of the base rule and the longer ones of the
verdict.

A null or empty text has no words and fails the base rule. Every row is judged on its own, so
ids may be null or repeated. Texts of any length are judged whole. `quality` reads doc_id and text
only, `filter_quality` carries all columns, whatever their names. Empty tables stay empty.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import long_id, map_arrow, row_batch
from .text import PLAIN, Words, raw, slices

MIN_WORDS = 50
#: Repeats of so many words or more count for the verdict.
MIN_REPEAT = 8
#: Largest share of a text's words under such repeats, and largest share of the longest one. The base
#: rule leaves at most half the words under repeats, so limits near that would reject nothing.
MAX_COVERED = 0.2
MAX_LONGEST = 0.1

_SYMBOLS = b"#*$%&|<>"
_BLANK = bytes([9, 10, 11, 12, 13, 32])


def longest_repeats(words: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each word, the length of the longest run from it that starts elsewhere in its text too.

    `words`: hashes of all words; `first`: where each text begins, and the end."""
    texts = len(first) - 1
    if not len(words):
        return np.zeros(0, np.int64)
    text = np.repeat(np.arange(texts), np.diff(first))
    # Each text ends with a mark that nothing equals, so suffixes differ and no shared run leaves its text.
    place = np.arange(len(words)) + text
    n = len(words) + texts
    _, ids = np.unique(words, return_inverse=True)
    key = np.empty(n, np.int64)
    key[place] = text * (len(words) + 1) + ids + 1
    key[first[1:] + np.arange(texts)] = np.arange(texts) * (len(words) + 1)

    order = np.argsort(key, kind="stable")
    levels, rank = [], np.zeros(n, np.int64)
    todo, todo_key, base, span = order, key[order], np.zeros(n, np.int64), 1
    while True:
        # Rank: where in suffix order the group of equal prefixes begins.
        new = np.empty(len(todo), bool)
        new[0] = True
        new[1:] = (todo_key[1:] != todo_key[:-1]) | (base[1:] != base[:-1])
        heads = np.flatnonzero(new)
        group = np.cumsum(new) - 1
        inside = heads[group] - np.maximum.accumulate(np.where(np.r_[True, base[1:] != base[:-1]], np.arange(len(todo)), 0))[heads[group]]
        rank[todo] = base + inside if levels else heads[group]
        levels.append(rank.copy())
        shared = ~new
        shared[:-1] |= ~new[1:]
        todo = todo[shared]
        if not len(todo):
            break
        base, ahead = rank[todo], rank[todo + span]
        again = np.lexsort((ahead, base))
        todo, base, todo_key = todo[again], base[again], ahead[again]
        span *= 2
    suffixes = np.empty(n, np.int64)
    suffixes[rank] = np.arange(n)

    # Longest common prefix of neighbours, from the longest power of two down.
    at = np.flatnonzero(levels[0][suffixes[1:]] == levels[0][suffixes[:-1]])
    x, y = suffixes[at], suffixes[at + 1]
    a, b = x.copy(), y.copy()
    lcp = np.zeros(len(at), np.int64)
    for level in range(len(levels) - 1, -1, -1):
        same = levels[level][a] == levels[level][b]
        lcp[same] += 1 << level
        a[same] += 1 << level
        b[same] += 1 << level
    longest = np.zeros(n, np.int64)
    longest[x] = lcp
    longest[y] = np.maximum(longest[y], lcp)
    return longest[place]


def covered(longest: np.ndarray, first: np.ndarray, least: int) -> np.ndarray:
    """Words of each text inside the union of its repeated runs of at least `least` words."""
    mark = np.zeros(len(longest) + 1, np.int64)
    at = np.flatnonzero(longest >= least)
    mark[: len(longest)][at] += 1
    np.subtract.at(mark, at + longest[at], 1)
    under = np.concatenate(([0], np.cumsum(np.cumsum(mark)[: len(longest)] > 0)))
    return under[first[1:]] - under[first[:-1]]


def _duplicate_lines(text: bytes) -> int:
    seen, n = set(), 0
    for line in text.split(b"\n"):
        if line in seen:
            n += 1
        elif line.strip(_BLANK):
            seen.add(line)
    return n


COLUMNS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_covered", "longest"]


def measure(texts: list[bytes]) -> dict[str, np.ndarray]:
    """The rules' measures of each text, COLUMNS by name."""
    out: dict[str, list] = {c: [] for c in COLUMNS}
    for a, b in slices(texts):
        part = texts[a:b]
        words = Words(part, PLAIN)
        longest = longest_repeats(words.hashes(), words.first)
        starts = np.flatnonzero((words.data & 0xC0) != 0x80)  # code points
        ends = np.cumsum([len(t) + 1 for t in part])
        points = np.searchsorted(starts, ends) - np.searchsorted(starts, ends - [len(t) + 1 for t in part])
        blanks = np.cumsum(words.data == 32)[ends - 1] - np.concatenate(([0], np.cumsum(words.data == 32)[ends[:-1] - 1]))
        out["n_words"].append(words.counts())
        out["word_chars"].append(points - blanks)
        out["n_symbols"].append([len(t) - len(t.translate(None, _SYMBOLS)) for t in part])
        out["n_dup_lines"].append([_duplicate_lines(t) for t in part])
        out["n_repeat_words"].append(covered(longest, words.first, 3))
        out["n_covered"].append(covered(longest, words.first, MIN_REPEAT))
        out["longest"].append([int(longest[x:y].max()) if y > x else 0 for x, y in zip(words.first[:-1], words.first[1:], strict=True)])
    return {c: np.concatenate(v).astype(np.int64) if v else np.zeros(0, np.int64) for c, v in out.items()}


def verdict(m: dict[str, np.ndarray], max_covered: float = MAX_COVERED, max_longest: float = MAX_LONGEST) -> tuple[np.ndarray, np.ndarray]:
    """base_failed and kept."""
    n = m["n_words"]
    base = (n < MIN_WORDS) | (100 * m["n_repeat_words"] > 50 * n)
    return base, ~base & (m["n_covered"] <= max_covered * n) & ((m["longest"] <= max_longest * n) | (m["longest"] < MIN_REPEAT))


def quality(docs: DataFrame) -> DataFrame:
    """doc_id, the measures, base_failed and kept; one row per document."""
    schema = pa.schema([("doc_id", pa.int64()), *((c, pa.int64()) for c in COLUMNS), ("base_failed", pa.bool_()), ("kept", pa.bool_())])

    def judge(batch: pa.RecordBatch) -> pa.RecordBatch:
        m = measure(raw(batch.column(1)))
        base, kept = verdict(m)
        return row_batch(schema, doc_id=batch.column(0), base_failed=base, kept=kept, **m)

    return map_arrow(docs.select(long_id("doc_id"), "text"), judge, "doc_id long, " + ", ".join(f"{c} long" for c in COLUMNS) + ", base_failed boolean, kept boolean")


def filter_quality(docs: DataFrame) -> DataFrame:
    """The rows of `docs`, all columns, that the rules keep."""

    @F.pandas_udf("boolean")
    def kept(texts):
        import pandas as pd

        return pd.Series(verdict(measure([(t or "").encode() for t in texts]))[1])

    return docs.where(kept("text"))
