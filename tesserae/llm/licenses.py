"""License scans by matching template markup.

A template is wording with `<<opt>> ... <<end>>` (may be left out; may nest) and `<<any N>>`
(at most N words of any kind, as for a name). It compiles into an automaton over words; a place in
a text is accepted if the automaton reads from there to its end, so all mandatory wording stands
there, exactly and in order. Of the ways to read from one start the longest counts.

Only words that begin some template start the automaton. No shuffle; texts of any length are scanned
whole. A null text is empty. Every row is judged on its own, so ids may be null or repeated. Only
doc_id and text are read, so other columns may have any name. An empty table stays empty.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import long_id, row_batch
from .license_texts import TEMPLATES
from .text import ALNUM, raw

#: Phrases of the base rule, with their labels. Fixed values.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

_ANY = None


@dataclass(frozen=True)
class Template:
    """An automaton: `steps[s]` maps a word to states, `any_steps[s]` are states that any word leads to."""

    label: str
    steps: tuple[dict[bytes, tuple[int, ...]], ...]
    any_steps: tuple[tuple[int, ...], ...]
    start: frozenset[int]
    final: frozenset[int]

    def read(self, words: Sequence[bytes], at: int) -> int:
        """End of the longest accepted run from `at`, or -1."""
        states, end, i = self.start, -1, at
        while states:
            if states & self.final:
                end = i
            if i == len(words):
                break
            w = words[i]
            states = frozenset(t for s in states for t in (*self.steps[s].get(w, ()), *self.any_steps[s]))
            i += 1
        return end if end > at else -1

    def first_words(self) -> set[bytes]:
        if any(self.any_steps[s] for s in self.start):
            raise ValueError(f"a template of {self.label} may begin with any word")
        return {w for s in self.start for w in self.steps[s]}


def compile_template(markup: str, label: str) -> Template:
    """Reads the markup into epsilon-free states."""
    word: list[dict[str | None, set[int]]] = [{}]
    free: list[set[int]] = [set()]

    def state() -> int:
        word.append({})
        free.append(set())
        return len(word) - 1

    at, opened = 0, []
    parts = [x for p in re.split(r"(<<[^>]*>>)", markup) for x in ([p] if p.startswith("<<") else p.encode().translate(ALNUM).decode().split())]
    for p in parts:
        if p == "<<opt>>":
            opened.append(at)
        elif p == "<<end>>":
            if not opened:
                raise ValueError(f"<<end>> without <<opt>>: {markup}")
            new = state()
            free[at].add(new)
            free[opened.pop()].add(new)
            at = new
        elif p.startswith("<<any "):
            last = state()
            for _ in range(int(p[6:-2])):
                free[at].add(last)
                new = state()
                word[at].setdefault(_ANY, set()).add(new)
                at = new
            free[at].add(last)
            at = last
        elif p.startswith("<<"):
            raise ValueError(f"unknown mark {p}: {markup}")
        else:
            new = state()
            word[at].setdefault(p, set()).add(new)
            at = new
    if opened:
        raise ValueError(f"<<opt>> without <<end>>: {markup}")

    def closure(states) -> tuple[int, ...]:
        seen, todo = set(states), list(states)
        while todo:
            for t in free[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return tuple(sorted(seen))

    steps = tuple({w.encode(): closure(t) for w, t in m.items() if w is not _ANY} for m in word)
    return Template(label, steps, tuple(closure(m.get(_ANY, ())) for m in word), frozenset(closure([0])), frozenset([at]))


def by_first_word(templates: Sequence[tuple[str, str]]) -> dict[bytes, list[Template]]:
    out: dict[bytes, list[Template]] = {}
    for markup, label in templates:
        t = compile_template(markup, label)
        for w in t.first_words():
            out.setdefault(w, []).append(t)
    return out


def places(words: Sequence[bytes], templates: dict[bytes, list[Template]]) -> list[tuple[int, int, str]]:
    """(start, end, label) of every accepted place."""
    return [(i, end, t.label) for i, w in enumerate(words) if w in templates for t in templates[w] if (end := t.read(words, i)) > 0]


def _covered(spans: list[tuple[int, int, str]]) -> int:
    n = at = 0
    for a, b, _ in sorted(spans):
        n += max(0, b - max(a, at))
        at = max(at, b)
    return n


def scan(docs: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES, base: Sequence[tuple[str, str]] = BASE) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans; one row per document.

    score: share of the words inside accepted places. spans: their starts and ends, flat."""
    phrases, marked = by_first_word(base), by_first_word(templates)
    kinds = [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("spans", pa.list_(pa.int64()))]
    schema = pa.schema(kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {n: [] for n, _ in kinds[1:]}
            for text in raw(batch.column(1)):
                words = text.translate(ALNUM).split()
                plain = places(words, phrases)
                spans = plain + places(words, marked)
                out["n_words"].append(len(words))
                out["n_base"].append(len(plain))
                out["first_word"].append(plain[0][0] if plain else None)
                out["last_word"].append(plain[-1][0] if plain else None)
                out["base_labels"].append(",".join(sorted({x[2] for x in plain})))
                out["labels"].append(",".join(sorted({x[2] for x in spans})))
                out["score"].append(_covered(spans) / len(words) if words else 0.0)
                out["spans"].append([y for x in sorted(spans) for y in x[:2]])
            yield row_batch(schema, doc_id=batch.column(0), **out)

    return docs.select(long_id("doc_id"), "text").mapInArrow(run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<long>")
