import random
import re

import numpy as np
import pytest

from tesserae.llm import quality
from tesserae.llm.text import PLAIN, Words

from . import cases


def repeats(words):
    """Longest run from each word that starts elsewhere too."""
    out = []
    for i in range(len(words)):
        best = 0
        for j in range(len(words)):
            k = 0
            while i != j and max(i, j) + k < len(words) and words[i + k] == words[j + k]:
                k += 1
            best = max(best, k)
        out.append(best)
    return out


def expected(doc_id, text):
    text = text or ""
    words = cases.WORD.findall(text)
    n, seen, dup = len(words), set(), 0
    for line in text.split("\n"):
        if cases.WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 3]) for i in range(n - 2)]
    inside = set()
    for i, w in enumerate(windows):
        if windows.count(w) > 1:
            inside |= {i, i + 1, i + 2}
    base = n < 50 or 100 * len(inside) > 50 * n
    runs = repeats(words)
    under = {j for i, k in enumerate(runs) if k >= 8 for j in range(i, i + k)}
    kept = not base and len(under) <= 0.2 * n and (max(runs) <= 0.1 * n or max(runs) < 8)
    return [doc_id, n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(inside), base, kept]


def test_longest_repeats_brute_force():
    rng = random.Random(3)
    for _ in range(60):
        texts = [" ".join(rng.choice("abcd") for _ in range(rng.randint(0, 30))).encode() for _ in range(rng.randint(1, 5))]
        w = Words(texts, PLAIN)
        assert quality.longest_repeats(w.hashes(), w.first).tolist() == [x for t in texts for x in repeats(t.split())]


def test_covered_is_union_of_repeated_runs():
    words = "a b c d e f g h x y a b c d e f g h z".split()
    w = Words([" ".join(words).encode()], PLAIN)
    longest = quality.longest_repeats(w.hashes(), w.first)
    assert longest.max() == 8
    assert quality.covered(longest, w.first, 8).tolist() == [16]
    assert quality.covered(longest, w.first, 9).tolist() == [0]


@pytest.mark.parametrize("source", ["fixture", "table"])
def test_rules_against_brute_force(spark, source):
    if source == "fixture":
        data = [r for r in cases.rows() if r[0] not in (1007, 1008)]
        say = lambda n, k: " ".join(f"{k}{x}" for x in range(n))
        data = [*data, (None, "a b"), (3000, f"{say(30, 'p')} {say(70, 'a')} {say(30, 'p')} {say(70, 'b')}"), (3001, f"{say(9, 'p')} {say(100, 'a')} {say(9, 'p')} {say(100, 'b')}")]
        docs = cases.frame(spark, data)
    else:
        docs = cases.table(spark, "sf0.001", "documents").limit(60)
        data = [(r.doc_id, r.text) for r in docs.collect()]
    got = sorted(([r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept] for r in quality.quality(docs).collect()), key=repr)
    assert got == sorted((expected(*r[:2]) for r in data), key=repr)


def test_verdict_limits_and_filter(spark):
    rng = np.random.default_rng(0)
    clean = " ".join(f"w{x}" for x in rng.integers(0, 10**6, 200))
    passage = " ".join(f"p{x}" for x in range(90))
    twice = f"{passage} x {passage} " + " ".join(f"q{x}" for x in range(60))
    docs = cases.frame(spark, [(1, clean), (2, twice), (3, "short"), (4, None)])
    rows = {r.doc_id: r for r in quality.quality(docs).collect()}
    assert rows[1].kept and not rows[2].kept and not rows[3].kept and not rows[4].kept
    assert rows[2].longest == 90 and rows[2].n_covered == 180
    kept = quality.filter_quality(docs)
    assert kept.columns == docs.columns and [r.doc_id for r in kept.collect()] == [1]


def test_limits_reject_what_the_base_rule_passes(spark):
    say = lambda n, k: " ".join(f"{k}{x}" for x in range(n))
    docs = [
        (1, f"{say(50, 'p')} {say(100, 'a')} {say(50, 'p')} {say(100, 'b')}"),  # a third is one passage and its copy
        (2, " ".join(f"{say(10, 'p')} {say(25, k)}" for k in "abcdefgh")),  # boilerplate, eight times
        (3, f"{say(150, 'a')} {' '.join([say(5, 'p')] * 5)} {say(20, 'b')}"),  # a run that overlaps its copy
        (4, f"{say(9, 'p')} {say(100, 'a')} {say(9, 'p')} {say(100, 'b')}"),  # one line quoted again
        (5, f"{say(6, 'p')} {say(20, 'a')} {say(6, 'p')} {say(20, 'b')}"),  # a phrase below MIN_REPEAT in a short text
        (6, f"{say(20, 'p')} {say(80, 'a')} {say(20, 'p')} {say(80, 'b')}"),  # at both limits
    ]
    rows = {r.doc_id: r for r in quality.quality(cases.frame(spark, docs)).collect()}
    assert not any(r.base_failed for r in rows.values())
    assert {d for d, r in rows.items() if not r.kept} == {1, 2, 3}
    assert rows[2].longest <= quality.MAX_LONGEST * rows[2].n_words and rows[3].n_covered <= quality.MAX_COVERED * rows[3].n_words
    assert sorted(r.doc_id for r in quality.filter_quality(cases.frame(spark, docs)).collect()) == [4, 5, 6]


def test_a_very_long_text(spark):
    rng = np.random.default_rng(1)
    words = [f"w{x}" for x in rng.integers(0, 10**6, 300_000)]
    copied = words + words[1000:101_000]
    rows = {r.doc_id: r for r in quality.quality(cases.frame(spark, [(1, " ".join(words)), (2, " ".join(copied))])).collect()}
    assert rows[1].kept and rows[2].longest == 100_000 and rows[2].n_covered == 200_000 and not rows[2].kept


def test_empty_table(spark):
    assert quality.quality(cases.frame(spark, [])).count() == 0
    assert quality.filter_quality(cases.frame(spark, [])).count() == 0
