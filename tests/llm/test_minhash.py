import random

import numpy as np
import pytest

from tesserae.llm import minhash
from tesserae.llm.graph import components
from tesserae.llm.text import U64

from . import cases


def shingle_set(text, n):
    words = cases.WORD.findall(cases.lower(text or ""))
    if len(words) < n:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i : i + n]) for i in range(len(words) - n + 1))


def expected(data, n=4, threshold=80):
    sets = [shingle_set(t, n) for _, t, *_ in data]
    parent = list(range(len(data)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i in range(len(data)):
        for j in range(i):
            if sets[i] and sets[j]:
                both = len(sets[i] & sets[j])
                if 100 * both >= threshold * (len(sets[i]) + len(sets[j]) - both):
                    parent[find(i)] = find(j)
    first = {}
    order = lambda d: (d is None, d or 0)
    for i, row in enumerate(data):
        first[find(i)] = min(first.get(find(i), row[0]), row[0], key=order)
    return [(row[0], len(sets[i]), first[find(i)] if sets[i] else row[0], row[0] == (first[find(i)] if sets[i] else row[0])) for i, row in enumerate(data)]


def family(rng, start, n, words=120, edits=(1, 12)):
    """Near copies of one text at many distances, so some link directly, some in chains, some not."""
    base = [f"b{start}x{rng.randrange(10**6)}" for _ in range(words)]
    out = []
    for i in range(n):
        w = list(base)
        for _ in range(rng.randint(*edits)):
            w[rng.randrange(words)] = f"e{rng.randrange(10**7)}"
        out.append((start + i, " ".join(w)))
    return out


@pytest.mark.parametrize("seed", [0, 1])
def test_against_brute_force(spark, seed):
    data = [*cases.rows(seed), (None, "one two three four five six"), (None, "One two three four five six"), (None, "lone words in a row that nobody has"), (3000, "one TWO three  four five six")]
    cases.same(minhash.near_duplicates(cases.frame(spark, data), shingle=4), expected(data))


@pytest.mark.parametrize("seed", [0, 5, 64])
def test_crowded_families(spark, seed):
    rng = random.Random(seed)
    data = family(rng, 0, 60) + family(rng, 1000, 40, words=60) + family(rng, 5000, 30, edits=(0, 2)) + family(rng, 7000, 40, words=12, edits=(0, 3))
    rng.shuffle(data)
    want = expected(data)
    assert len({w[2] for w in want}) > 10
    cases.same(minhash.near_duplicates(cases.frame(spark, data), shingle=4), want)


def templated(n, words=120, slots=10, values=3, seed=1):
    """Form letters: one text, some places filled in one of few ways."""
    rng = random.Random(seed)
    base = [f"t{i}" for i in range(words)]
    at = rng.sample(range(words), slots)
    out = set()
    while len(out) < n:
        w = list(base)
        for p in at:
            w[p] = f"v{p}x{rng.randrange(values)}"
        out.add(" ".join(w))
    return list(enumerate(sorted(out)))


def test_form_letters_meet_in_proportion(spark, monkeypatch):
    """Pairs that are compared in full grow with the family, not with its square, and no link is lost."""
    compared, real = [], minhash._linked

    def count(pairs, shingles, threshold):
        pairs = minhash.keep(pairs, "counted")
        compared[-1] += pairs.count()
        return real(pairs, shingles, threshold)

    monkeypatch.setattr(minhash, "_linked", count)
    for n in (250, 1000):
        data = templated(n)
        compared.append(0)
        got = minhash.near_duplicates(cases.frame(spark, data), shingle=4)
        cases.same(got, expected(data))
    assert compared[1] <= 5 * compared[0] and compared[1] < 60 * 1000


def test_form_letters_that_do_not_link(spark):
    data = templated(300, values=12)
    got = minhash.near_duplicates(cases.frame(spark, data), shingle=4).collect()
    want = expected(data)
    assert sum(w[3] for w in want) > 250
    cases.same(spark.createDataFrame(got), want)


def test_five_word_shingles_table(spark):
    docs = cases.table(spark, "sf0.01", "documents").limit(500)
    data = [(r.doc_id, r.text) for r in docs.collect()]
    cases.same(minhash.near_duplicates(docs), expected(data, n=5))


def test_very_long_texts(spark):
    rng = random.Random(7)
    words = [f"w{rng.randrange(10**6)}" for _ in range(200_000)]
    data = [(1, " ".join(words)), (2, " ".join(words[:190_000])), (3, " ".join(words[::-1])), (4, " ".join(words[100_000:])), (5, "x" * 3_000_000 + " a b c d")]
    cases.same(minhash.near_duplicates(cases.frame(spark, data), shingle=4), expected(data))


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 1 << 63, 3000).astype(U64)
    a, b = np.sort(pool[:2000]), np.sort(pool[500:2500])
    sig = minhash.signatures([a, b], 2000)
    assert abs((sig[0] == sig[1]).mean() - 1500 / 2500) < 0.05


def test_keep_first_takes_one_of_each_group(spark):
    text = " ".join(f"w{i}" for i in range(60))
    data = [(5, text), (3, text.upper()), (3, text.upper()), (9, text + " end"), (7, None), (8, ""), (11, "other words"), (None, "null id"), (None, "another null id")]
    docs = cases.frame(spark, data)
    kept = minhash.keep_first(docs)
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == sorted([(3, text.upper()), (7, None), (8, ""), (11, "other words"), (None, "null id"), (None, "another null id")], key=repr)


def test_components_of_chains_stars_and_rings(spark):
    chain = [(i, i + 1) for i in range(100, 140)]
    star = [(7, x) for x in range(200, 260)]
    ring = [(300 + i, 300 + (i + 1) % 9) for i in range(9)]
    got = {r.node: r.component for r in components(spark.createDataFrame(chain + star + ring + [(1, 1)], "a long, b long")).collect()}
    want = {x: 100 for x in range(100, 141)} | {x: 7 for x in [7, *range(200, 260)]} | {x: 300 for x in range(300, 309)}
    assert got == want


def test_empty(spark):
    assert minhash.near_duplicates(cases.frame(spark, [])).count() == 0
    assert minhash.keep_first(cases.frame(spark, [])).count() == 0
