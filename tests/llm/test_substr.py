import random

import numpy as np
import pytest

from tesserae.llm import substr

from . import cases


def expected(data, window=13):
    order = lambda d: (d is None, d or 0)
    first = {}
    split = [(d, cases.WORD.findall(t or "")) for d, t, *_ in data]
    for d, words in split:
        for i in range(len(words) - window + 1):
            w = tuple(words[i : i + window])
            first[w] = min(first.get(w, d), d, key=order)
    out = []
    for d, words in split:
        gone = set()
        for i in range(len(words) - window + 1):
            f = first[tuple(words[i : i + window])]
            if order(f) < order(d):
                gone |= set(range(i, i + window))
        out.append((d, len(words), len(gone), cases.sha(" ".join(w for i, w in enumerate(words) if i not in gone))))
    return out


@pytest.mark.parametrize("seed", [0, 1])
def test_against_brute_force(spark, seed):
    data = [*cases.rows(seed), (None, "q " * 40), (2000, "q " * 20), (None, "q " * 40)]
    cases.same(substr.dedup_substrings(cases.frame(spark, data)), expected(data))


def test_a_shard_in_several_passes(spark, monkeypatch):
    monkeypatch.setattr(substr, "PASS_WINDOWS", 50)
    monkeypatch.setattr(substr, "MAX_PARTITIONS", 2)
    data = cases.rows(3)
    got = substr.dedup_substrings(cases.frame(spark, data), shards=5)
    cases.same(got, expected(data))


def test_a_very_long_text(spark):
    rng = random.Random(8)
    long = " ".join(str(rng.randrange(50_000)) for _ in range(300_000))
    data = [(1, long), (2, "x " * 20 + long[1000:400_000]), (3, long[::-1])]
    cases.same(substr.dedup_substrings(cases.frame(spark, data)), expected(data))


def test_small_tasks_and_shards(spark, monkeypatch):
    rng = random.Random(4)
    data = [(rng.randrange(10**12), " ".join(rng.choice("ab") for _ in range(rng.randint(0, 60)))) for _ in range(80)]
    for shards in (1, 7):
        cases.same(substr.dedup_substrings(cases.frame(spark, data).repartition(9), shards=shards), expected(data))


def test_table(spark):
    docs = cases.table(spark, "sf0.01", "documents")
    want = expected([(r.doc_id, r.text) for r in docs.collect()])
    assert sum(w[2] for w in want) > 1000
    cases.same(substr.dedup_substrings(docs), want)


def test_packing():
    rng = np.random.default_rng(0)
    for top in (3, 300, 70_000, 1 << 40):
        ids = np.sort(rng.integers(-top, top, 50))
        h = rng.integers(0, 1 << 63, 50).astype(np.uint64)
        a, b = substr.unpack(substr.pack(h, ids))
        assert (a == h).all() and (b == ids).all()


def test_strip_and_intervals(spark):
    passage = " ".join(f"w{i}" for i in range(60))
    data = [(1, f"a  b {passage}"), (2, f"c {passage} d\ne"), (3, None), (4, " kept  as is ")]
    got = {r.doc_id: r.text for r in substr.strip_substrings(cases.frame(spark, data)).collect()}
    assert got == {1: data[0][1], 2: "c d e", 3: None, 4: data[3][1]}
    spans = {r.doc_id: r.spans for r in substr.dedup_substrings(cases.frame(spark, data)).collect()}
    assert spans == {1: [], 2: [1, 61], 3: [], 4: []}


def test_empty(spark):
    assert substr.dedup_substrings(cases.frame(spark, [])).count() == 0
