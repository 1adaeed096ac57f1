import random

import pytest

from tesserae.llm import mixing
from tesserae.llm.queries import oracle_sql, queries

from . import cases


def water_fill(sizes, cap=3):
    """The rule as worded: share by weight, stop those above, share the excess again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        left = total - sum(fixed.values())
        free = [s for s in names if s not in fixed]
        w = sum(weights[s] for s in free)
        target = {s: left * weights[s] / w for s in free}
        over = [s for s in free if target[s] > cap * sizes[s]]
        if not over:
            return fixed | target
        fixed |= {s: cap * sizes[s] for s in over}


def check(rows, docs):
    sizes = {}
    for _, text, source, *_ in docs:
        sizes[source] = sizes.get(source, 0) + len(cases.WORD.findall(text or ""))
    targets = water_fill(sizes)
    assert sum(targets.values()) == pytest.approx(sum(sizes.values()))
    by = {}
    source_of = {}
    for d in docs:
        source_of.setdefault(d[0], d[2])
    for r in rows:
        s = source_of[r.doc_id]
        assert r.source_size == sizes[s] and r.target == pytest.approx(targets[s]) and 0 <= r.taken <= 3 * r.size
        by[s] = by.get(s, 0) + r.taken
    for s, t in targets.items():
        assert abs(by[s] - t) <= 1


def test_fixture(spark):
    data = cases.rows()
    frame = cases.frame(spark, data)
    rows = mixing.mix(frame).collect()
    check(rows, data)
    assert sorted(rows) == sorted(mixing.mix(frame.repartition(7)).collect())


def test_capped_sources_and_nulls(spark):
    rng = random.Random(1)
    data = [(i, "w " * rng.randint(0, 20), rng.choice(["big"] * 20 + ["b", "c", None])) for i in range(300)] + [(900, None, "none"), (901, "", "none")]
    check(mixing.mix(cases.frame(spark, data)).collect(), data)


def test_sample_rows_match_taken(spark):
    data = [r for r in cases.rows() if r[0] != 1000]
    data = list({r[0]: r for r in data}.values())
    frame = cases.frame(spark, data)
    taken = {r.doc_id: r.taken for r in mixing.mix(frame).collect()}
    got = {}
    texts = {r[0]: r[1] for r in data}
    for r in mixing.sample(frame).collect():
        n = len(cases.WORD.findall(r.text))
        assert n == r.words and (r.text == texts[r.doc_id] or n < len(cases.WORD.findall(texts[r.doc_id])))
        got[r.doc_id] = got.get(r.doc_id, 0) + n
    assert got == {k: v for k, v in taken.items() if v}


def test_sample_keeps_n_chars_in_step(spark):
    data = [(i, f"word {i} " * 50, "ab"[i % 7 == 0]) for i in range(60)] + [(99, "long " * 200_000, "a"), (None, "null id", "b")]
    got = mixing.sample(cases.frame(spark, data)).collect()
    assert any(len(cases.WORD.findall(r.text)) < {i: 100, 99: 200_000}.get(r.doc_id, 100) for i, r in enumerate(got) if r.doc_id is not None)
    assert all(r.n_chars == len(r.text) for r in got)


def test_a_rest_that_rounds_up_to_a_whole_source(spark):
    """Targets a hair below a multiple of the size take all of it."""
    sized = spark.createDataFrame([("a", 3, "0a"), ("a", 4, "fb")], "source string, size long, key string")
    shares = mixing._shares(sized, (1.0,), 3).first()
    assert shares.target == 7 and shares.whole == 1 and shares.rest == 0
    full = spark.createDataFrame([("a", 3, "0a", 0, 7, None, None, None)], "source string, size long, key string, whole long, rest long, cut_key string, cut_left long, cut_size long")
    assert full.select(mixing._taken().alias("t")).first().t == 3


def test_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM read_parquet('/root/testdata/sf0.01/documents.parquet')")
    want = con.execute("SELECT doc_id, size, source_size, target, taken FROM (" + oracle_sql()["op7_source_mixing"] + ")").fetchall()
    got = queries()["op7_source_mixing"](spark, "/root/testdata/sf0.01")
    assert got.columns == ["doc_id", "size", "source_size", "target", "taken"]
    cases.same(got, want)


def test_empty(spark):
    assert mixing.mix(cases.frame(spark, [])).count() == 0
    assert mixing.sample(cases.frame(spark, [])).count() == 0
