import random

import numpy as np
import pytest

from tesserae.llm import linedup
from tesserae.llm.cuckoo import CuckooFilter
from tesserae.llm.queries import oracle_sql, queries

from . import cases

BLANK = " \t\n\x0b\x0c\r"


def key(line):
    return cases.lower(line.strip(BLANK))


def expected(data):
    order = lambda d: (d is None, d)
    holders = {}
    for d, text, *_ in data:
        for line in (text or "").split("\n"):
            if len(key(line)) >= 10:
                holders.setdefault(key(line), set()).add(d)
    first = {k: min(v, key=order) for k, v in holders.items() if len(v) > 1}
    out = []
    for d, text, *_ in data:
        lines = (text or "").split("\n")
        kept = [x for x in lines if first.get(key(x), d) == d]
        out.append((d, len(lines), len(lines) - len(kept), cases.sha("\n".join(kept))))
    return out


def test_cuckoo_holds_all_and_deletes():
    rng = np.random.default_rng(0)
    keys = np.unique(rng.integers(-(1 << 63), 1 << 63, 20_000))
    held = CuckooFilter.of(keys)
    assert held.contains(keys).all()
    assert held.slots < 4 * len(keys)
    others = rng.integers(-(1 << 63), 1 << 63, 50_000)
    assert held.contains(others).mean() < 0.001
    gone, stay = keys[::2], keys[1::2]
    held.delete(gone)
    assert held.contains(stay).all() and held.contains(gone).mean() < 0.001
    again = CuckooFilter.from_bytes(held.to_bytes())
    again.insert(gone)
    assert again.contains(keys).all() and len(again.layers) == 1
    for n in (0, 1, 2, 7):
        assert CuckooFilter.of(keys[:n]).contains(keys[:n]).all()


def test_full_filter_opens_layers():
    small = CuckooFilter(8)
    keys = np.arange(5000)
    for part in np.array_split(keys, 40):
        small.insert(part)
    assert len(small.layers) > 1 and small.contains(keys).all()
    assert sum(small.used) == sum(np.count_nonzero(x) for x in small.layers) == 5000
    small.delete(keys[100:])
    assert small.contains(keys[:100]).all() and sum(small.used) == 100


def test_crowded_buckets_lose_nothing():
    """All keys in few buckets: prints that no move can place go to further layers."""
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 1 << 62, 300_000))
    tight = CuckooFilter(layers=[np.zeros((2, 4), np.uint16)])
    tight._place(0, *[np.arange(1, 60).astype(np.uint16), np.zeros(59, np.int64)])
    assert sum(tight.used) == 59 and {len(x) for x in tight.layers} == {2}
    held = CuckooFilter(len(keys))
    held.insert(keys)
    assert held.contains(keys).all()


def test_equal_prints_go_one_by_one():
    held = CuckooFilter(100)
    held.insert(np.array([5, 5, 5, 9]))
    held.delete(np.array([5, 5]))
    assert held.contains(np.array([5, 9])).all()
    held.delete(np.array([5]))
    assert held.contains(np.array([5, 9])).tolist() == [False, True]


@pytest.mark.parametrize("seed", [0, 1])
def test_against_brute_force(spark, seed):
    data = [*cases.rows(seed), (None, "the shared  line of all\nsome other line of text"), (2, "Some other line of text \n\x0b"), (None, "Some other line of text")]
    cases.same(linedup.dedup_lines(cases.frame(spark, data)), expected(data))


def test_table_and_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM read_parquet('/root/testdata/sf0.01/documents.parquet')")
    got = queries()["op2_line_dedup"](spark, "/root/testdata/sf0.01")
    cases.same(got, con.execute("SELECT doc_id, n_lines, n_dropped, kept_sha256 FROM (" + oracle_sql()["op2_line_dedup"] + ")").fetchall())
    cases.same(got, expected([(r.doc_id, r.text) for r in cases.table(spark, "sf0.01", "documents").collect()]))


def state(index):
    drops = sorted((r.doc_id, sorted(r["keys"])) for r in index.drops().collect())
    return sorted(index.refs().collect()), sorted(index.counts().select("h", "g", "first_doc", "last_doc", "refs").collect()), drops


def test_adding_and_removing_is_reversible(spark):
    data = [r for r in cases.rows(3) if r[1] is not None]
    data = list({r[0]: r for r in data}.values())
    random.Random(1).shuffle(data)
    a, b = data[:70], data[70:]
    index = linedup.LineIndex(spark, shards=3).add(cases.frame(spark, a))
    before = state(index)
    index.add(cases.frame(spark, b))
    whole = linedup.LineIndex(spark, shards=3).add(cases.frame(spark, data))
    assert state(index) == state(whole)
    cases.same(linedup.dedup_lines(cases.frame(spark, b), index), [r for r in expected(data) if r[0] in {x[0] for x in b}])
    index.add(cases.frame(spark, b[:5]))  # again: no change
    assert state(index) == state(whole)
    keys = whole.counts()
    assert index.maybe_known(keys).where("not known").isEmpty()
    index.remove(spark.createDataFrame([(r[0],) for r in b], "doc_id long"))
    assert state(index) == before
    only_b = whole.counts().join(index.counts(), ["h", "g"], "left_anti")
    assert index.maybe_known(index.counts()).where("not known").isEmpty()
    assert only_b.count() == 0 or index.maybe_known(only_b).where("known").count() < 0.05 * only_b.count() + 1


def test_an_index_outlives_its_session(spark, tmp_path):
    """Two sessions add, one removes; a change that fails half way leaves the version before it."""
    data = list({r[0]: r for r in cases.rows(5) if r[1] is not None}.values())
    a, b, c = data[:40], data[40:80], data[80:]
    path = str(tmp_path / "index")
    linedup.LineIndex(spark, path, shards=5).add(cases.frame(spark, b))
    again = linedup.LineIndex(spark, path)
    assert (again.version, again.shards) == (1, 5)
    again.add(cases.frame(spark, a + c))
    broken = linedup.LineIndex(spark, path)

    def fail(*_):
        raise RuntimeError("lost")

    broken._commit = fail
    with pytest.raises(RuntimeError):
        broken.add(cases.frame(spark, [(5000, "a line that nobody keeps")]))
    third = linedup.LineIndex(spark, path)
    assert state(third) == state(linedup.LineIndex(spark, shards=5).add(cases.frame(spark, data)))
    third.remove(spark.createDataFrame([(r[0],) for r in b], "doc_id long"))
    last = linedup.LineIndex(spark, path)
    assert state(last) == state(linedup.LineIndex(spark, shards=5).add(cases.frame(spark, a + c)))
    cases.same(linedup.dedup_lines(cases.frame(spark, a + c), last), expected(a + c))


def test_filters_decide_what_is_looked_up():
    """Of one shard: a key that the filter holds and a second holder pass, a first holder is entered and does not."""
    h, g = np.array([11, 22, 22, 33]), np.array([1, 1, 1, 1])
    held = CuckooFilter.of(linedup._print_key(h[:1], g[:1]))
    none = [None] * 4
    told = linedup.row_batch(linedup._PASSED, part=[0], sure=[False], shard=[0], kind=[linedup._SLOTS], h=[None], g=[None], doc_id=[None], slots=[held.to_bytes()])
    refs = linedup.row_batch(linedup._PASSED, part=[0] * 4, sure=[False] * 4, shard=[0] * 4, kind=[linedup._REF] * 4, h=h, g=g, doc_id=[5, 6, 7, 8], slots=none)
    sure = linedup.row_batch(linedup._PASSED, part=[0], sure=[True], shard=[0], kind=[linedup._REF], h=[44], g=[1], doc_id=[9], slots=[None])
    rows = [r for b in linedup._filtered(iter([told, refs, sure])) for r in b.to_pylist()]
    assert [(r["h"], r["doc_id"], r["sure"]) for r in rows if r["kind"] == linedup._REF] == [(11, 5, False), (22, 7, False), (44, 9, True)]
    after = CuckooFilter.from_bytes(rows[-1]["slots"])
    assert rows[-1]["kind"] == linedup._SLOTS and after.contains(linedup._print_key(h, g)).all() and sum(after.used) == 3


def test_emptied_documents_can_go(spark):
    data = [(1, "a shared line here\nx"), (2, "A shared line here"), (3, None), (4, ""), (5, "a shared line here\n \t"), (6, "a shared line here\nown")]
    docs = cases.frame(spark, data)
    assert {r.doc_id for r in linedup.strip_lines(docs, drop_emptied=True).collect()} == {1, 3, 4, 6}


def test_strip_lines_keeps_columns(spark):
    data = [(1, "a shared line here\nx"), (2, "A shared line here \ny"), (3, None), (4, "")]
    docs = cases.frame(spark, data)
    got = linedup.strip_lines(docs)
    assert got.columns == docs.columns
    assert {(r.doc_id, r.text, r.n_chars) for r in got.collect()} == {(1, data[0][1], 20), (2, "y", 1), (3, None, None), (4, "", 0)}


def test_very_long_texts(spark):
    long = "\n".join(f"line number {i} of many" for i in range(60_000))
    data = [(1, long), (2, "own line of text\n" + long), (3, "y" * 2_000_000), (4, "Y" * 2_000_000 + " \nz")]
    cases.same(linedup.dedup_lines(cases.frame(spark, data)), expected(data))


def test_empty(spark):
    assert linedup.dedup_lines(cases.frame(spark, [])).count() == 0
    assert linedup.strip_lines(cases.frame(spark, [])).count() == 0
