"""Every registered query with SQL gives the rows that DuckDB gives."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from tesserae import queries
from tesserae.plans import query as Q

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def plain(x):
    return float(x) if isinstance(x, float) and not math.isnan(x) else x


@pytest.fixture(scope="module")
def con():
    return connect("/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_same_rows(spark, con, name):
    got = queries.QUERIES[name](spark, "/root/testdata/sf0.001")
    if name not in queries.SQL:
        assert got.count() > 0
        return
    want = con.execute("SELECT " + ", ".join(f'"{c}"' for c in got.columns) + f" FROM ({queries.SQL[name]})").fetchall()
    rows = sorted((tuple(map(plain, r)) for r in got.collect()), key=repr)
    want = sorted((tuple(map(plain, r)) for r in want), key=repr)
    assert len(rows) == len(want) and rows == want


def test_entry(spark):
    assert entry.entry(spark).count() == 20
    assert set(queries.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("kind", ["float", "int8"])
def test_batch_neighbours_ask_every_twentieth_row(spark, kind):
    """All stated queries against all rows, by brute force; the block path gives the same."""
    import numpy as np

    from tesserae.config import EngineConfig
    from tesserae.operators import vector

    folder = "/root/testdata/sf0.1"
    rows = spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding").collect()
    ids, v = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], np.float64)
    scale, sent = np.ones(len(v)), np.ones(len(v))
    if kind == "int8":
        top = np.abs(v).max(1)
        scale = np.where(top > 0, top / 127, 1.0)
        v, sent = np.clip(np.floor(v / scale[:, None] + 0.5), -127, 127), scale.astype(np.float32).astype(np.float64)
    want = {}
    for q in np.flatnonzero(ids % 20 == 0):
        score = (v @ v[q]) * scale[q] * sent
        want[int(ids[q])] = np.sort(score)[::-1][:10]
    assert len(want) == 100
    got = {}
    for r in queries.QUERIES[f"knn_{kind}"](spark, folder).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r)
    assert set(got) == set(want)
    for q, found in got.items():
        assert [r.score for r in found] == pytest.approx(want[q], abs=2e-6)
    have = queries.vectors_of(spark, folder)
    have = vector.quantized(have) if kind == "int8" else have
    blocks = queries._near(vector.nearest(have, queries.probe(spark, folder), 40, config=EngineConfig(query_block=30)), 10)
    assert sorted(map(tuple, blocks.collect())) == sorted(tuple(r) for x in got.values() for r in x)


def small_code_corpus(spark, tmp_path):
    """Pages whose hosts give names of one letter and more, every query form among them, and a connection to them."""
    hosts = ["m.adult-x", "tionsh", "y", "ab"]
    rows = [(i, f"https://{hosts[(i // 4) % 4]}.example.net/en/{i}", f"<title>class of {i}</title>") for i in range(200)]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    return con


def assert_same_rows(spark, con, name, folder):
    got = queries.QUERIES[name](spark, str(folder))
    want = con.execute("SELECT " + ", ".join(f'"{c}"' for c in got.columns) + f" FROM ({queries.SQL[name]})").fetchall()
    rows = sorted((tuple(map(plain, r)) for r in got.collect()), key=repr)
    assert rows and rows == sorted((tuple(map(plain, r)) for r in want), key=repr)


def test_definition_tier_of_names_whose_first_word_is_one_letter(spark, tmp_path):
    assert_same_rows(spark, small_code_corpus(spark, tmp_path), "definition_tier", tmp_path)


def test_query_classify_of_names_whose_first_word_is_one_letter(spark, tmp_path):
    assert_same_rows(spark, small_code_corpus(spark, tmp_path), "query_classify", tmp_path)
    assert Q.analyse(0, "how does the XHandler push work")["names"] == ["XHandler"]
    assert Q.analyse(0, "which IDs and APIs have URLs")["names"] == []


def odd_code_corpus(spark, tmp_path):
    """Pages without url, name or host, and pages numbered below 0 and beyond what a double holds exactly."""
    urls = [None, "", "https://example.com/en/1", "HTTPS://WWW.SHOP.EXAMPLE.COM/", "https://shop24.example.net/x", "https://shop.example.net/x", "https://x.example.net/"]
    rows = [(first + 20 * i + j, urls[i // 5 % 7], f"<title>class of {i}</title>") for first in (-700, 0, 9_000_000_000_000_000_000) for i in range(35) for j in range(2)]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    return con


@pytest.mark.parametrize("name", ["query_classify", "definition_tier", "exact_stem_boost"])
def test_odd_pages_are_asked_about_as_in_sql(spark, tmp_path, name):
    assert_same_rows(spark, odd_code_corpus(spark, tmp_path), name, tmp_path)


def test_known_names_join_those_found(spark):
    asked = spark.createDataFrame([(0, "how does the Handler push work", ["Handler"]), (1, "where is HandlerStack", ["HandlerStack", "Stack"]), (2, "how does the Handler work", None), (3, " ", ["Handler"])], "query_id long, text string, known_names array<string>")
    got = {r.query_id: r for r in Q.analysed(asked).collect()}
    assert {i: r.names for i, r in got.items()} == {0: ["Handler"], 1: ["HandlerStack", "Stack"], 2: []}
    assert got[0].names_low == ["handler"] and "Handler" in got[0].def_pattern and not got[2].def_pattern
    assert Q.analysed(asked.drop("known_names")).where("query_id = 0").first().names == []


def test_scores_round_as_in_sql(spark):
    """Scores of nine digits, halved as in a file's later chunks: halves of the seventh and ninth digit are common."""
    import random

    from tesserae.functions import vectors as V

    rng = random.Random(5)
    scores = [round(rng.random() / 5, 9) * 0.5**k * f for _ in range(4000) for k in range(4) for f in (1.0, 2.5)] + [-0.5, 0.5, 1.5, 0.0]
    con = duckdb.connect()
    for digits in (7, 9):
        want = [r[0] for r in con.execute(f"SELECT round(x, {digits}) FROM (SELECT unnest(?::DOUBLE[]) AS x)", [scores]).fetchall()]
        df = spark.createDataFrame(list(enumerate(scores)), "i long, x double")
        assert [r.y for r in df.select("i", V.rounded("x", digits).alias("y")).orderBy("i").collect()] == want


def test_hybrid_rerank_of_scores_at_a_half(spark, monkeypatch):
    halves = [float(f"{k * 5}e-8") for k in range(1, 100_000, 2)]
    scores = [x for x in halves if x * 1e7 % 1 < 0.5][:6]  # as decimals they are a half, as scaled doubles less
    rows = [(1, i, x, f"f{i}", 1, 1.0, 0.5, 6) for i, x in enumerate(scores)]
    frame = spark.createDataFrame(rows, "query_id long, chunk_ord long, score double, file_path string, start_line int, path_penalty double, alpha double, top_k int")
    monkeypatch.setattr(queries, "code_search", lambda *_: (None, None, frame))
    want = duckdb.execute("SELECT round(x, 7) FROM (SELECT unnest(?::DOUBLE[]) AS x)", [scores]).fetchall()
    got = {r.chunk_ord: r.score for r in queries.hybrid_rerank(spark, "").collect()}
    assert len(got) == 6 and [got[i] for i in range(6)] == [x for (x,) in want]


def many_of_a_name(spark, tmp_path):
    """960 pages of two hosts: every query's text comes several times, and its name's file has 60 chunks."""
    rows = [(i, f"https://{'shop' if i % 3 else 'tionsh'}.example.net/{i}", f"<title>part {i % 7} of the code</title>") for i in range(960)]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    vectors = [(i, [math.sin(i * 1.7 + 1), math.cos(i * 0.3), math.sin(i * i * 0.01), 0.5]) for i in range(320)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    for t in ("pages", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    return con


def test_hybrid_rerank_takes_no_more_of_a_name_than_can_be_among_the_best(spark, tmp_path, monkeypatch):
    from tesserae.operators import lexical, ranking

    con, taken, asked = many_of_a_name(spark, tmp_path), [], []
    candidates, bm25 = ranking.candidates, lexical.bm25
    monkeypatch.setattr(ranking, "candidates", lambda *a, **k: taken.append(candidates(*a, **k)) or taken[-1])
    monkeypatch.setattr(lexical, "bm25", lambda plans, *a, **k: asked.append(plans) or bm25(plans, *a, **k))
    assert_same_rows(spark, con, "hybrid_rerank", tmp_path)
    assert asked[0].count() == asked[0].select("text").distinct().count() < 48  # each text is searched for once
    unfound = taken[0].where("named AND score IS NULL").groupBy("query_id").count().collect()
    assert unfound and max(r["count"] for r in unfound) <= 6


def test_named_candidates_keep_the_best(spark):
    """Whatever is found, the bound leaves each query's top k as they are with all files of the name."""
    from tesserae.operators import ranking

    kinds = ["class PushHandler:", "PushHandler()", "#!/usr/bin/env x\nclass PushHandler {", "[package entry]\nclass PushHandler "]
    rows = [(i, kinds[i % 4], f"{['src', 'tests', 'installer'][i % 3]}/push_handler.py", 1 + i % 5, 9, "python") for i in range(90)]
    meta = ranking.chunk_meta(spark.createDataFrame(rows, "chunk_ord long, content string, file_path string, start_line int, end_line int, language string"))
    plans = Q.analysed(spark.createDataFrame([(0, "PushHandler"), (1, "where is PushHandler"), (2, "entry point of PushHandler")], "query_id long, text string"), 4).persist()
    found = spark.createDataFrame([(q, i, 0.01 + 0.001 * (i % 3)) for q in range(3) for i in range(q, 90, 7)], "query_id long, chunk_ord long, score double")
    entries, named = ranking.entry_candidates(meta, plans, 4), ranking.named_candidates(meta, plans)
    top = lambda **k: sorted(map(tuple, ranking.saturated(ranking.boosted(found, meta, plans, **k), meta, plans).collect()))
    want = top(entries=ranking.entry_candidates(meta, plans, 1 << 20))
    assert len(want) == 12 and top(entries=entries, named=named) == want
    assert named.count() < ranking._injected(plans, meta, ranking.DEFAULT).count()
