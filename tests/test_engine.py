"""The engine against plain Python and fixed expectations."""

import json
import os
import random
import re
import time

import numpy as np
import pytest

from tesserae import store
from tesserae.config import DEFAULT, EngineConfig, clamp_top_k, resolve_alpha
from tesserae.functions import embedding as E
from tesserae.functions import paths as P
from tesserae.index import IndexCache, SearchIndex
from tesserae.operators import chunking, lexical, ranking, results
from tesserae.plans import query as Q
from tesserae.sources import files, repos
from tesserae.streaming import changes

CHUNK = "chunk_ord long, content string, file_path string, start_line int, end_line int, language string"


def chunks(spark, rows):
    return spark.createDataFrame([(i, c, p, 1, c.count("\n") + 1, lang) for i, (c, p, lang) in enumerate(rows)], CHUNK)


def scores(spark, rows):
    return spark.createDataFrame([(0, i, float(s)) for i, s in enumerate(rows)], "query_id long, chunk_ord long, score double")


# Query analysis


def test_identifiers():
    assert Q.split_identifier("HandlerStack") == ["handlerstack", "handler", "stack"]
    assert Q.split_identifier("my_func") == ["my_func", "my", "func"]
    assert {"gethttpresponse", "http"} <= set(Q.tokenize("getHTTPResponse"))


def test_query_classes():
    q = "CLI entry point main command line interface"
    assert Q.is_location(q) and Q.is_entry_point(q)
    q = "where is cli-ui terminal output"
    assert Q.is_location(q) and not Q.is_entry_point(q)
    q = "hybrid search ranking BM25"
    assert not Q.is_location(q) and not Q.is_entry_point(q)
    assert Q.is_symbol("a::b") and Q.is_symbol("fooBar") and not Q.is_symbol("foo bar") and not Q.is_symbol("foo")
    assert Q.symbol_names("ns::Stack") == ["Stack", "ns::Stack"]


def test_alpha_and_k():
    assert resolve_alpha(True, None) == 0.3 and resolve_alpha(False, None) == 0.5 and resolve_alpha(False, 0) == 0
    with pytest.raises(ValueError):
        resolve_alpha(False, 1.5)
    assert [clamp_top_k(x) for x in (None, 5, 200, 0)] == [3, 5, 10, 3]
    with pytest.raises(ValueError):
        Q.analyse(0, "x", top_k=0)


# Lexical


def test_bm25_orders_and_filters(spark):
    c = chunks(spark, [("alpha", "a.ts", "x"), ("alpha beta gamma", "b.ts", "x"), ("delta epsilon", "c.ts", "y")])
    counts = lexical.term_counts(c, enrich=False)
    docs = lexical.document_stats(c, counts)
    args = lexical.postings(counts, docs), lexical.term_stats(counts), lexical.corpus_stats(docs)
    got = {r.chunk_ord: r.score for r in lexical.bm25(Q.plans(spark, [(0, "alpha beta")]), *args).collect()}
    assert set(got) == {0, 1} and got[1] > got[0]
    assert lexical.bm25(Q.plans(spark, [(0, "nothing")]), *args).count() == 0
    assert lexical.bm25(Q.plans(spark, [(0, "alpha")]), *args, lexical.selector(c, ["y"])).count() == 0
    assert lexical.selector(c) is None and lexical.selector(c, ["zzz"]) is None
    assert sorted(r.chunk_ord for r in lexical.selector(c, ["y"], ["a.ts"]).collect()) == [0, 2]


# Ranking


def greedy(items, k, decay=0.5):
    """The selection loop that the closed form replaces. items: (id, file, score) best first."""
    taken, per = [], {}
    for i, f, s in items:
        if len(taken) >= k and s <= min(x for x, _ in taken):
            break
        taken.append((s * decay ** per.get(f, 0), i))
        per[f] = per.get(f, 0) + 1
    return [i for _, i in sorted(taken, key=lambda x: -x[0])[:k]]


def test_saturation_equals_greedy_selection(spark):
    rng = random.Random(0)
    rows, want = [], {}
    for q in range(40):
        items = [(i, f"f{rng.randrange(4)}.ts", rng.random()) for i in range(rng.randint(1, 14))]
        rows += [(q, q * 100 + i, f"q{q}{f}", s) for i, f, s in items]
        want[q] = [q * 100 + i for i in greedy(sorted(items, key=lambda x: -x[2]), 5)]
    meta = spark.createDataFrame([(c, f, 1, 1.0) for _, c, f, _ in rows], "chunk_ord long, file_path string, start_line int, path_penalty double")
    plans = spark.createDataFrame([(q, 0.5, 5) for q in range(40)], "query_id long, alpha double, top_k int")
    s = spark.createDataFrame([(q, c, x) for q, c, _, x in rows], "query_id long, chunk_ord long, score double")
    got = {}
    for r in ranking.saturated(s, meta, plans).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.chunk_ord)
    assert got == want


def boost(spark, stage, query, rows, start=None, config=DEFAULT):
    meta = ranking.chunk_meta(chunks(spark, rows))
    plans = Q.plans(spark, [(0, query)])
    s = scores(spark, start or [1] * len(rows)).withColumn("top", ranking.F.lit(1.0))
    return {r.chunk_ord: round(r.score, 6) for r in stage(s, meta, plans, config).collect()}


def test_exact_stems(spark):
    f = lambda *paths: [("x", p, "t") for p in paths]
    got = boost(spark, ranking.exact_stems, "where is the cli code", f("src/cli.ts", "src/install.ts"))
    assert got == {0: 1.75, 1: 1.0}
    assert boost(spark, ranking.exact_stems, "cobra command CLI execute flags", f("cobra.go", "command.go")) == {0: 1.0, 1: 1.0}
    assert boost(spark, ranking.exact_stems, "route mod", f("route.rs", "mod.rs")) == {0: 1.0, 1: 1.0}
    assert boost(spark, ranking.exact_stems, "cli-ui terminal", f("cli-ui.ts", "cli.ts")) == {0: 1.75, 1: 1.0}


def boosted(spark, query, rows, start, config=DEFAULT):
    """Final scores of chunks of which the first were found; each in a file of its own, so coherence raises the best by a fifth."""
    meta = ranking.chunk_meta(chunks(spark, rows))
    found = spark.createDataFrame([(0, i, float(x)) for i, x in enumerate(start) if x is not None], "query_id long, chunk_ord long, score double")
    return {r.chunk_ord: round(r.score, 6) for r in ranking.boosted(found, meta, Q.plans(spark, [(0, query)]), config).collect()}


def test_installer_penalty_and_entry_points(spark):
    rows = [("x", "src/installer/a.ts", "t"), ("[package entry]\nbin: x\n", "package.json", "json"), ("function main() {}", "src/run.ts", "t"), ("x", "src/b.ts", "t")]
    # Coherence: 2 + 0.2 * 2 * 2 / 2 = 2.4 and 1 + 0.2 * 2 * 1 / 2 = 1.2; the best of all is 2.4.
    got = boosted(spark, "where is the output", rows, [2, None, None, 1])
    assert got == {0: 0.84, 1: 1.8, 3: 1.2}
    got = boosted(spark, "entry point", rows, [2, None, None, 1])
    assert got == {0: 0.84, 1: 6.0, 2: 6.0, 3: 1.2}
    got = boosted(spark, "where is run located", rows, [2, None, 1, None])
    assert got == {0: 0.84, 1: 1.8, 2: round(1.2 + 2.4 * 0.5 + 2.4 * 0.75 + 2.4 * 2.5, 6)}
    assert boosted(spark, "entry point", rows, [2, None, None, 1], EngineConfig(improvements=False)) == {0: 2.4, 3: 1.2}


def test_definitions_gain_and_come_in(spark):
    rows = [("class HandlerStack {", "a/handler_stack.py", "t"), ("use HandlerStack", "b.py", "t"), ("def HandlerStack(", "c.py", "t")]
    got = boosted(spark, "HandlerStack", rows, [None, 1, 0.5])
    assert got == {0: 5.4, 1: 1.2, 2: 4.2}


def test_entry_candidates_lose_no_answer(spark):
    """The first few entry points of a kind give the same top as all of them, found files among them or not."""
    rng = random.Random(3)
    rows = [(rng.choice(["function main() {}", "[package entry]\nbin: x\n", "plain text"]), rng.choice(["src/installer/", "tests/", "src/", "lib/x/"]) + rng.choice("abcdef") + ".ts", "t") for _ in range(150)]
    meta = ranking.chunk_meta(chunks(spark, rows))
    asked = [(0, "where is it located"), (1, "entry point of d"), (2, "where is the install hook"), (3, "where is a"), (4, "what else")]
    plans = Q.plans(spark, asked, 5)
    found = spark.createDataFrame([(q, i, 0.02 / (1 + k)) for q in range(5) for k, i in enumerate(rng.sample(range(150), 12))], "query_id long, chunk_ord long, score double")
    few, every = (ranking.saturated(ranking.boosted(found, meta, plans, entries=ranking.entry_candidates(meta, plans, n)), meta, plans) for n in (5, 1 << 20))
    rows_of = lambda df: sorted((r.query_id, r["rank"], r.chunk_ord, round(r.score, 9)) for r in df.collect())
    assert rows_of(few) == rows_of(every)
    assert ranking.entry_candidates(meta, plans, 5).count() < ranking.entry_candidates(meta, plans, 1 << 20).count()


def test_improvements_end_to_end(spark):
    rows = [("export async function main(argv) {\n run(cli)\n}\nfunction main(", "src/cli.ts", "typescript"), ("install the command line hooks entry point", "src/installer/install.ts", "typescript"), ("[package entry]\nbin cli: src/cli.ts\n", "package.json", "json"), ("terminal output", "src/ui.ts", "typescript")]
    index = SearchIndex.from_chunks(chunks(spark, rows))
    top = [r.file_path for r in index.search("CLI entry point main command line interface", 3).collect()]
    assert "src/cli.ts" in top and "src/installer/install.ts" not in top[:2]


# Results


def test_resolve_expand_snippet(spark):
    c = spark.createDataFrame([(i, f"c{i}", "f.py", a, b, "python") for i, (a, b) in enumerate([(1, 5), (6, 10), (11, 15), (15, 15)])], CHUNK)
    want = lambda path, line: spark.createDataFrame([(0, path, line)], "request_id long, file_path string, line int")
    assert results.resolve(c, want("f.py", 7)).first().chunk_ord == 1
    assert results.resolve(c, want("f.py", 15)).first().chunk_ord == 2
    assert results.resolve(c, want("g.py", 1)).isEmpty() and results.resolve(c, want("f.py", 99)).isEmpty()
    got = results.expand(c, want("f.py", 7), 1, 1).orderBy("offset").collect()
    assert [(r.chunk_ord, r.offset) for r in got] == [(0, -1), (1, 0), (2, 1)]
    body = "\n".join("needle" if i == 20 else f"line {i}" for i in range(40))
    hit = spark.createDataFrame([(0, body, 1, 40, ["needle"])], "chunk_ord long, content string, start_line int, end_line int, match_terms array<string>")
    r = results.snippets(hit, EngineConfig(snippet_lines=5)).first()
    assert r.truncated and r.anchor_line == 21 and (r.full_start_line, r.full_end_line) == (1, 40) and len(r.content.split("\n")) == 11 and (r.start_line, r.end_line) == (16, 26)
    short = spark.createDataFrame([(0, "a\nb", 3, 4, ["zz"])], "chunk_ord long, content string, start_line int, end_line int, match_terms array<string>")
    r = results.snippets(short).first()
    assert not r.truncated and r.content == "a\nb" and r.anchor_line == 3


# Chunking

PY = '''import os


@decorate
def first(a):
    return a


class Thing:
    """Doc."""

    size = 1

    def one(self):
        return 1

    async def two(self):
        # comment
        return 2


def last():
    pass
'''


def test_structural_python():
    lines = chunking.lines_of(PY)
    units = sorted(set(chunking._python_units(lines)))
    cut = [PY[a:b] for a, b in units]
    assert cut[0] == PY[: PY.index("def first")] and cut[1].startswith("@decorate\ndef first") and cut[2].startswith("class Thing") and "def one" in cut[2] and "def two" not in cut[2]
    assert cut[3].lstrip().startswith("async def two") and cut[4].startswith("def last")


def test_structural_braces():
    ts = "import x from 'y';\n\nexport function a() {\n  if (x) { y(); }\n};  \nconst b = (q) => {\n  return q;\n}\n"
    spans = chunking._brace_units(ts, chunking.lines_of(ts), "typescript", 60)
    assert sorted(ts[a:b] for a, b in spans) == sorted([ts[: ts.index("export")], ts[ts.index("export") : ts.index("const b")], ts[ts.index("const b") :]])
    go = "package x\n\ntype S struct {\n a int\n}\n\nfunc (s S) F() int {\n return 1\n}\n"
    assert len(chunking._brace_units(go, chunking.lines_of(go), "go", 60)) == 3
    assert chunking.structural_spans("x = 1\n", "python", 100) is None and chunking.structural_spans("x", "rust", 100) is None


def test_packing():
    assert chunking.pack([(0, 700), (700, 1400), (1400, 1600), (1600, 3100), (3100, 3110)], 1500) == [(0, 1400), (1400, 3100)[:1] + (1600,), (1600, 3100), (3100, 3110)]
    assert chunking.pack([(0, 700), (705, 1300), (1300, 2100)], 1500) == [(0, 1300), (1300, 2100)]


def test_line_column_equals_plain_scan(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice(["a", "bc ", "\n", "\r\n", "\r", "é😀"]) for _ in range(rng.randint(0, 80))) for _ in range(60)]
    got = spark.createDataFrame(list(enumerate(texts)), "i long, t string").select("i", chunking.line_spans_column("t", 20).alias("s")).collect()
    for r in got:
        assert [(x.start, x.end) for x in r.s] == chunking.line_spans(texts[r.i], 20)


def test_tree_spans():
    class Node:
        def __init__(self, start, end, children=()):
            self.start, self.end, self.children = start, end, children

    leaves = [Node(i * 40, i * 40 + 40) for i in range(6)]
    root = Node(0, 240, [Node(0, 160, leaves[:4]), *leaves[4:]])
    assert chunking.tree_spans(root, 100) == [(0, 80), (80, 160), (160, 240)]
    assert chunking.tree_spans(Node(0, 30, leaves[:1]), 100) == [(0, 30)]


# Embedding


class Mock:
    model, dimensions = "mock", 3

    def embed(self, texts):
        return [np.array([1.0, 0, 0]) if t.startswith("a") else np.array([0, 1.0, 0]) for t in texts]


def test_windows_and_pooling():
    assert E.split_windows("x" * 100, 100) == ["x" * 100]
    parts = E.split_windows("x" * 250, 100, 36)
    assert [len(p) for p in parts] == [100, 100, 100, 58]
    config = EngineConfig(window_chars=100, window_overlap=0)
    assert E.embed_texts(Mock(), ["a" * 100 + "b" * 100], config)[0] == pytest.approx([2**-0.5, 2**-0.5, 0])
    assert (E.unit(np.zeros(3)) == 0).all()


def test_http_backend_retries_splits_and_checks():
    calls = []

    def send(payload):
        calls.append(payload["input"])
        if len(calls) <= 2:
            raise E.HttpError(503, "busy")
        if any(len(t) > 200 for t in payload["input"]) or len(payload["input"]) > 2:
            raise E.HttpError(413, "large")
        return {"data": [{"index": i, "embedding": [float(len(t)), 1.0]} for i, t in reversed(list(enumerate(payload["input"])))]}

    b = E.HttpEmbedder("u", "m", send=send, sleep=lambda s: None)
    got = b.embed(["x", "y" * 300, "zz", "w"])
    assert len(got) == 4 and got[0][0] == 1 and got[1][0] == 150 and got[2][0] == 2
    assert b.stats["retries"] == 2 and b.stats["splits"] >= 2
    with pytest.raises(ValueError):
        E.vectors_of([{"index": 0, "embedding": [1]}, {"index": 0, "embedding": [1]}], 2)
    with pytest.raises(ValueError):
        E.vectors_of([{"index": 0, "embedding": [1]}], 2)
    assert E.vectors_of([{"index": 0, "embedding": {"values": [127, -127, 0], "scale": 0.01, "zero_point": 0}}], 1)[0] == pytest.approx([1.27, -1.27, 0])
    b = E.HttpEmbedder("u", "m", send=lambda p: (_ for _ in ()).throw(E.HttpError(400, "no")), sleep=lambda s: None)
    with pytest.raises(E.HttpError):
        b.embed(["x"])


# Sources


def write(root, path, text):
    os.makedirs(os.path.dirname(f"{root}/{path}") or root, exist_ok=True)
    with open(f"{root}/{path}", "w") as f:
        f.write(text)


def test_walk_and_ignore(tmp_path):
    root = str(tmp_path)
    for p in ("a.py", "__init__.py", ".hidden.py", "node_modules/x.py", "src/b.ts", "src/gen/c.ts", "src/keep.gen.ts", "out/d.py", "Dockerfile", "notes.md", "x/build/y.py", "logs/deep/z.py"):
        write(root, p, "x")
    write(root, ".gitignore", "# comment\n/out/\n*.gen.ts\n!keep.gen.ts\nlogs/**\n")
    write(root, "src/.gitignore", "gen\n!/b.ts\n")
    found = [os.path.relpath(p, root) for p in files.walk(root, P.extensions(["code"]))]
    assert found == [".hidden.py", "Dockerfile", "__init__.py", "a.py", "src/b.ts", "src/keep.gen.ts"]
    assert ".md" in P.extensions(["docs"]) and ".md" not in P.extensions(["code"]) and P.resolve_content(["all"]) == ["code", "docs", "config"] and P.resolve_content(["x", "docs"]) == ["docs"]


@pytest.mark.parametrize("pattern, path, is_dir, ignored", [("*.log", "a/b.log", False, True), ("/a", "b/a", False, False), ("a/", "a", False, False), ("a/", "a/b", False, True), ("a/*/c", "a/b/c", False, True), ("**/x", "p/q/x", False, True), ("a/**/b", "a/b", False, True), ("[ab].c", "b.c", False, True), ("[!ab].c", "b.c", False, False), ("q?z", "qaz", True, True), (r"\#x", "#x", False, True)])
def test_ignore_patterns(pattern, path, is_dir, ignored):
    assert files.IgnoreRules([pattern]).ignores(path, is_dir) is ignored


def test_statuses_and_entries(spark, tmp_path):
    root = str(tmp_path)
    write(root, "a.py", "print(1)\n")
    write(root, "blank.py", " \n\t")
    write(root, "big.py", "x" * 300)
    listed = files.listing(spark, root)
    gone = spark.createDataFrame([(9, "gone.py", f"{root}/gone.py", 0)], listed.schema)
    config = EngineConfig(max_file_bytes=200)
    read = files.read_files(listed.unionByName(gone), config)
    assert {r.file_path: r.status for r in read.collect()} == {"a.py": "valid", "blank.py": "empty", "big.py": "too_large", "gone.py": "error"}
    assert tuple(files.status_counts(read).first()) == (1, 2, 1)
    with pytest.raises(ValueError):
        files.listing(spark, root, config=EngineConfig(max_index_files=1))
    assert files.package_entry('{"bin": {"x": "a.js"}, "main": "m.js", "typings": "t.d.ts"}') == "[package entry]\nbin x: a.js\nmain: m.js\ntypes: t.d.ts\n"
    assert files.package_entry("{}") is None and files.package_entry("nope") is None


def test_source_policy():
    assert repos.is_git_url("git@host:a/b") and repos.is_git_url("https://x/y") and not repos.is_git_url("/a/b")
    assert repos.is_allowed("https://x") and not repos.is_allowed("http://x") and not repos.is_allowed("ssh://x") and repos.is_allowed("http://x", EngineConfig(allow_http_git=True))
    with pytest.raises(ValueError):
        repos.check_workspace("/etc", EngineConfig(workspace_root="/tmp"))
    repos.check_workspace("/tmp/x", EngineConfig(workspace_root="/tmp"))
    assert repos.indexed_path("/r/a/b.py", "/r") == "a/b.py" and repos.indexed_path("a/b.py", "/r") == "a/b.py" and repos.source_key("https://x", "v1") == "https://x@v1"


# The index as a whole


def tree(root):
    write(root, "src/auth.ts", "export function authenticate(token) {\n  return verify(token);\n}\n" + "// auth\n" * 12)
    write(root, "src/utils.ts", "export function formatDate(d) {\n  return d.toISOString();\n}\n" + "// utils\n" * 12)


def test_build_search_save_load_update(spark, tmp_path):
    root, cache = str(tmp_path / "repo"), str(tmp_path / "cache")
    tree(root)
    index = SearchIndex.from_path(spark, root, cache=cache)
    assert index.search("authenticate token", 1, alpha=0.0, rerank=False).first().file_path == "src/auth.ts"
    assert index.search("  ").count() == 0
    answer = index.answer("authenticate")
    assert answer["results"][0]["score"] == "100%" and answer["results"][0]["chunk"]["absolute_path"] == f"{root}/src/auth.ts"
    assert index.chunk_at(f"{root}/src/auth.ts", 2).first().file_path == "src/auth.ts"
    assert index.find_related("src/auth.ts", 2).first().file_path == "src/utils.ts" and index.find_related("nope", 1).count() == 0
    assert index.memory_bytes() == 2 * 256 + 8
    again = SearchIndex.from_path(spark, root, cache=cache)
    assert again.loaded
    same = lambda i: [(r.chunk_ord, round(r.score, 9)) for r in i.search("format date", 5).collect()]
    assert same(index) == same(again)

    write(root, "src/newfile.ts", "export function paginate(rows) {\n  return rows;\n}\n" + "// pages\n" * 12)
    write(root, "src/utils.ts", "export function parseDuration(d) {\n  return d;\n}\n" + "// utils\n" * 12)
    os.utime(f"{root}/src/utils.ts", (time.time() + 5, time.time() + 5))
    os.remove(f"{root}/src/auth.ts")
    assert sorted(again.refresh()) == ["src/auth.ts", "src/newfile.ts", "src/utils.ts"]
    assert sorted(r.file_path for r in again.tables["chunks"].collect()) == ["src/newfile.ts", "src/utils.ts"]
    assert again.search("paginate rows", 1).first().file_path == "src/newfile.ts" and again.search("parse duration", 1).first().file_path == "src/utils.ts"
    fresh = SearchIndex.from_path(spark, root)
    stats = lambda i: (i.tables["corpus"].first(), sorted((r.term, r.df) for r in i.tables["terms"].collect()))
    assert stats(again) == stats(fresh)
    again.save(f"{cache}/{store.cache_key(root)}")
    assert SearchIndex.load(spark, f"{cache}/{store.cache_key(root)}").tables["chunks"].count() == 2
    for p in ("src/newfile.ts", "src/utils.ts"):
        os.remove(f"{root}/{p}")
    with pytest.raises(ValueError):
        again.refresh()
    with pytest.raises(ValueError):
        SearchIndex.from_path(spark, root)


def test_store_refuses_partial_and_stale(spark, tmp_path):
    root, folder = str(tmp_path / "repo"), str(tmp_path / "index")
    tree(root)
    index = SearchIndex.from_path(spark, root)
    index.save(folder)
    assert store.valid(spark, folder, "hash", ["code"], "int8") and not store.valid(spark, folder, "other", ["code"], "int8") and not store.valid(spark, folder, "hash", ["code"], "float")
    os.remove(f"{folder}/v1/meta/_SUCCESS")
    assert store.newest(spark, folder) is None and store.missing(spark, folder, 1) == ["meta"]
    index.save(folder)
    assert store.newest(spark, folder) == 2
    path = f"{folder}/v2/meta"
    row = json.loads(spark.read.parquet(path).first().meta) | {"epoch": "old"}
    spark.createDataFrame([(json.dumps(row),)], "meta string").coalesce(1).write.parquet(f"{folder}/new")
    store.delete(spark, path)
    os.rename(f"{folder}/new", path)
    assert not store.valid(spark, folder, "hash", ["code"], "int8") and not os.path.exists(folder)


def test_float_and_int8_agree(spark):
    rng = np.random.default_rng(0)
    v = rng.normal(size=(200, 64))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    held = spark.createDataFrame([(i, x.astype("float32").tolist()) for i, x in enumerate(v)], "chunk_ord long, vector array<float>")
    queries = spark.createDataFrame([(i, (v[i] + rng.normal(size=64) * 0.05).tolist()) for i in range(40)], "query_id long, vector array<double>")
    from tesserae.operators import vector

    top = lambda h: {r.query_id: r.chunk_ord for r in vector.nearest(h, queries, 1).collect()}
    a, b = top(held), top(vector.quantized(held))
    assert sum(a[q] == b[q] for q in a) > 0.85 * len(a)
    full = v.astype("float32").astype(float) @ np.array([r.vector for r in queries.orderBy("query_id").collect()]).T
    assert all(a[q] == full[:, q].argmax() for q in a)
    with pytest.raises(ValueError):
        vector.nearest(held, queries, 0)


def test_changes_as_a_stream(spark, tmp_path):
    root, state = str(tmp_path / "repo"), str(tmp_path / "state")
    tree(root)
    index = SearchIndex.from_path(spark, root)
    query = index.watch(state)
    try:
        query.processAllAvailable()
        write(root, "src/extra.ts", "export function reconcile(x) {\n return x;\n}\n" + "// extra\n" * 12)
        os.remove(f"{root}/src/auth.ts")
        for _ in range(40):
            query.processAllAvailable()
            if sorted(r.file_path for r in index.tables["files"].collect()) == ["src/extra.ts", "src/utils.ts"]:
                break
            time.sleep(0.5)
    finally:
        query.stop()
    assert index.search("reconcile", 1).first().file_path == "src/extra.ts"
    assert changes.difference({"a": 1, "b": 1}, {"b": 2, "c": 1}) == [("a", None, "deleted"), ("b", 2, "modified"), ("c", 1, "new")]
    assert changes.is_ignored("a/node_modules/b") and changes.is_ignored(None) and not changes.is_ignored("src/a.ts")


def test_cache_of_indexes(spark, tmp_path):
    config = EngineConfig(cached_indexes=1)
    cache = IndexCache(spark, str(tmp_path / "cache"), config)
    for name in ("one", "two"):
        tree(str(tmp_path / name))
        cache.get(str(tmp_path / name))
    assert list(cache.held) == [str(tmp_path / "two")]
    with pytest.raises(ValueError):
        cache.get("http://x/y")
    cache.clear(str(tmp_path / "two"))
    assert not cache.held


def test_batch_equals_single_searches(spark):
    rows = [(f"{w} text about {w} and things", f"src/{w}.ts", "typescript") for w in ("alpha", "beta", "gamma", "delta")]
    index = SearchIndex.from_chunks(chunks(spark, rows))
    asked = [(1, "where is alpha"), (2, "GammaThing"), (3, " "), (4, "beta things")]
    got = {}
    for r in index.batch_search(spark.createDataFrame(asked, "query_id long, text string"), 3).collect():
        got.setdefault(r.query_id, []).append((r.chunk_ord, round(r.score, 9)))
    for i, q in asked:
        assert got.get(i, []) == [(r.chunk_ord, round(r.score, 9)) for r in index.search(q, 3).collect()]


def test_entry_content_pattern():
    assert re.search(P.ENTRY_CONTENT, "a\n  async function main (") and not re.search(P.ENTRY_CONTENT, "xfunction mainly(")
