"""Plug-ins, settings, accounting, persistence and evaluation against plain Python."""

import os
import random
import re
import time

import numpy as np
import pytest

from tesserae import store
from tesserae.config import EngineConfig, first_setting, strip_comments, whole_number
from tesserae.functions import embedding as E
from tesserae.functions import vectors as V
from tesserae.index import IndexCache, SearchIndex
from tesserae.operators import chunking, evaluation, vector
from tesserae.sources import files

from .test_engine import tree, write


class Node:
    def __init__(self, start, end, children=()):
        self.start, self.end, self.children = start, end, children


def by_thousand(source):
    """A toy syntax tree: one node for each thousand characters."""
    return Node(0, len(source), [Node(a, min(len(source), a + 1000)) for a in range(0, len(source), 1000)])


def broken(source):
    raise ValueError("no tree")


def test_parsers_plug_in(spark):
    text = "\n\n".join(f"def f{i}():\n    " + "x" * 700 for i in range(4))
    plain = chunking.chunk_spans(text, "python")
    config = EngineConfig(parsers=(("python", by_thousand),))
    spans = chunking.chunk_spans(text, "python", config, "a.py")
    assert spans == chunking.tree_spans(by_thousand(text), 1500) and spans != plain
    for parse in (broken, lambda s: None):
        assert chunking.chunk_spans(text, "python", EngineConfig(parsers=(("python", parse),)), "a.py") == plain
    config = EngineConfig(parsers=(("typescript", broken), (".tsx", by_thousand)))
    assert chunking.parser_for("src/a.TSX", "typescript", config) is by_thousand
    assert chunking.parser_for("src/a.ts", "typescript", config) is broken and chunking.parser_for("a.go", "go", config) is None
    rows = spark.createDataFrame([(0, "a.py", "python", text)], "file_seq long, file_path string, language string, content string")
    got = chunking.chunk_files(rows, EngineConfig(parsers=(("python", by_thousand),))).collect()
    assert [(r.span_start, r.span_start + len(r.content)) for r in got] == spans


def test_backslashes():
    assert [E.sanitize("a\\b", m) for m in ("preserve", "quad", "strip")] == ["a\\b", "a\\\\\\\\b", "a/b"]
    seen = []

    class Backend:
        model, dimensions = "x", 2

        def embed(self, texts):
            seen.extend(texts)
            return [np.ones(2)] * len(texts)

    E.embed_texts(Backend(), ["a\\b"], EngineConfig(backslashes="strip"))
    assert seen == ["a/b"]


def test_settings():
    assert strip_comments('{"a": "//x /* y", // c\n "b": \'/*\', /* d\n */ "e": "\\"//"}') == '{"a": "//x /* y", \n "b": \'/*\',  "e": "\\"//"}'
    assert strip_comments("/* open") == "" and strip_comments("'//open") == "'//open"
    given = {"A": "x", "B": "7.9", "C": "0", "D": " ", "E": "inf"}
    assert whole_number(given, ["A", "E", "B"], 3) == 7 and whole_number(given, ["C", "D", "Z"], 3) == 3 and whole_number(given, ["C"], least=0) == 0
    assert first_setting(given, ["D", "A"], "f") == "x" and first_setting(given, ["D"], "f") == "f"


def answers(*replies):
    """A transport that gives one reply after the other; numbers are errors."""
    left = list(replies)

    def send(payload):
        r = left.pop(0)
        if isinstance(r, int):
            raise E.HttpError(r, "no")
        if isinstance(r, Exception):
            raise r
        return r

    return send


def test_probe():
    def told(dims, *replies):
        p = E.probe(E.HttpEmbedder("http://x", "m", dims, send=answers(*replies), sleep=lambda s: None))
        return p.valid, p.status, p.dimensions

    good = {"data": [{"index": 0, "embedding": [1.0, 2.0]}]}
    assert told(2, good) == (True, 200, 2) and told(None, good) == (True, 200, 2)
    assert told(None, 503, good) == (True, 200, 2)
    assert told(3, good) == (False, 200, None)
    assert told(None, 401) == (False, 401, None) and "refused" in E.probe(E.HttpEmbedder("u", "m", send=answers(403))).message
    assert told(None, 404) == (False, 404, None) and told(None, {"data": []}) == (False, 200, None)
    assert told(None, {"what": 1}) == (False, 200, None) and told(None, OSError("down")) == (False, None, None)
    assert told(None, {"data": [{"index": 0, "embedding": []}]}) == (False, 200, None)


def test_profile_of_all_tasks(spark):
    rows = spark.createDataFrame([(i, "some text " * (i + 1)) for i in range(20)], "chunk_ord long, content string").repartition(5)
    told = E.embed_profile(rows, E.HashEmbedder(8)).first()
    assert told.texts == 20 and told.chars == sum(len("some text " * (i + 1)) for i in range(20)) and 0 < told.max_ms <= told.total_ms

    class Flaky(E.HttpEmbedder):
        def _post(self, payload):
            if self.stats["requests"] % 2 == 1:
                raise E.HttpError(429, "later")
            return {"data": [{"index": i, "embedding": [1.0, 0.0]} for i in range(len(payload["input"]))]}

    told = E.embed_profile(rows, Flaky("u", "m", sleep=time.sleep)).first()
    assert told.retries > 0 and told.requests == 2 * told.retries and told.errors == 0 and told.texts == 20


def test_vector_at(spark):
    rng = np.random.default_rng(0)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(5, 16)))] + [(9, [0.0] * 16)]
    held = vector.quantized(spark.createDataFrame(rows, "chunk_ord long, vector array<double>"))
    for r in held.select("chunk_ord", "codes", V.vector_at("codes", "scale").alias("v")).collect():
        c = np.array(r.codes, float)
        n = np.linalg.norm(c)
        assert np.allclose(r.v, c / n if n else c)


def test_best_rows_settle_ties_by_number():
    rng = np.random.default_rng(2)
    best, kept = vector._Best(3, 4), [[], [], []]
    for _ in range(6):
        ords = rng.permutation(1000)[:30] + 1000 * rng.integers(0, 9)
        dots = rng.integers(0, 4, (3, 30)).astype(float)
        best.add(0, dots, ords)
        for q in range(3):
            kept[q] += list(zip(-dots[q], ords.tolist(), strict=True))
    q, d, o = best.rows(0, 3)
    for i in range(3):
        assert sorted(zip(-d[q == i], o[q == i].tolist(), strict=True)) == sorted(kept[i])[:4]


def test_store_checks_dimensions_and_root(spark, tmp_path):
    root, folder = str(tmp_path / "repo"), str(tmp_path / "index")
    tree(root)
    index = SearchIndex.from_path(spark, root)
    assert index.file_status()["indexed"] == 2
    write(root, "src/none.ts", " \n")
    assert files.status_counts(files.read_files(files.listing(spark, root))).first().asDict() == {"indexed": 2, "empty_or_skipped": 1, "file_errors": 0}
    index.save(folder)
    fits = lambda **more: store.valid(spark, folder, "hash", ["code"], "int8", **more)
    assert fits(dimensions=256, root=root) and fits() and not fits(dimensions=64) and not fits(root=str(tmp_path))
    assert store.present(spark, folder, root)
    os.remove(f"{root}/src/auth.ts")
    assert not store.present(spark, folder, root) and not store.present(spark, folder, f"{root}/gone")
    missing = spark.createDataFrame([(0, "gone.ts", f"{root}/gone.ts", 0)], "file_seq long, file_path string, abs_path string, mtime_ms long")
    assert files.status_counts(files.read_files(missing)).first().file_errors == 1


def test_saving_to_the_cache_once(spark, tmp_path):
    root, cache = str(tmp_path / "repo"), str(tmp_path / "cache")
    tree(root)
    index = SearchIndex.from_path(spark, root)
    folder = f"{cache}/{store.cache_key(root)}"
    assert index.save_to_cache(cache) and store.versions(spark, folder) == [1]
    assert not index.save_to_cache(cache) and not SearchIndex.load(spark, folder).save_to_cache(cache)
    assert store.versions(spark, folder) == [1]
    write(root, "src/auth.ts", "export function login() {\n  return 2;\n}\n" + "// login\n" * 12)
    assert index.apply(["src/auth.ts"]) and store.versions(spark, folder) == [1, 2] and index.save_to_cache(cache)


def test_expand_answer(spark, tmp_path):
    root = str(tmp_path / "repo")
    tree(root)
    index = SearchIndex.from_path(spark, root)
    got = index.expand_payload(f"{root}/src/auth.ts", 2)
    assert (got["file_path"], got["line"], got["chunk_count"]) == ("src/auth.ts", 2, 1)
    assert got["anchor"] == got["chunks"][0] and got["anchor"]["absolute_path"] == f"{root}/src/auth.ts" and got["anchor"]["location"].startswith(f"{root}/src/auth.ts:1-")
    none = index.expand_payload("nope.ts", 3)
    assert none == {"file_path": "nope.ts", "line": 3, "chunk_count": 0, "anchor": None, "chunks": []}


def test_many_updates_keep_plans_short(spark, tmp_path):
    root = str(tmp_path / "repo")
    tree(root)
    index = SearchIndex.from_path(spark, root)
    size = lambda: max(len(t._jdf.queryExecution().optimizedPlan().toString()) for t in index.tables.values())
    sizes = []
    for i in range(4):
        write(root, "src/utils.ts", f"export function number{i}() {{\n  return {i};\n}}\n" + "// utils\n" * 12)
        assert index.apply(["src/utils.ts"])
        sizes.append(size())
    assert max(sizes) < 1.2 * sizes[0]
    assert index.search("number3", 1).first().file_path == "src/utils.ts" and index.tables["corpus"].first().n == 2
    # What was applied outlives the session.
    assert SearchIndex.load(spark, index.folder).search("number3", 1).first().file_path == "src/utils.ts"


def test_reading_what_was_written(spark, tmp_path):
    """`get` waits for the stream: a change made before it is in the answer."""
    root = str(tmp_path / "repo")
    tree(root)
    cache = IndexCache(spark, str(tmp_path / "cache"))
    try:
        cache.watch(root, str(tmp_path / "state"))
        write(root, "src/extra.ts", "export function reconcile(x) {\n return x;\n}\n" + "// extra\n" * 12)
        assert cache.get(root).search("reconcile", 1).first().file_path == "src/extra.ts"
    finally:
        cache.clear(root)
    assert not cache.streams and not cache.held


def grep(texts, words, context=2, lines=3):
    """The baseline by hand: file -> matches and the shown lines."""
    pattern = re.compile("|".join(map(re.escape, words)), re.I)
    out = {}
    for path, text in texts.items():
        n = len(pattern.findall(text))
        rows = text.split("\n")
        hits = [i for i, x in enumerate(rows) if pattern.search(x)][:lines]
        near = sorted({j for i in hits for j in range(i - context, i + context + 1) if 0 <= j < len(rows)})
        shown = []
        for k, j in enumerate(near):
            shown += ["--"] * (k > 0 and near[k - 1] < j - 1) + [f"{j + 1}{':' if j in hits else '-'}{rows[j]}"]
        if n:
            out[path] = (n, "\n".join(shown))
    return out


def test_grep_baseline(spark):
    rng = random.Random(1)
    vocab = ["the", "Router", "handle_request", "x-y", "plain", "text", "request", "over"]
    texts = {f"src/f{i}.ts": "\n".join(" ".join(rng.choice(vocab) for _ in range(3)) if rng.random() < 0.3 else "nothing" for _ in range(60)) for i in range(15)}
    chunks = []
    for path, text in texts.items():
        rows = text.split("\n")
        for a in range(0, len(rows), 20):
            chunks.append((path, a + 1, "\n".join(rows[a : a + 20])))
    frame = spark.createDataFrame(chunks, "file_path string, start_line int, content string")
    asked = {1: "where is the router for handle_request", 2: "x-y plain", 3: "of the", 4: "request REQUEST over", 5: ""}
    queries = spark.createDataFrame(list(asked.items()), "query_id long, text string")
    words = {r.query_id: list(r.w) for r in queries.select("query_id", evaluation.keywords(evaluation.F.col("text")).alias("w")).collect()}
    assert words == {1: ["handle_request", "router"], 2: ["plain", "x-y"], 3: [], 4: ["request", "over"], 5: []}
    ranked = evaluation.grep_rank(frame, queries, top_k=4, block=2)
    got = evaluation.grep_output(frame, ranked).collect()
    for q in asked:
        want = sorted((-n, path, shown) for path, (n, shown) in (grep(texts, words[q]) if words[q] else {}).items())[:4]
        mine = sorted((r["rank"], -r.matches, r.file_path, r.output) for r in got if r.query_id == q)
        assert [x[1:] for x in mine] == want and [x[0] for x in mine] == list(range(1, len(want) + 1))
    assert all(r.tokens == len(r.output) // 4 for r in got)


def test_quality_wins_and_overlap(spark):
    hits = spark.createDataFrame([(1, "a.ts", "has needle"), (1, "bad.ts", "x"), (2, "b.ts", "y")], "query_id long, file_path string, content string")
    specs = spark.createDataFrame([(1, ["bad.ts"], "needle"), (2, ["bad.ts"], "needle"), (3, [], None), (4, [], "z")], "query_id long, reject array<string>, needle string")
    got = {r.query_id: (r.false_positive, r.content_match) for r in evaluation.quality(hits, specs).collect()}
    assert got == {1: (True, True), 2: (False, False), 3: (False, True), 4: (False, False)}
    pairs = spark.createDataFrame([(0.5, 0.5004), (0.5, 0.6), (0.7, 0.1)], "a double, b double")
    assert evaluation.wins(pairs, "a", "b").first().asDict() == {"a_wins": 1, "b_wins": 1, "ties": 1}
    e = spark.createDataFrame([("f", 0, 10), ("f", 10, 30), ("g", 0, 5)], "file_path string, start int, end int")
    a = spark.createDataFrame([("f", 0, 20), ("f", 20, 30)], "file_path string, start int, end int")
    assert {r.file_path: r.overlap for r in evaluation.span_overlap(e, a).collect()} == pytest.approx({"f": 0.5, "g": 0.0})
