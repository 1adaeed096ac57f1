import random

import numpy as np
import pytest

from tesserae.llm import decontam
from tesserae.llm.text import ALNUM, Words

from . import cases


def expected(docs, items):
    items = [(i, cases.ALNUM_WORD.findall(cases.lower(t or ""))) for i, t in items]
    windows = {}
    for item, words in items:
        for k in range(max(1, len(words) - 12) if words else 0):
            windows.setdefault(tuple(words[k : k + 13]), set()).add(item)
    out = []
    for doc_id, text in docs:
        words = cases.ALNUM_WORD.findall(cases.lower(text or ""))
        hit, found = set(), set()
        for n in {len(w) for w in windows}:
            for i in range(len(words) - n + 1):
                if own := windows.get(tuple(words[i : i + n])):
                    hit |= set(range(i, i + n))
                    found |= own
        ids = sorted(str(x) for x in found if x is not None)
        out.append((doc_id, len(words), len(hit), len(ids), cases.sha(",".join(ids)), bool(hit) and 20 * len(hit) >= len(words)))
    return out


def items(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_tables_against_brute_force(spark, sf):
    docs, bench = cases.table(spark, sf, "documents"), cases.table(spark, sf, "benchmark")
    want = expected([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in bench.collect()])
    assert any(w[5] for w in want)
    cases.same(decontam.digest(docs, bench), want)


@pytest.mark.parametrize(("block_words", "pass_bytes"), [(1, 1 << 27), (40, 1), (40, 1 << 27), (10**6, 1)])
def test_small_alphabet_and_blocks(spark, block_words, pass_bytes):
    rng = random.Random(5)
    say = lambda n: " ".join(rng.choice("abc") for _ in range(n))
    bench = [(i, say(rng.choice([1, 5, 9, 12, 13, 14, 30]))) for i in range(8, 16)] + [(3, None), (4, ""), (5, "..."), (20, "É b. C-a"), (21, "É b. C-a"), (30, say(14))]
    docs = [(i, say(rng.randint(0, 60))) for i in range(60)] + [(100, None), (101, ""), (102, "x É,B c!A x")]
    docs += [docs[3], (None, docs[4][1])]
    found = decontam.decontaminate(cases.frame(spark, docs), items(spark, bench), block_words=block_words, pass_bytes=pass_bytes)
    got = sorted(([r.doc_id, r.n_words, r.n_hit, len(r["items"]), r.contaminated] for r in found.collect()), key=repr)
    assert got == sorted(([w[0], w[1], w[2], w[3], w[5]] for w in expected(docs, bench)), key=repr)


def test_clean_keeps_columns_and_cuts(spark):
    passage = " ".join(f"w{i}" for i in range(20))
    docs = cases.frame(spark, [(1, passage), (2, "Clean, text."), (3, None), (4, f"Head {passage}, tail " + "x " * 900)])
    bench = items(spark, [(1, passage)])
    kept = decontam.clean(docs, bench)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [2, 3, 4]
    cut = {r.doc_id: r.text for r in decontam.clean(docs, bench, cut_spans=True).collect()}
    assert cut[4].startswith("Head , tail x") and cut[2] == "Clean, text." and cut[3] is None


@pytest.mark.parametrize(("block_words", "pass_bytes"), [(1, 1 << 27), (40, 1), (10**6, 1)])
def test_clean_joins_the_hits_of_all_blocks(spark, block_words, pass_bytes):
    rng = random.Random(6)
    say = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    one, two, long = say(13), say(13), say(30).split()
    overlapping = [" ".join(long[:20]), " ".join(long[10:])]
    bench = [(1, one), (2, two), (3, overlapping[0]), (4, overlapping[1]), (5, None)]
    docs = [
        (1, f"{say(100)} {one} {say(200)} {two} {say(80)}"),  # a thirtieth by either item, a fifteenth in all
        (2, f"{say(100)} {one} {say(300)}"),
        (3, f"{say(400)}, {' '.join(long)}! {say(400)}"),
        (4, f"{say(200)} {one} {two} {say(600)}"),
        (5, say(30)), (6, None), (7, ""), (None, two),
    ]
    frame, bench_frame = cases.frame(spark, docs), items(spark, bench)
    want = {w[0]: w for w in expected(docs, bench) if not w[5]}
    assert set(want) == {2, 3, 4, 5, 6, 7}
    kept = {r.doc_id: r.text for r in decontam.clean(frame, bench_frame, block_words=block_words, pass_bytes=pass_bytes).collect()}
    assert kept == {d: t for d, t in docs if d in want}
    cut = decontam.clean(frame, bench_frame, cut_spans=True, block_words=block_words, pass_bytes=pass_bytes)
    assert cut.columns == frame.columns
    cut = {r.doc_id: r.text for r in cut.collect()}
    assert set(cut) == set(want) and cut[6] is None
    for d, t in cut.items():
        assert len((t or "").split()) == want[d][1] - want[d][2] + (d == 3)  # the `!` stays, apart from its word
    assert not set(long) & set(cut[3].replace(",", " ").replace("!", " ").split())


def test_automaton_against_brute_force():
    """Random texts over few words, in pieces, against every window by hand; packing changes nothing."""
    rng = random.Random(9)
    say = lambda n: " ".join(rng.choice("abcd") for _ in range(n)).encode()
    for window in (2, 5, 13):
        bench = [(i, say(rng.randint(1, 40))) for i in range(12)]
        lists = [(i, Words([t], ALNUM).hashes()) for i, t in bench]
        whole = decontam.SuffixAutomaton.from_bytes(decontam.SuffixAutomaton.of(lists, window).to_bytes())
        split = [decontam.SuffixAutomaton.of(lists[k : k + 5], window) for k in (0, 5, 10)]
        texts = [say(rng.choice([0, 1, 7, 60, 900])) for _ in range(30)]
        windows = {}
        for i, t in bench:
            w = t.split()
            for k in range(max(1, len(w) - window + 1)):
                windows.setdefault(tuple(w[k : k + window]), set()).add(i)
        want_spans, want_items = [], []
        for t in texts:
            w, hit, found = t.split(), set(), set()
            for n in {len(x) for x in windows}:
                for k in range(len(w) - n + 1):
                    if own := windows.get(tuple(w[k : k + n])):
                        hit |= set(range(k, k + n))
                        found |= own
            edges = [k for k in range(len(w) + 1) if (k in hit) != (k - 1 in hit)]
            want_spans.append(edges)
            want_items.append(sorted(found))
        for held in ([whole], split):
            assert decontam.match(held, texts, window) == ([len(t.split()) for t in texts], want_spans, want_items)


def test_packed_size_and_a_long_text():
    rng = np.random.default_rng(0)
    words = rng.integers(0, 1 << 63, 60_000).astype(np.uint64)[rng.integers(0, 60_000, 120_000)]
    packed = decontam.SuffixAutomaton.of([(k, words[k * 100 : k * 100 + 100]) for k in range(1200)]).to_bytes()
    assert len(packed) < 100 * len(words)
    item = " ".join(f"w{k}" for k in range(40))
    one = decontam.SuffixAutomaton.of([(1, Words([item.encode()], ALNUM).hashes())])
    text = ("w7 w8 " * 200_000 + item + " w9" * 100_000).encode()
    assert decontam.match([one], [text])[1:] == ([[400_000, 400_040]], [[1]])


def test_empty_tables(spark):
    assert decontam.digest(cases.frame(spark, []), items(spark, [(1, "a")])).count() == 0
    assert not decontam.digest(cases.frame(spark, [(1, "a b")]), items(spark, [])).first().contaminated
    assert decontam.clean(cases.frame(spark, [(1, "a b")]), items(spark, [])).count() == 1
