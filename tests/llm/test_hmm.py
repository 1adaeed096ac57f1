import math
import zlib

import numpy as np
import pytest

from tesserae.llm import hmm

from . import cases


def base(data):
    texts = [(d, cases.WORD.findall(cases.lower(t or "")) + [None]) for d, t, *_ in data]
    out = lambda d: d is not None and zlib.crc32(str(d).encode()) % 7 == 2
    counts = {}
    for d, words in texts:
        if not out(d):
            for w in words:
                counts[w] = counts.get(w, 0) + 1
    n, v = sum(counts.values()), len(counts)
    return [(d, out(d), len(words), sum(w in counts for w in words), n, sum(math.log10((counts.get(w, 0) + 1) / (n + v + 1)) for w in words)) for d, words in texts]


def check(rows, data):
    got = sorted(([r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score] for r in rows), key=repr)
    want = sorted((list(x) for x in base(data)), key=repr)
    assert len(got) == len(want)
    for g, w in zip(sorted(got, key=lambda x: (x[:5].__repr__(), x[5])), sorted(want, key=lambda x: (x[:5].__repr__(), x[5])), strict=True):
        assert g[:5] == w[:5] and g[5] == pytest.approx(w[5], rel=1e-9)


def random_model(rng, states=3, own=4, hashed=3):
    share = lambda *shape: (lambda x: x / x.sum(-1, keepdims=True))(rng.random(shape) + 0.05)
    words = np.sort(rng.integers(1, 1 << 63, own).astype(np.uint64))
    return hmm.Model(words, rng.integers(10, 50, hashed), rng.integers(1, 9, hashed), share(states), share(states, states), share(states, own + hashed + 1).T)


def enumerate_paths(model, obs):
    """Sums over all state paths: likelihood, expected transitions and states."""
    import itertools

    s = len(model.start)
    total, moves, states = 0.0, np.zeros((s, s)), np.zeros((len(obs), s))
    for path in itertools.product(range(s), repeat=len(obs)):
        p = model.start[path[0]] * model.emit[obs[0], path[0]]
        for t in range(1, len(obs)):
            p *= model.move[path[t - 1], path[t]] * model.emit[obs[t], path[t]]
        total += p
        for t, x in enumerate(path):
            states[t, x] += p
            if t:
                moves[path[t - 1], x] += p
    return total, moves / total, states / total


def test_recursions_against_all_paths():
    rng = np.random.default_rng(0)
    model = random_model(rng)
    texts = [rng.integers(0, 8, n) for n in (1, 4, 6, 2, 5)]
    first = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    obs = np.concatenate(texts)
    want = [enumerate_paths(model, t) for t in texts]
    expected = np.zeros((8, 3))
    for t, w in zip(texts, want, strict=True):
        for o, g in zip(t, w[2], strict=True):
            expected[o] += g
    for piece in (1, 2, 3, 256):  # texts of several pieces are one sequence
        sums = hmm.expected_counts(model, obs, first, piece)
        moves, emitted, starting, like = np.split(sums, np.cumsum([9, 24, 3]))
        assert like[0] == pytest.approx(sum(math.log10(w[0]) for w in want))
        assert hmm.likelihoods(model, obs, first, piece) == pytest.approx([math.log10(w[0]) for w in want])
        assert moves.reshape(3, 3) == pytest.approx(sum(w[1] for w in want))
        assert starting == pytest.approx(sum(w[2][0] for w in want))
        assert emitted.reshape(8, 3) == pytest.approx(expected)


def test_numbers_are_packed_in_as_few_bytes():
    for most in (0, 200, 60_000, 70_000, 1 << 25, 1 << 40):
        x = np.array([0, most // 3, most])
        assert hmm._numbers(hmm._least(x)).tolist() == x.tolist()
    assert len(hmm._least(np.array([70_000, 1]))) == 7 and not len(hmm._numbers(hmm._least(np.zeros(0, np.int64))))


def test_segments_cover_every_token():
    first = np.array([0, 1, 8, 8, 20])
    starts, sizes, begins = hmm.segments(first, 5)
    assert sorted(p for s, n in zip(starts, sizes, strict=True) for p in range(s, s + n)) == list(range(20))
    assert sorted(starts[begins].tolist()) == [0, 1, 8] and sizes.max() == 5


def test_training_takes_long_texts_whole():
    rng = np.random.default_rng(4)
    model = random_model(rng)
    sizes = [700, 3, 257]
    first = np.concatenate(([0], np.cumsum(sizes)))
    obs = rng.integers(0, 8, first[-1])
    want = np.zeros((3, 3))
    for a, b in zip(first[:-1], first[1:], strict=True):
        text = obs[a:b]
        alpha, beta = [model.start * model.emit[text[0]]], [np.ones(3)]
        for o in text[1:]:
            alpha.append(alpha[-1] / alpha[-1].sum() @ model.move * model.emit[o])
        for o in text[:0:-1]:
            beta.append(model.move @ (model.emit[o] * beta[-1] / beta[-1].sum()))
        for x, y, o in zip(alpha[:-1], beta[-2::-1], text[1:], strict=True):
            pair = x[:, None] * model.move * (model.emit[o] * y)
            want += pair / pair.sum()
    sums = hmm.expected_counts(model, obs, first)
    assert sums[:9].sum() == pytest.approx(sum(sizes) - len(sizes))  # a transition between any two words
    assert sums[:9].reshape(3, 3) == pytest.approx(want)
    assert sums[-1] == pytest.approx(hmm.likelihoods(model, obs, first).sum())


def test_rounds_raise_the_likelihood():
    rng = np.random.default_rng(2)
    model = random_model(rng)
    obs = np.concatenate([np.r_[rng.integers(0, 3, 30), 7] if i % 2 else np.r_[rng.integers(3, 7, 30), 7] for i in range(40)])
    first = np.arange(0, len(obs) + 1, 31)
    last = -np.inf
    for _ in range(8):
        sums = hmm.expected_counts(model, obs, first)
        assert sums[-1] > last - 0.5
        last, model = sums[-1], hmm._maximise(model, sums)
    assert last > hmm.expected_counts(random_model(rng), obs, first)[-1]


def test_probabilities_sum_to_one():
    """Over the own classes, the hashed ones with unseen words, and the end, after any text."""
    rng = np.random.default_rng(3)
    model = random_model(rng)
    assert model.emit.sum(0) == pytest.approx(1) and model.move.sum(1) == pytest.approx(1)
    for k in range(len(model.total)):
        counts = rng.multinomial(model.total[k] - model.kinds[k], np.full(model.kinds[k], 1 / model.kinds[k])) + 1
        words = np.full(len(counts), k, np.uint64)
        while (model.classes(words) != len(model.own) + k).any():
            words += np.uint64(1)
        assert (10 ** model.log_in_class(words, counts)).sum() + 10 ** model.log_in_class(words[:1], np.zeros(1))[0] == pytest.approx(1)


def test_fixture_against_brute_force(spark):
    data = [*cases.rows(), (None, "a null id"), *((i, f"Hash {i}") for i in range(5000, 5030))]
    rows = hmm.score(cases.frame(spark, data), rounds=2, own=20, hashed=8).collect()
    check(rows, data)
    assert all(r.score < 0 for r in rows)


def test_table_held_out_texts_score_above_unigrams(spark):
    docs = cases.table(spark, "sf0.01", "documents")
    rows = hmm.score(docs).collect()
    check(rows, [(r.doc_id, r.text) for r in docs.collect()])
    out = [r for r in rows if r.held_out]
    assert sum(r.score for r in out) > 0.97 * sum(r.base_score for r in out)
    again = {r.doc_id: r.score for r in hmm.score(docs.repartition(3)).collect()}
    assert all(again[r.doc_id] == pytest.approx(r.score, rel=1e-6) for r in rows)


def test_very_long_texts(spark):
    rng = np.random.default_rng(5)
    data = [(i, " ".join(f"w{x}" for x in rng.integers(0, 3000, n))) for i, n in enumerate([250_000, 5, 40, 700, 9])]
    rows = hmm.score(cases.frame(spark, data), rounds=2).collect()
    check(rows, data)
    assert all(math.isfinite(r.score) and r.score < 0 for r in rows)


def test_empty_and_untrained(spark):
    assert hmm.score(cases.frame(spark, [])).count() == 0
    lone = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    row = hmm.score(cases.frame(spark, [(lone, "never seen")])).first()
    assert row.held_out and row.train_tokens == 0 and row.n_known == 0 and row.base_score == 0 and math.isfinite(row.score)
