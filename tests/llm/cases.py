"""Fixture rows and the contract's rules in plain Python, for brute-force comparison."""

import hashlib
import random
import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, __judged int, hash string, h long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def frame(spark, rows):
    """Rows (doc_id, text[, source]) with columns whose names the operators might use themselves."""
    return spark.createDataFrame([(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or ""), 1, "x", 7) for r in rows], SCHEMA)


def rows(seed=0, n=120):
    """Copies, near copies, shared lines and passages, odd separators, nulls, empty and long texts, repeated rows."""
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdefghiÉñß😀") for _ in range(rng.randint(1, 7))) for _ in range(400)]
    say = lambda k: " ".join(rng.choice(vocab) for _ in range(k))
    hot, passage = "The shared  Line of all " + say(6), say(60)
    out = []
    for i in range(n):
        kind = rng.random()
        lines = [say(rng.randint(1, 30)) for _ in range(rng.randint(1, 6))]
        if kind < 0.3 and out:
            text = rng.choice(out)[1] or ""
            if kind < 0.2:
                w = text.split(" ")
                for _ in range(max(1, len(w) // 40)):
                    w[rng.randrange(len(w))] = rng.choice(vocab)
                text = " ".join(w)
        else:
            if rng.random() < 0.4:
                lines.insert(rng.randrange(len(lines) + 1), rng.choice(["", "\t ", " \x0b"]) + hot + rng.choice(["", " \r", "\x0c"]))
            if rng.random() < 0.3:
                lines.insert(rng.randrange(len(lines) + 1), passage)
            text = "\n".join(lines)
        out.append((i * 3 + 1, text, rng.choice(["a", "a", "a", "b", "c", None])))
    out += [(1000, None, "a"), (1001, "", "b"), (1002, " \t\n", None), (1003, "one", "a"), (1004, "one two three", "c"), (1005, "one two three", "c"), (1006, "x\x00y z w " * 30, "a"), (1007, "aa bb " * 900, "b"), (1008, say(4000), "c"), out[5], out[5]]
    rng.shuffle(out)
    return out


def table(spark, sf, name):
    return spark.read.parquet(f"/root/testdata/{sf}/{name}.parquet")


def same(df, expected, key=None):
    """The rows of `df`, its first columns as in `expected`, in any order."""
    width = len(expected[0]) if expected else len(df.columns)
    got = sorted((tuple(r)[:width] for r in df.collect()), key=repr)
    want = sorted((tuple(r) for r in expected), key=repr)
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert g == w
