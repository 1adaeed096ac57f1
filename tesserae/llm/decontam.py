"""Benchmark decontamination with generalised suffix automata of the test items.

The words of the items go into suffix automata, built in tasks from blocks of about `block_words`
words and held as flat arrays of at most some 100 bytes a word. A document's words are streamed
through them; a state holds the longest suffix that some item contains, so a window ends at a word
as soon as that length reaches the window's. No shuffle: automata are broadcast, as many at a time
as `pass_bytes` hold, and all of them read the documents in one scan. Only a benchmark of more than
about a million words takes another scan, so what is broadcast has a bound however large it grows.

All words that a batch of documents has at the same place of a run move together, one array
operation a place. Runs are cut into pieces that overlap by a window less a word, so one long text
makes no long chain of steps, and no window is lost. Words are told apart by 64-bit hashes.

Nulls: a null or empty text has no words and is never contaminated; a null item text has no
window; an item with a null id counts for hits but is named in no list. Repeated rows are judged
one by one; items with equal text are each counted; rows of one item_id count once. Texts and items
of any length are taken whole. An empty benchmark hits nothing, and an empty table stays empty.
`clean` carries all columns, whatever their names; the others read doc_id and text only.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, keep, long_id, row_batch
from .text import ALNUM, U64, Words, raw, slices

WINDOW = 13
BLOCK_WORDS = 250_000
PASS_BYTES = 128 << 20
#: Words that go through the automata in one piece.
PIECE = 256
#: A document goes if its hit words are at least one in so many of its words.
COVERAGE = 20


class SuffixAutomaton:
    """All runs of words of some items, as flat arrays.

    words: sorted hashes, whose places are the symbols; keys, targets: transitions by state * len(words)
    + symbol, sorted; link, length: suffix links and longest runs of states. A mark is a window that
    ends in a state: its words (`size`), its items (`items` from `at` on), and the next shorter mark on
    the suffix path (`up`); `top`: each state's longest mark, its own or from further up, or -1."""

    FIELDS = (("words", np.uint64), ("keys", np.int64), ("targets", np.int32), ("link", np.int32), ("length", np.int32), ("top", np.int32), ("size", np.int32), ("up", np.int32), ("at", np.int32), ("items", np.int64))

    def __init__(self, **arrays: np.ndarray):
        for name, kind in self.FIELDS:
            setattr(self, name, arrays[name].astype(kind, copy=False))
        self.least = int(self.size.min(initial=1 << 30))

    @classmethod
    def of(cls, items: list[tuple[int | None, np.ndarray]], window: int = WINDOW) -> SuffixAutomaton:
        """Of items: id, hashes of words. The automaton of Blumer et al., a word at a time."""
        lists = [h for _, h in items]
        words, symbols = np.unique(np.concatenate(lists) if lists else np.zeros(0, U64), return_inverse=True)
        v, go = len(words), {}
        link, length = array("i", [-1]), array("i", [0])
        head, later, symbol = array("i", [-1]), array("i"), array("i")  # a state's transitions, as a chain

        def state(n: int) -> int:
            link.append(0)
            length.append(n)
            head.append(-1)
            return len(link) - 1

        def lead(p: int, c: int, q: int) -> None:
            if p * v + c not in go:
                later.append(head[p])
                symbol.append(c)
                head[p] = len(later) - 1
            go[p * v + c] = q

        def split(p: int, q: int, c: int) -> int:
            """The state of the runs of q that end in p's: q itself, or a copy that takes the shorter ones over."""
            if length[q] == length[p] + 1:
                return q
            new, e = state(length[p] + 1), head[q]
            while e >= 0:
                lead(new, symbol[e], go[q * v + symbol[e]])
                e = later[e]
            link[new], link[q] = link[q], new
            while p >= 0 and go.get(p * v + c) == q:
                go[p * v + c] = new
                p = link[p]
            return new

        ends: dict[int, dict[int, set]] = {}
        at = 0
        for item, hashes in items:
            last, n = 0, len(hashes)
            for k, c in enumerate(symbols[at : at + n].tolist(), 1):
                q = go.get(last * v + c)
                if q is not None:  # another item has this run
                    last = split(last, q, c)
                else:
                    new, p = state(length[last] + 1), last
                    while p >= 0 and p * v + c not in go:
                        lead(p, c, new)
                        p = link[p]
                    if p >= 0:
                        link[new] = split(p, go[p * v + c], c)
                    last = new
                if k >= window or k == n:
                    ends.setdefault(last, {}).setdefault(min(k, window), set()).add(item)
            at += n
        # The state that holds a window of n words: the ancestor whose lengths include n.
        owners: dict[int, dict[int, set]] = {}
        for s, by_size in ends.items():
            for n, found in by_size.items():
                t = s
                while length[link[t]] >= n:
                    t = link[t]
                owners.setdefault(t, {}).setdefault(n, set()).update(found)
        top, size, up, starts, ids = np.full(len(link), -1, np.int32), [], [], [0], []
        for s in np.argsort(np.frombuffer(length, np.int32), kind="stable").tolist():
            mark = int(top[link[s]]) if s else -1
            for n in sorted(owners.get(s, ())):
                size.append(n)
                up.append(mark)
                ids += sorted(x for x in owners[s][n] if x is not None)
                starts.append(len(ids))
                mark = len(size) - 1
            top[s] = mark
        keys, targets = np.fromiter(go.keys(), np.int64, len(go)), np.fromiter(go.values(), np.int32, len(go))
        order = np.argsort(keys)
        return cls(words=words, keys=keys[order], targets=targets[order], link=np.array(link), length=np.array(length), top=top, size=np.array(size), up=np.array(up), at=np.array(starts), items=np.array(ids, np.int64))

    def to_bytes(self) -> bytes:
        arrays = [getattr(self, name) for name, _ in self.FIELDS]
        return b"".join([np.array([len(x) for x in arrays], np.int64).tobytes(), *(x.tobytes() for x in arrays)])

    @classmethod
    def from_bytes(cls, data: bytes) -> SuffixAutomaton:
        sizes, at, out = np.frombuffer(data, np.int64, len(cls.FIELDS)), 8 * len(cls.FIELDS), {}
        for n, (name, kind) in zip(sizes.tolist(), cls.FIELDS, strict=True):
            out[name] = np.frombuffer(data, kind, n, at)
            at += n * np.dtype(kind).itemsize
        return cls(**out)

    def _step(self, states: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """Where the transitions lead, or -1."""
        wanted = states.astype(np.int64) * len(self.words) + symbols
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, self.targets[at], -1)

    def ends(self, hashes: np.ndarray, first: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
        """Of the words of some texts, of which `first` are the starts: those at which windows end, and the longest one's mark."""
        none = np.zeros(0, np.int64)
        if not len(self.size) or not len(hashes):
            return none, none
        symbols = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
        known = np.zeros(len(hashes) + 2, np.int8)
        known[1:-1] = self.words[symbols] == hashes
        # Words of no item, and ends of texts, end every run.
        starts = np.flatnonzero(np.diff(known) == 1)
        ends = np.flatnonzero(np.diff(known) == -1)
        inner = first[1:-1]
        inner = inner[(inner > 0) & (inner < len(hashes))]
        inner = np.unique(inner[(known[inner] == 1) & (known[inner + 1] == 1)])
        starts, ends = np.sort(np.concatenate([starts, inner])), np.sort(np.concatenate([ends, inner]))
        long = ends - starts >= self.least
        starts, ends = starts[long], ends[long]
        pieces = np.maximum(1, -(-(ends - starts - (window - 1)) // PIECE))
        nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        starts, ends = np.repeat(starts, pieces) + nth * PIECE, np.repeat(ends, pieces)
        sizes = np.minimum(ends - starts, PIECE + window - 1)
        order = np.argsort(-sizes, kind="stable")
        starts, sizes = starts[order], sizes[order]
        live = len(sizes) - np.searchsorted(sizes[::-1], np.arange(1, (sizes[0] if len(sizes) else 0) + 1))
        state, matched = np.zeros(len(sizes), np.int32), np.zeros(len(sizes), np.int32)
        found_at, found = [], []
        for t, n in enumerate(live.tolist()):
            s, m, c = state[:n], matched[:n], symbols[starts[:n] + t]
            to = self._step(s, c)
            lost = np.flatnonzero(to < 0)
            while len(lost):  # a known word leads somewhere from the root at the latest
                s[lost] = self.link[s[lost]]
                m[lost] = self.length[s[lost]]
                to[lost] = self._step(s[lost], c[lost])
                lost = lost[to[lost] < 0]
            s[:] = to
            m += 1
            mark = self.top[to]
            hit = np.flatnonzero(mark >= 0)
            mark = mark[hit]
            while len(short := np.flatnonzero(self.size[mark] > m[hit])):
                mark[short] = self.up[mark[short]]
                stay = mark >= 0
                hit, mark = hit[stay], mark[stay]
            if len(hit):
                found_at.append(starts[hit] + t)
                found.append(mark)
        return (np.concatenate(found_at), np.concatenate(found)) if found else (none, none)

    def items_of(self, mark: int) -> set[int]:
        """The items of a window and of all shorter ones that end with it."""
        out: set[int] = set()
        while mark >= 0:
            out.update(self.items[self.at[mark] : self.at[mark + 1]].tolist())
            mark = int(self.up[mark])
        return out


def match(automata: list[SuffixAutomaton], texts: list[bytes], window: int = WINDOW) -> tuple[list[int], list[list[int]], list[list[int]]]:
    """Of each text: its words, the spans (flat starts and ends) of words inside occurrences of windows, and their items."""
    n_words, spans, items = [], [], []
    for a, b in slices(texts):
        words = Words(texts[a:b], ALNUM)
        hashes, first = words.hashes(), words.first
        cover = np.zeros(len(hashes) + 1, np.int64)
        found: list[set[int]] = [set() for _ in range(b - a)]
        for automaton in automata:
            at, mark = automaton.ends(hashes, first, window)
            np.add.at(cover, at + 1 - automaton.size[mark], 1)
            np.subtract.at(cover, at + 1, 1)
            text = np.searchsorted(first, at, "right") - 1
            known: dict[int, set[int]] = {}
            for k in np.unique(text * len(automaton.size) + mark).tolist() if len(at) else ():
                i, m = divmod(k, len(automaton.size))
                if m not in known:
                    known[m] = automaton.items_of(m)
                found[i] |= known[m]
        hit = np.zeros(len(hashes) + 2, np.int8)
        hit[1:-1] = np.cumsum(cover)[:-1] > 0
        starts, ends = np.flatnonzero(np.diff(hit) == 1), np.flatnonzero(np.diff(hit) == -1)
        inner = first[1:-1]
        inner = np.unique(inner[(inner > 0) & (inner < len(hashes))])
        inner = inner[(hit[inner] == 1) & (hit[inner + 1] == 1)]  # a text's hit end beside the next one's hit start
        starts, ends = np.sort(np.concatenate([starts, inner])), np.sort(np.concatenate([ends, inner]))
        cuts = np.searchsorted(starts, first)
        for i in range(b - a):
            own = slice(cuts[i], cuts[i + 1])
            spans.append((np.stack([starts[own], ends[own]], 1) - first[i]).ravel().tolist())
            items.append(sorted(found[i]))
        n_words += words.counts().tolist()
    return n_words, spans, items


def automata(benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """payload: one packed automaton per block of items; longer items are cut into overlapping pieces."""
    given = benchmark.select(long_id("item_id"), "text")
    size = given.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    schema = pa.schema([("payload", pa.binary())])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, n = [], 0
        pack = lambda b: row_batch(schema, payload=[SuffixAutomaton.of(b, window).to_bytes()])
        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), raw(batch.column(1)), strict=True):
                h = Words([text], ALNUM).hashes()
                for s in range(0, max(1, len(h) - window + 1), block_words) if len(h) else ():
                    piece = h[s : s + block_words + window - 1]
                    block.append((item, piece))
                    n += len(piece)
                    if n >= block_words:
                        yield pack(block)
                        block, n = [], 0
        if block:
            yield pack(block)

    return keep(given.repartition(max(1, size // (6 * block_words))).mapInArrow(build, "payload binary"), "automata")


def passes(benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS, pass_bytes: int = PASS_BYTES) -> Iterator[list[bytes]]:
    """The packed automata, `pass_bytes` at a time (one at least); one empty pass if there are none."""
    built = automata(benchmark, window, block_words)
    held, size, any_yet = [], 0, False
    for row in built.toLocalIterator():
        if held and size + len(row.payload) > pass_bytes:
            yield held
            held, size, any_yet = [], 0, True
        held.append(bytes(row.payload))
        size += len(row.payload)
    if held or not any_yet:
        yield held
    forget(built)


def matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """doc_id, n_words, spans (flat starts and ends of hit words, merged), items (sorted ids), one row per document."""
    spark = docs.sparkSession
    parts = []
    for packed in passes(benchmark, window, block_words, pass_bytes):
        held = spark.sparkContext.broadcast(packed)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            own = [SuffixAutomaton.from_bytes(x) for x in held.value]
            schema = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("n_words", pa.int64()), ("spans", pa.list_(pa.int64())), ("items", pa.list_(pa.int64()))])
            for batch in batches:
                n, spans, items = match(own, raw(batch.column(1)), window)
                yield row_batch(schema, doc_id=batch.column(0), text_key=batch.column(2), n_words=n, spans=spans, items=items)

        parts.append(docs.select(long_id("doc_id"), "text", F.xxhash64("text").alias("text_key")).mapInArrow(run, "doc_id long, text_key long, n_words long, spans array<long>, items array<long>"))
    if len(parts) == 1:
        return parts[0].drop("text_key")
    # Several passes: a document's spans and items are joined from those passes that hit it.
    merged = [keep(p, "decontam") for p in parts]
    hits = merged[0].where(F.size("spans") > 0)
    for p in merged[1:]:
        hits = hits.unionByName(p.where(F.size("spans") > 0))
    joined = hits.groupBy("doc_id", "text_key").agg(F.collect_list("spans").alias("s"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    joined = joined.select("doc_id", "text_key", _merge_spans("s").alias("spans"), "items")
    none = F.array().cast("array<long>")
    return (
        merged[0]
        .select("doc_id", "text_key", "n_words")
        .alias("d")
        .join(joined.alias("h"), F.col("d.doc_id").eqNullSafe(F.col("h.doc_id")) & (F.col("d.text_key") == F.col("h.text_key")), "left")
        .select("d.doc_id", "d.n_words", F.coalesce("h.spans", none).alias("spans"), F.coalesce("h.items", none).alias("items"))
    )


def _union(parts) -> list[int]:
    """Flat starts and ends of what the spans of all parts cover, those that touch merged."""
    out: list[int] = []
    for a, b in sorted((int(p[i]), int(p[i + 1])) for p in parts for i in range(0, len(p), 2)):
        if out and a <= out[-1]:
            out[-1] = max(out[-1], b)
        else:
            out += [a, b]
    return out


def _merge_spans(column: str):
    @F.pandas_udf("array<long>")
    def merge(lists):
        return lists.map(_union)

    return merge(column)


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, coverage: int = COVERAGE, block_words: int = BLOCK_WORDS, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """`matches` with n_hit and the verdict: contaminated if any word is hit and coverage * n_hit >= n_words."""
    n_hit = F.aggregate(F.sequence(F.lit(0), F.greatest(F.size("spans") / 2 - 1, F.lit(0)).cast("int")), F.lit(0).cast("long"), lambda a, i: a + F.coalesce(F.get("spans", 2 * i + 1) - F.get("spans", 2 * i), F.lit(0)))
    found = matches(docs, benchmark, window, block_words, pass_bytes).withColumn("n_hit", n_hit)
    return found.withColumn("contaminated", (F.col("n_hit") > 0) & (coverage * F.col("n_hit") >= F.col("n_words")))


def digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The columns of the query: counts, and the SHA-256 of the item ids sorted as strings."""
    ids = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return decontaminate(docs, benchmark).select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(ids.cast("binary"), 256).alias("items_sha256"), "contaminated")


def clean(docs: DataFrame, benchmark: DataFrame, cut_spans: bool = False, window: int = WINDOW, coverage: int = COVERAGE, block_words: int = BLOCK_WORDS, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """The rows of `docs`, all columns, that are not contaminated. With `cut_spans`, hit words of the kept ones go too.

    The spans found so far are a column of the row itself, so nothing is joined or shuffled; each
    pass of automata adds its own to them, and rows are judged and cut once, after the last pass."""
    spark, out = docs.sparkSession, docs
    if docs.isEmpty():
        return docs
    name = "__judged"
    while name in out.columns:
        name += "_"
    for k, packed in enumerate(passes(benchmark, window, block_words, pass_bytes)):
        out = keep(out, "decontam") if k else out  # one pass's automata in a worker at a time
        held = spark.sparkContext.broadcast(packed)

        @F.pandas_udf("hit long, words long, spans array<long>")
        def judge(texts, before, held=held):
            import pandas as pd

            own, rows = [SuffixAutomaton.from_bytes(x) for x in held.value], []
            for n, spans, old in zip(*match(own, [(t or "").encode() for t in texts], window)[:2], before, strict=True):
                spans = _union([spans, old]) if old is not None and len(old) else spans
                rows.append((sum(spans[1::2]) - sum(spans[::2]), n, spans))
            return pd.DataFrame(rows, columns=["hit", "words", "spans"])

        out = out.withColumn(name, judge("text", F.col(f"{name}.spans") if k else F.lit(None).cast("array<long>")))
    hit, words = F.col(f"{name}.hit"), F.col(f"{name}.words")
    out = out.where(~((hit > 0) & (coverage * hit >= words)))
    if cut_spans:

        @F.pandas_udf("string")
        def cut(texts, spans):
            import pandas as pd

            pairs = [list(zip(s[::2], s[1::2], strict=True)) for s in spans]
            return pd.Series([_cut(t.encode(), p).decode() if p and t is not None else t for t, p in zip(texts, pairs, strict=True)], dtype=object)

        out = out.withColumn("text", cut("text", F.col(f"{name}.spans")))
    return out.drop(name)


def _cut(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    mapped = np.frombuffer(text.translate(ALNUM), np.uint8)
    word = np.zeros(len(mapped) + 2, np.int8)
    word[1:-1] = mapped != 32
    step = np.diff(word)
    starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    out, at = [], 0
    for a, b in spans:
        out.append(text[at : starts[a]])
        at = int(ends[b - 1])
    return b"".join([*out, text[at:]])



_SQL_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE_SQL = f"""
WITH b AS (SELECT item_id, ws, least(13, len(ws)) AS n FROM (SELECT item_id, {_SQL_WORDS} AS ws FROM benchmark) WHERE len(ws) > 0),
bw AS (SELECT DISTINCT item_id, n, array_to_string(ws[i:i + n - 1], ' ') AS k FROM (SELECT item_id, n, ws, unnest(range(1, len(ws) - n + 2)) AS i FROM b)),
d AS (SELECT doc_id, {_SQL_WORDS} AS ws FROM documents),
dw AS (SELECT doc_id, n, i, array_to_string(ws[i:i + n - 1], ' ') AS k FROM (SELECT doc_id, n, ws, unnest(range(1, len(ws) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw))),
m AS (SELECT doc_id, i, dw.n, item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.k = bw.k),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM m) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN h ON d.doc_id = h.doc_id LEFT JOIN t ON d.doc_id = t.doc_id
"""
