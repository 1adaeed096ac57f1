"""Language-model scoring with a hidden Markov model, trained by Baum-Welch over the whole corpus.

The model: latent states follow a Markov chain and emit word classes; a class emits a word by the
corpus-wide counts. Frequent words are classes of their own, all other words fall into classes by
hash, and one class ends each text. Both kinds grow with the input as its vocabulary does, with the
square root of the training tokens, up to `MAX_CLASSES` (reached at 17 billion tokens), so that the
model that is broadcast, and what a round brings back to the driver, stay below 10 MB. The counts
behind them are of every word of every training text at any size, and the probabilities of all texts
sum to one (one place per class is kept for words never seen).

1. Texts become arrays of word numbers, with each task's words and their counts, in the shared folder.
2. Words and counts meet in shards by hash, summed per task before; each task's words get their
   corpus-wide counts back. The vocabulary is never in one place. Shards are dealt to partitions by
   number, and there is a most of both, so what is shuffled grows with the input, not its square.
3. Each round, tasks run the forward-backward recursion over all training tokens, each text whole,
   and send one set of expected counts each, cut into ranges of classes; each range is summed as it
   streams through one task, so the driver gets one set.
4. A text's score is its exact log10 likelihood by the scaled forward recursion over all its words.

Null or empty text: just the end. A null id counts as a training text. Rows that repeat an id are
texts of their own. An empty table stays empty; without training texts every word is unseen.
Words are told apart by 64-bit hashes. Only doc_id and text are read, so other columns may have any
name; texts of any length are taken whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_first_column, keep, long_id, row_batch, setting, shuffles_removed
from .text import LOWER, U64, Words, raw, slices

STATES, ROUNDS = 4, 6
#: The least and most classes of either kind.
MIN_CLASSES, MAX_CLASSES = 512, 1 << 17
#: Added to each expected emission and transition.
SMOOTH = 0.1
SEED = 7
TASK_TOKENS = 300_000
STEP_TOKENS = 300_000
#: Words of a text that are taken a step at a time; longer texts are chained from such pieces.
PIECE = 256
SHARD_BYTES = 48 << 20
MAX_SHARDS, MAX_PARTITIONS = 1 << 16, 1 << 13
#: Numbers of a set of expected counts that are summed in one task.
RANGE = 1 << 12
#: Counts of words are told apart in steps of this ratio where the frequent ones are chosen.
COUNT_STEP = 1.02
BATCH_BYTES = "8m"


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("long").cast("string").cast("binary")) % 7 == 2, F.lit(False))


@dataclass
class Model:
    """`own`: sorted hashes of the words that are classes; `total`, `kinds`: training tokens and words of each hashed class."""

    own: np.ndarray
    total: np.ndarray
    kinds: np.ndarray
    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray  # class by state

    @property
    def end(self) -> int:
        return len(self.own) + len(self.total)

    def classes(self, words: np.ndarray) -> np.ndarray:
        out = len(self.own) + (words % U64(len(self.total))).astype(np.int64)
        if len(self.own):
            at = np.minimum(np.searchsorted(self.own, words), len(self.own) - 1)
            out = np.where(self.own[at] == words, at, out)
        return out

    def log_in_class(self, words: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """log10 probability of each word in its class."""
        c = self.classes(words) - len(self.own)
        at = np.maximum(c, 0)
        inside = np.log10(counts + 1) - np.log10(self.total[at] + self.kinds[at] + 1)
        return np.where(c < 0, 0.0, inside)


def segments(first: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and lengths of pieces of at most `length`, and whether each begins its text."""
    sizes = np.diff(first)
    pieces = -(-sizes // length)
    nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    starts = np.repeat(first[:-1], pieces) + nth * length
    return starts, np.minimum(length, np.repeat(first[1:], pieces) - starts), nth == 0


class _Pieces:
    """The texts in pieces that move together, a word of each at a step, with what reaches each piece from its neighbours.

    A piece of a text of several has a matrix: what it makes of any state before it. Chains of these matrices, a
    vector operation a piece, give the exact states before each piece (`prior`) and the weights after it (`after`),
    so a long text takes no more steps than a short one and is still one sequence."""

    def __init__(self, model: Model, obs: np.ndarray, first: np.ndarray, length: int):
        starts, sizes, begins = segments(first, length)
        n = len(starts)
        self.text = np.cumsum(begins) - 1  # of the texts that have words
        prior, after = np.tile(model.start, (n, 1)), np.ones((n, len(model.start)))
        heads = np.flatnonzero(begins)
        count = np.diff(np.append(heads, n))
        several = np.flatnonzero(np.repeat(count > 1, count))
        if len(several):
            matrix = np.zeros((n, len(model.start), len(model.start)))
            matrix[several] = self._matrices(model, obs, starts[several], sizes[several])
            for k in range(1, count.max()):
                at = heads[count > k] + k
                end = (prior[at - 1][:, None, :] @ matrix[at - 1])[:, 0, :]
                prior[at] = end / end.sum(1, keepdims=True) @ model.move
            for k in range(1, count.max()):
                at = heads[count > k] + count[count > k] - k
                ahead = (matrix[at] @ after[at][:, :, None])[:, :, 0] @ model.move.T
                after[at - 1] = ahead / ahead.sum(1, keepdims=True)
        self.order = np.argsort(-sizes, kind="stable")
        self.sizes, self.begins = sizes[self.order], begins[self.order]
        self.prior, self.after = prior[self.order], after[self.order]
        self.live = len(sizes) - np.searchsorted(self.sizes[::-1], np.arange(1, (self.sizes[0] if n else 0) + 1))
        self.cuts = np.concatenate(([0], np.cumsum(self.live)))
        # Positions step by step, so that a step is a slice; `nth`: the piece of each.
        self.nth = np.arange(self.cuts[-1]) - np.repeat(self.cuts[:-1], self.live)
        self.seen = obs[starts[self.order][self.nth] + np.repeat(np.arange(len(self.live)), self.live)]
        self.last = self.cuts[self.sizes - 1] + np.arange(n) if n else np.zeros(0, np.int64)
        self.steps = list(zip([0, *self.cuts[:-2].tolist()], self.cuts[:-1].tolist(), self.cuts[1:].tolist(), strict=True)) if n else []

    @staticmethod
    def _matrices(model: Model, obs: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The product over a piece's words of emissions and moves, scaled; sizes are the same but for texts' last pieces."""
        order = np.argsort(-sizes, kind="stable")
        starts, sizes = starts[order], sizes[order]
        live = len(sizes) - np.searchsorted(sizes[::-1], np.arange(1, sizes[0] + 1))
        s = len(model.start)
        out = np.zeros((len(sizes), s, s))
        out[:, range(s), range(s)] = model.emit[obs[starts]]
        for t, n in enumerate(live[1:].tolist(), 1):
            now = out[:n].reshape(n * s, s) @ model.move
            now = now.reshape(n, s, s) * model.emit[obs[starts[:n] + t]][:, None, :]
            out[:n] = now / now.sum((1, 2), keepdims=True) if t % 8 == 0 else now
        out /= out.sum((1, 2), keepdims=True)
        back = np.empty_like(out)
        back[order] = out
        return back

    def forward(self, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Emissions, scaled states and scales of all positions."""
        emit = model.emit[self.seen]
        alpha, scale = np.empty_like(emit), np.empty(len(emit))
        for before, a, b in self.steps:
            now = alpha[a:b]
            if a:
                np.matmul(alpha[before : before + b - a], model.move, out=now)
            else:
                now[:] = self.prior
            now *= emit[a:b]
            now.sum(1, out=scale[a:b])
            now /= scale[a:b, None]
        return emit, alpha, scale


def expected_counts(model: Model, obs: np.ndarray, first: np.ndarray, piece: int = PIECE) -> np.ndarray:
    """Expected transitions, emissions, starts and the log likelihood over the texts, each one sequence, as one flat array."""
    p = _Pieces(model, obs, first, piece)
    emit, alpha, scale = p.forward(model)
    beta = np.ones_like(emit)
    beta[p.last] = p.after / (alpha[p.last] * p.after).sum(1, keepdims=True)
    weight, back = emit / scale[:, None], np.ascontiguousarray(model.move.T)
    for before, a, b in reversed(p.steps[1:]):
        weight[a:b] *= beta[a:b]
        np.matmul(weight[a:b], back, out=beta[before : before + b - a])
    n = len(p.sizes)
    weight[:n] *= beta[:n]
    ahead = np.repeat(p.cuts[:-2], p.live[1:]) + p.nth[n:] if n else p.nth
    moves = alpha[ahead].T @ weight[n:]
    # From the last word of a piece to the first of the next.
    place = np.empty(n, np.int64)
    place[p.order] = np.arange(n)
    later = np.flatnonzero(~p.begins)
    moves += alpha[p.last[place[p.order[later] - 1]]].T @ weight[later]
    gamma = alpha * beta
    emitted = np.stack([np.bincount(p.seen, gamma[:, k], len(model.emit)) for k in range(len(model.start))], 1)
    return np.concatenate([(moves * model.move).ravel(), emitted.ravel(), gamma[:n][p.begins].sum(0), [np.log10(scale).sum()]])


def likelihoods(model: Model, obs: np.ndarray, first: np.ndarray, piece: int = PIECE) -> np.ndarray:
    """log10 likelihood of each text's classes, by the scaled forward recursion over the whole text."""
    p = _Pieces(model, obs, first, piece)
    scale = p.forward(model)[2]
    texts = np.flatnonzero(np.diff(first) > 0)
    out = np.zeros(len(first) - 1)
    out[texts] = np.bincount(p.text[p.order][p.nth], np.log10(scale), len(texts)) if len(texts) else 0
    return out


def _maximise(model: Model, counts: np.ndarray) -> Model:
    s, k = len(model.start), len(model.emit)
    moves, emitted, starting = np.split(counts[:-1], np.cumsum([s * s, k * s]))
    moves, emitted = moves.reshape(s, s) + SMOOTH, emitted.reshape(k, s) + SMOOTH
    share = lambda x: (x + SMOOTH) / (x + SMOOTH).sum()
    return Model(model.own, model.total, model.kinds, share(starting), moves / moves.sum(1, keepdims=True), emitted / emitted.sum(0))


_BATCH = pa.schema([("batch", pa.int64()), ("ids", pa.list_(pa.int64())), ("held", pa.binary()), ("sizes", pa.binary()), ("words", pa.binary()), ("counts", pa.binary()), ("tokens", pa.binary())])
_BATCH_SQL = "batch long, ids array<long>, held binary, sizes binary, words binary, counts binary, tokens binary"


def _least(x: np.ndarray) -> bytes:
    """One byte for the width, then the numbers in it."""
    most = int(x.max(initial=0))
    width = next(w for w in (1, 2, 3, 4, 8) if most < 1 << 8 * w)
    if width == 3:
        return bytes([3]) + np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3]).tobytes()
    return bytes([width]) + x.astype(f"<u{width}").tobytes()


def _numbers(data: bytes) -> np.ndarray:
    if data[0] != 3:
        return np.frombuffer(data, f"<u{data[0]}", offset=1)
    three = np.frombuffer(data, np.uint8, offset=1).reshape(-1, 3)
    return np.pad(three, ((0, 0), (0, 1))).view("<u4")[:, 0]


def _rows(batch: pa.RecordBatch) -> Iterator[tuple]:
    """Rows as Python values, one at a time: a row may hold megabytes."""
    for i in range(batch.num_rows):
        yield tuple(c[i].as_py() for c in batch.columns)


def _numbered(docs: DataFrame) -> DataFrame:
    """Rows of some hundred texts: their ids, sizes, distinct words (sorted hashes) with training counts, and word numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, held, sizes, hashes, n, k = [], [], [], [], 0, 0

        def row() -> pa.RecordBatch:
            size, out = np.concatenate(sizes), np.concatenate(held)
            words, tokens = np.unique(np.concatenate(hashes), return_inverse=True)
            counts = np.bincount(tokens[~np.repeat(out, size)], minlength=len(words))
            batch = (TaskContext.get().partitionId() << 32) + k
            return row_batch(_BATCH, batch=[batch], ids=[[x for part in ids for x in part]], held=[out.tobytes()], sizes=[size.astype("<i8").tobytes()], words=[words.tobytes()], counts=[_least(counts)], tokens=[_least(tokens)])

        for batch in batches:
            texts, doc_ids = raw(batch.column(1)), batch.column(0).to_pylist()
            out = np.array(batch.column(2).to_pylist(), bool)
            for a, b in slices(texts):
                w = Words(texts[a:b], LOWER)
                ids.append(doc_ids[a:b])
                held.append(out[a:b])
                sizes.append(w.counts())
                hashes.append(w.hashes())
                n += len(w.starts)
                if n >= TASK_TOKENS:
                    yield row()
                    ids, held, sizes, hashes, n, k = [], [], [], [], 0, k + 1
        if ids:
            yield row()

    return docs.select(long_id("doc_id"), "text", held_out().alias("held")).mapInArrow(run, _BATCH_SQL)


def _counted(numbered: DataFrame, shards: int, own: int, hashed: int) -> DataFrame:
    """Rows of two kinds: (batch, shard, counts) gives a batch its words' corpus-wide counts, in the order of the
    shard's words there; (null, shard, null, top, totals, kinds) has a shard's most frequent words and class sums."""
    entry = pa.schema([("shard", pa.int32()), ("batch", pa.int64()), ("words", pa.binary()), ("counts", pa.binary())])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for batch, words, counts in _rows(rows):
                words, counts = np.frombuffer(words, U64), _numbers(counts)
                if not len(words):
                    continue
                shard = (words % U64(shards)).astype(np.int64)
                order = np.argsort(shard, kind="stable")
                starts = np.flatnonzero(np.r_[True, np.diff(shard[order]) > 0])
                parts = np.split(order, starts[1:])
                yield row_batch(entry, shard=shard[order[starts]], batch=np.full(len(parts), batch), words=[words[p].tobytes() for p in parts], counts=[_least(counts[p]) for p in parts])

    schema = pa.schema([("batch", pa.int64()), ("shard", pa.int32()), ("counts", pa.binary()), ("top_words", pa.binary()), ("top_counts", pa.binary()), ("totals", pa.binary()), ("kinds", pa.binary())])

    def total(rows: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(rows)
        shard = table["shard"][0].as_py()
        lists = [np.frombuffer(x, U64) for x in table["words"].to_pylist()]
        words, at = np.unique(np.concatenate(lists), return_inverse=True)
        sums = np.bincount(at, np.concatenate([_numbers(x) for x in table["counts"].to_pylist()]), len(words)).astype(np.int64)
        ends = np.cumsum([len(x) for x in lists])
        for i, (batch, b) in enumerate(zip(table["batch"].to_pylist(), ends.tolist(), strict=True)):
            yield row_batch(schema, batch=[batch], shard=[shard], counts=[_least(sums[at[b - len(lists[i]) : b]])], top_words=[None], top_counts=[None], totals=[None], kinds=[None])
        best = np.lexsort((words, -sums))[:own]
        best = best[sums[best] > 0]
        cls = (words % U64(hashed)).astype(np.int64)
        n, v = np.bincount(cls, sums, hashed).astype(np.int64), np.bincount(cls[sums > 0], minlength=hashed).astype(np.int64)
        yield row_batch(schema, batch=[None], shard=[shard], counts=[None], top_words=[words[best].tobytes()], top_counts=[sums[best].tobytes()], totals=[n.tobytes()], kinds=[v.tobytes()])

    dealt = numbered.select("batch", "words", "counts").mapInArrow(deal, "shard int, batch long, words binary, counts binary")
    dealt = dealt.repartitionById(min(shards, MAX_PARTITIONS), "shard").sortWithinPartitions("shard")
    return dealt.mapInArrow(by_first_column(total), "batch long, shard int, counts binary, top_words binary, top_counts binary, totals binary, kinds binary")


def _training_size(numbered: DataFrame) -> tuple[int, int]:
    """Training tokens without ends, and training texts."""

    def sizes(batches):
        for rows in batches:
            held = [~np.frombuffer(x, bool) for x in rows.column(0).to_pylist()]
            size = [np.frombuffer(x, "<i8") for x in rows.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([int(s[h].sum()) for h, s in zip(held, size, strict=True)], pa.int64()), pa.array([int(h.sum()) for h in held], pa.int64())], names=["tokens", "texts"])

    told = numbered.select("held", "sizes").mapInArrow(sizes, "tokens long, texts long").agg(F.sum("tokens").alias("tokens"), F.sum("texts").alias("texts")).first()
    return told.tokens or 0, told.texts or 0


def _step(count: np.ndarray) -> np.ndarray:
    return np.floor(np.log(count) / np.log(COUNT_STEP)).astype(np.int64)


def _first_model(counted: DataFrame, ends: int, states: int, own: int, hashed: int) -> tuple[Model, int, int]:
    """The starting model, the training tokens and the distinct ones, ends included.

    The frequent words are those above a count that at most `own` words reach, found from a histogram."""
    told = counted.where("batch IS NULL")

    def numbers(batches, arrays):
        for rows in batches:
            for row in _rows(rows):
                for kind, at, n in arrays(*row):
                    for i in range(0, len(at), 50_000):
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at[i : i + 50_000]), kind, np.int8)), pa.array(at[i : i + 50_000].astype(np.int64)), pa.array(n[i : i + 50_000].astype(np.int64))], names=["kind", "at", "n"])

    def summed(*columns, arrays):
        found = told.select(*columns).mapInArrow(lambda b: numbers(b, arrays), "kind byte, at long, n long").groupBy("kind", "at").agg(F.sum("n").alias("n"))
        return found.toPandas()

    sums = summed("totals", "kinds", arrays=lambda n, v: [(0, np.arange(hashed), np.frombuffer(n, np.int64)), (1, np.arange(hashed), np.frombuffer(v, np.int64))])
    total, kinds = np.zeros(hashed, np.int64), np.zeros(hashed, np.int64)
    for kind, out in enumerate((total, kinds)):
        out[sums["at"][sums["kind"] == kind]] = sums["n"][sums["kind"] == kind]
    steps = summed("top_counts", arrays=lambda c: [(0, *np.unique(_step(np.frombuffer(c, np.int64)), return_counts=True))]).sort_values("at", ascending=False)
    fits = steps["at"][steps["n"].cumsum() <= own]
    least = int(fits.min()) if len(fits) else 1 << 40

    def frequent(words, counts):
        counts = np.frombuffer(counts, np.int64)
        often = _step(counts) >= least
        return [(0, np.frombuffer(words, np.int64)[often], counts[often])]

    best = summed("top_words", "top_counts", arrays=frequent)
    tokens, distinct = int(total.sum()) + ends, int(kinds.sum()) + (ends > 0)
    words, often = best["at"].to_numpy(np.int64).view(U64), best["n"].to_numpy(np.int64)
    order = np.argsort(words)
    words, often = words[order], often[order]
    at = (words % U64(hashed)).astype(np.int64)
    np.subtract.at(total, at, often)
    np.subtract.at(kinds, at, 1)
    rng = np.random.default_rng(SEED)
    mass = np.concatenate([often, total, [ends]]) + SMOOTH
    emit = mass[:, None] * np.exp(rng.normal(0, 1, (len(mass), states)))
    even = np.full(states, 1 / states)
    move = np.full((states, states), 0.2 / states) + 0.8 * np.eye(states)
    return Model(words, total, kinds, even, move, emit / emit.sum(0)), tokens, distinct


def _sequences(model: Model, words: bytes, sizes: np.ndarray, tokens: bytes, take: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Classes of the chosen texts' tokens, each text closed by the end, and where texts begin."""
    classes = model.classes(np.frombuffer(words, U64))[_numbers(tokens)]
    chosen = classes[np.repeat(take, sizes)]
    size = sizes[take]
    first = np.concatenate(([0], np.cumsum(size + 1)))
    obs = np.full(first[-1], model.end)
    obs[np.arange(len(chosen)) + np.repeat(np.arange(len(size)), size)] = chosen
    return obs, first


def train(numbered: DataFrame, model: Model, rounds: int = ROUNDS) -> Model:
    """Baum-Welch: each round over all training tokens; expected counts are summed by ranges of classes."""
    spark = numbered.sparkSession
    width = len(model.start) * (len(model.start) + len(model.emit) + 1) + 1
    ranges = -(-width // RANGE)
    schema = pa.schema([("range", pa.int32()), ("sums", pa.binary())])

    for _ in range(rounds):
        held = spark.sparkContext.broadcast(model)

        def expect(batches, held=held):
            now, sums = held.value, np.zeros(width)
            obs, firsts, n = [], [np.zeros(1, np.int64)], 0
            for rows in batches:
                for out, sizes, words, tokens in _rows(rows):
                    o, f = _sequences(now, words, np.frombuffer(sizes, "<i8"), tokens, ~np.frombuffer(out, bool))
                    obs.append(o)
                    firsts.append(f[1:] + n)
                    n += len(o)
                    if n >= STEP_TOKENS:
                        sums += expected_counts(now, np.concatenate(obs), np.concatenate(firsts))
                        obs, firsts, n = [], [np.zeros(1, np.int64)], 0
            if n:
                sums += expected_counts(now, np.concatenate(obs), np.concatenate(firsts))
            if sums.any():
                yield row_batch(schema, range=np.arange(ranges), sums=[sums[k * RANGE : (k + 1) * RANGE].astype(np.float32).tobytes() for k in range(ranges)])

        def add(batches):
            held: dict[int, np.ndarray] = {}
            for rows in batches:
                for k, part in _rows(rows):
                    held[k] = held.get(k, 0) + np.frombuffer(part, np.float32).astype(float)
            if held:
                yield row_batch(schema, range=list(held), sums=[x.tobytes() for x in held.values()])

        with shuffles_removed(spark):  # read when a query is made
            told = numbered.select("held", "sizes", "words", "tokens").mapInArrow(expect, "range int, sums binary").repartitionById(ranges, "range").mapInArrow(add, "range int, sums binary")
            parts = told.collect()
        sums = np.zeros(width)
        for r in parts:
            sums[r.range * RANGE : (r.range + 1) * RANGE] = np.frombuffer(r.sums)
        model = _maximise(model, sums)
        held.unpersist()
    return model


def score(docs: DataFrame, states: int = STATES, rounds: int = ROUNDS, own: int | None = None, hashed: int | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score; one row per document.

    `own`, `hashed`: classes of either kind, by default as many as the training tokens allow. Rows between the steps hold megabytes, so Arrow batches are kept small; the scores are written
    before this returns."""
    with setting(docs.sparkSession, "spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES):
        return keep(_scored(docs, states, rounds, own, hashed), "scores")


def _scored(docs: DataFrame, states: int, rounds: int, own: int | None, hashed: int | None) -> DataFrame:
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = min(MAX_SHARDS, max(8, -(-size // SHARD_BYTES)))
    numbered = keep(_numbered(docs), "numbered")
    n_words, n_texts = _training_size(numbered)
    classes = min(MAX_CLASSES, max(MIN_CLASSES, int(n_words**0.5)))
    own, hashed = own or classes, hashed or classes
    counted = keep(_counted(numbered, shards, own, hashed), "word-counts")
    model, n_train, distinct = _first_model(counted, n_texts, states, own, hashed)
    model = train(numbered, model, rounds)
    held = spark.sparkContext.broadcast(model)
    fields = [("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = held.value
        log_all = np.log10(n_train + distinct + 1)
        for rows in batches:
            for ids, out, sizes, words_held, tokens_held, replies in _rows(rows):
                words, sizes = np.frombuffer(words_held, U64), np.frombuffer(sizes, "<i8")
                counts = np.zeros(len(words), np.int64)
                shard = (words % U64(shards)).astype(np.int64)
                order, at = np.argsort(shard, kind="stable"), 0
                for told in sorted(replies or (), key=lambda r: r["shard"]):
                    reply = _numbers(told["counts"])
                    counts[order[at : at + len(reply)]] = reply
                    at += len(reply)
                tokens = _numbers(tokens_held)
                ends = np.concatenate(([0], np.cumsum(sizes)))
                per_text = lambda x: np.diff(np.concatenate(([0], np.cumsum(x[tokens])))[ends])  # noqa: B023, E731
                obs, first = _sequences(now, words_held, sizes, tokens_held, np.ones(len(sizes), bool))
                n = sizes + 1
                base = per_text(np.log10(counts + 1)) + np.log10(n_texts + 1) - n * log_all
                yield row_batch(
                    pa.schema(fields), doc_id=ids, held_out=np.frombuffer(out, bool), n_tokens=n, n_known=per_text((counts > 0).astype(np.int64)) + (n_texts > 0),
                    train_tokens=np.full(len(n), n_train), base_score=base, score=likelihoods(now, obs, first) + per_text(now.log_in_class(words, counts)),
                )

    replies = counted.where("batch IS NOT NULL").groupBy("batch").agg(F.collect_list(F.struct("shard", "counts")).alias("replies"))
    out = numbered.join(replies, "batch", "left").select("ids", "held", "sizes", "words", "tokens", "replies")
    return out.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
