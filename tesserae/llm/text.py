"""Vectorised tokenising and hashing shared by the text operators.

Everything here works on UTF-8 bytes: every separator of the word rules is ASCII, so a
byte-wise class table gives the same words as the code-point rule, and ``bytes.translate``
lower-cases A-Z and nothing else.

Hash of a word: polynomial in its bytes modulo 2**64, finished with a mixer; hash of a run of
words: Rabin-Karp polynomial in the word hashes, read off prefix sums.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_SPACES = bytes([9, 10, 11, 12, 13, 32])

#: `[^\x20\x09-\x0D]+`, letters as they are.
PLAIN = bytes(32 if b in _SPACES else b for b in range(256))
#: `[^\x20\x09-\x0D]+` after lower-casing A-Z.
LOWER = bytes(32 if b in _SPACES else b + 32 if 65 <= b <= 90 else b for b in range(256))
#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after lower-casing A-Z: ASCII letters, digits, all above 0x7F.
ALNUM = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

_BASE = 0x9E3779B97F4A7C15 | 1
#: Odd multipliers of the two independent run hashes.
RUN_BASES = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)


#: Bytes, and words, whose hashes are worked out at a time: what a worker keeps does not grow with its longest text.
_CHUNK, _CHUNK_WORDS = 1 << 20, 1 << 18


class _Powers:
    """Powers of an odd base and of its inverse modulo 2**64; tables of up to `_CHUNK` are kept."""

    def __init__(self, base: int):
        self.bases = U64(base), U64(pow(base, -1, 1 << 64))
        self.held = np.ones(1, U64), np.ones(1, U64)

    def _table(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        out = []
        for b in self.bases:
            a = np.full(size, b, U64)
            a[0] = 1
            out.append(np.multiply.accumulate(a))
        return out[0], out[1]

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > _CHUNK:  # one word that long
            return self._table(n)
        if len(self.held[0]) < n:
            self.held = self._table(1 << (n - 1).bit_length())
        return self.held[0][:n], self.held[1][:n]


_POWERS = {b: _Powers(b) for b in (_BASE, *RUN_BASES)}


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values (the finaliser of SplitMix64)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def raw(column: pa.Array) -> list[bytes]:
    """The texts' UTF-8 bytes, null as empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def slices(texts: list[bytes], most: int = 1 << 19) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts of about `most` bytes; one text may be longer, none is cut."""
    start = size = 0
    for i, t in enumerate(texts):
        if i > start and size + len(t) > most:
            yield start, i
            start, size = i, 0
        size += len(t) + 1
    if start < len(texts):
        yield start, len(texts)


class Words:
    """The words of some texts: byte spans in `data`, and each text's first word in `first`."""

    def __init__(self, texts: list[bytes], table: bytes):
        self.buf = (b" ".join(texts) + b" ").translate(table)
        self.data = np.frombuffer(self.buf, np.uint8)
        word = np.empty(len(self.data) + 1, np.int8)
        word[0] = 0
        word[1:] = self.data != 32
        step = np.diff(word)
        self.starts, self.ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        at = np.zeros(len(texts) + 1, np.int64)
        np.cumsum([len(t) + 1 for t in texts], out=at[1:])
        self.first = np.searchsorted(self.starts, at)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self) -> np.ndarray:
        out, a = np.empty(len(self.starts), U64), 0
        while a < len(out):
            lo = self.starts[a]
            b = max(a + 1, int(np.searchsorted(self.ends, lo + _CHUNK, "right")))
            start, end = self.starts[a:b] - lo, self.ends[a:b] - lo
            up, down = _POWERS[_BASE].get(int(end[-1]))
            sums = np.zeros(end[-1] + 1, U64)
            np.cumsum(self.data[lo : lo + end[-1]] * up, out=sums[1:])
            out[a:b] = mix64((sums[end] - sums[start]) * down[start] + (end - start).astype(U64))
            a = b
        return out


def run_hashes(words: np.ndarray, n: int, base: int = RUN_BASES[0]) -> np.ndarray:
    """Rabin-Karp hash of each run of `n` consecutive word hashes (the caller drops those that cross texts)."""
    out = np.empty(max(0, len(words) - n + 1), U64)
    for a in range(0, len(out), _CHUNK_WORDS):
        part = words[a : a + _CHUNK_WORDS + n - 1]
        up, down = _POWERS[base].get(len(part))
        sums = np.zeros(len(part) + 1, U64)
        np.cumsum(part * up, out=sums[1:])
        out[a : a + _CHUNK_WORDS] = mix64((sums[n:] - sums[:-n]) * down[: len(part) - n + 1])
    return out


def runs_within(first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Start positions of all runs of `n` words that stay in one text, and how many each text has."""
    counts = np.maximum(np.diff(first) - n + 1, 0)
    if not counts.sum():
        return np.zeros(0, np.int64), counts
    before = np.cumsum(counts) - counts
    return np.arange(counts.sum()) + np.repeat(first[:-1] - before, counts), counts
