"""A cuckoo filter over 64-bit keys with deletion, vectorised.

Buckets of four 16-bit fingerprints; a key's second bucket is its first one xor a hash of the
fingerprint. A filter has layers: when one is full to `LOAD` the next keys open another, and prints
that find no slot within the allowed moves go to a layer of the same size, where their buckets have
the same numbers. So no key is ever lost and nothing has to be built anew. Deleting is sound only
for keys that were inserted, which the exact table tells.
"""

from __future__ import annotations

import numpy as np

from .text import U64, mix64

SLOTS = 4
LOAD = 0.85
MAX_MOVES = 64


class CuckooFilter:
    def __init__(self, keys: int = 0, layers: list[np.ndarray] | None = None, seed: int = 0):
        """`keys`: how many to make room for."""
        self.layers = layers or []
        self.used = [int(np.count_nonzero(x)) for x in self.layers]
        self.rng = np.random.default_rng(seed)
        if not self.layers:
            self._open(keys)

    @property
    def slots(self) -> int:
        return sum(x.size for x in self.layers)

    def _open(self, keys: int = 0, buckets: int = 0) -> int:
        n = buckets or 1 << max(1, int(np.ceil(np.log2(max(2, keys / (SLOTS * LOAD))))))
        self.layers.append(np.zeros((n, SLOTS), np.uint16))
        self.used.append(0)
        return len(self.layers) - 1

    def _room(self, layer: int) -> int:
        return int(self.layers[layer].size * LOAD) - self.used[layer]

    def reserve(self, keys: int) -> None:
        """Opens a layer for as many of `keys` as find no room in the others."""
        more = keys - sum(max(0, self._room(k)) for k in range(len(self.layers)))
        if more > 0:
            self._open(more)

    @staticmethod
    def _hashed(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = mix64(keys.astype(U64) ^ U64(0x5851F42D4C957F2D))
        prints = (h >> U64(48)).astype(np.uint16)
        prints[prints == 0] = 1
        return prints, h

    @staticmethod
    def _other(bucket: np.ndarray, prints: np.ndarray, buckets: int) -> np.ndarray:
        return bucket ^ (mix64(prints.astype(U64)) & U64(buckets - 1)).astype(np.int64)

    def _places(self, layer: int, prints: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(self.layers[layer])
        a = (h & U64(n - 1)).astype(np.int64)
        return a, self._other(a, prints, n)

    def contains(self, keys: np.ndarray) -> np.ndarray:
        prints, h = self._hashed(keys)
        out = np.zeros(len(keys), bool)
        for k, slots in enumerate(self.layers):
            a, b = self._places(k, prints, h)
            out |= ((slots[a] == prints[:, None]) | (slots[b] == prints[:, None])).any(1)
        return out

    def insert(self, keys: np.ndarray) -> None:
        """One print for each key, equal ones included."""
        prints, h = self._hashed(keys)
        self.reserve(len(keys))
        for k in range(len(self.layers)):
            take = max(0, min(len(prints), self._room(k)))
            if take:
                self._place(k, prints[:take], self._places(k, prints[:take], h[:take])[0])
                prints, h = prints[take:], h[take:]

    def _place(self, layer: int, prints: np.ndarray, at: np.ndarray) -> None:
        slots = self.layers[layer]
        n, given = len(slots), len(prints)
        prints, at = self._fill(slots, prints, at)
        if len(prints):  # the second bucket
            prints, at = self._fill(slots, prints, self._other(at, prints, n))
        for _ in range(MAX_MOVES):
            if not len(prints):
                break
            # One newcomer a bucket throws out a random print, which moves to its other bucket.
            _, one = np.unique(at, return_index=True)
            slot = self.rng.integers(0, SLOTS, len(one))
            thrown = slots[at[one], slot].copy()
            slots[at[one], slot] = prints[one]
            wait = np.ones(len(at), bool)
            wait[one] = False
            at = np.concatenate([at[wait], self._other(at[one], thrown, n)])
            prints = np.concatenate([prints[wait], thrown])
            prints, at = self._fill(slots, prints, at)
        self.used[layer] += given - len(prints)
        if len(prints):
            spare = [k for k in range(layer + 1, len(self.layers)) if len(self.layers[k]) == n and self._room(k) >= len(prints)]
            self._place(spare[0] if spare else self._open(buckets=n), prints, at)

    @staticmethod
    def _fill(slots: np.ndarray, prints: np.ndarray, bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Puts prints into free slots; returns print and bucket of those left over."""
        for slot in range(SLOTS):
            if not len(bucket):
                break
            free = slots[bucket, slot] == 0
            _, first = np.unique(np.where(free, bucket, -1), return_index=True)
            take = np.zeros(len(bucket), bool)
            take[first] = True
            take &= free
            slots[bucket[take], slot] = prints[take]
            bucket, prints = bucket[~take], prints[~take]
        return prints, bucket

    def delete(self, keys: np.ndarray) -> None:
        """Removes one print for each key, equal ones included; every key must be in the filter."""
        prints, h = self._hashed(keys)
        for k, slots in enumerate(self.layers):
            flat = slots.reshape(-1)
            while len(prints):
                a, b = self._places(k, prints, h)
                places = np.concatenate([a[:, None] * SLOTS + np.arange(SLOTS), b[:, None] * SLOTS + np.arange(SLOTS)], 1)
                there = flat[places] == prints[:, None]
                found = np.flatnonzero(there.any(1))
                if not len(found):
                    break
                # Of keys that want the same slot one gets it; the others look again.
                slot, own = np.unique(places[found, there[found].argmax(1)], return_index=True)
                flat[slot] = 0
                self.used[k] -= len(slot)
                left = np.ones(len(prints), bool)
                left[found[own]] = False
                prints, h = prints[left], h[left]

    def to_bytes(self) -> bytes:
        sizes = np.array([len(self.layers), *map(len, self.layers)], np.int64)
        return b"".join([sizes.tobytes(), *(x.tobytes() for x in self.layers)])

    @classmethod
    def from_bytes(cls, data: bytes) -> CuckooFilter:
        n = int(np.frombuffer(data, np.int64, 1)[0])
        sizes, at, layers = np.frombuffer(data, np.int64, n, 8).tolist(), 8 * (n + 1), []
        for size in sizes:
            layers.append(np.frombuffer(data, np.uint16, size * SLOTS, at).reshape(-1, SLOTS).copy())
            at += 2 * size * SLOTS
        return cls(layers=layers)

    @classmethod
    def of(cls, keys: np.ndarray) -> CuckooFilter:
        out = cls(len(keys))
        out.insert(keys)
        return out
