"""A minimal perfect hash over pairs of 64-bit hashes, and the arrays that it indexes, as numpy arrays.

Level by level (Limasset et al. 2017), every key left is hashed to twice as many bits as there are keys left; a key that
is alone at its bit stays there, the others go on. A key's number is the rank of its bit over all levels.
"""

from __future__ import annotations

import numpy as np

_U = np.uint64
_ODD = 0x9E3779B97F4A7C15


def _hash(a: np.ndarray, b: np.ndarray, level: int) -> np.ndarray:
    x = a + _U((level + 1) * _ODD % (1 << 64))
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9) ^ b
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class LineIndex:
    """Fingerprint (the second hash), count and first document of each key (h1, h2), by the key's number."""

    def __init__(self, sizes: np.ndarray, bits: np.ndarray, fingerprint: np.ndarray, count: np.ndarray, first: np.ndarray):
        self.sizes, self.bits, self.fingerprint, self.count, self.first = sizes, bits, fingerprint, count, first
        ones = np.bitwise_count(bits).astype(np.int64)
        self.before = np.cumsum(ones) - ones

    @classmethod
    def build(cls, h1: np.ndarray, h2: np.ndarray, count: np.ndarray, first: np.ndarray) -> LineIndex:
        """An index of distinct pairs (uint64)."""
        sizes, words, a, b = [], [], h1, h2
        while len(a):
            n = 64 * (1 + 2 * len(a) // 64)
            at = (_hash(a, b, len(sizes)) % _U(n)).astype(np.int64)
            alone = np.bincount(at, minlength=n)[at] == 1
            bits = np.zeros(n, np.uint8)
            bits[at[alone]] = 1
            sizes.append(n)
            words.append(np.packbits(bits, bitorder="little").view(np.uint64))
            a, b = a[~alone], b[~alone]
        none = np.zeros(0, np.uint64)
        index = cls(np.array(sizes, np.int64), np.concatenate(words or [none]), *(np.zeros(len(h1), t) for t in (np.uint64, np.uint32, np.int64)))
        at = index.number(h1, h2)
        index.fingerprint[at], index.first[at] = h2, first
        index.count[at] = np.minimum(count, 0xFFFFFFFF)
        return index

    def number(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """The number of each pair; any number or -1 for a pair that isn't in the index."""
        out = np.full(len(h1), -1, np.int64)
        left, offset = np.arange(len(h1)), 0
        for level, n in enumerate(self.sizes):
            if not len(left):
                break
            at = (_hash(h1[left], h2[left], level) % _U(n)).astype(np.int64) + offset
            word, bit = self.bits[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit & _U(1)).astype(bool)
            below = np.bitwise_count(word & ((_U(1) << bit) - _U(1))).astype(np.int64)
            out[left[hit]] = (self.before[at >> 6] + below)[hit]
            left, offset = left[~hit], offset + int(n)
        return out

    def probe(self, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Whether each pair is in the index, and its count and first document (0 for others)."""
        at = self.number(h1, h2)
        found = at >= 0
        found[found] = self.fingerprint[at[found]] == h2[found]
        count, first = np.zeros(len(h1), np.uint32), np.zeros(len(h1), np.int64)
        count[found], first[found] = self.count[at[found]], self.first[at[found]]
        return found, count, first

    def to_bytes(self) -> bytes:
        parts = (self.sizes, self.bits, self.fingerprint, self.count, self.first)
        return np.array([len(p) for p in parts], np.int64).tobytes() + b"".join(p.tobytes() for p in parts)

    @classmethod
    def from_bytes(cls, data: bytes) -> LineIndex:
        lengths, at, parts = np.frombuffer(data, np.int64, 5), 40, []
        for n, kind in zip(lengths, (np.int64, np.uint64, np.uint64, np.uint32, np.int64), strict=True):
            parts.append(np.frombuffer(data, kind, n, at))
            at += parts[-1].nbytes
        return cls(*parts)
