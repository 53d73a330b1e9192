"""Vectorised word splitting and hashing over the bytes of an Arrow batch.

Word rules over code points whose classes are ASCII only are the same over UTF-8 bytes, since every
byte of a non-ASCII code point is above 0x7F. All functions take many texts at once, so that the cost
per text is small.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

_rng = np.random.Generator(np.random.PCG64(20240611))
_BYTE_VALUE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = int(_rng.integers(1, 2**62)) * 4 + 3
_INVERSE = pow(_BASE, -1, 2**64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

SPACE_WORD = np.ones(256, bool)  # [^\x20\x09-\x0D]+
SPACE_WORD[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
ALNUM_WORD = np.zeros(256, bool)  # [^\x00-\x2F\x3A-\x60\x7B-\x7F]+, after lower-casing A-Z
ALNUM_WORD[0x30:0x3A] = ALNUM_WORD[0x61:0x7B] = ALNUM_WORD[0x80:] = True

_powers: list[np.ndarray] = []


def _power_tables(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, grown on demand."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, 1 << 16)
        _powers[:] = []
        for base in (_BASE, _INVERSE):
            factors = np.full(size, base, np.uint64)
            factors[0] = 1
            _powers.append(np.multiply.accumulate(factors))
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over all 64."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class Words(NamedTuple):
    start: np.ndarray  #: first byte of each word
    end: np.ndarray  #: one past its last byte
    count: np.ndarray  #: words of each text
    first: np.ndarray  #: index of each text's first word, and the total at the end


def split(data: np.ndarray, offsets: np.ndarray, word: np.ndarray, lower: bool = False) -> tuple[np.ndarray, Words]:
    """The (lower-cased) bytes and their words; no word crosses from one text into the next."""
    if lower:
        data = _LOWER[data]
    inside = word[data]
    n = len(data)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.empty(n, bool)
    after = np.empty(n, bool)
    if n:
        before[0], before[1:] = False, inside[:-1]
        after[-1], after[:-1] = False, inside[1:]
        before &= ~edge[:n]
        after &= ~edge[1:]
    start = np.flatnonzero(inside & ~before)
    end = np.flatnonzero(inside & ~after) + 1
    first = np.searchsorted(start, offsets)
    return data, Words(start, end, np.diff(first), first)


def hashes(data: np.ndarray, words: Words) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    if not len(words.start):
        return np.zeros(0, np.uint64)
    power, inverse = _power_tables(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE_VALUE[data] * power[: len(data)], out=total[1:])
    size = (words.end - words.start).astype(np.uint64)
    return mix((total[words.end] - total[words.start]) * inverse[words.start] + size)


def windows(word_hash: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each position on; the last k - 1 positions have none."""
    n = len(word_hash) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, k, np.uint64)
    for j in range(k):
        out = (out ^ word_hash[j : j + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(32)
    return mix(out)


def text_of(words: Words) -> np.ndarray:
    """The text index of each word."""
    return np.repeat(np.arange(len(words.count)), words.count)


def starts_of(words: Words, k: int) -> np.ndarray:
    """Word indexes at which k words of one text begin."""
    left = np.repeat(words.first[1:], words.count) - np.arange(len(words.start))
    return np.flatnonzero(left >= k)


def distinct(keys: np.ndarray) -> np.ndarray:
    """Sorted distinct keys; for numbers this is faster than numpy's own, which hashes."""
    keys = np.sort(keys)
    fresh = np.ones(len(keys), bool)
    fresh[1:] = keys[1:] != keys[:-1]
    return keys[fresh]


class Places:
    """The places of keys in a sorted array of distinct ones, by a direct table; the few that share a slot are searched."""

    BITS = 21

    def __init__(self, keys: np.ndarray) -> None:
        self.keys = keys
        self.table = np.zeros(1 << self.BITS, np.int32)
        self.table[self._slot(keys)] = np.arange(len(keys), dtype=np.int32)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.BITS)

    def of(self, keys: np.ndarray) -> np.ndarray:
        """All ``keys`` must be there."""
        at = self.table[self._slot(keys)]
        other = np.flatnonzero(self.keys[at] != keys)
        at[other] = np.searchsorted(self.keys, keys[other])
        return at
