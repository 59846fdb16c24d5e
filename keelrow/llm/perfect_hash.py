"""Minimal perfect hashing of 128-bit keys in numpy.

Each level has a bit array twice as long as the keys that are left.  A key that is alone at its
position gets it; the others go on to the next level with another hash.  The slot of a key is the
number of set bits before its own, so the slots are 0 .. n-1 without gaps.  About 3.7 bits a key and
half as many again for the counts of bits before each word.
"""

from __future__ import annotations

import numpy as np

LOAD = 2.0
_MAX_LEVELS = 200


def mixed(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit mix of uint64 values, another one for each salt."""
    with np.errstate(over="ignore"):
        x = x + np.uint64((0x9E3779B97F4A7C15 * (salt + 1)) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _positions(high: np.ndarray, low: np.ndarray, level: int, bits: int) -> np.ndarray:
    return (mixed(high ^ mixed(low, level), level) % np.uint64(bits)).astype(np.int64)


def build(high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sizes of the levels in bits, and their bit arrays as one array of words.  Keys must differ."""
    sizes, words = [], []
    while len(high):
        if len(sizes) == _MAX_LEVELS:
            raise ValueError("keys are repeated")
        bits = max(64, int(len(high) * LOAD + 63) // 64 * 64)
        at = _positions(high, low, len(sizes), bits)
        alone = np.bincount(at, minlength=bits) == 1
        words.append(np.packbits(alone, bitorder="little").view(np.uint64))
        sizes.append(bits)
        left = ~alone[at]
        high, low = high[left], low[left]
    return np.array(sizes, np.int64), np.concatenate(words) if words else np.zeros(0, np.uint64)


def slots(sizes: np.ndarray, words: np.ndarray, high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """The slot of each key; -1 for many, and any slot for other, keys that were not built in."""
    found = np.full(len(high), -1, np.int64)
    before = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])
    open_, base = np.arange(len(high)), 0
    for level, bits in enumerate(sizes):
        if not len(open_):
            break
        at = _positions(high[open_], low[open_], level, int(bits))
        word, bit = base + (at >> 6), (at & 63).astype(np.uint64)
        value = words[word]
        hit = (value >> bit) & np.uint64(1) == 1
        lower = value & ((np.uint64(1) << bit) - np.uint64(1))
        found[open_[hit]] = (before[word] + np.bitwise_count(lower))[hit]
        open_, base = open_[~hit], base + int(bits) // 64
    return found
