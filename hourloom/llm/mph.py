"""Minimal perfect hash functions over 128-bit keys, built and read with numpy.

Keys that share no place in a bit array keep it, the others go to the next, smaller array. The slot of a key is the number of set
bits before its place. Some three bits per key beside the slots; a key that was not in the set gets some slot or -1, so what a
slot holds must be compared with the key.
"""

from __future__ import annotations

import numpy as np

GAMMA = 2.0
LEVELS = 48
_STEP = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; numpy wraps around."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _places(a: np.ndarray, b: np.ndarray, level: int, size: int) -> np.ndarray:
    h = mix(a + np.uint64(int(_STEP) * (level + 1) % 2**64)) ^ b
    return (mix(h) % np.uint64(size)).astype(np.int64)


def build(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sizes, bits): the length of every level in bits (a multiple of 64), and all levels as 64-bit words.

    a, b: the halves of distinct 128-bit keys. Equal keys cannot be told apart and raise an error.
    """
    sizes, words = [], []
    for level in range(LEVELS):
        if not len(a):
            break
        size = max(64, int(np.ceil(GAMMA * len(a) / 64)) * 64)
        at = _places(a, b, level, size)
        once = np.bincount(at, minlength=size) == 1
        sizes.append(size)
        words.append(np.packbits(once, bitorder="little").view(np.uint64))
        left = ~once[at]
        a, b = a[left], b[left]
    if len(a):
        raise ValueError("keys are not distinct")
    return np.array(sizes, np.int64), np.concatenate(words) if words else np.empty(0, np.uint64)


def slots(sizes: np.ndarray, words: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The slot of each key, -1 where no level has a bit for it."""
    found = np.full(len(a), -1, np.int64)
    before = np.concatenate([[0], np.cumsum(np.bitwise_count(words).astype(np.int64))])
    todo, start = np.arange(len(a)), 0
    for level, size in enumerate(sizes):
        if not len(todo):
            break
        at = _places(a[todo], b[todo], level, int(size))
        word, bit = start // 64 + (at >> 6), (at & 63).astype(np.uint64)
        hit = (words[word] >> bit) & np.uint64(1) == 1
        lower = words[word[hit]] & ((np.uint64(1) << bit[hit]) - np.uint64(1))
        found[todo[hit]] = before[word[hit]] + np.bitwise_count(lower)
        todo, start = todo[~hit], start + int(size)
    return found
