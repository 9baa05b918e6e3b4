"""Words, word shingles and MinHash values of one text, with numpy; for use inside tasks."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

from hourloom.llm.mph import mix

SHINGLE = 5
_WORDS = re.compile(r"\w+").findall
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
#: Hashes of so many distinct words are remembered by a task.
REMEMBERED = 100_000


class WordHashes(dict):
    """64-bit hashes of words."""

    def __missing__(self, word: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        made = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            self[word] = made
        return made

    def of(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def shingle_set(text: str, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of SHINGLE lowercase words; a shorter text is one run, one without words has none."""
    words = hashes.of(_WORDS(text.lower()))
    if not len(words):
        return words
    width = min(SHINGLE, len(words))
    run = np.full(len(words) - width + 1, width, np.uint64)
    for i in range(width):
        run = run * _FACTOR + words[i : len(words) - width + 1 + i]
    return np.unique(mix(run))


class MinHash:
    """n values per set: the least of a multiplied and shifted 32-bit hash, by n fixed pairs of constants."""

    def __init__(self, n: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.factors = (rng.integers(0, 1 << 31, n, dtype=np.uint32) * np.uint32(2) + np.uint32(1))[:, None]
        self.summands = rng.integers(0, 1 << 32, n, dtype=np.uint32)[:, None]

    def values(self, shingles: np.ndarray) -> np.ndarray:
        low = (shingles >> np.uint64(32)).astype(np.uint32)
        least = np.full(len(self.factors), np.iinfo(np.uint32).max, np.uint32)
        for at in range(0, len(low), 1024):
            part = low[None, at : at + 1024] * self.factors
            part += self.summands
            np.minimum(least, part.min(axis=1), out=least)
        return least


def binary_matrix(column: pa.Array, dtype, width: int) -> np.ndarray:
    """Rows of a binary column of equal lengths as a matrix."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(-1, width)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """(rows, starts): tables of whole groups from batches sorted by keys, with the first row of every group and the number of rows.

    What is held back is the last group of a batch, which may go on in the next one.
    """
    held: list[pa.RecordBatch] = []

    def starts_of(table: pa.Table) -> np.ndarray:
        new = np.zeros(table.num_rows, bool)
        new[:1] = True
        for key in keys:
            column = table.column(key).combine_chunks()
            if pa.types.is_binary(column.type):
                width = len(column[0].as_py()) if len(column) else 1
                values = binary_matrix(column, np.uint8, width)
                new[1:] |= (values[1:] != values[:-1]).any(axis=1)
            else:
                values = column.to_numpy(zero_copy_only=False)
                new[1:] |= values[1:] != values[:-1]
        return np.flatnonzero(new)

    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([*held, batch])
        starts = starts_of(table)
        cut = int(starts[-1])
        if cut:
            yield table.slice(0, cut), np.append(starts[:-1], cut)
        held = table.slice(cut).to_batches()
    if held:
        table = pa.Table.from_batches(held)
        yield table, np.append(starts_of(table), table.num_rows)


def least_labels(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of n items the least item that the pairs (i, j) connect it to."""
    labels = np.arange(n)
    while True:
        before = labels.copy()
        least = np.minimum(labels[i], labels[j])
        np.minimum.at(labels, i, least)
        np.minimum.at(labels, j, least)
        labels = labels[labels]
        if np.array_equal(before, labels):
            return labels
