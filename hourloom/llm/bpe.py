"""Byte-level BPE, encoding and decoding, with a two-tier lookup.

Pre-tokens (matches of the pattern) that are entries of the vocabulary are resolved whole by a minimal perfect hash whose slots
hold the entry's bytes and rank. The others are merged: their bytes form a linked list, a heap holds the ranks of neighbouring pairs,
and the least rank, leftmost first, is merged until no pair is in the vocabulary. Special tokens do not exist here.

The vocabulary (a rank file: base64 bytes and rank per line) is read on the driver; its size is fixed, so it is broadcast. Each task
keeps the ids of recent distinct pre-tokens, twice REMEMBERED at most; what is forgotten is worked out again.

Defined cases: a null text is empty and has no ids; null ids decode to empty; any text decodes to its own UTF-8 bytes.
Columns of docs with the name of an added column are replaced, all others kept.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from hourloom.llm import mph

REMEMBERED = 150_000
#: Longer pre-tokens are not remembered, so what is kept has a bound in bytes too.
LONGEST_REMEMBERED = 64
#: Texts are split and looked up in groups of so many characters.
GROUP_CHARS = 1_000_000


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


def _keys(tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    hashed = np.frombuffer(b"".join(xxhash.xxh3_128_digest(t) for t in tokens), np.uint64).reshape(-1, 2)
    return hashed[:, 0].copy(), hashed[:, 1].copy()


class Vocabulary:
    """The whole entries by slot, ranks of pairs for merging, bytes by id."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, pattern
        entries = list(ranks)
        self.sizes, self.words = mph.build(*_keys(entries))
        order = np.argsort(mph.slots(self.sizes, self.words, *_keys(entries)))
        self.entries = [entries[i] for i in order]
        self.ids = [ranks[e] for e in self.entries]
        # The bytes of all ids one after another, and where each begins; ids without an entry are empty.
        lengths = np.zeros(max(ranks.values(), default=-1) + 1, np.int64)
        for entry, i in ranks.items():
            lengths[i] = len(entry)
        self.lengths, self.starts = lengths, np.concatenate([[0], np.cumsum(lengths)])[:-1]
        by_id = {i: e for e, i in ranks.items()}
        self.bytes = np.frombuffer(b"".join(by_id.get(i, b"") for i in range(len(lengths))), np.uint8)
        self.packed = [i.to_bytes(4, "little") for i in range(len(lengths))]

    def whole(self, tokens: list[bytes]) -> list[int | None]:
        """The id of each pre-token that is an entry."""
        at = mph.slots(self.sizes, self.words, *_keys(tokens)).tolist() if tokens else []
        return [self.ids[s] if s >= 0 and self.entries[s] == t else None for t, s in zip(tokens, at)]

    def merge(self, token: bytes) -> list[int]:
        """Ids of a pre-token by merging neighbours in the order of rank, leftmost first."""
        ranks, rank_of, n = self.ranks, self.ranks.get, len(token)
        ends = list(range(1, n + 1))  # the part that starts at i ends before ends[i]; 0 once it is merged into another
        previous = list(range(-1, n - 1))
        heap = [(rank, i, i + 2) for i in range(n - 1) if (rank := rank_of(token[i : i + 2])) is not None]
        heapify(heap)
        while heap:
            _, i, end = heappop(heap)
            middle = ends[i]
            # Stale unless part i and the part after it still are what was ranked.
            if not middle or middle >= end or ends[middle] != end:
                continue
            ends[i], ends[middle] = end, 0
            if end < n:
                previous[end] = i
                after = ends[end]
                if (rank := rank_of(token[i:after])) is not None:
                    heappush(heap, (rank, i, after))
            before = previous[i]
            if before >= 0 and (rank := rank_of(token[before:end])) is not None:
                heappush(heap, (rank, before, end))
        made, i = [], 0
        while i < n:
            made.append(ranks[token[i : ends[i]]])
            i = ends[i]
        return made


class Encoder:
    """Encodes texts in groups; keeps the ids of recent pre-tokens, as little-endian 32-bit integers, in two generations.

    When the younger generation is full it becomes the older one, whose pre-tokens return to the younger when they are met again.
    """

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary, self.split = vocabulary, regex.compile(vocabulary.pattern).findall
        self.recent: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[bytes]:
        parts = [self.split(t) for t in texts]
        needed = set()
        for p in parts:
            needed.update(p)
        missing = needed.difference(self.recent)
        again = {p: self.older[p] for p in missing if p in self.older}
        made = self._work_out([p for p in missing if p not in again])
        made.update(again)
        short = {p: ids for p, ids in made.items() if len(p) <= LONGEST_REMEMBERED}
        known = self.recent
        if len(known) + len(short) > REMEMBERED:
            made.update((p, known[p]) for p in needed if p in known)
            self.older, self.recent = known, short
            known = made
        else:
            known.update(short)
            if len(short) < len(made):
                known = {p: known[p] if p in known else made[p] for p in needed}
        return [b"".join(map(known.__getitem__, p)) for p in parts]

    def _work_out(self, parts: list[str]) -> dict[str, bytes]:
        tokens = [p.encode() for p in parts]
        made, packed, merge = {}, self.vocabulary.packed, self.vocabulary.merge
        for part, token, known in zip(parts, tokens, self.vocabulary.whole(tokens)):
            made[part] = packed[known] if known is not None else b"".join([packed[i] for i in merge(token)])
        return made


def grouped(texts: Iterator, most_chars: int = GROUP_CHARS) -> Iterator[list]:
    """Consecutive texts with at most so many characters (or bytes) together, or one longer text."""
    group, chars = [], 0
    for text in texts:
        if group and chars + len(text) > most_chars:
            yield group
            group, chars = [], 0
        group.append(text)
        chars += len(text)
    if group:
        yield group


def decode_ids(vocabulary: Vocabulary, texts: list[bytes]) -> list[bytes]:
    """The bytes of every list of ids, gathered for all lists at once."""
    ids = np.frombuffer(b"".join(texts), "<u4").astype(np.int64)
    lengths = vocabulary.lengths[ids]
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    # Byte k of an id's entry lies k places after its start.
    places = np.arange(total) + np.repeat(vocabulary.starts[ids] - (ends - lengths), lengths)
    whole = vocabulary.bytes[places].tobytes()
    counts = np.cumsum([len(t) // 4 for t in texts])
    borders = np.concatenate([[0], ends])[np.concatenate([[0], counts])].tolist() if texts else [0]
    return [whole[a:b] for a, b in zip(borders, borders[1:])]


def load(spark: SparkSession, path: str, pattern: str):
    """The vocabulary of a rank file, as a broadcast variable."""
    return spark.sparkContext.broadcast(Vocabulary(read_ranks(path), pattern))


def _columns(batch: pa.RecordBatch, names: list[str]) -> list[pa.Array]:
    return [batch.column(batch.schema.get_field_index(n)) for n in names]


def _not_named(fields: list[T.StructField], names: list[str]) -> list[T.StructField]:
    gone = {n.lower() for n in names}
    return [f for f in fields if f.name.lower() not in gone]


def encode(docs: DataFrame, vocabulary, text_column: str = "text", name: str = "ids", keep_text: bool = True, decoded: str | None = None) -> DataFrame:
    """Adds the ids of a text as little-endian unsigned 32-bit integers (binary).

    With a name for `decoded` the ids are decoded in the same pass, so no worker process beside the encoder's is needed.
    """
    added = [name, *([decoded] if decoded else [])]
    kept = _not_named(docs.schema.fields, added if keep_text else [*added, text_column])
    names = [f.name for f in kept]
    schema = T.StructType([*kept, *(T.StructField(n, T.BinaryType()) for n in added)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary.value)
        for batch in batches:
            texts = (t.as_py() or "" for t in batch.column(batch.schema.get_field_index(text_column)))
            at = 0
            for group in grouped(texts):
                ids = encoder.encode(group)
                made = [pa.array(ids, pa.binary())]
                if decoded:
                    made.append(pa.array(decode_ids(vocabulary.value, ids), pa.binary()))
                rows = batch.slice(at, len(group))
                at += len(group)
                yield pa.RecordBatch.from_arrays([*_columns(rows, names), *made], [*names, *added])

    return docs.mapInArrow(run, schema)


def decode(encoded: DataFrame, vocabulary, ids_column: str = "ids", name: str = "decoded") -> DataFrame:
    """Adds the bytes that the ids stand for."""
    fields = _not_named(encoded.schema.fields, [name])
    kept = [f.name for f in fields]
    schema = T.StructType([*fields, T.StructField(name, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index(ids_column))
            made = (decode_ids(vocabulary.value, group) for group in grouped((i.as_py() or b"" for i in ids), 4 * GROUP_CHARS // 8))
            texts = pa.array((t for group in made for t in group), pa.binary())
            yield pa.RecordBatch.from_arrays([*_columns(batch, kept), texts], [*kept, name])

    return encoded.mapInArrow(run, schema)
