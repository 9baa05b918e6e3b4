"""BPE with word ends, encoding and decoding, by dynamic programming over the prefixes of a pre-token.

A text is cut at the special tokens of the vocabulary, put into composed form and lower case, and split into pre-tokens. A pre-token
is a string of symbols: its UTF-8 bytes, the last of which carries the mark of the word's end. Merging yields one list of tokens for
every prefix, and the list without its last token is that of a shorter prefix. So the last token of each prefix is enough:

- an automaton over the vocabulary (tries with suffix links) names all tokens that end at a place, in one pass;
- such a token is the last one of the prefix if merging would leave it apart from the last token of the prefix before it. That is a
  property of the pair: no rule joins a piece at the right edge of the one with a piece at the left edge of the other while both
  are there. Exactly one token passes;
- the ids follow from the end of the pre-token by these last tokens.

This holds for rules that are learned in order (both parts of a rule come from earlier rules); other vocabularies are refused.
The vocabulary has a fixed size and is broadcast. Each task keeps the ids of recent distinct pre-tokens, twice REMEMBERED at most.

Defined cases: a null text is empty and has no ids; null ids decode to empty; ids without a token are left out by decoding; columns of
docs that have the name of an added column are replaced; all others are kept. Letters follow the Unicode tables of Python, so code points
that other libraries' tables lack may split otherwise.
"""

from __future__ import annotations

import json
import math
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from hourloom.llm.bpe import LONGEST_REMEMBERED, grouped

REMEMBERED = 150_000
#: Verdicts on pairs of tokens that a task keeps.
PAIRS = 400_000
#: The last token of the empty prefix.
START = -1
#: What the end of a word adds to the code of its last byte.
WORD_END = 256


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in vocabulary files: itself, or one from 256 on for the others, in order."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    hidden = [b for b in range(256) if b not in set(shown)]
    letter = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
    return [letter[b] for b in range(256)]


class Vocabulary:
    """Tokens, rules and the automaton of a vocabulary file (JSON with a BPE model)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            described = json.load(file)
        model = described["model"]
        end, ids = model["end_of_word_suffix"], model["vocab"]
        self.special = {t["content"]: t["id"] for t in described["added_tokens"]}
        if model["type"] != "BPE" or not end or model["dropout"] or any(t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"] for t in described["added_tokens"]):
            raise ValueError("only BPE vocabularies with a word end and plain special tokens are known")
        split = described["pre_tokenizer"]["pretokenizers"][0]
        if (split["type"], split["behavior"], split["invert"]) != ("Split", "Removed", True):
            raise ValueError("pre-tokens must be the matches of a pattern")
        self.pattern = split["pattern"]["Regex"]
        letters = byte_letters()
        missing = [x for letter in letters for x in (letter, letter + end) if x not in ids]
        if missing:
            raise ValueError(f"bytes without a token: {missing[:5]}")

        size = max([*ids.values(), *self.special.values()]) + 1
        self.tokens = np.full(size, None, object)
        for text, i in [*ids.items(), *self.special.items()]:
            self.tokens[i] = text
        self.symbols = {ids[letter]: (b,) for b, letter in enumerate(letters)}
        self.symbols |= {ids[letter + end]: (b + WORD_END,) for b, letter in enumerate(letters)}
        self.packed = [i.to_bytes(4, "little") for i in range(size)]
        self.left_edges: dict[int, list[tuple[int, float]]] = {}
        self.right_edges: dict[int, list[tuple[int, float]]] = {}
        self.rules: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.made: dict[int, float] = dict.fromkeys(self.symbols, -1)
        usable = set(self.symbols)
        for rank, (left, right) in enumerate(model["merges"]):
            a, b, both = ids[left], ids[right], ids[left + right]
            if a not in self.made or b not in self.made or both in self.made:
                raise ValueError(f"rule {rank} does not come after the rules of its parts")
            if a in usable and b in usable and self.apart(a, b, rank):
                usable.add(both)
            self.rules[a, b], self.parts[both], self.made[both] = rank, (a, b), rank
            self.symbols[both] = self.symbols[a] + self.symbols[b]
        self.lengths = [len(self.symbols.get(i, ())) for i in range(size)]
        self._link(usable)

    def _link(self, usable: set[int]) -> None:
        """The automaton: a trie of the symbols of all usable tokens, for each state its longest proper suffix that is a state, and the tokens that end in it."""
        self.children, ends = [{}], [None]
        for token in usable:
            state = 0
            for symbol in self.symbols[token]:
                after = self.children[state].get(symbol)
                if after is None:
                    after = self.children[state][symbol] = len(self.children)
                    self.children.append({})
                    ends.append(None)
                state = after
            # Length, id, and what is known about the tokens that it may come after.
            ends[state] = (len(self.symbols[token]), token, {})
        self.suffix, self.found, layer = [0] * len(ends), [()] * len(ends), [0]
        while layer:
            for state in layer:
                for symbol, after in self.children[state].items():
                    if state:
                        self.suffix[after] = self.step(self.suffix[state], symbol)
                    self.found[after] = ((ends[after],) if ends[after] else ()) + self.found[self.suffix[after]]
            layer = [after for state in layer for after in self.children[state].values()]

    def step(self, state: int, symbol: int) -> int:
        """The state of the longest suffix, after a further symbol."""
        children, suffix = self.children, self.suffix
        while symbol not in children[state]:
            state = suffix[state]
        return children[state][symbol]

    def edge(self, token: int, side: int) -> list[tuple[int, float]]:
        """The pieces at the left (0) or right (1) edge of a token while it is put together, each with the rank that ends it."""
        pieces, until = [], math.inf
        while True:
            pieces.append((token, until))
            if token not in self.parts:
                return pieces
            until, token = self.made[token], self.parts[token][side]

    def apart(self, a: int, b: int, before: float = math.inf) -> bool:
        """Whether no rule of a rank below `before` joins across the border of a and b. Equal rules apply from left to right."""
        if a not in self.right_edges:
            self.right_edges[a] = self.edge(a, 1)
        if b not in self.left_edges:
            self.left_edges[b] = self.edge(b, 0)
        left_pieces, rank_of = self.left_edges[b], self.rules.get
        for x, x_until in self.right_edges[a]:
            for y, y_until in left_pieces:
                rank = rank_of((x, y))
                if rank is not None and rank < before and rank < x_until and rank <= y_until:
                    return False
        return True


def load(spark: SparkSession, path: str):
    """The vocabulary of a file, as a broadcast variable."""
    return spark.sparkContext.broadcast(Vocabulary(path))


def composed_lower(text: str) -> str:
    """Composed form, in lower case letter by letter (a final sigma is like any other)."""
    if text.isascii():
        return text.lower()
    return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()


def one_byte_pattern(pattern: str) -> str:
    """The pattern for texts of code points below 256, with the sets of white space, letters and numbers spelled out: the plain regex engine takes half the time."""
    # That engine counts the separators 0x1c to 0x1f as white space, Unicode does not.
    pattern = pattern.replace(r"[^\s", r"[^\t-\r \x85\xa0")
    for kind in "LN":
        members = "".join(regex.escape(chr(c)) for c in range(256) if unicodedata.category(chr(c))[0] == kind)
        pattern = pattern.replace(rf"[\p{{{kind}}}]", f"[{members}]").replace(rf"\p{{{kind}}}", members)
    return pattern


class Encoder:
    """Encodes texts in groups; keeps the ids of recent pre-tokens, as 32-bit integers in bytes, in two generations."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.find_any = regex.compile(vocabulary.pattern).findall
        self.find_latin = re.compile(one_byte_pattern(vocabulary.pattern)).findall
        longest_first = sorted(vocabulary.special, key=len, reverse=True)
        self.special = regex.compile("(" + "|".join(map(regex.escape, longest_first)) + ")") if longest_first else None
        self.judged = 0
        self.special_ids = {i: vocabulary.packed[i] for i in vocabulary.special.values()}
        self.recent: dict[str | int, bytes] = dict(self.special_ids)
        self.older: dict[str | int, bytes] = {}

    def find(self, text: str) -> list[str]:
        """Pre-tokens of a text without special tokens."""
        lower = composed_lower(text)
        try:
            lower.encode("latin-1")
        except UnicodeEncodeError:
            return self.find_any(lower)
        return self.find_latin(lower)

    def split(self, text: str) -> list[str | int]:
        """Pre-tokens, and special tokens as their ids."""
        if self.special is None or self.special.search(text) is None:
            return self.find(text)
        parts: list[str | int] = []
        for i, piece in enumerate(self.special.split(text)):
            parts += [self.vocabulary.special[piece]] if i % 2 else self.find(piece)
        return parts

    def tokens_of(self, parts: list[str]) -> dict[str, bytes]:
        """Ids of pre-tokens. In order of their bytes, each goes on from the prefix it shares with the one before."""
        children, suffix, found = self.vocabulary.children, self.vocabulary.suffix, self.vocabulary.found
        lengths, packed, made = self.vocabulary.lengths, self.vocabulary.packed, {}
        earlier, last, states = b"", [START], [0]
        for part in sorted(parts):
            code = part.encode()
            # The last byte carries the mark of the end, so it is never shared.
            shared, most = 0, min(len(code), len(earlier)) - 1
            while shared < most and code[shared] == earlier[shared]:
                shared += 1
            del last[shared + 1 :], states[shared + 1 :]
            earlier, state, at, size = code, states[-1], shared, len(code)
            while at < size:
                symbol = code[at]
                at += 1
                if at == size:
                    symbol += WORD_END
                after = children[state].get(symbol)
                while after is None:
                    state = suffix[state]
                    after = children[state].get(symbol)
                state = after
                states.append(state)
                for length, token, verdicts in found[state]:
                    before = last[at - length]
                    follows = verdicts.get(before)
                    if follows is None:
                        follows = self.judge(before, token, verdicts)
                    if follows:
                        last.append(token)
                        break
            token = last[at]
            ids = packed[token]
            while at := at - lengths[token]:
                token = last[at]
                ids = packed[token] + ids
            made[part] = ids
        return made

    def judge(self, before: int, token: int, verdicts: dict[int, bool]) -> bool:
        """Whether a token may come after another one, kept for later."""
        if self.judged >= PAIRS:
            for candidates in self.vocabulary.found:
                for _, _, known in candidates:
                    known.clear()
            self.judged = 0
        self.judged += 1
        follows = verdicts[before] = before == START or self.vocabulary.apart(before, token)
        return follows

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian 32-bit integers."""
        parts = [self.split(t) for t in texts]
        needed = set().union(*parts)
        if len(self.recent) > REMEMBERED:
            self.older, self.recent = self.recent, dict(self.special_ids)
        known, older = self.recent, self.older
        missing = needed.difference(known)
        again = {p: older[p] for p in missing if p in older}
        known.update(again)
        known.update(self.tokens_of([p for p in missing if p not in again]))
        made = [b"".join(map(known.__getitem__, p)) for p in parts]
        for part in needed:
            if isinstance(part, str) and len(part) > LONGEST_REMEMBERED:
                del known[part]
        return made


def decode_ids(vocabulary: Vocabulary, ids: np.ndarray) -> str:
    """The tokens of the ids, a space between any two."""
    tokens = vocabulary.tokens
    inside = ids[(ids >= 0) & (ids < len(tokens))]
    texts = tokens[inside].tolist()
    return " ".join(texts) if None not in texts else " ".join([t for t in texts if t is not None])


def _with(docs: DataFrame, fields: list[T.StructField], without: tuple[str, ...] = ()) -> tuple[list[str], T.StructType]:
    """Names of the kept columns and the schema with the added ones, which replace columns of the same name."""
    gone = {f.name.lower() for f in fields} | {n.lower() for n in without}
    kept = [f for f in docs.schema.fields if f.name.lower() not in gone]
    return [f.name for f in kept], T.StructType([*kept, *fields])


def encode(docs: DataFrame, vocabulary, text_column: str = "text", name: str = "ids", keep_text: bool = True, decoded: str | None = None) -> DataFrame:
    """Adds the ids of a text (array<int>). With a name for `decoded`, the text that the ids decode to comes in the same pass."""
    added = [T.StructField(name, T.ArrayType(T.IntegerType(), False)), *([T.StructField(decoded, T.StringType())] if decoded else [])]
    names, schema = _with(docs, added, () if keep_text else (text_column,))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary.value)
        for batch in batches:
            texts = (t.as_py() or "" for t in batch.column(batch.schema.get_field_index(text_column)))
            at = 0
            for group in grouped(texts):
                made = encoder.encode(group)
                ends = np.cumsum([0, *(len(m) // 4 for m in made)]).astype(np.int32)
                every = np.frombuffer(b"".join(made), "<i4")
                columns = [pa.ListArray.from_arrays(pa.array(ends), pa.array(every, pa.int32()))]
                if decoded:
                    columns.append(pa.array([decode_ids(vocabulary.value, every[a:b]) for a, b in zip(ends, ends[1:])], pa.string()))
                rows = batch.slice(at, len(group))
                at += len(group)
                kept = [rows.column(rows.schema.get_field_index(n)) for n in names]
                yield pa.RecordBatch.from_arrays([*kept, *columns], [*names, *(f.name for f in added)])

    return docs.mapInArrow(run, schema)


def decode(encoded: DataFrame, vocabulary, ids_column: str = "ids", name: str = "decoded") -> DataFrame:
    """Adds the text that the ids decode to."""
    names, schema = _with(encoded, [T.StructField(name, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index(ids_column))
            texts = [decode_ids(vocabulary.value, np.array([i for i in x.as_py() or [] if i is not None], np.int64)) for x in ids]
            kept = [batch.column(batch.schema.get_field_index(n)) for n in names]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(texts, pa.string())], [*names, name])

    return encoded.mapInArrow(run, schema)
