"""Quality by importance resampling.

Two generative models of hashed n-grams (words and pairs of words in N_BUCKETS buckets) are counted: the raw one over all documents,
the target one over documents labelled good. A document's log weight is the sum, over its n-grams, of the log ratio of
target and raw probability. Adding Gumbel noise (from a digest of the id, so reruns agree) and keeping the k largest sums
draws k documents without replacement in proportion to their weights. k follows from the scores of the labelled documents: the cut is
put where the share of bad ones below it, less GOOD_COST times the share of good ones below it, is largest, and k is the number of all
documents above the cut. Shares of either kind do not hang on how many of each were labelled. One in HELD_OUT of the good ones is left out of the
target model, and only these tell where good documents score.

Only the target model and the cut use a sample: at most about LABELLED labelled documents, chosen by a hash of the id. Counts of the
raw model, scores, k and the k-th largest score cover all documents.

Defined cases: a null text is empty and has log weight 0; rows with the k-th largest score stay, all of them if tied; repeated rows
have equal scores; without labels of both kinds every document stays; null ids share one noise value. Other columns are kept.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hourloom.llm.common import cut, fresh
from hourloom.llm.mph import mix
from hourloom.llm.shingles import WordHashes

N_BUCKETS = 1 << 15
LABELLED = 20_000
SMOOTHING = 1.0
GOOD_COST = 2.0
HELD_OUT = 4
SEED = 41
#: Scores are ranked in steps of 1/SCALE.
SCALE = 1 << 20
STEP_BITS = 13
#: n-grams that are counted at once.
GRAMS_AT_ONCE = 1_000_000
_TOKENS = re.compile(r"\w+|[^\w\s]+").findall
_PAIR = np.uint64(0xD6E8FEB86659FD93)


def ngram_buckets(text: str, hashes: WordHashes) -> np.ndarray:
    """Buckets of the words (runs of letters and digits, runs of other signs; lowercase) and of neighbouring pairs."""
    words = hashes.of(_TOKENS(text.lower()))
    pairs = words[:-1] * _PAIR + words[1:]
    return (mix(np.concatenate([words, pairs])) & np.uint64(N_BUCKETS - 1)).astype(np.int64)


def sampled_labels(labels: DataFrame, most: int = LABELLED) -> DataFrame:
    """(doc_id, good, held) of some `most` labelled ids; held ones are not for the target model."""
    known = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    part = min(1.0, most / max(1, known.count()))
    chosen = known.filter(F.pmod(F.xxhash64(F.lit(SEED), "doc_id"), F.lit(1 << 30)) < F.lit(int(part * (1 << 30))))
    held = F.pmod(F.xxhash64(F.lit(SEED + 2), "doc_id"), F.lit(HELD_OUT)) == 0
    return chosen.select("doc_id", (F.col("quality") >= 1).alias("good"), held.alias("held"))


def count_models(docs: DataFrame, good_ids: DataFrame) -> np.ndarray:
    """Counts of all buckets, raw and target: an array of two rows. Per task two numbers per bucket leave the executors."""
    marked = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(
        F.broadcast(good_ids.select("doc_id", F.lit(True).alias("good"))), "doc_id", "left"  # at most some LABELLED ids
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, counts = WordHashes(), np.zeros((2, N_BUCKETS), np.int64)

        def add(row: int, found: list[np.ndarray]) -> None:
            if found:
                counts[row] += np.bincount(np.concatenate(found), minlength=N_BUCKETS)

        for batch in batches:
            every, chosen, n = [], [], 0
            for text, good in zip(batch.column(0), batch.column(1)):
                found = ngram_buckets(text.as_py(), hashes)
                every.append(found)
                if good.as_py():
                    chosen.append(found)
                n += len(found)
                if n >= GRAMS_AT_ONCE:
                    add(0, every), add(1, chosen)
                    every, chosen, n = [], [], 0
            add(0, every), add(1, chosen)
        used = np.flatnonzero(counts[0])
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts[0][used]), pa.array(counts[1][used])], ["bucket", "raw", "target"])

    parts = marked.select("text", "good").mapInArrow(run, "bucket long, raw long, target long")
    counts = np.zeros((2, N_BUCKETS), np.int64)
    for row in parts.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).collect():  # N_BUCKETS rows at most
        counts[:, row["bucket"]] = row["raw"], row["target"]
    return counts


def log_ratios(counts: np.ndarray) -> np.ndarray:
    """log(target / raw) per bucket, both smoothed."""
    smooth = counts + SMOOTHING
    shares = smooth / smooth.sum(axis=1, keepdims=True)
    return np.log(shares[1]) - np.log(shares[0])


def gumbel(id_column: str) -> Column:
    """Gumbel noise from the id."""
    uniform = (F.shiftrightunsigned(F.xxhash64(F.lit(SEED + 1), id_column), 11).cast("double") + 0.5) / float(1 << 53)
    return -F.log(-F.log(uniform))


def add_weights(docs: DataFrame, ratios: np.ndarray, name: str) -> DataFrame:
    """Adds the log weight of the column text."""
    shared = docs.sparkSession.sparkContext.broadcast(ratios)  # N_BUCKETS numbers
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, table = WordHashes(), shared.value
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text"))
            sums = pa.array((float(table[ngram_buckets(t.as_py() or "", hashes)].sum()) for t in texts), pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, sums], [*batch.schema.names, name])

    return docs.mapInArrow(run, schema)


def kth_largest(keys: DataFrame, k: int) -> int | None:
    """The k-th largest of a long column `key`, by counting ever finer ranges; None if there are not more than k rows.

    A key moved by 2^63 is read as 64 bits, STEP_BITS of them at a time from the highest; each of the five passes counts at most
    2^STEP_BITS values, whatever the number of rows.
    """
    if keys.count() <= k:
        return None
    moved = F.col("key").bitwiseXOR(F.lit(-(1 << 63)))
    prefix, width, left = 0, 64, k
    while width:
        step = min(STEP_BITS, width)
        rows = keys if width == 64 else keys.filter(F.shiftrightunsigned(moved, width) == F.lit(prefix))
        width -= step
        part = F.shiftrightunsigned(moved, width).bitwiseAND(F.lit((1 << step) - 1))
        counts = {r["part"]: r["count"] for r in rows.groupBy(part.alias("part")).count().collect()}
        found = max(counts, default=0)
        for found in sorted(counts, reverse=True):
            if counts[found] >= left:
                break
            left -= counts[found]
        prefix = (prefix << step) | found
    return prefix - (1 << 63)


def best_cut(good: list[int], bad: list[int]) -> float:
    """Where to cut the keys of labelled documents: between the last that goes and the first that stays; -inf if none should go."""
    keys = np.array([*good, *bad], float)
    if not good or not bad:
        return -math.inf
    gains = np.r_[np.full(len(good), -GOOD_COST / len(good)), np.full(len(bad), 1 / len(bad))]
    order = np.argsort(keys, kind="stable")
    keys, below = keys[order], np.cumsum(gains[order])
    last = np.r_[keys[1:] != keys[:-1], True]  # equal keys go together
    below[~last] = -math.inf
    at = int(np.argmax(below))
    if below[at] <= 0:
        return -math.inf
    return (keys[at] + keys[at + 1]) / 2 if at + 1 < len(keys) else keys[at] + 1


def score(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, str, str, Column]:
    """docs with a log weight and a score, the names of both, and the condition that the sample takes a row."""
    weight, total = fresh(docs, "log_weight", "score")
    chosen = cut(sampled_labels(labels))
    counts = count_models(docs, chosen.filter("good AND NOT held"))
    ratios = log_ratios(counts) if counts[1].any() else np.zeros(N_BUCKETS)
    scored = add_weights(docs, ratios, weight).withColumn(total, F.floor((F.col(weight) + gumbel("doc_id")) * SCALE) / SCALE)
    if not counts[1].any():
        return scored, weight, total, F.lit(True)
    keys = cut(scored.select("doc_id", (F.col(total) * SCALE).cast("long").alias("key")))
    told = chosen.filter("held OR NOT good")
    labelled = keys.join(F.broadcast(told), "doc_id").groupBy("doc_id", "good").agg(F.max("key").alias("key"))  # LABELLED rows
    known = labelled.select("good", "key").collect()
    border = best_cut([r["key"] for r in known if r["good"]], [r["key"] for r in known if not r["good"]])
    least = kth_largest(keys, keys.filter(F.col("key") >= F.lit(border)).count())
    return scored, weight, total, F.lit(True) if least is None else F.col(total) >= F.lit(least / SCALE)


def resample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the sample takes, with their columns."""
    scored, weight, total, taken = score(docs, labels)
    return scored.filter(taken).drop(weight, total)
