"""Exact deduplication against a minimal perfect hash over the distinct digests of earlier documents.

The digests (SHA-256 of the text) of history are dealt to buckets of bounded size by their leading bits. Each bucket becomes one
row: a minimal perfect hash and, by slot, the full digest, the locator of the winner (its id) and the number of copies. New
documents are first reduced to their distinct digests, so a text with any number of copies is one lookup; a lookup takes the slot
and compares all 32 bytes. Members are repeats of history, nonmembers are groups of their own.

Of equal texts the row with the largest id stays, be it old or new. Defined cases: a null text is empty; null ids are less than
any other (a group of null ids keeps one row, keep_id null); rows equal in id and text are repeats of each other, one stays;
other columns do not matter; an empty history or an empty table of new rows is no special case.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hourloom.llm import mph
from hourloom.llm.common import cut, fresh

BUCKET_DIGESTS = 20_000
INDEX_SCHEMA = "bucket int, sizes binary, words binary, digests binary, winners binary, has_winner binary, copies binary"
FOUND_SCHEMA = "digest binary, keep_id long, group_size long, in_history boolean"


def digest_of(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))


def digest_rows(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """digest, doc_id, rows: one row per pair of text and id."""
    return docs.select(digest_of(F.col(text_column)).alias("digest"), F.col(id_column).alias("doc_id")).groupBy("digest", "doc_id").agg(F.count("*").alias("rows"))


def distinct_digests(rows: DataFrame) -> DataFrame:
    return rows.groupBy("digest").agg(F.max("doc_id").alias("winner"), F.sum("rows").alias("copies"))


def _bucketed(distinct: DataFrame, n_buckets: int) -> DataFrame:
    return distinct.withColumn("bucket", F.pmod(F.xxhash64("digest"), F.lit(n_buckets)).cast("int"))


def _keys(digests: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    halves = np.ascontiguousarray(digests[:, :16]).view(np.uint64)
    return halves[:, 0].copy(), halves[:, 1].copy()


def _matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint8).reshape(-1, 32)


def _index_bucket(group: pd.DataFrame) -> pd.DataFrame:
    digests = _matrix(group["digest"])
    sizes, words = mph.build(*_keys(digests))
    order = np.argsort(mph.slots(sizes, words, *_keys(digests)))
    has = group["winner"].notna().to_numpy()[order]
    winners = group["winner"].fillna(0).to_numpy(np.int64)[order]
    copies = group["copies"].to_numpy(np.int64)[order]
    row = [int(group["bucket"].iloc[0]), *(x.tobytes() for x in (sizes, words, digests[order], winners, has, copies))]
    return pd.DataFrame([row], columns=["bucket", "sizes", "words", "digests", "winners", "has_winner", "copies"])


def build_index(history: DataFrame, n_buckets: int) -> DataFrame:
    """One row per bucket from (digest, winner, copies); a table to write, and to read for later runs."""
    return _bucketed(history, n_buckets).groupBy("bucket").applyInPandas(_index_bucket, INDEX_SCHEMA)


def _no_rows() -> pd.DataFrame:
    return pd.DataFrame({"digest": [], "keep_id": pd.array([], "Int64"), "group_size": [], "in_history": []})


def _merge_bucket(index: pd.DataFrame, new: pd.DataFrame) -> pd.DataFrame:
    """The decision for every distinct digest of a bucket: old ones, repeats of old ones, and new ones."""
    winners, has, copies = np.empty(0, np.int64), np.empty(0, bool), np.empty(0, np.int64)
    old = np.empty((0, 32), np.uint8)
    if len(index):
        row = index.iloc[0]
        old = np.frombuffer(row["digests"], np.uint8).reshape(-1, 32)
        winners, has, copies = (np.frombuffer(row[c], t).copy() for c, t in (("winners", np.int64), ("has_winner", bool), ("copies", np.int64)))
    fresh_digests = _matrix(new["digest"]) if len(new) else np.empty((0, 32), np.uint8)
    ids, counts = new["winner"].fillna(0).to_numpy(np.int64), new["copies"].to_numpy(np.int64)
    known = new["winner"].notna().to_numpy(bool)
    member = np.zeros(len(new), bool)
    if len(index) and len(new):
        at = mph.slots(np.frombuffer(row["sizes"], np.int64), np.frombuffer(row["words"], np.uint64), *_keys(fresh_digests))
        member = at >= 0
        member[member] = (old[at[member]] == fresh_digests[member]).all(axis=1)
        to = at[member]
        copies[to] += counts[member]
        larger = known[member] & (~has[to] | (ids[member] > winners[to]))
        winners[to[larger]], has[to[larger]] = ids[member][larger], True
    said = [bytes(d) for d in old] + [bytes(d) for d in fresh_digests[~member]]
    if not said:
        return _no_rows()
    keep = pd.array(np.concatenate([winners, ids[~member]]), "Int64")
    keep[~np.concatenate([has, known[~member]])] = pd.NA
    in_history = np.arange(len(said)) < len(old)
    return pd.DataFrame({"digest": said, "keep_id": keep, "group_size": np.concatenate([copies, counts[~member]]), "in_history": in_history})


def look_up(index: DataFrame, new: DataFrame, n_buckets: int) -> DataFrame:
    """digest, keep_id, group_size, in_history for every distinct digest of the index and of new (digest, winner, copies)."""
    return index.groupBy("bucket").cogroup(_bucketed(new, n_buckets).groupBy("bucket")).applyInPandas(_merge_bucket, FOUND_SCHEMA)


def buckets_for(n_digests: int) -> int:
    """Buckets that hold some BUCKET_DIGESTS digests each, however many there are."""
    return max(1, -(-n_digests // BUCKET_DIGESTS))


def decide(rows: DataFrame) -> DataFrame:
    """Decisions for one table of (digest, doc_id, rows), read as two arrivals: ids below the middle of their range are history."""
    span = rows.agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.count("*").alias("n")).first()
    middle = 0 if span["least"] is None else (span["least"] + span["most"]) // 2
    n_buckets = buckets_for(span["n"])
    old = F.coalesce(F.col("doc_id") <= middle, F.lit(True))
    index = build_index(distinct_digests(rows.filter(old)), n_buckets)
    return look_up(index, distinct_digests(rows.filter(~old)), n_buckets)


def mark_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, digest, in_history: one row per document."""
    rows = cut(digest_rows(docs))
    joined = rows.join(decide(rows), "digest")
    each = joined.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("rows"))))
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)
    return each.select("doc_id", "keep_id", "group_size", kept.alias("kept"), "digest", "in_history")


def drop_duplicates(docs: DataFrame) -> DataFrame:
    """The documents that stay, with all their columns."""
    digest, = fresh(docs, "digest")
    rows = cut(digest_rows(docs))
    repeated = rows.filter(F.col("rows") > 1).limit(1).count() > 0
    decided = rows.join(decide(rows), "digest")
    # Only what goes is looked up, so the texts meet a table that is small where copies are few.
    gone = decided.filter(~F.col("doc_id").eqNullSafe(F.col("keep_id"))).select(F.col("doc_id").alias("gone_id"), F.col("digest").alias("gone_digest"))
    keyed = docs.withColumn(digest, digest_of(F.col("text")))
    left = keyed.join(gone, F.col("doc_id").eqNullSafe(F.col("gone_id")) & (F.col(digest) == F.col("gone_digest")), "left_anti")
    # Rows equal in id and text: whatever else they hold, one stays.
    return (left.dropDuplicates(["doc_id", digest]) if repeated else left).drop(digest)
