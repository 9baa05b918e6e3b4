"""Self-join of documents on the Jaccard similarity of their word shingles, with Bayesian pruning of candidate pairs.

1. Every text becomes its set of five-word shingles and HASHES MinHash values. Texts with equal sets are one node from here on, so
   copies are never paired.
2. Candidates share a band of ROWS values: at a similarity of 0.8 a pair has no common band with a probability under 1e-7.
   Buckets with the same members are reduced to the one of the lowest band.
3. Inside a bucket, pairs are compared STEP values at a time. With a uniform prior the posterior probability of reaching the
   threshold after m of n equal values is a binomial sum; a pair is dropped when it falls below TOLERANCE. A pair is handled
   in the lowest band it shares. Large buckets are dealt out as pairs of blocks; what leaves a task is a spanning forest.
4. Components of what is left are small and tight. Their texts are read again, and all pairs inside are verified on the whole sets, in
   blocks again. This gives every node its exact number of links, and the edges of the final classes.

Result of `similar_classes`: one row per document with class_id (the least id in its class), class_size and n_links: the
number of other documents whose similarity reaches the threshold, copies included.

Defined cases: null text is empty; texts without words are alike only if the texts are equal; texts of fewer than five words are one
shingle; repeated rows are documents of their own and linked; null ids count as the largest when the class id is chosen (null if
all are). Other columns do not matter.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hourloom.llm.common import cut, fresh
from hourloom.llm.components import connected
from hourloom.llm.shingles import MinHash, WordHashes, binary_matrix, least_labels, shingle_set, whole_groups

THRESHOLD = 0.8
HASHES, ROWS, STEP = 128, 4, 16
BANDS = HASHES // ROWS
TOLERANCE = 1e-6
PAIRS_AT_ONCE = 200_000
#: Components up to this size are verified as one block.
ONE_BLOCK = 64
#: Blocks of more rows than this count common shingles by matrix products.
BY_MATRIX = 24
COLUMNS_AT_ONCE = 4096


def needed_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> list[int]:
    """For n = STEP, 2 STEP, ... values: the least number of equal ones that keeps a pair.

    P(J >= t | m of n) with a uniform prior is the probability of at most m successes among n + 1 draws of chance t.
    """
    needed = []
    for n in range(STEP, HASHES + 1, STEP):
        below, m = 0.0, -1
        while below < tolerance:
            m += 1
            below += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        needed.append(m)
    return needed


def text_key(column: Column) -> Column:
    return F.xxhash64(F.coalesce(column, F.lit("")))


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, node (16 bytes that name the set), shingles (their number), values (HASHES little-endian 32-bit integers)."""
    narrow = docs.select("doc_id", text_key(F.col("text")).alias("text_key"), F.coalesce("text", F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, least = WordHashes(), MinHash(HASHES)
        for batch in batches:
            nodes, sizes, values = [], [], []
            for text in batch.column(2):
                said = text.as_py()
                shingles = shingle_set(said, hashes)
                nodes.append(xxhash.xxh3_128_digest(shingles.tobytes() if len(shingles) else b"\0" + said.encode()))
                sizes.append(len(shingles))
                values.append(least.values(shingles).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(nodes, pa.binary()), pa.array(sizes, pa.int64()), pa.array(values, pa.binary())],
                ["doc_id", "text_key", "node", "shingles", "values"],
            )

    return narrow.mapInArrow(run, "doc_id long, text_key long, node binary, shingles long, values binary")


def distinct_nodes(signed: DataFrame) -> DataFrame:
    """node, copies, first (the least doc_id with its text_key), values: one row per different set."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_key")).alias("first")
    return signed.groupBy("node").agg(F.count("*").alias("copies"), F.max("shingles").alias("shingles"), first, F.max("values").alias("values"))


def bands_of(nodes: DataFrame) -> DataFrame:
    """band, bucket, node: BANDS rows per node."""
    width = 4 * ROWS
    each = nodes.filter(F.col("shingles") > 0).select("node", "values", F.explode(F.sequence(F.lit(0), F.lit(BANDS - 1))).alias("band"))
    part = F.substring(F.col("values"), F.col("band") * width + 1, F.lit(width))
    return each.select("band", F.xxhash64("band", part).alias("bucket"), "node")


def bucket_members(nodes: DataFrame) -> DataFrame:
    """band, bucket, node, members: rows of buckets with several nodes; of buckets with equal members only the lowest band's."""
    banded = bands_of(nodes)
    sizes = banded.groupBy("bucket").agg(
        F.count("*").alias("members"), F.bit_xor(F.xxhash64("node")).alias("mixed"), F.min("node").alias("least"), F.min("band").alias("band")
    )
    lowest = sizes.filter("members > 1").groupBy("members", "mixed", "least").agg(F.min(F.struct("band", "bucket")).alias("b"))
    return banded.select("bucket", "node").join(lowest.select("b.bucket", "b.band", "members"), "bucket")


def in_blocks(rows: DataFrame, n_blocks: Column, by: str) -> DataFrame:
    """Adds block_a, block_b, side: each row goes to every pair of blocks that holds its own one."""
    dealt = rows.withColumn("n_blocks", n_blocks.cast("int")).withColumn("own", F.pmod(F.xxhash64("node", by), F.col("n_blocks")).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("n_blocks") - 1), lambda k: F.struct(F.least("own", k).alias("a"), F.greatest("own", k).alias("b")))
    each = dealt.withColumn("pair", F.explode(pairs))
    side = F.when(F.col("pair.a") == F.col("pair.b"), 0).when(F.col("own") == F.col("pair.a"), 1).otherwise(2)
    return each.withColumns({"block_a": F.col("pair.a"), "block_b": F.col("pair.b"), "side": side}).drop("pair", "own", "n_blocks")


def _pairs(starts: np.ndarray, side: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers (i, j) of the pairs of all groups, some PAIRS_AT_ONCE at a time."""
    first, second, n = [], [], 0
    for start, end in zip(starts[:-1].tolist(), starts[1:].tolist()):
        if end - start == 2:
            if side[start] == 0 or side[start] != side[start + 1]:
                first.append(np.array([start]))
                second.append(np.array([start + 1]))
                n += 1
        else:
            sides = side[start:end]
            lefts = np.flatnonzero(sides <= 1) + start
            rights = lefts if sides[0] == 0 else np.flatnonzero(sides == 2) + start
            rows = max(1, PAIRS_AT_ONCE // max(1, len(rights)))
            for at in range(0, len(lefts), rows):
                i = np.repeat(lefts[at : at + rows], len(rights))
                j = np.tile(rights, len(lefts[at : at + rows]))
                if sides[0] == 0:
                    i, j = i[i < j], j[i < j]
                first.append(i)
                second.append(j)
                n += len(i)
                if n >= PAIRS_AT_ONCE:
                    yield np.concatenate(first), np.concatenate(second)
                    first, second, n = [], [], 0
        if n >= PAIRS_AT_ONCE:
            yield np.concatenate(first), np.concatenate(second)
            first, second, n = [], [], 0
    if n:
        yield np.concatenate(first), np.concatenate(second)


def prune(values: np.ndarray, i: np.ndarray, j: np.ndarray, band: np.ndarray, needed: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """The pairs that may still reach the threshold, without those that a lower band shares."""
    matches = np.zeros(len(i), np.int32)
    for step, least in enumerate(needed):
        columns = slice(step * STEP, (step + 1) * STEP)
        equal = values[i, columns] == values[j, columns]
        matches = matches + equal.sum(axis=1, dtype=np.int32)
        keep = matches >= least
        shared = equal.reshape(len(i), -1, ROWS).all(axis=2)
        lower = np.arange(step * STEP // ROWS, (step + 1) * STEP // ROWS)
        keep &= ~(shared & (lower < band[:, None])).any(axis=1)
        i, j, band, matches = i[keep], j[keep], band[keep], matches[keep]
        if not len(i):
            break
    return i, j


def likely_edges(members: DataFrame, nodes: DataFrame, threshold: float, tolerance: float) -> DataFrame:
    """a, b: a spanning forest, bucket by bucket, of the pairs that survive the pruning."""
    needed = needed_matches(threshold, tolerance)
    n_blocks = F.ceil(F.sqrt("members") / 13)
    dealt = in_blocks(members, n_blocks, "bucket").join(nodes.select("node", "values"), "node")
    keys = ["bucket", "block_a", "block_b"]
    sorted_rows = dealt.select(*keys, "band", "side", "node", "values").repartition(*keys).sortWithinPartitions(*keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, starts in whole_groups(batches, keys):
            values = binary_matrix(rows.column("values").combine_chunks(), np.uint32, HASHES)
            side, band = rows.column("side").to_numpy(), rows.column("band").to_numpy()
            node = rows.column("node").combine_chunks()
            for i, j in _pairs(starts, side):
                i, j = prune(values, i, j, band[i], needed)
                if len(i):
                    labels = least_labels(rows.num_rows, i, j)
                    moved = np.flatnonzero(labels != np.arange(rows.num_rows))
                    yield pa.RecordBatch.from_arrays([node.take(pa.array(moved)), node.take(pa.array(labels[moved]))], ["a", "b"])

    return sorted_rows.mapInArrow(run, "a binary, b binary")


def common_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Numbers of common elements of sorted distinct arrays, left by right."""
    if len(left) + len(right) <= BY_MATRIX:
        return np.array([[len(np.intersect1d(x, y, assume_unique=True)) for y in right] for x in left], np.int64)
    rows = np.repeat(np.arange(len(left) + len(right)), [len(x) for x in (*left, *right)])
    found, column, times = np.unique(np.concatenate([*left, *right]), return_inverse=True, return_counts=True)
    several = times[column] > 1
    rows, column = rows[several], (np.cumsum(times > 1) - 1)[column[several]]
    order = np.argsort(column, kind="stable")
    rows, column = rows[order], column[order]
    counts = np.zeros((len(left), len(right)), np.int64)
    n_columns = int(column[-1]) + 1 if len(column) else 0
    for at in range(0, n_columns, COLUMNS_AT_ONCE):
        low, high = np.searchsorted(column, [at, at + COLUMNS_AT_ONCE])
        held = np.zeros((len(left) + len(right), min(COLUMNS_AT_ONCE, n_columns - at)), np.float32)
        held[rows[low:high], column[low:high] - at] = 1
        counts += np.rint(held[: len(left)] @ held[len(left) :].T).astype(np.int64)
    return counts


def verify(sets: list[np.ndarray], side: np.ndarray, threshold: Fraction) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers (i, j), i before j, of the pairs of a block whose sets reach the threshold."""
    if side[0] == 0:
        lefts = rights = np.arange(len(sets))
    else:
        lefts, rights = np.flatnonzero(side == 1), np.flatnonzero(side == 2)
    sizes = np.array([len(s) for s in sets], np.int64)
    if len(sets) == 2:
        if not len(lefts) or not len(rights):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        lefts, rights, same = np.array([0]), np.array([1]), False
    else:
        same = side[0] == 0
    common = common_counts([sets[x] for x in lefts], [sets[x] for x in rights])
    union = sizes[lefts][:, None] + sizes[rights][None, :] - common
    reached = common * threshold.denominator >= union * threshold.numerator
    if same:
        reached = np.triu(reached, 1)
    i, j = np.nonzero(reached)
    return lefts[i], rights[j]


def verified_links(components: DataFrame, nodes: DataFrame, docs: DataFrame, threshold: float) -> DataFrame:
    """node, root, links: per block a node's weight of linked nodes, and a node it is connected to."""
    exact = Fraction(str(threshold))
    named = components.join(nodes.select("node", "first", "copies"), "node").select(
        "node", "label", "copies", F.col("first.doc_id").alias("first_id"), F.col("first.text_key").alias("first_key")
    )
    texts = docs.select(F.col("doc_id").alias("id"), text_key(F.col("text")).alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    read = texts.join(named, F.col("id").eqNullSafe(F.col("first_id")) & (F.col("key") == F.col("first_key")))

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            sets = pa.array((shingle_set(t.as_py(), hashes).tobytes() for t in batch.column(3)), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), sets], ["label", "node", "copies", "set"])

    sets = read.select("label", "node", "copies", "text").mapInArrow(shingled, "label binary, node binary, copies long, set binary")
    sizes = components.groupBy("label").agg(F.count("*").alias("size"))
    n_blocks = F.when(F.col("size") <= ONE_BLOCK, 1).otherwise(F.ceil(F.sqrt("size") / 2.5))
    # Rows equal in id and text read the same node twice.
    once = cut(sets.dropDuplicates(["node"]))
    keys = ["label", "block_a", "block_b"]
    dealt = in_blocks(once.join(sizes, "label"), n_blocks, "label").select(*keys, "side", "node", "copies", "set")
    sorted_rows = dealt.repartition(*keys).sortWithinPartitions(*keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, starts in whole_groups(batches, keys):
            node, side = rows.column("node").combine_chunks(), rows.column("side").to_numpy()
            copies, held = rows.column("copies").to_numpy(), rows.column("set").combine_chunks()
            links, root = np.zeros(rows.num_rows, np.int64), np.arange(rows.num_rows)
            for start, end in zip(starts[:-1].tolist(), starts[1:].tolist()):
                if end - start < 2:
                    continue
                i, j = verify([np.frombuffer(held[x].as_py(), np.uint64) for x in range(start, end)], side[start:end], exact)
                if len(i):
                    np.add.at(links, i + start, copies[j + start])
                    np.add.at(links, j + start, copies[i + start])
                    root[start:end] = least_labels(end - start, i, j) + start
            linked = np.flatnonzero(links)
            if len(linked):
                yield pa.RecordBatch.from_arrays(
                    [node.take(pa.array(linked)), node.take(pa.array(root[linked])), pa.array(links[linked])], ["node", "root", "links"]
                )

    return sorted_rows.mapInArrow(run, "node binary, root binary, links long")


def similar_classes(docs: DataFrame, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """doc_id, text_key, class_id, class_size, n_links, first (whether the row is the class's first): one row per document."""
    signed = cut(signatures(docs))
    nodes = cut(distinct_nodes(signed))
    likely = cut(connected(likely_edges(bucket_members(nodes), nodes, threshold, tolerance)))
    links = cut(verified_links(likely, nodes, docs, threshold))
    classes = connected(links.select(F.col("node").alias("a"), F.col("root").alias("b")))
    counted = links.groupBy("node").agg(F.sum("links").alias("links"))
    known = (
        nodes.select("node", "copies", "first").join(classes, "node", "left").join(counted, "node", "left")
        .select("node", "copies", "first", F.coalesce("label", "node").alias("label"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    )
    named = cut(known)
    groups = named.groupBy("label").agg(F.min("first").alias("class_first"), F.sum("copies").alias("class_size"))
    by_node = cut(named.join(groups, "label").select("node", "class_first", "class_size", "n_links"))
    joined = signed.select("doc_id", "text_key", "node").join(by_node, "node")
    first = F.col("doc_id").eqNullSafe(F.col("class_first.doc_id")) & (F.col("text_key") == F.col("class_first.text_key"))
    return joined.select("doc_id", "text_key", F.col("class_first.doc_id").alias("class_id"), "class_size", "n_links", first.alias("first"))


def keep_first(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The first document of every class (least id), with all its columns."""
    key, = fresh(docs, "text_key")
    classes = cut(similar_classes(docs, threshold))
    gone = classes.filter(~F.col("first")).select(F.col("doc_id").alias("gone_id"), F.col("text_key").alias("gone_key")).distinct()
    left = docs.withColumn(key, text_key(F.col("text"))).join(
        gone, F.col("doc_id").eqNullSafe(F.col("gone_id")) & (F.col(key) == F.col("gone_key")), "left_anti"
    )
    # Rows equal in id and text are all first; one of them stays.
    repeated = classes.filter("first").groupBy("doc_id", "text_key").count().filter("count > 1").limit(1).count() > 0
    return (left.dropDuplicates(["doc_id", key]) if repeated else left).drop(key)
