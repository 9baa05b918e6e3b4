"""A corpus pipeline: quality, exact copies, near copies, source mix, token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame. `run` writes what a stage returns to the shared folder as Parquet and
hands the reread table to the next. All stages but the last return the columns of documents. Columns beyond those that a stage
needs are carried along; a document taken by the mix more than once is a row for each time.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hourloom.llm import bpe, exact_dedup, jaccard_join, mixing, quality
from hourloom.llm.common import scratch_folder, table


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: documents that importance resampling takes."""
    return quality.resample(docs, table(spark, sf_dir, "labels"))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: of equal texts the row with the largest id."""
    return exact_dedup.drop_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: of every class of similar texts the row with the least id."""
    return jaccard_join.keep_first(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: every document as often as the mix takes it; the words of a block that cuts a document, as a row of their own."""
    return mixing.mixed_documents(docs)


def to_token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: ids of every text, and whether they decode to it."""
    vocabulary = bpe.load(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    decoded = bpe.encode(docs.select("doc_id", "source", "text"), vocabulary, decoded="decoded")
    whole = F.col("decoded") == F.coalesce("text", F.lit("")).cast("binary")
    return decoded.select("doc_id", "source", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", whole.alias("round_trip"))


STAGES = [
    ("quality classifier", drop_low_quality),
    ("exact dedup", drop_exact_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing sources to target weights", mix_sources),
    ("byte-level BPE encoding and decoding", to_token_ids),
]

#: SQL has no byte-pair merges and no connected components in bounded work; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_folder(spark, "stage-" + "".join(c if c.isalnum() else "-" for c in name))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
