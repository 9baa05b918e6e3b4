"""Session set-up and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def build_session(
    app: str = "hourloom", master: str | None = None, shuffle_partitions: int | None = None, extra: dict | None = None
) -> SparkSession:
    """A session with the settings the operators are written for: UTC wall time and adaptive execution."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        # Several operators multiply rows right after a small exchange (scenarios, halos), so small exchanges are not
        # merged into one task; the number of tasks stays bounded by the default parallelism.
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64KB")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # Fits that run side by side share the executors.
        .config("spark.scheduler.mode", "FAIR")
    )
    if master is not None:
        builder = builder.master(master)
    if shuffle_partitions is not None:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in (extra or {}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_root(spark: SparkSession) -> str:
    """Folder every executor can reach. Only a local session without the setting may use a temporary folder."""
    root = spark.conf.get(CHECKPOINT_KEY, None)
    if root:
        return root
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError(f"{CHECKPOINT_KEY} must name a folder shared by all executors")
    root = tempfile.mkdtemp(prefix="hourloom-")
    spark.conf.set(CHECKPOINT_KEY, root)
    return root


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh, unique path below the shared folder."""
    return os.path.join(scratch_root(spark), "hourloom", f"{label}-{uuid.uuid4().hex}")


def store(df: DataFrame, label: str) -> DataFrame:
    """Write a derived table to the shared folder and read it back.

    Meant for small results that meet a large table. Their size is then known when the join is planned: below the
    broadcast threshold the large side is not shuffled at all, above it both sides are.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
