"""Deduplicating reads, splices of two sources, append and replace writes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hourloom.session import store


def latest_per_key(df: DataFrame, keys: Sequence[str], newest_first: Sequence[Column]) -> DataFrame:
    """One row per key: the first in the given order, which must be total within a key.

    The filter row_number() = 1 becomes a group limit before the exchange, so a map task sends at most one row per key
    however often a key occurs.
    """
    order = Window.partitionBy(*keys).orderBy(*newest_first)
    return df.withColumn("__rank", F.row_number().over(order)).where(F.col("__rank") == 1).drop("__rank")


def observations_before_forecast(observed: DataFrame, forecast: DataFrame, time: str, first: Column | None = None) -> DataFrame:
    """Forecasts plus the observations strictly before the first forecast."""
    start = forecast.select(F.min(time)).scalar() if first is None else first
    return forecast.unionByName(observed.where(F.col(time) < start))


def history_then_latest(history: DataFrame, latest: DataFrame, time: str, last: Column | None = None) -> DataFrame:
    """History wins; the other source only adds what is newer than all of it."""
    end = history.select(F.max(time)).scalar() if last is None else last
    return history.unionByName(latest.where(F.col(time) > end))


def by_content(df: DataFrame, keys: Sequence[str]) -> list[Column]:
    """An order on the other columns, largest values first: rows that tie in it are equal."""
    return [F.col(f"`{c}`").desc_nulls_last() for c in df.columns if c not in keys]


def merge_rows(old: DataFrame, new: DataFrame, keys: Sequence[str], newest_first: Sequence[Column] = ()) -> DataFrame:
    """Rows of both, the new one where a key occurs twice.

    `newest_first` orders rows within one side; the content decides between rows that tie in it, so a repeated task keeps the same one.
    """
    newest_first = [*newest_first, *by_content(new, keys)]
    both = old.withColumn("__side", F.lit(0)).unionByName(new.withColumn("__side", F.lit(1)))
    return latest_per_key(both, keys, [F.col("__side").desc(), *newest_first]).drop("__side")


def write_rows(
    spark: SparkSession,
    df: DataFrame,
    path: str,
    mode: str = "replace",
    keys: Sequence[str] = (),
    partition_by: Sequence[str] = (),
    newest_first: Sequence[Column] = (),
) -> bool:
    """Append rows, or replace those with the same key by rewriting only the partitions the new rows fall into.

    Partition columns must be part of the key; `newest_first` says which of several new rows of a key counts. An empty frame
    changes nothing and counts as success. The rows are computed once: a replace stages them in the shared folder first.
    """
    if mode not in ("insert", "replace"):
        raise ValueError("mode must be one of: insert, replace")
    if mode == "insert":
        df.write.mode("append").partitionBy(*partition_by).parquet(path)
        return True
    if not keys or not partition_by or not set(partition_by) <= set(keys):
        raise ValueError("replace needs keys and partition columns that belong to the key")
    staged = store(df, "replace")
    if exists(spark, path):
        stored = spark.read.schema(df.schema).parquet(path).select(*df.columns)
        merged = merge_rows(_touched(stored, staged, partition_by), staged, keys, newest_first)
    else:
        merged = latest_per_key(staged, keys, [*newest_first, *by_content(staged, keys)])
    # Dynamic overwrite stages its files and swaps partitions at commit, so the old rows are readable until then.
    (
        merged.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*partition_by)
        .parquet(path)
    )
    spark.catalog.refreshByPath(path)
    return True


def _touched(stored: DataFrame, new: DataFrame, partition_by: Sequence[str]) -> DataFrame:
    """Stored rows of the partitions the new rows fall into, by a null-safe semi join on the partition columns."""
    wanted = new.select(*partition_by).distinct().withColumnsRenamed({name: f"__{name}" for name in partition_by})
    same = [F.col(name).eqNullSafe(F.col(f"__{name}")) for name in partition_by]
    return stored.join(wanted, same, "left_semi").select(*new.columns)


def exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders right below a path, none if it does not exist."""
    if not exists(spark, path):
        return []
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = target.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(target)
    return [f.getPath().getName() for f in found if f.isDirectory()]
