"""Lagged values of series.

An hourly series has at most one row per key and hour, so a window over one key holds no more rows than the range has
hours (about 88,000 in ten years). For series without that bound, `add_row_lags_blocked` cuts each key into blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from hourloom.functions.mathfns import mean_all, mean_skip_null
from hourloom.functions.params import lag_average_name, lag_name
from hourloom.functions.timefns import hour_number, hours

Offsets = Mapping[str, Sequence[int]]


def _default_name(column: str, k: int) -> str:
    return f"{column}_la{k}"


def _lag_columns(window: WindowSpec, lags: Offsets, name: Callable[[str, int], str]) -> dict[str, Column]:
    return {name(c, k): F.lag(c, k).over(window) for c, ks in lags.items() for k in ks}


def add_row_lags(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    lags: Offsets,
    name: Callable[[str, int], str] = _default_name,
) -> DataFrame:
    """Value k rows earlier in the same series. All offsets share one exchange and one sort."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumns(_lag_columns(window, lags, name))


def add_row_lags_blocked(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    lags: Offsets,
    block: Column,
    rows_per_chunk: int = 50_000,
    name: Callable[[str, int], str] = _default_name,
) -> DataFrame:
    """Same result as `add_row_lags` when one key may hold a large share of all rows.

    `block` must grow with the order columns (e.g. the minute of the time). Rows are numbered per (key, block), block
    totals turn that into a row number within the key, and the key is cut into chunks of equal size. The last rows of a
    chunk are copied to the next one, so every lag is found inside its chunk and no task sees more than one chunk.
    """
    reach = max(k for ks in lags.values() for k in ks)
    if rows_per_chunk < reach:
        raise ValueError("rows_per_chunk must not be smaller than the largest lag")
    # One struct as the key of a cell: NULL keys match each other, and the window and the join share an exchange.
    cell = F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], block.alias("block")).alias("__cell")
    in_cell = Window.partitionBy("__cell").orderBy(*order)
    numbered = df.select("*", cell).withColumn("__row", F.row_number().over(in_cell))
    earlier = Window.partitionBy(*[f"__cell.k{i}" for i in range(len(keys))]).orderBy("__cell.block").rowsBetween(
        Window.unboundedPreceding, -1
    )
    sizes = df.select(cell).groupBy("__cell").agg(F.count(F.lit(1)).alias("__n"))
    starts = sizes.select("__cell", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__start"))
    placed = (
        numbered.join(starts, "__cell")
        .withColumn("__position", F.col("__start") + F.col("__row") - 1)
        .withColumn("__home", F.floor(F.col("__position") / rows_per_chunk))
    )
    at_end = F.pmod(F.col("__position"), F.lit(rows_per_chunk)) >= rows_per_chunk - reach
    targets = F.when(at_end, F.array(F.col("__home"), F.col("__home") + 1)).otherwise(F.array(F.col("__home")))
    window = Window.partitionBy(*keys, "__chunk").orderBy("__position")
    lagged = placed.withColumn("__chunk", F.explode(targets)).withColumns(_lag_columns(window, lags, name))
    made = [name(c, k) for c, ks in lags.items() for k in ks]
    return lagged.where(F.col("__chunk") == F.col("__home")).select(*df.columns, *made)


def add_time_lags(
    df: DataFrame,
    keys: Sequence[str],
    time: str,
    lags: Offsets,
    name: Callable[[str, int], str] = _default_name,
) -> DataFrame:
    """Value exactly k hours earlier, NULL where that hour is missing. Needs one row per key and hour.

    A one-point RANGE frame replaces one self join per offset.
    """
    window = Window.partitionBy(*keys).orderBy("__hour")
    made = {name(c, k): F.max(c).over(window.rangeBetween(-k, -k)) for c, ks in lags.items() for k in ks}
    return df.withColumn("__hour", hour_number(F.col(time))).withColumns(made).drop("__hour")


def with_lookback(
    df: DataFrame, time: str, lo: Column, hi: Column, lookback_hours: int, lagging: Callable[[DataFrame], DataFrame]
) -> DataFrame:
    """Lag over a range that starts earlier, then trim. A filter on the order key cannot be pushed through a window, so
    the wider range is stated before it: that one does reach the scan."""
    padded = df.where(F.col(time).between(lo - hours(lookback_hours), hi))
    return lagging(padded).where(F.col(time) >= lo)


def add_station_lags(
    df: DataFrame,
    target: str,
    lags: Sequence[int],
    lags_avg: Sequence[int],
    station: str | Sequence[str] = "station_id",
    time: str = "date_time",
    average_name: str | None = None,
) -> DataFrame:
    """Own lags of the target and the average of the short ones (NULLs skipped).

    If a copy `<target>_train` exists, it gets its own lags and average.
    """
    every = sorted({*lags, *lags_avg})
    if not every:
        return df
    keys = [station] if isinstance(station, str) else list(station)
    window = Window.partitionBy(*keys).orderBy(time)
    copies = {"": target}
    if f"{target}_train" in df.columns:
        copies["_train"] = f"{target}_train"
    df = df.withColumns(
        {lag_name(target, k) + suffix: F.lag(c, k).over(window) for suffix, c in copies.items() for k in every}
    )
    if lags_avg:
        title = average_name or lag_average_name(lags_avg)
        df = df.withColumns(
            {
                title + suffix: mean_skip_null([F.col(lag_name(target, k) + suffix) for k in lags_avg])
                for suffix in copies
            }
        )
    return df


def add_lag_band(df: DataFrame, column: str, offsets: Sequence[int], name: str | None = None) -> DataFrame:
    """Mean of consecutive lags; NULL as soon as one is NULL."""
    name = name or f"{column}_la{offsets[0]}to{offsets[-1]}"
    return df.withColumn(name, mean_all([F.col(_default_name(column, k)) for k in offsets]))
