"""Casting, capping and dropping of rows, and checks of completeness."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hourloom.functions.mathfns import cap_at


def require_columns(df: DataFrame, names: Sequence[str]) -> None:
    missing = [name for name in names if name not in df.columns]
    if missing:
        raise KeyError(f"missing columns: {missing}")


def fix_column_types(df: DataFrame, categorical: Sequence[str], metric: Sequence[str], time: str = "date_time") -> DataFrame:
    """Categories as strings, metrics (and every column copied for training) as doubles, the time as NTZ."""
    require_columns(df, [*categorical, *metric])
    metric = [*metric, *(c for c in df.columns if "_train" in c and c not in metric)]
    casts = {c: F.col(f"`{c}`").cast("string") for c in categorical}
    casts.update({c: F.col(f"`{c}`").cast("double") for c in metric})
    if time in df.columns:
        casts[time] = F.col(time).cast("timestamp_ntz")
    return df.withColumns(casts)


def drop_empty_series(df: DataFrame, target: str, key: str = "station_id") -> DataFrame:
    """Keep the series with at least one value. Series without a key drop out.

    A count over the series, so windows on the same key that follow need no exchange of their own.
    """
    values = F.count(F.col(target)).over(Window.partitionBy(key))
    return df.where(F.col(key).isNotNull()).withColumn("__values", values).where(F.col("__values") > 0).drop("__values")


def cap_outliers(df: DataFrame, caps: Mapping[str, Column | float]) -> DataFrame:
    return df.withColumns({name: cap_at(F.col(name), cap) for name, cap in caps.items()})


def count_outliers(df: DataFrame, caps: Mapping[str, Column | float]) -> DataFrame:
    return df.agg(*[F.count_if(F.col(name) > cap).alias(f"{name}_capped") for name, cap in caps.items()])


def training_cap_columns(columns: Sequence[str], target: str) -> list[str]:
    """The target, its own lags and the lag average; lags of other sources stay as they are."""
    return [c for c in columns if f"{target}_lag" in c or "lag_avg" in c or c == target]


def cap_for_training(df: DataFrame, target: str, cap: Column | float) -> DataFrame:
    return df.withColumns({c: cap_at(F.col(f"`{c}`"), cap) for c in training_cap_columns(df.columns, target)})


def drop_missing_target(df: DataFrame, target: str) -> DataFrame:
    return df.where(F.col(target).isNotNull())


def within_horizon(df: DataFrame, day: int, time: str = "date_time", forecast: str = "date_time_forecast") -> DataFrame:
    """Rows of the first or second day after the forecast was made: (24(day-1), 24 day] hours."""
    if day > 2:
        raise ValueError("forecasts reach two days at most")
    ahead = F.unix_timestamp(time) - F.unix_timestamp(forecast)
    return df.where((ahead > 86400 * (day - 1)) & (ahead <= 86400 * day))


def hours_between(lo: Column, hi: Column) -> Column:
    """Number of hourly points in a closed range."""
    return (F.round(F.abs(F.unix_timestamp(hi) - F.unix_timestamp(lo)) / 3600) + 1).cast("long")


def completeness(
    df: DataFrame, lo: Column, hi: Column, place: Sequence[str] = ("x", "y"), n_coords: Column | None = None
) -> DataFrame:
    """One row: expected and found number of rows when every place has every hour of the range.

    `n_coords` fixes the number of places, so that places without any row count as missing.
    """
    per_place = df.groupBy(*place).agg(F.count(F.lit(1)).alias("n"))
    places = F.count(F.lit(1)) if n_coords is None else n_coords
    found = per_place.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), places.cast("long").alias("n_coords"))
    expected = F.col("n_coords") * hours_between(lo, hi)
    return found.select("n_coords", "n_rows", expected.alias("expected_rows"), (expected == F.col("n_rows")).alias("complete"))


def incomplete_series(df: DataFrame, lo: Column, hi: Column, place: Sequence[str] = ("x", "y")) -> DataFrame:
    """The places that do not have exactly one row per hour, and how many rows they lack."""
    per_place = df.groupBy(*place).agg(F.count(F.lit(1)).alias("n_rows"))
    lacking = hours_between(lo, hi) - F.col("n_rows")
    return per_place.withColumn("n_missing", lacking).where(F.col("n_missing") != 0)


def duplicate_rows(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows (or keys) that occur more than once."""
    columns = df.columns if columns is None else columns
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
