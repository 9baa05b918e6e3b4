"""Shapes of the result tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hourloom.functions.mathfns import half_even
from hourloom.functions.timefns import unix_seconds


def rounded_value(value: Column) -> Column:
    return half_even(value, 1).cast("decimal(10,1)")


def grid_output(
    df: DataFrame, model_id: Column, forecast_time: Column, mode: str = "grid", pred: str = "pred", keep: Sequence[str] = ()
) -> DataFrame:
    """Grid predictions with one decimal; `grid_sim` keeps the traffic percentage. Columns to keep come last."""
    if mode not in ("grid", "grid_sim"):
        raise ValueError("mode must be one of: grid, grid_sim")
    return df.select(
        model_id.alias("model_id"),
        unix_seconds(forecast_time).alias("date_time_forecast"),
        unix_seconds(F.col("date_time")).alias("date_time"),
        "x",
        "y",
        *(["kfz_pct"] if mode == "grid_sim" else []),
        rounded_value(F.col(pred)).alias("value"),
        *keep,
    )


def station_output(df: DataFrame, model_id: Column, forecast_time: Column, pred: str = "pred") -> DataFrame:
    """Station forecasts; both times as unix seconds."""
    return df.select(
        model_id.alias("model_id"),
        unix_seconds(forecast_time).alias("date_time_forecast"),
        unix_seconds(F.col("date_time")).alias("date_time"),
        "station_id",
        F.col(pred).alias("value"),
    )


def left_out_output(df: DataFrame, model_id: Column, pred: str = "pred") -> DataFrame:
    """Predictions at stations that were left out of the training."""
    return df.select(
        model_id.alias("model_id"),
        unix_seconds(F.col("date_time")).alias("date_time"),
        "station_id",
        F.col(pred).alias("value"),
    )


def threshold_output(
    daily: DataFrame, model_id: Column, forecast_time: Column, limit: float, tweak: float, day: str = "date"
) -> DataFrame:
    """One row per station and day with the daily mean of every percentage in its own column."""
    means = [c for c in daily.columns if c.startswith("pct_kfz_")]
    return daily.select(
        "station_id",
        model_id.alias("model_id"),
        F.col(day).alias("date"),
        unix_seconds(forecast_time).alias("date_time_forecast"),
        F.lit(limit).alias("pollutant_limit"),
        F.lit(tweak).alias("tweak_value"),
        *means,
    )
