"""From coarse source cells to fine city cells."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourloom.operators.lags import Offsets, add_row_lags


def expand_to_cells(source: DataFrame, cell_map: DataFrame, source_key: Sequence[str]) -> DataFrame:
    """One row of a source cell becomes one row for each city cell mapped to it (inner join)."""
    return cell_map.join(source, list(source_key)).drop(*source_key)


def lag_then_expand(
    source: DataFrame, cell_map: DataFrame, source_key: Sequence[str], time: str, lags: Offsets
) -> DataFrame:
    """Lags are the same for all city cells of a source cell, so they are taken before the rows are multiplied."""
    return expand_to_cells(add_row_lags(source, source_key, [time], lags), cell_map, source_key)


def attach_source(
    rows: DataFrame, source: DataFrame, cell_map: DataFrame, source_key: Sequence[str], time: str, lags: Offsets
) -> DataFrame:
    """Inner join of (x, y, time) rows with the lagged source of their cell.

    The same rows as joining with `lag_then_expand`, but the source grid is never multiplied: the many rows look up the
    few. Both joins have a unique right side; whether it is broadcast is decided at run time from its measured size.
    """
    lagged = add_row_lags(source, source_key, [time], lags)
    return rows.join(cell_map, ["x", "y"]).join(lagged, [*source_key, time]).drop(*source_key)


def reproject(source: DataFrame, reprojection: DataFrame, on: Sequence[str] = ("lat_int", "lon_int")) -> DataFrame:
    return source.join(reprojection, list(on)).drop(*on)


def scale_volume(traffic: DataFrame, scaling: DataFrame, value: str = "value", name: str = "kfz_per_hour") -> DataFrame:
    """Predicted volume times the factor of its cell; cells without a factor drop out."""
    return traffic.join(scaling.select("x", "y", "scaling"), ["x", "y"]).withColumn(
        name, F.col("scaling") * F.col(value)
    ).drop("scaling", value)
