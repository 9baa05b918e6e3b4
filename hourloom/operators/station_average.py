"""Station average weighted by the kind of station and the traffic volume of a cell.

A cell between "no traffic" (share 1) and "much traffic" (share 0) takes the background mean with weight `share` and the
mean of the traffic stations with weight `1 - share`. There are only two kinds of stations, so the means of an hour fit in
one row and the weighting is arithmetic on joined columns: no product of volumes and hours is formed. Lags of the weighted
average are weighted averages of the lagged means, so they are taken on one row per hour.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hourloom.functions.mathfns import exact_mean, half_even, mean_all

TRAFFIC_STATION = "Verkehr"  # fixed value: type of a station beside a street


def pivot_by_model(df: DataFrame, group: Sequence[str], models: Mapping[str, Column], value: str = "value") -> DataFrame:
    """Long to wide: one column per name, taken from the rows of that model."""
    picks = [F.max(F.when(F.col("model_id") == model, F.col(value))).alias(name) for name, model in models.items()]
    return df.groupBy(*group).agg(*picks)


def class_means(
    df: DataFrame,
    values: Sequence[str],
    time: str = "date_time",
    station_type: str = "station_type",
    traffic_label: str = TRAFFIC_STATION,
    decimals: int = 4,
) -> DataFrame:
    """One row per hour with `<value>_traffic` and `<value>_background`, each rounded to one digit.

    A station of unknown type is a background station.
    """
    is_traffic = F.coalesce(F.col(station_type), F.lit("")) == traffic_label
    parts = {"traffic": is_traffic, "background": ~is_traffic}
    means = [
        half_even(exact_mean(F.when(cond, F.col(v)), decimals), 1).alias(f"{v}_{part}")
        for v in values
        for part, cond in parts.items()
    ]
    return df.groupBy(time).agg(*means)


def lag_class_means(means: DataFrame, values: Sequence[str], lags: Sequence[int], time: str = "date_time") -> DataFrame:
    """Lags over the hours. One row per hour: the single window partition is as long as the range has hours."""
    window = Window.orderBy(time)
    return means.withColumns(
        {
            f"{v}_{part}_la{k}": F.lag(f"{v}_{part}", k).over(window)
            for v in values
            for part in ("traffic", "background")
            for k in lags
        }
    )


def weighted(to_traffic: Column, to_background: Column, traffic: Column, background: Column) -> Column:
    """Sum of the two weighted means; a missing mean adds nothing, NULL if both are missing."""
    first, second = to_traffic * traffic, to_background * background
    return F.coalesce(first + second, first, second)


def volume_class(kfz_per_24h: Column) -> Column:
    """Thousands of vehicles a day."""
    return F.rint(kfz_per_24h / 1000).cast("int")


def attach_weighted_average(
    rows: DataFrame,
    cell_volume: DataFrame,
    scaling: DataFrame,
    lagged_means: DataFrame,
    values: Sequence[str],
    lags: Sequence[int],
    band: Sequence[int] = (),
    time: str = "date_time",
) -> DataFrame:
    """Add `wavg_<value>`, its lags and the mean of a band of lags to rows keyed by (x, y, time); rows stay.

    cell_volume: x, y, kfz_per_24h. scaling: kkfz_per_24h, scaling_stadtrand, one row per volume class.
    """
    share = (
        cell_volume.select("x", "y", volume_class(F.col("kfz_per_24h")).alias("kkfz_per_24h"))
        .join(scaling, "kkfz_per_24h", "left")
        .select(
            "x", "y", F.abs(F.col("scaling_stadtrand") - 1).alias("__to_traffic"), F.abs("scaling_stadtrand").alias("__to_background")
        )
    )
    wide = rows.join(share, ["x", "y"], "left").join(lagged_means, time, "left")
    to_traffic, to_background = F.col("__to_traffic"), F.col("__to_background")
    kept = [F.col(f"`{c}`") for c in rows.columns]
    wide = wide.select(
        *kept,
        *[
            weighted(to_traffic, to_background, F.col(f"{v}_traffic{s}"), F.col(f"{v}_background{s}")).alias(f"wavg_{v}{s}")
            for v in values
            for s in ("", *(f"_la{k}" for k in lags))
        ],
    )
    if band:
        wide = wide.withColumns(
            {
                f"wavg_{v}_la{band[0]}to{band[-1]}": mean_all([F.col(f"wavg_{v}_la{k}") for k in band])
                for v in values
            }
        )
    return wide
