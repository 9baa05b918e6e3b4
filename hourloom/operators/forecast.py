"""Recursive forecasts: a prediction becomes the lag of a later hour."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hourloom.functions.params import lag_average_name, lag_name
from hourloom.operators.folds import add_series_step
from hourloom.operators.lags import add_station_lags
from hourloom.sources.merge import by_content, latest_per_key

HOUR_SLOTS = 1 << 24  # more hours than any time stamp has since the epoch


def _whole_series(batches: Iterator[pd.DataFrame], series: list[str]) -> Iterator[pd.DataFrame]:
    """Regroup a sorted partition so that no series is cut by a batch border. Holds one batch and one series."""
    rest = None
    for batch in batches:
        if batch.empty:
            continue
        if rest is not None:
            batch = pd.concat([rest, batch], ignore_index=True)
        last = batch.iloc[-1][series]
        same = np.ones(len(batch), dtype=bool)
        for name in series:
            same &= (batch[name] == last[name]).to_numpy() | (batch[name].isna() & pd.isna(last[name])).to_numpy()
        others = np.flatnonzero(~same)
        cut = int(others[-1]) + 1 if len(others) else 0
        rest = batch.iloc[cut:]
        if cut:
            yield batch.iloc[:cut].reset_index(drop=True)
    if rest is not None and len(rest):
        yield rest.reset_index(drop=True)


def _forecast_batch(
    rows: pd.DataFrame, series: list[str], time: str, step: str, target: str, lags: list[int], lags_avg: list[int],
    average: str | None, scorer,
) -> pd.DataFrame:
    """Walk the time steps; within a step all series of the batch are scored together."""
    codes = np.zeros(len(rows), dtype=np.int64)
    for name in series:
        values = rows[name]
        changed = (values != values.shift()) & ~(values.isna() & values.shift().isna())
        codes |= changed.to_numpy().astype(np.int64)
    codes[0] = 0
    codes = np.cumsum(codes)
    seconds = rows[time].to_numpy().astype("datetime64[s]").astype(np.int64)
    if (seconds % 3600 != seconds[0] % 3600).any():
        raise ValueError("times must lie on an hourly grid")
    slots = codes * HOUR_SLOTS + seconds // 3600
    earlier = {}
    for k in lags:
        at = np.minimum(np.searchsorted(slots, slots - k), len(slots) - 1)
        earlier[k] = np.where(slots[at] == slots - k, at, -1)
    columns = {name: rows[name].to_numpy() for name in scorer.features}
    for k in lags:
        columns[lag_name(target, k)] = rows[lag_name(target, k)].to_numpy(dtype=float).copy()
    if average is not None:
        columns[average] = rows[average].to_numpy(dtype=float).copy()
    pred = np.full(len(rows), np.nan)
    steps = rows[step].to_numpy()
    order = np.argsort(steps, kind="stable")
    borders = np.flatnonzero(np.r_[True, np.diff(steps[order]) != 0, True])
    for start, stop in zip(borders[:-1], borders[1:]):
        at = order[start:stop]
        now = steps[at[0]]
        for k in lags:
            if now >= k:
                source = earlier[k][at]
                columns[lag_name(target, k)][at] = np.where(source >= 0, pred[source], np.nan)
        if average is not None and now > 0:
            short = np.column_stack([columns[lag_name(target, k)][at] for k in lags_avg])
            known = ~np.isnan(short)
            total = np.where(known, short, 0.0).sum(axis=1)
            columns[average][at] = np.where(known.any(axis=1), total / np.maximum(known.sum(axis=1), 1), np.nan)
        pred[at] = scorer.score({name: columns[name][at] for name in scorer.features})
    made = {lag_name(target, k): columns[lag_name(target, k)] for k in lags}
    if average is not None:
        made[average] = columns[average]
    return rows.assign(**made, pred=pred)


def recursive_forecast(
    df: DataFrame,
    target: str,
    lags: Sequence[int],
    lags_avg: Sequence[int],
    scorer,
    series: Sequence[str] = ("fold_id", "station_id"),
    time: str = "date_time",
    step: str = "step",
    keep: Sequence[str] = (),
    average_name: str | None = None,
) -> DataFrame:
    """Forecast each series hour by hour.

    df holds one row per series and hour with lag columns taken from observations, and `step`, the ordinal of the hour
    in its fold. From step k on, lag k is the prediction k hours earlier (NULL if that hour is missing). Output: series
    keys, time, `keep`, `pred`; lags named in `keep` come out as they were used.

    One exchange brings the rows of a series together, sorted; a series is as long as the horizon, so a task streams
    over Arrow batches and scores one step of all series in a batch at once.
    """
    series, keep = list(series), list(keep)
    every = sorted({*lags, *lags_avg})
    average = (average_name or lag_average_name(lags_avg)) if lags_avg else None
    inputs = [*series, time, step, *keep, *scorer.features, *(lag_name(target, k) for k in every)]
    inputs += [average] if average else []
    inputs = list(dict.fromkeys(inputs))
    output = [*series, time, *[c for c in keep if c not in series and c != time]]
    schema = T.StructType([df.schema[c] for c in output] + [T.StructField("pred", T.DoubleType())])
    shared = df.sparkSession.sparkContext.broadcast(scorer)
    averaged = sorted(lags_avg)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in _whole_series(batches, series):
            done = _forecast_batch(rows, series, time, step, target, every, averaged, average, shared.value)
            yield done[[*output, "pred"]]

    placed = df.select(*[F.col(f"`{c}`") for c in inputs]).repartition(*series).sortWithinPartitions(*series, time)
    made = placed.mapInPandas(run, schema)
    return made.withColumn("pred", F.nanvl("pred", F.lit(None).cast("double")))


def recursive_forecasts(
    df: DataFrame,
    target: str,
    tried: Sequence[tuple[Sequence[int], object]],
    lags_avg: Sequence[int],
    series: Sequence[str] = ("fold_id", "station_id"),
    time: str = "date_time",
    step: str = "step",
    keep: Sequence[str] = (),
    average_name: str | None = None,
) -> DataFrame:
    """`recursive_forecast` for several (lags, scorer): `preds` holds the prediction of each, in their order.

    The rows are brought together once and walked once per scorer. All scorers travel to every executor, so they should be small.
    """
    series, keep = list(series), list(keep)
    every = [sorted({*lags, *lags_avg}) for lags, _ in tried]
    average = (average_name or lag_average_name(lags_avg)) if lags_avg else None
    inputs = [*series, time, step, *keep, *(f for _, scorer in tried for f in scorer.features)]
    inputs += [lag_name(target, k) for own in every for k in own] + ([average] if average else [])
    inputs = list(dict.fromkeys(inputs))
    output = [*series, time, *[c for c in keep if c not in series and c != time]]
    schema = T.StructType([df.schema[c] for c in output] + [T.StructField("preds", T.ArrayType(T.DoubleType()))])
    shared = df.sparkSession.sparkContext.broadcast([scorer for _, scorer in tried])
    averaged = sorted(lags_avg)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in _whole_series(batches, series):
            made = [
                _forecast_batch(rows, series, time, step, target, own, averaged, average, scorer)["pred"].to_numpy()
                for own, scorer in zip(every, shared.value)
            ]
            yield rows[output].assign(preds=list(np.column_stack(made)))

    placed = df.select(*[F.col(f"`{c}`") for c in inputs]).repartition(*series).sortWithinPartitions(*series, time)
    made = placed.mapInPandas(run, schema)
    return made.withColumn("preds", F.transform("preds", lambda p: F.nanvl(p, F.lit(None).cast("double"))))


def lags_from_predictions(
    df: DataFrame,
    target: str,
    pred: str,
    start: Column,
    lags: Sequence[int],
    lags_avg: Sequence[int],
    station: str | Sequence[str] = "station_id",
    time: str = "date_time",
    average_name: str | None = None,
) -> DataFrame:
    """Lag columns built from observations up to `start` and predictions after it; the target stays as it is."""
    mixed = F.when(F.col(time) <= start, F.col(target)).otherwise(F.col(pred))
    made = add_station_lags(
        df.withColumns({"__observed": F.col(target), target: mixed}), target, lags, lags_avg, station, time, average_name
    )
    return made.withColumn(target, F.col("__observed")).drop("__observed")


def prefill_lags(
    df: DataFrame,
    target: str,
    lags: Sequence[int],
    lags_avg: Sequence[int],
    start: Column,
    scorer,
    station: str = "station_id",
    time: str = "date_time",
    average_name: str | None = None,
) -> DataFrame:
    """Hide the target after `start`, forecast the whole horizon, and take the lags from observations and forecasts.

    A series has one row per hour: of doubled rows the one with the largest values stays.
    """
    df = latest_per_key(df, [station, time], by_content(df, [station, time]))
    known = df.drop(*[c for c in df.columns if c.startswith(f"{target}_lag") or c.startswith("lag_avg")])
    hidden = known.withColumn(target, F.when(F.col(time) <= start, F.col(target)))
    lagged = add_station_lags(hidden, target, lags, lags_avg, station, time, average_name)
    future = add_series_step(lagged.where(F.col(time) > start), time, [station])
    forecast = recursive_forecast(
        future, target, lags, lags_avg, scorer, [station], time, average_name=average_name
    ).withColumnRenamed("pred", "__pred")
    joined = known.join(forecast, [station, time], "left")
    return lags_from_predictions(joined, target, "__pred", start, lags, lags_avg, station, time, average_name).drop("__pred")
