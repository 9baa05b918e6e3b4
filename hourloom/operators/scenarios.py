"""Forecasts replayed under scaled traffic."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hourloom.functions.mathfns import exact_mean
from hourloom.functions.timefns import clamp_start, hours, to_local, to_utc, traffic_hour
from hourloom.operators.folds import add_series_step
from hourloom.operators.forecast import prefill_lags, recursive_forecast

PERCENTAGES = tuple(range(0, 101, 10))  # of a scenario run
EVERY_PERCENTAGE = tuple(range(101))  # looked at for the highest admissible one
HOURS_PER_DAY = 24


def _scaled(value: Column, percentage: Column, in_traffic_hour: Column) -> Column:
    return F.when(in_traffic_hour, value * percentage / F.lit(100)).otherwise(value)


def scale_traffic(df: DataFrame, percentage: Column | int, value: str = "kfz_per_hour", time: str = "date_time") -> DataFrame:
    """Multiply traffic by percentage / 100 in the local hours 5..21; other hours stay."""
    pct = F.lit(percentage) if isinstance(percentage, int) else percentage
    return df.withColumn(value, _scaled(F.col(value), pct, traffic_hour(F.col(time))))


def traffic_scenarios(
    df: DataFrame, percentages: Sequence[int] = PERCENTAGES, value: str = "kfz_per_hour", time: str = "date_time"
) -> DataFrame:
    """One copy of every row per percentage (`kfz_pct`). A narrow step: scoring needs no exchange afterwards."""
    copies = df.withColumn("kfz_pct", F.explode(F.array(*[F.lit(p) for p in percentages])))
    return scale_traffic(copies, F.col("kfz_pct"), value, time)


def day_number(time: Column, start: Column) -> Column:
    """0 for the 24 elapsed hours (start, start + 24 h], 1 for the next ..; NULL up to the start."""
    ahead = F.unix_timestamp(time) - F.unix_timestamp(start)
    return F.when(ahead > 0, (F.ceil(ahead / (HOURS_PER_DAY * 3600)) - 1).cast("int"))


def complete_days_prefix(
    df: DataFrame, station: str = "station_id", day: str = "day", skip_incomplete: bool = False
) -> DataFrame:
    """(station, day) pairs that are forecast: days of exactly 24 rows, up to the first day that has another number.

    A day without rows ends the run as well. `skip_incomplete` leaves out incomplete days only.
    """
    sizes = df.where(F.col(day).isNotNull()).groupBy(station, day).agg(F.count(F.lit(1)).alias("n_rows"))
    full = sizes.where(F.col("n_rows") == HOURS_PER_DAY)
    if not skip_incomplete:
        so_far = Window.partitionBy(station).orderBy(day)
        full = full.withColumn("__n", F.row_number().over(so_far)).where(F.col("__n") == F.col(day) + 1).drop("__n")
    return full.select(station, day)


def daily_scenario_means(
    df: DataFrame,
    keys: Sequence[str],
    pred: str = "pred",
    percentages: Sequence[int] = PERCENTAGES,
    decimals: int | None = None,
) -> DataFrame:
    """Mean prediction per key and percentage, percentages as columns `pct_kfz_<p>`."""
    means = [
        (
            F.avg(F.when(F.col("kfz_pct") == p, F.col(pred)))
            if decimals is None
            else exact_mean(F.when(F.col("kfz_pct") == p, F.col(pred)), decimals)
        ).alias(f"pct_kfz_{p}")
        for p in percentages
    ]
    return df.groupBy(*keys).agg(*means)


def scenario_means(
    df: DataFrame,
    keys: Sequence[str],
    score: Callable[[Mapping[str, Column]], Column],
    percentages: Sequence[int] = PERCENTAGES,
    features: Sequence[str] = (),
    value: str = "kfz_per_hour",
    time: str = "date_time",
) -> DataFrame:
    """keys, kfz_pct, mean: mean prediction per key and percentage, a row for each.

    `score` gives the prediction from its inputs by name: the scaled traffic and the `features`. The hours of a key meet as they are and
    are multiplied by the percentages behind the exchange, so what is shuffled does not grow with the number of percentages, and what
    groups by the same keys afterwards needs no exchange. A key, as the day of a station, has few hours.
    """
    hour = F.struct(traffic_hour(F.col(time)).alias("__daytime"), *[F.col(f"`{c}`") for c in (value, *features)])
    listed = df.groupBy(*keys).agg(F.collect_list(hour).alias("__hours"))
    copies = listed.withColumn("kfz_pct", F.explode(F.array(*[F.lit(p) for p in percentages])))

    def predicted(h: Column) -> Column:
        return score({value: _scaled(h[value], F.col("kfz_pct"), h["__daytime"]), **{c: h[c] for c in features}})

    known = copies.withColumn("__known", F.filter(F.transform("__hours", predicted), lambda p: p.isNotNull()))
    mean = F.aggregate("__known", F.lit(0.0), lambda total, p: total + p) / F.nullif(F.size("__known"), F.lit(0))
    return known.select(*keys, "kfz_pct", mean.alias("mean"))


def max_admissible_percentage(
    means: DataFrame, keys: Sequence[str], limit: Column | float, tweak: Column | float, pct: str = "kfz_pct", mean: str = "mean",
    monotone: bool = False,
) -> DataFrame:
    """Highest percentage whose daily mean + tweak stays below the limit; "not possible" if 0 % already exceeds it.

    All percentages are looked at, so the prediction need not grow with traffic. With `monotone` it is made to, so that every
    lower percentage is admissible too.
    """
    if monotone:
        means = monotone_scenarios(means, keys, pct, mean)
    limit = limit if isinstance(limit, Column) else F.lit(float(limit))
    tweak = tweak if isinstance(tweak, Column) else F.lit(float(tweak))
    adjusted = F.col(mean) + tweak
    return (
        means.groupBy(*keys)
        .agg(
            F.max(F.when(adjusted < limit, F.col(pct))).alias("__best"),
            F.max(F.when(F.col(pct) == 0, (adjusted <= limit).cast("int"))).alias("__possible"),
        )
        .select(
            *keys,
            F.when(F.col("__possible") == 1, F.coalesce(F.col("__best"), F.lit(0)).cast("string"))
            .otherwise("not possible")
            .alias("max_percentage"),
        )
    )


def monotonicity_violations(means: DataFrame, keys: Sequence[str], pct: str = "kfz_pct", mean: str = "mean") -> DataFrame:
    """How often more traffic gives a lower daily mean; a group has one row per percentage."""
    before = F.lag(mean).over(Window.partitionBy(*keys).orderBy(pct))
    falls = means.withColumn("__falls", (F.col(mean) < before).cast("int"))
    return falls.groupBy(*keys).agg(F.coalesce(F.sum("__falls"), F.lit(0)).alias("n_violations"))


def isotonic(values: Column) -> Column:
    """The array that never falls and is nearest to `values` by least squares, by pooling adjacent violators.

    Blocks of (sum, n) are kept in order. A new value is a block of its own, and takes in the blocks before it while their mean is above
    its own; every value then becomes the mean of its block. One pass over an array as long as the list of percentages.
    """
    block = "struct<s:double,n:int>"

    def mean(b: Column) -> Column:
        return b["s"] / b["n"]

    def pool(blocks: Column, value: Column) -> Column:
        def take_in(state: Column, before: Column) -> Column:
            own = state["own"]
            joins = state["open"] & (mean(before) > mean(own))
            joined = F.struct((before["s"] + own["s"]).alias("s"), (before["n"] + own["n"]).alias("n"))
            kept = F.when(joins, state["kept"]).otherwise(F.concat(F.array(before), state["kept"]))
            return F.struct(F.when(joins, joined).otherwise(own).alias("own"), kept.alias("kept"), joins.alias("open"))

        start = F.struct(
            F.struct(value.cast("double").alias("s"), F.lit(1).alias("n")).alias("own"), F.array().cast(f"array<{block}>").alias("kept"), F.lit(True).alias("open")
        )
        return F.aggregate(F.reverse(blocks), start, take_in, lambda state: F.concat(state["kept"], F.array(state["own"])))

    pooled = F.aggregate(values, F.array().cast(f"array<{block}>"), pool)
    return F.flatten(F.transform(pooled, lambda b: F.array_repeat(mean(b), b["n"])))


def monotone_scenarios(df: DataFrame, keys: Sequence[str], pct: str = "kfz_pct", pred: str = "pred") -> DataFrame:
    """(keys, pct, pred) with predictions that never fall as traffic grows, as near to the given ones as can be.

    A group has one row per percentage, so the arrays are short; rows without a prediction are left out.
    """
    known = df.where(F.col(pred).isNotNull())
    listed = known.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(F.col(pct).alias("p"), F.col(pred).alias("v")))).alias("at"))
    pooled = listed.withColumn("v", isotonic(F.transform("at", lambda x: x["v"])))
    return pooled.select(*keys, F.inline(F.arrays_zip(F.col("at.p").alias(pct), F.col("v").alias(pred))))


def scenario_contribution(
    df: DataFrame, keys: Sequence[str], by: Sequence[str] = (), pred: str = "pred", time: str = "date_time"
) -> DataFrame:
    """Share of traffic in the pollution: 100 * (1 - mean(prediction without / with all traffic)), daytime hours only."""
    day = df.where(traffic_hour(F.col(time)) & F.col("kfz_pct").isin(0, 100))
    pairs = day.groupBy(*keys).agg(
        F.max(F.when(F.col("kfz_pct") == 0, F.col(pred))).alias("__none"),
        F.max(F.when(F.col("kfz_pct") == 100, F.col(pred))).alias("__all"),
    )
    share = F.col("__none") / F.nullif(F.col("__all"), F.lit(0.0))
    return pairs.groupBy(*by).agg((100 * (1 - F.avg(share))).alias("contribution"), F.count(share).alias("n_hours"))


def scenario_forecast(
    df: DataFrame,
    target: str,
    lags: Sequence[int],
    lags_avg: Sequence[int],
    start: Column,
    forecast_days: int,
    scorer,
    percentages: Sequence[int] = PERCENTAGES,
    value: str = "kfz_per_hour",
    station: str = "station_id",
    time: str = "date_time",
    skip_incomplete: bool = False,
    average_name: str | None = None,
) -> DataFrame:
    """Hourly predictions for every station, day and percentage.

    Lags are filled from one forecast over the whole horizon at 100 %. Within a day they are replaced by the scenario's
    own predictions, and each (station, day, percentage) is a series of 24 rows.
    """
    in_range = df.where(F.col(time) <= start + hours(forecast_days * HOURS_PER_DAY))
    filled = prefill_lags(in_range, target, lags, lags_avg, start, scorer, station, time, average_name)
    future = filled.withColumn("day", day_number(F.col(time), start)).where(F.col("day").isNotNull())
    future = add_series_step(future, time, [station, "day"])
    future = future.join(complete_days_prefix(future, station, "day", skip_incomplete), [station, "day"], "left_semi")
    return recursive_forecast(
        traffic_scenarios(future, percentages, value, time),
        target, lags, lags_avg, scorer, [station, "day", "kfz_pct"], time, keep=[target], average_name=average_name,
    )


def scenario_days(predictions: DataFrame, start: Column, station: str = "station_id") -> DataFrame:
    """Daily means of a scenario forecast, with the local date on which each day starts."""
    daily = daily_scenario_means(predictions, [station, "day"])
    return daily.withColumn("date", F.to_date(to_local(start + hours(F.col("day") * HOURS_PER_DAY))))


def scenario_range(local_start: Column, forecast_days: int, latest: Column) -> tuple[Column, Column]:
    """UTC start and end of a scenario run asked for in local time.

    The start moves back to one hour after the latest observation; the end counts from the start that was asked for.
    """
    asked = to_utc(local_start)
    return clamp_start(asked, latest), asked + hours(forecast_days * HOURS_PER_DAY)


def alarm_days(days: DataFrame) -> DataFrame:
    """Days of `transgression_days` with an alarm, true or false."""
    return days.where(F.col("label").isin("True Positive", "False Positive"))


def with_suggestions(days: DataFrame, means: DataFrame, limit: float, tweak: float) -> DataFrame:
    """Days with a true or false alarm, next to the highest traffic percentage that keeps them below the limit.

    days: rows of `transgression_days`; means: station_id, day, kfz_pct, mean.
    """
    alarms = alarm_days(days)
    best = max_admissible_percentage(means, ["station_id", "day"], limit, tweak)
    return alarms.join(best, ["station_id", "day"], "left")
