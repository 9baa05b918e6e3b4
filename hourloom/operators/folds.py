"""Rolling-origin folds, retraining groups, hold-out and leave-one-out splits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hourloom.functions.timefns import HOUR, align_prediction_hour, hours

HOURS_PER_YEAR = 365 * 24


def last_time(df: DataFrame, time: str, test_hours: int, prediction_hour: int | None = None, last: Column | None = None) -> Column:
    """Upper end of the newest fold."""
    last = df.select(F.max(time)).scalar() if last is None else last
    return last if prediction_hour is None else align_prediction_hour(last, test_hours, prediction_hour)


def fold_cut(last: Column, fold_id: Column, test_hours: int, step_hours: int) -> Column:
    """Time after which fold `fold_id` (1 = newest) is tested."""
    return last - hours((fold_id - 1) * step_hours + test_hours)


def rolling_test_rows(
    df: DataFrame,
    time: str,
    n_folds: int,
    test_hours: int,
    step_hours: int | None = None,
    include_current: bool = False,
    prediction_hour: int | None = None,
    last: Column | None = None,
) -> DataFrame:
    """Every row once per fold that tests it, with `fold_id`, `fold_cut` and `fold_end`.

    Fold i tests (cut, cut + test_hours]. The ids follow from the age of a row by arithmetic, so no range join is needed
    and a row is copied at most test / step + 1 times. `include_current` moves the start of the data one hour back.
    """
    step_hours = test_hours if step_hours is None else step_hours
    width = test_hours + (1 if include_current else 0)
    end = last_time(df, time, test_hours, prediction_hour, last)
    aged = df.withColumn("__last", end).withColumn("__age", F.unix_timestamp("__last") - F.unix_timestamp(time))
    if step_hours == 0:
        if n_folds != 1:
            raise ValueError("a step of 0 hours allows one fold only")
        oldest, newest = F.lit(1), F.lit(1)
        aged = aged.where((F.col("__age") >= 0) & (F.col("__age") < width * HOUR))
    else:
        step = step_hours * HOUR
        newest = F.least(F.floor(F.col("__age") / step) + 1, F.lit(n_folds))
        oldest = F.greatest(F.floor((F.col("__age") - width * HOUR) / step) + 2, F.lit(1))
        aged = aged.where(oldest <= newest)
    ids = F.sequence(oldest.cast("int"), newest.cast("int"))
    cut = fold_cut(F.col("__last"), F.col("fold_id"), test_hours, step_hours)
    return (
        aged.withColumn("fold_id", F.explode(ids))
        .withColumn("fold_cut", cut)
        .withColumn("fold_end", F.col("fold_cut") + hours(test_hours))
        .drop("__last", "__age")
    )


def train_rows(
    df: DataFrame, time: str, cut: Column, train_years: float, include_current: bool = False
) -> DataFrame:
    """Training rows of one fold: (cut - years, cut]. Train windows are never exploded, each retraining filters once."""
    upper = cut - hours(1) if include_current else cut
    lower = cut - hours(round(train_years * HOURS_PER_YEAR))
    return df.where((F.col(time) > lower) & (F.col(time) <= upper))


def fold_sizes(
    df: DataFrame,
    time: str,
    n_folds: int,
    test_hours: int,
    step_hours: int | None = None,
    train_years: float = 3,
    include_current: bool = False,
    prediction_hour: int | None = None,
    last: Column | None = None,
) -> DataFrame:
    """Bounds and numbers of train and test rows of every fold.

    The bounds of one kind are a regular grid, so the age of a row says by arithmetic up to which fold it lies before them. Rows
    are counted per such number in one aggregation; what is added up along the folds is one row per fold.
    """
    step_hours = test_hours if step_hours is None else step_hours
    if step_hours == 0 and n_folds != 1:
        raise ValueError("a step of 0 hours allows one fold only")
    end = last_time(df, time, test_hours, prediction_hour, last)
    train_hours = round(train_years * HOURS_PER_YEAR)
    # Hours from the end of the newest fold back to its bound of each kind.
    back = {"train_from": test_hours + train_hours, "split": test_hours + (1 if include_current else 0), "end": 0}
    aged = df.select((F.unix_timestamp(end) - F.unix_timestamp(time)).alias("age"))

    def folds_before(hours_back: int) -> Column:
        """How many folds have their bound at or after the row."""
        ahead = F.col("age") - hours_back * HOUR
        within = F.when(ahead >= 0, 1).otherwise(0) if step_hours == 0 else F.floor(ahead / (step_hours * HOUR)) + 1
        return F.greatest(F.least(within, F.lit(n_folds)), F.lit(0)).cast("int")

    counted = aged.select(*[folds_before(h).alias(name) for name, h in back.items()]).groupBy(*back).agg(F.count(F.lit(1)).alias("n"))
    per_kind = F.array(*[F.struct(F.lit(name).alias("kind"), F.col(name).alias("fold_id")) for name in back])
    each = counted.select("n", F.inline(per_kind)).groupBy("fold_id").agg(*[F.sum(F.when(F.col("kind") == k, F.col("n"))).alias(k) for k in back])
    ids = df.sparkSession.range(1, n_folds + 1, 1, 1).select(F.col("id").cast("int").alias("fold_id"))
    older = Window.orderBy(F.col("fold_id").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    known = ids.join(each, "fold_id", "left").select("fold_id", *[F.coalesce(F.sum(k).over(older), F.lit(0)).alias(k) for k in back])
    return (
        known.withColumn("fold_cut", fold_cut(end, F.col("fold_id"), test_hours, step_hours))
        .withColumn("fold_end", F.col("fold_cut") + hours(test_hours))
        .select(
            "fold_id", "fold_cut", "fold_end",
            (F.col("split") - F.col("train_from")).alias("n_train"), (F.col("end") - F.col("split")).alias("n_test"),
        )
    )


def add_step(df: DataFrame, time: str, fold: str = "fold_id", name: str = "step") -> DataFrame:
    """Ordinal of the time point within its fold, from 0. All series of a fold share the numbering.

    Numbered on the distinct time points of a fold; how they meet the rows is left to the planner, which sees their number.
    """
    window = Window.partitionBy(fold).orderBy(time)
    points = df.select(fold, time).distinct().withColumn(name, F.row_number().over(window) - 1)
    return df.join(points, [fold, time])


def add_series_step(df: DataFrame, time: str, series: Sequence[str], name: str = "step") -> DataFrame:
    """Ordinal of the row within its own series, from 0."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*series).orderBy(time)) - 1)


def add_retrain_group(df: DataFrame, n_folds: int, every: int, fold: str = "fold_id") -> DataFrame:
    """The oldest fold comes first and a model serves `every` folds: group number and the fold its model is trained on."""
    group = F.floor((F.lit(n_folds) - F.col(fold)) / every).cast("int")
    return df.withColumn("train_group", group).withColumn(
        "train_fold_id", (F.lit(n_folds) - F.col("train_group") * every).cast("int")
    )


def add_holdout_role(df: DataFrame, time: str, validation_hours: int, last: Column | None = None) -> DataFrame:
    """`train` before max - span, else `validation`."""
    last = df.select(F.max(time)).scalar() if last is None else last
    is_train = F.col(time) < last - hours(validation_hours)
    return df.withColumn("role", F.when(is_train, "train").otherwise("validation"))


def leave_one_out_sizes(df: DataFrame, station: str = "station_id") -> DataFrame:
    """One fold per station: it is tested, all others train."""
    if station not in df.columns:
        raise KeyError(station)
    sizes = df.groupBy(station).agg(F.count(F.lit(1)).alias("n_test"))
    total = sizes.select(F.sum("n_test")).scalar()
    return sizes.withColumn("n_train", total - F.col("n_test"))


def leave_one_out(df: DataFrame, left_out: str | int, station: str = "station_id") -> tuple[DataFrame, DataFrame]:
    """(train, test) of one station."""
    return df.where(F.col(station) != left_out), df.where(F.col(station) == left_out)
