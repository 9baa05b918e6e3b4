"""Error metrics, daily limit checks, tweak search and exact quantiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hourloom.functions.mathfns import half_even, ratio
from hourloom.functions.timefns import closed_right_day
from hourloom.session import store


def regression_metrics(df: DataFrame, target: str, pred: str, by: Sequence[str] = ()) -> DataFrame:
    """Number of pairs, RMSE, MAE and R2. NULL where R2 has no variance to explain."""
    pairs = df.where(F.col(target).isNotNull() & F.col(pred).isNotNull())
    return pairs.groupBy(*by).agg(*_metrics(target, pred))


def _metrics(target: str, pred: str) -> list[Column]:
    error = F.col(target) - F.col(pred)
    spread = F.nullif(F.var_pop(target) * F.count(F.lit(1)), F.lit(0.0))
    return [
        F.count(F.lit(1)).alias("n"),
        F.sqrt(F.avg(error * error)).alias("rmse"),
        F.avg(F.abs(error)).alias("mae"),
        (1 - F.sum(error * error) / spread).alias("r_squared"),
    ]


def metrics_per_time_and_all(df: DataFrame, target: str, pred: str, time: str = "date_time") -> DataFrame:
    """Metrics for each time point and, as time point "all", over everything; one pass with grouping sets."""
    pairs = df.where(F.col(target).isNotNull() & F.col(pred).isNotNull())
    label = F.when(F.grouping(time) == 1, "all").otherwise(F.date_format(time, "yyyy-MM-dd HH:mm:ss"))
    out = pairs.rollup(time).agg(label.alias("time_point"), *_metrics(target, pred))
    return out.drop(time)


def daily_local_means(
    df: DataFrame, values: Sequence[str], station: str = "station_id", time: str = "date_time", zone: str = "Europe/Berlin"
) -> DataFrame:
    """Means per station and local day, the day being (00:00, 24:00]. Days without rows do not appear."""
    return df.groupBy(station, closed_right_day(F.col(time), zone).alias("day")).agg(
        *[F.avg(v).alias(v) for v in values]
    )


def predictions_with_observations(
    predictions: DataFrame, observations: DataFrame, model_id: Column | int, stations: Sequence[str] | DataFrame
) -> DataFrame:
    """Predictions of one model at the given stations with the observation of the same hour, if there is one.

    Sort the result by station and time where it is shown; nothing here depends on the order.
    """
    chosen = predictions.where(F.col("model_id") == model_id)
    if isinstance(stations, DataFrame):
        chosen = chosen.join(stations.select("station_id"), "station_id", "left_semi")
    else:
        chosen = chosen.where(F.col("station_id").isin(list(stations)))
    return chosen.join(observations, ["station_id", "date_time"], "left")


def _exceeds(value: Column, limit: float) -> Column:
    """Strictly above; a missing value does not exceed."""
    return F.coalesce(value > F.lit(float(limit)), F.lit(False))


def with_observation(df: DataFrame, observed: str) -> DataFrame:
    """Days that were measured. The others say nothing about a prediction and count in no evaluation."""
    return df.where(F.col(observed).isNotNull())


def limit_confusion(
    df: DataFrame, observed: str, pred: str, limit: float, tweak: float = 0.0, by: Sequence[str] = ()
) -> DataFrame:
    """Confusion counts of "above the limit" and the rates within the observed classes (0 for an empty class)."""
    df = with_observation(df, observed)
    is_above, said_above = _exceeds(F.col(observed), limit), _exceeds(F.col(pred) + F.lit(float(tweak)), limit)
    counts = df.groupBy(*by).agg(
        F.count_if(is_above & said_above).alias("tp"),
        F.count_if(is_above & ~said_above).alias("fn"),
        F.count_if(~is_above & said_above).alias("fp"),
        F.count_if(~is_above & ~said_above).alias("tn"),
    )
    return _with_rates(counts)


def _with_rates(counts: DataFrame) -> DataFrame:
    """Rates and the F1 score of both classes, computed from the rates."""
    above, below = F.col("tp") + F.col("fn"), F.col("fp") + F.col("tn")
    rated = counts.withColumns(
        {
            "tp_rate": ratio(F.col("tp"), above),
            "fn_rate": ratio(F.col("fn"), above),
            "fp_rate": ratio(F.col("fp"), below),
            "tn_rate": ratio(F.col("tn"), below),
        }
    )
    wrong = F.col("fp_rate") + F.col("fn_rate")
    return rated.withColumns(
        {
            "f1_above": ratio(2 * F.col("tp_rate"), 2 * F.col("tp_rate") + wrong),
            "f1_below": ratio(2 * F.col("tn_rate"), 2 * F.col("tn_rate") + wrong),
        }
    )


def tweak_curve(
    df: DataFrame, observed: str, pred: str, limit: float, low: int = -20, high: int = 20, step: float = 1.0
) -> DataFrame:
    """Confusion counts and rates for every tweak low, low + step, .. up to high + 1 (exclusive).

    A row flips to "predicted above" at one place of the grid and stays there. So each row is reduced to the index of
    that place, rows are counted per index, and the counts are summed along the grid: no row is multiplied by the grid.
    """
    df = with_observation(df, observed)
    n = max(round((high + 1 - low) / step), 0)
    level = F.lit(float(limit))

    def tweak(i: Column) -> Column:
        return F.lit(float(low)) + i * F.lit(float(step))

    guess = F.floor((level - F.col(pred) - F.lit(float(low))) / F.lit(float(step)))
    first = F.greatest(F.least(guess - 1, F.lit(n)), F.lit(0)).cast("int")
    final = F.least(F.greatest(guess + 2, F.lit(-1)), F.lit(n - 1)).cast("int")
    # The estimate may be off by a rounding error; the comparison itself decides.
    hit = F.array_min(F.filter(F.sequence(first, final), lambda i: F.col(pred) + tweak(i) > level))
    flips_at = F.coalesce(F.when(final < first, first).otherwise(F.coalesce(hit, final + 1)), F.lit(n))
    flips = (
        df.select(flips_at.alias("i"), _exceeds(F.col(observed), limit).alias("above"))
        .groupBy("i")
        .agg(F.count_if("above").alias("above"), F.count_if(~F.col("above")).alias("below"))
    )
    so_far = Window.orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.orderBy("i").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    grid = df.sparkSession.range(0, n + 1, 1, 1).select(F.col("id").cast("int").alias("i"))
    counts = grid.join(flips, "i", "left").select(
        "i",
        F.coalesce(F.sum("above").over(so_far), F.lit(0)).alias("tp"),
        (F.coalesce(F.sum("above").over(whole), F.lit(0)) - F.coalesce(F.sum("above").over(so_far), F.lit(0))).alias("fn"),
        F.coalesce(F.sum("below").over(so_far), F.lit(0)).alias("fp"),
        (F.coalesce(F.sum("below").over(whole), F.lit(0)) - F.coalesce(F.sum("below").over(so_far), F.lit(0))).alias("tn"),
    )
    curve = counts.where(F.col("i") < n).withColumn("tweak", tweak(F.col("i")))
    return _with_rates(curve.select("tweak", "tp", "fn", "fp", "tn"))


def find_tweak_value(
    df: DataFrame, observed: str, pred: str, limit: float, low: int = -20, high: int = 20, step: float = 1.0
) -> DataFrame:
    """Smallest tweak whose miss rate is not above its false-alarm rate, else the last tweak of the grid."""
    curve = tweak_curve(df, observed, pred, limit, low, high, step)
    found = F.min(F.when(F.col("fn_rate") <= F.col("fp_rate"), F.col("tweak")))
    return curve.agg(F.coalesce(found, F.max("tweak")).alias("tweak"))


def transgression_days(df: DataFrame, observed: str, pred: str, limit: float, tweak: float) -> DataFrame:
    """Days above the limit, observed or predicted, labelled; values also as text with two digits."""
    is_above, said_above = _exceeds(F.col(observed), limit), _exceeds(F.col(pred) + F.lit(float(tweak)), limit)
    label = (
        F.when(is_above & said_above, "True Positive")
        .when(~is_above & said_above, "False Positive")
        .when(is_above & ~said_above, "False Negative")
    )
    return (
        with_observation(df, observed)
        .withColumn("label", label)
        .where(F.col("label").isNotNull())
        .select(
            "station_id",
            "day",
            "label",
            F.format_string("%.2f", half_even(F.col(observed), 2)).alias("observation"),
            F.format_string("%.2f", half_even(F.col(pred) + F.lit(float(tweak)), 2)).alias("prediction"),
        )
    )


def transgressions_per_month(
    df: DataFrame, observed: str, pred: str, limit: float, tweak: float, day: str = "day", station: str | None = None
) -> DataFrame:
    """Days above the limit per calendar month (all years together)."""
    df = with_observation(df, observed)
    if station is not None:
        df = df.where(F.col("station_id") == station)
    return df.groupBy(F.month(day).alias("month")).agg(
        F.count_if(_exceeds(F.col(observed), limit)).alias("n_observed"),
        F.count_if(_exceeds(F.col(pred), limit)).alias("n_predicted"),
        F.count_if(_exceeds(F.col(pred) + F.lit(float(tweak)), limit)).alias("n_predicted_tweaked"),
    )


#: Parts that a wide bracket is cut into, and rounds that narrow it: enough for any 64-bit value.
BRACKET_PARTS, BRACKET_ROUNDS = 4096, 200


def _narrower(values: DataFrame, brackets: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The brackets cut down to the part that holds the rank; the window of a key has one row per part."""
    placed = values.join(brackets, list(keys)).where(F.col("__v") <= F.col("__high"))
    width = F.col("__high") - F.col("__low")
    part = F.when(width > 0, F.least(F.floor((F.col("__v") - F.col("__low")) / width * BRACKET_PARTS), F.lit(BRACKET_PARTS - 1))).otherwise(0)
    part = F.when(F.col("__v") >= F.col("__low"), part)  # NULL below the bracket, which comes first in the order
    counted = placed.groupBy(*keys, "__rank", part.alias("__part")).agg(F.count(F.lit(1)).alias("__n"), F.min("__v").alias("__least"), F.max("__v").alias("__most"))
    up_to = Window.partitionBy(*keys).orderBy(F.col("__part").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = counted.withColumn("__last", F.sum("__n").over(up_to) - 1)

    def part_at(rank: Column) -> Column:
        holds = (F.col("__last") - F.col("__n") + 1 <= rank) & (rank <= F.col("__last"))
        return F.max(F.when(holds, F.struct("__part", "__least", "__most")))

    found = ranked.groupBy(*keys, "__rank").agg(part_at(F.floor("__rank")).alias("a"), part_at(F.ceil("__rank")).alias("b"))
    same = F.col("a.__part") == F.col("b.__part")
    # Between two parts the rank lies between the last value of the one and the first of the other.
    low, high = F.when(same, F.col("a.__least")).otherwise(F.col("a.__most")), F.when(same, F.col("a.__most")).otherwise(F.col("b.__least"))
    return found.select(*keys, "__rank", low.alias("__low"), high.alias("__high"))


def exact_quantile(
    df: DataFrame, keys: Sequence[str], value: str, p: float, accuracy: int = 10_000, name: str = "quantile", most: int = 100_000,
) -> DataFrame:
    """Exact quantile with linear interpolation per key, in two passes or a few more.

    The built-in percentile holds every distinct value of a key in one buffer. Here a mergeable sketch, whose rank error
    is at most n / accuracy, first brackets the wanted rank of each key: three such errors to either side, which is enough from
    n = accuracy on; a key of fewer rows is bracketed by its extremes. While a bracket holds more than `most` different values, it is
    cut into BRACKET_PARTS equal parts that are counted, and the part that holds the rank is the next one. The last pass counts what lies
    below and inside, and ranks the values inside, so no task ranks more than `most` of a key. A bracket that misses the rank would
    raise an error.
    """
    margin = 3.0 / accuracy
    low_p, high_p = max(p - margin, 0.0), min(p + margin, 1.0)
    filled = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("__v"))
    few = F.col("__n") < accuracy
    low = F.when(few | F.lit(low_p == 0.0), F.col("__min")).otherwise(F.col("__cut")[0])
    high = F.when(few | F.lit(high_p == 1.0), F.col("__max")).otherwise(F.col("__cut")[1])
    brackets = (
        filled.groupBy(*keys)
        .agg(
            F.min("__v").alias("__min"), F.max("__v").alias("__max"), F.count(F.lit(1)).alias("__n"),
            F.percentile_approx("__v", [low_p, high_p], accuracy).alias("__cut"),
        )
        .select(*keys, (F.lit(p) * (F.col("__n") - 1)).alias("__rank"), low.alias("__low"), high.alias("__high"), "__n")
    )
    known = store(brackets, "quantile-brackets")
    # What a bracket can hold follows from the rows of its key; only where that is too much the values inside are counted.
    can_hold = known.agg(F.max(F.when(few, F.col("__n")).otherwise(8 * F.col("__n") / accuracy))).first()[0]
    known = known.drop("__n")
    for _ in range(BRACKET_ROUNDS if (can_hold or 0) > most else 0):
        inside = filled.join(known, list(keys)).where(F.col("__v").between(F.col("__low"), F.col("__high")))
        held = inside.groupBy(*keys).agg(F.approx_count_distinct("__v").alias("n")).agg(F.max("n")).first()[0]
        if (held or 0) <= most:
            break
        known = store(_narrower(filled, known, keys), "quantile-brackets")
    placed = filled.join(known, list(keys)).where(F.col("__v") <= F.col("__high"))
    # What lies below the bracket is one row per key with a NULL value; NULL comes first in the order.
    inside = F.when(F.col("__v") >= F.col("__low"), F.col("__v"))
    counted = placed.groupBy(*keys, "__rank", inside.alias("__v")).agg(F.count(F.lit(1)).alias("__n"))
    up_to = Window.partitionBy(*keys).orderBy(F.col("__v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = counted.withColumn("__last", F.sum("__n").over(up_to) - 1)
    first = F.col("__last") - F.col("__n") + 1

    def value_at(rank: Column) -> Column:
        return F.max(F.when((first <= rank) & (rank <= F.col("__last")), F.col("__v")))

    found = ranked.groupBy(*keys, "__rank").agg(
        value_at(F.floor("__rank")).alias("__lower"), value_at(F.ceil("__rank")).alias("__upper")
    )
    share = F.col("__rank") - F.floor("__rank")
    between = F.col("__lower") + (F.col("__upper") - F.col("__lower")) * share
    checked = F.when(between.isNull(), F.raise_error(F.lit("the bracket of a quantile misses its rank"))).otherwise(between)
    return found.select(*keys, checked.cast("double").alias(name))


def fold_scores(folds: DataFrame, by: Sequence[str], rmse: str = "rmse", iteration: str = "best_iteration") -> DataFrame:
    """Score of a parameter set: mean error over its folds and the 0.75 quantile of the best rounds, as whole number."""
    return folds.groupBy(*by).agg(
        F.avg(rmse).alias("avg_rmse"), F.percentile(F.col(iteration), F.lit(0.75)).cast("int").alias("best_iteration")
    )
