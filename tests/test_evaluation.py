import datetime as dt
import random

import numpy as np
import pytest
from conftest import at, hourly
from pyspark.sql import functions as F

from hourloom.operators import attribution, evaluation
from hourloom.operators.scoring import LinearScorer
from hourloom.operators.search import sample_parameters
from hourloom.operators.station_average import attach_weighted_average, class_means, lag_class_means


def test_daily_means_close_on_the_right(spark):
    data = [(s, t, float(i)) for s in ("3141", "2718") for i, t in enumerate(hourly("2020-12-31 23:00:00", 49))]
    df = spark.createDataFrame(data, "station_id STRING, date_time TIMESTAMP_NTZ, pred DOUBLE")
    got = {(r.station_id, str(r.day)): r.pred for r in evaluation.daily_local_means(df, ["pred"]).collect()}
    assert got["3141", "2021-01-01"] == np.mean(range(1, 25)) and got["3141", "2021-01-02"] == np.mean(range(25, 49))
    assert got["2718", "2020-12-31"] == 0.0


@pytest.mark.parametrize("day, n", [("2022-03-27", 23), ("2022-10-30", 25), ("2022-06-01", 24)])
def test_days_of_clock_changes(spark, day, n):
    df = spark.createDataFrame([(1, t, 1.0) for t in hourly("2022-01-01 00:00:00", 24 * 365)], "station_id INT, date_time TIMESTAMP_NTZ, v DOUBLE")
    sizes = df.groupBy(evaluation.closed_right_day(F.col("date_time")).alias("d")).count()
    assert sizes.where(F.col("d").cast("string") == day).first()["count"] == n


def limit_days(spark, n=400, seed=1):
    draw = random.Random(seed)
    data = [(draw.choice("ab"), round(draw.gauss(45, 15), 1), round(draw.gauss(42, 15), 1)) for _ in range(n)]
    data += [("a", 50.0, 50.0), ("b", 50.1, 44.9), ("b", 60.0, None)]
    unmeasured = [("a", None, 60.0), ("b", None, 10.0), ("b", None, 49.0), ("a", None, None)]
    return data, spark.createDataFrame(data + unmeasured, "station_id STRING, obs DOUBLE, pred DOUBLE")


def counts(data, limit, tweak):
    tp = fn = fp = tn = 0
    for _, obs, pred in data:
        is_above, said = obs > limit, pred is not None and pred + tweak > limit
        tp, fn, fp, tn = tp + (is_above and said), fn + (is_above and not said), fp + (not is_above and said), tn + (not is_above and not said)
    return tp, fn, fp, tn


@pytest.mark.parametrize("low, high, step", [(-20, 20, 1.0), (-20, 20, 0.1), (-3, 4, 0.7)])
def test_tweak_curve_equals_counting_per_tweak(spark, low, high, step):
    data, df = limit_days(spark)
    got = {r.tweak: (r.tp, r.fn, r.fp, r.tn) for r in evaluation.tweak_curve(df, "obs", "pred", 50, low, high, step).collect()}
    n = round((high + 1 - low) / step)
    assert got == {low + i * step: counts(data, 50, low + i * step) for i in range(n)}


def test_find_tweak_value(spark):
    data, df = limit_days(spark)

    def rates(tweak):
        tp, fn, fp, tn = counts(data, 50, tweak)
        return fn / (tp + fn), fp / (fp + tn)

    want = next(t for t in range(-20, 21) if rates(t)[0] <= rates(t)[1])
    assert evaluation.find_tweak_value(df, "obs", "pred", 50).first()[0] == want
    never = spark.createDataFrame([(60.0, 0.0), (10.0, -100.0)], "obs DOUBLE, pred DOUBLE")
    assert evaluation.find_tweak_value(never, "obs", "pred", 50).first()[0] == 20.0
    empty = df.where("obs > 1000")
    assert evaluation.tweak_curve(empty, "obs", "pred", 50).where("tp + fn + fp + tn > 0").isEmpty()


def test_confusion_and_rates(spark):
    data, df = limit_days(spark)
    got = evaluation.limit_confusion(df, "obs", "pred", 50, 2.0).first()
    assert (got.tp, got.fn, got.fp, got.tn) == counts(data, 50, 2.0)
    assert got.tp_rate + got.fn_rate == 1 and got.fp_rate + got.tn_rate == 1
    only_low = evaluation.limit_confusion(df.where("obs < 20"), "obs", "pred", 50).first()
    assert (only_low.tp_rate, only_low.fn_rate, only_low.f1_above) == (0.0, 0.0, 0.0)


def test_transgressions(spark):
    df = spark.createDataFrame([("a", at("2022-01-05"), 60.0, 55.0), ("a", at("2022-01-06"), 40.0, 48.0), ("a", at("2021-01-07"), 70.0, 10.0), ("b", at("2022-02-01"), 10.0, 10.0)], "station_id STRING, day TIMESTAMP_NTZ, obs DOUBLE, pred DOUBLE")
    got = {(r.label, r.observation, r.prediction) for r in evaluation.transgression_days(df, "obs", "pred", 50, 5.3).collect()}
    assert got == {("True Positive", "60.00", "60.30"), ("False Positive", "40.00", "53.30"), ("False Negative", "70.00", "15.30")}
    months = {r.month: tuple(r)[1:] for r in evaluation.transgressions_per_month(df, "obs", "pred", 50, 5.3).collect()}
    assert months == {1: (2, 1, 2), 2: (0, 0, 0)}
    assert evaluation.transgressions_per_month(df, "obs", "pred", 50, 5.3, station="b").count() == 1


@pytest.mark.parametrize("p", [0.0, 0.5, 0.75, 0.999, 1.0])
@pytest.mark.parametrize("accuracy", [50, 10_000])
def test_exact_quantile(spark, p, accuracy):
    draw = random.Random(2)
    data = [("hot", round(draw.expovariate(0.05), 2)) for _ in range(4000)] + [("one", 7.0)] + [("few", float(i)) for i in range(7)]
    data += [("flat", 3.0)] * 500 + [("hot", None), ("none", None)]
    df = spark.createDataFrame(data, "k STRING, v DOUBLE").repartition(5)
    got = {r.k: r.quantile for r in evaluation.exact_quantile(df, ["k"], "v", p, accuracy).collect()}
    want = {k: np.quantile([v for kk, v in data if kk == k and v is not None], p) for k in ("hot", "one", "few", "flat")}
    assert got.keys() == want.keys()
    for k in want:
        assert np.isclose(got[k], want[k], rtol=1e-12, atol=1e-12)


@pytest.mark.parametrize("p", [0.0, 0.31, 0.999, 1.0])
def test_exact_quantile_of_many_values(spark, p):
    draw = random.Random(4)
    data = [("hot", draw.gauss(0, 1) if draw.random() < 0.7 else 0.5) for _ in range(30_000)] + [("few", 1.0), ("few", 2.0)]
    df = spark.createDataFrame(data, "k STRING, v DOUBLE").repartition(4)
    got = {r.k: r.quantile for r in evaluation.exact_quantile(df, ["k"], "v", p, accuracy=2000).collect()}
    for k in ("hot", "few"):
        assert np.isclose(got[k], np.quantile([v for kk, v in data if kk == k], p), rtol=1e-12, atol=1e-12)


def test_metrics(spark):
    df = spark.createDataFrame([(at("2022-01-01"), 1.0, 2.0), (at("2022-01-01"), 3.0, 3.0), (at("2022-01-02"), 5.0, 1.0), (at("2022-01-02"), None, 1.0)], "date_time TIMESTAMP_NTZ, y DOUBLE, pred DOUBLE")
    got = {r.time_point: r for r in evaluation.metrics_per_time_and_all(df, "y", "pred").collect()}
    assert set(got) == {"all", "2022-01-01 00:00:00", "2022-01-02 00:00:00"}
    assert np.isclose(got["all"].rmse, np.sqrt(17 / 3)) and np.isclose(got["all"].mae, 5 / 3) and np.isclose(got["all"].r_squared, 1 - 17 / 8)
    assert got["2022-01-02 00:00:00"].r_squared is None


def test_fold_scores(spark):
    df = spark.createDataFrame([(1, 2.0, i) for i in (3, 8, 10, 20)], "parameter_set INT, rmse DOUBLE, best_iteration INT")
    assert tuple(evaluation.fold_scores(df, ["parameter_set"]).first()) == (1, 2.0, int(np.quantile([3, 8, 10, 20], 0.75)))


def test_parameters_are_drawn_within_bounds():
    space = {"stepSize": (0.01, 0.3), "maxDepth": (3, 9)}
    sets = sample_parameters(space, 20, start_with={"stepSize": 0.1, "maxDepth": 5, "other": 1})
    assert len(sets) == 20 and sets[0] == {"stepSize": 0.1, "maxDepth": 5}
    assert all(0.01 <= s["stepSize"] <= 0.3 and 3 <= s["maxDepth"] <= 9 for s in sets)
    assert sets == sample_parameters(space, 20, start_with={"stepSize": 0.1, "maxDepth": 5})


def test_attribution_of_a_linear_model_is_exact(spark):
    df = spark.createDataFrame([(float(i), float(i * i % 7)) for i in range(20)], "a DOUBLE, b DOUBLE")
    model = LinearScorer({"a": 2.0, "b": -3.0}, 1.0)
    made = attribution.attribute(df, ["a", "b"], model.column, attribution.feature_means(df, ["a", "b"]), 3)
    rows = made.toPandas()
    assert np.allclose(rows["phi_a"], 2.0 * (rows["a"] - rows["a"].mean())) and np.allclose(rows["phi_b"], -3.0 * (rows["b"] - rows["b"].mean()))
    assert [r.feature for r in attribution.attribution_ranking(made, ["a", "b"], 1).collect()] == ["a"]


def test_weighted_average_by_hand(spark):
    typed = spark.createDataFrame(
        [("1", t, 10.0 * (i + 1), kind) for i, t in enumerate(hourly("2022-01-01 00:00:00", 3)) for kind in ("Verkehr", None, "Stadtrand") if not (i == 2 and kind == "Verkehr")],
        "station_id STRING, date_time TIMESTAMP_NTZ, no2 DOUBLE, station_type STRING",
    ).withColumn("no2", F.when(F.col("station_type") == "Verkehr", F.col("no2") * 3).otherwise(F.col("no2")))
    means = lag_class_means(class_means(typed, ["no2"]), ["no2"], [1])
    volume = spark.createDataFrame([(1, 1, 2400.0), (1, 2, 500.0), (1, 3, 99_000.0)], "x INT, y INT, kfz_per_24h DOUBLE")
    scaling = spark.createDataFrame([(0, 1.0), (2, 0.25)], "kkfz_per_24h INT, scaling_stadtrand DOUBLE")
    rows = volume.select("x", "y").crossJoin(means.select("date_time"))
    got = {(r.y, r.date_time.hour): (r.wavg_no2, r.wavg_no2_la1) for r in attach_weighted_average(rows, volume, scaling, means, ["no2"], [1]).collect()}
    assert got[1, 0] == (0.75 * 30 + 0.25 * 10, None) and got[1, 1] == (0.75 * 60 + 0.25 * 20, 0.75 * 30 + 0.25 * 10)
    assert got[1, 2] == (0.25 * 30, 0.75 * 60 + 0.25 * 20)
    assert got[2, 0] == (10.0, None) and got[3, 0] == (None, None)


def test_days_without_observation_count_nowhere(spark):
    rows = [("a", dt.date(2022, 1, 1), 60.0, 60.0), ("a", dt.date(2022, 1, 2), 10.0, 10.0), ("a", dt.date(2022, 1, 3), None, 60.0), ("a", dt.date(2022, 2, 1), None, 70.0)]
    df = spark.createDataFrame(rows, "station_id STRING, day DATE, obs DOUBLE, pred DOUBLE")
    row = evaluation.limit_confusion(df, "obs", "pred", 50).first()
    assert (row.tp, row.fn, row.fp, row.tn, row.fp_rate) == (1, 0, 0, 1, 0.0)
    assert [r.label for r in evaluation.transgression_days(df, "obs", "pred", 50, 0.0).collect()] == ["True Positive"]
    months = evaluation.transgressions_per_month(df, "obs", "pred", 50, 0.0).collect()
    assert [(r.month, r.n_observed, r.n_predicted) for r in months] == [(1, 1, 1)]


def test_quantile_bracket_holds_the_rank_at_every_size(spark):
    draw = random.Random(6)
    data = [(f"k{n}", draw.choice([draw.random(), 1.0, 2.0])) for n in (1, 2, 99, 100, 101, 150, 399, 1000) for _ in range(n)]
    df = spark.createDataFrame(data, "k STRING, v DOUBLE").repartition(5)
    for p in (0.0, 0.25, 0.5, 0.99, 1.0):
        got = {r.k: r.quantile for r in evaluation.exact_quantile(df, ["k"], "v", p, accuracy=100).collect()}
        for k, value in got.items():
            assert np.isclose(value, np.quantile([v for kk, v in data if kk == k], p), rtol=1e-12)


@pytest.mark.parametrize("p", [0.0, 0.25, 0.5, 0.999, 1.0])
def test_wide_brackets_are_narrowed(spark, p, monkeypatch):
    """A hot key of many different values, clusters of very different scale, ties: no more than `most` values of a key are ranked."""
    rng = np.random.default_rng(5)
    keys = {"hot": rng.normal(size=20_000), "scales": np.concatenate([10.0 ** rng.uniform(-9, 9, 4000), np.zeros(50)]), "ties": np.repeat([1.0, 2.0], 300), "one": np.array([3.0])}
    rows = [(k, float(v)) for k, vs in keys.items() for v in vs]
    df = spark.createDataFrame(rows, "k STRING, v DOUBLE")
    rounds, narrower = [], evaluation._narrower
    monkeypatch.setattr(evaluation, "_narrower", lambda *a: rounds.append(1) or narrower(*a))
    got = {r.k: r.quantile for r in evaluation.exact_quantile(df, ["k"], "v", p, 100, most=20).collect()}
    assert rounds and got == pytest.approx({k: np.quantile(vs, p) for k, vs in keys.items()}, rel=1e-12)
