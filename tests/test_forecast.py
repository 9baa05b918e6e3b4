import math
import random

import numpy as np
import pytest
from conftest import at, hourly
from pyspark.sql import functions as F

from hourloom.functions.timefns import ntz
from hourloom.operators import folds
from hourloom.operators.forecast import prefill_lags, recursive_forecast
from hourloom.operators.lags import add_station_lags
from hourloom.operators.scoring import LinearScorer, StagedScorer, combine_stages
from hourloom.operators.training import StagedModel, best_iteration, fit_staged, fit_with_early_stopping

SCORER = LinearScorer({"y_lag1": 0.6, "lag_avg_(1, 2)": 0.3}, 1.0)


def series(spark, stations=3, n=40, gaps=0.15, seed=3):
    draw = random.Random(seed)
    data = [
        (f"s{s}", t, draw.random() * 50 if draw.random() > 0.1 else None)
        for s in range(stations)
        for t in hourly("2022-01-01 00:00:00", n)
        if draw.random() > gaps
    ]
    return spark.createDataFrame(data, "station_id STRING, date_time TIMESTAMP_NTZ, y DOUBLE")


def walk(rows, lags, lags_avg, score):
    """Plain statement of the recursion: rows of one fold as dicts, hour by hour."""
    done, out = {}, {}
    times = sorted({r["date_time"] for r in rows})
    for step, time in enumerate(times):
        for r in [r for r in rows if r["date_time"] == time]:
            values = dict(r)
            for k in sorted({*lags, *lags_avg}):
                if step >= k:
                    values[f"y_lag{k}"] = done.get((r["station_id"], time.timestamp() - 3600 * k))
            if step > 0:
                known = [values[f"y_lag{k}"] for k in lags_avg if values[f"y_lag{k}"] is not None]
                values["lag_avg_(1, 2)"] = sum(known) / len(known) if known else None
            pred = score(values)
            done[r["station_id"], time.timestamp()] = pred
            out[r["station_id"], time] = (pred, values)
    return out


def linear(values):
    return 1.0 + 0.6 * (values["y_lag1"] or 0.0) + 0.3 * (values["lag_avg_(1, 2)"] or 0.0)


@pytest.mark.parametrize("batch", [3, 10_000])
def test_recursion_matches_a_plain_loop(spark, batch):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        lagged = add_station_lags(series(spark), "y", [1, 3], [1, 2])
        tests = folds.add_step(folds.rolling_test_rows(lagged, "date_time", 3, 12, 6), "date_time")
        keep = ["y_lag1", "y_lag3", "lag_avg_(1, 2)"]
        got = recursive_forecast(tests, "y", [1, 3], [1, 2], SCORER, keep=keep).collect()
        by_fold = {}
        for r in tests.collect():
            by_fold.setdefault(r.fold_id, []).append(r.asDict())
        want = {(f, *key): value for f, rows in by_fold.items() for key, value in walk(rows, [1, 3], [1, 2], linear).items()}
        assert len(got) == len(want) > 60
        for r in got:
            pred, values = want[r.fold_id, r.station_id, r.date_time]
            assert math.isclose(r.pred, pred, rel_tol=1e-12)
            assert (r.y_lag3 is None or math.isnan(r.y_lag3)) == (values["y_lag3"] is None)
            if values["y_lag3"] is not None:
                assert math.isclose(r.y_lag3, values["y_lag3"], rel_tol=1e-12)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10_000)


def test_times_off_the_hour_are_an_error(spark):
    df = spark.createDataFrame([("a", at("2022-01-01 00:00:00"), 0, 1.0), ("a", at("2022-01-01 01:30:00"), 1, 1.0)], "station_id STRING, date_time TIMESTAMP_NTZ, step INT, y_lag1 DOUBLE")
    with pytest.raises(Exception, match="hourly grid"):
        recursive_forecast(df, "y", [1], [], LinearScorer({"y_lag1": 1.0}), ["station_id"]).collect()


def fixture_frame(spark):
    data = [("314", t, float(i) if i < 10 else None, 1.0) for i, t in enumerate(hourly("2021-01-01 00:00:00", 25))]
    return spark.createDataFrame(data, "station_id STRING, date_time TIMESTAMP_NTZ, y DOUBLE, feature DOUBLE")


def test_prefilled_lags_are_consistent(spark):
    start, lags, average = at("2021-01-01 03:00:00"), [1, 2, 3], "lag_avg_(1, 2)"
    before = fixture_frame(spark)
    got = prefill_lags(before, "y", lags, [1, 2], ntz("2021-01-01 03:00:00"), SCORER).orderBy("date_time").toPandas()
    assert got[["station_id", "y", "feature"]].equals(before.orderBy("date_time").toPandas()[["station_id", "y", "feature"]])
    one, two, three = (got[f"y_lag{k}"].to_numpy() for k in lags)
    assert np.array_equal(one[3:-2], two[4:-1]) and np.array_equal(one[3:-2], three[5:])
    assert np.allclose(got[average][2:], (one[2:] + two[2:]) / 2)
    after = got["date_time"] > start
    assert not got.loc[after, ["y_lag1", "y_lag2", "y_lag3", average]].isna().any().any()
    assert list(one[1:5]) == [0.0, 1.0, 2.0, 3.0]
    value, previous = 3.0, 2.0
    for i in range(5, 25):
        value, previous = 1.0 + 0.6 * value + 0.3 * (value + previous) / 2, value
        assert math.isclose(one[i], value)


@pytest.fixture(scope="module")
def trained(spark):
    draw = random.Random(5)
    data = []
    for t in hourly("2022-01-01 00:00:00", 600):
        kind = draw.choice(["low", "mid", "high", "top"])
        x = draw.random() * 10 if draw.random() > 0.1 else None
        level = {"low": 1, "mid": 9, "high": 4, "top": 13}[kind]
        data.append(("a", t, level + (x or 5.0) ** 2 / 10 + draw.random(), x, kind))
    df = spark.createDataFrame(data, "station_id STRING, date_time TIMESTAMP_NTZ, y DOUBLE, x DOUBLE, kind STRING")
    df = add_station_lags(df, "y", [1], [1, 2], average_name="avg")
    params = {"maxIter": 4, "maxDepth": 4, "stepSize": 0.4}
    return df, fit_staged(df, "y", ["kind"], ["kind", "x", "y_lag1", "avg"], ["kind"], params, params)


def test_tree_scorer_equals_the_pipeline(spark, trained):
    df, model = trained
    got = model.transform(df).toPandas()
    scorer = model.scorer(spark)
    columns = {name: got[name].to_numpy() for name in scorer.features}
    assert np.allclose(scorer.score(columns), got["pred"].to_numpy())
    assert np.allclose(got["pred"], np.maximum(got["pred_stage_1"] + got["pred_stage_2"], 0))
    assert got["pred"].nunique() > 20


def test_recursion_with_trees_uses_its_own_predictions(spark, trained):
    df, model = trained
    tests = folds.add_step(folds.rolling_test_rows(df, "date_time", 1, 24), "date_time")
    got = recursive_forecast(tests, "y", [1], [1, 2], model.scorer(spark), keep=["y_lag1"], average_name="avg").orderBy("date_time").toPandas()
    assert np.array_equal(got["y_lag1"].to_numpy()[1:], got["pred"].to_numpy()[:-1])


def test_model_survives_saving(spark, trained, tmp_path):
    df, model = trained
    model.save(str(tmp_path / "m"))
    again = StagedModel.load(str(tmp_path / "m"), model.features_1, model.features_2, model.categorical)
    assert again.transform(df).select("pred").collect() == model.transform(df).select("pred").collect()


def test_one_stage_is_not_clipped(spark):
    df = spark.createDataFrame([(-5.0, 2.0), (-1.0, 3.0)], "a DOUBLE, b DOUBLE")
    assert [tuple(r) for r in df.select(combine_stages(F.col("a"), None), combine_stages(F.col("a"), F.col("b"))).collect()] == [(-5.0, 0.0), (-1.0, 2.0)]
    first, second = LinearScorer({"a": 1.0}), LinearScorer({"b": 1.0})
    columns = {"a": np.array([-5.0, -1.0]), "b": np.array([2.0, 3.0])}
    assert list(StagedScorer(first).score(columns)) == [-5.0, -1.0]
    assert list(StagedScorer(first, second).score(columns)) == [0.0, 2.0]


def test_early_stopping_rule():
    assert best_iteration([5, 4, 3.99, 3.98, 3.97], 2, 0.05) == 2
    assert best_iteration([5, 4, 3, 2], 2, 0.05) == 4
    assert best_iteration([1.0], 2, 5.0) == 1


def test_early_stopping_on_what_is_left_over(spark, trained):
    df, _ = trained
    roles = folds.add_holdout_role(df, "date_time", 48)
    train, held = roles.where("role = 'train'"), roles.where("role = 'validation'")
    params = {"maxIter": 4, "maxDepth": 3, "stepSize": 0.4}
    first, rounds = fit_with_early_stopping(train, held, "y", ["kind"], ["kind"], params)
    both, _ = fit_with_early_stopping(train, held, "y", ["x"], ["kind"], params, first=first)
    assert 1 <= rounds <= 4 and both.first is first.first

    def error(model):
        return model.transform(held).agg(F.avg((F.col("y") - F.col("pred")) ** 2)).first()[0]

    assert error(both) < error(first)


def test_doubled_hours_are_forecast_once(spark):
    data = [("a", t, float(i % 7)) for i, t in enumerate(hourly("2021-01-01 00:00:00", 60))]
    doubled = data + [(s, t, y - 5.0) for s, t, y in data[::3]]
    scorer = LinearScorer({"y_lag1": 0.5}, 1.0)
    frames = [spark.createDataFrame(d, "station_id STRING, date_time TIMESTAMP_NTZ, y DOUBLE") for d in (data, doubled)]
    start = F.lit(data[30][1])
    once, twice = (sorted(tuple(r) for r in prefill_lags(f, "y", [1], [], start, scorer).collect()) for f in frames)
    assert once == twice
