import datetime as dt
import itertools
import random

import pytest
from conftest import at, hourly
from pyspark.sql import functions as F

from hourloom.functions.timefns import ntz
from hourloom.operators import folds


@pytest.mark.parametrize("test_hours, step, include", list(itertools.product([5, 24], [3, 5, 24, 30], [False, True])))
def test_arithmetic_equals_range_join(spark, test_hours, step, include):
    times = hourly("2022-01-01 00:00:00", 150)
    df = spark.createDataFrame([(t,) for t in times], "date_time TIMESTAMP_NTZ")
    n, last = 6, times[-1]
    got = {(r.fold_id, r.date_time) for r in folds.rolling_test_rows(df, "date_time", n, test_hours, step, include).collect()}
    want = set()
    for i in range(1, n + 1):
        cut = last - dt.timedelta(hours=(i - 1) * step + test_hours)
        low = cut - dt.timedelta(hours=1) if include else cut
        want |= {(i, t) for t in times if low < t <= cut + dt.timedelta(hours=test_hours)}
    assert got == want


def test_fold_invariants(spark):
    df = spark.createDataFrame([(t,) for t in hourly("2018-04-01 00:00:00", 24 * 630)], "date_time TIMESTAMP_NTZ")
    for include, most in ((False, 24), (True, 25)):
        sizes = folds.fold_sizes(df, "date_time", 90, 24, 12, train_years=1, include_current=include).collect()
        assert len(sizes) == 90
        for r in sizes:
            assert r.fold_end - r.fold_cut == dt.timedelta(hours=24)
            assert 0 < r.n_test <= most and r.n_train <= 8760
        rows = folds.rolling_test_rows(df, "date_time", 90, 24, 12, include)
        assert {r[0]: r[1] for r in rows.groupBy("fold_id").count().collect()} == {r.fold_id: r.n_test for r in sizes}
    newest = min(sizes, key=lambda r: r.fold_id)
    train = folds.train_rows(df, "date_time", F.lit(newest.fold_cut), 1, include_current=True)
    assert train.count() == newest.n_train


def test_step_zero_needs_one_fold(spark):
    df = spark.createDataFrame([(t,) for t in hourly("2022-01-01 00:00:00", 10)], "date_time TIMESTAMP_NTZ")
    assert folds.rolling_test_rows(df, "date_time", 1, 4, 0, include_current=True).count() == 5
    with pytest.raises(ValueError):
        folds.rolling_test_rows(df, "date_time", 2, 4, 0)


def test_prediction_hour_moves_the_folds(spark):
    df = spark.createDataFrame([(t,) for t in hourly("2022-11-01 00:00:00", 240)], "date_time TIMESTAMP_NTZ")
    cuts = folds.rolling_test_rows(df, "date_time", 2, 24, 24, prediction_hour=5).select("fold_cut").distinct().collect()
    assert {c[0].hour for c in cuts} == {4}


def test_steps_number_the_time_points_of_a_fold(spark):
    data = [("a", 1, at("2022-01-01 01:00:00")), ("a", 2, at("2022-01-01 03:00:00")), ("a", 1, at("2022-01-01 03:00:00")), ("b", 1, at("2022-01-01 03:00:00"))]
    df = spark.createDataFrame(data, "fold_id STRING, station INT, date_time TIMESTAMP_NTZ")
    got = sorted((r.fold_id, r.station, r.step) for r in folds.add_step(df, "date_time").collect())
    assert got == [("a", 1, 0), ("a", 1, 1), ("a", 2, 1), ("b", 1, 0)]


def test_retrain_groups_start_with_the_oldest_fold(spark):
    got = folds.add_retrain_group(spark.range(1, 8).withColumnRenamed("id", "fold_id"), 7, 3).orderBy("fold_id").collect()
    assert [r.train_group for r in got] == [2, 1, 1, 1, 0, 0, 0]
    assert [r.train_fold_id for r in got] == [1, 4, 4, 4, 7, 7, 7]


def test_holdout_and_leave_one_out(spark):
    df = spark.createDataFrame([(t,) for t in hourly("2022-01-01 00:00:00", 10)], "date_time TIMESTAMP_NTZ")
    roles = {r[0]: r[1] for r in folds.add_holdout_role(df, "date_time", 3).groupBy("role").count().collect()}
    assert roles == {"train": 6, "validation": 4}
    stations = spark.createDataFrame([(1, 1), (2, 1), (3, 3), (4, 4)], "row INT, station_id INT")
    sizes = {r.station_id: (r.n_test, r.n_train) for r in folds.leave_one_out_sizes(stations).collect()}
    assert sizes == {1: (2, 2), 3: (1, 3), 4: (1, 3)}
    train, test = folds.leave_one_out(stations, 1)
    assert [r.row for r in train.orderBy("row").collect()] == [3, 4] and [r.row for r in test.orderBy("row").collect()] == [1, 2]
    with pytest.raises(KeyError):
        folds.leave_one_out_sizes(stations.drop("station_id"))


def test_last_time_can_be_given(spark):
    df = spark.createDataFrame([(t,) for t in hourly("2022-01-01 00:00:00", 100)], "date_time TIMESTAMP_NTZ")
    got = folds.rolling_test_rows(df, "date_time", 1, 4, last=ntz("2022-01-02 00:00:00")).agg(F.min("date_time"), F.max("date_time")).first()
    assert tuple(got) == (at("2022-01-01 21:00:00"), at("2022-01-02 00:00:00"))


@pytest.mark.parametrize("include", [False, True])
def test_fold_sizes_of_times_between_hours(spark, include):
    draw = random.Random(3)
    first = at("2022-01-01")
    times = [first + dt.timedelta(seconds=draw.randrange(40 * 86_400)) for _ in range(3000)] + [first + dt.timedelta(hours=h) for h in range(960)]
    df = spark.createDataFrame([(t,) for t in times], "date_time TIMESTAMP_NTZ")
    last = first + dt.timedelta(hours=959)
    got = folds.fold_sizes(df, "date_time", 12, 48, 36, train_years=240 / folds.HOURS_PER_YEAR, include_current=include, last=F.lit(last)).collect()
    assert [r.fold_id for r in sorted(got)] == list(range(1, 13))
    for r in got:
        split = r.fold_cut - dt.timedelta(hours=1 if include else 0)
        assert r.fold_cut == last - dt.timedelta(hours=(r.fold_id - 1) * 36 + 48)
        assert r.n_test == sum(split < t <= r.fold_end for t in times)
        assert r.n_train == sum(r.fold_cut - dt.timedelta(hours=240) < t <= split for t in times)
