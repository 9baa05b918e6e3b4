import pytest
from conftest import at, hourly
from pyspark.sql import functions as F

from hourloom.functions.timefns import ntz
from hourloom.operators import cleaning


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def test_drop_empty_series(spark):
    df = spark.createDataFrame(
        [(1, None, 1.0), (1, None, 2.0), (2, 5.0, None), (2, 6.0, None), (3, 7.0, 4.0), (None, 1.0, 1.0)],
        "station_id INT, depvar DOUBLE, other DOUBLE",
    )
    kept = cleaning.drop_empty_series(df, "depvar").select("station_id", "depvar", "other")
    assert rows(kept, "depvar") == [(2, 5.0, None), (2, 6.0, None), (3, 7.0, 4.0)]


def test_cap_outliers_keeps_nulls(spark):
    df = spark.createDataFrame([(float(i), float(i), float(i)) for i in range(1, 6)] + [(None, None, 9.0)], "no2 DOUBLE, pm10 DOUBLE, pm25 DOUBLE")
    caps = {"no2": 2.0, "pm10": 3.0, "pm25": 4.0}
    got = rows(cleaning.cap_outliers(df, caps))
    assert got == [(1, 1, 1), (2, 2, 2), (2, 3, 3), (2, 3, 4), (2, 3, 4), (None, None, 4)]
    assert tuple(cleaning.count_outliers(df, caps).first()) == (3, 2, 2)


def test_cap_for_training_picks_columns_by_name(spark):
    names = ["no2", "no2_lag_981", "no2_sth", "pm25", "lag_avg_(1, 2, 3)", "cams_no2_la4"]
    df = spark.createDataFrame([tuple(float(i) for _ in names) for i in range(1, 7)], names)
    capped = cleaning.cap_for_training(df, "no2", 3.0)
    for name in names:
        values = [r[0] for r in capped.select(f"`{name}`").collect()]
        assert values == ([1, 2, 3, 3, 3, 3] if name in ("no2", "no2_lag_981", "lag_avg_(1, 2, 3)") else [1, 2, 3, 4, 5, 6])


def test_fix_column_types(spark):
    df = spark.createDataFrame([(1, 2, at("2022-01-01"), 3)], "col1 INT, col2 INT, date_time TIMESTAMP_NTZ, y_train INT")
    types = dict(cleaning.fix_column_types(df, ["col1"], ["col2"]).dtypes)
    assert types == {"col1": "string", "col2": "double", "date_time": "timestamp_ntz", "y_train": "double"}
    with pytest.raises(KeyError):
        cleaning.fix_column_types(df, ["col1"], ["col42"])


def test_completeness(spark):
    data = [(x, 0, t) for x in (1, 2) for t in hourly("2022-01-01 00:00:00", 5)]
    lo, hi = ntz("2022-01-01 00:00:00"), ntz("2022-01-01 04:00:00")
    df = spark.createDataFrame(data, "x INT, y INT, t TIMESTAMP_NTZ")
    assert tuple(cleaning.completeness(df, lo, hi).first()) == (2, 10, 10, True)
    assert tuple(cleaning.completeness(df, lo, hi, n_coords=F.lit(3)).first()) == (3, 10, 15, False)
    assert cleaning.incomplete_series(df, lo, hi).isEmpty()
    lacking = cleaning.incomplete_series(df.where("x = 1 OR t < '2022-01-01 03:00:00'"), lo, hi)
    assert rows(lacking) == [(2, 0, 3, 2)]
    empty = cleaning.completeness(df.where("x > 9"), lo, hi, n_coords=F.lit(2)).first()
    assert tuple(empty) == (2, 0, 10, False)


def test_duplicates_and_horizon(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "i INT, s STRING")
    assert rows(cleaning.duplicate_rows(df)) == [(1, "a", 2)]
    times = spark.createDataFrame([(at("2022-01-01 00:00:00"), t) for t in hourly("2022-01-01 00:00:00", 50)], "f TIMESTAMP_NTZ, t TIMESTAMP_NTZ")
    assert cleaning.within_horizon(times, 1, "t", "f").count() == 24
    assert cleaning.within_horizon(times, 2, "t", "f").agg(F.min("t"), F.max("t")).first() == (at("2022-01-02 01:00:00"), at("2022-01-03 00:00:00"))
    with pytest.raises(ValueError):
        cleaning.within_horizon(times, 3, "t", "f")
