import pytest
from conftest import at
from pyspark.sql import functions as F

from hourloom.functions import timefns as tf


def one(spark, text, expression):
    frame = spark.createDataFrame([(at(text),)], "t TIMESTAMP_NTZ")
    return frame.select(expression(F.col("t"))).first()[0]


@pytest.mark.parametrize(
    "last, hour, expected",
    [
        ("2022-11-11 11:11:11", 17, "2022-11-10 14:11:11"),
        ("2022-11-11 11:11:11", 9, "2022-11-11 06:11:11"),
        ("2022-11-11 11:11:11", 14, "2022-11-11 11:11:11"),
        ("2022-06-11 11:11:11", 17, "2022-06-10 13:11:11"),
        ("2022-06-11 11:11:11", 9, "2022-06-11 05:11:11"),
        ("2022-06-11 11:11:11", 15, "2022-06-11 11:11:11"),
    ],
)
def test_align_prediction_hour(spark, last, hour, expected):
    assert one(spark, last, lambda t: tf.align_prediction_hour(t, 46, hour)) == at(expected)


def test_traffic_hours_follow_daylight_saving(spark):
    times = [f"2022-01-01 {h:02d}:00:00" for h in (3, 4, 20, 21)]
    times += [f"2022-07-01 {h:02d}:00:00" for h in (2, 3, 19, 20)]
    times += [f"2022-03-27 {h:02d}:00:00" for h in (0, 1, 2)] + [f"2022-10-30 {h:02d}:00:00" for h in (0, 1, 2)]
    frame = spark.createDataFrame([(i, at(t)) for i, t in enumerate(times)], "i INT, t TIMESTAMP_NTZ")
    mask = [r[0] for r in frame.orderBy("i").select(tf.traffic_hour(F.col("t"))).collect()]
    assert mask == [c == "T" for c in "FTTFFTTFFFFFFF"]


@pytest.mark.parametrize("session_zone", ["UTC", "Europe/Berlin", "America/New_York"])
def test_unix_seconds_do_not_depend_on_the_session_zone(spark, session_zone):
    spark.conf.set("spark.sql.session.timeZone", session_zone)
    try:
        for text, zone, expected in [
            ("2022-06-22 09:22:49", "UTC", 1655889769),
            ("2022-06-22 09:22:49", "Europe/Berlin", 1655882569),
            ("2022-11-22 09:22:49", "UTC", 1669108969),
            ("2022-11-22 09:22:49", "Europe/Berlin", 1669105369),
        ]:
            assert one(spark, text, lambda t: tf.unix_seconds(t, zone)) == expected
        assert one(spark, "2022-03-27 02:30:00", tf.floor_hour) == at("2022-03-27 02:00:00")
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


@pytest.mark.parametrize(
    "now, twice, hourly_start",
    [
        ("2023-01-10 13:59:00", "2023-01-10 05:00:00", "2023-01-10 14:00:00"),
        ("2023-01-10 14:00:00", "2023-01-10 15:00:00", "2023-01-10 15:00:00"),
        ("2023-01-10 03:30:00", "2023-01-09 15:00:00", "2023-01-10 04:00:00"),
        ("2023-01-10 04:00:00", "2023-01-10 05:00:00", "2023-01-10 05:00:00"),
    ],
)
def test_model_start(spark, now, twice, hourly_start):
    assert one(spark, now, tf.model_start) == at(twice)
    assert one(spark, now, lambda t: tf.model_start(t, twice_daily=False)) == at(hourly_start)


def test_horizon_end(spark):
    assert one(spark, "2023-01-10 10:59:00", tf.horizon_end) == at("2023-01-14 00:00:00")
    assert one(spark, "2023-01-10 11:00:00", tf.horizon_end) == at("2023-01-15 00:00:00")


def test_clamp_start_and_bounds(spark):
    latest = tf.ntz("2023-01-10 10:00:00")
    assert one(spark, "2023-01-10 11:00:00", lambda t: tf.clamp_start(t, latest)) == at("2023-01-10 11:00:00")
    assert one(spark, "2023-01-10 12:00:00", lambda t: tf.clamp_start(t, latest)) == at("2023-01-10 11:00:00")
    assert one(spark, "2023-01-10 12:00:00", lambda t: tf.bounds(None, None, t)[1]) == at("2023-01-15 12:00:00")
    assert one(spark, "2023-01-10 12:00:00", lambda t: tf.bounds(None, None, t, False)[1]) == at("2023-01-10 12:00:00")
    assert one(spark, "2023-01-10 12:00:00", lambda t: tf.bounds(None, None, t)[0]) == at("2015-01-01 00:00:00")


def test_weekday_starts_on_monday(spark):
    assert [one(spark, f"2023-01-0{d} 00:00:00", tf.weekday) for d in (1, 2, 3)] == [7, 1, 2]
