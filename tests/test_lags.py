import random

import pandas as pd
import pytest
from conftest import at, hourly
from pyspark.sql import functions as F

from hourloom.functions.timefns import ntz
from hourloom.operators import lags, mapping
from hourloom.sources import merge


def table(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


@pytest.mark.parametrize("chunk", [30, 64, 1000])
def test_blocked_lags_equal_plain_lags_with_a_hot_key(spark, chunk):
    draw = random.Random(1)
    start = pd.Timestamp("2024-01-01")
    data = []
    for i in range(3000):
        key = "hot" if draw.random() < 0.6 else draw.choice(["a", "b", None])
        burst = draw.random() < 0.4
        moment = start + pd.Timedelta(minutes=17 if burst else draw.randrange(5000), seconds=0 if burst else draw.randrange(60))
        data.append((key, moment.to_pydatetime(), i, draw.random() if draw.random() < 0.9 else None))
    df = spark.createDataFrame(data, "k STRING, ts TIMESTAMP_NTZ, id INT, v DOUBLE")
    wanted = {"v": (1, 7, 24), "id": (2,)}
    plain = lags.add_row_lags(df, ["k"], ["ts", "id"], wanted)
    minute = F.floor(F.unix_timestamp("ts") / 60)
    blocked = lags.add_row_lags_blocked(df, ["k"], ["ts", "id"], wanted, minute, rows_per_chunk=chunk)
    assert blocked.columns == plain.columns
    assert table(blocked, "id") == table(plain, "id")


def test_blocked_lags_need_chunks_longer_than_the_lag(spark):
    df = spark.createDataFrame([(1, 1, 1.0)], "k INT, i INT, v DOUBLE")
    with pytest.raises(ValueError):
        lags.add_row_lags_blocked(df, ["k"], ["i"], {"v": (5,)}, F.col("i"), rows_per_chunk=4)


def series(spark, gap=True):
    data = [(s, t, float(i + 100 * s)) for s in (1, 2) for i, t in enumerate(hourly("2022-01-01 00:00:00", 30)) if not (gap and i == 7)]
    return spark.createDataFrame(data, "station_id INT, date_time TIMESTAMP_NTZ, y DOUBLE")


def test_station_lags_match_pandas(spark):
    df = series(spark).withColumn("y_train", F.when(F.col("y") % 3 != 0, F.col("y")))
    got = lags.add_station_lags(df, "y", [2, 4], [1, 2]).toPandas().sort_values(["station_id", "date_time"])
    raw = got[["station_id", "date_time", "y", "y_train"]].copy()
    for suffix in ("", "_train"):
        for k in (1, 2, 4):
            raw[f"y_lag{k}{suffix}"] = raw.groupby("station_id")["y" + suffix].shift(k)
        raw[f"lag_avg_(1, 2){suffix}"] = raw[[f"y_lag1{suffix}", f"y_lag2{suffix}"]].mean(axis=1)
    pd.testing.assert_frame_equal(got[raw.columns].reset_index(drop=True), raw.reset_index(drop=True))


def test_no_lags_leave_the_frame_alone(spark):
    df = series(spark)
    assert lags.add_station_lags(df, "y", [], []).columns == df.columns


def test_time_lags_see_the_gap(spark):
    got = {(r.station_id, r.date_time.day, r.date_time.hour): r.y_la1 for r in lags.add_time_lags(series(spark), ["station_id"], "date_time", {"y": (1,)}).collect()}
    assert got[1, 1, 8] is None and got[1, 1, 9] == 108.0 and got[2, 1, 0] is None


def test_lookback_fills_the_first_lags(spark):
    lo, hi = ntz("2022-01-01 10:00:00"), ntz("2022-01-01 20:00:00")
    got = lags.with_lookback(series(spark, False), "date_time", lo, hi, 5, lambda d: lags.add_row_lags(d, ["station_id"], ["date_time"], {"y": (5, 6)}))
    first = got.where("station_id = 1").orderBy("date_time").first()
    assert (first.date_time, first.y_la5, first.y_la6) == (at("2022-01-01 10:00:00"), 105.0, None)
    assert got.count() == 22


def test_lag_band_is_null_if_one_is(spark):
    made = lags.add_lag_band(lags.add_row_lags(series(spark, False), ["station_id"], ["date_time"], {"y": (1, 2, 3)}), "y", (1, 2, 3))
    values = [r[0] for r in made.where("station_id = 1").orderBy("date_time").select("y_la1to3").limit(5).collect()]
    assert values == [None, None, None, 101.0, 102.0]


def test_lag_then_map_equals_map_then_lag(spark):
    source = spark.createDataFrame(
        [(c, t, float(i * (c + 1))) for c in range(3) for i, t in enumerate(hourly("2022-01-01 00:00:00", 20))], "cell INT, date_time TIMESTAMP_NTZ, v DOUBLE"
    )
    cells = spark.createDataFrame([(x, y, (x + y) % 4) for x in range(5) for y in range(5)], "x INT, y INT, cell INT")
    before = mapping.lag_then_expand(source, cells, ["cell"], "date_time", {"v": (1, 3)})
    after = lags.add_row_lags(mapping.expand_to_cells(source, cells, ["cell"]), ["x", "y"], ["date_time"], {"v": (1, 3)})
    columns = sorted(before.columns)
    assert before.count() == after.count() > 0
    assert before.select(columns).exceptAll(after.select(columns)).isEmpty()
    rows = before.select("x", "y", "date_time")
    attached = mapping.attach_source(rows, source, cells, ["cell"], "date_time", {"v": (1, 3)})
    assert attached.select(columns).exceptAll(after.select(columns)).isEmpty() and attached.count() == after.count()


def test_splices_do_not_overlap(spark):
    observed = spark.createDataFrame([(t, "o") for t in hourly("2022-01-01 00:00:00", 6)], "date_time TIMESTAMP_NTZ, source STRING")
    forecast = spark.createDataFrame([(t, "f") for t in hourly("2022-01-01 03:00:00", 6)], "date_time TIMESTAMP_NTZ, source STRING")
    ahead = table(merge.observations_before_forecast(observed, forecast, "date_time"), "date_time")
    assert [s for _, s in ahead] == list("ooo") + list("ffffff")
    back = table(merge.history_then_latest(observed, forecast, "date_time"), "date_time")
    assert [s for _, s in back] == list("oooooo") + list("fff")
    assert len({t for t, _ in ahead}) == 9
