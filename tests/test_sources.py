import pytest
from conftest import at
from pyspark.sql import functions as F

from hourloom.functions.timefns import ntz
from hourloom.operators.training import fit_staged
from hourloom.sources import merge, outputs, registry, tables

DDL = "station STRING, hour INT, value DOUBLE"


def stored(spark, path):
    return sorted(tuple(r) for r in spark.read.parquet(path).select("station", "hour", "value").collect())


def test_replace_rewrites_only_touched_partitions(spark, tmp_path):
    path = str(tmp_path / "t")

    def put(rows, **how):
        return merge.write_rows(spark, spark.createDataFrame(rows, DDL), path, keys=["station", "hour"], partition_by=["station"], **how)

    assert put([("a", 1, 1.0), ("a", 2, 2.0), ("b", 1, 5.0)])
    untouched = sorted(p.name for p in (tmp_path / "t" / "station=b").iterdir())
    assert put([("a", 2, 20.0), ("c", 1, 9.0)])
    assert put([("a", 2, 20.0), ("c", 1, 9.0)])
    assert stored(spark, path) == [("a", 1, 1.0), ("a", 2, 20.0), ("b", 1, 5.0), ("c", 1, 9.0)]
    assert sorted(p.name for p in (tmp_path / "t" / "station=b").iterdir()) == untouched
    assert put([("a", 1, 1.0)], mode="insert")
    assert len(stored(spark, path)) == 5
    assert put([])
    assert len(stored(spark, path)) == 5
    with pytest.raises(ValueError):
        put([("a", 1, 1.0)], mode="upsert")
    with pytest.raises(ValueError):
        merge.write_rows(spark, spark.createDataFrame([("a", 1, 1.0)], DDL), path, keys=["hour"], partition_by=["station"])


def test_replace_computes_its_rows_once_and_orders_ties(spark, tmp_path):
    path, seen = str(tmp_path / "t"), spark.sparkContext.accumulator(0)

    def marked(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch

    rows = [("a", 1, float(v)) for v in (3, 9, 5)] + [("b", 2, 1.0)]
    for order in (rows, rows[::-1]):
        frame = spark.createDataFrame(order, DDL).mapInPandas(marked, DDL)
        before = seen.value
        merge.write_rows(spark, frame, path, keys=["station", "hour"], partition_by=["station"])
        assert seen.value - before == 4 and stored(spark, path) == [("a", 1, 9.0), ("b", 2, 1.0)]
    merge.write_rows(spark, spark.createDataFrame(rows, DDL), path, keys=["station", "hour"], partition_by=["station"], newest_first=[F.asc("value")])
    assert stored(spark, path) == [("a", 1, 3.0), ("b", 2, 1.0)]


def test_replace_keeps_rows_of_missing_partition_values(spark, tmp_path):
    path, ddl = str(tmp_path / "t"), "station STRING, hour INT, part STRING, value DOUBLE"

    def put(*rows):
        frame = spark.createDataFrame(rows, ddl)
        merge.write_rows(spark, frame, path, keys=["station", "hour", "part"], partition_by=["station", "part"])

    put((None, 1, "p", 1.0), (None, 2, "p", 2.0), ("a", 1, None, 3.0), ("a", 1, "p", 4.0))
    put((None, 2, "p", 20.0), ("a", 1, "p", 40.0))
    got = sorted((r.station or "", r.hour, r.part or "", r.value) for r in spark.read.parquet(path).collect())
    assert got == [("", 1, "p", 1.0), ("", 2, "p", 20.0), ("a", 1, "", 3.0), ("a", 1, "p", 40.0)]


def test_latest_per_key_limits_rows_before_the_exchange(spark):
    df = spark.createDataFrame([("a", i, float(i)) for i in range(50)] + [("b", 1, 1.0)], DDL)
    latest = merge.latest_per_key(df, ["station"], [F.desc("hour")])
    assert sorted(tuple(r) for r in latest.collect()) == [("a", 49, 49.0), ("b", 1, 1.0)]
    plan = latest._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Exchange") < plan.rindex("WindowGroupLimit")


def test_registry_round_trip(spark, tmp_path):
    path, models, final = str(tmp_path / "registry"), str(tmp_path / "models"), str(tmp_path / "final")
    df = spark.createDataFrame([(float(i), i % 3 + 0.5, at("2022-01-01")) for i in range(60)], "y DOUBLE, x DOUBLE, date_time TIMESTAMP_NTZ")
    model = fit_staged(df, "y", ["x"], None, [], {"maxIter": 2, "maxDepth": 2})
    text = registry.training_description(df, "date_time", {"eta": 0.1}, [24], [1, 2]).first()[0]
    assert text == '{"eta":0.1,"lags":"[24]","lags_avg":"[1, 2]","training_period":["2022-01-01 00:00:00","2022-01-01 00:00:00"]}'
    ids = [registry.register_model(spark, path, models, model, "no2", f"temporal_{i}", text, None, 1) for i in range(2)]
    assert ids == [1, 2]
    known = spark.read.parquet(path)
    row = registry.model_row(known, 2)
    assert row.model_name == "temporal_1" and row.features_2 is None
    assert registry.available_models(known, "temporal%", "no2").count() == 2 and registry.available_models(known, "%", "pm10").isEmpty()
    settings = registry.model_settings(known).where("model_id = 1").first()
    assert settings.lags == [24] and settings.lags_avg == [1, 2] and settings.metric_feature_cols == ["x"] and settings.max_training_date_model_2 is None
    with pytest.raises(ValueError, match="not registered"):
        registry.model_row(known, 9)
    with pytest.raises(ValueError, match="more than once"):
        registry.model_row(known.unionByName(known), 1)
    for model_id in (1, 2):
        registry.promote_model(spark, final, "no2", "temporal", model_id)
    registry.promote_model(spark, final, "no2", "spatial", 1)
    chosen = spark.read.parquet(final)
    got = spark.range(1).select(registry.final_model_id(chosen, "temporal", "no2"), registry.final_model_id(chosen, "spatial", "no2")).first()
    assert tuple(got) == (2, 1) and chosen.count() == 2


def test_outputs(spark):
    df = spark.createDataFrame([(at("2022-01-01 01:00:00"), 1, 2, 50, "s", 12.25, at("2022-01-01")), (at("2022-01-01 02:00:00"), 1, 2, 50, "s", 12.351, at("2022-01-01"))], "date_time TIMESTAMP_NTZ, x INT, y INT, kfz_pct INT, station_id STRING, pred DOUBLE, date TIMESTAMP_NTZ")
    made = outputs.grid_output(df, F.lit(3), ntz("2022-01-01 00:00:00"), "grid_sim")
    assert made.columns == ["model_id", "date_time_forecast", "date_time", "x", "y", "kfz_pct", "value"]
    assert [str(r.value) for r in made.collect()] == ["12.2", "12.4"] and made.first().date_time == 1640998800
    assert "kfz_pct" not in outputs.grid_output(df, F.lit(3), ntz("2022-01-01 00:00:00")).columns
    with pytest.raises(ValueError):
        outputs.grid_output(df, F.lit(3), F.col("date_time"), "stations")
    assert outputs.station_output(df, F.lit(3), F.col("date_time")).columns == ["model_id", "date_time_forecast", "date_time", "station_id", "value"]
    assert outputs.left_out_output(df, F.lit(3)).columns == ["model_id", "date_time", "station_id", "value"]


def test_coordinate_sources(spark):
    station_map = spark.createDataFrame([(1, 1, "a"), (2, 2, "b"), (3, 3, "c")], "x INT, y INT, station_id STRING")
    stations = spark.createDataFrame([("a", True), ("b", False)], "station_id STRING, is_active BOOLEAN")
    batches = spark.createDataFrame([(1, 5, 5), (2, 6, 6)], "batch INT, x INT, y INT")
    known = {"station_map": station_map, "stations": stations, "grid_batches": batches, "grid_sim_batches": batches, "sampler_map": station_map}
    assert tables.coords_for("stations", known).collect() == [(1, 1)]
    assert tables.coords_for("stations", known, only_active=False).count() == 2
    assert tables.coords_for("grid", known, batch=2).collect() == [(6, 6)]
    assert tables.coords_for("grid_sim", known).columns == ["batch", "x", "y"]
    assert tables.coords_for("passive_samplers", known).count() == 3
    with pytest.raises(ValueError):
        tables.coords_for("city", known)
    caps = spark.createDataFrame([("no2", 5.0, 4.0)], tables.SCHEMAS["cap_values"])
    got = spark.range(1).select(tables.cap_value(caps, "no2", "cap_value_outlier"), tables.cap_value(caps, "pm10", "cap_value_outlier")).first()
    assert tuple(got) == (5.0, None)
