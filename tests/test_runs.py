import json

import duckdb
import numpy as np
import pytest
from conftest import at, hourly
from oracle import compare
from pyspark.sql import functions as F

from hourloom.functions.timefns import ntz
from hourloom.operators import attribution
from hourloom.operators.scoring import LinearScorer, as_column
from hourloom.operators.training import StagedModel
from hourloom.plans import queries_forecast, runs, samples, serving
from hourloom.plans.features import assemble_features, traffic_rows
from hourloom.sources.registry import model_row
from hourloom.streaming import requests

SF_DIR = "/root/testdata/sf0.001"
LO, HI = "2024-01-05 00:00:00", "2024-01-20 00:00:00"
NEWEST = ("ts", "event_id")


def predict(df):
    return df.withColumn("pred", LinearScorer({"kfz_per_hour": 0.5}, 1.0).column())


def test_sampler_run_appends(spark, tmp_path):
    domain, path = samples.domain_tables(spark, SF_DIR), str(tmp_path / "out")
    for _ in range(2):
        runs.sampler_run(spark, domain, ntz(LO), ntz(HI), predict, 5, {}, path, NEWEST)
    stored = spark.read.parquet(path)
    per_row = stored.groupBy("date_time", "x", "y").count().select("count").distinct().collect()
    assert [r[0] for r in per_row] == [2]
    cells = {(r.x, r.y) for r in domain["sampler_map"].collect()}
    assert {(r.x, r.y) for r in stored.collect()} <= cells


def test_grid_run_of_some_batches_reports_each(spark, tmp_path):
    domain = samples.domain_tables(spark, SF_DIR)
    wanted = spark.createDataFrame([(0,), (2,)], "batch INT")
    report = runs.grid_run(spark, domain, ntz(LO), ntz(HI), predict, 5, {}, str(tmp_path / "o"), "grid", NEWEST, wanted)
    assert {r.batch: r.finished for r in report.collect()} == {0: False, 2: False}
    assert spark.read.parquet(str(tmp_path / "o")).count() > 0


def test_requests_are_answered_from_the_feature_table(spark, tmp_path):
    domain = samples.domain_tables(spark, SF_DIR)
    source, out, rejected, progress = (str(tmp_path / n) for n in ("in", "out", "rejected", "progress"))
    texts = [json.dumps({"key": "a", "batch_id": 0, "depvar": p}) for p in ("no2", "pm10")]
    spark.createDataFrame([(t,) for t in [*texts, "junk"]], "value STRING").write.text(source)
    handler = runs.request_handler(
        domain["grid_batches"],
        lambda coords: assemble_features(domain, coords, ntz(LO), ntz(HI), "grid", NEWEST),
        {"no2": (1, predict), "pm10": (2, predict), "pm25": (3, predict)},
        ntz(LO),
    )
    requests.serve_requests(requests.file_messages(spark, source), handler, out, rejected, progress).awaitTermination()
    rows = spark.read.parquet(out)
    counts = {r.model_id: r["count"] for r in rows.groupBy("model_id").count().collect()}
    assert set(counts) == {1, 2} and counts[1] == counts[2] > 0
    assert spark.read.parquet(rejected).count() == 1


def test_train_and_register(spark, tmp_path):
    data = [("a", t, float(i % 24), float(i % 7)) for i, t in enumerate(hourly("2022-01-01 00:00:00", 200))]
    df = spark.createDataFrame(data, "station_id STRING, date_time TIMESTAMP_NTZ, no2 DOUBLE, x DOUBLE")
    params = {"maxIter": 2, "maxDepth": 2}
    registry, models, final = (str(tmp_path / n) for n in ("registry", "models", "final"))
    model_id = runs.train_and_register(
        spark, df, "no2", ["x"], ["x"], [], params, params, [24], [1], "temporal", 1, registry, models, 20.0, final, "temporal"
    )
    row = model_row(spark.read.parquet(registry), model_id)
    assert json.loads(row.description)["lags"] == "[]" and json.loads(row.description_residuals)["lags"] == "[24]"
    assert json.loads(row.description)["training_period"] == ["2022-01-01 00:00:00", "2022-01-09 07:00:00"]
    model = StagedModel.load(row.model_path, row.features_1, row.features_2, row.categorical)
    assert model.transform(df).where("pred > 19.5").isEmpty()
    assert spark.read.parquet(final).first().model_id == model_id


def test_time_validation_retrains_per_group(spark):
    data = [(s, t, float((i * 3) % 24), float(i % 24)) for s in ("a", "b") for i, t in enumerate(hourly("2022-01-01 00:00:00", 400))]
    df = spark.createDataFrame(data, "station_id STRING, date_time TIMESTAMP_NTZ, y DOUBLE, h DOUBLE")
    params = {"maxIter": 1, "maxDepth": 2}
    got = runs.cross_validate_in_time(df, "y", ["h"], None, [], params, None, [], [], 3, 24, 24, 2, 1)
    sizes = {(r.fold_id, r.train_group): r["count"] for r in got.groupBy("fold_id", "train_group").count().collect()}
    assert sizes == {(3, 0): 48, (2, 0): 48, (1, 1): 48}
    left = runs.cross_validate_stations(df, "y", ["h"], None, [], params, None)
    assert {r.station_id: r["count"] for r in left.groupBy("station_id").count().collect()} == {"a": 400, "b": 400}


def test_attribution_through_a_batch_scorer(spark):
    df = spark.createDataFrame([(float(i), float(i * i % 7)) for i in range(20)], "a DOUBLE, b DOUBLE")
    scorer = LinearScorer({"a": 2.0, "b": -3.0}, 1.0)
    made = attribution.attribute(df, ["a", "b"], as_column(spark, scorer), attribution.feature_means(df, ["a", "b"]), 2).toPandas()
    assert np.allclose(made["phi_a"], 2.0 * (made["a"] - made["a"].mean()))


def test_station_forecast_starts_now(spark):
    data = [("a", t, float(i)) for i, t in enumerate(hourly("2022-01-01 00:00:00", 30))] + [("none", t, None) for t in hourly("2022-01-01 00:00:00", 30)]
    df = spark.createDataFrame(data, "station_id STRING, date_time TIMESTAMP_NTZ, y DOUBLE")
    got = runs.station_forecast(df, "y", [1], [], LinearScorer({"y_lag1": 1.0}, 1.0), ntz("2022-01-01 10:00:00"), {"y": 5.0}).orderBy("date_time").collect()
    assert {r.station_id for r in got} == {"a"} and got[0].date_time == at("2022-01-01 10:00:00")
    assert [r.pred for r in got[:3]] == [6.0, 7.0, 8.0] and len(got) == 20
    assert df.where(F.col("y").isNull()).count() == 30


def test_traffic_versions_do_not_hang_on_the_order_of_rows(spark):
    rows = [(1, at("2022-01-01 01:00:00"), 0, 0, v, 1) for v in (99.0, 10.0)]
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame(order, "model_id INT, date_time TIMESTAMP_NTZ, x INT, y INT, value DOUBLE, version INT").coalesce(1)
        assert [r.value for r in traffic_rows(df, F.lit(1), F.lit(2), ["version"]).collect()] == [99.0]


def test_report_does_not_count_doubled_rows(spark):
    batches = spark.createDataFrame([(1, 0, 0), (1, 0, 1)], "batch INT, x INT, y INT")
    lo, hi = ntz("2022-01-01 00:00:00"), ntz("2022-01-01 01:00:00")
    cells = [(1, 0, y, at(f"2022-01-01 0{h}:00:00")) for y in (0, 1) for h in (0, 1)]
    full = spark.createDataFrame(cells, "batch INT, x INT, y INT, date_time TIMESTAMP_NTZ")
    doubled = spark.createDataFrame(cells[:3] + cells[:1], full.schema)
    assert runs.batch_report(full, batches, lo, hi).first().finished
    assert not runs.batch_report(doubled, batches, lo, hi).first().finished


def test_assembly_runs_once_per_grid_run(spark, tmp_path):
    domain, read = dict(samples.domain_tables(spark, SF_DIR)), spark.sparkContext.accumulator(0)
    scaling = domain["traffic_scaling"]

    def marked(batches):
        for batch in batches:
            read.add(len(batch))
            yield batch

    domain["traffic_scaling"] = scaling.coalesce(1).mapInPandas(marked, scaling.schema)
    n = scaling.count()
    report = runs.grid_run(spark, domain, ntz(LO), ntz(HI), predict, 5, {}, str(tmp_path / "o"), "grid", NEWEST)
    report.collect()
    # The assembly itself reads the table for the scaling and for the volume class.
    assert n <= read.value <= 2 * n


def test_service_answers_once_across_a_stop_between_rows_and_report(spark, tmp_path, monkeypatch):
    domain = samples.domain_tables(spark, SF_DIR)
    final = spark.createDataFrame([("spatial", 4, "no2"), ("spatial", 9, "no2"), ("temporal", 11, "no2"), ("spatial", 2, "pm10")], "domain STRING, model_id INT, pollutant STRING")
    asked, loaded = [], []

    def load(depvar, model_id):
        loaded.append((depvar, model_id))
        return predict

    source, progress = str(tmp_path / "in"), str(tmp_path / "progress")
    service = serving.GridService(domain, final, load, ntz(LO), ntz(HI), str(tmp_path / "out"), NEWEST, {}, metric=["kfz_per_hour"])

    def send(*texts):
        spark.createDataFrame([(t,) for t in texts], "value STRING").coalesce(1).write.mode("append").text(source)

    def request(batch, depvar):
        asked.append((batch, depvar))
        return json.dumps({"key": "k", "batch_id": batch, "depvar": depvar})

    write = serving.GridService.write_reports
    send(request(0, "no2"), request(0, "no2"), request(0, "pm10"), request(1, "pm25"), request(999, "no2"), "junk")

    def stop(self, *args):
        raise RuntimeError("stopped")

    monkeypatch.setattr(serving.GridService, "write_reports", stop)
    with pytest.raises(Exception, match="stopped"):
        service.serve(requests.file_messages(spark, source), progress).awaitTermination()
    before = service.rows(spark).count()
    assert before > 0 and service.reports(spark).isEmpty()
    monkeypatch.setattr(serving.GridService, "write_reports", write)
    service.serve(requests.file_messages(spark, source), progress).awaitTermination()
    assert service.rows(spark).count() == before
    told = {(r.batch, r.depvar): r.model_id for r in service.reports(spark).collect()}
    assert told == {(0, "no2"): 9, (0, "pm10"): 2, (1, "pm25"): None, (999, "no2"): 9} and service.reports(spark).count() == 4
    assert spark.read.parquet(f"{tmp_path}/out/rejected").count() == 1
    # What has been answered for this start is not computed again.
    loaded.clear()
    send(request(0, "no2"), request(1, "no2"))
    service.serve(requests.file_messages(spark, source), progress).awaitTermination()
    assert loaded == [("no2", 9)] and service.reports(spark).count() == 5 and service.rows(spark).count() >= before
    per_row = service.rows(spark).groupBy("depvar", "batch", "date_time", "x", "y").count().select("count").distinct().collect()
    assert [r[0] for r in per_row] == [1]


def test_answers_have_a_folder_per_pollutant_and_count_once_even_if_progress_is_lost(spark, tmp_path, monkeypatch):
    domain, root = dict(samples.domain_tables(spark, SF_DIR)), tmp_path / "out"
    domain["grid_batches"] = domain["station_map"].select("x", "y", (F.col("station_id").cast("int") % 3).alias("batch"))
    final = spark.createDataFrame([("spatial", 9, "no2"), ("spatial", 2, "pm10")], "domain STRING, model_id INT, pollutant STRING")
    service = serving.GridService(domain, final, lambda *_: predict, ntz(LO), ntz(HI), str(root), NEWEST, {}, metric=["kfz_per_hour"])

    def serve(n, *batches):
        texts = [json.dumps({"key": "k", "batch_id": b, "depvar": d}) for b in batches for d in ("no2", "pm10")]
        spark.createDataFrame([(t,) for t in texts], "value STRING").coalesce(1).write.text(str(tmp_path / f"in{n}"))
        service.serve(requests.file_messages(spark, str(tmp_path / f"in{n}")), str(tmp_path / f"progress{n}")).awaitTermination()

    with monkeypatch.context() as m:
        m.setattr(serving.GridService, "write_reports", lambda *_: 1 / 0)
        with pytest.raises(Exception, match="division by zero"):
            serve(1, 0, 1)
    first = {tuple(r) for r in service.rows(spark).collect()}
    # Another stream with its own progress asks for more than was written.
    serve(2, 1, 2)
    serve(3, 0, 1, 2)
    rows = service.rows(spark)
    per_row = [r[-1] for r in rows.groupBy("depvar", "batch", "date_time", "x", "y").count().collect()]
    assert set(per_row) == {1} and first < {tuple(r) for r in rows.collect()}
    assert {(r.depvar, r.batch) for r in rows.select("depvar", "batch").distinct().collect()} == {(d, b) for d in ("no2", "pm10") for b in (0, 1, 2)}
    assert service.reports(spark).count() == 6
    holding = {p.parent for p in (root / "rows").rglob("*.parquet")}
    assert len(holding) == 3 * 2  # an answer and a pollutant, not a request


@pytest.mark.parametrize("n_batches", [2, 5])
def test_reports_wait_for_files_that_do_not_grow_with_the_requests(spark, tmp_path, monkeypatch, n_batches):
    """All cells of `n_batches` have each hour but one cell of batch 1; views and purchases ask for both pollutants."""
    tables, served, db = tmp_path / "tables", tmp_path / "requests", duckdb.connect()
    customer, every = spark.read.parquet(f"{SF_DIR}/customer.parquet").where("c_custkey < 50"), range(n_batches)
    shifted = customer.withColumn("c_custkey", F.explode(F.array(*[F.col("c_custkey") + 50 * i for i in every])))
    hour = F.col("id") % 120  # the last ones lie behind the range: the weather forecast starts there
    ts = F.when(hour < 116, F.expr(f"TIMESTAMP_NTZ'{queries_forecast.SERVED_FROM}' + make_dt_interval(0, id % 120)")).otherwise(ntz("2024-01-20 00:00:00"))
    user = F.floor(F.col("id") / 120)
    kind = F.when(hour % 2 == 0, "view").otherwise("purchase")
    events = spark.range(120 * 50 * n_batches).select(
        F.col("id").alias("event_id"), ts.alias("ts"), user.alias("user_id"), kind.alias("event_type"),
        (F.col("id") % 100 / 4).alias("value"), F.lit("{}").alias("props"),
    ).where("NOT (user_id = 60 AND event_id % 120 = 7)")
    for name, made in {"customer": shifted, "events": events, "region": spark.read.parquet(f"{SF_DIR}/region.parquet")}.items():
        made.write.parquet(f"{tables}/{name}.parquet")
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tables}/{name}.parquet/*.parquet'")
    monkeypatch.setattr(queries_forecast, "scratch_path", lambda *_: str(served))
    reports = queries_forecast.stream_reports(spark, str(tables))
    assert compare(reports, db, queries_forecast.STREAM_REPORTS) is None
    finished = {(r.batch, r.depvar) for r in reports.where("finished").collect()}
    assert finished == {(b, p) for b in every if b != 1 for p in ("no2", "pm10")}
    holding = {p.parent for p in (served / "served" / "rows").rglob("*.parquet")}
    assert len(holding) == 2  # one per pollutant, however many batches were asked for
