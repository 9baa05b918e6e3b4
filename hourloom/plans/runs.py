"""End-to-end runs: training, grid prediction, station forecast, scenarios, cross validation."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import partial
from threading import Lock

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hourloom.operators.cleaning import cap_for_training, cap_outliers, drop_empty_series, drop_missing_target, hours_between
from hourloom.operators.evaluation import regression_metrics
from hourloom.operators.folds import add_retrain_group, add_series_step, add_step, fold_cut, last_time, leave_one_out, rolling_test_rows, train_rows
from hourloom.operators.forecast import recursive_forecast
from hourloom.operators.lags import add_station_lags
from hourloom.operators.pool import in_pool
from hourloom.operators.scenarios import PERCENTAGES, traffic_scenarios
from hourloom.operators.training import StagedModel, fit_staged
from hourloom.plans.features import assemble_features
from hourloom.session import scratch_path, store
from hourloom.sources.merge import by_content, exists, latest_per_key, write_rows
from hourloom.sources.outputs import grid_output
from hourloom.sources.registry import REGISTRY_SCHEMA, first_free_id, promote_model, register_model, training_description
from hourloom.sources.tables import sampler_coords


def prepare_station_rows(
    df: DataFrame, target: str, caps: Mapping[str, Column | float], lags: Sequence[int], lags_avg: Sequence[int],
    station: str = "station_id", time: str = "date_time", average_name: str | None = None,
) -> DataFrame:
    """Drop series without the target, cap outliers, build own lags."""
    kept = cap_outliers(drop_empty_series(df, target, station), caps)
    return add_station_lags(kept, target, lags, lags_avg, station, time, average_name)


def train(
    df: DataFrame, target: str, features_1: Sequence[str], features_2: Sequence[str] | None, categorical: Sequence[str],
    params_1: dict, params_2: dict | None, cap: Column | float | None = None,
) -> StagedModel:
    data = drop_missing_target(df, target)
    if cap is not None:
        data = cap_for_training(data, target, cap)
    return fit_staged(data, target, features_1, features_2, categorical, params_1, params_2)


def grid_predictions(
    features: DataFrame, predict: Callable[[DataFrame], DataFrame], mode: str = "grid", value: str = "kfz_per_hour"
) -> DataFrame:
    """Predictions of all batches in one plan; `grid_sim` scores every row under each traffic percentage.

    Scenario rows keep the time and place of the unscaled row. The prediction column is `pred`.
    """
    if mode not in ("grid", "grid_sim"):
        raise ValueError("mode must be one of: grid, grid_sim")
    return predict(traffic_scenarios(features, PERCENTAGES if mode == "grid_sim" else (100,), value))


def batch_report(features: DataFrame, batches: DataFrame, lo: Column, hi: Column, sent: DataFrame | None = None) -> DataFrame:
    """(batch, finished): every coordinate of the batch has each hour of [lo, hi], and its rows could be written.

    `sent` optionally lists (batch, ok) of the sinks.
    """
    wanted = batches.distinct().groupBy("batch").agg(F.count(F.lit(1)).alias("n_coords"))
    # Different hours per cell: a doubled row must not stand in for a missing one.
    found = features.select("batch", "x", "y", "date_time").distinct().groupBy("batch").agg(F.count(F.lit(1)).alias("n_rows"))
    report = wanted.join(found, "batch", "left")
    complete = F.coalesce(F.col("n_rows"), F.lit(0)) == F.col("n_coords") * hours_between(lo, hi)
    if sent is None:
        return report.select("batch", complete.alias("finished"))
    oks = sent.groupBy("batch").agg(F.bool_and("ok").alias("ok"))
    return report.join(oks, "batch", "left").select("batch", (complete & F.coalesce("ok", F.lit(False))).alias("finished"))


def grid_run(
    spark: SparkSession, tables: Mapping[str, DataFrame], lo: Column, hi: Column, predict: Callable[[DataFrame], DataFrame],
    model_id: int, caps: Mapping[str, Column | float], path: str | None, mode: str,
    newest: Sequence[str], batches: DataFrame | None = None,
) -> DataFrame:
    """Features, predictions and output rows of all batches (or of the given ones), and the report (batch, finished).

    Batches are a column, not a loop. With a `path` the rows are appended there; the write either succeeds as a whole or
    raises, so a report that is returned speaks of stored rows.
    """
    known = tables[f"{mode}_batches"]
    wanted = store(known if batches is None else known.join(batches.select("batch").distinct(), "batch", "left_semi"), "batches")
    features = assemble_features(tables, wanted.select("x", "y"), lo, hi, mode, newest)
    features = cap_outliers(features.join(wanted, ["x", "y"]), caps)
    if path is not None:
        features = store(features, "grid-features")  # rows and report read one assembly
        rows = grid_output(grid_predictions(features, predict, mode), F.lit(model_id), lo, mode)
        write_rows(spark, rows, path, mode="insert")
    return batch_report(features, wanted, lo, hi)


def sampler_run(
    spark: SparkSession, tables: Mapping[str, DataFrame], lo: Column, hi: Column, predict: Callable[[DataFrame], DataFrame],
    model_id: int, caps: Mapping[str, Column | float], path: str, newest: Sequence[str],
) -> None:
    """Predictions at the cells of the passive samplers, appended to their table."""
    features = assemble_features(tables, sampler_coords(tables["sampler_map"]), lo, hi, "passive_samplers", newest)
    rows = grid_output(grid_predictions(cap_outliers(features, caps), predict), F.lit(model_id), lo)
    write_rows(spark, rows, path, mode="insert")


def request_handler(
    batches: DataFrame, features_at: Callable[[DataFrame], DataFrame], predictors: Mapping[str, tuple[int, Callable]],
    forecast_time: Column, mode: str = "grid",
) -> Callable[[DataFrame], DataFrame]:
    """Handler for a request stream: the output rows of all requested batches and pollutants in one plan.

    predictors: pollutant -> (model id, predict). `features_at` returns features for coordinates.
    """

    def handle(requests: DataFrame) -> DataFrame:
        asked = requests.select(F.col("batch_id").alias("batch"), "depvar").distinct()
        places = batches.join(asked, "batch").select("x", "y", "depvar").distinct()
        # One assembly for all requested batches; each pollutant takes the cells it was asked for.
        features = store(features_at(places.select("x", "y").distinct()), "requested-features")
        parts = []
        for depvar, (model_id, predict) in predictors.items():
            own = features.join(places.where(F.col("depvar") == depvar), ["x", "y"], "left_semi")
            parts.append(grid_output(grid_predictions(own, predict, mode), F.lit(model_id), forecast_time, mode))
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out

    return handle


def described(params: dict | None) -> dict:
    """The parameters that a description names: single values."""
    return {k: v for k, v in (params or {}).items() if k != "cuts"}


def train_and_register(
    spark: SparkSession, df: DataFrame, target: str, features_1: Sequence[str], features_2: Sequence[str] | None,
    categorical: Sequence[str], params_1: dict, params_2: dict | None, lags: Sequence[int], lags_avg: Sequence[int],
    name: str, trained_at: int, registry_path: str, model_root: str, cap: Column | float | None = None,
    final_path: str | None = None, domain: str | None = None, time: str = "date_time",
) -> int:
    """Train, describe and register a model; make it the final one of its domain if asked. Returns its id.

    With two stages the description of the first one names no lags, as that stage does not use them.
    """
    model = train(df, target, features_1, features_2, categorical, params_1, params_2, cap)
    seen = drop_missing_target(df, target)
    two = features_2 is not None
    first = training_description(seen, time, described(params_1), [] if two else lags, [] if two else lags_avg).first()[0]
    second = training_description(seen, time, described(params_2), lags, lags_avg).first()[0] if two else None
    model_id = register_model(spark, registry_path, model_root, model, target, name, first, second, trained_at)
    if final_path is not None and domain is not None:
        promote_model(spark, final_path, target, domain, model_id)
    return model_id


def forecast_t_plus_k(
    df: DataFrame, target: str, lags: Sequence[int], lags_avg: Sequence[int], scorer, n_windows: int, window_hours: int,
    step_hours: int | None = None, prediction_hour: int | None = None, include_current: bool = False,
    last: Column | None = None, station: str = "station_id", time: str = "date_time", average_name: str | None = None,
) -> DataFrame:
    """Recursive forecasts from every time point t for the next k hours, all folds in one job."""
    tests = rolling_test_rows(df, time, n_windows, window_hours, step_hours, include_current, prediction_hour, last)
    order = [F.col(target).asc_nulls_last(), *by_content(tests, ["fold_id", station, time])]
    unique = latest_per_key(tests, ["fold_id", station, time], order)
    return recursive_forecast(
        add_step(unique, time), target, lags, lags_avg, scorer,
        ["fold_id", station], time,
        keep=["fold_cut", target], average_name=average_name,
    )


def station_forecast(
    df: DataFrame, target: str, lags: Sequence[int], lags_avg: Sequence[int], scorer, now: Column,
    caps: Mapping[str, Column | float], station: str = "station_id", time: str = "date_time", average_name: str | None = None,
) -> DataFrame:
    """Forecast of all stations from `now` (included) to the end of the data. Each station counts its own steps."""
    rows = prepare_station_rows(df, target, caps, lags, lags_avg, station, time, average_name)
    order = [F.col(target).asc_nulls_last(), *by_content(rows, [station, time])]
    future = latest_per_key(rows.where(F.col(time) >= now), [station, time], order)
    return recursive_forecast(
        add_series_step(future, time, [station]), target, lags, lags_avg, scorer, [station], time, keep=[target],
        average_name=average_name,
    )


def cross_validate_in_time(
    df: DataFrame, target: str, features_1: Sequence[str], features_2: Sequence[str] | None, categorical: Sequence[str],
    params_1: dict, params_2: dict | None, lags: Sequence[int], lags_avg: Sequence[int], n_windows: int, window_hours: int,
    step_hours: int, retrain_every: int, train_years: float, prediction_hour: int | None = None,
    cap: Column | float | None = None, last: Column | None = None, station: str = "station_id", time: str = "date_time",
    average_name: str | None = None,
) -> DataFrame:
    """Rolling-origin validation with a retrained model for every group of folds, oldest first.

    The loop runs over retraining groups (windows / retrain_every), not over folds: a group is one fit and one forecast.
    """
    spark = df.sparkSession
    df = store(latest_per_key(df, [station, time], by_content(df, [station, time])), "validated-rows")
    tests = rolling_test_rows(df, time, n_windows, window_hours, step_hours, False, prediction_hour, last)
    tests = store(add_retrain_group(add_step(tests, time), n_windows, retrain_every), "test-rows")
    end = last_time(df, time, window_hours, prediction_hour, last)
    out = None
    for group in range((n_windows - 1) // retrain_every + 1):
        cut = fold_cut(end, F.lit(n_windows - group * retrain_every), window_hours, step_hours)
        history = train_rows(df, time, cut, train_years)
        model = train(history, target, features_1, features_2, categorical, params_1, params_2, cap)
        part = recursive_forecast(
            tests.where(F.col("train_group") == group), target, lags, lags_avg, model.scorer(spark),
            ["fold_id", station], time, keep=["fold_cut", "train_group", target], average_name=average_name,
        )
        out = part if out is None else out.unionByName(part)
    return out


def left_out_plan(spark: SparkSession, data: DataFrame, path: str, registry_path: str, station: str) -> DataFrame:
    """The stations of a run in order, each with the id that its model gets. Written once; a restarted run reads it again."""
    if not exists(spark, f"{path}/plan/_SUCCESS"):
        start = first_free_id(spark, registry_path)
        number = F.row_number().over(Window.orderBy(station))  # one row per station
        plan = data.select(station).distinct().select(station, (number - 1 + start).cast("int").alias("model_id"))
        plan.coalesce(1).write.mode("overwrite").parquet(f"{path}/plan")
    return spark.read.parquet(f"{path}/plan")


def cross_validate_stations(
    df: DataFrame, target: str, features_1: Sequence[str], features_2: Sequence[str] | None, categorical: Sequence[str],
    params_1: dict, params_2: dict | None, cap: Column | float | None = None, station: str = "station_id", time: str = "date_time",
    path: str | None = None, name: str = "left out", trained_at: int = 0, workers: int = 4,
) -> DataFrame:
    """Predictions at every station by a model trained on all others, with the id of that model.

    A fit per station is the nature of the method. The rows are written once, and a bounded number of fits runs at a time. Below `path`
    lie the plan (which station gets which model id), the registry with one model per station, and the predictions of a station in a
    folder of its own. A station is finished when the manifest names it, which is written last; a run that is started again with the
    same path goes on with the others.
    """
    spark = df.sparkSession
    path = path or scratch_path(spark, "left-out")
    registry_path, writing = f"{path}/registry", Lock()
    if not exists(spark, f"{path}/rows/_SUCCESS"):
        drop_missing_target(df, target).write.mode("overwrite").parquet(f"{path}/rows")
    data = spark.read.parquet(f"{path}/rows")
    plan = left_out_plan(spark, data, path, registry_path, station).orderBy("model_id").collect()
    manifest = "model_id INT"
    finished = {r[0] for r in spark.read.schema(manifest).parquet(f"{path}/finished").collect()} if exists(spark, f"{path}/finished") else set()

    def validate(left_out: str | int, model_id: int) -> None:
        others, test = leave_one_out(data, left_out, station)
        model = train(others, target, features_1, features_2, categorical, params_1, params_2, cap)
        made = model.transform(test).withColumn("model_id", F.lit(model_id))
        made.write.mode("overwrite").parquet(f"{path}/predictions/model={model_id}")
        description = training_description(others, time, described(params_1), [], []).first()[0]
        with writing:
            known = spark.read.schema(REGISTRY_SCHEMA).parquet(registry_path) if exists(spark, registry_path) else None
            # A run that was stopped between registry and manifest has the row already.
            if known is None or known.where(F.col("model_id") == model_id).isEmpty():
                register_model(spark, registry_path, f"{path}/models", model, target, f"{name} {left_out}", description, None, trained_at, model_id)
            write_rows(spark, spark.createDataFrame([(model_id,)], manifest), f"{path}/finished", mode="insert")

    in_pool(spark, [partial(validate, r[station], r["model_id"]) for r in plan if r["model_id"] not in finished], workers)
    return spark.read.option("recursiveFileLookup", "true").parquet(f"{path}/predictions")


def station_metrics(predictions: DataFrame, target: str, pred: str = "pred", station: str = "station_id") -> DataFrame:
    return regression_metrics(predictions, target, pred, [station])

