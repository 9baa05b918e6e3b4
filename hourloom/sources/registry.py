"""Model registry: descriptions, settings, look-ups and promotion."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hourloom.sources.merge import exists, write_rows

REGISTRY_SCHEMA = (
    "model_id INT, date_time_training_execution BIGINT, pollutant STRING, model_name STRING, description STRING, "
    "model_path STRING, description_residuals STRING, features_1 ARRAY<STRING>, features_2 ARRAY<STRING>, "
    "categorical ARRAY<STRING>"
)
DESCRIPTION_SCHEMA = "training_period ARRAY<STRING>, lags STRING, lags_avg STRING"
TIME_FORMAT = "yyyy-MM-dd HH:mm:ss"


def training_description(
    df: DataFrame, time: str, params: dict, lags: Sequence[int], lags_avg: Sequence[int], by: Sequence[str] = ()
) -> DataFrame:
    """JSON description (keys in alphabetical order) of a training set, one row per `by` group.

    The lag lists are JSON text inside the JSON document.
    """
    period = F.array(F.date_format(F.min(time), TIME_FORMAT), F.date_format(F.max(time), TIME_FORMAT))
    entries = {name: F.lit(value) for name, value in params.items()}
    entries["training_period"] = F.col("__period")
    entries["lags"] = F.lit(json.dumps(list(lags)))
    entries["lags_avg"] = F.lit(json.dumps(list(lags_avg)))
    ordered = F.struct(*[entries[name].alias(name) for name in sorted(entries)])
    return df.groupBy(*by).agg(period.alias("__period")).select(*by, F.to_json(ordered).alias("description"))


def model_settings(registry: DataFrame) -> DataFrame:
    """Settings of each registered model: the union of both stages, without duplicates."""
    none_s, none_i = F.array().cast("array<string>"), F.array().cast("array<int>")

    def lag_list(description: Column, key: str) -> Column:
        decoded = F.from_json(F.from_json(description, DESCRIPTION_SCHEMA)[key], "array<int>")
        return F.coalesce(decoded, none_i)

    first, second = F.col("description"), F.col("description_residuals")
    features = F.array_sort(F.array_union(F.col("features_1"), F.coalesce(F.col("features_2"), none_s)))
    return registry.select(
        "model_id",
        "pollutant",
        features.alias("feature_cols"),
        F.array_intersect(features, F.col("categorical")).alias("categorical_feature_cols"),
        F.array_except(features, F.col("categorical")).alias("metric_feature_cols"),
        F.array_sort(F.array_union(lag_list(first, "lags"), lag_list(second, "lags"))).alias("lags"),
        F.array_sort(F.array_union(lag_list(first, "lags_avg"), lag_list(second, "lags_avg"))).alias("lags_avg"),
        F.from_json(first, DESCRIPTION_SCHEMA)["training_period"][1].alias("max_training_date_model_1"),
        F.from_json(second, DESCRIPTION_SCHEMA)["training_period"][1].alias("max_training_date_model_2"),
    )


def available_models(registry: DataFrame, name_pattern: str, pollutant: str) -> DataFrame:
    """Models whose name is LIKE the pattern, ordered for display."""
    return (
        registry.where(F.col("model_name").like(name_pattern) & (F.col("pollutant") == pollutant))
        .select(
            "model_id", "date_time_training_execution", "pollutant", "model_name", "description", "description_residuals"
        )
        .orderBy("model_id", "pollutant", F.desc("date_time_training_execution"))
    )


def model_row(registry: DataFrame, model_id: int):
    """The registry row of a model; a missing or a duplicated id is an error."""
    rows = registry.where(F.col("model_id") == model_id).limit(2).collect()
    if not rows:
        raise ValueError(f"model {model_id} is not registered")
    if len(rows) > 1:
        raise ValueError(f"model id {model_id} is registered more than once")
    return rows[0]


def final_model_id(models_final: DataFrame, domain: str, pollutant: str) -> Column:
    chosen = models_final.where((F.col("domain") == domain) & (F.col("pollutant") == pollutant))
    return chosen.select(F.max("model_id")).scalar()


def next_model_id(registry: DataFrame) -> int:
    return (registry.agg(F.max("model_id")).first()[0] or 0) + 1


def first_free_id(spark: SparkSession, registry_path: str) -> int:
    return next_model_id(spark.read.schema(REGISTRY_SCHEMA).parquet(registry_path)) if exists(spark, registry_path) else 1


def register_model(
    spark: SparkSession,
    registry_path: str,
    model_root: str,
    model,
    pollutant: str,
    model_name: str,
    description: str,
    description_residuals: str | None,
    trained_at: int,
    model_id: int | None = None,
) -> int:
    """Save the stages below `model_root` and append the registry row. One writer at a time, as ids are max + 1 unless one is given."""
    if model_id is None:
        model_id = first_free_id(spark, registry_path)
    path = f"{model_root}/{model_id}"
    model.save(path)
    row = (
        model_id, trained_at, pollutant, model_name, description, path, description_residuals,
        list(model.features_1), None if model.features_2 is None else list(model.features_2), list(model.categorical),
    )
    write_rows(spark, spark.createDataFrame([row], REGISTRY_SCHEMA), registry_path, mode="insert")
    return model_id


def promote_model(spark: SparkSession, path: str, pollutant: str, domain: str, model_id: int) -> None:
    """Make a model the productive one for its pollutant and domain."""
    row = spark.createDataFrame([(domain, model_id, pollutant)], "domain STRING, model_id INT, pollutant STRING")
    write_rows(spark, row, path, mode="replace", keys=["pollutant", "domain"], partition_by=["pollutant"])
