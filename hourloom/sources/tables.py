"""Input tables, coordinate sources and small lookups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Columns the operators expect, as DDL. NTZ columns hold UTC wall time.
SCHEMAS = {
    "traffic_predictions": "model_id INT, date_time TIMESTAMP_NTZ, x INT, y INT, value DOUBLE",
    "traffic_models_final": "depvar STRING, model_id INT",
    "traffic_scaling": "x INT, y INT, scaling DOUBLE, kfz_per_24h DOUBLE",
    "weather": "date_time TIMESTAMP_NTZ, x INT, y INT, wind_direction DOUBLE, wind_speed DOUBLE, precipitation DOUBLE, "
    "temperature DOUBLE, cloud_cover DOUBLE, pressure_msl DOUBLE, sunshine DOUBLE",
    "cams": "date_time TIMESTAMP_NTZ, lat_int INT, lon_int INT, no2 DOUBLE, pm25 DOUBLE, pm10 DOUBLE",
    "reprojection": "lat_int INT, lon_int INT, x INT, y INT",
    "cell_map": "x INT, y INT, source_x INT, source_y INT",
    "station_map": "x INT, y INT, station_id STRING, station_x INT, station_y INT",
    "stations": "station_id STRING, is_active BOOLEAN",
    "station_types": "id STRING, stattyp STRING",
    "calendar": "date_time TIMESTAMP_NTZ, doy_scaled DOUBLE, type_school_holiday STRING, is_public_holiday BOOLEAN",
    "land_use": "x INT, y INT, grauflaeche DOUBLE, gewaesser DOUBLE, gruenflaeche DOUBLE, infrastruktur DOUBLE, "
    "mischnutzung DOUBLE, wald DOUBLE, wohnnutzung DOUBLE, building_density DOUBLE, traffic_intensity_kfz DOUBLE, "
    "nox_h DOUBLE, nox_i DOUBLE, nox_v DOUBLE, pmx_i DOUBLE",
    "observations": "date_time TIMESTAMP_NTZ, station_id STRING, x INT, y INT, pm10 DOUBLE, pm25 DOUBLE, no2 DOUBLE",
    "scaling_by_volume": "kkfz_per_24h INT, scaling_stadtrand DOUBLE",
    "coord_batches": "batch INT, x INT, y INT",
    "cap_values": "pollutant STRING, cap_value_outlier DOUBLE, cap_value_training DOUBLE",
}


def read_table(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(path)


def in_range(df: DataFrame, time: str, lo: Column, hi: Column) -> DataFrame:
    """Closed time range."""
    return df.where(F.col(time).between(lo, hi))


def at_coords(df: DataFrame, coords: DataFrame, on: Sequence[str] = ("x", "y")) -> DataFrame:
    """Keep the rows at the given coordinates."""
    return df.join(coords.select(*on), list(on), "left_semi")


def batch_coords(batches: DataFrame, batch: int | None = None) -> DataFrame:
    """Coordinates of one batch, or of all batches with the batch number kept as a column."""
    if batch is None:
        return batches.select("batch", "x", "y")
    return batches.where(F.col("batch") == batch).select("x", "y")


def station_coords(station_map: DataFrame, stations: DataFrame, only_active: bool = True) -> DataFrame:
    wanted = [True] if only_active else [True, False]
    known = stations.where(F.col("is_active").isin(wanted)).select("station_id")
    return station_map.join(known, "station_id").select("x", "y")


def sampler_coords(sampler_map: DataFrame) -> DataFrame:
    return sampler_map.select("x", "y")


def coords_for(mode: str, tables: dict[str, DataFrame], batch: int | None = None, only_active: bool = True) -> DataFrame:
    """Coordinate source of a mode; any other mode is an error."""
    if mode == "stations":
        return station_coords(tables["station_map"], tables["stations"], only_active)
    if mode == "passive_samplers":
        return sampler_coords(tables["sampler_map"])
    if mode in ("grid", "grid_sim"):
        return batch_coords(tables[f"{mode}_batches"], batch)
    raise ValueError("mode must be one of: stations, grid, passive_samplers, grid_sim")


def traffic_table(mode: str) -> str:
    return "traffic_grid" if mode in ("grid", "grid_sim") else f"traffic_{mode}"


def scalar_of(df: DataFrame, expression: Column) -> Column:
    """A one-row aggregate as a scalar subquery: it stays inside the plan."""
    return df.select(expression).scalar()


def cap_value(cap_values: DataFrame, pollutant: str, column: str) -> Column:
    """Cap of one pollutant as a scalar; max() makes a missing row NULL, so nothing is capped."""
    return scalar_of(cap_values.where(F.col("pollutant") == pollutant), F.max(column))


def latest_time(df: DataFrame, time: str) -> Column:
    return scalar_of(df, F.max(time))


def largest_batch(batches: DataFrame) -> Column:
    return scalar_of(batches, F.max("batch"))


def rows_per_batch(batches: DataFrame) -> DataFrame:
    return batches.groupBy("batch").agg(F.count(F.lit(1)).alias("n_coords"))


def station_types(stations: DataFrame, types: DataFrame) -> DataFrame:
    """Station number (characters 4..6 of the long id) and type, for the stations used in predictions."""
    used = stations.select("id")
    return types.join(used, "id", "left_semi").select(F.substring("id", 4, 3).alias("station_id"), "stattyp")
