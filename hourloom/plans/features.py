"""The feature table: one row per city cell and hour, assembled from all sources."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hourloom.functions.params import CAMS_LAGS, POLLUTANTS, STATION_AVERAGE_BAND, STATION_AVERAGE_LAGS, TRAFFIC_LAGS, WEATHER_LAGS
from hourloom.functions.timefns import hours, weekday
from hourloom.operators.lags import add_row_lags
from hourloom.operators.mapping import reproject
from hourloom.operators.station_average import attach_weighted_average, class_means, lag_class_means, pivot_by_model
from hourloom.session import store
from hourloom.sources.merge import history_then_latest, observations_before_forecast
from hourloom.sources.tables import at_coords, in_range, traffic_table

LOOKBACK_HOURS = 48
LAGGED_WEATHER = ("wind_direction", "precipitation", "pressure_msl")

Tables = Mapping[str, DataFrame]


def traffic_rows(
    predictions: DataFrame, volume_model: Column, speed_model: Column, newest: Sequence[str]
) -> DataFrame:
    """Volume and speed per cell and hour from the newest row of each model.

    Deduplication and pivot in one aggregation with map-side combine: however often a key was rewritten, a map task sends
    one row for it. Rows that tie in `newest` are ordered by their value, so the result does not depend on the order of rows.
    """
    version = F.struct(*newest, "value")
    is_volume, is_speed = F.col("model_id") == volume_model, F.col("model_id") == speed_model
    return (
        predictions.where(is_volume | is_speed)
        .groupBy("date_time", "x", "y")
        .agg(
            F.max_by(F.col("value"), F.when(is_volume, version)).alias("value"),
            F.max_by(F.col("value"), F.when(is_speed, version)).alias("velocity"),
            F.count_if(is_volume).alias("__n"),
        )
        .where(F.col("__n") > 0)
        .drop("__n")
    )


def traffic_features(tables: Tables, coords: DataFrame, lo: Column, hi: Column, mode: str, newest: Sequence[str]) -> DataFrame:
    predictions = at_coords(in_range(tables[traffic_table(mode)], "date_time", lo - hours(LOOKBACK_HOURS), hi), coords)
    chosen = tables["traffic_models_final"]
    rows = traffic_rows(
        predictions,
        chosen.where(F.col("depvar") == "q_kfz").select(F.max("model_id")).scalar(),
        chosen.where(F.col("depvar") == "v_kfz").select(F.max("model_id")).scalar(),
        newest,
    )
    scaled = rows.join(tables["traffic_scaling"].select("x", "y", "scaling"), ["x", "y"])
    scaled = scaled.withColumn("kfz_per_hour", F.col("scaling") * F.col("value")).drop("scaling", "value")
    return add_row_lags(scaled, ["x", "y"], ["date_time"], {"kfz_per_hour": TRAFFIC_LAGS}).where(F.col("date_time") >= lo)


def weather_source(tables: Tables, lo: Column, hi: Column) -> DataFrame:
    """Lagged weather per source cell; forecasts replace observations from their first hour on."""
    forecast = tables["weather_forecast"]
    first = forecast.select(F.min("date_time")).scalar()
    start = lo - hours(LOOKBACK_HOURS)
    spliced = observations_before_forecast(
        in_range(tables["weather_observed"], "date_time", start, hi), in_range(forecast, "date_time", start, hi),
        "date_time", first,
    )
    renamed = spliced.withColumnsRenamed({"x": "dwd_x", "y": "dwd_y"})
    return add_row_lags(renamed, ["dwd_x", "dwd_y"], ["date_time"], {c: WEATHER_LAGS for c in LAGGED_WEATHER})


def cams_source(tables: Tables, lo: Column, hi: Column) -> DataFrame:
    ranged = in_range(tables["cams"], "date_time", lo - hours(LOOKBACK_HOURS), hi)
    named = reproject(ranged, tables["reprojection"]).withColumnsRenamed(
        {"x": "cams_x", "y": "cams_y", **{p: f"cams_{p}" for p in POLLUTANTS}}
    )
    return add_row_lags(named, ["cams_x", "cams_y"], ["date_time"], {f"cams_{p}": CAMS_LAGS for p in POLLUTANTS})


def station_means(tables: Tables, lo: Column, hi: Column) -> DataFrame:
    """Hourly means of traffic and background stations: stored history, then the latest predictions.

    Each source has its own models: the latest predictions come from the final temporal model of a pollutant, history from the
    newest of its models that history holds, which a retraining leaves behind.
    """
    history, latest = tables["predictions_history"], tables["predictions_latest"]
    final, described = tables["models_final"], tables["models_described"]
    held = history.select("model_id").distinct()

    def newest_held(pollutant: str) -> Column:
        of_pollutant = described.where(F.col("pollutant") == pollutant)
        return held.join(of_pollutant, "model_id", "left_semi").select(F.max("model_id")).scalar()

    def final_temporal(pollutant: str) -> Column:
        return final.where((F.col("pollutant") == pollutant) & (F.col("domain") == "temporal")).select(F.max("model_id")).scalar()

    keys = ["date_time", "station_id"]
    known_to = history.select(F.max("date_time")).scalar()
    past = pivot_by_model(in_range(history, "date_time", lo, hi), keys, {p: newest_held(p) for p in POLLUTANTS})
    recent = pivot_by_model(in_range(latest, "date_time", lo, hi), keys, {p: final_temporal(p) for p in POLLUTANTS})
    wide = history_then_latest(past, recent, "date_time", known_to)
    typed = wide.join(tables["station_types"], "station_id", "left")
    return class_means(typed, POLLUTANTS)


def calendar_columns() -> dict[str, Column]:
    return {
        "weekday": weekday(F.col("__calendar_time")),
        "year": F.year("__calendar_time"),
        "hour": F.hour("__calendar_time"),
    }


def assemble_features(
    tables: Tables,
    coords: DataFrame,
    lo: Column,
    hi: Column,
    mode: str,
    newest: Sequence[str],
    average_lookback_hours: int = 0,
) -> DataFrame:
    """Features of every coordinate and hour in [lo, hi].

    `newest` names the version columns of the traffic predictions: of rows with the same key the one with the largest values counts.
    Traffic rows lead. Coarse sources are lagged on their own cells and looked up through the cell maps, which equals
    mapping first and lagging after but sorts one row per source cell instead of one per city cell. The station average
    has no look-back unless asked for, so its first hours have no lags.
    """
    rows = traffic_features(tables, store(coords.distinct(), "coords"), lo, hi, mode, newest)
    # Tables with one row per cell
    rows = rows.join(tables["cell_map_dwd"].select("x", "y", "dwd_x", "dwd_y"), ["x", "y"])
    rows = rows.join(tables["cell_map_cams"].select("x", "y", "cams_x", "cams_y"), ["x", "y"])
    rows = rows.join(tables["land_use"], ["x", "y"], "left")
    rows = rows.join(tables["station_map"].select("x", "y", "station_id"), ["x", "y"], "left")
    # Observations may be as many as the rows: they come while the rows are narrow
    # Placed on their cells first: most cells have no station, and a missing station is no key to meet on.
    measured = in_range(tables["observations"], "date_time", lo, hi).drop("x", "y")
    placed = measured.join(tables["station_map"].select("x", "y", "station_id"), "station_id")
    rows = rows.join(placed, ["x", "y", "date_time", "station_id"], "left")
    # Sources by their own cell and hour
    rows = rows.join(weather_source(tables, lo, hi), ["dwd_x", "dwd_y", "date_time"])
    rows = rows.join(cams_source(tables, lo, hi), ["cams_x", "cams_y", "date_time"])
    rows = rows.drop("dwd_x", "dwd_y", "cams_x", "cams_y")
    calendar = tables["calendar"].withColumn("__calendar_time", F.col("date_time"))
    rows = rows.join(calendar, "date_time", "left").withColumns(calendar_columns()).drop("__calendar_time")
    means = lag_class_means(
        station_means(tables, lo - hours(average_lookback_hours), hi), POLLUTANTS, STATION_AVERAGE_LAGS
    )
    return attach_weighted_average(
        rows, tables["traffic_scaling"], tables["scaling_by_volume"], means, POLLUTANTS, STATION_AVERAGE_LAGS,
        STATION_AVERAGE_BAND,
    )
