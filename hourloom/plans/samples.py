"""Domain tables derived from the generic test tables, each as a Spark plan and as the equal SQL text.

The generic tables hold no air-quality data. Events play the measurements (user = city cell or station, event type =
station or model), customers play the cells, and orders play the series of coarse source cells.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hourloom.functions.mathfns import exact_mean
from hourloom.functions.timefns import floor_hour, ntz, weekday

RANGE_FROM, RANGE_TO = "2024-01-05 00:00:00", "2024-01-28 23:00:00"
FORECAST_FROM = "2024-01-20 00:00:00"
HISTORY_TO = "2024-01-18 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def station_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """station_id, date_time, y: hourly mean per event type."""
    events = table(spark, sf_dir, "events")
    return events.groupBy(F.col("event_type").alias("station_id"), floor_hour(F.col("ts")).alias("date_time")).agg(
        exact_mean(F.col("value"), 2).alias("y")
    )


STATION_HOURS = """station_hours AS (
  SELECT event_type AS station_id, date_trunc('hour', ts) AS date_time,
         CAST(sum(CAST(value AS DECIMAL(18, 2))) AS DOUBLE) / count(value) AS y
  FROM events GROUP BY 1, 2)"""


def user_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, date_time, y: hourly mean per user."""
    events = table(spark, sf_dir, "events")
    return events.groupBy("user_id", floor_hour(F.col("ts")).alias("date_time")).agg(
        exact_mean(F.col("value"), 2).alias("y")
    )


USER_HOURS = """user_hours AS (
  SELECT user_id, date_trunc('hour', ts) AS date_time,
         CAST(sum(CAST(value AS DECIMAL(18, 2))) AS DOUBLE) / count(value) AS y
  FROM events GROUP BY 1, 2)"""


def last_hour(spark: SparkSession, sf_dir: str) -> Column:
    """Newest hour, read from the time column alone."""
    return table(spark, sf_dir, "events").select(floor_hour(F.max("ts"))).scalar()


def pollutant_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, date_time, no2, pm10, pm25: three measurements per user and hour, each from its own event type."""
    kinds = {"no2": "view", "pm10": "purchase", "pm25": "error"}
    return (
        table(spark, sf_dir, "events")
        .groupBy("user_id", floor_hour(F.col("ts")).alias("date_time"))
        .agg(*[F.max(F.when(F.col("event_type") == kind, F.col("value"))).alias(p) for p, kind in kinds.items()])
    )


POLLUTANT_HOURS = """pollutant_hours AS (
  SELECT user_id, date_trunc('hour', ts) AS date_time,
         max(CASE WHEN event_type = 'view' THEN value END) AS no2,
         max(CASE WHEN event_type = 'purchase' THEN value END) AS pm10,
         max(CASE WHEN event_type = 'error' THEN value END) AS pm25
  FROM events GROUP BY 1, 2)"""


def day_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """station_id, day, obs, pred: daily means per user (as station); the prediction is the mean of the day before.

    Every seventh day of a month was not measured.
    """
    events = table(spark, sf_dir, "events")
    daily = events.groupBy(F.col("user_id").alias("station_id"), F.to_date("ts").alias("day")).agg(
        exact_mean(F.col("value"), 2).alias("obs")
    )
    before = F.lag("obs").over(Window.partitionBy("station_id").orderBy("day"))
    measured = F.when(F.dayofmonth("day") % 7 != 0, F.col("obs"))
    return daily.withColumn("pred", before).where(F.col("pred").isNotNull()).withColumn("obs", measured)


DAY_VALUES = """day_values AS (
  SELECT station_id, day, CASE WHEN day(day) % 7 <> 0 THEN obs END AS obs, pred FROM (
    SELECT station_id, day, obs, lag(obs) OVER (PARTITION BY station_id ORDER BY day) AS pred
    FROM (SELECT user_id AS station_id, CAST(ts AS DATE) AS day,
                 CAST(sum(CAST(value AS DECIMAL(18, 2))) AS DOUBLE) / count(value) AS obs
          FROM events GROUP BY 1, 2))
  WHERE pred IS NOT NULL)"""


# Made from the number of the customer, by another divisor each.
OTHER_LAND_USE = tuple(
    enumerate(
        ("grauflaeche", "gewaesser", "gruenflaeche", "infrastruktur", "mischnutzung", "wald", "wohnnutzung", "nox_h", "nox_i", "nox_v", "pmx_i"),
        start=3,
    )
)


def cell_columns(user: Column) -> list[Column]:
    """City cell of a user."""
    return [F.pmod(user, F.lit(16)).cast("int").alias("x"), F.floor(user / 16).cast("int").alias("y")]


class LazyTables(Mapping):
    """Tables by name, each planned when it is first asked for."""

    def __init__(self, builders: dict[str, Callable[[], DataFrame]]):
        self._builders, self._made = builders, {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._made:
            self._made[name] = self._builders[name]()
        return self._made[name]

    def __iter__(self):
        return iter(self._builders)

    def __len__(self) -> int:
        return len(self._builders)


def domain_tables(spark: SparkSession, sf_dir: str) -> Mapping[str, DataFrame]:
    """All inputs of the feature assembly."""
    events, customer = table(spark, sf_dir, "events"), table(spark, sf_dir, "customer")
    region = table(spark, sf_dir, "region")
    hour = floor_hour(F.col("ts")).alias("date_time")
    cell = cell_columns(F.col("user_id"))
    key = F.col("c_custkey")
    station = F.col("user_id").cast("string").alias("station_id")
    splice_at = ntz(FORECAST_FROM)

    def cells() -> DataFrame:
        return events.select("user_id").distinct().select(*cell, F.col("user_id"))

    def traffic() -> DataFrame:
        model = F.when(F.col("event_type") == "click", 2).otherwise(1).alias("model_id")
        return events.select(model, hour, *cell, F.col("value"), "ts", "event_id")

    def weather() -> DataFrame:
        def of(kind: str) -> Column:
            return F.when(F.col("event_type") == kind, F.col("value"))

        return events.groupBy(F.pmod("user_id", F.lit(4)).cast("int").alias("x"), F.lit(0).alias("y"), hour).agg(
            F.max("value").alias("wind_direction"),
            F.min("value").alias("wind_speed"),
            exact_mean(F.col("value"), 2).alias("precipitation"),
            F.count(F.lit(1)).cast("double").alias("temperature"),
            F.max(of("view")).alias("cloud_cover"),
            F.max(of("error")).alias("sunshine"),
            F.min(of("purchase")).alias("pressure_msl"),
        )

    def cams() -> DataFrame:
        point = [F.pmod("user_id", F.lit(5)).cast("int").alias("lat_int"), F.lit(7).alias("lon_int")]
        return events.groupBy(*point, hour).agg(
            exact_mean(F.col("value"), 2).alias("no2"), F.max("value").alias("pm10"), F.min("value").alias("pm25")
        )

    def reprojection() -> DataFrame:
        points = events.select(F.pmod("user_id", F.lit(5)).cast("int").alias("lat_int"), F.lit(7).alias("lon_int")).distinct()
        return points.select("lat_int", "lon_int", (F.col("lat_int") * 10).alias("x"), F.lit(70).alias("y"))

    kind = F.col("event_type")
    model_of_kind = F.when(kind == "view", 3).when(kind == "purchase", 1).when(kind == "error", 2).otherwise(0)

    def predictions() -> DataFrame:
        return events.select(hour, station, model_of_kind.alias("model_id"), "value")

    def history() -> DataFrame:
        """Written by earlier models: number 2x for most rows, 1x for some that are older still."""
        model = model_of_kind + F.when(F.col("event_id") % 10 == 0, 10).otherwise(20)
        past = events.where(floor_hour(F.col("ts")) <= ntz(HISTORY_TO))
        return past.select(hour, station, model.alias("model_id"), "value")

    def models_described() -> DataFrame:
        """All models ever registered: the final ones and two earlier ones of each pollutant."""
        earlier = models_final().withColumn("shift", F.explode(F.array(F.lit(0), F.lit(10), F.lit(20))))
        return earlier.select("pollutant", (F.col("model_id") + F.col("shift")).alias("model_id"))

    def models_final() -> DataFrame:
        number = F.col("r_regionkey")
        names = F.when(number == 1, "pm10").when(number == 2, "pm25").when(number == 3, "no2")
        return region.select(names.alias("pollutant"), F.lit("temporal").alias("domain"), number.alias("model_id"))

    def traffic_models_final() -> DataFrame:
        number = F.col("r_regionkey")
        return region.select(F.when(number == 1, "q_kfz").when(number == 2, "v_kfz").alias("depvar"), number.alias("model_id"))

    def measured() -> DataFrame:
        return events.groupBy(hour, station).agg(
            F.max("value").alias("pm10"), F.min("value").alias("pm25"), exact_mean(F.col("value"), 2).alias("no2")
        )

    def calendar() -> DataFrame:
        return events.select(hour).distinct().select(
            "date_time",
            (F.dayofyear("date_time") / 366).alias("doy_scaled"),
            F.when(weekday(F.col("date_time")) >= 6, "weekend").otherwise("none").alias("type_school_holiday"),
            (F.dayofyear("date_time") == 1).alias("is_public_holiday"),
        )

    def volume_shares() -> DataFrame:
        classes = customer.select(F.rint(F.abs("c_acctbal") / 1000).cast("int").alias("kkfz_per_24h")).distinct()
        return classes.select("kkfz_per_24h", (1 - F.col("kkfz_per_24h") / 10).alias("scaling_stadtrand"))

    return LazyTables(
        {
            "traffic_stations": traffic,
            "traffic_grid": traffic,
            "traffic_passive_samplers": traffic,
            "traffic_models_final": traffic_models_final,
            "traffic_scaling": lambda: customer.select(
                *cell_columns(key), (F.lit(0.5) + F.pmod(key, F.lit(10)) / 10).alias("scaling"),
                F.abs("c_acctbal").alias("kfz_per_24h"),
            ),
            "weather_forecast": lambda: weather().where(F.col("date_time") >= splice_at),
            "weather_observed": weather,
            "cams": cams,
            "reprojection": reprojection,
            "cell_map_dwd": lambda: cells().select(
                "x", "y", F.pmod("user_id", F.lit(4)).cast("int").alias("dwd_x"), F.lit(0).alias("dwd_y")
            ),
            "cell_map_cams": lambda: cells().select(
                "x", "y", (F.pmod("user_id", F.lit(5)) * 10).cast("int").alias("cams_x"), F.lit(70).alias("cams_y")
            ),
            "calendar": calendar,
            "land_use": lambda: customer.select(
                *cell_columns(key), F.col("c_acctbal").alias("building_density"),
                F.col("c_nationkey").cast("double").alias("traffic_intensity_kfz"),
                *[F.pmod(key, F.lit(n)).cast("double").alias(name) for n, name in OTHER_LAND_USE],
            ),
            "station_map": lambda: cells().select("x", "y", station),
            "stations": lambda: customer.select(
                key.cast("string").alias("station_id"), (F.col("c_mktsegment") != "MACHINERY").alias("is_active")
            ),
            "sampler_map": lambda: customer.where(F.col("c_acctbal") < 0).select(*cell_columns(key)),
            "grid_batches": lambda: customer.select(*cell_columns(key), F.floor(key / 50).cast("int").alias("batch")),
            "grid_sim_batches": lambda: customer.select(*cell_columns(key), F.floor(key / 100).cast("int").alias("batch")),
            "observations": measured,
            "predictions_history": history,
            "models_described": models_described,
            "predictions_latest": predictions,
            "models_final": models_final,
            "station_types": lambda: customer.select(
                key.cast("string").alias("station_id"),
                F.when(F.col("c_mktsegment") == "BUILDING", "Verkehr").alias("station_type"),
            ),
            "scaling_by_volume": volume_shares,
        }
    )


# The same tables as SQL. x and y of a user or customer k are k % 16 and k // 16.
DOMAIN = {
    "traffic": """traffic AS (
  SELECT CASE WHEN event_type = 'click' THEN 2 ELSE 1 END AS model_id, date_trunc('hour', ts) AS date_time,
         CAST(user_id % 16 AS INTEGER) AS x, CAST(user_id // 16 AS INTEGER) AS y, value, ts, event_id FROM events)""",
    "traffic_scaling": """traffic_scaling AS (
  SELECT CAST(c_custkey % 16 AS INTEGER) AS x, CAST(c_custkey // 16 AS INTEGER) AS y,
         CAST(0.5 AS DOUBLE) + CAST(c_custkey % 10 AS DOUBLE) / 10 AS scaling, abs(c_acctbal) AS kfz_per_24h
  FROM customer)""",
    "weather": """weather AS (
  SELECT CAST(user_id % 4 AS INTEGER) AS dwd_x, date_trunc('hour', ts) AS date_time,
         max(value) AS wind_direction, min(value) AS wind_speed,
         CAST(sum(CAST(value AS DECIMAL(18, 2))) AS DOUBLE) / count(value) AS precipitation,
         CAST(count(*) AS DOUBLE) AS temperature,
         max(CASE WHEN event_type = 'view' THEN value END) AS cloud_cover,
         max(CASE WHEN event_type = 'error' THEN value END) AS sunshine,
         min(CASE WHEN event_type = 'purchase' THEN value END) AS pressure_msl
  FROM events GROUP BY 1, 2)""",
    "cams": """cams AS (
  SELECT CAST(user_id % 5 AS INTEGER) AS lat_int, date_trunc('hour', ts) AS date_time,
         CAST(sum(CAST(value AS DECIMAL(18, 2))) AS DOUBLE) / count(value) AS cams_no2,
         max(value) AS cams_pm10, min(value) AS cams_pm25
  FROM events GROUP BY 1, 2)""",
    "predictions": """predictions AS (
  SELECT date_trunc('hour', ts) AS date_time, CAST(user_id AS VARCHAR) AS station_id,
         CASE event_type WHEN 'view' THEN 3 WHEN 'purchase' THEN 1 WHEN 'error' THEN 2 ELSE 0 END AS model_id, value, event_id
  FROM events)""",
    "station_types": """station_types AS (
  SELECT CAST(c_custkey AS VARCHAR) AS station_id,
         CASE WHEN c_mktsegment = 'BUILDING' THEN 'Verkehr' END AS station_type FROM customer)""",
    "scaling_by_volume": """scaling_by_volume AS (
  SELECT DISTINCT CAST(round_even(abs(c_acctbal) / 1000, 0) AS INTEGER) AS kkfz_per_24h,
         1 - CAST(round_even(abs(c_acctbal) / 1000, 0) AS DOUBLE) / 10 AS scaling_stadtrand FROM customer)""",
}
