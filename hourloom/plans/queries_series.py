"""Queries on cleaning, time, lags and source handling, each with the SQL that states its result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hourloom.functions import timefns as tf
from hourloom.operators import cleaning, lags, mapping
from hourloom.operators.evaluation import exact_quantile, predictions_with_observations
from hourloom.operators.station_average import pivot_by_model
from hourloom.plans import samples
from hourloom.plans.samples import FORECAST_FROM, HISTORY_TO, POLLUTANT_HOURS, RANGE_FROM, RANGE_TO, STATION_HOURS, USER_HOURS, table
from hourloom.sources import merge, tables

LAG_BAND = tuple(range(1, 9))


def capped_hourly_lags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly series per user, capped, with own lags 1, 2, 24 and the average of lags 1..5."""
    capped = cleaning.cap_outliers(samples.user_hours(spark, sf_dir), {"y": 120.0})
    made = lags.add_station_lags(capped, "y", [1, 2, 24], [1, 2, 3, 4, 5], "user_id", average_name="lag_avg_1_5")
    return made.select("user_id", "date_time", "y", "y_lag1", "y_lag2", "y_lag24", "lag_avg_1_5")


CAPPED_HOURLY_LAGS = f"""WITH {USER_HOURS},
capped AS (SELECT user_id, date_time, CASE WHEN y > 120 THEN 120 ELSE y END AS y FROM user_hours),
lagged AS (SELECT *, {", ".join(f"lag(y, {k}) OVER w AS y_lag{k}" for k in (1, 2, 3, 4, 5, 24))}
           FROM capped WINDOW w AS (PARTITION BY user_id ORDER BY date_time))
SELECT user_id, date_time, y, y_lag1, y_lag2, y_lag24,
       ({" + ".join(f"coalesce(y_lag{k}, 0)" for k in range(1, 6))}) /
       nullif({" + ".join(f"CASE WHEN y_lag{k} IS NULL THEN 0 ELSE 1 END" for k in range(1, 6))}, 0) AS lag_avg_1_5
FROM lagged"""


def multi_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lags.add_row_lags(samples.user_hours(spark, sf_dir), ["user_id"], ["date_time"], {"y": (4, 8, 24, 48)})


MULTI_LAG = f"""WITH {USER_HOURS}
SELECT *, {", ".join(f"lag(y, {k}) OVER w AS y_la{k}" for k in (4, 8, 24, 48))}
FROM user_hours WINDOW w AS (PARTITION BY user_id ORDER BY date_time)"""


def multi_lag_irregular(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row lags on raw events, where one user may own a large share of all rows: cut into blocks of minutes."""
    events = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "value")
    minute = F.floor(F.unix_timestamp("ts") / 60)
    return lags.add_row_lags_blocked(events, ["user_id"], ["ts", "event_id"], {"value": (1, 4, 24)}, minute)


MULTI_LAG_IRREGULAR = """SELECT user_id, ts, event_id, value,
  lag(value, 1) OVER w AS value_la1, lag(value, 4) OVER w AS value_la4, lag(value, 24) OVER w AS value_la24
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)"""


def lag_with_lookback(spark: SparkSession, sf_dir: str) -> DataFrame:
    series = samples.station_hours(spark, sf_dir)
    return lags.with_lookback(
        series, "date_time", tf.ntz(RANGE_FROM), tf.ntz(RANGE_TO), 48,
        lambda d: lags.add_row_lags(d, ["station_id"], ["date_time"], {"y": (4, 48)}),
    )


LAG_WITH_LOOKBACK = f"""WITH {STATION_HOURS}
SELECT * FROM (
  SELECT *, lag(y, 4) OVER w AS y_la4, lag(y, 48) OVER w AS y_la48 FROM station_hours
  WHERE date_time BETWEEN TIMESTAMP '{RANGE_FROM}' - INTERVAL 48 HOUR AND TIMESTAMP '{RANGE_TO}'
  WINDOW w AS (PARTITION BY station_id ORDER BY date_time))
WHERE date_time >= TIMESTAMP '{RANGE_FROM}'"""


def station_lags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Own lags and their average, for the target and for its copy used in training."""
    series = samples.station_hours(spark, sf_dir).withColumn("y_train", F.when(F.col("y") <= 60, F.col("y")))
    made = lags.add_station_lags(series, "y", [24, 48], [1, 2, 3])
    return made.withColumnsRenamed({"lag_avg_(1, 2, 3)": "lag_avg", "lag_avg_(1, 2, 3)_train": "lag_avg_train"})


def _mean_sql(columns: list[str]) -> str:
    return (
        f"({' + '.join(f'coalesce({c}, 0)' for c in columns)}) / "
        f"nullif({' + '.join(f'CASE WHEN {c} IS NULL THEN 0 ELSE 1 END' for c in columns)}, 0)"
    )


STATION_LAGS = f"""WITH {STATION_HOURS},
base AS (SELECT *, CASE WHEN y <= 60 THEN y END AS y_train FROM station_hours),
lagged AS (SELECT *, {", ".join(f"lag(y, {k}) OVER w AS y_lag{k}, lag(y_train, {k}) OVER w AS y_lag{k}_train" for k in (1, 2, 3, 24, 48))}
           FROM base WINDOW w AS (PARTITION BY station_id ORDER BY date_time))
SELECT *, {_mean_sql(["y_lag1", "y_lag2", "y_lag3"])} AS lag_avg,
       {_mean_sql(["y_lag1_train", "y_lag2_train", "y_lag3_train"])} AS lag_avg_train FROM lagged"""


def lag_avg_skipna(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = lags.add_station_lags(samples.user_hours(spark, sf_dir), "y", [], [1, 2, 3, 4, 5], "user_id", average_name="lag_avg")
    return made.select("user_id", "date_time", "lag_avg")


LAG_AVG_SKIPNA = f"""WITH {USER_HOURS},
lagged AS (SELECT *, {", ".join(f"lag(y, {k}) OVER w AS l{k}" for k in range(1, 6))}
           FROM user_hours WINDOW w AS (PARTITION BY user_id ORDER BY date_time))
SELECT user_id, date_time, {_mean_sql([f"l{k}" for k in range(1, 6)])} AS lag_avg FROM lagged"""


def lag_band_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = lags.add_row_lags(samples.user_hours(spark, sf_dir), ["user_id"], ["date_time"], {"y": LAG_BAND})
    return lags.add_lag_band(made, "y", LAG_BAND).select("user_id", "date_time", "y_la1to8")


LAG_BAND_MEAN = f"""WITH {USER_HOURS}
SELECT user_id, date_time, ({" + ".join(f"lag(y, {k}) OVER w" for k in LAG_BAND)}) / 8 AS y_la1to8
FROM user_hours WINDOW w AS (PARTITION BY user_id ORDER BY date_time)"""


def time_offset_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lags.add_time_lags(samples.user_hours(spark, sf_dir), ["user_id"], "date_time", {"y": (1, 3, 24)})


TIME_OFFSET_LAG = f"""WITH {USER_HOURS}
SELECT a.*, b1.y AS y_la1, b3.y AS y_la3, b24.y AS y_la24 FROM user_hours a
{" ".join(f"LEFT JOIN user_hours b{k} ON b{k}.user_id = a.user_id AND b{k}.date_time = a.date_time - INTERVAL {k} HOUR" for k in (1, 3, 24))}"""


def calendar_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    ts = F.col("ts")
    return table(spark, sf_dir, "events").select(
        "event_id", tf.weekday(ts).cast("long").alias("weekday"), F.year(ts).cast("long").alias("year"),
        F.hour(ts).cast("long").alias("hour"), F.hour(tf.to_local(ts)).cast("long").alias("local_hour"),
    )


LOCAL = "timezone('Europe/Berlin', timezone('UTC', {0}))"
CALENDAR_FEATURES = f"""SELECT event_id, isodow(ts) AS weekday, year(ts) AS year, hour(ts) AS hour,
  hour({LOCAL.format('ts')}) AS local_hour FROM events"""


def local_hour_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        *[
            tf.traffic_hour(F.col("o_orderdate") + tf.hours(h)).alias(f"daytime_{h}")
            for h in (0, 3, 4, 19, 20, 21)
        ],
    )


LOCAL_HOUR_MASK = "SELECT o_orderkey, " + ", ".join(
    f"hour({LOCAL.format(f'o_orderdate + INTERVAL {h} HOUR')}) BETWEEN 5 AND 21 AS daytime_{h}" for h in (0, 3, 4, 19, 20, 21)
) + " FROM orders"


def to_unix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        "event_id", tf.unix_seconds(F.col("ts")).alias("from_utc"),
        tf.unix_seconds(F.col("ts"), tf.LOCAL_ZONE).alias("from_local"),
        tf.to_utc(F.col("ts")).alias("local_as_utc"),
    )


TO_UNIX = """SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) AS from_utc,
  CAST(floor(epoch(timezone('Europe/Berlin', ts))) AS BIGINT) AS from_local,
  timezone('UTC', timezone('Europe/Berlin', ts)) AS local_as_utc FROM events"""


def model_start_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        "event_id", tf.model_start(F.col("ts")).alias("twice_daily"), tf.model_start(F.col("ts"), False).alias("hourly")
    )


MODEL_START_TIME = f"""WITH l AS (SELECT event_id, {LOCAL.format('ts')} AS t FROM events)
SELECT event_id, CASE WHEN hour(t) >= 15 THEN date_trunc('day', t) + INTERVAL 15 HOUR
                      WHEN hour(t) < 5 THEN date_trunc('day', t) - INTERVAL 9 HOUR
                      ELSE date_trunc('day', t) + INTERVAL 5 HOUR END AS twice_daily,
       date_trunc('hour', t) AS hourly FROM l"""


def forecast_horizon_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    moment = F.col("o_orderdate") + tf.hours(F.pmod("o_orderkey", F.lit(24)))
    return table(spark, sf_dir, "orders").select("o_orderkey", tf.horizon_end(moment).alias("horizon_end"))


FORECAST_HORIZON_END = f"""WITH m AS (
  SELECT o_orderkey, o_orderdate + to_hours(CAST(o_orderkey % 24 AS INTEGER)) AS t FROM orders),
ahead AS (SELECT o_orderkey, t + to_hours(CASE WHEN hour({LOCAL.format('t')}) >= 12 THEN 120 ELSE 96 END) AS t FROM m)
SELECT o_orderkey, CAST(date_trunc('day', {LOCAL.format('t')}) AS TIMESTAMP) AS horizon_end FROM ahead"""


def align_prediction_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    moment = F.col("o_orderdate") + tf.hours(F.pmod("o_orderkey", F.lit(24)))
    return table(spark, sf_dir, "orders").select("o_orderkey", tf.align_prediction_hour(moment, 46, 5).alias("aligned"))


ALIGN_PREDICTION_HOUR = f"""WITH m AS (
  SELECT o_orderkey, o_orderdate + to_hours(CAST(o_orderkey % 24 AS INTEGER)) AS t FROM orders)
SELECT o_orderkey, t - to_hours(CAST((hour({LOCAL.format('t - INTERVAL 46 HOUR')}) - 5 + 24) % 24 AS INTEGER)) AS aligned
FROM m"""


def clamp_start(spark: SparkSession, sf_dir: str) -> DataFrame:
    latest = table(spark, sf_dir, "events").groupBy("user_id").agg(tf.floor_hour(F.max("ts")).alias("latest"))
    return latest.select("user_id", tf.clamp_start(tf.ntz("2024-01-30 18:00:00"), F.col("latest")).alias("start"))


CLAMP_START = """SELECT user_id, CASE WHEN TIMESTAMP '2024-01-30 18:00:00' - INTERVAL 1 HOUR > latest
  THEN latest + INTERVAL 1 HOUR ELSE TIMESTAMP '2024-01-30 18:00:00' END AS start
FROM (SELECT user_id, date_trunc('hour', max(ts)) AS latest FROM events GROUP BY 1)"""


def latest_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.latest_per_key(table(spark, sf_dir, "events"), ["user_id", "event_type"], [F.desc("ts"), F.desc("event_id")])


LATEST_PER_KEY = """SELECT * EXCLUDE (n) FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS n FROM events)
WHERE n = 1"""


def upsert_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored rows from views, clicks and errors; purchases and sign-ups arrive later and replace the same hour."""
    events = table(spark, sf_dir, "events")
    late = F.col("event_type").isin("purchase", "signup")
    hour = tf.floor_hour(F.col("ts")).alias("date_time")

    def rows(part: DataFrame) -> DataFrame:
        return part.groupBy("user_id", hour).agg(F.max("value").alias("value"))

    return merge.merge_rows(rows(events.where(~late)), rows(events.where(late)), ["user_id", "date_time"])


UPSERT_REPLACE = """WITH r AS (
  SELECT user_id, date_trunc('hour', ts) AS date_time, event_type IN ('purchase', 'signup') AS late, max(value) AS value
  FROM events GROUP BY 1, 2, 3)
SELECT user_id, date_time, coalesce(max(CASE WHEN late THEN value END), max(value)) AS value FROM r GROUP BY 1, 2"""


def drop_empty_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Series are users; the target is the price of a large purchase, which some users never make."""
    large = (F.col("event_type") == "purchase") & (F.col("value") > 120)
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", F.when(large, F.col("value")).alias("target"))
    return cleaning.drop_empty_series(rows, "target", "user_id")


DROP_EMPTY_SERIES = """WITH r AS (
  SELECT event_id, user_id, CASE WHEN event_type = 'purchase' AND value > 120 THEN value END AS target FROM events)
SELECT * FROM r WHERE user_id IN (SELECT user_id FROM r WHERE target IS NOT NULL)"""


def _caps(spark: SparkSession, sf_dir: str):
    """Caps of the three pollutants as scalars, looked up in a table made from the retail prices of parts."""
    part = table(spark, sf_dir, "part")
    level = part.agg(F.min("p_retailprice").alias("low")).select(
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(p).alias("pollutant"), (F.col("low") / F.lit(d)).alias("cap_value_outlier"))
                    for p, d in (("no2", 10.0), ("pm10", 8.0), ("pm25", 16.0))
                ]
            )
        )
    )
    return {p: tables.cap_value(level, p, "cap_value_outlier") for p in ("no2", "pm10", "pm25")}


CAPS = """caps AS (SELECT min(p_retailprice) / 10.0::DOUBLE AS no2, min(p_retailprice) / 8.0::DOUBLE AS pm10,
  min(p_retailprice) / 16.0::DOUBLE AS pm25 FROM part)"""


def cap_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.cap_outliers(samples.pollutant_hours(spark, sf_dir), _caps(spark, sf_dir))


CAP_OUTLIERS = f"""WITH {POLLUTANT_HOURS}, {CAPS}
SELECT user_id, date_time, {", ".join(f"CASE WHEN h.{p} > caps.{p} THEN caps.{p} ELSE h.{p} END AS {p}" for p in ("no2", "pm10", "pm25"))}
FROM pollutant_hours h, caps"""


def count_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.count_outliers(samples.pollutant_hours(spark, sf_dir), _caps(spark, sf_dir))


COUNT_CAPPED = f"""WITH {POLLUTANT_HOURS}, {CAPS}
SELECT {", ".join(f"count(*) FILTER (WHERE h.{p} > caps.{p}) AS {p}_capped" for p in ("no2", "pm10", "pm25"))}
FROM pollutant_hours h, caps"""


def cap_training(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = lags.add_station_lags(samples.user_hours(spark, sf_dir), "y", [1], [1, 2], "user_id", average_name="lag_avg_1_2")
    made = made.withColumn("cams_y_la1", F.col("y_lag1"))
    return cleaning.cap_for_training(made, "y", 75.0)


CAP_TRAINING = f"""WITH {USER_HOURS},
lagged AS (SELECT *, lag(y, 1) OVER w AS y_lag1, lag(y, 2) OVER w AS y_lag2
           FROM user_hours WINDOW w AS (PARTITION BY user_id ORDER BY date_time)),
averaged AS (SELECT *, {_mean_sql(["y_lag1", "y_lag2"])} AS lag_avg_1_2, y_lag1 AS cams_y_la1 FROM lagged)
SELECT user_id, date_time, cams_y_la1, {", ".join(f"CASE WHEN {c} > 75 THEN 75 ELSE {c} END AS {c}" for c in ("y", "y_lag1", "y_lag2", "lag_avg_1_2"))}
FROM averaged"""


def fix_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_shipdate")
    return cleaning.fix_column_types(items, ["l_linenumber"], ["l_suppkey", "l_quantity"], "l_shipdate")


FIX_TYPES = """SELECT l_orderkey, CAST(l_linenumber AS VARCHAR) AS l_linenumber, CAST(l_suppkey AS DOUBLE) AS l_suppkey,
  l_quantity, l_shipdate FROM lineitem"""


def drop_missing_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.drop_missing_target(samples.pollutant_hours(spark, sf_dir), "no2")


DROP_MISSING_TARGET = f"WITH {POLLUTANT_HOURS} SELECT * FROM pollutant_hours WHERE no2 IS NOT NULL"


def horizon_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order is the moment of the forecast, the shipping date of an item the time it is for; second day ahead."""
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_shipdate").alias("date_time"))
    made = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderdate").alias("date_time_forecast")
    )
    return cleaning.within_horizon(items.join(made, "l_orderkey"), 2)


HORIZON_FILTER = """SELECT l_orderkey, l_linenumber, l_shipdate AS date_time, o_orderdate AS date_time_forecast
FROM lineitem JOIN orders ON o_orderkey = l_orderkey
WHERE l_shipdate - o_orderdate > INTERVAL 24 HOUR AND l_shipdate - o_orderdate <= INTERVAL 48 HOUR"""


def range_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing bounds of a request filled in: a user with a purchase asks for data from the first one on."""
    bought = F.when(F.col("event_type") == "purchase", F.col("ts"))
    rows = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max("ts").alias("now"), F.min(bought).alias("asked"))
    asked = F.col("asked")
    lo, hi = tf.bounds(asked, None, F.col("now"))
    return rows.select("user_id", lo.alias("lo"), hi.alias("hi"))


RANGE_BOUNDS = """SELECT user_id, coalesce(min(ts) FILTER (WHERE event_type = 'purchase'), TIMESTAMP '2015-01-01') AS lo,
  max(ts) + INTERVAL 5 DAY AS hi FROM events GROUP BY user_id"""


def completeness_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    lo, hi = tf.ntz(RANGE_FROM), tf.ntz(RANGE_TO)
    rows = tables.in_range(samples.station_hours(spark, sf_dir), "date_time", lo, hi)
    return cleaning.completeness(rows, lo, hi, ["station_id"])


COMPLETENESS_CHECK = f"""WITH {STATION_HOURS}
SELECT count(DISTINCT station_id) AS n_coords, count(*) AS n_rows,
  count(DISTINCT station_id) * (date_diff('hour', TIMESTAMP '{RANGE_FROM}', TIMESTAMP '{RANGE_TO}') + 1) AS expected_rows,
  count(*) = count(DISTINCT station_id) * (date_diff('hour', TIMESTAMP '{RANGE_FROM}', TIMESTAMP '{RANGE_TO}') + 1) AS complete
FROM station_hours WHERE date_time BETWEEN TIMESTAMP '{RANGE_FROM}' AND TIMESTAMP '{RANGE_TO}'"""


def incomplete_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    lo, hi = tf.ntz(RANGE_FROM), tf.ntz(RANGE_TO)
    rows = tables.in_range(samples.user_hours(spark, sf_dir), "date_time", lo, hi)
    return cleaning.incomplete_series(rows, lo, hi, ["user_id"])


INCOMPLETE_SERIES = f"""WITH {USER_HOURS}, c AS (
  SELECT user_id, count(*) AS n_rows FROM user_hours
  WHERE date_time BETWEEN TIMESTAMP '{RANGE_FROM}' AND TIMESTAMP '{RANGE_TO}' GROUP BY 1)
SELECT * FROM (SELECT *, date_diff('hour', TIMESTAMP '{RANGE_FROM}', TIMESTAMP '{RANGE_TO}') + 1 - n_rows AS n_missing FROM c)
WHERE n_missing <> 0"""


def duplicate_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey", "l_quantity", "l_discount", "l_tax")
    return cleaning.duplicate_rows(items, ["l_suppkey", "l_partkey", "l_quantity"])


DUPLICATE_ROWS = """SELECT l_suppkey, l_partkey, l_quantity, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1"""


def cap_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_quantile(table(spark, sf_dir, "events"), ["event_type"], "value", 0.999).withColumn(
        "quantile", F.round("quantile", 6)
    )


CAP_VALUES = "SELECT event_type, round(quantile_cont(value, 0.999), 6) AS quantile FROM events GROUP BY 1"


def cap_values_by_supplier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quantile of the largest table, per supplier."""
    return exact_quantile(table(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_extendedprice", 0.75).withColumn(
        "quantile", F.round("quantile", 4)
    )


CAP_VALUES_BY_SUPPLIER = "SELECT l_suppkey, round(quantile_cont(l_extendedprice, 0.75), 4) AS quantile FROM lineitem GROUP BY 1"


def map_source_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders per region and month as the coarse source, nations as the fine cells; lags are taken on the regions."""
    nation, customer, orders = (table(spark, sf_dir, t) for t in ("nation", "customer", "orders"))
    of_region = customer.join(nation, customer.c_nationkey == nation.n_nationkey).select("c_custkey", "n_regionkey")
    month = F.to_date(F.trunc(F.to_date("o_orderdate"), "month")).alias("month")
    source = (
        orders.join(of_region, orders.o_custkey == of_region.c_custkey)
        .groupBy("n_regionkey", month)
        .agg(F.count(F.lit(1)).alias("n_orders"), F.max("o_totalprice").alias("top_price"))
    )
    cells = nation.select("n_nationkey", "n_regionkey")
    return mapping.lag_then_expand(source, cells, ["n_regionkey"], "month", {"n_orders": (1, 12), "top_price": (1,)})


MAP_SOURCE_CELLS = """WITH source AS (
  SELECT n_regionkey, CAST(date_trunc('month', o_orderdate) AS DATE) AS month, count(*) AS n_orders, max(o_totalprice) AS top_price
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2),
cells AS (SELECT n_nationkey, month, n_orders, top_price FROM source JOIN nation USING (n_regionkey))
SELECT *, lag(n_orders, 1) OVER w AS n_orders_la1, lag(n_orders, 12) OVER w AS n_orders_la12, lag(top_price, 1) OVER w AS top_price_la1
FROM cells WINDOW w AS (PARTITION BY n_nationkey ORDER BY month)"""


def reproject_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two hops: source points to projected cells, projected cells to city cells."""
    customer, orders = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    points = orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n_orders"))
    projection = customer.select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("n_nationkey"))
    cells = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    per_cell = mapping.reproject(points, projection, ["o_custkey"]).groupBy("n_nationkey").agg(
        F.sum("n_orders").alias("n_orders")
    )
    return mapping.expand_to_cells(per_cell, cells, ["n_nationkey"])


REPROJECT_SOURCE = """SELECT n_name, CAST(count(*) AS BIGINT) AS n_orders FROM orders JOIN customer ON o_custkey = c_custkey
JOIN nation ON c_nationkey = n_nationkey GROUP BY 1"""


def scaled_traffic(spark: SparkSession, sf_dir: str) -> DataFrame:
    domain = samples.domain_tables(spark, sf_dir)
    volume = domain["traffic_grid"].where(F.col("model_id") == 1).select("event_id", "x", "y", "value")
    return mapping.scale_volume(volume, domain["traffic_scaling"])


SCALED_TRAFFIC = f"""WITH {samples.DOMAIN["traffic"]}, {samples.DOMAIN["traffic_scaling"]}
SELECT event_id, x, y, scaling * value AS kfz_per_hour FROM traffic JOIN traffic_scaling USING (x, y) WHERE model_id = 1"""


def splice_obs_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases after a point in time act as forecasts and begin a little later in each table; all else is observed."""
    events = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    forecast = events.where((F.col("event_type") == "purchase") & (F.col("ts") >= tf.ntz(FORECAST_FROM)))
    observed = events.where(F.col("event_type") != "purchase")
    return merge.observations_before_forecast(observed, forecast, "ts")


SPLICE_OBS_FORECAST = f"""WITH e AS (SELECT event_id, ts, user_id, event_type, value FROM events),
f AS (SELECT * FROM e WHERE event_type = 'purchase' AND ts >= TIMESTAMP '{FORECAST_FROM}')
SELECT * FROM f UNION ALL
SELECT * FROM e WHERE event_type <> 'purchase' AND ts < (SELECT min(ts) FROM f)"""


def splice_history_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    history = events.where((F.col("event_type") != "view") & (F.col("ts") <= tf.ntz(HISTORY_TO)))
    return merge.history_then_latest(history, events.where(F.col("event_type") == "view"), "ts")


SPLICE_HISTORY_LATEST = f"""WITH e AS (SELECT event_id, ts, user_id, event_type, value FROM events),
h AS (SELECT * FROM e WHERE event_type <> 'view' AND ts <= TIMESTAMP '{HISTORY_TO}')
SELECT * FROM h UNION ALL SELECT * FROM e WHERE event_type = 'view' AND ts > (SELECT max(ts) FROM h)"""


def pivot_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(
        tf.floor_hour(F.col("ts")).alias("date_time"), "user_id", F.col("event_type").alias("model_id"), "value"
    )
    kinds = {"no2_filled": "view", "pm10_filled": "purchase", "pm25_filled": "error"}
    return pivot_by_model(rows, ["date_time", "user_id"], {name: F.lit(kind) for name, kind in kinds.items()})


PIVOT_MODELS = """SELECT date_trunc('hour', ts) AS date_time, user_id,
  max(CASE WHEN event_type = 'view' THEN value END) AS no2_filled,
  max(CASE WHEN event_type = 'purchase' THEN value END) AS pm10_filled,
  max(CASE WHEN event_type = 'error' THEN value END) AS pm25_filled FROM events GROUP BY 1, 2"""


def coords_by_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    domain = samples.domain_tables(spark, sf_dir)
    parts = [
        tables.coords_for(mode, domain).select(F.lit(mode).alias("mode"), "x", "y")
        for mode in ("stations", "passive_samplers", "grid")
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


COORDS_BY_MODE = """WITH c AS (SELECT *, CAST(c_custkey % 16 AS INTEGER) AS x, CAST(c_custkey // 16 AS INTEGER) AS y FROM customer)
SELECT 'stations' AS mode, x, y FROM c WHERE c_mktsegment <> 'MACHINERY' AND c_custkey IN (SELECT user_id FROM events)
UNION ALL SELECT 'passive_samplers', x, y FROM c WHERE c_acctbal < 0
UNION ALL SELECT 'grid', x, y FROM c"""


def station_type_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Station number cut out of a long id, only for stations in use."""
    supplier = table(spark, sf_dir, "supplier")
    long_id = F.concat(F.lit("DEB"), F.lpad(F.col("s_suppkey").cast("string"), 3, "0")).alias("id")
    types = supplier.select(long_id, F.when(F.col("s_acctbal") > 5000, "Verkehr").otherwise("Stadtrand").alias("stattyp"))
    used = table(spark, sf_dir, "lineitem").where(F.col("l_returnflag") == "R").select(
        F.concat(F.lit("DEB"), F.lpad(F.col("l_suppkey").cast("string"), 3, "0")).alias("id")
    )
    return tables.station_types(used, types)


STATION_TYPE_LOOKUP = """SELECT substring('DEB' || lpad(CAST(s_suppkey AS VARCHAR), 3, '0'), 4, 3) AS station_id,
  CASE WHEN s_acctbal > 5000 THEN 'Verkehr' ELSE 'Stadtrand' END AS stattyp
FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_returnflag = 'R')"""


def small_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows per batch next to the largest batch and the most recent observation, all inside one plan."""
    domain = samples.domain_tables(spark, sf_dir)
    return tables.rows_per_batch(domain["grid_batches"]).select(
        "batch", "n_coords", tables.largest_batch(domain["grid_batches"]).alias("max_batch"),
        tables.latest_time(table(spark, sf_dir, "events"), "ts").alias("latest"),
    )


SMALL_LOOKUPS = """WITH b AS (SELECT CAST(c_custkey // 50 AS INTEGER) AS batch FROM customer)
SELECT batch, count(*) AS n_coords, (SELECT max(batch) FROM b) AS max_batch, (SELECT max(ts) FROM events) AS latest
FROM b GROUP BY 1"""


def pred_vs_obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions of one model at chosen stations with the observed values of that hour."""
    hours = samples.pollutant_hours(spark, sf_dir).withColumnRenamed("user_id", "station_id")
    predictions = table(spark, sf_dir, "events").groupBy(
        F.col("user_id").alias("station_id"), tf.floor_hour(F.col("ts")).alias("date_time"),
        F.when(F.col("event_type") == "signup", 1).otherwise(2).alias("model_id"),
    ).agg(F.max("value").alias("pred"))
    observations = hours.where(F.coalesce("no2", "pm10").isNotNull())
    stations = table(spark, sf_dir, "customer").where(F.col("c_mktsegment") == "BUILDING").select(
        F.col("c_custkey").alias("station_id")
    )
    return predictions_with_observations(predictions, observations, 2, stations)


PRED_VS_OBS = f"""WITH {POLLUTANT_HOURS}, p AS (
  SELECT user_id AS station_id, date_trunc('hour', ts) AS date_time, CASE WHEN event_type = 'signup' THEN 1 ELSE 2 END AS model_id,
         max(value) AS pred FROM events GROUP BY 1, 2, 3)
SELECT p.*, no2, pm10, pm25 FROM p LEFT JOIN pollutant_hours h
  ON h.user_id = p.station_id AND h.date_time = p.date_time AND coalesce(h.no2, h.pm10) IS NOT NULL
WHERE model_id = 2 AND station_id IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')"""


QUERIES = {
    "capped_hourly_lags": (capped_hourly_lags, CAPPED_HOURLY_LAGS),
    "multi_lag": (multi_lag, MULTI_LAG),
    "multi_lag_irregular": (multi_lag_irregular, MULTI_LAG_IRREGULAR),
    "lag_with_lookback": (lag_with_lookback, LAG_WITH_LOOKBACK),
    "station_lags": (station_lags, STATION_LAGS),
    "lag_avg_skipna": (lag_avg_skipna, LAG_AVG_SKIPNA),
    "lag_band_mean": (lag_band_mean, LAG_BAND_MEAN),
    "time_offset_lag": (time_offset_lag, TIME_OFFSET_LAG),
    "calendar_features": (calendar_features, CALENDAR_FEATURES),
    "local_hour_mask": (local_hour_mask, LOCAL_HOUR_MASK),
    "to_unix": (to_unix, TO_UNIX),
    "model_start_time": (model_start_time, MODEL_START_TIME),
    "forecast_horizon_end": (forecast_horizon_end, FORECAST_HORIZON_END),
    "align_prediction_hour": (align_prediction_hour, ALIGN_PREDICTION_HOUR),
    "clamp_start": (clamp_start, CLAMP_START),
    "latest_per_key": (latest_per_key, LATEST_PER_KEY),
    "upsert_replace": (upsert_replace, UPSERT_REPLACE),
    "drop_empty_series": (drop_empty_series, DROP_EMPTY_SERIES),
    "cap_outliers": (cap_outliers, CAP_OUTLIERS),
    "count_capped": (count_capped, COUNT_CAPPED),
    "cap_training": (cap_training, CAP_TRAINING),
    "fix_types": (fix_types, FIX_TYPES),
    "drop_missing_target": (drop_missing_target, DROP_MISSING_TARGET),
    "horizon_filter": (horizon_filter, HORIZON_FILTER),
    "range_bounds": (range_bounds, RANGE_BOUNDS),
    "completeness_check": (completeness_check, COMPLETENESS_CHECK),
    "incomplete_series": (incomplete_series, INCOMPLETE_SERIES),
    "duplicate_rows": (duplicate_rows, DUPLICATE_ROWS),
    "cap_values": (cap_values, CAP_VALUES),
    "cap_values_by_supplier": (cap_values_by_supplier, CAP_VALUES_BY_SUPPLIER),
    "map_source_cells": (map_source_cells, MAP_SOURCE_CELLS),
    "reproject_source": (reproject_source, REPROJECT_SOURCE),
    "scaled_traffic": (scaled_traffic, SCALED_TRAFFIC),
    "splice_obs_forecast": (splice_obs_forecast, SPLICE_OBS_FORECAST),
    "splice_history_latest": (splice_history_latest, SPLICE_HISTORY_LATEST),
    "pivot_by_model": (pivot_models, PIVOT_MODELS),
    "coords_by_mode": (coords_by_mode, COORDS_BY_MODE),
    "station_type_lookup": (station_type_lookup, STATION_TYPE_LOOKUP),
    "small_lookups": (small_lookups, SMALL_LOOKUPS),
    "pred_vs_obs": (pred_vs_obs, PRED_VS_OBS),
}
