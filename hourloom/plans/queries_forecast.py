"""Queries on folds, metrics, limits, scenarios, forecasts, models and requests, with SQL where SQL can state them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hourloom.functions import timefns as tf
from hourloom.functions.params import (
    CAMS_LAGS, POLLUTANTS, STATION_AVERAGE_BAND, STATION_AVERAGE_LAGS, TRAFFIC_LAGS, WEATHER_LAGS, FeatureSpec, boosting_params,
)
from hourloom.operators import attribution, cleaning, evaluation, folds, scenarios
from hourloom.operators.forecast import lags_from_predictions, prefill_lags, recursive_forecast
from hourloom.operators.lags import add_row_lags, add_station_lags
from hourloom.operators.scoring import LinearScorer, combine_stages
from hourloom.operators.stumps import Split, StumpModel
from hourloom.operators.station_average import attach_weighted_average, lag_class_means
from hourloom.operators.training import StagedModel
from hourloom.plans import features, retrieve, runs, samples, serving
from hourloom.plans.samples import DAY_VALUES, DOMAIN, RANGE_FROM, RANGE_TO, STATION_HOURS, USER_HOURS, table
from hourloom.session import scratch_path, store
from hourloom.sources import outputs, registry
from hourloom.sources.merge import write_rows
from hourloom.sources.tables import coords_for
from hourloom.streaming import requests

LIMIT, TWEAK = 50.0, 5.3
START = "2024-01-20 00:00:00"

# ---------------------------------------------------------------- feature assembly


def _station_mean_sql(lo: str, hi: str) -> str:
    means = ", ".join(
        f"round_even(CAST(sum(CAST(CASE WHEN {cond} THEN {p} END AS DECIMAL(18, 4))) AS DOUBLE) / "
        f"count(CASE WHEN {cond} THEN {p} END), 1) AS {p}_{part}"
        for p in POLLUTANTS
        for part, cond in (("traffic", "is_traffic"), ("background", "NOT is_traffic"))
    )
    lagged = ", ".join(
        f"lag({p}_{part}, {k}) OVER (ORDER BY date_time) AS {p}_{part}_la{k}"
        for p in POLLUTANTS for part in ("traffic", "background") for k in STATION_AVERAGE_LAGS
    )
    newest = "(SELECT max(model_id) FROM history WHERE model_id IN (SELECT model_id FROM described WHERE pollutant = '{}'))"
    of_history = ", ".join(f"max(CASE WHEN model_id = {newest.format(p)} THEN value END) AS {p}" for p in POLLUTANTS)
    final = {"no2": 3, "pm10": 1, "pm25": 2}
    of_latest = ", ".join(f"max(CASE WHEN model_id = {final[p]} THEN value END) AS {p}" for p in POLLUTANTS)
    return f"""{DOMAIN["predictions"]}, {DOMAIN["station_types"]}, {DOMAIN["scaling_by_volume"]},
history AS (
  SELECT date_time, station_id, model_id + CASE WHEN event_id % 10 = 0 THEN 10 ELSE 20 END AS model_id, value
  FROM predictions WHERE date_time <= TIMESTAMP '{samples.HISTORY_TO}'),
described AS (
  SELECT CASE r_regionkey WHEN 1 THEN 'pm10' WHEN 2 THEN 'pm25' WHEN 3 THEN 'no2' END AS pollutant, r_regionkey + k AS model_id
  FROM region, (VALUES (0), (10), (20)) v(k)),
wide AS (
  SELECT date_time, station_id, {of_history} FROM history
  WHERE date_time BETWEEN TIMESTAMP '{lo}' AND TIMESTAMP '{hi}' GROUP BY 1, 2
  UNION ALL
  SELECT date_time, station_id, {of_latest} FROM predictions
  WHERE date_time > (SELECT max(date_time) FROM history) AND date_time BETWEEN TIMESTAMP '{lo}' AND TIMESTAMP '{hi}' GROUP BY 1, 2),
typed AS (SELECT wide.*, coalesce(station_type, '') = 'Verkehr' AS is_traffic FROM wide LEFT JOIN station_types USING (station_id)),
means AS (SELECT date_time, {means} FROM typed GROUP BY 1),
lagged_means AS (SELECT *, {lagged} FROM means),
share AS (
  SELECT x, y, scaling_stadtrand AS share FROM traffic_scaling
  LEFT JOIN scaling_by_volume ON kkfz_per_24h = CAST(round_even(traffic_scaling.kfz_per_24h / 1000, 0) AS INTEGER))"""


def _weighted_sql(p: str, suffix: str) -> str:
    t, b = f"abs(share - 1) * {p}_traffic{suffix}", f"abs(share) * {p}_background{suffix}"
    return f"CASE WHEN {t} IS NOT NULL OR {b} IS NOT NULL THEN coalesce({t}, 0) + coalesce({b}, 0) END"


def _average_columns_sql() -> str:
    parts = []
    for p in POLLUTANTS:
        parts += [f"{_weighted_sql(p, s)} AS wavg_{p}{s}" for s in ("", *(f"_la{k}" for k in STATION_AVERAGE_LAGS))]
        band = " + ".join(f"({_weighted_sql(p, f'_la{k}')})" for k in STATION_AVERAGE_BAND)
        parts.append(f"({band}) / {len(STATION_AVERAGE_BAND)} AS wavg_{p}_la1to8")
    return ", ".join(parts)


def weighted_station_avg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted station average, its lags and band at every cell and hour with an event."""
    domain = samples.domain_tables(spark, sf_dir)
    lo, hi = tf.ntz(RANGE_FROM), tf.ntz(RANGE_TO)
    rows = domain["traffic_grid"].select("x", "y", "date_time").distinct()
    means = lag_class_means(features.station_means(domain, lo, hi), POLLUTANTS, STATION_AVERAGE_LAGS)
    return attach_weighted_average(
        rows, domain["traffic_scaling"], domain["scaling_by_volume"], means, POLLUTANTS, STATION_AVERAGE_LAGS,
        STATION_AVERAGE_BAND,
    )


WEIGHTED_STATION_AVG = f"""WITH {DOMAIN["traffic"]}, {DOMAIN["traffic_scaling"]}, {_station_mean_sql(RANGE_FROM, RANGE_TO)}
SELECT date_time, x, y, {_average_columns_sql()}
FROM (SELECT DISTINCT x, y, date_time FROM traffic) LEFT JOIN share USING (x, y) LEFT JOIN lagged_means USING (date_time)"""


def feature_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    domain = samples.domain_tables(spark, sf_dir)
    return features.assemble_features(
        domain, coords_for("stations", domain), tf.ntz(RANGE_FROM), tf.ntz(RANGE_TO), "stations", newest=("event_id",)
    )


def _lag_sql(columns, offsets, keys: str) -> str:
    return ", ".join(
        f"lag({c}, {k}) OVER (PARTITION BY {keys} ORDER BY date_time) AS {c}_la{k}" for c in columns for k in offsets
    )


_PADDED = f"date_time BETWEEN TIMESTAMP '{RANGE_FROM}' - INTERVAL 48 HOUR AND TIMESTAMP '{RANGE_TO}'"
_RANGE = f"date_time BETWEEN TIMESTAMP '{RANGE_FROM}' AND TIMESTAMP '{RANGE_TO}'"


def _assembly_sql(coords: str) -> str:
    """The feature table at the coordinates that a query gives, in the range of the sample tables."""
    other_land_use = ", ".join(f"CAST(k.c_custkey % {n} AS DOUBLE) AS {name}" for n, name in samples.OTHER_LAND_USE)
    return f"""WITH {DOMAIN["traffic"]}, {DOMAIN["traffic_scaling"]}, {DOMAIN["weather"]}, {DOMAIN["cams"]},
{_station_mean_sql(RANGE_FROM, RANGE_TO)},
users AS (SELECT DISTINCT user_id, CAST(user_id % 16 AS INTEGER) AS x, CAST(user_id // 16 AS INTEGER) AS y FROM events),
coords AS ({coords}),
newest AS (
  SELECT model_id, date_time, x, y, value FROM (
    SELECT *, row_number() OVER (PARTITION BY model_id, date_time, x, y ORDER BY event_id DESC) AS n FROM traffic
    WHERE {_PADDED}) JOIN coords USING (x, y) WHERE n = 1),
scaled AS (
  SELECT v.x, v.y, v.date_time, scaling * v.value AS kfz_per_hour, s.value AS velocity
  FROM (SELECT * FROM newest WHERE model_id = 1) v JOIN traffic_scaling USING (x, y)
  LEFT JOIN (SELECT * FROM newest WHERE model_id = 2) s ON s.x = v.x AND s.y = v.y AND s.date_time = v.date_time),
lagged_traffic AS (SELECT *, {_lag_sql(["kfz_per_hour"], TRAFFIC_LAGS, "x, y")} FROM scaled),
spliced AS (
  SELECT * FROM weather WHERE date_time >= TIMESTAMP '{samples.FORECAST_FROM}' UNION ALL
  SELECT * FROM weather WHERE date_time < (SELECT min(date_time) FROM weather WHERE date_time >= TIMESTAMP '{samples.FORECAST_FROM}')),
mapped_weather AS (
  SELECT x, y, spliced.* EXCLUDE (dwd_x) FROM spliced JOIN users ON user_id % 4 = dwd_x WHERE {_PADDED}),
lagged_weather AS (SELECT *, {_lag_sql(features.LAGGED_WEATHER, WEATHER_LAGS, "x, y")} FROM mapped_weather),
mapped_cams AS (SELECT x, y, cams.* EXCLUDE (lat_int) FROM cams JOIN users ON user_id % 5 = lat_int WHERE {_PADDED}),
lagged_cams AS (SELECT *, {_lag_sql([f"cams_{p}" for p in POLLUTANTS], CAMS_LAGS, "x, y")} FROM mapped_cams),
measured AS (
  SELECT date_trunc('hour', ts) AS date_time, user_id, max(value) AS pm10, min(value) AS pm25,
         CAST(sum(CAST(value AS DECIMAL(18, 2))) AS DOUBLE) / count(value) AS no2 FROM events GROUP BY 1, 2),
times AS (SELECT DISTINCT date_trunc('hour', ts) AS date_time FROM events),
joined AS (
  SELECT t.*, w.* EXCLUDE (x, y, date_time), c.* EXCLUDE (x, y, date_time), u.user_id
  FROM lagged_traffic t JOIN lagged_weather w ON w.x = t.x AND w.y = t.y AND w.date_time = t.date_time
  JOIN lagged_cams c ON c.x = t.x AND c.y = t.y AND c.date_time = t.date_time JOIN users u ON u.x = t.x AND u.y = t.y)
SELECT j.* EXCLUDE (user_id), CAST(j.user_id AS VARCHAR) AS station_id, m.pm10, m.pm25, m.no2,
  CAST(dayofyear(times.date_time) AS DOUBLE) / 366 AS doy_scaled, isodow(times.date_time) AS weekday, year(times.date_time) AS year,
  hour(times.date_time) AS hour, CASE WHEN isodow(times.date_time) >= 6 THEN 'weekend' ELSE 'none' END AS type_school_holiday,
  dayofyear(times.date_time) = 1 AS is_public_holiday, k.c_acctbal AS building_density,
  CAST(k.c_nationkey AS DOUBLE) AS traffic_intensity_kfz, {other_land_use}, {_average_columns_sql()}
FROM joined j LEFT JOIN times USING (date_time) LEFT JOIN customer k ON k.c_custkey = j.user_id
LEFT JOIN measured m ON m.user_id = j.user_id AND m.date_time = j.date_time
LEFT JOIN share ON share.x = j.x AND share.y = j.y LEFT JOIN lagged_means lm ON lm.date_time = j.date_time
WHERE j.{_RANGE}"""


FEATURE_ASSEMBLY = _assembly_sql("SELECT x, y FROM users JOIN customer ON c_custkey = user_id WHERE c_mktsegment <> 'MACHINERY'")


def _retrieved(spark: SparkSession, sf_dir: str, mode: str, **how) -> retrieve.Retrieved:
    """With the end of the range as the present time and no data after it."""
    domain = samples.domain_tables(spark, sf_dir)
    return retrieve.retrieve(domain, mode, ("event_id",), tf.ntz(RANGE_TO), tf.ntz(RANGE_FROM), include_future=False, **how)


def retrieve_stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stations in use and those that are not, as for training."""
    return _retrieved(spark, sf_dir, "stations", only_active=False).rows


def retrieve_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _retrieved(spark, sf_dir, "grid", batch=1).rows


def retrieve_grid_sim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _retrieved(spark, sf_dir, "grid_sim", batch=0).rows


def retrieve_samplers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _retrieved(spark, sf_dir, "passive_samplers").rows


def retrieval_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _retrieved(spark, sf_dir, "grid", batch=1).report()


def retrieve_grid_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All cells: no batch is named."""
    return _retrieved(spark, sf_dir, "grid").rows


def retrieve_grid_sim_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _retrieved(spark, sf_dir, "grid_sim").rows


def retrieval_report_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _retrieved(spark, sf_dir, "grid").report()


_CELLS = "SELECT CAST(c_custkey % 16 AS INTEGER) AS x, CAST(c_custkey // 16 AS INTEGER) AS y FROM customer"
RETRIEVE_STATIONS = _assembly_sql("SELECT x, y FROM users JOIN customer ON c_custkey = user_id")
RETRIEVE_GRID = _assembly_sql(f"{_CELLS} WHERE c_custkey // 50 = 1")
RETRIEVE_GRID_SIM = _assembly_sql(f"{_CELLS} WHERE c_custkey // 100 = 0")
RETRIEVE_ALL_CELLS = _assembly_sql(_CELLS)
RETRIEVE_SAMPLERS = _assembly_sql(f"{_CELLS} WHERE c_acctbal < 0")
RETRIEVAL_REPORT = f"""WITH rows_of_batch AS ({RETRIEVE_GRID}), c AS (
  SELECT (SELECT count(*) FROM customer WHERE c_custkey // 50 = 1) AS n_coords, (SELECT count(*) FROM rows_of_batch) AS n_rows,
    (SELECT count(*) FROM rows_of_batch) - (SELECT count(*) FROM (SELECT DISTINCT * FROM rows_of_batch)) AS n_repeated,
    date_diff('hour', TIMESTAMP '{RANGE_FROM}', TIMESTAMP '{RANGE_TO}') + 1 AS n_hours)
SELECT n_coords, n_rows, n_coords * n_hours AS expected_rows, n_coords * n_hours = n_rows AS complete, n_repeated FROM c"""
RETRIEVAL_REPORT_ALL = f"""WITH rows_of_all AS ({RETRIEVE_ALL_CELLS}), c AS (
  SELECT (SELECT count(*) FROM customer) AS n_coords, (SELECT count(*) FROM rows_of_all) AS n_rows,
    (SELECT count(*) FROM rows_of_all) - (SELECT count(*) FROM (SELECT DISTINCT * FROM rows_of_all)) AS n_repeated,
    date_diff('hour', TIMESTAMP '{RANGE_FROM}', TIMESTAMP '{RANGE_TO}') + 1 AS n_hours)
SELECT n_coords, n_rows, n_coords * n_hours AS expected_rows, n_coords * n_hours = n_rows AS complete, n_repeated FROM c"""

# ---------------------------------------------------------------- folds


def rolling_origin_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.rolling_test_rows(
        samples.station_hours(spark, sf_dir), "date_time", 10, 96, 24, include_current=True, prediction_hour=5,
        last=samples.last_hour(spark, sf_dir),
    )


def _last_sql(window: int | None = None, hour: int = 5) -> str:
    newest = "(SELECT date_trunc('hour', max(ts)) FROM events)"
    if window is None:
        return newest
    first = f"hour(timezone('Europe/Berlin', timezone('UTC', {newest} - INTERVAL {window} HOUR)))"
    return f"({newest} - to_hours(CAST(({first} - {hour} + 24) % 24 AS INTEGER)))"


def _folds_sql(n: int, test: int, step: int, last: str) -> str:
    return (
        f"folds AS (SELECT CAST(i AS INTEGER) AS fold_id, {last} - to_hours(CAST((i - 1) * {step} + {test} AS INTEGER)) AS fold_cut, "
        f"{last} - to_hours(CAST((i - 1) * {step} AS INTEGER)) AS fold_end FROM generate_series(1, {n}) s(i))"
    )


ROLLING_ORIGIN_FOLDS = f"""WITH {STATION_HOURS}, {_folds_sql(10, 96, 24, _last_sql(96))}
SELECT h.*, folds.* FROM station_hours h JOIN folds ON date_time > fold_cut - INTERVAL 1 HOUR AND date_time <= fold_end"""


def fold_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.fold_sizes(
        samples.user_hours(spark, sf_dir), "date_time", 12, 48, 24, train_years=240 / folds.HOURS_PER_YEAR,
        last=samples.last_hour(spark, sf_dir),
    )


FOLD_SIZES = f"""WITH {USER_HOURS}, {_folds_sql(12, 48, 24, _last_sql())}
SELECT folds.*, (SELECT count(*) FROM user_hours WHERE date_time > fold_cut - INTERVAL 240 HOUR AND date_time <= fold_cut) AS n_train,
  (SELECT count(*) FROM user_hours WHERE date_time > fold_cut AND date_time <= fold_end) AS n_test FROM folds"""


def train_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training rows of the third fold: ten days up to its cut."""
    cut = folds.fold_cut(samples.last_hour(spark, sf_dir), F.lit(3), 48, 24)
    return folds.train_rows(samples.user_hours(spark, sf_dir), "date_time", cut, 240 / folds.HOURS_PER_YEAR)


TRAIN_WINDOW = f"""WITH {USER_HOURS}, {_folds_sql(3, 48, 24, _last_sql())}
SELECT user_hours.* FROM user_hours JOIN folds ON fold_id = 3 AND date_time > fold_cut - INTERVAL 240 HOUR AND date_time <= fold_cut"""


def fold_step_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = folds.rolling_test_rows(
        samples.user_hours(spark, sf_dir), "date_time", 5, 48, 24, last=samples.last_hour(spark, sf_dir)
    )
    return folds.add_step(rows, "date_time").select("fold_id", "user_id", "date_time", "step")


FOLD_STEP_INDEX = f"""WITH {USER_HOURS}, {_folds_sql(5, 48, 24, _last_sql())}
SELECT fold_id, user_id, date_time, dense_rank() OVER (PARTITION BY fold_id ORDER BY date_time) - 1 AS step
FROM user_hours JOIN folds ON date_time > fold_cut AND date_time <= fold_end"""


def retrain_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = folds.rolling_test_rows(
        samples.user_hours(spark, sf_dir), "date_time", 10, 48, 24, last=samples.last_hour(spark, sf_dir)
    )
    sizes = rows.groupBy("fold_id").agg(F.count(F.lit(1)).alias("n_test"))
    return folds.add_retrain_group(sizes, 10, 3)


RETRAIN_GROUPS = f"""WITH {USER_HOURS}, {_folds_sql(10, 48, 24, _last_sql())}
SELECT fold_id, count(*) AS n_test, CAST((10 - fold_id) // 3 AS INTEGER) AS train_group,
  CAST(10 - ((10 - fold_id) // 3) * 3 AS INTEGER) AS train_fold_id
FROM user_hours JOIN folds ON date_time > fold_cut AND date_time <= fold_end GROUP BY fold_id"""


def holdout_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.add_holdout_role(table(spark, sf_dir, "events").select("event_id", "ts"), "ts", 48)


HOLDOUT_SPLIT = """SELECT event_id, ts, CASE WHEN ts < (SELECT max(ts) FROM events) - INTERVAL 48 HOUR THEN 'train' ELSE 'validation' END AS role
FROM events"""


def leave_one_out_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.leave_one_out_sizes(table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("station_id")))


LEAVE_ONE_OUT_FOLDS = """SELECT l_suppkey AS station_id, count(*) AS n_test, (SELECT count(*) FROM lineitem) - count(*) AS n_train
FROM lineitem GROUP BY 1"""

# ---------------------------------------------------------------- metrics and limits


def _persistence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prediction of an hour: the value 24 rows earlier."""
    lagged = add_row_lags(samples.station_hours(spark, sf_dir), ["station_id"], ["date_time"], {"y": (24,)})
    return lagged.withColumnRenamed("y_la24", "pred")


PERSISTENCE = f"""{STATION_HOURS},
persistence AS (SELECT *, lag(y, 24) OVER (PARTITION BY station_id ORDER BY date_time) AS pred FROM station_hours)"""
METRICS = """count(*) AS n, round(sqrt(avg((y - pred) * (y - pred))), 6) AS rmse, round(avg(abs(y - pred)), 6) AS mae,
  round(1 - sum((y - pred) * (y - pred)) / nullif(var_pop(y) * count(*), 0), 6) AS r_squared"""


def _rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in names})


def regression_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = evaluation.metrics_per_time_and_all(_persistence(spark, sf_dir), "y", "pred")
    return _rounded(made, "rmse", "mae", "r_squared")


REGRESSION_METRICS = f"""WITH {PERSISTENCE}, pairs AS (SELECT * FROM persistence WHERE pred IS NOT NULL)
SELECT 'all' AS time_point, {METRICS} FROM pairs
UNION ALL SELECT strftime(date_time, '%Y-%m-%d %H:%M:%S'), {METRICS} FROM pairs GROUP BY date_time"""


def station_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = runs.station_metrics(_persistence(spark, sf_dir), "y")
    return _rounded(made, "rmse", "mae", "r_squared")


STATION_METRICS = f"WITH {PERSISTENCE} SELECT station_id, {METRICS} FROM persistence WHERE pred IS NOT NULL GROUP BY 1"


def daily_local_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").withColumnRenamed("user_id", "station_id")
    return _rounded(evaluation.daily_local_means(rows, ["value"], time="ts"), "value", digits=10)


DAILY_LOCAL_MEAN = """SELECT user_id AS station_id,
  CAST(timezone('Europe/Berlin', timezone('UTC', ts)) - INTERVAL 1 MICROSECOND AS DATE) AS day, round(avg(value), 10) AS value
FROM events GROUP BY 1, 2"""


def limit_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.limit_confusion(samples.day_values(spark, sf_dir), "obs", "pred", LIMIT, TWEAK, ["station_id"])


RATES = """tp_rate, fn_rate, fp_rate, tn_rate,
  coalesce(2 * tp_rate / nullif(2 * tp_rate + (fp_rate + fn_rate), 0), 0) AS f1_above,
  coalesce(2 * tn_rate / nullif(2 * tn_rate + (fp_rate + fn_rate), 0), 0) AS f1_below"""


def _confusion_sql(source: str, group: str, tweak: str) -> str:
    said = f"pred + {tweak} > {LIMIT}::DOUBLE"
    return f"""counts AS (
  SELECT {group}, count(*) FILTER (WHERE obs > {LIMIT} AND {said}) AS tp, count(*) FILTER (WHERE obs > {LIMIT} AND NOT {said}) AS fn,
         count(*) FILTER (WHERE NOT obs > {LIMIT} AND {said}) AS fp, count(*) FILTER (WHERE NOT obs > {LIMIT} AND NOT {said}) AS tn
  FROM {source} WHERE obs IS NOT NULL GROUP BY ALL),
rated AS (
  SELECT *, coalesce(CAST(tp AS DOUBLE) / nullif(tp + fn, 0), 0) AS tp_rate, coalesce(CAST(fn AS DOUBLE) / nullif(tp + fn, 0), 0) AS fn_rate,
         coalesce(CAST(fp AS DOUBLE) / nullif(fp + tn, 0), 0) AS fp_rate, coalesce(CAST(tn AS DOUBLE) / nullif(fp + tn, 0), 0) AS tn_rate
  FROM counts)"""


LIMIT_CONFUSION = f"""WITH {DAY_VALUES}, {_confusion_sql("day_values", "station_id", f"{TWEAK}::DOUBLE")}
SELECT station_id, tp, fn, fp, tn, {RATES} FROM rated"""


def tweak_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.tweak_curve(samples.day_values(spark, sf_dir), "obs", "pred", LIMIT, -20, 20, 0.5)


TWEAK_CURVE = f"""WITH {DAY_VALUES},
grid AS (SELECT -20::DOUBLE + i * 0.5::DOUBLE AS tweak FROM generate_series(0, 81) s(i)),
{_confusion_sql("day_values, grid", "tweak", "tweak")}
SELECT tweak, tp, fn, fp, tn, {RATES} FROM rated"""


def find_tweak_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.find_tweak_value(samples.day_values(spark, sf_dir), "obs", "pred", LIMIT, -20, 20, 1.0)


FIND_TWEAK_VALUE = f"""WITH {DAY_VALUES},
grid AS (SELECT -20::DOUBLE + i * 1.0::DOUBLE AS tweak FROM generate_series(0, 40) s(i)),
{_confusion_sql("day_values, grid", "tweak", "tweak")}
SELECT coalesce(min(tweak) FILTER (WHERE fn_rate <= fp_rate), max(tweak)) AS tweak FROM rated"""


def transgression_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.transgression_days(samples.day_values(spark, sf_dir), "obs", "pred", LIMIT, TWEAK)


TRANSGRESSION_DAYS = f"""WITH {DAY_VALUES}, labelled AS (
  SELECT station_id, day, obs, pred + {TWEAK}::DOUBLE AS tweaked,
    CASE WHEN obs > {LIMIT} AND pred + {TWEAK}::DOUBLE > {LIMIT} THEN 'True Positive'
         WHEN pred + {TWEAK}::DOUBLE > {LIMIT} THEN 'False Positive' WHEN obs > {LIMIT} THEN 'False Negative' END AS label
  FROM day_values)
SELECT station_id, day, label, printf('%.2f', round_even(obs, 2)) AS observation, printf('%.2f', round_even(tweaked, 2)) AS prediction
FROM labelled WHERE label IS NOT NULL AND obs IS NOT NULL"""


def transgressions_per_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order values as observations; the prediction knows the value before a discount that depends on the priority."""
    rows = table(spark, sf_dir, "orders").select(
        F.col("o_orderdate").alias("day"), F.when(F.col("o_custkey") % 9 != 0, F.col("o_totalprice") / 1000).alias("obs"),
        (F.col("o_totalprice") / F.when(F.col("o_orderpriority") == "5-LOW", 900).otherwise(1100)).alias("pred"),
    )
    return evaluation.transgressions_per_month(rows, "obs", "pred", 250.0, 20.0)


TRANSGRESSIONS_PER_MONTH = """WITH r AS (
  SELECT o_orderdate AS day, CASE WHEN o_custkey % 9 <> 0 THEN o_totalprice / 1000 END AS obs, o_totalprice / CASE WHEN o_orderpriority = '5-LOW' THEN 900 ELSE 1100 END AS pred
  FROM orders)
SELECT CAST(month(day) AS INTEGER) AS month, count(*) FILTER (WHERE obs > 250) AS n_observed,
  count(*) FILTER (WHERE pred > 250) AS n_predicted, count(*) FILTER (WHERE pred + 20 > 250) AS n_predicted_tweaked FROM r
WHERE obs IS NOT NULL GROUP BY 1"""


def fold_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = folds.rolling_test_rows(
        _persistence(spark, sf_dir), "date_time", 8, 48, 24, last=samples.last_hour(spark, sf_dir)
    )
    scored = evaluation.regression_metrics(rows, "y", "pred", ["station_id", "fold_id"])
    scored = scored.withColumn("best_iteration", F.col("n"))
    return _rounded(evaluation.fold_scores(scored, ["station_id"]), "avg_rmse")


FOLD_SCORES = f"""WITH {PERSISTENCE}, {_folds_sql(8, 48, 24, _last_sql())},
scored AS (
  SELECT station_id, fold_id, count(*) AS n, sqrt(avg((y - pred) * (y - pred))) AS rmse
  FROM persistence JOIN folds ON date_time > fold_cut AND date_time <= fold_end WHERE pred IS NOT NULL GROUP BY 1, 2)
SELECT station_id, round(avg(rmse), 6) AS avg_rmse, CAST(floor(quantile_cont(n, 0.75)) AS INTEGER) AS best_iteration FROM scored GROUP BY 1"""

# ---------------------------------------------------------------- scenarios

TRAFFIC_SCORER = LinearScorer({"kfz_per_hour": 0.3}, 10.0)


def _traffic_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples.user_hours(spark, sf_dir).withColumnsRenamed({"user_id": "station_id", "y": "kfz_per_hour"})


def _scenario_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scenarios.traffic_scenarios(_traffic_rows(spark, sf_dir))


def _scenario_sql(step: int) -> str:
    return f"""{USER_HOURS}, scenario_rows AS (
  SELECT user_id AS station_id, date_time, CAST(p * {step} AS INTEGER) AS kfz_pct,
    hour(timezone('Europe/Berlin', timezone('UTC', date_time))) BETWEEN 5 AND 21 AS daytime,
    CASE WHEN hour(timezone('Europe/Berlin', timezone('UTC', date_time))) BETWEEN 5 AND 21
         THEN y * CAST(p * {step} AS INTEGER) / 100 ELSE y END AS kfz_per_hour
  FROM user_hours, generate_series(0, {100 // step}) s(p)),
scored AS (SELECT *, 10.0::DOUBLE + 0.3::DOUBLE * coalesce(kfz_per_hour, 0) AS pred FROM scenario_rows)"""


SCENARIO_ROWS = _scenario_sql(10)
EVERY_PERCENTAGE = _scenario_sql(1)


def _scored(rows: DataFrame) -> DataFrame:
    return rows.withColumn("pred", TRAFFIC_SCORER.column())


def traffic_scenarios(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scenario_rows(spark, sf_dir)


TRAFFIC_SCENARIOS = f"WITH {SCENARIO_ROWS} SELECT station_id, date_time, kfz_pct, kfz_per_hour FROM scenario_rows"


def scenario_daily_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _scored(_scenario_rows(spark, sf_dir)).withColumn("day", F.to_date("date_time"))
    made = scenarios.daily_scenario_means(rows, ["station_id", "day"])
    return _rounded(made, *[c for c in made.columns if c.startswith("pct")], digits=10)


SCENARIO_DAILY_PIVOT = f"""WITH {SCENARIO_ROWS}
SELECT station_id, CAST(date_time AS DATE) AS day,
  {", ".join(f"round(avg(CASE WHEN kfz_pct = {p} THEN pred END), 10) AS pct_kfz_{p}" for p in scenarios.PERCENTAGES)}
FROM scored GROUP BY 1, 2"""


def thresholds_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored form of the daily means."""
    rows = _scored(_scenario_rows(spark, sf_dir)).withColumn("date", F.to_date("date_time"))
    daily = scenarios.daily_scenario_means(rows, ["station_id", "date"])
    made = outputs.threshold_output(daily, F.lit(7), tf.ntz(START), LIMIT, TWEAK)
    return _rounded(made, *[c for c in made.columns if c.startswith("pct")], digits=10)


THRESHOLDS_OUTPUT = f"""WITH {SCENARIO_ROWS}
SELECT station_id, 7 AS model_id, CAST(date_time AS DATE) AS date, CAST(epoch(TIMESTAMP '{START}') AS BIGINT) AS date_time_forecast,
  {LIMIT}::DOUBLE AS pollutant_limit, {TWEAK}::DOUBLE AS tweak_value,
  {", ".join(f"round(avg(CASE WHEN kfz_pct = {p} THEN pred END), 10) AS pct_kfz_{p}" for p in scenarios.PERCENTAGES)}
FROM scored GROUP BY ALL"""


def complete_days_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two busy stations, sales and all other events; days count from a fixed start."""
    sales = F.col("event_type").isin("purchase", "signup")
    rows = table(spark, sf_dir, "events").select(
        F.when(sales, "sales").otherwise("other").alias("station_id"), tf.floor_hour(F.col("ts")).alias("date_time")
    ).distinct()
    numbered = rows.withColumn("day", scenarios.day_number(F.col("date_time"), tf.ntz(RANGE_FROM)))
    return scenarios.complete_days_prefix(numbered)


COMPLETE_DAYS_PREFIX = f"""WITH r AS (
  SELECT DISTINCT CASE WHEN event_type IN ('purchase', 'signup') THEN 'sales' ELSE 'other' END AS station_id,
         date_trunc('hour', ts) AS date_time FROM events),
d AS (SELECT station_id, CAST(ceil(epoch(date_time - TIMESTAMP '{RANGE_FROM}') / 86400) - 1 AS INTEGER) AS day, count(*) AS n
      FROM r WHERE date_time > TIMESTAMP '{RANGE_FROM}' GROUP BY 1, 2)
SELECT station_id, day FROM d WHERE n = 24 AND day < coalesce((
  SELECT min(g) FROM generate_series(0, 40) s(g) WHERE g NOT IN (SELECT day FROM d e WHERE e.station_id = d.station_id AND e.n = 24)), 1000)"""


def _scenario_means(rows: DataFrame, percentages=scenarios.EVERY_PERCENTAGE) -> DataFrame:
    """Daily means of the percentages, rounded so that a mean right at the limit does not hang on the order of a sum."""
    dated = rows.withColumn("day", F.to_date("date_time"))
    return scenarios.scenario_means(dated, ["station_id", "day"], TRAFFIC_SCORER.column, percentages).withColumn("mean", F.round("mean", 10))


def max_admissible_pct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scenarios.max_admissible_percentage(_scenario_means(_traffic_rows(spark, sf_dir)), ["station_id", "day"], 28.0, 2.7)


MAX_ADMISSIBLE_PCT = f"""WITH {EVERY_PERCENTAGE},
means AS (SELECT station_id, CAST(date_time AS DATE) AS day, kfz_pct, round(avg(pred), 10) + 2.7::DOUBLE AS level FROM scored GROUP BY 1, 2, 3)
SELECT station_id, day, CASE WHEN max(level) FILTER (WHERE kfz_pct = 0) > 28 THEN 'not possible'
  ELSE CAST(coalesce(max(kfz_pct) FILTER (WHERE level < 28), 0) AS VARCHAR) END AS max_percentage FROM means GROUP BY 1, 2"""


def transgression_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alarm days with the highest percentage of traffic, to 1 %, that keeps them below the limit."""
    days = evaluation.transgression_days(samples.day_values(spark, sf_dir), "obs", "pred", LIMIT, TWEAK)
    alarms = scenarios.alarm_days(days.select("station_id", "day", "label"))
    # Only the hours of alarm days are multiplied by the percentages.
    hours_of_alarms = _traffic_rows(spark, sf_dir).withColumn("day", F.to_date("date_time")).join(alarms, ["station_id", "day"], "left_semi")
    return scenarios.with_suggestions(alarms, _scenario_means(hours_of_alarms), 28.0, 2.7)


TRANSGRESSION_SUGGESTIONS = f"""WITH {EVERY_PERCENTAGE}, {DAY_VALUES},
means AS (SELECT station_id, CAST(date_time AS DATE) AS day, kfz_pct, round(avg(pred), 10) + 2.7::DOUBLE AS level FROM scored GROUP BY 1, 2, 3),
best AS (
  SELECT station_id, day, CASE WHEN max(level) FILTER (WHERE kfz_pct = 0) > 28 THEN 'not possible'
    ELSE CAST(coalesce(max(kfz_pct) FILTER (WHERE level < 28), 0) AS VARCHAR) END AS max_percentage FROM means GROUP BY 1, 2)
SELECT station_id, day, CASE WHEN obs > {LIMIT} THEN 'True Positive' ELSE 'False Positive' END AS label, max_percentage
FROM day_values LEFT JOIN best USING (station_id, day) WHERE obs IS NOT NULL AND pred + {TWEAK}::DOUBLE > {LIMIT}"""


def scenario_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Start and end of a two-day run for the local day 20 days after a user's first event, given the user's last event."""
    seen = table(spark, sf_dir, "events").groupBy("user_id").agg(F.min("ts").alias("first"), F.max("ts").alias("last"))
    asked = F.to_date(F.col("first") + tf.days(20)).cast("timestamp_ntz")
    start, end = scenarios.scenario_range(asked, 2, tf.floor_hour(F.col("last")))
    return seen.select("user_id", start.alias("start"), end.alias("end"))


SCENARIO_RANGE = """WITH u AS (
  SELECT user_id, timezone('UTC', timezone('Europe/Berlin', date_trunc('day', min(ts) + INTERVAL 20 DAY)::TIMESTAMP)) AS asked,
         date_trunc('hour', max(ts)) AS latest FROM events GROUP BY 1)
SELECT user_id, CASE WHEN asked - INTERVAL 1 HOUR > latest THEN latest + INTERVAL 1 HOUR ELSE asked END AS start,
  asked + INTERVAL 48 HOUR AS "end" FROM u"""


def monotonicity_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scenarios.monotonicity_violations(_scenario_means(_traffic_rows(spark, sf_dir), scenarios.PERCENTAGES), ["station_id", "day"])


MONOTONICITY_VIOLATIONS = f"""WITH {SCENARIO_ROWS},
means AS (SELECT station_id, CAST(date_time AS DATE) AS day, kfz_pct, round(avg(pred), 10) AS mean FROM scored GROUP BY 1, 2, 3),
steps AS (SELECT *, lag(mean) OVER (PARTITION BY station_id, day ORDER BY kfz_pct) AS before FROM means)
SELECT station_id, day, count(*) FILTER (WHERE mean < before) AS n_violations FROM steps GROUP BY 1, 2"""


UNEVEN = StumpModel(10.0, tuple(Split("kfz_per_hour", cut, 0.0, right) for cut, right in ((5.0, 12.0), (20.0, -7.0), (35.0, 9.0), (60.0, -3.0))), ("kfz_per_hour",))


def monotone_scenarios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions of a model that falls in places, made to grow with traffic."""
    rows = UNEVEN.transform(_scenario_rows(spark, sf_dir), "pred")
    return _rounded(scenarios.monotone_scenarios(rows, ["station_id", "date_time"]), "pred")


_UNEVEN_SQL = "10.0::DOUBLE + " + " + ".join(f"CASE WHEN kfz_per_hour <= {s.cut}::DOUBLE THEN 0 ELSE {s.right}::DOUBLE END" for s in UNEVEN.splits)
MONOTONE_SCENARIOS = f"""WITH {SCENARIO_ROWS},
uneven AS (SELECT station_id, date_time, kfz_pct, {_UNEVEN_SQL} AS v FROM scenario_rows),
runs AS (
  SELECT a.station_id, a.date_time, a.kfz_pct AS j, b.kfz_pct AS k, avg(b.v) OVER (PARTITION BY a.station_id, a.date_time, a.kfz_pct ORDER BY b.kfz_pct) AS m
  FROM uneven a JOIN uneven b ON a.station_id = b.station_id AND a.date_time = b.date_time AND a.kfz_pct <= b.kfz_pct),
least AS (
  SELECT u.station_id, u.date_time, u.kfz_pct, j, min(m) AS m FROM uneven u
  JOIN runs r ON r.station_id = u.station_id AND r.date_time = u.date_time AND j <= u.kfz_pct AND k >= u.kfz_pct GROUP BY ALL)
SELECT station_id, date_time, kfz_pct, round(max(m), 6) AS pred FROM least GROUP BY ALL"""


def scenario_contribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = scenarios.scenario_contribution(
        _scored(_scenario_rows(spark, sf_dir)), ["station_id", "date_time"], ["station_id"]
    )
    return _rounded(made, "contribution")


SCENARIO_CONTRIBUTION = f"""WITH {SCENARIO_ROWS},
pairs AS (SELECT station_id, date_time, max(CASE WHEN kfz_pct = 0 THEN pred END) AS a, max(CASE WHEN kfz_pct = 100 THEN pred END) AS b
          FROM scored WHERE daytime GROUP BY 1, 2)
SELECT station_id, round(100 * (1 - avg(a / b)), 6) AS contribution, count(*) AS n_hours FROM pairs GROUP BY 1"""


def grid_sim_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every cell, hour and percentage in the stored form, values with one decimal."""
    domain = samples.domain_tables(spark, sf_dir)
    cells = domain["traffic_grid"].groupBy("x", "y", "date_time").agg(F.max("value").alias("kfz_per_hour"))
    made = runs.grid_predictions(cells, _scored, "grid_sim")
    return outputs.grid_output(made, F.lit(7), tf.ntz(START), "grid_sim")


GRID_SIM_OUTPUT = f"""WITH {DOMAIN["traffic"]},
cells AS (SELECT x, y, date_time, max(value) AS v FROM traffic GROUP BY ALL),
scaled AS (
  SELECT x, y, date_time, CAST(p * 10 AS INTEGER) AS kfz_pct,
    CASE WHEN hour(timezone('Europe/Berlin', timezone('UTC', date_time))) BETWEEN 5 AND 21
         THEN v * CAST(p * 10 AS INTEGER) / 100 ELSE v END AS kfz FROM cells, generate_series(0, 10) s(p))
SELECT 7 AS model_id, CAST(epoch(TIMESTAMP '{START}') AS BIGINT) AS date_time_forecast, CAST(epoch(date_time) AS BIGINT) AS date_time,
  x, y, kfz_pct, CAST(round_even(10.0::DOUBLE + 0.3::DOUBLE * kfz, 1) AS DECIMAL(10, 1)) AS value FROM scaled"""


def batch_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of one place each: purchases, sales, all other events, everything."""
    kinds = F.array(
        F.when(F.col("event_type") == "purchase", 1), F.when(F.col("event_type").isin("purchase", "signup"), 2),
        F.when(~F.col("event_type").isin("purchase", "signup"), 3), F.lit(4),
    )
    rows = table(spark, sf_dir, "events").select(
        F.explode(F.array_compact(kinds)).alias("batch"), tf.floor_hour(F.col("ts")).alias("date_time")
    ).distinct()
    lo, hi = tf.ntz(RANGE_FROM), tf.ntz(RANGE_TO)
    batches = rows.select("batch", F.lit(0).alias("x"), F.lit(0).alias("y")).distinct()
    placed = rows.withColumns({"x": F.lit(0), "y": F.lit(0)})
    return runs.batch_report(placed.where(F.col("date_time").between(lo, hi)), batches, lo, hi)


BATCH_REPORT = f"""WITH r AS (
  SELECT DISTINCT unnest(list_filter([CASE WHEN event_type = 'purchase' THEN 1 END, CASE WHEN event_type IN ('purchase', 'signup') THEN 2 END,
    CASE WHEN event_type NOT IN ('purchase', 'signup') THEN 3 END, 4], lambda b: b IS NOT NULL)) AS batch, date_trunc('hour', ts) AS date_time
  FROM events)
SELECT batch, count(*) FILTER (WHERE {_RANGE}) = date_diff('hour', TIMESTAMP '{RANGE_FROM}', TIMESTAMP '{RANGE_TO}') + 1 AS finished
FROM r GROUP BY 1"""

# ---------------------------------------------------------------- forecasts

SCORER = LinearScorer({"y_lag1": 0.5, "y_lag24": 0.2, "lag_avg": 0.1}, 5.0)


def _lagged_stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return add_station_lags(samples.station_hours(spark, sf_dir), "y", [1, 24], [1, 2], average_name="lag_avg")


def _user_stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user as a station: as many series as there are users."""
    return samples.user_hours(spark, sf_dir).withColumnRenamed("user_id", "station_id")


USER_STATIONS = f"""{USER_HOURS},
station_hours AS (SELECT user_id AS station_id, date_time, y FROM user_hours)"""


def recursive_forecast_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """recursive_forecast over every user."""
    lagged = add_station_lags(_user_stations(spark, sf_dir), "y", [1, 24], [1, 2], average_name="lag_avg")
    tests = folds.rolling_test_rows(lagged, "date_time", 4, 48, 24, last=samples.last_hour(spark, sf_dir))
    return recursive_forecast(
        folds.add_step(tests, "date_time"), "y", [1, 24], [1, 2], SCORER, keep=["y"], average_name="lag_avg"
    )


def prefill_forecast_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """prefill_forecast over every user."""
    return prefill_lags(_user_stations(spark, sf_dir), "y", [1, 24], [1, 2], tf.ntz(START), SCORER, average_name="lag_avg")


def station_forecast_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """station_forecast over every user."""
    made = runs.station_forecast(
        _user_stations(spark, sf_dir), "y", [1, 24], [1, 2], SCORER, tf.ntz(START), {"y": 150.0}, average_name="lag_avg"
    )
    return outputs.station_output(made, F.lit(7), tf.ntz(START))


def recursive_forecast_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four overlapping folds of 48 hours, forecast hour by hour with a linear scorer."""
    tests = folds.rolling_test_rows(
        _lagged_stations(spark, sf_dir), "date_time", 4, 48, 24, last=samples.last_hour(spark, sf_dir)
    )
    made = recursive_forecast(
        folds.add_step(tests, "date_time"), "y", [1, 24], [1, 2], SCORER, keep=["y"], average_name="lag_avg"
    )
    return made


def _mean_of_two(a: str, b: str) -> str:
    known = f"CASE WHEN {a} IS NULL THEN 0 ELSE 1 END + CASE WHEN {b} IS NULL THEN 0 ELSE 1 END"
    return f"(coalesce({a}, 0) + coalesce({b}, 0)) / nullif({known}, 0)"


def _walk_sql(rows: str, keys: str, lags: tuple[int, ...], pred: str, extra: str = "NULL", name: str = "walk") -> str:
    """Recursion over hours: each series carries the list of its predictions.

    `rows` has the keys, h (1, 2, .. hours of the series), step, the observed lags l<k>. `pred` reads the used lags u<k>
    and `extra` as x.
    """
    same = " AND ".join(f"d.{k} = k.{k}" for k in keys.split(", "))
    used = ", ".join(f"CASE WHEN d.step >= {k} THEN k.preds[k.h - {k - 1}] ELSE d.l{k} END AS u{k}" for k in lags)
    return f"""{name} AS (
  SELECT DISTINCT {keys}, CAST(0 AS BIGINT) AS h, CAST([] AS DOUBLE[]) AS preds FROM {rows}
  UNION ALL
  SELECT {keys}, h + 1, list_append(preds, CASE WHEN is_row THEN {pred} END)
  FROM (SELECT {", ".join(f"k.{k}" for k in keys.split(", "))}, k.h, k.preds, d.h IS NOT NULL AS is_row, {extra} AS x, {used}
        FROM {name} k LEFT JOIN {rows} d ON {same} AND d.h = k.h + 1 WHERE k.h < (SELECT max(h) FROM {rows})))"""


LINEAR = f"5.0::DOUBLE + 0.5::DOUBLE * coalesce(u1, 0) + 0.2::DOUBLE * coalesce(u24, 0) + 0.1::DOUBLE * coalesce({_mean_of_two('u1', 'u2')}, 0)"
OBSERVED_LAGS = "lag({0}, 1) OVER w AS l1, lag({0}, 2) OVER w AS l2, lag({0}, 24) OVER w AS l24"
BY_STATION = "WINDOW w AS (PARTITION BY station_id ORDER BY date_time)"

RECURSIVE_FORECAST = f"""WITH RECURSIVE {STATION_HOURS}, {_folds_sql(4, 48, 24, _last_sql())},
lagged AS (SELECT *, {OBSERVED_LAGS.format("y")} FROM station_hours {BY_STATION}),
test_rows AS (
  SELECT lagged.*, fold_id, date_diff('hour', fold_cut, date_time) AS h, dense_rank() OVER (PARTITION BY fold_id ORDER BY date_time) - 1 AS step
  FROM lagged JOIN folds ON date_time > fold_cut AND date_time <= fold_end),
{_walk_sql("test_rows", "fold_id, station_id", (1, 2, 24), LINEAR)}
SELECT d.fold_id, d.station_id, d.date_time, d.y, k.preds[d.h] AS pred
FROM test_rows d JOIN walk k ON k.fold_id = d.fold_id AND k.station_id = d.station_id AND k.h = (SELECT max(h) FROM test_rows)"""


def prefill_given(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lags built from observations up to a start and given predictions after it."""
    rows = _persistence(spark, sf_dir).withColumn("pred", F.coalesce("pred", F.lit(30.0)))
    made = lags_from_predictions(rows, "y", "pred", tf.ntz(START), [1, 24], [1, 2], average_name="lag_avg")
    return made.select("station_id", "date_time", "y", "y_lag1", "y_lag2", "y_lag24", "lag_avg")


PREFILL_GIVEN = f"""WITH {PERSISTENCE},
mixed AS (SELECT *, CASE WHEN date_time <= TIMESTAMP '{START}' THEN y ELSE coalesce(pred, 30.0::DOUBLE) END AS m FROM persistence),
lagged AS (SELECT station_id, date_time, y, lag(m, 1) OVER w AS y_lag1, lag(m, 2) OVER w AS y_lag2, lag(m, 24) OVER w AS y_lag24
           FROM mixed WINDOW w AS (PARTITION BY station_id ORDER BY date_time))
SELECT *, (coalesce(y_lag1, 0) + coalesce(y_lag2, 0)) / nullif(CASE WHEN y_lag1 IS NULL THEN 0 ELSE 1 END
  + CASE WHEN y_lag2 IS NULL THEN 0 ELSE 1 END, 0) AS lag_avg FROM lagged"""


def prefill_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with the predictions of a recursive forecast."""
    return prefill_lags(
        samples.station_hours(spark, sf_dir), "y", [1, 24], [1, 2], tf.ntz(START), SCORER, average_name="lag_avg"
    )


PREFILL_FORECAST = f"""WITH RECURSIVE {STATION_HOURS},
hidden AS (SELECT *, CASE WHEN date_time <= TIMESTAMP '{START}' THEN y END AS known FROM station_hours),
lagged AS (SELECT *, {OBSERVED_LAGS.format("known")} FROM hidden {BY_STATION}),
future AS (
  SELECT *, date_diff('hour', TIMESTAMP '{START}', date_time) AS h, row_number() OVER (PARTITION BY station_id ORDER BY date_time) - 1 AS step
  FROM lagged WHERE date_time > TIMESTAMP '{START}'),
{_walk_sql("future", "station_id", (1, 2, 24), LINEAR)},
mixed AS (
  SELECT s.*, CASE WHEN date_time <= TIMESTAMP '{START}' THEN y ELSE k.preds[date_diff('hour', TIMESTAMP '{START}', date_time)] END AS m
  FROM station_hours s LEFT JOIN walk k ON k.station_id = s.station_id AND k.h = (SELECT max(h) FROM future)),
final AS (SELECT *, {OBSERVED_LAGS.format("m")} FROM mixed {BY_STATION})
SELECT station_id, date_time, y, l1 AS y_lag1, l2 AS y_lag2, l24 AS y_lag24, {_mean_of_two("l1", "l2")} AS lag_avg FROM final"""


def station_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forecast of every station from a point in time on, in the stored form."""
    made = runs.station_forecast(
        samples.station_hours(spark, sf_dir), "y", [1, 24], [1, 2], SCORER, tf.ntz(START), {"y": 150.0}, average_name="lag_avg"
    )
    return outputs.station_output(made, F.lit(7), tf.ntz(START))


STATION_FORECAST = f"""WITH RECURSIVE {STATION_HOURS},
capped AS (SELECT station_id, date_time, CASE WHEN y > 150 THEN 150 ELSE y END AS y FROM station_hours),
lagged AS (SELECT *, {OBSERVED_LAGS.format("y")} FROM capped {BY_STATION}),
future AS (
  SELECT *, date_diff('hour', TIMESTAMP '{START}', date_time) + 1 AS h, row_number() OVER (PARTITION BY station_id ORDER BY date_time) - 1 AS step
  FROM lagged WHERE date_time >= TIMESTAMP '{START}'),
{_walk_sql("future", "station_id", (1, 2, 24), LINEAR)}
SELECT 7 AS model_id, CAST(epoch(TIMESTAMP '{START}') AS BIGINT) AS date_time_forecast, CAST(epoch(d.date_time) AS BIGINT) AS date_time,
  d.station_id, k.preds[d.h] AS value
FROM future d JOIN walk k ON k.station_id = d.station_id AND k.h = (SELECT max(h) FROM future)"""


RECURSIVE_FORECAST_USERS, PREFILL_FORECAST_USERS, STATION_FORECAST_USERS = (
    sql.replace(STATION_HOURS, USER_STATIONS) for sql in (RECURSIVE_FORECAST, PREFILL_FORECAST, STATION_FORECAST)
)


def scenario_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily means for each station, day and percentage: two days ahead, 0..100 % traffic."""
    sales = F.col("event_type").isin("purchase", "signup")
    rows = table(spark, sf_dir, "events").groupBy(
        F.when(sales, "sales").otherwise("other").alias("station_id"), tf.floor_hour(F.col("ts")).alias("date_time")
    ).agg(F.max("value").alias("y"), F.count(F.lit(1)).cast("double").alias("kfz_per_hour"))
    start = tf.ntz(START)
    scorer = LinearScorer({"y_lag1": 0.5, "lag_avg": 0.1, "kfz_per_hour": 0.8}, 3.0)
    made = scenarios.scenario_days(
        scenarios.scenario_forecast(rows, "y", [1], [1, 2], start, 2, scorer, average_name="lag_avg"), start
    )
    return _rounded(made, *[c for c in made.columns if c.startswith("pct")], digits=9)


_TRAFFIC_LINEAR = f"3.0::DOUBLE + 0.5::DOUBLE * coalesce(u1, 0) + 0.1::DOUBLE * coalesce({_mean_of_two('u1', 'u2')}, 0) + 0.8::DOUBLE * coalesce(x, 0)"
SCENARIO_FORECAST = f"""WITH RECURSIVE places AS (
  SELECT CASE WHEN event_type IN ('purchase', 'signup') THEN 'sales' ELSE 'other' END AS station_id, date_trunc('hour', ts) AS date_time,
         max(value) AS y, CAST(count(*) AS DOUBLE) AS kfz FROM events GROUP BY 1, 2),
ranged AS (SELECT * FROM places WHERE date_time <= TIMESTAMP '{START}' + INTERVAL 48 HOUR),
hidden AS (SELECT *, CASE WHEN date_time <= TIMESTAMP '{START}' THEN y END AS known FROM ranged),
lagged AS (SELECT *, lag(known, 1) OVER w AS l1, lag(known, 2) OVER w AS l2 FROM hidden {BY_STATION}),
future AS (
  SELECT *, date_diff('hour', TIMESTAMP '{START}', date_time) AS h, row_number() OVER (PARTITION BY station_id ORDER BY date_time) - 1 AS step
  FROM lagged WHERE date_time > TIMESTAMP '{START}'),
{_walk_sql("future", "station_id", (1, 2), _TRAFFIC_LINEAR, "d.kfz")},
mixed AS (
  SELECT r.*, CASE WHEN date_time <= TIMESTAMP '{START}' THEN y ELSE k.preds[date_diff('hour', TIMESTAMP '{START}', date_time)] END AS m
  FROM ranged r LEFT JOIN walk k ON k.station_id = r.station_id AND k.h = (SELECT max(h) FROM future)),
filled AS (SELECT *, lag(m, 1) OVER w AS l1, lag(m, 2) OVER w AS l2 FROM mixed {BY_STATION}),
days AS (
  SELECT *, CAST((date_diff('hour', TIMESTAMP '{START}', date_time) - 1) // 24 AS INTEGER) AS day,
         (date_diff('hour', TIMESTAMP '{START}', date_time) - 1) % 24 + 1 AS h
  FROM filled WHERE date_time > TIMESTAMP '{START}'),
full_days AS (SELECT station_id, day, count(*) AS n FROM days GROUP BY 1, 2 HAVING count(*) = 24),
kept AS (
  SELECT f.station_id, f.day FROM full_days f
  WHERE (SELECT count(*) FROM full_days e WHERE e.station_id = f.station_id AND e.day <= f.day) = f.day + 1),
scenario AS (
  SELECT days.*, h - 1 AS step, CAST(p * 10 AS INTEGER) AS kfz_pct,
    CASE WHEN hour(timezone('Europe/Berlin', timezone('UTC', date_time))) BETWEEN 5 AND 21 THEN kfz * CAST(p * 10 AS INTEGER) / 100 ELSE kfz END AS v
  FROM days JOIN kept USING (station_id, day), generate_series(0, 10) s(p)),
{_walk_sql("scenario", "station_id, day, kfz_pct", (1, 2), _TRAFFIC_LINEAR, "d.v", "replay")}
SELECT station_id, day, CAST(timezone('Europe/Berlin', timezone('UTC', TIMESTAMP '{START}' + to_hours(day * 24))) AS DATE) AS date,
  {", ".join(f"max(CASE WHEN kfz_pct = {p} THEN round(list_avg(preds), 9) END) AS pct_kfz_{p}" for p in scenarios.PERCENTAGES)}
FROM replay WHERE h = 24 GROUP BY station_id, day"""


# ---------------------------------------------------------------- models

STAGE_1 = LinearScorer({"l_quantity": 2.0, "l_discount": -300.0}, 4.0)
STAGE_2 = LinearScorer({"l_tax": -90.0, "l_quantity": -1.5}, 1.0)


def two_stage_combine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both stages, their total and the observed value side by side."""
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax", "l_extendedprice")
    staged = items.withColumns({"pred_stage_1": STAGE_1.column(), "pred_stage_2": STAGE_2.column()})
    return staged.select(
        "l_orderkey", "l_linenumber", "pred_stage_1", "pred_stage_2",
        combine_stages(F.col("pred_stage_1"), F.col("pred_stage_2")).alias("pred"),
        (F.col("l_extendedprice") - F.col("pred_stage_1")).alias("residual"),
    )


TWO_STAGE_COMBINE = """WITH s AS (
  SELECT *, 4.0::DOUBLE + 2.0::DOUBLE * l_quantity + -300.0::DOUBLE * l_discount AS s1,
         1.0::DOUBLE + -90.0::DOUBLE * l_tax + -1.5::DOUBLE * l_quantity AS s2 FROM lineitem)
SELECT l_orderkey, l_linenumber, s1 AS pred_stage_1, s2 AS pred_stage_2, CASE WHEN s1 + s2 < 0 THEN 0 ELSE s1 + s2 END AS pred,
  l_extendedprice - s1 AS residual FROM s"""


CHAIN = FeatureSpec("no2", (1, 2), (1, 2), stages=2)  # sample stations have few hours with data
CHAIN_START = "2024-01-26 00:00:00"  # the last three days of the range are forecast


def retrieved_to_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole chain: retrieve, train two stages on the real feature lists, register, promote, load, forecast all stations."""
    rows = _retrieved(spark, sf_dir, "stations", only_active=False).rows
    metric = [f for f in CHAIN.names if f not in CHAIN.categoric and f not in CHAIN.lag_columns]
    typed = store(cleaning.fix_column_types(rows, ["station_id", *CHAIN.categoric], ["no2", *metric]), "chain-rows")
    start, caps = tf.ntz(CHAIN_START), {"no2": 150.0}
    ready = runs.prepare_station_rows(typed, "no2", caps, CHAIN.own_lags, CHAIN.short_lags)
    params = [{**boosting_params("no2", True, stage), "maxIter": 2, "maxDepth": 3} for stage in (1, 2)]
    root = scratch_path(spark, "chain")
    model_id = runs.train_and_register(
        spark, ready.where(F.col("date_time") < start), "no2", CHAIN.of_stage(1), CHAIN.of_stage(2), CHAIN.categoric, *params,
        CHAIN.own_lags, CHAIN.short_lags, "temporal_chain", 1, f"{root}/registry", f"{root}/models", 120.0, f"{root}/final", "temporal",
    )
    chosen = spark.read.parquet(f"{root}/final").select(F.max("model_id")).first()[0]
    row = registry.model_row(spark.read.parquet(f"{root}/registry"), chosen)
    model = StagedModel.load(row.model_path, row.features_1, row.features_2, row.categorical)
    made = runs.station_forecast(typed, "no2", CHAIN.own_lags, CHAIN.short_lags, model.scorer(spark), start, caps)
    return made.select("station_id", "date_time", "pred", F.lit(model_id).alias("model_id"))


def grid_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All batches through assembly, scoring and the sink; what was stored is read back."""
    domain, path = samples.domain_tables(spark, sf_dir), scratch_path(spark, "grid")
    runs.grid_run(
        spark, domain, tf.ntz(RANGE_FROM), tf.ntz(RANGE_TO), _scored, 7, {"no2": 150.0}, path, "grid", ("event_id",)
    )
    return spark.read.parquet(path)


GRID_RUN = f"""WITH {DOMAIN["traffic"]}, {DOMAIN["traffic_scaling"]},
users AS (SELECT DISTINCT CAST(user_id % 16 AS INTEGER) AS x, CAST(user_id // 16 AS INTEGER) AS y FROM events),
newest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY date_time, x, y ORDER BY event_id DESC) AS n
           FROM traffic WHERE model_id = 1 AND {_RANGE}) WHERE n = 1),
scaled AS (
  SELECT x, y, date_time, scaling * value AS kfz FROM newest JOIN traffic_scaling USING (x, y) JOIN users USING (x, y)),
day AS (SELECT *, CASE WHEN hour(timezone('Europe/Berlin', timezone('UTC', date_time))) BETWEEN 5 AND 21 THEN kfz * 100 / 100 ELSE kfz END AS v FROM scaled)
SELECT 7 AS model_id, CAST(epoch(TIMESTAMP '{RANGE_FROM}') AS BIGINT) AS date_time_forecast, CAST(epoch(date_time) AS BIGINT) AS date_time,
  x, y, CAST(round_even(10.0::DOUBLE + 0.3::DOUBLE * v, 1) AS DECIMAL(10, 1)) AS value FROM day"""


_ALL_CELLS = f"""{DOMAIN["traffic"]}, {DOMAIN["traffic_scaling"]},
newest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY date_time, x, y ORDER BY event_id DESC) AS n
           FROM traffic WHERE model_id = 1 AND {_RANGE}) WHERE n = 1),
scaled AS (SELECT x, y, date_time, scaling * value AS kfz FROM newest JOIN traffic_scaling USING (x, y)),
measured_cells AS (SELECT DISTINCT CAST(user_id % 16 AS INTEGER) AS x, CAST(user_id // 16 AS INTEGER) AS y FROM events)"""


def grid_sim_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same in mode grid_sim, types fixed: every row under each traffic percentage."""
    domain, path = samples.domain_tables(spark, sf_dir), scratch_path(spark, "grid-sim")

    def predict(rows: DataFrame) -> DataFrame:
        return _scored(cleaning.fix_column_types(rows, [], ["kfz_per_hour"]))

    runs.grid_run(spark, domain, tf.ntz(RANGE_FROM), tf.ntz(RANGE_TO), predict, 7, {"no2": 150.0}, path, "grid_sim", ("event_id",))
    return spark.read.parquet(path)


GRID_SIM_RUN = f"""WITH {_ALL_CELLS},
day AS (
  SELECT scaled.*, CAST(p * 10 AS INTEGER) AS kfz_pct, CASE WHEN hour(timezone('Europe/Berlin', timezone('UTC', date_time))) BETWEEN 5 AND 21 THEN kfz * CAST(p * 10 AS INTEGER) / 100 ELSE kfz END AS v
  FROM scaled JOIN measured_cells USING (x, y), generate_series(0, 10) s(p))
SELECT 7 AS model_id, CAST(epoch(TIMESTAMP '{RANGE_FROM}') AS BIGINT) AS date_time_forecast, CAST(epoch(date_time) AS BIGINT) AS date_time,
  x, y, kfz_pct, CAST(round_even(10.0::DOUBLE + 0.3::DOUBLE * v, 1) AS DECIMAL(10, 1)) AS value FROM day"""


def sampler_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions at the cells of the passive samplers, as they are stored."""
    domain, path = samples.domain_tables(spark, sf_dir), scratch_path(spark, "samplers")
    runs.sampler_run(spark, domain, tf.ntz(RANGE_FROM), tf.ntz(RANGE_TO), _scored, 7, {"no2": 150.0}, path, ("event_id",))
    return spark.read.parquet(path)


SAMPLER_RUN = f"""WITH {_ALL_CELLS},
samplers AS (SELECT DISTINCT CAST(c_custkey % 16 AS INTEGER) AS x, CAST(c_custkey // 16 AS INTEGER) AS y FROM customer WHERE c_acctbal < 0),
day AS (
  SELECT scaled.*, CASE WHEN hour(timezone('Europe/Berlin', timezone('UTC', date_time))) BETWEEN 5 AND 21 THEN kfz * 100 / 100 ELSE kfz END AS v
  FROM scaled JOIN samplers USING (x, y) JOIN measured_cells USING (x, y))
SELECT 7 AS model_id, CAST(epoch(TIMESTAMP '{RANGE_FROM}') AS BIGINT) AS date_time_forecast, CAST(epoch(date_time) AS BIGINT) AS date_time,
  x, y, CAST(round_even(10.0::DOUBLE + 0.3::DOUBLE * v, 1) AS DECIMAL(10, 1)) AS value FROM day"""


def attribution_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").select("l_quantity", "l_discount", "l_tax")
    names = ["l_quantity", "l_discount", "l_tax"]
    model = LinearScorer({"l_quantity": 2.0, "l_discount": -300.0, "l_tax": -90.0}, 4.0)
    made = attribution.attribute(items, names, lambda state: model.column(state), attribution.feature_means(items, names))
    return _rounded(attribution.attribution_ranking(made, names), "importance")


ATTRIBUTION_TOPK = """WITH m AS (SELECT avg(l_quantity) AS q, avg(l_discount) AS d, avg(l_tax) AS t FROM lineitem)
SELECT 'l_quantity' AS feature, round(avg(abs(2.0 * (l_quantity - q))), 6) AS importance FROM lineitem, m
UNION ALL SELECT 'l_discount', round(avg(abs(300.0 * (l_discount - d))), 6) FROM lineitem, m
UNION ALL SELECT 'l_tax', round(avg(abs(90.0 * (l_tax - t))), 6) FROM lineitem, m"""

# ---------------------------------------------------------------- registry


def training_period_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.training_description(
        table(spark, sf_dir, "events"), "ts", {"eta": 0.1, "max_depth": 12, "objective": "reg:squarederror"}, [24, 48],
        [1, 2, 3], by=["user_id"],
    )


TRAINING_PERIOD_JSON = """SELECT user_id, '{"eta":0.1,"lags":"[24, 48]","lags_avg":"[1, 2, 3]","max_depth":12,"objective":"reg:squarederror",'
  || '"training_period":["' || strftime(min(ts), '%Y-%m-%d %H:%M:%S') || '","' || strftime(max(ts), '%Y-%m-%d %H:%M:%S') || '"]}' AS description
FROM events GROUP BY 1"""


SPEC = FeatureSpec("no2", (24, 48), (1, 2), stages=2)


def _registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One model per user, trained on its events; users with a purchase have two stages."""
    events = table(spark, sf_dir, "events")
    first = registry.training_description(events, "ts", {"eta": 0.1}, [], [], by=["user_id"])
    second = registry.training_description(
        events.where(F.col("event_type") == "purchase"), "ts", {"eta": 0.2}, [24, 48], [1, 2], by=["user_id"]
    ).withColumnRenamed("description", "description_residuals")
    stage_1, stage_2, categorical = SPEC.of_stage(1), SPEC.of_stage(2), SPEC.categoric
    newest = events.groupBy("user_id").agg(tf.unix_seconds(F.max("ts")).alias("date_time_training_execution"))
    two = F.col("description_residuals").isNotNull()
    return (
        first.join(second, "user_id", "left")
        .join(newest, "user_id")
        .select(
            F.col("user_id").alias("model_id"),
            "date_time_training_execution",
            F.when(two, "no2").otherwise("pm10").alias("pollutant"),
            F.when(two, "temporal_cv_t+96").otherwise("spatial").alias("model_name"),
            "description",
            "description_residuals",
            F.array(*[F.lit(f) for f in stage_1]).alias("features_1"),
            F.when(two, F.array(*[F.lit(f) for f in stage_2])).alias("features_2"),
            F.array(*[F.lit(f) for f in categorical]).alias("categorical"),
        )
    )


def model_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = registry.model_settings(_registry(spark, sf_dir))
    return made.select(
        "model_id", "pollutant", F.size("feature_cols").alias("n_features"),
        F.array_join("categorical_feature_cols", ",").alias("categorical"), F.size("metric_feature_cols").alias("n_metric"),
        F.array_join(F.col("lags").cast("array<string>"), ",").alias("lags"),
        F.array_join(F.col("lags_avg").cast("array<string>"), ",").alias("lags_avg"),
        "max_training_date_model_1", "max_training_date_model_2",
    )


def _model_settings_sql() -> str:
    stage_1, categorical = SPEC.of_stage(1), SPEC.categoric
    union = len(set(stage_1) | set(SPEC.names))
    names = ",".join(sorted(categorical))
    return f"""WITH u AS (SELECT user_id, max(ts) AS last, max(ts) FILTER (WHERE event_type = 'purchase') AS last_2 FROM events GROUP BY 1)
SELECT user_id AS model_id, CASE WHEN last_2 IS NULL THEN 'pm10' ELSE 'no2' END AS pollutant,
  CASE WHEN last_2 IS NULL THEN {len(stage_1)} ELSE {union} END AS n_features,
  CASE WHEN last_2 IS NULL THEN '' ELSE '{names}' END AS categorical,
  CASE WHEN last_2 IS NULL THEN {len(stage_1)} ELSE {union - len(categorical)} END AS n_metric,
  CASE WHEN last_2 IS NULL THEN '' ELSE '24,48' END AS lags, CASE WHEN last_2 IS NULL THEN '' ELSE '1,2' END AS lags_avg,
  strftime(last, '%Y-%m-%d %H:%M:%S') AS max_training_date_model_1, strftime(last_2, '%Y-%m-%d %H:%M:%S') AS max_training_date_model_2
FROM u"""


def available_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.available_models(_registry(spark, sf_dir), "temporal_cv%", "no2").select(
        "model_id", "date_time_training_execution", "pollutant", "model_name"
    )


AVAILABLE_MODELS = """SELECT user_id AS model_id, CAST(floor(epoch(max(ts))) AS BIGINT) AS date_time_training_execution, 'no2' AS pollutant,
  'temporal_cv_t+96' AS model_name FROM events GROUP BY 1 HAVING count(*) FILTER (WHERE event_type = 'purchase') > 0"""


def final_model_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows predicted by the model that is final for a pollutant; the id is a scalar inside the plan."""
    domain = samples.domain_tables(spark, sf_dir)
    chosen = registry.final_model_id(domain["models_final"], "temporal", "no2")
    return domain["predictions_latest"].where(F.col("model_id") == chosen)


FINAL_MODEL_CHOICE = """SELECT date_trunc('hour', ts) AS date_time, CAST(user_id AS VARCHAR) AS station_id, value, 3 AS model_id
FROM events WHERE event_type = 'view'"""

# ---------------------------------------------------------------- requests


def produce_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    batches = table(spark, sf_dir, "customer").select(F.floor(F.col("c_custkey") / 5).cast("int").alias("batch"))
    return requests.produce_requests(batches, 4, with_uuid=False)


PRODUCE_REQUESTS = """WITH b AS (SELECT DISTINCT CAST(c_custkey // 5 AS INTEGER) AS batch FROM customer)
SELECT CAST(batch % 4 AS VARCHAR) AS key, '{"key":"' || batch || '-' || p || '","batch_id":' || batch || ',"depvar":"' || p || '"}' AS value
FROM b, (VALUES ('no2'), ('pm10'), ('pm25')) v(p)"""


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Request texts from views and purchases; all other events send texts that are no requests."""
    depvar = F.when(F.col("event_type") == "view", "no2").when(F.col("event_type") == "purchase", "pm10")
    body = F.to_json(
        F.struct(F.col("event_id").cast("string").alias("key"), F.col("user_id").cast("int").alias("batch_id"), depvar.alias("depvar"))
    )
    return table(spark, sf_dir, "events").select(
        "event_id", F.when(depvar.isNotNull(), body).otherwise(F.col("props")).alias("value")
    )


def parse_request(spark: SparkSession, sf_dir: str) -> DataFrame:
    return requests.parse_requests(_messages(spark, sf_dir)).drop("value")


PARSE_REQUEST = """SELECT event_id, CASE WHEN valid THEN CAST(event_id AS VARCHAR) END AS key,
  CASE WHEN valid THEN CAST(user_id AS INTEGER) END AS batch_id,
  CASE event_type WHEN 'view' THEN 'no2' WHEN 'purchase' THEN 'pm10' END AS depvar, valid AS is_valid
FROM (SELECT *, event_type IN ('view', 'purchase') AS valid FROM events)"""


#: Intercept and weight of traffic of the models that are final for nitrogen dioxide (3) and coarse dust (1).
SERVED = {3: (20.0, 0.3), 1: (10.0, 0.2)}
SERVED_AT = "2024-01-09 13:30:00"
SERVED_FROM, SERVED_TO = "2024-01-09 05:00:00", "2024-01-14 00:00:00"


def _served(spark: SparkSession, sf_dir: str) -> serving.GridService:
    """Texts arrive as files; each valid one asks for a batch of cells and a pollutant, and the stream answers with the final model."""
    domain, root = samples.domain_tables(spark, sf_dir), scratch_path(spark, "requests")
    _messages(spark, sf_dir).select("value").write.text(f"{root}/in")

    def load(depvar: str, model_id: int):
        intercept, weight = SERVED[model_id]
        return lambda rows: rows.withColumn("pred", LinearScorer({"kfz_per_hour": weight}, intercept).column())

    now = tf.ntz(SERVED_AT)
    service = serving.GridService(
        domain, domain["models_final"], load, tf.model_start(now), tf.horizon_end(now), f"{root}/served", ("event_id",), {"no2": 150.0},
        domain="temporal", metric=["kfz_per_hour"],
    )
    service.serve(requests.file_messages(spark, f"{root}/in"), f"{root}/progress").awaitTermination()
    return service


def stream_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that the answered requests have left."""
    rows = _served(spark, sf_dir).rows(spark)
    return rows.select("depvar", "batch", F.col("date_time_forecast").cast("long").alias("date_time_forecast"), "model_id", "date_time", "x", "y", "value")


def stream_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report for every distinct request."""
    return _served(spark, sf_dir).reports(spark)


_ASKED = """asked AS (
  SELECT DISTINCT CAST(user_id AS INTEGER) AS batch, CASE event_type WHEN 'view' THEN 'no2' ELSE 'pm10' END AS depvar, CASE event_type WHEN 'view' THEN 3 ELSE 1 END AS model_id
  FROM events WHERE event_type IN ('view', 'purchase')),
batches AS (SELECT CAST(c_custkey % 16 AS INTEGER) AS x, CAST(c_custkey // 16 AS INTEGER) AS y, CAST(c_custkey // 50 AS INTEGER) AS batch FROM customer)"""
_SERVED_ROWS = f"""{DOMAIN["traffic"]}, {DOMAIN["traffic_scaling"]}, {_ASKED},
newest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY date_time, x, y ORDER BY event_id DESC) AS n
           FROM traffic WHERE model_id = 1 AND date_time BETWEEN TIMESTAMP '{SERVED_FROM}' AND TIMESTAMP '{SERVED_TO}') WHERE n = 1),
cells_with_data AS (SELECT DISTINCT CAST(user_id % 16 AS INTEGER) AS x, CAST(user_id // 16 AS INTEGER) AS y FROM events),
scaled AS (SELECT x, y, batch, date_time, scaling * value AS kfz FROM newest JOIN traffic_scaling USING (x, y) JOIN cells_with_data USING (x, y) JOIN batches USING (x, y)),
daytime AS (SELECT *, CASE WHEN hour(timezone('Europe/Berlin', timezone('UTC', date_time))) BETWEEN 5 AND 21 THEN kfz * 100 / 100 ELSE kfz END AS v FROM scaled)"""
_SERVED_VALUE = " ".join(f"WHEN {m} THEN {a}::DOUBLE + {w}::DOUBLE * v" for m, (a, w) in SERVED.items())
STREAM_REQUESTS = f"""WITH {_SERVED_ROWS}
SELECT depvar, batch, CAST(epoch(TIMESTAMP '{SERVED_FROM}') AS BIGINT) AS date_time_forecast, model_id, CAST(epoch(date_time) AS BIGINT) AS date_time, x, y,
  CAST(round_even(CASE model_id {_SERVED_VALUE} END, 1) AS DECIMAL(10, 1)) AS value
FROM daytime JOIN asked USING (batch)"""
STREAM_REPORTS = f"""WITH {_SERVED_ROWS},
found AS (SELECT batch, count(*) AS n FROM daytime GROUP BY 1),
wanted AS (SELECT batch, count(*) * (date_diff('hour', TIMESTAMP '{SERVED_FROM}', TIMESTAMP '{SERVED_TO}') + 1) AS n FROM batches GROUP BY 1)
SELECT batch, depvar, CAST(epoch(TIMESTAMP '{SERVED_FROM}') AS BIGINT) AS date_time_forecast, model_id, coalesce(found.n = wanted.n, false) AS finished
FROM asked LEFT JOIN found USING (batch) LEFT JOIN wanted USING (batch)"""


def retry_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports of both attempts and the rows stored, when one batch fails once and another one always."""
    cells = table(spark, sf_dir, "customer").select("c_custkey", F.floor(F.col("c_custkey") / 50).cast("int").alias("batch"))
    sizes, path = store(cells.groupBy("batch").count(), "cells"), scratch_path(spark, "retried")
    once, always = sizes.agg(F.min("batch"), F.max("batch")).first()
    failed_alone = []

    def run(batches: DataFrame) -> DataFrame:
        ids = [r[0] for r in batches.limit(2).collect()]
        bad = [always, *([] if failed_alone else [once])]
        if ids == [once]:
            failed_alone.append(once)
        error = F.raise_error(F.lit("a batch that cannot be computed")).cast("int")
        rows = cells.join(batches, "batch").withColumn("value", F.when(F.col("batch").isin(bad), error).otherwise(F.lit(1)))
        write_rows(spark, rows, path, mode="insert")
        return sizes.join(batches, "batch").select("batch", F.lit(True).alias("finished"))

    try:
        reports, failed = requests.run_with_retry(sizes, requests.isolated(run)), None
    except requests.BatchesFailed as error:
        reports, failed = error.reports, error.failed
    stored = spark.read.parquet(path).groupBy("batch").agg(F.count(F.lit(1)).alias("n_rows"))
    flagged = failed.withColumn("gave_up", F.lit(True)) if failed is not None else sizes.select("batch", F.lit(False).alias("gave_up"))
    made = reports.join(stored, "batch", "left").join(flagged, "batch", "left")
    return made.select("batch", "attempt", "finished", F.coalesce("n_rows", F.lit(0)).alias("n_rows"), F.coalesce("gave_up", F.lit(False)).alias("gave_up"))


RETRY_GRID = """WITH sizes AS (SELECT CAST(c_custkey // 50 AS INTEGER) AS batch, count(*) AS n FROM customer GROUP BY 1),
ends AS (SELECT min(batch) AS once, max(batch) AS always FROM sizes),
attempts AS (
  SELECT batch, 1 AS attempt, batch NOT IN (once, always) AS finished FROM sizes, ends
  UNION ALL SELECT batch, 2, batch = once FROM sizes, ends WHERE batch IN (once, always))
SELECT batch, attempt, finished, CASE WHEN batch = always THEN 0 ELSE n END AS n_rows, batch = always AS gave_up FROM attempts JOIN sizes USING (batch), ends"""


def batches_to_reschedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    reports = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("batch"), (F.col("o_orderstatus") == "F").alias("finished")
    )
    return requests.batches_to_reschedule(reports)


BATCHES_TO_RESCHEDULE = """SELECT o_custkey AS batch FROM orders GROUP BY 1 HAVING NOT bool_or(o_orderstatus = 'F')"""

QUERIES = {
    "feature_assembly": (feature_assembly, FEATURE_ASSEMBLY),
    "retrieved_to_forecast": (retrieved_to_forecast, None),
    "retrieve_stations": (retrieve_stations, RETRIEVE_STATIONS),
    "retrieve_grid": (retrieve_grid, RETRIEVE_GRID),
    "retrieve_grid_sim": (retrieve_grid_sim, RETRIEVE_GRID_SIM),
    "retrieve_samplers": (retrieve_samplers, RETRIEVE_SAMPLERS),
    "retrieval_report": (retrieval_report, RETRIEVAL_REPORT),
    "retrieve_grid_all": (retrieve_grid_all, RETRIEVE_ALL_CELLS),
    "retrieve_grid_sim_all": (retrieve_grid_sim_all, RETRIEVE_ALL_CELLS),
    "retrieval_report_all": (retrieval_report_all, RETRIEVAL_REPORT_ALL),
    "weighted_station_avg": (weighted_station_avg, WEIGHTED_STATION_AVG),
    "rolling_origin_folds": (rolling_origin_folds, ROLLING_ORIGIN_FOLDS),
    "fold_sizes": (fold_sizes, FOLD_SIZES),
    "train_window": (train_window, TRAIN_WINDOW),
    "transgression_suggestions": (transgression_suggestions, TRANSGRESSION_SUGGESTIONS),
    "scenario_range": (scenario_range, SCENARIO_RANGE),
    "fold_step_index": (fold_step_index, FOLD_STEP_INDEX),
    "retrain_groups": (retrain_groups, RETRAIN_GROUPS),
    "holdout_split": (holdout_split, HOLDOUT_SPLIT),
    "leave_one_out_folds": (leave_one_out_folds, LEAVE_ONE_OUT_FOLDS),
    "regression_metrics": (regression_metrics, REGRESSION_METRICS),
    "station_metrics": (station_metrics, STATION_METRICS),
    "daily_local_mean": (daily_local_mean, DAILY_LOCAL_MEAN),
    "limit_confusion": (limit_confusion, LIMIT_CONFUSION),
    "tweak_curve": (tweak_curve, TWEAK_CURVE),
    "find_tweak_value": (find_tweak_value, FIND_TWEAK_VALUE),
    "transgression_days": (transgression_days, TRANSGRESSION_DAYS),
    "transgressions_per_month": (transgressions_per_month, TRANSGRESSIONS_PER_MONTH),
    "fold_scores": (fold_scores, FOLD_SCORES),
    "traffic_scenarios": (traffic_scenarios, TRAFFIC_SCENARIOS),
    "scenario_daily_pivot": (scenario_daily_pivot, SCENARIO_DAILY_PIVOT),
    "thresholds_output": (thresholds_output, THRESHOLDS_OUTPUT),
    "complete_days_prefix": (complete_days_prefix, COMPLETE_DAYS_PREFIX),
    "max_admissible_pct": (max_admissible_pct, MAX_ADMISSIBLE_PCT),
    "monotonicity_violations": (monotonicity_violations, MONOTONICITY_VIOLATIONS),
    "monotone_scenarios": (monotone_scenarios, MONOTONE_SCENARIOS),
    "scenario_contribution": (scenario_contribution, SCENARIO_CONTRIBUTION),
    "grid_sim_output": (grid_sim_output, GRID_SIM_OUTPUT),
    "batch_report": (batch_report, BATCH_REPORT),
    "recursive_forecast": (recursive_forecast_query, RECURSIVE_FORECAST),
    "prefill_lags": (prefill_given, PREFILL_GIVEN),
    "prefill_forecast": (prefill_forecast, PREFILL_FORECAST),
    "station_forecast": (station_forecast, STATION_FORECAST),
    "recursive_forecast_users": (recursive_forecast_users, RECURSIVE_FORECAST_USERS),
    "prefill_forecast_users": (prefill_forecast_users, PREFILL_FORECAST_USERS),
    "station_forecast_users": (station_forecast_users, STATION_FORECAST_USERS),
    "scenario_forecast": (scenario_forecast, SCENARIO_FORECAST),
    "two_stage_combine": (two_stage_combine, TWO_STAGE_COMBINE),
    "grid_run": (grid_run, GRID_RUN),
    "grid_sim_run": (grid_sim_run, GRID_SIM_RUN),
    "sampler_run": (sampler_run, SAMPLER_RUN),
    "attribution_topk": (attribution_topk, ATTRIBUTION_TOPK),
    "training_period_json": (training_period_json, TRAINING_PERIOD_JSON),
    "model_settings": (model_settings, _model_settings_sql()),
    "available_models": (available_models, AVAILABLE_MODELS),
    "final_model_choice": (final_model_choice, FINAL_MODEL_CHOICE),
    "produce_requests": (produce_requests, PRODUCE_REQUESTS),
    "parse_request": (parse_request, PARSE_REQUEST),
    "stream_requests": (stream_requests, STREAM_REQUESTS),
    "stream_reports": (stream_reports, STREAM_REPORTS),
    "retry_grid": (retry_grid, RETRY_GRID),
    "batches_to_reschedule": (batches_to_reschedule, BATCHES_TO_RESCHEDULE),
}
