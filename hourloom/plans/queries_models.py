"""Queries around fitted models, with SQL that fits the same models.

One-level trees are sums and counts per bin, so SQL states their fit exactly. The stations are the users, each a series of its own; only
leave-one-out validation, a fit per station, takes the event types as stations.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hourloom.functions import timefns as tf
from hourloom.operators import attribution, evaluation, folds
from hourloom.operators.lags import add_station_lags
from hourloom.operators.search import candidate_table, search_parameters
from hourloom.operators.stumps import UNIT
from hourloom.operators.training import StagedModel, fit_staged, fit_with_early_stopping
from hourloom.plans import runs, samples
from hourloom.plans.queries_forecast import (
    BY_STATION, OBSERVED_LAGS, USER_STATIONS, _folds_sql, _last_sql, _mean_of_two, _rounded, _user_stations, _walk_sql,
)
from hourloom.plans.samples import STATION_HOURS, table
from hourloom.session import scratch_path
from hourloom.sources import outputs, registry

LEVELS = (10.0, 20.0, 35.0, 50.0, 70.0, 100.0, 150.0)
CUTS = {
    "hour": tuple(float(h) for h in range(23)), "weekday": tuple(float(d) for d in range(1, 7)),
    "y_lag1": LEVELS, "y_lag2": LEVELS, "y_lag24": LEVELS, "y_lag48": LEVELS, "lag_avg": LEVELS,
}
CALENDAR = ("hour", "weekday")
FEATURES = (*CALENDAR, "y_lag1", "y_lag24", "lag_avg")
STUMPS = {"cuts": CUTS, "rounds": 2, "eta": 0.5, "min_rows": 20}
CAP = 150.0

# ---------------------------------------------------------------- one-level trees in SQL


def _bins_sql(features: Sequence[str], cuts: dict) -> str:
    items = [
        f"{{'feature': {i}, 'bin': len(list_filter({[float(c) for c in sorted(cuts[f])]}::DOUBLE[], lambda c: NOT coalesce({f} <= c, false)))}}"
        for i, f in enumerate(features)
    ]
    return f"[{', '.join(items)}]"


def _split_sql(name: str, source: str, residual: str, features: Sequence[str], cuts: dict, min_rows: str, by: Sequence[str] = (), where: str = "TRUE", allowed: str = "TRUE") -> str:
    """Table `name`: by, feature, cut, l and r of the split with the largest gain."""
    keys = "".join(f"{k}, " for k in by)
    listed = "CASE b.feature " + " ".join(f"WHEN {i} THEN {[float(c) for c in sorted(cuts[f])]}::DOUBLE[]" for i, f in enumerate(features)) + " END"
    names = "CASE b.feature " + " ".join(f"WHEN {i} THEN '{f}'" for i, f in enumerate(features)) + " END"
    rank = f"PARTITION BY {keys[:-2]} ORDER BY" if by else "ORDER BY"
    gain = "CAST(ls AS DOUBLE) * CAST(ls AS DOUBLE) / CAST(ln AS DOUBLE) + CAST(rs AS DOUBLE) * CAST(rs AS DOUBLE) / CAST(rn AS DOUBLE)"
    return f"""{name}_each AS (SELECT {keys}CAST(floor(({residual}) * {UNIT}.0::DOUBLE + 0.5::DOUBLE) AS BIGINT) AS r, unnest({_bins_sql(features, cuts)}) AS at_ FROM {source} WHERE {where}),
{name}_counts AS (SELECT {keys}at_.feature AS feature, at_.bin AS bin, sum(r) AS s, count(*) AS n FROM {name}_each GROUP BY ALL),
{name}_sides AS (
  SELECT *, ts - ls AS rs, tn - ln AS rn FROM (
    SELECT {keys}feature, bin, sum(s) OVER u AS ls, sum(n) OVER u AS ln, sum(s) OVER t AS ts, sum(n) OVER t AS tn FROM {name}_counts
    WINDOW u AS (PARTITION BY {keys}feature ORDER BY bin ROWS UNBOUNDED PRECEDING), t AS (PARTITION BY {keys}feature))),
{name} AS (
  SELECT {keys}{names} AS feature, ({listed})[b.bin + 1] AS cut, CAST(ls AS DOUBLE) / CAST(ln AS DOUBLE) / {UNIT} AS l, CAST(rs AS DOUBLE) / CAST(rn AS DOUBLE) / {UNIT} AS r
  FROM (SELECT *, row_number() OVER ({rank} {gain} DESC, feature, bin) AS place FROM {name}_sides WHERE ln >= {min_rows} AND rn >= {min_rows} AND rn > 0 AND {allowed}) b WHERE place = 1)"""


def _side_sql(split: str, features: Sequence[str], eta: str, value=lambda f: f) -> str:
    """What a split adds to a row."""
    of_row = f"CASE {split}.feature " + " ".join(f"WHEN '{f}' THEN {value(f)}" for f in features) + " END"
    return f"CASE WHEN {of_row} <= {split}.cut THEN {split}.l * {eta} ELSE {split}.r * {eta} END"


def _boost_sql(name: str, source: str, label: str, features: Sequence[str], params: dict, where: str = "TRUE", by: Sequence[str] = (), f: str = "f") -> str:
    """Tables <name>0, <name>1, ...: source with `f`, the prediction after so many rounds, fitted on the rows that `where` takes."""
    keys = "".join(f"{k}, " for k in by)
    known, same = f"({where}) AND {label} IS NOT NULL", " AND ".join(f"d.{k} = s.{k}" for k in by) or "TRUE"
    eta, least = f"{params['eta']}::DOUBLE", str(params["min_rows"])
    units = f"CAST(floor(({label}) * {UNIT}.0::DOUBLE + 0.5::DOUBLE) AS BIGINT)"
    base = f"CAST(sum({units}) AS DOUBLE) / CAST(count({label}) AS DOUBLE) / {UNIT}"
    made = [f"""{name}_base AS (SELECT {keys}{base} AS base FROM {source} WHERE {known} {f'GROUP BY {keys[:-2]}' if by else ''}),
{name}0 AS (SELECT d.*, s.base AS {f} FROM {source} d JOIN {name}_base s ON {same})"""]
    for k in range(1, params["rounds"] + 1):
        made.append(_split_sql(f"{name}_s{k}", f"{name}{k - 1}", f"{label} - {f}", features, params["cuts"], least, by, known))
        made.append(f"{name}{k} AS (SELECT d.* REPLACE (d.{f} + coalesce({_side_sql('s', features, eta, lambda x: f'd.{x}')}, 0) AS {f}) FROM {name}{k - 1} d LEFT JOIN {name}_s{k} s ON {same})")
    return ",\n".join(made)


# ---------------------------------------------------------------- rows


def _user_model_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with_calendar(add_station_lags(_user_stations(spark, sf_dir), "y", [1, 24], [1, 2], average_name="lag_avg"))


def _with_calendar(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"hour": F.hour("date_time").cast("double"), "weekday": tf.weekday(F.col("date_time")).cast("double")})


_CALENDAR_SQL = "CAST(hour(date_time) AS DOUBLE) AS hour, CAST(isodow(date_time) AS DOUBLE) AS weekday"
MODEL_ROWS = f"""model_rows AS (
  SELECT station_id, date_time, y, l1 AS y_lag1, l2 AS y_lag2, l24 AS y_lag24, l48 AS y_lag48, {_mean_of_two("l1", "l2")} AS lag_avg, {_CALENDAR_SQL}
  FROM (SELECT *, {OBSERVED_LAGS.format("y")}, lag(y, 48) OVER w AS l48 FROM station_hours {BY_STATION}))"""
_CAPPED = ", ".join(f"CASE WHEN {c} > {CAP} THEN {CAP} ELSE {c} END AS {c}" for c in ("y", "y_lag1", "y_lag2", "y_lag24", "y_lag48", "lag_avg"))

# ---------------------------------------------------------------- queries


def two_stage_fit_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two stages of two one-level trees each; the second learns what the first leaves over."""
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax", "l_extendedprice")
    model = fit_staged(items, "l_extendedprice", ["l_quantity", "l_discount"], ["l_discount", "l_tax", "l_quantity"], [], ITEM_STUMPS, ITEM_STUMPS)
    return model.transform(items).select("l_orderkey", "l_linenumber", "pred_stage_1", "pred_stage_2", "pred")


ITEM_STUMPS = {
    "cuts": {"l_quantity": tuple(5.0 * i for i in range(1, 10)), "l_discount": tuple(i / 100 for i in range(10)), "l_tax": tuple(i / 100 for i in range(8))},
    "rounds": 2, "eta": 0.5, "min_rows": 10,
}
TWO_STAGE_FIT_PREDICT = f"""WITH {_boost_sql("first", "lineitem", "l_extendedprice", ("l_quantity", "l_discount"), ITEM_STUMPS)},
left_over AS (SELECT *, l_extendedprice - f AS residual FROM first2),
{_boost_sql("second", "left_over", "residual", ("l_discount", "l_tax", "l_quantity"), ITEM_STUMPS, f="g")}
SELECT l_orderkey, l_linenumber, f AS pred_stage_1, g AS pred_stage_2, CASE WHEN f + g < 0 THEN 0 ELSE f + g END AS pred FROM second2"""


def forecast_t_plus_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two stages trained on the rows before the oldest fold, then all folds of all users forecast in one job, in the stored form."""
    rows, last = _user_model_rows(spark, sf_dir), samples.last_hour(spark, sf_dir)
    cut = folds.fold_cut(last, F.lit(5), 48, 24)
    model = runs.train(folds.train_rows(rows, "date_time", cut, 1), "y", CALENDAR, FEATURES, [], STUMPS, STUMPS, CAP)
    made = runs.forecast_t_plus_k(rows, "y", [1, 24], [1, 2], model.scorer(spark), 5, 48, 24, last=last, average_name="lag_avg")
    return outputs.station_output(made, F.lit(7), F.col("fold_cut"))


def _walked_sql(rows: str, splits: Sequence[str], eta: str, same: str, base: str) -> str:
    """Table <rows>_x: rows with x, all that the prediction of an hour needs beside its lags; the walk reads it."""
    parts = ", ".join(f"'{s}': {{'feature': {s}.feature, 'cut': {s}.cut, 'l': {s}.l, 'r': {s}.r}}" for s in splits)
    joins = " ".join(f"LEFT JOIN {s} ON {same.format(s=s)}" for s in splits)
    return f"""{rows}_x AS (
  SELECT d.* EXCLUDE (y_lag1, y_lag2, y_lag24, y_lag48), y_lag1 AS l1, y_lag2 AS l2, y_lag24 AS l24, y_lag48 AS l48,
    {{'f': f, 'base': {base}, 'hour': hour, 'weekday': weekday, {parts}}} AS m
  FROM {rows} d {joins})"""


def _staged_pred(splits: Sequence[str], eta: str, lags: Sequence[int] = (1, 2, 24), features: Sequence[str] = FEATURES) -> str:
    """Prediction of an hour from x and the used lags: the second stage on top of the first one's f, not below 0."""
    used = {f"y_lag{k}": f"u{k}" for k in lags} | {"lag_avg": f"({_mean_of_two('u1', 'u2')})", "hour": "x.hour", "weekday": "x.weekday"}
    total = "x.base"
    for s in splits:
        total += f" + coalesce({_side_sql(f'x.{s}', features, eta, lambda f: used[f])}, 0)"
    return total


_TWO_ROUNDS = f"""{_boost_sql("first", "history", "y", CALENDAR, STUMPS)},
left_over AS (SELECT *, y - f AS residual FROM first2),
{_boost_sql("second", "left_over", "residual", FEATURES, STUMPS, f="g")}"""
_ETA = f"{STUMPS['eta']}::DOUBLE"


def _first_stage_of(rows: str, splits: Sequence[str], same: str, base: str) -> str:
    """rows with f, the first stage's prediction, which hangs on the calendar alone."""
    total, joins = base, ""
    for s in splits:
        total += f" + coalesce({_side_sql(s, CALENDAR, _ETA, lambda f: f'd.{f}')}, 0)"
        joins += f" LEFT JOIN {s} ON {same.format(s=s)}"
    return f"(SELECT d.*, {total} AS f FROM {rows} d {joins})"


_PRED = f"CASE WHEN x.f + ({_staged_pred(('second_s1', 'second_s2'), _ETA)}) < 0 THEN 0 ELSE x.f + ({_staged_pred(('second_s1', 'second_s2'), _ETA)}) END"
FORECAST_T_PLUS_K = f"""WITH RECURSIVE {USER_STATIONS}, {_folds_sql(5, 48, 24, _last_sql())}, {MODEL_ROWS},
history AS (
  SELECT * REPLACE ({_CAPPED}) FROM model_rows
  WHERE y IS NOT NULL AND date_time <= (SELECT fold_cut FROM folds WHERE fold_id = 5) AND date_time > (SELECT fold_cut FROM folds WHERE fold_id = 5) - INTERVAL 8760 HOUR),
{_TWO_ROUNDS},
test_rows AS (
  SELECT m.*, fold_id, fold_cut, date_diff('hour', fold_cut, date_time) AS h, dense_rank() OVER (PARTITION BY fold_id ORDER BY date_time) - 1 AS step
  FROM {_first_stage_of("model_rows", ("first_s1", "first_s2"), "TRUE", "(SELECT base FROM first_base)")} m JOIN folds ON date_time > fold_cut AND date_time <= fold_end),
{_walked_sql("test_rows", ("second_s1", "second_s2"), _ETA, "TRUE", "(SELECT base FROM second_base)")},
{_walk_sql("test_rows_x", "fold_id, station_id", (1, 2, 24), _PRED, "d.m")}
SELECT 7 AS model_id, CAST(epoch(fold_cut) AS BIGINT) AS date_time_forecast, CAST(epoch(d.date_time) AS BIGINT) AS date_time, d.station_id, k.preds[d.h] AS value
FROM test_rows_x d JOIN walk k ON k.fold_id = d.fold_id AND k.station_id = d.station_id AND k.h = (SELECT max(h) FROM test_rows_x)"""


def cross_validate_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four folds, a model retrained for every two of them; error metrics of each fold over all users."""
    made = runs.cross_validate_in_time(
        _user_model_rows(spark, sf_dir), "y", CALENDAR, FEATURES, [], STUMPS, STUMPS, [1, 24], [1, 2],
        4, 48, 24, 2, 1, prediction_hour=5, cap=CAP, last=samples.last_hour(spark, sf_dir), average_name="lag_avg",
    )
    return _rounded(evaluation.regression_metrics(made, "y", "pred", ["fold_id"]), "rmse", "mae", "r_squared")


_GROUP_ROUNDS = f"""{_boost_sql("first", "history", "y", CALENDAR, STUMPS, by=("grp",))},
left_over AS (SELECT *, y - f AS residual FROM first2),
{_boost_sql("second", "left_over", "residual", FEATURES, STUMPS, by=("grp",), f="g")}"""
CROSS_VALIDATE_TIME = f"""WITH RECURSIVE {USER_STATIONS}, {_folds_sql(4, 48, 24, _last_sql(48))}, {MODEL_ROWS},
grouped AS (SELECT *, (4 - fold_id) // 2 AS grp FROM folds),
history AS (
  SELECT m.* REPLACE ({_CAPPED}), grp FROM model_rows m JOIN grouped ON fold_id = 4 - grp * 2 AND date_time <= fold_cut AND date_time > fold_cut - INTERVAL 8760 HOUR
  WHERE y IS NOT NULL),
{_GROUP_ROUNDS},
in_folds AS (
  SELECT m.*, fold_id, grp, date_diff('hour', fold_cut, date_time) AS h, dense_rank() OVER (PARTITION BY fold_id ORDER BY date_time) - 1 AS step
  FROM model_rows m JOIN grouped ON date_time > fold_cut AND date_time <= fold_end),
test_rows AS (
  SELECT m.*, (SELECT base FROM second_base b WHERE b.grp = m.grp) AS base
  FROM {_first_stage_of("in_folds", ("first_s1", "first_s2"), "{s}.grp = d.grp", "(SELECT base FROM first_base b WHERE b.grp = d.grp)")} m),
{_walked_sql("test_rows", ("second_s1", "second_s2"), _ETA, "{s}.grp = d.grp", "d.base")},
{_walk_sql("test_rows_x", "fold_id, station_id", (1, 2, 24), _PRED, "d.m")},
made AS (
  SELECT d.fold_id, y, k.preds[d.h] AS pred
  FROM test_rows_x d JOIN walk k ON k.fold_id = d.fold_id AND k.station_id = d.station_id AND k.h = (SELECT max(h) FROM test_rows_x) WHERE y IS NOT NULL)
SELECT fold_id, count(*) AS n, round(sqrt(avg((y - pred) * (y - pred))), 6) AS rmse, round(avg(abs(y - pred)), 6) AS mae,
  round(1 - sum((y - pred) * (y - pred)) / nullif(var_pop(y) * count(*), 0), 6) AS r_squared
FROM made WHERE pred IS NOT NULL GROUP BY fold_id"""


def _station_model_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with_calendar(add_station_lags(samples.station_hours(spark, sf_dir), "y", [1, 24], [1, 2], average_name="lag_avg"))


def cross_validate_stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every station predicted by a model of all others, with the id under which that model is registered."""
    made = runs.cross_validate_stations(_station_model_rows(spark, sf_dir), "y", FEATURES, None, [], STUMPS, None, CAP)
    return outputs.left_out_output(made, F.col("model_id"))


_LEFT_OUT_ROUNDS = _boost_sql("fitted", "others", "y", FEATURES, STUMPS, by=("left_out",))
CROSS_VALIDATE_STATIONS = f"""WITH {STATION_HOURS}, {MODEL_ROWS},
known AS (SELECT * FROM model_rows WHERE y IS NOT NULL),
plan AS (SELECT station_id AS left_out, CAST(row_number() OVER (ORDER BY station_id) AS INTEGER) AS model_id FROM (SELECT DISTINCT station_id FROM known)),
others AS (SELECT known.* REPLACE ({_CAPPED}), left_out FROM known JOIN plan ON station_id <> left_out),
{_LEFT_OUT_ROUNDS}
SELECT model_id, CAST(epoch(date_time) AS BIGINT) AS date_time, station_id,
  b.base + coalesce({_side_sql("s1", FEATURES, _ETA, lambda f: f"d.{f}")}, 0) + coalesce({_side_sql("s2", FEATURES, _ETA, lambda f: f"d.{f}")}, 0) AS value
FROM known d JOIN plan ON station_id = left_out JOIN fitted_base b USING (left_out) LEFT JOIN fitted_s1 s1 USING (left_out) LEFT JOIN fitted_s2 s2 USING (left_out)"""

SEARCHED_ROUNDS, PATIENCE, MIN_DELTA = 6, 2, 0.05
STOPPING = {**STUMPS, "rounds": SEARCHED_ROUNDS}


def early_stopping_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both stages with early stopping on the last three days: rounds that were fitted, the best one, and predictions on the days held out."""
    rows = folds.add_holdout_role(_user_model_rows(spark, sf_dir), "date_time", 72, samples.last_hour(spark, sf_dir))
    train, held = rows.where("role = 'train'"), rows.where("role = 'validation'")
    first, best_1 = fit_with_early_stopping(train, held, "y", CALENDAR, [], STOPPING, PATIENCE, MIN_DELTA, block=2)
    model, best_2 = fit_with_early_stopping(train, held, "y", FEATURES, [], STOPPING, PATIENCE, MIN_DELTA, first, block=2)
    fitted = [len(s.splits) for s in (model.first, model.second)]
    return model.transform(held).select(
        "station_id", "date_time", "y", "pred", *[F.lit(v).alias(n) for n, v in zip(("rounds_1", "rounds_2", "best_1", "best_2"), (*fitted, best_1, best_2))]
    )


def _stopping_sql(name: str, label: str, f: str) -> str:
    """Tables <name>_stop (best, rounds) from the errors of each round on held-out rows, and <name>_at with `f` of the last round."""
    errors = " UNION ALL ".join(f"SELECT {k} AS i, sqrt(avg(({label} - {f}) * ({label} - {f}))) AS e FROM {name}{k} WHERE role = 'validation' AND {label} IS NOT NULL" for k in range(1, SEARCHED_ROUNDS + 1))
    whole = " UNION ALL ".join(f"SELECT *, {k} AS i FROM {name}{k}" for k in range(1, SEARCHED_ROUNDS + 1))
    return f"""{name}_errors AS ({errors}),
{name}_walk AS (
  SELECT 0 AS i, CAST('inf' AS DOUBLE) AS best, 0 AS best_round, false AS stopped
  UNION ALL SELECT w.i + 1, CASE WHEN e < best - {MIN_DELTA} THEN e ELSE best END, CASE WHEN e < best - {MIN_DELTA} THEN w.i + 1 ELSE best_round END,
    e >= best - {MIN_DELTA} AND w.i + 1 - best_round >= {PATIENCE} FROM {name}_walk w JOIN {name}_errors x ON x.i = w.i + 1 WHERE NOT stopped),
{name}_stop AS (SELECT i AS rounds, greatest(best_round, 1) AS best FROM {name}_walk ORDER BY i DESC LIMIT 1),
{name}_at AS (SELECT * EXCLUDE (i) FROM ({whole}) WHERE i = (SELECT rounds FROM {name}_stop))"""


EARLY_STOPPING_FIT = f"""WITH RECURSIVE {USER_STATIONS}, {MODEL_ROWS},
rows_ AS (SELECT *, CASE WHEN date_time < {_last_sql()} - INTERVAL 72 HOUR THEN 'train' ELSE 'validation' END AS role FROM model_rows),
{_boost_sql("first", "rows_", "y", CALENDAR, STOPPING, "role = 'train'")},
{_stopping_sql("first", "y", "f")},
left_over AS (SELECT *, y - f AS residual FROM first_at),
{_boost_sql("second", "left_over", "residual", FEATURES, STOPPING, "role = 'train'", f="g")},
{_stopping_sql("second", "residual", "g")}
SELECT station_id, date_time, y, CASE WHEN f + g < 0 THEN 0 ELSE f + g END AS pred, first_stop.rounds AS rounds_1, second_stop.rounds AS rounds_2,
  first_stop.best AS best_1, second_stop.best AS best_2
FROM second_at, first_stop, second_stop WHERE role = 'validation'"""

SEARCH_LAGS = ((1,), (1, 24), (1, 24, 48))
SEARCH_SETS = [{"cuts": CUTS, "eta": eta, "min_rows": least, "rounds": n} for eta in (0.25, 0.75) for least in (20, 400) for n in (1, 2)]
SEARCH_FEATURES = (*CALENDAR, "y_lag1", "y_lag24", "y_lag48", "lag_avg")


def param_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight parameter sets with three sets of own lags over three folds; the worse half gives up after each fold."""
    made = search_parameters(
        _with_calendar(_user_stations(spark, sf_dir)), "y", CALENDAR, [], candidate_table(SEARCH_SETS, SEARCH_LAGS), samples.last_hour(spark, sf_dir),
        3, 48, 24, 1, 1, 48, [1, 2], cap=CAP, patience=1, average_name="lag_avg", workers=8,
    )
    return _rounded(made, "avg_rmse")


_CANDIDATES = ", ".join(
    f"({i * len(SEARCH_LAGS) + j}, {list(lags)}, {p['eta']}::DOUBLE, {p['min_rows']}, {p['rounds']}, {[k for k, f in enumerate(SEARCH_FEATURES) if not f.startswith('y_lag') or int(f[5:]) in lags]})"
    for i, p in enumerate(SEARCH_SETS) for j, lags in enumerate(SEARCH_LAGS)
)
_ONE_OF_BOTH = "CASE WHEN x.rounds >= {k} THEN coalesce({side}, 0) ELSE 0 END"
_SEARCH_USED = {"y_lag1": "u1", "y_lag24": "u24", "y_lag48": "u48", "lag_avg": f"({_mean_of_two('u1', 'u2')})", "hour": "x.hour", "weekday": "x.weekday"}
_SEARCH_PRED = "x.base + " + " + ".join(
    _ONE_OF_BOTH.format(k=k, side=_side_sql(f"x.s{k}", SEARCH_FEATURES, "x.eta", lambda f: _SEARCH_USED[f])) for k in (1, 2)
)
_SEARCH_KEYS = ("candidate", "fold_id")


def _search_split(k: int, label: str) -> str:
    return _split_sql(
        f"s{k}", f"fit{k - 1}", f"{label} - f", SEARCH_FEATURES, CUTS, "(SELECT min_rows FROM candidates c WHERE c.candidate = {n}.candidate)".format(n=f"s{k}_sides"),
        _SEARCH_KEYS, "part = 'train'", f"list_contains((SELECT listed FROM candidates c WHERE c.candidate = s{k}_sides.candidate), feature)",
    )


def _kept(rung: int, source: str) -> str:
    return f"""kept{rung} AS (
  SELECT candidate FROM (
    SELECT candidate, row_number() OVER (ORDER BY round(avg(rmse), 9), candidate) AS place, count(*) OVER () AS n
    FROM scored WHERE fold_id > {3 - rung} AND candidate IN (SELECT candidate FROM {source}) GROUP BY candidate)
  WHERE place <= (n + 1) // 2)"""


PARAM_SEARCH = f"""WITH RECURSIVE {USER_STATIONS}, {_folds_sql(3, 48, 24, _last_sql())}, {MODEL_ROWS},
candidates AS (SELECT * FROM (VALUES {_CANDIDATES}) v(candidate, lags, eta, min_rows, rounds, listed)),
history AS (
  SELECT m.* REPLACE ({_CAPPED}), fold_id, CASE WHEN date_time < fold_cut - INTERVAL 48 HOUR THEN 'train' ELSE 'held' END AS part
  FROM model_rows m JOIN folds ON date_time <= fold_cut AND date_time > fold_cut - INTERVAL 8760 HOUR WHERE y IS NOT NULL),
bases AS (
  SELECT fold_id, CAST(sum(CAST(floor(y * {UNIT}.0::DOUBLE + 0.5::DOUBLE) AS BIGINT)) AS DOUBLE) / CAST(count(y) AS DOUBLE) / {UNIT} AS base
  FROM history WHERE part = 'train' GROUP BY fold_id),
fit0 AS (SELECT h.*, candidate, eta, base AS f FROM history h JOIN bases USING (fold_id) CROSS JOIN candidates),
{_search_split(1, "y")},
fit1 AS (
  SELECT d.* REPLACE (d.f + coalesce({_side_sql("s", SEARCH_FEATURES, "d.eta", lambda f: f"d.{f}")}, 0) AS f)
  FROM fit0 d LEFT JOIN s1 s ON s.candidate = d.candidate AND s.fold_id = d.fold_id),
{_search_split(2, "y")},
fit2 AS (
  SELECT d.* REPLACE (d.f + coalesce({_side_sql("s", SEARCH_FEATURES, "d.eta", lambda f: f"d.{f}")}, 0) AS f)
  FROM fit1 d LEFT JOIN s2 s ON s.candidate = d.candidate AND s.fold_id = d.fold_id),
error1 AS (SELECT candidate, fold_id, sqrt(avg((y - f) * (y - f))) AS e FROM fit1 WHERE part = 'held' GROUP BY ALL),
error2 AS (SELECT candidate, fold_id, sqrt(avg((y - f) * (y - f))) AS e FROM fit2 WHERE part = 'held' GROUP BY ALL),
best AS (
  SELECT candidate, fold_id, CASE WHEN rounds = 2 AND error2.e < error1.e - {MIN_DELTA} THEN 2 ELSE 1 END AS best_iteration
  FROM error1 JOIN error2 USING (candidate, fold_id) JOIN candidates USING (candidate)),
test_rows AS (
  SELECT m.* EXCLUDE (y_lag1, y_lag2, y_lag24, y_lag48), y_lag1 AS l1, y_lag2 AS l2, y_lag24 AS l24, y_lag48 AS l48, fold_id, candidate,
    date_diff('hour', fold_cut, date_time) AS h, dense_rank() OVER (PARTITION BY fold_id, candidate ORDER BY date_time) - 1 AS step,
    {{'base': base, 'eta': eta, 'rounds': rounds, 'hour': hour, 'weekday': weekday, 's1': {{'feature': s1.feature, 'cut': s1.cut, 'l': s1.l, 'r': s1.r}},
      's2': {{'feature': s2.feature, 'cut': s2.cut, 'l': s2.l, 'r': s2.r}}}} AS m
  FROM model_rows m JOIN folds ON date_time > fold_cut AND date_time <= fold_end JOIN bases USING (fold_id) CROSS JOIN candidates
    LEFT JOIN s1 USING (candidate, fold_id) LEFT JOIN s2 USING (candidate, fold_id)),
{_walk_sql("test_rows", "candidate, fold_id, station_id", (1, 2, 24, 48), _SEARCH_PRED, "d.m")},
scored AS (
  SELECT d.candidate, d.fold_id, sqrt(avg((y - k.preds[d.h]) * (y - k.preds[d.h]))) AS rmse
  FROM test_rows d JOIN walk k ON k.candidate = d.candidate AND k.fold_id = d.fold_id AND k.station_id = d.station_id AND k.h = (SELECT max(h) FROM test_rows)
  WHERE y IS NOT NULL AND k.preds[d.h] IS NOT NULL GROUP BY ALL),
{_kept(1, "candidates")},
{_kept(2, "kept1")}
SELECT candidate, 1 AS stage, lags, CAST(count(*) AS INTEGER) AS n_folds, round(avg(rmse), 6) AS avg_rmse, CAST(floor(quantile_cont(best_iteration, 0.75)) AS INTEGER) AS best_iteration
FROM scored JOIN best USING (candidate, fold_id) JOIN candidates USING (candidate)
WHERE fold_id = 3 OR (fold_id = 2 AND candidate IN (SELECT candidate FROM kept1)) OR (fold_id = 1 AND candidate IN (SELECT candidate FROM kept2))
GROUP BY candidate, lags"""

def registered_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model is trained, registered and promoted; the final one is looked up, loaded and predicts every labelled row of all users."""
    rows, root = _user_model_rows(spark, sf_dir).select("station_id", "date_time", "y", *FEATURES), scratch_path(spark, "registered")
    for name in ("temporal_a", "temporal_b"):
        runs.train_and_register(
            spark, rows, "y", CALENDAR, FEATURES, [], STUMPS, STUMPS, [1, 24], [1, 2], name, 1, f"{root}/registry", f"{root}/models", CAP,
            f"{root}/final" if name.endswith("b") else None, "temporal",
        )
    known = spark.read.schema(registry.REGISTRY_SCHEMA).parquet(f"{root}/registry")
    chosen = spark.read.parquet(f"{root}/final").select(F.max("model_id")).first()[0]
    row = registry.model_row(known, chosen)
    model = StagedModel.load(row.model_path, row.features_1, row.features_2, row.categorical)
    settings = registry.model_settings(known).where(F.col("model_id") == chosen).first()
    said = [F.lit(chosen).alias("model_id"), *[F.lit(settings[c]).alias(c) for c in ("lags", "lags_avg", "max_training_date_model_2")]]
    return model.transform(rows.where("y IS NOT NULL")).select("station_id", "date_time", "pred", *said)


REGISTERED_MODEL = f"""WITH {USER_STATIONS}, {MODEL_ROWS},
known AS (SELECT * FROM model_rows WHERE y IS NOT NULL),
history AS (SELECT * REPLACE ({_CAPPED}) FROM known),
{_TWO_ROUNDS}
SELECT 2 AS model_id, station_id, date_time, [1, 24] AS lags, [1, 2] AS lags_avg, (SELECT strftime(max(date_time), '%Y-%m-%d %H:%M:%S') FROM known) AS max_training_date_model_2,
  CASE WHEN f + g < 0 THEN 0 ELSE f + g END AS pred
FROM (
  SELECT d.station_id, d.date_time, fb.base + coalesce({_side_sql("a", CALENDAR, _ETA, lambda f: f"d.{f}")}, 0) + coalesce({_side_sql("b", CALENDAR, _ETA, lambda f: f"d.{f}")}, 0) AS f,
    sb.base + coalesce({_side_sql("c", FEATURES, _ETA, lambda f: f"d.{f}")}, 0) + coalesce({_side_sql("e", FEATURES, _ETA, lambda f: f"d.{f}")}, 0) AS g
  FROM known d CROSS JOIN first_base fb CROSS JOIN second_base sb LEFT JOIN first_s1 a ON TRUE LEFT JOIN first_s2 b ON TRUE LEFT JOIN second_s1 c ON TRUE LEFT JOIN second_s2 e ON TRUE)"""

ATTRIBUTED = {**STUMPS, "rounds": 4}


def attribution_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of a model of four one-level trees by mean absolute attribution, and the error that the sampled orders leave (none, as the model adds up)."""
    rows = _user_model_rows(spark, sf_dir).select("y", *FEATURES)
    scorer = fit_staged(rows, "y", FEATURES, None, [], ATTRIBUTED).scorer(spark)
    made = attribution.attribute_batches(rows, FEATURES, scorer, attribution.feature_means(rows, FEATURES), pairs=2)
    return _rounded(attribution.attribution_errors(made, FEATURES), "importance", "error")


def _attributed(f: str) -> str:
    terms = []
    for k in range(1, ATTRIBUTED["rounds"] + 1):
        sides = [f"CASE WHEN {x} <= s{k}.cut THEN s{k}.l * {_ETA} ELSE s{k}.r * {_ETA} END" for x in (f"d.{f}", f"b.{f}")]
        terms.append(f"CASE WHEN s{k}.feature = '{f}' THEN ({sides[0]}) - ({sides[1]}) ELSE 0 END")
    return " + ".join(terms)


_ATTRIBUTED_JOINS = "".join(f" CROSS JOIN tree_s{k} s{k}" for k in range(1, ATTRIBUTED["rounds"] + 1))
ATTRIBUTION_TREES = f"""WITH {USER_STATIONS}, {MODEL_ROWS},
{_boost_sql("tree", "model_rows", "y", FEATURES, ATTRIBUTED)},
background AS (SELECT {", ".join(f"avg({f}) AS {f}" for f in FEATURES)} FROM model_rows),
phi AS (SELECT {", ".join(f"abs({_attributed(f)}) AS {f}" for f in FEATURES)} FROM model_rows d CROSS JOIN background b{_ATTRIBUTED_JOINS})
{" UNION ALL ".join(f"SELECT '{f}' AS feature, round(avg({f}), 6) AS importance, 0.0::DOUBLE AS error FROM phi" for f in FEATURES)}"""

QUERIES = {
    "registered_model": (registered_model, REGISTERED_MODEL),
    "attribution_trees": (attribution_trees, ATTRIBUTION_TREES),
    "two_stage_fit_predict": (two_stage_fit_predict, TWO_STAGE_FIT_PREDICT),
    "forecast_t_plus_k": (forecast_t_plus_k, FORECAST_T_PLUS_K),
    "cross_validate_time": (cross_validate_time, CROSS_VALIDATE_TIME),
    "cross_validate_stations": (cross_validate_stations, CROSS_VALIDATE_STATIONS),
    "early_stopping_fit": (early_stopping_fit, EARLY_STOPPING_FIT),
    "param_search": (param_search, PARAM_SEARCH),
}
