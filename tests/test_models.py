"""Fitted models: one-level trees, boosting in blocks, search that gives up, pooled validation, attribution."""

import itertools
import math
import random
import threading

import numpy as np
import pytest
from conftest import hourly
from pyspark.sql import functions as F

from hourloom.functions.timefns import ntz
from hourloom.operators import attribution, search, stumps, training
from hourloom.operators.pool import in_pool
from hourloom.operators.scoring import LinearScorer, StagedScorer
from hourloom.operators.stumps import Split, StumpModel
from hourloom.plans import runs
from hourloom.sources.registry import REGISTRY_SCHEMA

CUTS = {"x": [2.0, 4.0, 6.0, 8.0], "z": [-0.5, 0.0, 0.5]}


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(1)
    made = [(rng.choice("abc"), rng.uniform(0, 10), rng.choice([None, rng.uniform(-1, 1)])) for _ in range(500)]
    return [(k, x, z, (x > 5) * 4 + ord(k) % 3 + (z or 0) * x + rng.gauss(0, 1)) for k, x, z in made] + [("a", 1.0, 0.1, None)]


@pytest.fixture(scope="module")
def df(spark, rows):
    return spark.createDataFrame(rows, "kind STRING, x DOUBLE, z DOUBLE, y DOUBLE").cache()


# --- one-level trees


def plain_stumps(rows, cuts, rounds, eta, min_rows):
    known = [r for r in rows if r["y"] is not None]
    unit = lambda v: math.floor(v * 1e6 + 0.5)
    base = float(sum(unit(r["y"]) for r in known)) / len(known) / 1e6
    fitted, splits = [base] * len(known), []
    for _ in range(rounds):
        best = None
        for f, cut in ((f, c) for f in cuts for c in cuts[f]):
            sides = [[unit(r["y"] - p) for r, p in zip(known, fitted) if (r[f] is not None and r[f] <= cut) is left] for left in (True, False)]
            if min(map(len, sides)) < min_rows:
                continue
            gain = sum(float(sum(s)) ** 2 / len(s) for s in sides)
            if best is None or gain > best[0] * (1 + 1e-12):
                best = (gain, Split(f, cut, *(float(sum(s)) / len(s) / 1e6 * eta for s in sides)))
        if best is None:
            break
        splits.append(best[1])
        fitted = [p + (best[1].left if r[best[1].feature] is not None and r[best[1].feature] <= best[1].cut else best[1].right) for r, p in zip(known, fitted)]
    return base, splits


@pytest.mark.parametrize("min_rows", [1, 120, 400])
def test_stumps_equal_a_plain_search(spark, df, rows, min_rows, tmp_path):
    model = stumps.fit_stumps(df, "y", ["x", "z"], CUTS, 4, 0.3, min_rows)
    base, splits = plain_stumps([dict(zip(("kind", "x", "z", "y"), r)) for r in rows], CUTS, 4, 0.3, min_rows)
    assert model.base == pytest.approx(base) and [(s.feature, s.cut) for s in model.splits] == [(s.feature, s.cut) for s in splits]
    assert np.allclose([(s.left, s.right) for s in model.splits], [(s.left, s.right) for s in splits])
    held = model.transform(df).toPandas()
    scored = model.score({f: held[f].to_numpy() for f in ("x", "z")})
    assert (scored == held["__prediction"]).all() and model.features == ["x", "z"]
    model.save(spark, str(tmp_path / "m"))
    assert StumpModel.load(spark, str(tmp_path / "m")) == model


def test_stumps_of_nothing(spark):
    none = spark.createDataFrame([], "x DOUBLE, y DOUBLE")
    assert stumps.fit_stumps(none, "y", ["x"], {"x": [1.0]}, 3) == StumpModel(0.0, (), ("x",))


def test_staged_stumps_are_stored_and_read_back(spark, df, tmp_path):
    params = {"cuts": CUTS, "rounds": 2, "eta": 0.5}
    model = training.fit_staged(df, "y", ["x"], ["x", "z"], [], params, params)
    model.save(str(tmp_path / "m"))
    again = training.StagedModel.load(str(tmp_path / "m"), ["x"], ["x", "z"], [])
    assert again == model and isinstance(again.scorer(spark), StagedScorer)
    assert again.transform(df).where("pred < 0").isEmpty()


# --- boosting in blocks


@pytest.mark.parametrize("block", [1, 3, 20])
def test_blocks_stop_and_equal_the_full_fit(spark, rows, block):
    schema, features = "kind STRING, x DOUBLE, z DOUBLE, y DOUBLE", ["kind", "x", "z"]
    train, held = spark.createDataFrame(rows[:350], schema), spark.createDataFrame(rows[350:], schema)
    params = {"maxIter": 14, "maxDepth": 3, "stepSize": 0.4}
    full = training.stage_pipeline(features, ["kind"], "y", params).fit(train)
    prepared = held.where("y IS NOT NULL")
    for stage in full.stages[:-1]:
        prepared = stage.transform(prepared)
    errors = [e**0.5 for e in full.stages[-1].evaluateEachIteration(prepared, "squared")]
    best, stop = training.best_iteration(errors, 2, 0.02), training.stopped_at(errors, 2, 0.02)
    assert 0 < stop < 14
    model, rounds = training.fit_with_early_stopping(train, held, "y", features, ["kind"], params, 2, 0.02, block=block)
    kept = model.first.stages[-1]
    assert rounds == best and kept.getNumTrees == stop == best + 2
    found = model.transform(held.where("y IS NOT NULL")).select(F.sqrt(F.avg(F.pow(F.col("y") - F.col("pred"), 2)))).first()[0]
    assert found == pytest.approx(errors[stop - 1], rel=1e-9)


def test_no_round_is_fitted_after_the_block_that_stops(spark, rows, monkeypatch):
    schema = "kind STRING, x DOUBLE, z DOUBLE, y DOUBLE"
    train, held = spark.createDataFrame(rows[:350], schema), spark.createDataFrame(rows[350:], schema)
    grown = []
    grow = training._StumpRounds.grow
    monkeypatch.setattr(training._StumpRounds, "grow", lambda self, n: grown.append(n) or grow(self, n))
    params = {"cuts": CUTS, "rounds": 40, "eta": 0.9}
    model, best = training.fit_with_early_stopping(train, held, "y", ["x", "z"], [], params, 3, 0.05, block=4)
    assert sum(grown) <= best + 3 + 4 < 40 and len(model.first.splits) == best + 3


def test_assembled_vectors_are_kept_while_trees_are_fitted(df, monkeypatch):
    fit, held = training.GBTRegressor._fit, []
    monkeypatch.setattr(training.GBTRegressor, "_fit", lambda self, rows: held.append((rows, rows.storageLevel.useDisk)) or fit(self, rows))
    trees = {"maxIter": 2, "maxDepth": 2}
    model = training.fit_staged(df, "y", ["x"], ["kind", "x", "z"], ["kind"], trees, trees)
    assert [kept for _, kept in held] == [True, True] and not any(rows.storageLevel.useDisk for rows, _ in held)
    # The same models as the whole pipeline fits.
    rows = training.training_set(df, "y", ["x", "kind", "z"])
    left = model.first.transform(rows).withColumn("__residual", F.col("y") - F.col("__prediction")).select("__residual", "kind", "x", "z")
    for data, label, features, stage in ((rows, "y", ["x"], model.first), (left, "__residual", ["kind", "x", "z"], model.second)):
        whole = training.stage_pipeline(features, ["kind"], label, trees).fit(data)
        assert whole.stages[-1].toDebugString.split("\n")[1:] == stage.stages[-1].toDebugString.split("\n")[1:]


# --- search


def test_survivors_are_the_lower_half():
    assert search.survivors({0: [3.0], 1: [1.0], 2: [2.0]}) == [1, 2]
    assert search.survivors({4: [1.0], 3: [1.0], 2: [1.0], 1: [2.0]}) == [2, 3]
    assert search.survivors({7: [], 8: [5.0]}) == [8] and search.survivors({1: [1.0]}) == [1]


@pytest.fixture(scope="module")
def series(spark):
    rng = random.Random(2)
    data = [(s, t, (i * 7 % 24) + rng.gauss(0, 3) + 5 * k, float(i % 24)) for k, s in enumerate("ab") for i, t in enumerate(hourly("2022-01-01 00:00:00", 300))]
    return spark.createDataFrame(data, "station_id STRING, date_time TIMESTAMP_NTZ, y DOUBLE, h DOUBLE").cache()


def test_search_gives_up_the_worse_half_and_equals_a_plain_loop(series, monkeypatch):
    levels = [float(v) for v in range(0, 40, 4)]
    cuts = {"h": [float(v) for v in range(24)], "y_lag1": levels, "y_lag24": levels, "avg": levels}
    sets = [{"cuts": cuts, "eta": eta, "rounds": n} for eta in (0.2, 0.8) for n in (1, 6)]
    table = search.candidate_table(sets, [(1,), (1, 24)])
    assert [(c.number, c.lags) for c in table[:3]] == [(0, (1,)), (1, (1, 24)), (2, (1,))]
    fits, fit = [], search.fit_with_early_stopping
    monkeypatch.setattr(search, "fit_with_early_stopping", lambda *a, **k: fits.append(1) or fit(*a, **k))
    given = ("y", ["h"], [], table, ntz("2022-01-13 11:00:00"), 3, 24, 24, 1, 1, 24, [1, 2])
    whole = {r["candidate"]: r for r in search.search_parameters(series, *given, patience=2, average_name="avg", prune=False).collect()}
    assert len(fits) == 3 * 8 and {r["n_folds"] for r in whole.values()} == {3}
    # The plain loop: one candidate and one fold at a time.
    alone = {}
    for c in table:
        for folds in (1, 2):
            only = search.search_parameters(series, "y", ["h"], [], [c], ntz("2022-01-13 11:00:00") - F.expr(f"INTERVAL {24 * (3 - folds)} HOUR"), folds, 24, 24, 1, 1, 24, [1, 2], patience=2, average_name="avg").first()
            alone[c.number, folds] = only["avg_rmse"]
        alone[c.number, 3] = whole[c.number]["avg_rmse"]
    left, want = [c.number for c in table], {}
    for folds in (1, 2, 3):
        want |= {n: (folds, alone[n, folds]) for n in left}
        left = sorted(sorted(left, key=lambda n: (round(alone[n, folds], 9), n))[: (len(left) + 1) // 2])
    fits.clear()
    got = search.search_parameters(series, *given, patience=2, average_name="avg", workers=3).collect()
    assert len(fits) == 8 + 4 + 2
    assert {r["candidate"]: r["n_folds"] for r in got} == {n: f for n, (f, _) in want.items()}
    assert all(r["avg_rmse"] == pytest.approx(want[r["candidate"]][1], rel=1e-9) for r in got)


def test_a_search_over_more_candidates_needs_no_more_passes(spark, series):
    """Candidates of one-level trees share their rows, counts and forecasts; those of other cuts of a feature are a set of their own."""
    cuts = {"h": [6.0, 12.0, 18.0], "y_lag1": [5.0, 10.0, 20.0], "y_lag24": [5.0, 10.0, 20.0], "avg": [5.0, 10.0, 20.0]}
    context, jobs, made = spark.sparkContext, {}, {}
    for n in (1, 6):
        sets = [{"cuts": cuts, "eta": 0.1 + i / 10, "rounds": 2, "min_rows": 5} for i in range(n)]
        table = search.candidate_table(sets, [(1,), (1, 24)])
        context.setJobGroup(f"search-{n}", "")
        found = search.search_parameters(series, "y", ["h"], [], table, ntz("2022-01-13 11:00:00"), 1, 24, 24, 1, 1, 24, [1], average_name="avg")
        jobs[n] = len(context.statusTracker().getJobIdsForGroup(f"search-{n}"))
        made[n] = {(r["candidate"], tuple(r["lags"])): r["avg_rmse"] for r in found.collect()}
    context.setLocalProperty("spark.jobGroup.id", None)
    assert len(made[6]) == 12 and jobs[6] <= jobs[1] + 2
    assert {k: made[6][k] for k in made[1]} == pytest.approx(made[1])
    other = [search.Candidate(0, {"cuts": cuts}, (1,)), search.Candidate(1, {"cuts": {**cuts, "h": [3.0]}}, (1,)), search.Candidate(2, {"cuts": cuts}, (1, 24)), search.Candidate(3, {"maxIter": 2}, (1,))]
    alone, sets = search.shareable(other, lambda c: ["h", *(f"y_lag{k}" for k in c.lags)])
    assert [c.number for c in alone] == [3] and [[c.number for c in s] for s in sets] == [[0, 2], [1]]


def test_search_of_the_second_stage(spark, series):
    cuts = {"h": [6.0, 12.0, 18.0], "y_lag1": [5.0, 10.0, 20.0], "avg": [5.0, 10.0, 20.0]}
    first = training.fit_staged(series, "y", ["h"], params_1={"cuts": cuts, "rounds": 3})
    table = search.candidate_table([{"cuts": cuts, "rounds": 3}, {"maxIter": 2, "maxDepth": 2}], [(1,)], stage=2)
    got = search.search_parameters(series, "y", ["h"], [], table, ntz("2022-01-13 11:00:00"), 2, 24, 24, 2, 1, 24, [1], average_name="avg", first=first, prune=False).collect()
    assert {(r["candidate"], r["stage"], r["n_folds"]) for r in got} == {(0, 2, 2), (1, 2, 2)}


# --- pooled fits


def test_pool_bounds_its_workers_and_raises(spark):
    at_once, most, lock = [0], [0], threading.Lock()

    def job(i):
        with lock:
            at_once[0] += 1
            most[0] = max(most[0], at_once[0])
        n = spark.range(i).count()
        with lock:
            at_once[0] -= 1
        return n

    assert in_pool(spark, [lambda i=i: job(i) for i in range(12)], 3) == list(range(12)) and 1 < most[0] <= 3
    with pytest.raises(ZeroDivisionError):
        in_pool(spark, [lambda: 1 / 0, lambda: 1], 2)


def test_left_out_stations_resume_where_they_stopped(spark, series, tmp_path, monkeypatch):
    more = series.union(series.where("station_id = 'a'").withColumn("station_id", F.lit("c")).withColumn("y", F.col("y") + 9))
    params, path, fitted, train = {"cuts": {"h": [6.0, 12.0, 18.0]}, "rounds": 2}, str(tmp_path / "run"), [], runs.train

    def stopping(df, *args):
        fitted.append(sorted(r[0] for r in df.select("station_id").distinct().collect()))
        if len(fitted) == 2:
            raise RuntimeError("the driver is lost")
        return train(df, *args)

    monkeypatch.setattr(runs, "train", stopping)
    with pytest.raises(RuntimeError):
        runs.cross_validate_stations(more, "y", ["h"], None, [], params, None, path=path, workers=1)
    got = runs.cross_validate_stations(more, "y", ["h"], None, [], params, None, path=path, workers=2)
    done = len(fitted)
    assert sorted(map(tuple, fitted[2:])) == [("a", "b"), ("a", "c")] and fitted[0] == ["b", "c"]
    assert {(r.station_id, r.model_id): r["count"] for r in got.groupBy("station_id", "model_id").count().collect()} == {("a", 1): 300, ("b", 2): 300, ("c", 3): 300}
    models = spark.read.schema(REGISTRY_SCHEMA).parquet(f"{path}/registry").collect()
    assert sorted((r.model_id, r.model_name) for r in models) == [(1, "left out a"), (2, "left out b"), (3, "left out c")]
    stored = training.StagedModel.load(f"{path}/models/2", ["h"], None, [])
    want = train(more.where("station_id <> 'b'"), "y", ["h"], None, [], params, None)
    assert stored == want
    again = runs.cross_validate_stations(more, "y", ["h"], None, [], params, None, path=path)
    assert len(fitted) == done and again.count() == 900


# --- attribution


def test_attribution_in_batches(spark):
    # Cut off at 0, the features interact.
    scorer = StagedScorer(LinearScorer({"a": 1.0, "b": -1.5}), LinearScorer({"c": 2.0}, 0.5))
    rng = random.Random(3)
    data = [tuple(rng.uniform(-2, 2) for _ in range(3)) for _ in range(60)]
    df = spark.createDataFrame(data, "a DOUBLE, b DOUBLE, c DOUBLE").repartition(3)
    names, background = scorer.features, {"a": 0.5, "b": -1.0, "c": 0.25}
    made = attribution.attribute_batches(df, names, scorer, {f: F.lit(v) for f, v in background.items()}, pairs=40)
    assert made._jdf.queryExecution().executedPlan().toString().count("MapInPandas") == 1
    score = lambda r: float(scorer.score({f: np.array([r[f]]) for f in names})[0])
    off = []
    for r in made.collect():
        own = {f: r[f] for f in names}
        assert sum(r[f"phi_{f}"] for f in names) == pytest.approx(score(own) - score(background))
        for f in names:
            exact = 0.0
            for order in itertools.permutations(names):
                before = {g: own[g] if order.index(g) < order.index(f) else background[g] for g in names}
                exact += (score({**before, f: own[f]}) - score(before)) / 6
            off.append(abs(r[f"phi_{f}"] - exact) <= 4 * r[f"se_{f}"] + 1e-9)
    assert sum(off) >= 0.9 * len(off)
    ranked = attribution.attribution_errors(made, names).collect()
    assert [r["importance"] for r in ranked] == sorted((r["importance"] for r in ranked), reverse=True) and all(r["error"] >= 0 for r in ranked)
    assert attribution.attribute_batches(df.limit(0), names, scorer, {f: F.lit(0.0) for f in names}).count() == 0
