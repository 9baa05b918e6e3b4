"""Search over parameter and lag sets by rolling-origin validation, giving up the worse half from fold to fold."""

from __future__ import annotations

import math
import random
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hourloom.functions.params import LAG_OPTIONS, lag_average_name, lag_name
from hourloom.functions.timefns import hours
from hourloom.operators.cleaning import cap_for_training
from hourloom.operators.evaluation import fold_scores, regression_metrics
from hourloom.operators.folds import add_retrain_group, add_step, fold_cut, rolling_test_rows, train_rows
from hourloom.operators.forecast import recursive_forecast, recursive_forecasts
from hourloom.operators.lags import add_station_lags
from hourloom.operators.pool import in_pool
from hourloom.operators.scoring import StagedScorer
from hourloom.operators.training import StagedModel, binned_rows, count_together, fit_with_early_stopping
from hourloom.session import store
from hourloom.sources.merge import by_content, latest_per_key


def sample_parameters(space: Mapping[str, tuple], n: int, seed: int = 123, start_with: dict | None = None) -> list[dict]:
    """n parameter sets; integer bounds are drawn uniformly, float bounds on a log scale. Known good ones come first."""
    draw = random.Random(seed)
    sets = [] if start_with is None else [{k: start_with[k] for k in space}]
    while len(sets) < n:
        chosen = {}
        for name, (low, high) in space.items():
            if isinstance(low, int) and isinstance(high, int):
                chosen[name] = draw.randint(low, high)
            else:
                chosen[name] = math.exp(draw.uniform(math.log(low), math.log(high)))
        sets.append(chosen)
    return sets


def sample_lag_sets(n: int, seed: int = 123, offered: Sequence[tuple[int, ...]] = LAG_OPTIONS) -> list[tuple[int, ...]]:
    """The default set of own lags, then others in a seeded order; at most as many as there are."""
    others = [lags for lags in offered[1:]]
    random.Random(seed).shuffle(others)
    return [offered[0], *others][:n]


@dataclass(frozen=True)
class Candidate:
    """A row of the search table: a parameter set with a set of own lags, tried at a stage."""

    number: int
    params: dict
    lags: tuple[int, ...]
    stage: int = 1


def candidate_table(parameter_sets: Sequence[dict], lag_sets: Sequence[Sequence[int]], stage: int = 1) -> list[Candidate]:
    """Every parameter set with every lag set."""
    pairs = [(params, tuple(lags)) for params in parameter_sets for lags in lag_sets]
    return [Candidate(i, params, lags, stage) for i, (params, lags) in enumerate(pairs)]


def survivors(scores: Mapping[int, Sequence[float]]) -> list[int]:
    """Candidates whose mean error so far is not above the median, lower half rounded up; equal ones by number."""
    ranked = sorted(scores, key=lambda n: (round(sum(scores[n]) / len(scores[n]), 9) if scores[n] else math.inf, n))
    return sorted(ranked[: (len(ranked) + 1) // 2])


def shareable(candidates: Sequence[Candidate], features: Callable[[Candidate], Sequence[str]]) -> tuple[list[Candidate], list[list[Candidate]]]:
    """Candidates that are fitted alone, and sets of those of one-level trees at one stage with the same cuts of every feature."""
    alone, sets = [], []
    for c in candidates:
        if "cuts" not in c.params:
            alone.append(c)
            continue
        cuts = {f: tuple(c.params["cuts"][f]) for f in features(c)}
        for known, members in sets:
            if members[0].stage == c.stage and all(known.get(f, own) == own for f, own in cuts.items()):
                known.update(cuts)
                members.append(c)
                break
        else:
            sets.append((cuts, [c]))
    return alone, [members for _, members in sets]


def search_parameters(
    df: DataFrame,
    target: str,
    features: Sequence[str],
    categorical: Sequence[str],
    candidates: Sequence[Candidate],
    last: Column,
    n_folds: int,
    test_hours: int,
    step_hours: int,
    retrain_every: int,
    train_years: float,
    validation_hours: int,
    lags_avg: Sequence[int],
    cap: float | None = None,
    patience: int = 20,
    min_delta: float = 0.05,
    station: str = "station_id",
    time: str = "date_time",
    average_name: str | None = None,
    first: StagedModel | None = None,
    prune: bool = True,
    workers: int = 4,
) -> DataFrame:
    """Score table, one row per candidate: folds it was scored on, mean RMSE over them and the rounds to use.

    Folds are the rungs, oldest first, a retraining group at a time. After a group the candidates above the median of the mean errors so far
    give up: they are not fitted on later groups, so a search over many costs little more than the last ones' folds. Without
    `prune` all go to the end. The rows are written once for all candidates and groups, with the lags of all of them. `features` are
    those beside the own lags and their average; stage 2 learns what `first` leaves over. Candidates of one-level trees share the
    prepared training rows of a group, count on them together, and are forecast together, so a group costs a few passes over its rows
    however many they are. Other fits of a group run a few at a time.
    """
    spark = df.sparkSession
    unique = latest_per_key(df, [station, time], by_content(df, [station, time]))
    every = sorted({k for c in candidates for k in c.lags})
    lagged = store(add_station_lags(unique, target, every, lags_avg, station, time, average_name), "lagged-rows")
    average = [average_name or lag_average_name(lags_avg)] if lags_avg else []
    tests = rolling_test_rows(lagged, time, n_folds, test_hours, step_hours, last=last)
    tests = store(add_retrain_group(add_step(tests, time), n_folds, retrain_every), "test-rows")
    scores: dict[int, list[float]] = {c.number: [] for c in candidates}
    results: list[tuple[int, int, float, int]] = []
    left = list(candidates)
    groups = (n_folds - 1) // retrain_every + 1
    for group in range(groups):
        cut = fold_cut(last, F.lit(n_folds - group * retrain_every), test_hours, step_hours)
        history = train_rows(lagged, time, cut, train_years)
        if cap is not None:
            history = cap_for_training(history, target, cap)
        held_from = cut - hours(validation_hours)
        train, held = history.where(F.col(time) < held_from), history.where(F.col(time) >= held_from)
        group_tests = tests.where(F.col("train_group") == group)

        def own_features(c: Candidate) -> list[str]:
            return [*features, *(lag_name(target, k) for k in c.lags), *average]

        def fit(c: Candidate, binned=None) -> tuple[StagedModel, int]:
            staged = first if c.stage == 2 else None
            return fit_with_early_stopping(train, held, target, own_features(c), categorical, c.params, patience, min_delta, staged, binned=binned)

        def score(c: Candidate) -> list[tuple[int, int, float, int]]:
            model, rounds = fit(c)
            forecast = recursive_forecast(
                group_tests, target, c.lags, lags_avg, model.scorer(spark), ["fold_id", station], time, keep=[target], average_name=average_name,
            )
            scored = regression_metrics(forecast, target, "pred", ["fold_id"]).collect()  # one row per fold
            return [(c.number, r["fold_id"], r["rmse"], rounds) for r in sorted(scored, key=lambda r: -r["fold_id"])]

        def score_together(alike: Sequence[Candidate]) -> list[tuple[int, int, float, int]]:
            staged = first if alike[0].stage == 2 else None
            cuts = {f: c.params["cuts"][f] for c in alike for f in own_features(c)}
            binned = binned_rows(train, held, target, cuts, staged)
            try:
                count_together(binned, [(own_features(c), c.params) for c in alike])
                fitted = [fit(c, binned) for c in alike]
            finally:
                binned.unpersist()
            lower = staged.scorer(spark).first if staged is not None else None
            scorers = [StagedScorer(m.first) if lower is None else StagedScorer(lower, m.second) for m, _ in fitted]
            forecast = recursive_forecasts(
                group_tests, target, [(c.lags, s) for c, s in zip(alike, scorers)], lags_avg, ["fold_id", station], time, keep=[target], average_name=average_name,
            )
            each = forecast.select("fold_id", target, F.posexplode("preds").alias("place", "pred"))
            scored = regression_metrics(each, target, "pred", ["place", "fold_id"]).collect()  # one row per candidate and fold
            ordered = sorted(scored, key=lambda r: (r["place"], -r["fold_id"]))
            return [(alike[r["place"]].number, r["fold_id"], r["rmse"], fitted[r["place"]][1]) for r in ordered]

        alone, together = shareable(left, own_features)
        for rows in [*map(score_together, together), *in_pool(spark, [partial(score, c) for c in alone], workers)]:
            results += rows
            for number, _, rmse, _ in rows:
                scores[number].append(rmse)
        if prune and group + 1 < groups:
            kept = set(survivors({c.number: scores[c.number] for c in left}))
            left = [c for c in left if c.number in kept]
    listed = spark.createDataFrame(results, "candidate INT, fold_id INT, rmse DOUBLE, best_iteration INT")
    described = spark.createDataFrame([(c.number, c.stage, list(c.lags)) for c in candidates], "candidate INT, stage INT, lags ARRAY<INT>")
    counted = listed.groupBy("candidate").agg(F.count(F.lit(1)).cast("int").alias("n_folds"))
    return described.join(counted, "candidate").join(fold_scores(listed, ["candidate"]), "candidate")
