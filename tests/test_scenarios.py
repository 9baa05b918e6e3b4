import datetime as dt
import math

import pytest
from conftest import at, hourly
from pyspark.sql import functions as F

from hourloom.functions.timefns import ntz
from hourloom.operators import scenarios
from hourloom.operators.scoring import LinearScorer
from hourloom.plans import queries_forecast, runs


def test_traffic_is_scaled_by_day_only(spark):
    data = [(at(f"2023-06-20 {h:02d}:00:00"), v) for h, v in ((13, 100.0), (14, 80.0), (15, 0.0), (1, 100.0))]
    df = spark.createDataFrame(data, "date_time TIMESTAMP_NTZ, kfz_per_hour DOUBLE")
    got = {r.date_time.hour: r.kfz_per_hour for r in scenarios.scale_traffic(df, 80).collect()}
    assert got == {13: 80.0, 14: 64.0, 15: 0.0, 1: 100.0}
    assert scenarios.traffic_scenarios(df).count() == 44


def test_days_are_24_elapsed_hours(spark):
    start = ntz("2022-01-01 00:00:00")
    df = spark.createDataFrame([(t,) for t in hourly("2022-01-01 00:00:00", 50)], "t TIMESTAMP_NTZ")
    got = [r[0] for r in df.orderBy("t").select(scenarios.day_number(F.col("t"), start)).collect()]
    assert got == [None] + [0] * 24 + [1] * 24 + [2]


@pytest.mark.parametrize("sizes, kept, skipping", [([24, 24, 24], [0, 1, 2], [0, 1, 2]), ([24, 23, 24], [0], [0, 2]), ([25, 24], [], [1]), ([24, 0, 24], [0], [0, 2])])
def test_run_ends_at_the_first_incomplete_day(spark, sizes, kept, skipping):
    df = spark.createDataFrame([("a", d) for d, n in enumerate(sizes) for _ in range(n)], "station_id STRING, day INT")
    assert sorted(r.day for r in scenarios.complete_days_prefix(df).collect()) == kept
    assert sorted(r.day for r in scenarios.complete_days_prefix(df, skip_incomplete=True).collect()) == skipping


def test_max_admissible_percentage(spark):
    cases = {
        "rising": {p: 20 + p / 5 for p in range(0, 101, 10)},
        "bumpy": {p: 45 if p in (10, 20) else 30 + (p > 70) * 20 for p in range(0, 101, 10)},
        "above": {p: 60 for p in range(0, 101, 10)},
        "below": {p: 10 for p in range(0, 101, 10)},
        "equal": {p: 35 + p for p in range(0, 101, 10)},
    }
    df = spark.createDataFrame([(k, p, float(m)) for k, ms in cases.items() for p, m in ms.items()], "station_id STRING, kfz_pct INT, mean DOUBLE")
    got = {r.station_id: r.max_percentage for r in scenarios.max_admissible_percentage(df, ["station_id"], 40.0, 5.0).collect()}
    assert got == {"rising": "70", "bumpy": "70", "above": "not possible", "below": "100", "equal": "0"}
    falls = {r.station_id: r.n_violations for r in scenarios.monotonicity_violations(df, ["station_id"]).collect()}
    assert falls == {"rising": 0, "bumpy": 1, "above": 0, "below": 0, "equal": 0}


def test_contribution_counts_daytime_only(spark):
    df = spark.createDataFrame([(p, at(f"2023-06-20 {h:02d}:00:00"), v) for p, h, v in ((0, 10, 5.0), (100, 10, 10.0), (0, 11, 4.0), (100, 11, 16.0), (0, 1, 1.0), (100, 1, 1.0), (50, 10, 7.0))], "kfz_pct INT, date_time TIMESTAMP_NTZ, pred DOUBLE")
    got = scenarios.scenario_contribution(df, ["date_time"]).first()
    assert got.n_hours == 2 and math.isclose(got.contribution, 100 * (1 - (0.5 + 0.25) / 2))


def test_scenario_forecast_matches_a_plain_loop(spark):
    times = hourly("2022-01-01 00:00:00", 24 * 4)
    start = at("2022-01-02 00:00:00")
    value = {t: 10.0 + (i * 7) % 13 for i, t in enumerate(times)}
    traffic = {t: float((i * 5) % 17) for i, t in enumerate(times)}
    df = spark.createDataFrame([("a", t, value[t], traffic[t]) for t in times], "station_id STRING, date_time TIMESTAMP_NTZ, y DOUBLE, kfz_per_hour DOUBLE")
    scorer = LinearScorer({"y_lag1": 0.5, "y_lag3": 0.2, "kfz_per_hour": 0.4}, 1.0)
    got = scenarios.scenario_forecast(df, "y", [1, 3], [], ntz("2022-01-02 00:00:00"), 2, scorer, percentages=(0, 50, 100))
    got = {(r.day, r.kfz_pct, r.date_time): r.pred for r in got.collect()}

    hour = dt.timedelta(hours=1)
    full = {t: value[t] for t in times if t <= start}
    for t in [t for t in times if start < t <= start + 48 * hour]:
        full[t] = 1.0 + 0.5 * full[t - hour] + 0.2 * full[t - 3 * hour] + 0.4 * traffic[t]
    want = {}
    for day in (0, 1):
        for pct in (0, 50, 100):
            own = {}
            for step in range(24):
                t = start + (24 * day + step + 1) * hour
                lag1 = own[t - hour] if step >= 1 else full[t - hour]
                lag3 = own[t - 3 * hour] if step >= 3 else full[t - 3 * hour]
                local = (t + hour).hour
                own[t] = 1.0 + 0.5 * lag1 + 0.2 * lag3 + 0.4 * traffic[t] * (pct / 100 if 5 <= local <= 21 else 1)
            want.update({(day, pct, t): v for t, v in own.items()})
    assert got.keys() == want.keys()
    assert all(math.isclose(got[k], want[k], rel_tol=1e-9) for k in want)
    assert all(math.isclose(got[d, 100, t], full[t], rel_tol=1e-9) for d, p, t in want if p == 100)


def test_grid_run_and_report(spark):
    cells = [(1, 0), (1, 1), (2, 0)]
    batches = spark.createDataFrame([(b, b, y) for b, y in cells] + [(3, 9, 9)], "batch INT, x INT, y INT")
    data = [(b, b, y, t, 10.0) for b, y in cells for t in hourly("2022-01-01 10:00:00", 3) if not (b == 2 and t.hour == 11)]
    features = spark.createDataFrame(data, "batch INT, x INT, y INT, date_time TIMESTAMP_NTZ, kfz_per_hour DOUBLE")
    lo, hi = ntz("2022-01-01 10:00:00"), ntz("2022-01-01 12:00:00")
    assert {r.batch: r.finished for r in runs.batch_report(features, batches, lo, hi).collect()} == {1: True, 2: False, 3: False}
    sent = spark.createDataFrame([(1, True), (1, False)], "batch INT, ok BOOLEAN")
    assert not any(r.finished for r in runs.batch_report(features, batches, lo, hi, sent).collect())

    def predict(d):
        return d.withColumn("pred", F.col("kfz_per_hour") + 1)

    assert runs.grid_predictions(features, predict, "grid").count() == 8
    assert {r[0] for r in runs.grid_predictions(features, predict, "grid_sim").select("pred").distinct().collect()} == {float(p) for p in range(1, 12)}
    with pytest.raises(ValueError):
        runs.grid_predictions(features, predict, "stations")


def test_range_and_suggestions(spark):
    latest = ntz("2022-06-10 04:00:00")
    got = spark.range(1).select(*scenarios.scenario_range(ntz("2022-06-10 00:00:00"), 2, latest)).first()
    assert tuple(got) == (at("2022-06-09 22:00:00"), at("2022-06-11 22:00:00"))
    got = spark.range(1).select(*scenarios.scenario_range(ntz("2022-06-12 00:00:00"), 1, latest)).first()
    assert tuple(got) == (at("2022-06-10 05:00:00"), at("2022-06-12 22:00:00"))
    days = spark.createDataFrame([("a", 1, "True Positive"), ("a", 2, "False Negative"), ("a", 3, "False Positive")], "station_id STRING, day INT, label STRING")
    means = spark.createDataFrame([("a", 1, p, 40.0 + p / 5) for p in range(0, 101, 10)], "station_id STRING, day INT, kfz_pct INT, mean DOUBLE")
    got = {r.day: r.max_percentage for r in scenarios.with_suggestions(days, means, 50.0, 5.0).collect()}
    assert got == {1: "20", 3: None}


def test_isotonic_is_the_nearest_that_never_falls(spark):
    import random

    rng = random.Random(4)
    lists = [[], [1.0], [3.0, 2.0, 1.0], [1.0, 1.0, 2.0], *([round(rng.uniform(0, 9), 1) for _ in range(rng.randint(2, 11))] for _ in range(60))]
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(lists)], "i INT, v ARRAY<DOUBLE>")
    for r in frame.select("v", scenarios.isotonic(F.col("v")).alias("got")).collect():
        v, n = r["v"], len(r["v"])
        # The value at i is the largest over j <= i of the least mean of j..k over k >= i.
        want = [max(min(sum(v[j : k + 1]) / (k - j + 1) for k in range(i, n)) for j in range(i + 1)) for i in range(n)]
        assert r["got"] == pytest.approx(want)


def test_monotone_scenarios_leave_no_violation(spark):
    rows = [(s, p, float((p * 7 + s) % 13)) for s in range(5) for p in range(0, 101, 10)] + [(9, 0, None)]
    df = spark.createDataFrame(rows, "station INT, kfz_pct INT, pred DOUBLE")
    made = scenarios.monotone_scenarios(df, ["station"])
    assert made.count() == 55
    left = scenarios.monotonicity_violations(made, ["station"], mean="pred")
    assert left.where("n_violations > 0").isEmpty()
    total = lambda frame: {r[0]: round(r[1], 6) for r in frame.where("pred IS NOT NULL").groupBy("station").sum("pred").collect()}
    assert total(made) == total(df)


def test_admissible_percentages_of_means_made_monotone(spark):
    rows = [("a", p, m) for p, m in zip(range(0, 101, 10), (1.0, 2.0, 9.0, 3.0, 4.0, 4.0, 4.0, 4.0, 4.0, 20.0, 4.0))]
    df = spark.createDataFrame(rows, "station STRING, kfz_pct INT, mean DOUBLE")
    given = (df, ["station"], 8.0, 0.0)
    assert scenarios.max_admissible_percentage(*given).first()["max_percentage"] == "100"
    # From 20 % on the mean of what falls is 4.6 up to 80 %, and 12 from 90 % on.
    assert scenarios.max_admissible_percentage(*given, monotone=True).first()["max_percentage"] == "80"


def test_percentages_multiply_the_hours_behind_the_exchange(spark):
    """A hundred percentages shuffle no more than one, and the means are those of the scaled rows."""
    times = hourly("2023-06-20 00:00:00", 24)
    data = [(s, t, None if t.hour == 9 else float(t.hour * s), 2.0 * s) for s in (1, 2) for t in times] + [(3, times[0], None, None)]
    df = spark.createDataFrame(data, "station_id INT, date_time TIMESTAMP_NTZ, kfz_per_hour DOUBLE, wind DOUBLE")
    scorer = LinearScorer({"kfz_per_hour": 0.3, "wind": -1.0}, 10.0)
    means = scenarios.scenario_means(df, ["station_id"], scorer.column, scenarios.EVERY_PERCENTAGE, ["wind"])
    plain = scenarios.traffic_scenarios(df, scenarios.EVERY_PERCENTAGE).withColumn("pred", scorer.column())
    want = {(r[0], r[1]): r[2] for r in plain.groupBy("station_id", "kfz_pct").agg(F.avg("pred")).collect()}
    got = {(r[0], r[1]): r[2] for r in means.collect()}
    assert len(got) == 303 and got == pytest.approx(want)
    unknown = scenarios.scenario_means(df, ["station_id"], lambda at: at["kfz_per_hour"], (0, 100)).collect()
    assert {(r[0], r[1]): r[2] for r in unknown if r[0] == 3} == {(3, 0): None, (3, 100): None}
    assert [r[2] for r in unknown if r[:2] == (1, 100)] == pytest.approx([sum(h for h in range(24) if h != 9) / 23])


def test_admissible_percentages_shuffle_hours_only(spark):
    plan = queries_forecast.max_admissible_pct(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    before, _, after = plan.partition("Generate")
    assert "Exchange" not in before and "Exchange" in after
