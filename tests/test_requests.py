import json

import pytest
from pyspark.sql import functions as F

from hourloom.streaming import requests


def test_requests_are_produced_per_batch_and_pollutant(spark):
    made = requests.produce_requests(spark.createDataFrame([(1,), (5,), (5,)], "batch INT"), 4).collect()
    bodies = [json.loads(r.value) for r in made]
    assert sorted((b["batch_id"], b["depvar"]) for b in bodies) == [(b, p) for b in (1, 5) for p in ("no2", "pm10", "pm25")]
    assert {r.key for r in made} == {"1"} and len({b["key"] for b in bodies}) == 6


def test_texts_that_are_no_requests_are_marked(spark):
    texts = ['{"key": "k", "batch_id": 7, "depvar": "no2"}', "__import__('os')", "{}", '{"batch_id": "x", "depvar": "no2"}', '{"key": "k", "batch_id": 7, "depvar": "co2"}', None]
    parsed = requests.parse_requests(spark.createDataFrame([(t,) for t in texts], "value STRING"))
    assert [r.is_valid for r in parsed.collect()] == [True, False, False, False, False, False]


def test_stream_answers_each_request_once_across_restarts(spark, tmp_path):
    source, out, rejects, progress = (str(tmp_path / n) for n in ("in", "out", "rejects", "progress"))

    def send(*texts):
        spark.createDataFrame([(t,) for t in texts], "value STRING").coalesce(1).write.mode("append").text(source)

    def serve(handle):
        requests.serve_requests(requests.file_messages(spark, source), handle, out, rejects, progress).awaitTermination()

    def answer(asked):
        return asked.withColumn("answer", F.col("batch_id") * 2)

    def fail(asked):
        raise RuntimeError("lost")

    def body(i):
        return json.dumps({"key": str(i), "batch_id": i, "depvar": "pm10"})

    send(body(1), "junk")
    serve(answer)
    send(body(2))
    with pytest.raises(Exception, match="lost"):
        serve(fail)
    serve(answer)
    serve(answer)
    assert sorted((r.batch_id, r.answer) for r in spark.read.parquet(out).collect()) == [(1, 2), (2, 4)]
    assert [r.value for r in spark.read.parquet(rejects).collect()] == ["junk"]


def test_reschedule_and_retry(spark):
    reports = spark.createDataFrame([(1, False), (2, True), (3, False), (3, False), (1, True)], "batch INT, finished BOOLEAN")
    assert [r.batch for r in requests.batches_to_reschedule(reports).collect()] == [3]
    batches = spark.createDataFrame([(1,), (2,)], "batch INT")
    calls = []

    def second_time(pending):
        calls.append(sorted(r.batch for r in pending.collect()))
        return pending.select("batch", (F.lit(len(calls) > 1) | (F.col("batch") == 1)).alias("finished"))

    assert requests.run_with_retry(batches, second_time).count() == 3 and calls == [[1, 2], [2]]
    many = spark.range(30).select(F.col("id").cast("int").alias("batch"))
    with pytest.raises(requests.BatchesFailed, match="29 batches failed 2 times") as raised:
        requests.run_with_retry(many, lambda p: p.select("batch", (F.col("batch") == 3).alias("finished")))
    assert sorted(r.batch for r in raised.value.failed.collect()) == [b for b in range(30) if b != 3]


def test_a_bad_batch_fails_alone(spark, tmp_path):
    path, runs_made = str(tmp_path / "rows"), []

    def run(batches):
        runs_made.append(sorted(r[0] for r in batches.collect()))
        bad = F.raise_error(F.lit("bad")).cast("int")
        batches.withColumn("v", F.when(F.col("batch") == 11, bad).otherwise(1)).write.mode("append").parquet(path)
        return batches.withColumn("finished", F.lit(True))

    batches = spark.range(16).select(F.col("id").cast("int").alias("batch"))
    with pytest.raises(requests.BatchesFailed) as failed:
        requests.run_with_retry(batches, requests.isolated(run))
    assert [r.batch for r in failed.value.failed.collect()] == [11]
    assert sorted(r[0] for r in spark.read.parquet(path).select("batch").collect()) == [b for b in range(16) if b != 11]
    told = {(r.batch, r.attempt): r.finished for r in failed.value.reports.collect()}
    assert told == {**{(b, 1): b != 11 for b in range(16)}, (11, 2): False}
    assert len(runs_made) <= 1 + 2 * 4 + 1
