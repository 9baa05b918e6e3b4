"""Prediction requests: produced per batch and pollutant, consumed as a stream with at-least-once delivery."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hourloom.session import store

from hourloom.functions.params import POLLUTANTS

REQUEST_SCHEMA = "key STRING, batch_id INT, depvar STRING"


def produce_requests(
    batches: DataFrame, n_partitions: int, pollutants: Sequence[str] = POLLUTANTS, with_uuid: bool = True
) -> DataFrame:
    """One message per batch and pollutant as (key, value), in the form a Kafka sink takes.

    The message key is the batch number modulo the partitions of the topic.
    """
    wanted = batches.select("batch").distinct().select(
        "batch", F.explode(F.array(*[F.lit(p) for p in pollutants])).alias("depvar")
    )
    name = F.uuid() if with_uuid else F.concat_ws("-", F.col("batch").cast("string"), F.col("depvar"))
    body = F.struct(name.alias("key"), F.col("batch").cast("int").alias("batch_id"), F.col("depvar"))
    return wanted.select(
        F.pmod(F.col("batch"), F.lit(n_partitions)).cast("string").alias("key"), F.to_json(body).alias("value")
    )


def send_requests(messages: DataFrame, servers: str, topic: str) -> None:
    """Write produced messages to a topic. Needs the Kafka connector on the class path."""
    messages.write.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).save()


def parse_requests(messages: DataFrame, value: str = "value") -> DataFrame:
    """Decode request texts. `is_valid` is false for text that is no request; it is never evaluated as code."""
    request = F.from_json(F.col(value), REQUEST_SCHEMA)
    parsed = messages.withColumn("__request", request)
    valid = F.col("__request.batch_id").isNotNull() & F.col("__request.depvar").isin(list(POLLUTANTS))
    return parsed.withColumns(
        {
            "key": F.col("__request.key"),
            "batch_id": F.col("__request.batch_id"),
            "depvar": F.col("__request.depvar"),
            "is_valid": F.coalesce(valid, F.lit(False)),
        }
    ).drop("__request")


def kafka_messages(spark: SparkSession, servers: str, topic: str) -> DataFrame:
    """Request texts of a topic from its earliest message on. Needs the Kafka connector on the class path."""
    source = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .option("startingOffsets", "earliest")
        .load()
    )
    return source.select(F.col("value").cast("string").alias("value"))


def file_messages(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """Request texts from text files, one per line."""
    reader = spark.readStream.schema("value STRING").format("text")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(path)


def serve_requests(
    messages: DataFrame,
    handle: Callable[[DataFrame], DataFrame],
    output: str,
    rejects: str,
    checkpoint: str,
    continuous: bool = False,
):
    """Answer requests with `handle(requests) -> rows` and write the rows.

    Progress is committed after a batch has been written, and a repeated batch overwrites its own folder, so a
    restart neither loses nor doubles rows. Texts that are no request go to `rejects`.
    """

    def answer(batch: DataFrame, epoch: int) -> None:
        parsed = parse_requests(batch).persist()  # both writes read it
        requests = parsed.where("is_valid").select("key", "batch_id", "depvar")
        handle(requests).write.mode("overwrite").parquet(f"{output}/epoch={epoch}")
        parsed.where("NOT is_valid").select("value").write.mode("overwrite").parquet(f"{rejects}/epoch={epoch}")
        parsed.unpersist()

    writer = messages.writeStream.foreachBatch(answer).option("checkpointLocation", checkpoint)
    if not continuous:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def batches_to_reschedule(reports: DataFrame) -> DataFrame:
    """Batches that never finished; one success is enough."""
    done = reports.where(F.col("finished")).select("batch")
    return reports.select("batch").distinct().join(done, "batch", "left_anti")


class BatchesFailed(RuntimeError):
    """`failed` lists every batch that never finished, `reports` all reports (batch, attempt, finished)."""

    def __init__(self, message: str, failed: DataFrame, reports: DataFrame):
        super().__init__(message)
        self.failed, self.reports = failed, reports


def isolated(run: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
    """`run` for sets of batches of which some make it fail: they alone are reported as not finished.

    If a run over several batches fails, its two halves are run on their own. So a single bad batch costs two runs for each doubling
    of the number of batches, while the rows of all others are written by the runs that succeed.
    """

    def guarded(batches: DataFrame) -> DataFrame:
        ids = store(batches.select("batch").distinct(), "batches")
        try:
            return store(run(ids).select("batch", "finished"), "batch-reports")
        except PySparkException:
            middle = ids.select(F.percentile_approx("batch", 0.5, 10_000).alias("m"), F.min("batch").alias("lo"), F.max("batch").alias("hi")).first()
            if middle["lo"] == middle["hi"]:
                return ids.select("batch", F.lit(False).alias("finished"))
            cut = min(middle["m"], middle["hi"] - 1)
            return guarded(ids.where(F.col("batch") <= cut)).unionByName(guarded(ids.where(F.col("batch") > cut)))

    return guarded


def run_with_retry(batches: DataFrame, run: Callable[[DataFrame], DataFrame], attempts: int = 2) -> DataFrame:
    """Run all batches, then the failed ones again, at most `attempts` times in all; raise if some never finish.

    `run` takes a frame with `batch` and returns (batch, finished). Reports (batch, attempt, finished) are written to the shared
    folder, so no run is repeated by a later read. The error of batches that never finished carries all of them as the frame `failed`.
    """
    reports, pending = None, batches.select("batch").distinct()
    for attempt in range(1, attempts + 1):
        report = store(run(pending).select("batch", F.lit(attempt).alias("attempt"), "finished"), "batch-reports")
        reports = report if reports is None else reports.unionByName(report)
        pending = batches_to_reschedule(reports)
        if pending.isEmpty():
            return reports
    raise BatchesFailed(f"{pending.count()} batches failed {attempts} times", pending, reports)
