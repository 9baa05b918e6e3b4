"""Serving grid predictions from a stream of requests: model lookup, assembly, prediction, write, report."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hourloom.functions.timefns import unix_seconds
from hourloom.operators.cleaning import cap_outliers, fix_column_types
from hourloom.plans.features import assemble_features
from hourloom.plans.runs import batch_report, grid_predictions
from hourloom.session import store
from hourloom.sources.merge import exists, folders
from hourloom.sources.outputs import grid_output
from hourloom.streaming.requests import parse_requests

REPORT_SCHEMA = "batch INT, depvar STRING, date_time_forecast LONG, model_id INT, finished BOOLEAN"
Predict = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class GridService:
    """Answers requests (batch, pollutant) for the run that starts at `lo` and ends at `hi`.

    The final model of each pollutant is looked up in `models_final` when a request is answered; `load_model(pollutant, model_id)`
    gives its prediction. Below `root` lie the rows, the reports and the texts that were no requests.
    """

    tables: Mapping[str, DataFrame]
    models_final: DataFrame
    load_model: Callable[[str, int], Predict]
    lo: Column
    hi: Column
    root: str
    newest: Sequence[str]
    caps: Mapping[str, Column | float]
    mode: str = "grid"
    domain: str = "spatial"
    categorical: Sequence[str] = ()
    metric: Sequence[str] = ()

    def final_models(self, pollutants: Sequence[str]) -> dict[str, int]:
        """The final model of each pollutant that has one: a row per pollutant."""
        chosen = self.models_final.where((F.col("domain") == self.domain) & F.col("pollutant").isin(list(pollutants)))
        return {r["pollutant"]: r["model_id"] for r in chosen.groupBy("pollutant").agg(F.max("model_id").alias("model_id")).collect()}

    def reports(self, spark: SparkSession) -> DataFrame:
        path = f"{self.root}/reports"
        return spark.read.schema(REPORT_SCHEMA).parquet(path) if exists(spark, path) else spark.createDataFrame([], REPORT_SCHEMA)

    def rows(self, spark: SparkSession) -> DataFrame:
        """Rows of every request, from the newest answer that holds any: an answer cut short and given again counts once."""
        stored, request = spark.read.parquet(f"{self.root}/rows"), ["depvar", "batch", "date_time_forecast"]
        newest = stored.groupBy(*request).agg(F.max("answer").alias("answer"))
        return stored.join(newest, [*request, "answer"], "left_semi").drop("answer")

    def assembled(self, places: DataFrame) -> DataFrame:
        """One stored assembly of all requested cells, which every pollutant reads."""
        features = assemble_features(self.tables, places.select("x", "y").distinct(), self.lo, self.hi, self.mode, self.newest)
        if self.categorical or self.metric:
            features = fix_column_types(features, self.categorical, self.metric)
        return store(cap_outliers(features.join(places.select("batch", "x", "y").distinct(), ["x", "y"]), self.caps), "requested-features")

    def write_rows(self, features: DataFrame, places: DataFrame, models: Mapping[str, int]) -> None:
        """Rows of all requested batches, a folder per pollutant below that of the answer.

        The answer gets the next number, and `rows` takes the newest one of a request. So the files are as many as the tasks, however
        many requests there are, and nothing stored is read or rewritten.
        """
        spark, path = features.sparkSession, f"{self.root}/rows"
        number = 1 + max((int(name.removeprefix("answer=")) for name in folders(spark, path) if name.startswith("answer=")), default=0)
        for depvar, model_id in sorted(models.items()):
            own = features.join(places.where(F.col("depvar") == depvar).select("batch", "x", "y"), ["batch", "x", "y"], "left_semi")
            predicted = grid_predictions(own, self.load_model(depvar, model_id), self.mode)
            made = grid_output(predicted, F.lit(model_id), self.lo, self.mode, keep=["batch"])
            made.write.parquet(f"{path}/answer={number}/depvar={depvar}")

    def write_reports(self, asked: DataFrame, complete: DataFrame, models: Mapping[str, int]) -> None:
        known = asked.sparkSession.createDataFrame(sorted(models.items()), "depvar STRING, model_id INT")
        told = asked.join(complete, "batch", "left").join(F.broadcast(known), "depvar", "left")  # a row per pollutant
        finished = F.coalesce("finished", F.lit(False)) & F.col("model_id").isNotNull()
        report = told.select("batch", "depvar", unix_seconds(self.lo).alias("date_time_forecast"), "model_id", finished.alias("finished"))
        report.write.mode("append").parquet(f"{self.root}/reports")

    def answer(self, texts: DataFrame, epoch: int) -> None:
        """One batch of the stream.

        The report is written last and tells by (batch, pollutant, start) what has been answered, so an epoch that is played again
        after a stop answers what has no report: its rows take the place of those written before the stop.
        """
        spark = texts.sparkSession
        parsed = parse_requests(texts).persist()
        try:
            parsed.where("NOT is_valid").select("value").write.mode("overwrite").parquet(f"{self.root}/rejected/epoch={epoch}")
            valid = parsed.where("is_valid").select(F.col("batch_id").alias("batch"), "depvar").distinct()
            answered = self.reports(spark).where(F.col("date_time_forecast") == unix_seconds(self.lo)).select("batch", "depvar")
            asked = store(valid.join(answered, ["batch", "depvar"], "left_anti"), "asked")
        finally:
            parsed.unpersist()
        if asked.isEmpty():
            return
        models = self.final_models([r[0] for r in asked.select("depvar").distinct().collect()])
        places = store(self.tables[f"{self.mode}_batches"].join(asked, "batch"), "requested-cells")
        features = self.assembled(places)
        self.write_rows(features, places, models)
        self.write_reports(asked, batch_report(features, places.select("batch", "x", "y"), self.lo, self.hi), models)

    def serve(self, messages: DataFrame, checkpoint: str, continuous: bool = False):
        """Start answering; without `continuous` until what has arrived is answered."""
        writer = messages.writeStream.foreachBatch(self.answer).option("checkpointLocation", checkpoint)
        return (writer if continuous else writer.trigger(availableNow=True)).start()
