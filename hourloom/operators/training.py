"""Two-stage boosted regression on Spark ML: the second stage learns what the first one leaves over."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import Imputer, StringIndexer, VectorAssembler
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hourloom.operators.scoring import StagedScorer, TreeScorer, combine_stages
from hourloom.operators.stumps import StumpModel, bin_counts_of_models, fit_stumps, longer, mean_label, with_bins
from hourloom.session import scratch_path, store
from hourloom.sources.merge import exists

MAX_TREE_NODES = 20_000_000  # bound of what a scorer may ship to every executor


#: A fitted stage: a pipeline that ends in boosted trees, or boosted one-level trees.
Stage = PipelineModel | StumpModel


@dataclass
class StagedModel:
    """One or two fitted stages with their feature lists."""

    first: Stage
    second: Stage | None
    features_1: list[str]
    features_2: list[str] | None
    categorical: list[str]

    def transform(self, df: DataFrame) -> DataFrame:
        """Adds `pred_stage_1`, `pred_stage_2` and their total `pred`; scoring is narrow."""
        kept = df.columns
        out = self.first.transform(df).withColumnRenamed("__prediction", "pred_stage_1").select(*_quoted(kept), "pred_stage_1")
        if self.second is None:
            return out.withColumns({"pred_stage_2": F.lit(None).cast("double"), "pred": F.col("pred_stage_1")})
        out = self.second.transform(out).withColumnRenamed("__prediction", "pred_stage_2")
        out = out.select(*_quoted(kept), "pred_stage_1", "pred_stage_2")
        return out.withColumn("pred", combine_stages(F.col("pred_stage_1"), F.col("pred_stage_2")))

    def save(self, path: str) -> None:
        for number, stage in ((1, self.first), (2, self.second)):
            if isinstance(stage, StumpModel):
                stage.save(SparkSession.active(), f"{path}/stumps_{number}")
            elif stage is not None:
                stage.write().overwrite().save(f"{path}/stage_{number}")

    @staticmethod
    def load(path: str, features_1: Sequence[str], features_2: Sequence[str] | None, categorical: Sequence[str]) -> StagedModel:
        return StagedModel(
            _load_stage(path, 1),
            None if features_2 is None else _load_stage(path, 2),
            list(features_1),
            None if features_2 is None else list(features_2),
            list(categorical),
        )

    def scorer(self, spark: SparkSession) -> StagedScorer:
        first = _stage_scorer(spark, self.first, self.features_1, self.categorical)
        if self.second is None:
            return StagedScorer(first)
        return StagedScorer(first, _stage_scorer(spark, self.second, self.features_2, self.categorical))


def _load_stage(path: str, number: int) -> Stage:
    spark = SparkSession.active()
    if exists(spark, f"{path}/stumps_{number}"):
        return StumpModel.load(spark, f"{path}/stumps_{number}")
    return PipelineModel.load(f"{path}/stage_{number}")


def _stage_scorer(spark: SparkSession, stage: Stage, features: Sequence[str], categorical: Sequence[str]) -> StumpModel | TreeScorer:
    return stage if isinstance(stage, StumpModel) else tree_scorer(spark, stage, features, categorical)


def fit_stage(data: DataFrame, label: str, features: Sequence[str], categorical: Sequence[str], params: dict) -> Stage:
    """Boosted trees, or one-level trees if the parameters name `cuts`.

    Boosted trees read their input several times before they keep it in bins. The assembled vectors are kept meanwhile, so the columns
    are indexed, filled and assembled, and a first stage's trees walked, once.
    """
    if "cuts" in params:
        return fit_stumps(data, label, features, **params)
    *preparation, boosting = stage_pipeline(features, categorical, label, params).getStages()
    prepared = Pipeline(stages=preparation).fit(data)
    rows = prepared.transform(data).select("__vector", F.col(f"`{label}`")).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        boosted = boosting.fit(rows)
    finally:
        rows.unpersist()
    return PipelineModel([*prepared.stages, boosted])


def _quoted(names: Sequence[str]) -> list:
    return [F.col(f"`{n}`") for n in names]


def stage_pipeline(features: Sequence[str], categorical: Sequence[str], label: str, params: dict, **extra) -> Pipeline:
    """Index categories, fill missing metrics with their mean, assemble, boost."""
    cats = [f for f in features if f in categorical]
    metrics = [f for f in features if f not in categorical]
    stages = []
    if cats:
        stages.append(StringIndexer(inputCols=cats, outputCols=[f"{c}__code" for c in cats], handleInvalid="keep"))
    if metrics:
        stages.append(Imputer(inputCols=metrics, outputCols=[f"{c}__filled" for c in metrics], strategy="mean"))
    stages.append(
        VectorAssembler(
            inputCols=[f"{f}__code" if f in cats else f"{f}__filled" for f in features], outputCol="__vector"
        )
    )
    settings = {"maxBins": 64, "seed": 7, **params, **extra}
    stages.append(GBTRegressor(featuresCol="__vector", labelCol=label, predictionCol="__prediction", **settings))
    return Pipeline(stages=stages)


def _spread(df: DataFrame, label: str, features: Sequence[str], partitions: int | None = None) -> DataFrame:
    """Labelled rows and the columns a fit needs, spread evenly."""
    spark = df.sparkSession
    if partitions is None:
        partitions = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    used = list(dict.fromkeys([label, *features]))
    rows = df.where(F.col(f"`{label}`").isNotNull()).select(*_quoted(used))
    return rows.repartition(partitions)


def training_set(df: DataFrame, label: str, features: Sequence[str], partitions: int | None = None) -> DataFrame:
    """Labelled rows and the columns a fit needs, spread evenly and persisted; the caller releases them.

    Boosting passes over the rows rounds x depth times, so one exchange pays for itself.
    """
    return _spread(df, label, features, partitions).persist(StorageLevel.MEMORY_AND_DISK)


def fit_staged(
    df: DataFrame,
    target: str,
    features_1: Sequence[str],
    features_2: Sequence[str] | None = None,
    categorical: Sequence[str] = (),
    params_1: dict | None = None,
    params_2: dict | None = None,
    first: Stage | None = None,
    partitions: int | None = None,
) -> StagedModel:
    """Fit stage 1 (unless given) on the target and stage 2, if it has features, on target - prediction of stage 1."""
    data = training_set(df, target, [*features_1, *(features_2 or [])], partitions)
    try:
        if first is None:
            first = fit_stage(data, target, features_1, categorical, params_1 or {})
        second = None
        if features_2 is not None:
            left_over = first.transform(data).withColumn("__residual", F.col(target) - F.col("__prediction"))
            left_over = left_over.select("__residual", *_quoted(features_2))
            second = fit_stage(left_over, "__residual", features_2, categorical, params_2 or {})
    finally:
        data.unpersist()
    return StagedModel(
        first, second, list(features_1), None if features_2 is None else list(features_2), list(categorical)
    )


def _best_and_stop(errors: Sequence[float], patience: int, min_delta: float) -> tuple[int, int]:
    best, best_round = float("inf"), 0
    for i, error in enumerate(errors, start=1):
        if error < best - min_delta:
            best, best_round = error, i
        elif i - best_round >= patience:
            return best_round, i
    return best_round, 0


def best_iteration(errors: Sequence[float], patience: int, min_delta: float) -> int:
    """The best round before `patience` rounds in a row have not improved the best error by min_delta."""
    return max(_best_and_stop(errors, patience, min_delta)[0], 1)


def stopped_at(errors: Sequence[float], patience: int, min_delta: float) -> int:
    """The round at which boosting stops, 0 if it does not."""
    return _best_and_stop(errors, patience, min_delta)[1]


MODELS_AT_ONCE = 32  # models whose residuals, or errors, one pass over the rows sums up


class BinnedRows:
    """Training and held-out rows of one-level trees: prepared once and read by any number of fits.

    `cuts` names the features of all fits. What has been counted for a model is kept, so fits that begin alike count once; counting
    for several models is one pass over the rows. `unpersist` releases them.
    """

    def __init__(self, train: DataFrame, held: DataFrame, label: str, cuts: Mapping[str, Sequence[float]]):
        self.label, self.cuts = F.col(f"`{label}`"), dict(cuts)
        self.train = with_bins(_spread(train, label, list(cuts)), self.cuts).persist(StorageLevel.MEMORY_AND_DISK)
        self.held = held.where(self.label.isNotNull())
        self.base = mean_label(self.train, self.label)
        self._counts, self._errors = {}, {}

    def count(self, models: Sequence[StumpModel]) -> None:
        """Count the residuals of all models that have not been counted."""
        new = list({m.splits: m for m in models if m.splits not in self._counts}.values())
        for at in range(0, len(new), MODELS_AT_ONCE):
            some = new[at : at + MODELS_AT_ONCE]
            self._counts |= {m.splits: c for m, c in zip(some, bin_counts_of_models(self.train, self.label, some))}

    def counts(self, model: StumpModel, features: Sequence[str]) -> list[tuple[int, int, int, int]]:
        """Counts of a model's residuals by the features of a fit, numbered in its order."""
        self.count([model])
        names = list(self.cuts)
        own = {names.index(f): i for i, f in enumerate(features)}
        return [(own[feature], *rest) for feature, *rest in self._counts[model.splits] if feature in own]

    def errors(self, models: Sequence[StumpModel]) -> list[float]:
        """RMSE of the models on held-out rows, infinite without any."""
        new = list({m.splits: m for m in models if m.splits not in self._errors}.values())
        for at in range(0, len(new), MODELS_AT_ONCE):
            some = new[at : at + MODELS_AT_ONCE]
            error = [self.label - m.column() for m in some]
            found = self.held.agg(*[F.sqrt(F.avg(e * e)).alias(str(i)) for i, e in enumerate(error)]).first()
            self._errors |= {m.splits: e if e is not None else float("inf") for m, e in zip(some, found)}
        return [self._errors[m.splits] for m in models]

    def unpersist(self) -> None:
        self.train.unpersist()


class _StumpRounds:
    """Blocks of one-level trees."""

    def __init__(self, rows: BinnedRows, features: Sequence[str], params: dict):
        self.rows = rows
        self.params = {"eta": 0.3, "min_rows": 1, **{k: v for k, v in params.items() if k not in ("cuts", "rounds")}}
        self.cuts = {f: params["cuts"][f] for f in features}
        self.most = params.get("rounds", 1)
        self.model = StumpModel(rows.base, (), tuple(features))

    def grow(self, rounds: int) -> int:
        before = len(self.model.splits)
        for _ in range(rounds):
            grown = longer(self.model, self.rows.counts(self.model, list(self.cuts)), self.cuts, self.params["eta"], self.params["min_rows"])
            if grown is self.model:
                break
            self.model = grown
        return len(self.model.splits) - before

    def errors(self, held: DataFrame, first: int) -> list[float]:
        """RMSE on held-out rows after each round from `first` on, in one pass."""
        return self.rows.errors([self.model.after(k) for k in range(first, len(self.model.splits) + 1)])

    def finish(self, rounds: int) -> Stage:
        return self.model.after(rounds)


def count_together(rows: BinnedRows, fits: Sequence[tuple[Sequence[str], dict]], block: int = 5) -> None:
    """Count on the rows what the first block of every fit (features, parameters) will ask for: a pass per round and one for the errors.

    No fit stops before its first block is made. Later blocks, of the fits that come so far, count on their own.
    """
    every = [_StumpRounds(rows, features, params) for features, params in fits]
    growing = every
    for i in range(block):
        growing = [r for r in growing if i < r.most]
        rows.count([r.model for r in growing])
        growing = [r for r in growing if r.grow(1)]
    rows.errors([r.model.after(k) for r in every for k in range(1, len(r.model.splits) + 1)])


class _TreeRounds:
    """Blocks of boosted trees. A round is a regression tree on twice what is left over, as least squares boosting takes it.

    Rows are prepared once. What is left over is kept as a column of the stored rows and brought up to date after each block, so neither
    plans nor the work of a round grow with the number of rounds before it.
    """

    def __init__(self, train: DataFrame, label: str, features: Sequence[str], categorical: Sequence[str], params: dict):
        settings = {"maxIter": 20, "stepSize": 0.1, **params}
        self.most, self.step = settings.pop("maxIter"), settings.pop("stepSize")
        whole = stage_pipeline(features, categorical, label, params)
        self.boosting = whole.getStages()[-1]
        self.preparation = Pipeline(stages=whole.getStages()[:-1]).fit(train)
        self.label, self.trees, self.weights = label, [], []
        self.settings = {"maxBins": 64, "seed": 7, "featureSubsetStrategy": "all", **settings}
        self.train = store(self._prepared(train).withColumn("__fitted", F.lit(0.0)), "boosting-rows")

    def _prepared(self, rows: DataFrame) -> DataFrame:
        return self.preparation.transform(rows).select("__vector", F.col(f"`{self.label}`").cast("double").alias("__label"))

    def grow(self, rounds: int) -> int:
        for _ in range(rounds):
            left = F.col("__label") - F.col("__fitted")
            first = not self.trees
            rows = self.train.select("__vector", "__label", "__fitted", (left if first else 2.0 * left).alias("__left"))
            # A forest of one tree samples rows and columns as boosting does.
            learner = RandomForestRegressor(featuresCol="__vector", labelCol="__left", numTrees=1, bootstrap=False)
            tree = learner.fit(rows, {getattr(learner, k): v for k, v in {**self.settings, "seed": self.settings["seed"] + len(self.trees)}.items()}).trees[0]
            tree.setFeaturesCol("__vector").setPredictionCol("__tree")
            self.trees.append(tree)
            self.weights.append(1.0 if first else self.step)
            self.train = tree.transform(self.train).withColumn("__fitted", F.col("__fitted") + self.weights[-1] * F.col("__tree")).drop("__tree")
        self.train = store(self.train, "boosting-rows")
        return rounds

    def errors(self, held: DataFrame, first: int) -> list[float]:
        """RMSE on held-out rows after each round from `first` on. Rows held out are scored by the new trees only."""
        if not hasattr(self, "held"):
            self.held = store(self._prepared(held).withColumn("__fitted", F.lit(0.0)), "held-out-rows")
        scored, columns = self.held, []
        for i in range(max(first, 1) - 1, len(self.trees)):
            scored = self.trees[i].transform(scored).withColumn("__fitted", F.col("__fitted") + self.weights[i] * F.col("__tree")).drop("__tree")
            scored = scored.withColumn(f"__e{i}", F.pow(F.col("__label") - F.col("__fitted"), 2))
            columns.append(f"__e{i}")
        stored = store(scored, "held-out-rows")
        found = stored.agg(*[F.sqrt(F.avg(c)).alias(c) for c in columns]).first()
        self.held = stored.drop(*columns)
        return [e if e is not None else float("inf") for e in found]

    def finish(self, rounds: int) -> Stage:
        """One boosted model of the trees of all blocks, in the pipeline that prepares its input."""
        jvm, gateway = self.train.sparkSession.sparkContext._jvm, self.train.sparkSession.sparkContext._gateway
        package = jvm.org.apache.spark.ml.regression
        trees, weights = gateway.new_array(package.DecisionTreeRegressionModel, rounds), gateway.new_array(gateway.jvm.double, rounds)
        for i in range(rounds):
            trees[i], weights[i] = self.trees[i]._java_obj, float(self.weights[i])
        boosted = GBTRegressionModel(package.GBTRegressionModel(self.boosting.uid, trees, weights))
        boosted.setFeaturesCol("__vector").setPredictionCol("__prediction")
        return PipelineModel([*self.preparation.stages, boosted])


def _left_over(train: DataFrame, held: DataFrame, target: str, first: StagedModel | None) -> tuple[DataFrame, DataFrame, str]:
    """Both frames with what is to be learned, and its name: the target, or what a first stage leaves over."""
    if first is None:
        return train, held, target
    label = "__residual"
    train, held = (first.transform(d).withColumn(label, F.col(target) - F.col("pred_stage_1")) for d in (train, held))
    return train, held, label


def binned_rows(train: DataFrame, held: DataFrame, target: str, cuts: Mapping[str, Sequence[float]], first: StagedModel | None = None) -> BinnedRows:
    """Rows for `fit_with_early_stopping`, prepared for all features that have cuts."""
    train, held, label = _left_over(train, held, target, first)
    return BinnedRows(train, held, label, cuts)


def fit_with_early_stopping(
    train: DataFrame,
    validation: DataFrame,
    target: str,
    features: Sequence[str],
    categorical: Sequence[str],
    params: dict,
    patience: int = 20,
    min_delta: float = 0.05,
    first: StagedModel | None = None,
    block: int = 5,
    binned: BinnedRows | None = None,
) -> tuple[StagedModel, int]:
    """Boost one stage until held-out rows stop improving; the model up to there, and its best number of rounds.

    Rounds are fitted in blocks, each on what the blocks before leave over. After a block the errors of its rounds on the held-out
    rows are known, and once `patience` rounds in a row have not improved the best error by min_delta no further block is fitted: at
    most `block` rounds more than needed to see it. The model holds the rounds up to the stop, as those after the best one belong to it.
    With `first` given, the stage is fitted on what that model leaves over, and the result holds both stages. Fits of one-level trees
    may share their prepared rows as `binned`, made of the same rows by `binned_rows`; the caller releases them.
    """
    stumps = "cuts" in params
    own = stumps and binned is None
    if own:
        binned = binned_rows(train, validation, target, {f: params["cuts"][f] for f in features}, first)
    if not stumps:
        train, validation, label = _left_over(train, validation, target, first)
        data, held = training_set(train, label, features), validation.where(F.col(f"`{label}`").isNotNull())
    else:
        data, held = binned, binned.held
    try:
        rounds = _StumpRounds(binned, features, params) if stumps else _TreeRounds(data, label, features, categorical, params)
        errors, stop = [], 0
        while not stop and len(errors) < rounds.most:
            if not rounds.grow(min(block, rounds.most - len(errors))):
                break
            errors += rounds.errors(held, len(errors) + 1)
            stop = stopped_at(errors, patience, min_delta)
        fitted = rounds.finish(stop or len(errors))
    finally:
        if own or not stumps:
            data.unpersist()
    best = best_iteration(errors, patience, min_delta)
    if first is None:
        return StagedModel(fitted, None, list(features), None, list(categorical)), best
    return StagedModel(first.first, fitted, first.features_1, list(features), list(categorical)), best


def tree_scorer(spark: SparkSession, model: PipelineModel, features: Sequence[str], categorical: Sequence[str]) -> TreeScorer:
    """Node arrays of a fitted stage, read from its saved form. Size is bounded by rounds x 2^(depth + 1) and checked."""
    boosted = model.stages[-1]
    if boosted.totalNumNodes > MAX_TREE_NODES:
        raise ValueError(f"{boosted.totalNumNodes} tree nodes are too many to ship to executors")
    path = scratch_path(spark, "trees")
    boosted.write().overwrite().save(path)
    nodes = (
        spark.read.parquet(f"{path}/data")
        .select("treeID", "nodeData.*")
        .select(
            "treeID", "id", "prediction", "leftChild", "rightChild",
            F.col("split.featureIndex").alias("feature"),
            F.col("split.leftCategoriesOrThreshold").alias("cut"),
            F.col("split.numCategories").alias("n_categories"),
        )
        .orderBy("treeID", "id")
        .toPandas()
    )
    trees = nodes["treeID"].to_numpy()
    starts = np.flatnonzero(np.r_[True, trees[1:] != trees[:-1]])
    base = np.repeat(starts, np.diff(np.r_[starts, len(trees)]))
    leaf = nodes["leftChild"].to_numpy() < 0
    continuous = (nodes["n_categories"].to_numpy() < 0) & ~leaf
    threshold = np.full(len(nodes), -np.inf)
    threshold[continuous] = [c[0] for c in nodes["cut"][continuous]]
    categories = {
        int(i): np.asarray(nodes["cut"].iloc[i], dtype=float) for i in np.flatnonzero(~leaf & ~continuous)
    }
    fill, labels = {}, {}
    for stage in model.stages[:-1]:
        if hasattr(stage, "surrogateDF"):
            fill = {k: float(v) for k, v in stage.surrogateDF.first().asDict().items() if v is not None}
        elif hasattr(stage, "labelsArray"):
            labels = {c: {v: i for i, v in enumerate(ls)} for c, ls in zip(stage.getInputCols(), stage.labelsArray)}
    return TreeScorer(
        inputs=list(features),
        roots=starts,
        weights=np.asarray(boosted.treeWeights, dtype=float),
        feature=np.where(leaf, -1, nodes["feature"].to_numpy()),
        threshold=threshold,
        left=base + nodes["leftChild"].to_numpy(),
        right=base + nodes["rightChild"].to_numpy(),
        value=nodes["prediction"].to_numpy(),
        categories=categories,
        fill=fill,
        labels=labels,
    )

