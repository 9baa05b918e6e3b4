"""Boosting by one-level trees whose splits are found by one aggregation per round.

Rows are counted and summed per (feature, bin); the bins of a feature are set by its cuts, so a round ends with a few hundred rows
whatever the size of the table, and the driver takes the split with the largest gain. Labels are summed in millionths as whole
numbers, so no order of rows changes a model. A missing value lies beyond all cuts.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UNIT = 1_000_000  # labels are summed in this many parts of one


@dataclass(frozen=True)
class Split:
    """Adds `left` to rows with feature <= cut, `right` to all others."""

    feature: str
    cut: float
    left: float
    right: float


@dataclass(frozen=True)
class StumpModel:
    """base + the sum of its splits; also a scorer for numpy columns."""

    base: float
    splits: tuple[Split, ...]
    inputs: tuple[str, ...] = ()

    @property
    def features(self) -> list[str]:
        """What the model was offered, also if no split uses it."""
        return list(self.inputs)

    def after(self, rounds: int) -> StumpModel:
        """The model of the first rounds."""
        return replace(self, splits=self.splits[:rounds])

    def column(self) -> Column:
        total = F.lit(self.base)
        for s in self.splits:
            total = total + F.when(F.col(f"`{s.feature}`") <= F.lit(s.cut), F.lit(s.left)).otherwise(F.lit(s.right))
        return total

    def transform(self, df: DataFrame, name: str = "__prediction") -> DataFrame:
        return df.withColumn(name, self.column())

    def score(self, columns: Mapping[str, np.ndarray]) -> np.ndarray:
        size = len(next(iter(columns.values()))) if columns else 0
        total = np.full(size, self.base)
        for s in self.splits:
            total = total + np.where(columns[s.feature].astype(float) <= s.cut, s.left, s.right)
        return total

    def save(self, spark: SparkSession, path: str) -> None:
        text = json.dumps({"base": self.base, "splits": [vars(s) for s in self.splits], "inputs": self.inputs})
        spark.createDataFrame([(text,)], "model STRING").coalesce(1).write.mode("overwrite").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> StumpModel:
        stored = json.loads(spark.read.parquet(path).first()[0])
        return StumpModel(stored["base"], tuple(Split(**s) for s in stored["splits"]), tuple(stored["inputs"]))


def in_units(value: Column) -> Column:
    return F.floor(value * F.lit(float(UNIT)) + 0.5).cast("long")


def _bin(value: Column, cuts: Sequence[float]) -> Column:
    """How many cuts a value lies beyond."""
    known = F.array(*[F.lit(float(c)) for c in sorted(cuts)])
    return F.size(F.filter(known, lambda c: ~F.coalesce(value <= c, F.lit(False))))


def bin_counts(rows: DataFrame, residual: Column, cuts: Mapping[str, Sequence[float]]) -> DataFrame:
    """feature and bin (both as numbers), s, n: sum of residuals in units and number of rows."""
    bins = [F.struct(F.lit(i).alias("feature"), _bin(F.col(f"`{n}`"), cuts[n]).alias("bin")) for i, n in enumerate(cuts)]
    each = rows.select(in_units(residual).alias("r"), F.explode(F.array(*bins)).alias("at"))
    return each.groupBy("at.feature", "at.bin").agg(F.sum("r").alias("s"), F.count(F.lit(1)).alias("n"))


def with_bins(rows: DataFrame, cuts: Mapping[str, Sequence[float]], name: str = "__bins") -> DataFrame:
    """The bin of every feature as an array, in the order of the cuts."""
    return rows.withColumn(name, F.array(*[_bin(F.col(f"`{n}`"), cuts[n]).cast("smallint") for n in cuts]))


def bin_counts_of_models(
    binned: DataFrame, label: Column, models: Sequence[StumpModel], bins: str = "__bins"
) -> list[list[tuple[int, int, int, int]]]:
    """(feature, bin, s, n) as `bin_counts` has them, for every model: one pass over rows that have their bins."""
    sums = [f"__r{i}" for i in range(len(models))]
    each = binned.select(*[in_units(label - m.column()).alias(r) for r, m in zip(sums, models)], F.posexplode(bins).alias("feature", "bin"))
    found = each.groupBy("feature", "bin").agg(F.count(F.lit(1)).alias("n"), *[F.sum(r).alias(r) for r in sums]).collect()  # features x bins
    return [[(c["feature"], c["bin"], c[r], c["n"]) for c in found] for r in sums]


def best_split(counts: Sequence[tuple[int, int, int, int]], cuts: Mapping[str, Sequence[float]], min_rows: int) -> Split | None:
    """The split with the largest gain, its sides being mean residuals; None if none has min_rows on both sides.

    The gain is the sum over both sides of (sum of residuals)^2 / rows. Of equal ones the earlier feature and the smaller cut is taken.
    """
    best, found = None, None
    for i, name in enumerate(cuts):
        own = sorted((b, s, n) for feature, b, s, n in counts if feature == i)
        total, rows = sum(s for _, s, _ in own), sum(n for _, _, n in own)
        left_sum = left_rows = 0
        for b, s, n in own:
            left_sum, left_rows = left_sum + s, left_rows + n
            right_sum, right_rows = total - left_sum, rows - left_rows
            if left_rows < min_rows or right_rows < max(min_rows, 1):
                continue
            gain = float(left_sum) * float(left_sum) / float(left_rows) + float(right_sum) * float(right_sum) / float(right_rows)
            if best is None or gain > best:
                best = gain
                found = Split(name, float(sorted(cuts[name])[b]), float(left_sum) / float(left_rows) / UNIT, float(right_sum) / float(right_rows) / UNIT)
    return found


def mean_label(rows: DataFrame, label: Column) -> float:
    found = rows.agg(F.sum(in_units(label)).cast("double").alias("s"), F.count(label).cast("double").alias("n")).first()
    return found["s"] / found["n"] / UNIT if found["n"] else 0.0


def longer(model: StumpModel, counts: Sequence[tuple[int, int, int, int]], cuts: Mapping[str, Sequence[float]], eta: float, min_rows: int) -> StumpModel:
    """The model with the split that the counts of its residuals give, or the same if there is none to make."""
    found = best_split(counts, cuts, min_rows)
    if found is None:
        return model
    return replace(model, splits=(*model.splits, replace(found, left=found.left * eta, right=found.right * eta)))


def next_split(rows: DataFrame, label: Column, model: StumpModel, cuts: Mapping[str, Sequence[float]], eta: float, min_rows: int) -> StumpModel:
    """The model with one more split, or the same if there is none to make."""
    counts = [tuple(r) for r in bin_counts(rows, label - model.column(), cuts).collect()]  # features x bins
    return longer(model, counts, cuts, eta, min_rows)


def fit_stumps(
    rows: DataFrame, label: str, features: Sequence[str], cuts: Mapping[str, Sequence[float]], rounds: int = 1, eta: float = 0.3, min_rows: int = 1
) -> StumpModel:
    """Boosted one-level trees on rows with a label; `cuts` names the possible cuts of every feature."""
    known = rows.where(F.col(f"`{label}`").isNotNull())
    model = StumpModel(mean_label(known, F.col(f"`{label}`")), (), tuple(features))
    own = {f: cuts[f] for f in features}
    for _ in range(rounds):
        grown = next_split(known, F.col(f"`{label}`"), model, own, eta, min_rows)
        if grown is model:
            break
        model = grown
    return model
