"""Small scorers that run inside a task on numpy columns.

They score many rows at a time: the recursion hands over one time step of all series in a batch.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows times trees that are walked down at once.
NODES_AT_ONCE = 2_000_000


@dataclass(frozen=True)
class LinearScorer:
    """intercept + sum(coefficient * feature), missing features count as 0."""

    coefficients: Mapping[str, float]
    intercept: float = 0.0
    floor: float | None = None

    @property
    def features(self) -> list[str]:
        return list(self.coefficients)

    def score(self, columns: Mapping[str, np.ndarray]) -> np.ndarray:
        total = np.float64(self.intercept)
        for name, weight in self.coefficients.items():
            total = total + weight * np.nan_to_num(columns[name].astype(float), nan=0.0)
        return total if self.floor is None else np.maximum(total, self.floor)

    def column(self, rename: Mapping[str, Column] | None = None) -> Column:
        """The same score as a column expression."""
        rename = rename or {}
        total = F.lit(self.intercept)
        for name, weight in self.coefficients.items():
            total = total + F.lit(weight) * F.coalesce(rename.get(name, F.col(f"`{name}`")), F.lit(0.0))
        return total if self.floor is None else F.greatest(total, F.lit(self.floor))


@dataclass(frozen=True)
class TreeScorer:
    """Weighted sum of regression trees, stored as node arrays.

    `inputs` lists the assembled vector in order; `fill` replaces missing metrics; `labels` turns categories into codes.
    """

    inputs: list[str]
    roots: np.ndarray
    weights: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    categories: Mapping[int, np.ndarray] = field(default_factory=dict)
    fill: Mapping[str, float] = field(default_factory=dict)
    labels: Mapping[str, Mapping[str, int]] = field(default_factory=dict)

    @property
    def features(self) -> list[str]:
        return list(self.inputs)

    def _matrix(self, columns: Mapping[str, np.ndarray]) -> np.ndarray:
        parts = []
        for name in self.inputs:
            raw = columns[name]
            if name in self.labels:
                codes = self.labels[name]
                parts.append(np.array([codes.get(v, len(codes)) for v in raw], dtype=float))
            else:
                numbers = raw.astype(float)
                parts.append(np.where(np.isnan(numbers), self.fill.get(name, np.nan), numbers))
        return np.column_stack(parts)

    @cached_property
    def _walk(self) -> tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Steps to the deepest leaf, and node arrays in which a leaf leads to itself.

        Categories are rows of a boolean table, node by code; the last code stands for everything the node does not know.
        """
        leaf = self.feature < 0
        own = np.arange(len(leaf))
        left, right = np.where(leaf, own, self.left), np.where(leaf, own, self.right)
        steps, level = 0, np.asarray(self.roots)
        while (~leaf[level]).any():
            inner = level[~leaf[level]]
            steps, level = steps + 1, np.concatenate([left[inner], right[inner]])
        width = 2 + int(max((codes.max() for codes in self.categories.values() if len(codes)), default=-1))
        row = np.full(len(leaf), -1)
        table = np.zeros((len(self.categories), width), bool)
        for at, (node, codes) in enumerate(self.categories.items()):
            row[node] = at
            table[at, codes.astype(int)] = True
        table[:, -1] = False
        return steps, np.where(leaf, 0, self.feature), left, right, row, table, self.threshold

    def score(self, columns: Mapping[str, np.ndarray]) -> np.ndarray:
        """All trees of all rows go down together, one level at a time; a block of rows bounds the memory."""
        x = self._matrix(columns)
        block = max(1, NODES_AT_ONCE // max(len(self.roots), 1))
        parts = [self._score_rows(x[at : at + block]) for at in range(0, len(x), block)]
        return np.concatenate(parts) if parts else np.zeros(0)

    def _score_rows(self, x: np.ndarray) -> np.ndarray:
        steps, feature, left, right, row, table, threshold = self._walk
        node = np.repeat(np.asarray(self.roots)[None, :], len(x), axis=0)
        at = np.arange(len(x))[:, None]
        for _ in range(steps):
            values = x[at, feature[node]]
            goes_left = values <= threshold[node]
            if len(table):
                rows = row[node]
                listed = rows >= 0
                codes = values[listed]
                known = (codes >= 0) & (codes < table.shape[1] - 1) & (codes == np.floor(codes))
                goes_left[listed] = table[rows[listed], np.where(known, codes, table.shape[1] - 1).astype(int)]
            node = np.where(goes_left, left[node], right[node])
        # A running sum adds the trees in their order, as the model itself does.
        return np.cumsum(self.value[node] * np.asarray(self.weights)[None, :], axis=1)[:, -1]


@dataclass(frozen=True)
class StagedScorer:
    """Sum of two stages, not below 0. A single stage is returned as it is."""

    first: LinearScorer | TreeScorer
    second: LinearScorer | TreeScorer | None = None

    @property
    def features(self) -> list[str]:
        names = list(self.first.features)
        if self.second is not None:
            names += [n for n in self.second.features if n not in names]
        return names

    def score(self, columns: Mapping[str, np.ndarray]) -> np.ndarray:
        total = self.first.score(columns)
        return total if self.second is None else np.maximum(total + self.second.score(columns), 0.0)


def as_column(spark: SparkSession, scorer) -> Callable[[Mapping[str, Column]], Column]:
    """A scorer as a function of columns, scored in Arrow batches. Its node arrays travel once per executor."""
    shared = spark.sparkContext.broadcast(scorer)
    names = scorer.features

    def score(*columns: pd.Series) -> pd.Series:
        made = shared.value.score({n: c.to_numpy() for n, c in zip(names, columns)})
        return pd.Series(made, dtype=float)

    scored = F.pandas_udf(score, T.DoubleType())
    return lambda state: scored(*[state[n] for n in names])


def combine_stages(first: Column, second: Column | None) -> Column:
    """Column form of StagedScorer. NULL if a stage is NULL."""
    if second is None:
        return first
    total = first + second
    return F.when(total < 0, F.lit(0.0)).otherwise(total)
