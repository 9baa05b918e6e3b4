"""Which features move a prediction: sampled-permutation attribution of any scorer."""

from __future__ import annotations

import random
from collections.abc import Callable, Iterator, Mapping, Sequence
from functools import reduce
from operator import add

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Score = Callable[[Mapping[str, Column]], Column]


def feature_means(df: DataFrame, features: Sequence[str]) -> dict[str, Column]:
    """Background of the attribution: the mean of each feature, as scalars inside the plan."""
    row = df.select(F.struct(*[F.avg(f).alias(f) for f in features])).scalar()
    return {f: row.getField(f) for f in features}


def attribute(
    df: DataFrame,
    features: Sequence[str],
    score: Score,
    background: Mapping[str, Column],
    permutations: int = 4,
    seed: int = 7,
) -> DataFrame:
    """Adds `phi_<feature>`: the mean change of the score when the feature moves from the background to the row's value.

    For every sampled order of the features they are switched one after the other. All scores are expressions on the
    same row, so the step is narrow: no row is copied and nothing is shuffled.
    """
    order = random.Random(seed)
    features = list(features)
    # The background is read once per row set, not once per expression.
    held = df.withColumns({f"__b_{f}": background[f] for f in features})
    phi: dict[str, list[Column]] = {f: [] for f in features}
    for _ in range(permutations):
        sequence = order.sample(features, len(features))
        state = {f: F.col(f"__b_{f}") for f in features}
        before = score(state)
        for f in sequence:
            state = {**state, f: F.col(f)}
            after = score(state)
            phi[f].append(after - before)
            before = after
    made = {f"phi_{f}": reduce(add, parts) / F.lit(permutations) for f, parts in phi.items()}
    return held.withColumns(made).drop(*[f"__b_{f}" for f in features])


def attribute_batches(
    df: DataFrame, features: Sequence[str], scorer, background: Mapping[str, Column], pairs: int = 4, seed: int = 7
) -> DataFrame:
    """Adds `phi_<feature>` and `se_<feature>`, its standard error from the sampling of orders, for a scorer on numpy columns.

    Orders come in antithetic pairs, an order and its reverse, whose mean is one observation. A batch of rows is scored under all states
    of an order at once, so there is one Python stage however many features and orders there are. Along every order the
    changes add up to score(row) - score(background), hence the sum of phi does.
    """
    order, features, kept = random.Random(seed), list(features), df.columns
    orders = [order.sample(features, len(features)) for _ in range(pairs)]
    shared = df.sparkSession.sparkContext.broadcast(scorer)  # as large as the model
    held = df.withColumns({f"__b_{f}": background[f] for f in features})
    added = [T.StructField(f"{kind}_{f}", T.DoubleType()) for kind in ("phi", "se") for f in features]
    schema = T.StructType([*df.schema.fields, *added])

    def changes(rows: pd.DataFrame, sequence: list[str]) -> dict[str, np.ndarray]:
        """Change of the score by each feature when they are switched in this order."""
        n, switched, states = len(rows), set(), {f: [] for f in features}
        for step in range(len(sequence) + 1):
            switched |= set(sequence[step - 1 : step])
            for f in features:
                states[f].append(rows[f if f in switched else f"__b_{f}"].to_numpy())
        scores = shared.value.score({f: np.concatenate(parts) for f, parts in states.items()}).reshape(-1, n)
        return dict(zip(sequence, np.diff(scores, axis=0)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            mean = {f: np.zeros(len(rows)) for f in features}
            spread = {f: np.zeros(len(rows)) for f in features}
            for i, sequence in enumerate(orders, start=1):
                there, back = changes(rows, sequence), changes(rows, sequence[::-1])
                for f in features:
                    seen = (there[f] + back[f]) / 2
                    off = seen - mean[f]
                    mean[f] += off / i
                    spread[f] += off * (seen - mean[f])
            error = {f: np.sqrt(spread[f] / max(pairs - 1, 1) / pairs) for f in features}
            made = {f"phi_{f}": mean[f] for f in features} | {f"se_{f}": error[f] for f in features}
            yield rows[kept].assign(**made)

    return held.mapInPandas(run, schema)


def attribution_errors(attributed: DataFrame, features: Sequence[str], top: int = 10) -> DataFrame:
    """feature, importance (mean absolute attribution) and the standard error of it from the sampling of orders, the strongest first."""
    parts = [F.struct(F.lit(f).alias("feature"), F.abs(F.col(f"phi_{f}")).alias("phi"), F.col(f"se_{f}").alias("se")) for f in features]
    each = attributed.select(F.inline(F.array(*parts)))
    ranked = each.groupBy("feature").agg(F.avg("phi").alias("importance"), (F.sqrt(F.sum(F.col("se") * F.col("se"))) / F.count(F.lit(1))).alias("error"))
    return ranked.orderBy(F.desc("importance"), "feature").limit(top)


def attribution_ranking(attributed: DataFrame, features: Sequence[str], top: int = 10) -> DataFrame:
    """Features by mean absolute attribution, the strongest first."""
    means = attributed.agg(*[F.avg(F.abs(F.col(f"phi_{f}"))).alias(f) for f in features])
    pairs = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("importance")) for f in features])
    return means.select(F.inline(pairs)).orderBy(F.desc("importance"), "feature").limit(top)
