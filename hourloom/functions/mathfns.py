"""Small numeric expressions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F


def cap_at(value: Column, cap: Column | float) -> Column:
    """Values above the cap become the cap; NULL stays NULL (least() would skip it)."""
    cap = cap if isinstance(cap, Column) else F.lit(float(cap))
    return F.when(value > cap, cap).otherwise(value)


def mean_skip_null(columns: Sequence[Column]) -> Column:
    """Row mean over the non-null columns; NULL if there is none."""
    total = reduce(add, [F.coalesce(c, F.lit(0.0)) for c in columns])
    present = reduce(add, [F.when(c.isNotNull(), 1).otherwise(0) for c in columns])
    return total / F.nullif(present, F.lit(0))


def mean_all(columns: Sequence[Column]) -> Column:
    """Row mean that is NULL as soon as one column is."""
    return reduce(add, columns) / F.lit(len(columns))


def half_even(value: Column, digits: int = 0) -> Column:
    """Round a double as column stores and numpy do: scale, round halves to even, scale back.

    bround() works on the shortest decimal text of the double instead and differs where scaling hits a half.
    """
    scale = F.lit(10.0**digits)
    return F.rint(value * scale) / scale


def exact_mean(value: Column, decimals: int = 4) -> Column:
    """Mean of measurements with a fixed number of decimals.

    The sum is taken in decimals, so the result does not depend on the order in which a shuffle delivers the rows.
    """
    total = F.sum(value.cast(f"decimal({min(18 + decimals, 28)},{decimals})"))
    return total.cast("double") / F.nullif(F.count(value), F.lit(0))


def ratio(numerator: Column, denominator: Column) -> Column:
    """0 where the denominator is 0."""
    return F.coalesce(numerator / F.nullif(denominator, F.lit(0)), F.lit(0.0))
