"""Retrieval of the features of a mode in one call: bounds, coordinates, assembly, and a report on the rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hourloom.functions.timefns import bounds
from hourloom.operators.cleaning import completeness
from hourloom.plans.features import assemble_features
from hourloom.sources.tables import coords_for


@dataclass(frozen=True)
class Retrieved:
    """Feature rows of [lo, hi] at `coords`. Nothing is computed before one of the frames is read."""

    rows: DataFrame
    coords: DataFrame
    lo: Column
    hi: Column
    fixed_places: bool

    def report(self) -> DataFrame:
        """One row: n_coords, n_rows, expected_rows, complete, n_repeated (rows that equal an earlier one).

        Batches say which places there have to be, so places without any row count as missing; other modes go by what came.
        """
        n_coords = self.coords.select(F.count(F.lit(1))).scalar() if self.fixed_places else None
        same = self.rows.groupBy(*[F.col(f"`{c}`") for c in self.rows.columns]).agg(F.count(F.lit(1)).alias("__n"))
        repeated = same.select(F.coalesce(F.sum(F.col("__n") - 1), F.lit(0))).scalar()
        return completeness(self.rows, self.lo, self.hi, n_coords=n_coords).withColumn("n_repeated", repeated)


def retrieve(
    tables: Mapping[str, DataFrame],
    mode: str,
    newest: Sequence[str],
    now: Column,
    lo: Column | None = None,
    hi: Column | None = None,
    batch: int | None = None,
    include_future: bool = True,
    only_active: bool = True,
) -> Retrieved:
    """Features of a mode ("stations", "grid", "grid_sim" or "passive_samplers") in the given or default bounds.

    The grid modes take one batch, or all batches if none is named. `newest` names the version columns of the traffic table.
    """
    coords = coords_for(mode, tables, batch, only_active).select("x", "y")
    lo, hi = bounds(lo, hi, now, include_future)
    rows = assemble_features(tables, coords, lo, hi, mode, newest)
    return Retrieved(rows, coords, lo, hi, mode in ("grid", "grid_sim"))
