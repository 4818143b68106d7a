"""Standardisation with the population deviation."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


# With more columns the moments are taken in Arrow batches instead of generated aggregates.
AGGREGATED_COLUMNS = 128


@dataclass(frozen=True)
class Scaler:
    """Fitted means and deviations, applied as literals in one projection."""

    columns: list[str]
    means: list[float]
    deviations: list[float]
    rows: int
    missing: tuple[str, ...] = ()

    def expressions(self) -> dict[str, Column]:
        return {
            name: (F.col(name) - F.lit(mean)) / F.lit(deviation)
            for name, mean, deviation in zip(self.columns, self.means, self.deviations)
        }

    def transform(self, table: DataFrame) -> DataFrame:
        return table.withColumns(self.expressions())


def fit_scaler(
    table: DataFrame, columns: list[str], with_mean: bool = True, with_std: bool = True
) -> Scaler:
    """One aggregate over the table; a constant column is divided by 1."""
    if len(columns) > AGGREGATED_COLUMNS:
        return _fit_wide(table, columns, with_mean, with_std)
    measures = [F.count("*")]
    for name in columns:
        value = F.col(name).cast("double")
        measures += [F.avg(value), F.stddev_pop(value), F.min(value), F.max(value), missing_cells(name)]
    row = table.agg(*[m.alias(f"m{i}") for i, m in enumerate(measures)]).head()
    means, deviations, missing = [], [], []
    for i in range(len(columns)):
        mean, deviation, low, high, holes = row[1 + 5 * i : 6 + 5 * i]
        if holes:
            missing.append(columns[i])
        means.append(mean if with_mean and mean is not None else 0.0)
        varies = with_std and deviation is not None and low != high and deviation > 0.0
        deviations.append(deviation if varies else 1.0)
    return Scaler(list(columns), means, deviations, row[0], tuple(missing))


def _fit_wide(table: DataFrame, columns: list[str], with_mean: bool, with_std: bool) -> Scaler:
    """The same from moments per task, which are merged column by column."""

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, parts = 0, []
        for batch in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            if len(x):
                rows += len(x)
                parts.append(_moments(x))
        if parts:
            n, mean, m2, low, high, missing = _merged(np.array(parts))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(len(n), dtype=np.int32)), pa.array(np.full(len(n), rows)), *map(pa.array, (n, mean, m2, low, high, missing))],
                names=["place", "rows", *MOMENTS],
            )

    def merged(group: pa.Table) -> pa.Table:
        parts = np.stack([group.column(c).to_numpy() for c in MOMENTS], axis=1)[:, :, None]
        sums = _merged(parts)[:, 0]
        cells = [group.column("place")[0].as_py(), int(group.column("rows").to_numpy().sum()), *map(float, sums)]
        return pa.table({name: [cell] for name, cell in zip(["place", "rows", *MOMENTS], cells, strict=True)}, schema=_ARROW)

    matrix = table.select(*[F.col(c).cast("double").alias(c) for c in columns])
    schema = "place int, rows long, " + ", ".join(f"{m} double" for m in MOMENTS)
    found = matrix.mapInArrow(moments, schema).groupBy("place").applyInArrow(merged, schema).collect()
    by_place = {r.place: r for r in found}  # a row per column
    means, deviations, missing = [], [], []
    for i, name in enumerate(columns):
        r = by_place.get(i)
        filled = r is not None and r.n > 0
        if r is not None and r.missing:
            missing.append(name)
        means.append(r.mean if with_mean and filled else 0.0)
        deviation = (r.m2 / r.n) ** 0.5 if filled else 0.0
        deviations.append(deviation if with_std and filled and r.low != r.high and deviation > 0.0 else 1.0)
    return Scaler(list(columns), means, deviations, by_place[0].rows if found else 0, tuple(missing))


MOMENTS = ["n", "mean", "m2", "low", "high", "missing"]
_ARROW = pa.schema([("place", pa.int32()), ("rows", pa.int64()), *[(m, pa.float64()) for m in MOMENTS]])


def _moments(x: np.ndarray) -> np.ndarray:
    """MOMENTS of each column of x, over the cells that are not NaN."""
    holes = np.isnan(x)
    n = (~holes).sum(axis=0).astype(float)
    mean = np.where(holes, 0.0, x).sum(axis=0) / np.maximum(n, 1)
    gaps = np.where(holes, 0.0, x - mean)
    low, high = np.where(holes, np.inf, x).min(axis=0), np.where(holes, -np.inf, x).max(axis=0)
    return np.stack([n, mean, (gaps * gaps).sum(axis=0), low, high, holes.sum(axis=0).astype(float)])


def _merged(parts: np.ndarray) -> np.ndarray:
    """Moments (part, moment, column) of all parts together."""
    n, mean, m2, low, high, missing = np.moveaxis(parts, 1, 0)
    total = n.sum(axis=0)
    middle = (n * mean).sum(axis=0) / np.maximum(total, 1)
    spread = m2.sum(axis=0) + (n * (mean - middle) ** 2).sum(axis=0)
    return np.stack([total, middle, spread, low.min(axis=0), high.max(axis=0), missing.sum(axis=0)])


def missing_cells(name: str) -> Column:
    """Number of NULL and NaN cells of a column."""
    value = F.col(name).cast("double")
    return F.count_if(value.isNull() | F.isnan(value))


def require_filled(table: DataFrame, columns: list[str], scaler: Scaler | None) -> None:
    """Raise if a column has a NULL or NaN; looked up in ``scaler``, or else in one aggregate."""
    if scaler is not None:
        missing = scaler.missing
    else:
        found = table.agg(*[missing_cells(c).alias(f"m{i}") for i, c in enumerate(columns)]).head()
        missing = [c for c, n in zip(columns, found) if n]
    if missing:
        raise ValueError(f"columns with missing values: {', '.join(missing)}")


def standardize(
    table: DataFrame, columns: list[str], with_mean: bool = True, with_std: bool = True
) -> DataFrame:
    """z-scores of ``columns``; all other columns pass through."""
    return fit_scaler(table, columns, with_mean, with_std).transform(table)
