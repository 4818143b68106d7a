"""Truncated SVD of a tall, narrow feature matrix and the measures derived from it.

The matrix has one row per log line and mostly a few dozen columns, so X'X is a small table:
each partition adds up its own, Spark sums the parts, and only the d x d result is
decomposed on the driver. With many columns the leading components are found without it
(``svd_wide``). The reduced matrix is then a plain projection, or a product per Arrow batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from logsift.functions.vectors import dot, literals, squared_norm, total
from logsift.operators.scaling import Scaler, fit_scaler, require_filled
from logsift.operators.svd_wide import Rows, leading
from logsift.scratch import materialize

# Up to this many products the Gramian is a code-generated aggregate without Python.
NATIVE_PRODUCTS = 28
# From this many columns on, leading components are found without X'X.
WIDE_COLUMNS = 256
# Up to this many products the projection is generated code, beyond it goes through Arrow batches.
PROJECTED_PRODUCTS = 128
# Entries of a singular vector this close in size count as equal for the sign rule.
SIGN_TIE = 1e-9


def gramian(table: DataFrame, columns: list[str]) -> np.ndarray:
    """X'X of the given columns."""
    d = len(columns)
    cells = [(i, j) for i in range(d) for j in range(i, d)]
    matrix = table.select(*[F.col(c).cast("double").alias(c) for c in columns])
    if len(cells) <= NATIVE_PRODUCTS:
        sums = [F.sum(F.col(columns[i]) * F.col(columns[j])) for i, j in cells]
        values = matrix.agg(*[s.alias(f"g{n}") for n, s in enumerate(sums)]).head()
    else:
        summed = (
            matrix.mapInArrow(_partial_products, "cell INT, value DOUBLE")
            .groupBy("cell")
            .agg(F.sum("value").alias("value"))
        )
        values = [0.0] * len(cells)
        for row in summed.collect():  # d(d+1)/2 numbers
            values[row.cell] = row.value
    gram = np.zeros((d, d))
    for (i, j), value in zip(cells, values):
        gram[i, j] = gram[j, i] = value or 0.0
    return gram


def _partial_products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    gram = None
    for batch in batches:
        x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])
        gram = x.T @ x if gram is None else gram + x.T @ x
    if gram is not None:
        upper = gram[np.triu_indices(len(gram))]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(len(upper), dtype=np.int32)), pa.array(upper)], ["cell", "value"]
        )


@dataclass(frozen=True)
class TruncatedSvd:
    """Fitted decomposition; can be applied to other tables with the same columns."""

    columns: list[str]
    scaler: Scaler | None
    singular_values: list[float]
    components: list[list[float]]

    @property
    def reduced_columns(self) -> list[str]:
        return [f"c{j}" for j in range(len(self.components))]

    def scaled(self, table: DataFrame) -> DataFrame:
        return self.scaler.transform(table) if self.scaler else table

    def _projections(self) -> dict[str, Column]:
        x = [F.col(c).cast("double") for c in self.columns]
        return {
            name: dot(x, literals(component))
            for name, component in zip(self.reduced_columns, self.components)
        }

    def both(self, table: DataFrame) -> DataFrame:
        """The (scaled) input columns with the reduced columns next to them."""
        return self.scaled(table).withColumns(self._projections())

    def transform(self, table: DataFrame) -> DataFrame:
        """US: the reduced columns replace the input columns."""
        others = [c for c in table.columns if c not in self.columns]
        if len(self.columns) * len(self.components) > PROJECTED_PRODUCTS:
            return self._multiplied(table.select(*others, *[F.col(c).cast("double").alias(c) for c in self.columns]))
        return self.both(table).select(*others, *self.reduced_columns)

    def _multiplied(self, table: DataFrame) -> DataFrame:
        """``transform`` by one matrix product per Arrow batch; the input columns are the last ones."""
        first, components = len(table.columns) - len(self.columns), np.array(self.components)
        rows = Rows(*self._shift_and_scale(), first)
        names = [*table.columns[:first], *self.reduced_columns]

        def product(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                us = rows(batch) @ components.T
                # A missing input leaves no result, as in generated code.
                missing = np.any([c.is_null().to_numpy(zero_copy_only=False) for c in batch.columns[first:]], axis=0)
                reduced = [pa.array(np.ascontiguousarray(c), mask=missing) for c in us.T]
                yield pa.RecordBatch.from_arrays([*batch.columns[:first], *reduced], names=names)

        schema = table.select(*table.columns[:first]).schema
        for name in self.reduced_columns:
            schema = schema.add(name, "double")
        return table.mapInArrow(product, schema)

    def _shift_and_scale(self) -> tuple[np.ndarray, np.ndarray]:
        d = len(self.columns)
        if self.scaler is None:
            return np.zeros(d), np.ones(d)
        return np.array(self.scaler.means), np.array(self.scaler.deviations)

    def rebuilt(self) -> list[Column]:
        """Input columns rebuilt from the reduced ones (US x VT)."""
        reduced = [F.col(c) for c in self.reduced_columns]
        return [
            dot(reduced, literals([component[i] for component in self.components]))
            for i in range(len(self.columns))
        ]

    def squared_loss(self) -> Column:
        return total(
            [
                (F.col(c).cast("double") - again) * (F.col(c).cast("double") - again)
                for c, again in zip(self.columns, self.rebuilt())
            ]
        )

    def tables(self, spark) -> dict[str, DataFrame]:
        """S and VT as small tables, and the energy curve T."""
        s = spark.createDataFrame(
            [(j, v) for j, v in enumerate(self.singular_values)],
            "component INT, singular_value DOUBLE",
        )
        names = ", ".join(f"`{c}` DOUBLE" for c in self.columns)
        vt = spark.createDataFrame(
            [(j, *row) for j, row in enumerate(self.components)], f"component INT, {names}"
        )
        return {"S": s, "VT": vt, "T": energy_curve(s)}


def tsvd(
    table: DataFrame, columns: list[str], n_components: int = 2, normalize: bool = True
) -> TruncatedSvd:
    """Decompose the (standardised) columns; ``transform`` then gives the reduced matrix.

    Missing values are an error. Of each right singular vector the largest entry is made positive (of equal ones the first).
    """
    if not 1 <= n_components <= len(columns):
        raise ValueError(f"n_components must be 1..{len(columns)}, got {n_components}")
    scaler = fit_scaler(table, columns) if normalize else None
    require_filled(table, columns, scaler)
    if len(columns) >= WIDE_COLUMNS and 4 * n_components <= len(columns):
        unfitted = TruncatedSvd(list(columns), scaler, [], [])
        # Every pass reads the matrix, so it is written once, as one column.
        matrix = materialize(table.select(F.array(*[F.col(c).cast("double") for c in columns]).alias("x")), "matrix")
        singular, right = leading(matrix, *unfitted._shift_and_scale(), n_components)
    else:
        scaled = scaler.transform(table) if scaler else table
        values, vectors = np.linalg.eigh(gramian(scaled, columns))
        order = np.argsort(-values, kind="stable")[:n_components]
        singular, right = np.sqrt(np.clip(values[order], 0.0, None)), vectors[:, order].T
    components = []
    for vector in right:
        size = np.abs(vector)
        lead = int(np.argmax(size >= size.max() - SIGN_TIE))
        components.append([float(v) for v in (vector if vector[lead] > 0 else -vector)])
    return TruncatedSvd(list(columns), scaler, [float(v) for v in singular], components)


def energy_curve(singular_values: DataFrame) -> DataFrame:
    """Running share of the squared singular values; the input has one row per component."""
    upto = Window.orderBy("component").rowsBetween(Window.unboundedPreceding, 0)
    energy = F.col("singular_value") * F.col("singular_value")
    every = Window.orderBy("component").rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing
    )
    return singular_values.select(
        "component", (F.sum(energy).over(upto) / F.sum(energy).over(every)).alias("t")
    )


def variance_ratios(table: DataFrame, svd: TruncatedSvd) -> DataFrame:
    """Population variance of each reduced column over the summed variance of the input."""
    both = svd.both(table)
    inputs = [F.var_pop(F.col(c).cast("double")) for c in svd.columns]
    outputs = [F.var_pop(c).alias(c) for c in svd.reduced_columns]
    row = both.agg(total(inputs).alias("_all"), *outputs)
    ratios = [
        F.struct(F.lit(j).alias("component"), (F.col(c) / F.col("_all")).alias("variance_ratio"))
        for j, c in enumerate(svd.reduced_columns)
    ]
    return row.select(F.inline(F.array(*ratios)))


def reconstruction_error(table: DataFrame, svd: TruncatedSvd) -> DataFrame:
    """Frobenius norm of US x VT - X as a one-row table."""
    return svd.both(table).agg(F.sqrt(F.sum(svd.squared_loss())).alias("error"))


def reconstruct(table: DataFrame, svd: TruncatedSvd) -> DataFrame:
    """The rebuilt matrix US x VT in place of the input columns, two products per Arrow batch."""
    others = [c for c in table.columns if c not in svd.columns]
    scaled = svd.scaled(table).select(*others, *[F.col(c).cast("double").alias(c) for c in svd.columns])
    components, first = np.array(svd.components), len(others)

    def rebuilt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[first:]])
            again = x @ components.T @ components
            columns = [pa.array(np.ascontiguousarray(c)) for c in again.T]
            yield pa.RecordBatch.from_arrays([*batch.columns[:first], *columns], names=batch.schema.names)

    return scaled.mapInArrow(rebuilt, scaled.schema)


def srss(table: DataFrame, columns: list[str], split: int = 1, maximum: int = 3) -> DataFrame:
    """Two columns r0, r1: root of summed squares of columns [0, split) and [split, maximum)."""
    if not 0 < split < maximum <= len(columns):
        raise ValueError(f"need 0 < split < maximum <= {len(columns)}")

    def root(names: list[str]) -> Column:
        return F.sqrt(squared_norm([F.col(c) for c in names]))

    others = [c for c in table.columns if c not in columns]
    return table.select(
        *others, root(columns[:split]).alias("r0"), root(columns[split:maximum]).alias("r1")
    )


def tsvd_srss(
    table: DataFrame, columns: list[str], split: int = 1, maximum: int = 3, normalize: bool = True
) -> tuple[TruncatedSvd, DataFrame]:
    """SVD with ``maximum`` components, reduced to the two SRSS columns."""
    svd = tsvd(table, columns, maximum, normalize)
    return svd, srss(svd.transform(table), svd.reduced_columns, split, maximum)


def centroid_distance(table: DataFrame, columns: list[str], name: str = "distance") -> DataFrame:
    """Add the Euclidean distance of each row to the mean row (one aggregate)."""
    x = [F.col(c).cast("double") for c in columns]
    means = table.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(x)]).head()
    gaps = [c - F.lit(mean) for c, mean in zip(x, means)]
    return table.withColumn(name, F.sqrt(squared_norm(gaps)))


def tsvd_centroid_distance(
    table: DataFrame, columns: list[str], normalize: bool = True
) -> tuple[TruncatedSvd, DataFrame]:
    """SVD with all components; each reduced row gets its distance to their centroid."""
    svd = tsvd(table, columns, len(columns), normalize)
    reduced = svd.transform(table)
    return svd, centroid_distance(reduced, svd.reduced_columns)


def reconstruction_anomaly_score(
    table: DataFrame, columns: list[str], n_components: int = 2
) -> DataFrame:
    """``score``: squared reconstruction loss of the unscaled matrix, min-max scaled to [0, 1].

    If all losses are equal every score is 0.
    """
    svd = tsvd(table, columns, n_components, normalize=False)
    others = [c for c in table.columns if c not in columns]
    losses = svd.both(table).select(*others, svd.squared_loss().alias("_loss"))
    low, high = losses.agg(F.min("_loss"), F.max("_loss")).head()
    if low is None or high == low:
        score = F.lit(0.0)
    else:
        score = (F.col("_loss") - F.lit(low)) / F.lit(high - low)
    return losses.withColumn("score", score).drop("_loss")
