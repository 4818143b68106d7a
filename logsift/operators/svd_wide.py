"""SVD of matrices with many columns by a randomised block Krylov range finder and a TSQR tree.

A few columns more than wanted are drawn at random. Each pass multiplies them by X'X, block by block
in Arrow batches, and sends columns x block sums; the products so far span the space in which the best
approximation is taken, until the residuals of the wanted vectors vanish. The driver holds columns x
passes x block numbers and no columns x columns matrix. The singular values then come from the tall
matrix itself: every task reduces its rows of X V to a triangle and triangles are merged in a tree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logsift.scratch import materialize

# Columns drawn beyond the wanted ones, most passes, and the residual (of the largest value) to reach.
BEYOND, PASSES, RESIDUAL = 10, 40, 1e-12
# Triangles merged by one task.
FAN_IN = 16
SEED = 4181


class Rows:
    """Arrow batches, of number columns or of one array column, as standardised rows."""

    def __init__(self, shift: np.ndarray, scale: np.ndarray, first: int = 0):
        self.shift, self.scale, self.first = shift, scale, first

    def __call__(self, batch: pa.RecordBatch) -> np.ndarray:
        columns = batch.columns[self.first :]
        if pa.types.is_list(columns[0].type):
            x = columns[0].flatten().to_numpy().reshape(-1, len(self.shift))
        else:
            x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in columns])
        return (x - self.shift) / self.scale


def _through(matrix: DataFrame, rows: Rows, block: np.ndarray) -> np.ndarray:
    """X'X times ``block``."""
    d, width = block.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, width))
        for batch in batches:
            x = rows(batch)
            total += x.T @ (x @ block)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(d, dtype=np.int32)), _lists(total)], ["row", "cells"])

    cells = [F.sum(F.get("cells", F.lit(j))).alias(f"s{j}") for j in range(width)]
    found = matrix.mapInArrow(sums, "row int, cells array<double>").groupBy("row").agg(*cells)
    out = np.zeros((d, width))
    for r in found.collect():  # columns x block
        out[r[0]] = r[1:]
    return out


def _lists(x: np.ndarray) -> pa.Array:
    offsets = pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1])
    return pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(x).reshape(-1)))


def triangle(matrix: DataFrame, rows: Rows, block: np.ndarray) -> np.ndarray:
    """R of the QR decomposition of X times ``block``, merged FAN_IN triangles at a time."""
    width = block.shape[1]

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.zeros((0, width))
        for batch in batches:
            r = np.linalg.qr(np.vstack([r, rows(batch) @ block]), mode="r")
        yield _one(TaskContext.get().partitionId(), r)

    def merged(group: pa.Table) -> pa.Table:
        parts = [np.array(v, float).reshape(-1, width) for v in group.column("cells").to_pylist()]
        at = group.column("at")[0].as_py() // FAN_IN
        return pa.Table.from_batches([_one(at, np.linalg.qr(np.vstack(parts), mode="r"))])

    schema = "at long, cells array<double>"
    level = materialize(matrix.mapInArrow(local, schema), "triangles")
    while (last := level.agg(F.max("at")).head()[0]) is not None and last > 0:
        groups = level.groupBy(F.floor(F.col("at") / FAN_IN).alias("group"))
        level = materialize(groups.applyInArrow(merged, schema), "triangles")
    found = [np.array(r.cells, float).reshape(-1, width) for r in level.collect()]  # one row, or none
    return np.linalg.qr(np.vstack([np.zeros((width, width)), *found]), mode="r")


def _one(at: int, r: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), _lists(r.reshape(1, -1))], ["at", "cells"])


def leading(matrix: DataFrame, shift: np.ndarray, scale: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(k singular values, right vectors as rows) of the standardised rows of ``matrix``, one array each."""
    rows, d = Rows(shift, scale), len(shift)
    block = np.linalg.qr(np.random.default_rng(SEED).normal(size=(d, min(k + BEYOND, d))))[0]
    basis, images = np.zeros((d, 0)), np.zeros((d, 0))
    for _ in range(PASSES):
        image = _through(matrix, rows, block)
        basis, images = np.hstack([basis, block]), np.hstack([images, image])
        projected = basis.T @ images
        values, vectors = np.linalg.eigh((projected + projected.T) / 2)
        order = np.argsort(-values)[:k]
        right = basis @ vectors[:, order]
        residual = np.linalg.norm(images @ vectors[:, order] - right * values[order], axis=0)
        if not values[order[0]] > 0 or residual.max() <= RESIDUAL * values[order[0]]:
            break
        # The part of the image that the basis does not span; orthogonal twice, as one round leaves rests.
        rest = image
        for _ in range(2):
            rest = rest - basis @ (basis.T @ rest)
            rest, spare = np.linalg.qr(rest)
            size = np.abs(np.diag(spare))
        block = rest[:, : min(int((size > 1e-14).sum()), d - basis.shape[1])]
        block -= basis @ (basis.T @ block)
        if not block.shape[1]:
            break
        block = np.linalg.qr(block)[0]
    _, singular, turned = np.linalg.svd(triangle(matrix, rows, right))
    return singular[:k], turned[:k] @ right.T
