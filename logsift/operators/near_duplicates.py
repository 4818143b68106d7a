"""Combining rows that lie close to each other in sorted order."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from logsift.scratch import materialize, place_columns

# Distinct rows that one task walks over, and numbers in them: a walk holds a few copies of these.
WALK_ROWS, WALK_CELLS = 200_000, 2_000_000


def _first_beyond(x: np.ndarray, start: int, rep: np.ndarray, rtol: float) -> int:
    """First row from ``start`` on that is farther from ``rep`` than its tolerance."""
    tolerance = rtol * (math.sqrt(float((rep * rep).sum())) + rtol)
    step = 16
    while start < len(x):
        gaps = x[start : start + step] - rep
        far = np.sqrt((gaps * gaps).sum(axis=1)) > tolerance
        if far.any():
            return start + int(far.argmax())
        start += step
        step *= 2
    return len(x)


def _walker(names: list[str], rtol: float):
    cells = [(n, pa.float64()) for n in names]
    schema = pa.schema(
        [("_pid", pa.int64()), ("_n", pa.int64()), ("_own", pa.bool_()), *cells, ("weight", pa.int64()), ("line_no", pa.int64())]
    )

    def walk(rows: pa.Table, carried: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return schema.empty_table()
        order = np.argsort(rows.column("_pos").to_numpy())
        x = np.empty((len(order), len(names)))
        for i, n in enumerate(names):
            x[:, i] = rows.column(n).to_numpy()[order]
        weights = np.cumsum(np.append(0, rows.column("weight").to_numpy()[order]))
        at, rep = 0, None
        if carried.num_rows and carried.column("_has")[0].as_py():
            rep = np.array([carried.column(n).to_numpy()[0] for n in names], float)
            at = _first_beyond(x, 0, rep, rtol)
        before, starts = at, []
        while at < len(x):
            starts.append(at)
            at = _first_beyond(x, at + 1, x[at], rtol)
        own = np.array(starts, np.int64)
        sums = np.diff(weights[np.append(own, len(x))])
        lines = rows.column("line_no").take(pa.array(order[own])).combine_chunks().cast(pa.int64())
        numbers, mine, taken = np.arange(len(own)), np.ones(len(own), bool), x[own]
        del x
        if before:  # rows that the incoming representative takes
            numbers, mine = np.append(-1, numbers), np.append(False, mine)
            taken, sums = np.vstack([rep, taken]), np.append(weights[before], sums)
            lines = pa.concat_arrays([pa.nulls(1, pa.int64()), lines])
        return pa.Table.from_arrays(
            [
                pa.array(np.full(len(numbers), rows.column("_pid")[0].as_py())), pa.array(numbers), pa.array(mine),
                *[pa.array(taken[:, i], from_pandas=True) for i in range(len(names))], pa.array(sums), lines,
            ],
            schema=schema,
        )

    return walk


def combine_near_duplicates(
    table: DataFrame, columns: list[str], rtol: float, walk_rows: int = WALK_ROWS
) -> DataFrame:
    """(sample, columns, weight, line_no): representatives in sorted order and their counts.

    Rows are sorted by the columns. A row farther than rtol * (|rep| + rtol) from the
    current representative becomes the next one, every other row adds to its count.

    Equal rows are counted first. The distinct rows are range-partitioned and each
    partition is walked on its own, then again with the representative that really comes
    in from the partition before, until no incoming representative changes. Walks that
    meet once stay together, so this takes few rounds, and no partition must fit with another.
    """
    names = [f"_x{i}" for i in range(len(columns))]
    distinct = materialize(
        table.groupBy(*[(F.col(c).cast("double") + F.lit(0.0)).alias(n) for c, n in zip(columns, names)])
        .agg(F.count("*").alias("weight"), F.min("line_no").alias("line_no")),
        "distinct",
    )
    walk_rows = max(1, min(walk_rows, WALK_CELLS // len(columns)))
    partitions = max(1, math.ceil(distinct.count() / walk_rows))
    ranged = materialize(
        distinct.repartitionByRange(partitions, *names)
        .sortWithinPartitions(*names)
        .select("*", *place_columns()),
        "ranged",
    )
    cells = ", ".join(f"{n} DOUBLE" for n in names)
    schema = f"_pid BIGINT, _n BIGINT, _own BOOLEAN, {cells}, weight BIGINT, line_no BIGINT"
    walk = _walker(names, rtol)

    def walked_with(rows: DataFrame, carried: DataFrame) -> DataFrame:
        return (
            rows.groupBy("_pid").cogroup(carried.groupBy("_pid")).applyInArrow(walk, schema=schema)
        )

    pids = ranged.select("_pid").distinct()
    nothing = F.lit(None).cast(f"struct<{', '.join(f'{n}: double' for n in names)}>")
    carried = pids.select("_pid", nothing.alias("rep"))

    def as_columns(incoming: DataFrame) -> DataFrame:
        return incoming.select(
            "_pid", F.col("rep").isNotNull().alias("_has"), *[F.col(f"rep.{n}").alias(n) for n in names]
        )

    walked = materialize(walked_with(ranged, as_columns(carried)), "walked")
    while partitions > 1:
        last = walked.where("_own").groupBy("_pid").agg(
            F.max_by(F.struct(*names), "_n").alias("rep")
        )
        # one row per partition
        before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
        incoming = materialize(
            pids.join(last, "_pid", "left").select(
                "_pid", F.last("rep", ignorenulls=True).over(before).alias("rep")
            ),
            "carried",
        )
        changed = materialize(
            incoming.join(carried.withColumnRenamed("rep", "old"), "_pid")
            .where(~F.col("rep").eqNullSafe(F.col("old")))
            .select("_pid", "rep"),
            "changed",
        )
        if changed.isEmpty():
            break
        again = walked_with(ranged.join(changed.select("_pid"), "_pid", "left_semi"), as_columns(changed))
        walked = materialize(
            walked.join(changed.select("_pid"), "_pid", "left_anti").unionByName(again), "walked"
        )
        carried = incoming

    earlier = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        walked.groupBy("_pid")
        .agg(F.count_if("_own").alias("_reps"))
        .select("_pid", F.coalesce(F.sum("_reps").over(earlier), F.lit(0)).alias("_offset"))
    )
    own = F.col("_own")
    numbered = walked.join(offsets, "_pid").groupBy(*names).agg(
        F.max(F.when(own, F.col("_offset") + F.col("_n"))).alias("sample"),
        F.sum("weight").alias("weight"),
        F.max(F.when(own, F.col("line_no"))).alias("line_no"),
    )
    return numbered.select(
        "sample", *[F.col(n).alias(c) for n, c in zip(names, columns)], "weight", "line_no"
    )
