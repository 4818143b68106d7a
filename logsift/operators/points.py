"""Point tables for scatter plots."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from logsift.scratch import materialize

AXES = ["x", "y", "z"]
# Most points of a box; up to so many Spark cuts each task's ranks before the shuffle.
MOST_PER_BOX = 1000


def align_by_line(left: DataFrame, right: DataFrame, how: str = "left") -> DataFrame:
    """Columns of two tables side by side, matched on the line keys that both have."""
    keys = [c for c in ("file", "line_no") if c in left.columns and c in right.columns]
    return left.join(right, keys, how)


def plot_points(
    table: DataFrame,
    columns: list[str],
    dims: int = 2,
    labels: DataFrame | None = None,
    how: str = "left",
) -> DataFrame:
    """First ``dims`` columns as x, y(, z), with "Log Line: n" and the label as text.

    ``how='left'`` gives a row without label "0"; ``how='inner'`` leaves it out.
    """
    if dims not in (2, 3):
        raise ValueError(f"dims must be 2 or 3, got {dims}")
    points = table.select(
        "line_no",
        *[F.col(c).cast("double").alias(axis) for c, axis in zip(columns, AXES[:dims])],
        F.concat(F.lit("Log Line: "), F.col("line_no").cast("string")).alias("log_line"),
    )
    if labels is None:
        return points
    text = labels.select("line_no", F.col("label").cast("string").alias("label"))
    return align_by_line(points, text, how).withColumn(
        "label", F.coalesce(F.col("label"), F.lit("0"))
    )


def thin_points(points: DataFrame, per_box: int = 20, boxes: int = 100) -> DataFrame:
    """Few enough points to draw, with the ``weight`` that each stands for.

    Every axis is cut into ``boxes`` parts between its ends. Of each box (and label, if there is one)
    the ``per_box`` points whose line numbers have the lowest hashes stay, so the choice does not
    depend on partitions, and a box that holds any point keeps one. Tasks send no more than
    ``per_box`` points of a box. A point without a coordinate cannot be drawn and is left out.
    """
    if not 1 <= per_box <= MOST_PER_BOX:
        raise ValueError(f"per_box must be 1..{MOST_PER_BOX}, got {per_box}")
    axes = [c for c in AXES if c in points.columns]
    drawn = points.where(reduce(and_, [F.col(c).isNotNull() & ~F.isnan(c) for c in axes]))
    ends = materialize(
        drawn.agg(*[f(c).alias(f"_{f.__name__}_{c}") for c in axes for f in (F.min, F.max)]), "ends"
    )
    cells = {}
    for c in axes:
        low, high = F.col(f"_min_{c}"), F.col(f"_max_{c}")
        part = F.floor((F.col(c) - low) * (F.lit(float(boxes)) / (high - low)))
        cells[f"_box_{c}"] = F.when(high > low, F.least(part, F.lit(boxes - 1))).otherwise(0)
    box = [*cells, *[c for c in ("label",) if c in points.columns]]
    boxed = drawn.join(F.broadcast(ends)).withColumns(cells)  # one row
    rank = Window.partitionBy(*box).orderBy(F.md5(F.col("line_no").cast("string").cast("binary")), "line_no")
    kept = boxed.withColumn("_rank", F.row_number().over(rank)).where(F.col("_rank") <= per_box)
    counts = boxed.groupBy(*box).agg(F.count("*").alias("_n"))
    same = reduce(and_, [F.col(f"p.{c}").eqNullSafe(F.col(f"n.{c}")) for c in box])
    weight = F.col("_n") / F.least(F.col("_n"), F.lit(per_box))
    return kept.alias("p").join(counts.alias("n"), same).select(
        *[F.col(f"p.{c}") for c in points.columns], weight.alias("weight")
    )


def append_centroids(points: DataFrame, centroids: DataFrame, columns: list[str]) -> DataFrame:
    """Add the centroids as points "Centroid i", numbered on after the last log line."""
    axes = [c for c in AXES if c in points.columns]
    if "label" not in points.columns:
        points = points.withColumn("label", F.lit("0"))
    last = points.agg(F.coalesce(F.max("line_no"), F.lit(0))).scalar()
    number = (last + F.lit(1) + F.col("cluster")).cast("bigint")
    extra = centroids.select(
        number.alias("line_no"),
        *[F.col(c).cast("double").alias(axis) for c, axis in zip(columns, axes)],
        F.concat(F.lit("Log Line: "), number.cast("string")).alias("log_line"),
        F.concat(F.lit("Centroid "), F.col("cluster").cast("string")).alias("label"),
    )
    return points.unionByName(extra)
