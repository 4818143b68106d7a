"""Labels from two centroids, and the reduced log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logsift.functions.vectors import dot, literals, squared_distance, squared_norm
from logsift.scratch import materialize

OK_CLASS = 0.2


def two_centroids(centroids: DataFrame | list, columns: list[str]) -> list[list[float]]:
    """The two centroids as numbers; a DataFrame is ordered by its ``cluster`` column."""
    if isinstance(centroids, DataFrame):
        rows = centroids.orderBy("cluster").select(*columns).take(3)
        centroids = [list(row) for row in rows]
    if len(centroids) != 2:
        raise ValueError(f"two centroids are needed, got {len(centroids)}")
    return [[float(v) for v in c] for c in centroids]


def _cells(columns: list[str]) -> list[Column]:
    return [F.col(c).cast("double") for c in columns]


def euclidean_to_centroids(table: DataFrame, columns: list[str], centroids) -> DataFrame:
    """Add the distances ``d0`` and ``d1``."""
    points = _cells(columns)
    return table.withColumns(
        {
            f"d{i}": F.sqrt(squared_distance(points, literals(c)))
            for i, c in enumerate(two_centroids(centroids, columns))
        }
    )


def cosine_to_centroids(table: DataFrame, columns: list[str], centroids) -> DataFrame:
    """Add the similarities ``s0`` and ``s1``; a zero vector is similar to nothing (0)."""
    points = _cells(columns)
    length = F.sqrt(squared_norm(points))
    added = {}
    for i, centroid in enumerate(two_centroids(centroids, columns)):
        size = sum(v * v for v in centroid) ** 0.5
        unit = [v / size if size > 0 else 0.0 for v in centroid]
        added[f"s{i}"] = F.when(length > 0, dot(points, literals(unit)) / length).when(length == 0, 0.0)
    return table.withColumns(added)


def classify_euclidean(table: DataFrame) -> DataFrame:
    """0 if the first centroid is strictly nearer, else 1; NULL without a distance."""
    return table.withColumn("label", F.when(F.col("d0") < F.col("d1"), 0).when(F.col("d0") >= F.col("d1"), 1))


def classify_cosine(table: DataFrame) -> DataFrame:
    """0 if the first centroid is strictly more similar, else 1; NULL without a similarity."""
    return table.withColumn("label", F.when(F.col("s0") > F.col("s1"), 0).when(F.col("s0") <= F.col("s1"), 1))


def labels_reversed(table: DataFrame, status: str = "status") -> DataFrame:
    """One row: do more failed requests carry label 1 than label 0?

    Every status class other than 0.2 counts as failed.
    """
    failed = F.coalesce(F.col(status) != OK_CLASS, F.lit(True))
    ones = F.count_if(failed & (F.col("label") == 1))
    zeros = F.count_if(failed & (F.col("label") == 0))
    return table.agg((ones > zeros).alias("reversed"))


def orient_labels(table: DataFrame, status: str = "status") -> DataFrame:
    """Swap 0 and 1 everywhere if most failed requests carry label 1.

    The table is written once; the decision and the result are both read from there.
    """
    table = materialize(table, "oriented")
    reversed_ = labels_reversed(table, status).scalar()
    return table.withColumn(
        "label", F.when(reversed_, F.lit(1) - F.col("label")).otherwise(F.col("label"))
    )


def reduce_log(lines: DataFrame, labels: DataFrame, keep: int = 1, on: str = "line_no") -> DataFrame:
    """The lines labelled ``keep``, by default the anomalous ones."""
    return lines.join(labels.where(F.col("label") == keep).select(on), on, "left_semi")
