"""Column profile: counts, most frequent value, moments and quartiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from logsift.operators.features import feature_columns
from logsift.scratch import BROADCAST_ROWS, materialize

QUARTILES = {"q25": 0.25, "q50": 0.5, "q75": 0.75}
PROFILE_COLUMNS = ["column", "count", "unique", "top", "freq", "mean", "std", "min", *QUARTILES, "max"]


def _long(table: DataFrame, columns: list[str]) -> DataFrame:
    """(column, text, number): string columns fill text, numeric columns number."""
    kinds = {f.name: isinstance(f.dataType, T.StringType) for f in table.schema.fields}
    cells = [
        F.struct(
            F.lit(name).alias("column"),
            (F.col(name) if kinds[name] else F.lit(None).cast("string")).alias("text"),
            (F.lit(None).cast("double") if kinds[name] else F.col(name).cast("double")).alias("number"),
        )
        for name in columns
    ]
    return table.select(F.inline(F.array(*cells)))


def _exact_quartiles(values: DataFrame) -> DataFrame:
    """Linear-interpolated quartiles from (column, number, n), one row per distinct number.

    The values are range-partitioned; running counts inside a partition start from the
    totals of the partitions before it, so no column goes through a single task.
    """
    placed = materialize(
        values.repartitionByRange("column", "number").withColumn("_pid", F.spark_partition_id()),
        "profile",
    )
    totals = placed.groupBy("column", "_pid").agg(F.sum("n").alias("_n"))
    by_partition = Window.partitionBy("column").orderBy("_pid")
    ahead = totals.select(
        "column",
        "_pid",
        F.coalesce(
            F.sum("_n").over(by_partition.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        ).alias("_ahead"),
        F.sum("_n").over(Window.partitionBy("column")).alias("_all"),
    )
    # one row per column and partition; usually few
    ahead = materialize(ahead, "ahead")
    if ahead.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        ahead = F.broadcast(ahead)
    inside = Window.partitionBy("_pid", "column").orderBy("number")
    ranked = placed.join(ahead, ["column", "_pid"]).withColumn(
        "_upto", F.col("_ahead") + F.sum("n").over(inside)
    )

    def at(index):
        """Value with 0-based rank ``index``."""
        return F.max(
            F.when((F.col("_upto") - F.col("n") <= index) & (index < F.col("_upto")), F.col("number"))
        )

    measures = []
    for name, q in QUARTILES.items():
        place = (F.col("_all") - 1) * F.lit(q)
        low = at(F.floor(place))
        high = at(F.ceil(place))
        share = F.max(place - F.floor(place))
        measures.append((low + (high - low) * share).alias(name))
    return ranked.groupBy("column").agg(*measures)


def profile(table: DataFrame, columns: list[str] | None = None, exact: bool = True) -> DataFrame:
    """One row per column, missing values ignored.

    String columns have count, unique, top and freq (of equally frequent values the
    smallest); numeric columns have count, mean, sample std, min, quartiles and max.
    The table is read once: values are counted, and everything else comes from the counts.
    ``exact=False`` estimates the quartiles and the distinct numbers of texts; it reads the table
    twice, but counts only texts.
    """
    columns = columns if columns is not None else feature_columns(table)
    long = _long(table, columns)
    moments = [
        F.avg("number").alias("mean"),
        F.stddev_samp("number").alias("std"),
        F.min("number").alias("min"),
        F.max("number").alias("max"),
    ]
    filled = F.count(F.coalesce(F.col("text"), F.col("number").cast("string"))).alias("count")
    if not exact:
        quartiles = F.approx_percentile("number", list(QUARTILES.values()))
        basic = long.groupBy("column").agg(
            filled,
            *moments,
            F.approx_count_distinct("text").alias("_texts"),
            quartiles.alias("_q"),
        )
        texts = long.where("text IS NOT NULL").groupBy("column", "text")
        top = _top_values(texts.agg(F.count("*").alias("n")))
        joined = basic.join(top.drop("unique"), "column", "left").withColumn(
            "unique", F.when(F.col("_texts") > 0, F.col("_texts"))
        )
        for i, name in enumerate(QUARTILES):
            joined = joined.withColumn(name, F.get("_q", F.lit(i)))
        return joined.select(*PROFILE_COLUMNS)

    counted = materialize(
        long.groupBy("column", "text", "number").agg(F.count("*").alias("n")), "values"
    )
    basic = _weighted_moments(counted)
    top = _top_values(counted.where("text IS NOT NULL"))
    quartiles = _exact_quartiles(counted.where("number IS NOT NULL").select("column", "number", "n"))
    return (
        basic.join(top, "column", "left").join(quartiles, "column", "left").select(*PROFILE_COLUMNS)
    )


def _weighted_moments(counted: DataFrame) -> DataFrame:
    """count, mean, std, min and max by column from (column, text, number, n)."""
    x, n = F.col("number"), F.col("n")
    numbers = F.sum(F.when(x.isNotNull(), n))
    sums = counted.groupBy("column").agg(
        F.coalesce(F.sum(F.when(x.isNotNull() | F.col("text").isNotNull(), n)), F.lit(0)).alias("count"),
        F.try_divide(F.sum(x * n), numbers).alias("mean"),
        numbers.alias("_numbers"),
        F.min("number").alias("min"),
        F.max("number").alias("max"),
    )
    # one row per column of the table
    apart = counted.where(x.isNotNull()).join(F.broadcast(sums.select("column", "mean")), "column")
    squares = apart.groupBy("column").agg(F.sum(n * (x - F.col("mean")) * (x - F.col("mean"))).alias("_squares"))
    spread = F.sqrt(F.try_divide(F.col("_squares"), F.col("_numbers") - 1))
    return sums.join(F.broadcast(squares), "column", "left").select(
        "column", "count", "mean", spread.alias("std"), "min", "max"
    )


def _top_values(counted: DataFrame) -> DataFrame:
    best = F.min(F.struct((-F.col("n")).alias("minus"), F.col("text")))
    return counted.groupBy("column").agg(F.count("*").alias("unique"), best.alias("_b")).select(
        "column", "unique", F.col("_b.text").alias("top"), (-F.col("_b.minus")).alias("freq")
    )
