"""Label files: two CSV fields per log line, header-less."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logsift.sources.log_lines import number_lines, unnumbered_lines


def label_of(first: Column, second: Column) -> Column:
    """0 if both fields are "0", else 1 (numbers and texts alike)."""
    benign = (F.trim(first) == "0") & (F.trim(second) == "0")
    return F.when(benign, 0).otherwise(1)


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, label) of a label file; blank lines do not count as lines."""
    filled = unnumbered_lines(spark, path, "strict").where(F.trim("value") != "")
    fields = F.from_csv(F.col("value"), "c0 STRING, c1 STRING")
    return number_lines(filled).select("line_no", fields.alias("f")).select(
        "line_no", label_of(F.col("f.c0"), F.col("f.c1")).alias("label")
    )
