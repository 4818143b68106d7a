"""Text logs with line numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from logsift.scratch import materialize


# Most splits whose offsets (two numbers each) are broadcast, about 64 MB.
BROADCAST_SPLITS = 4_000_000


def number_lines(lines: DataFrame) -> DataFrame:
    """Add ``line_no`` (from 1, files in path order) to lines that carry ``file`` and ``block``.

    The lines are written once with their place, and both the counts and the numbers are taken
    from what was written, so a later change of the split size cannot move a line. The generated
    row id is consecutive inside one split of a file; adding up the line counts of the earlier
    splits gives the number. Only the table with one row per split is moved: a split is known by
    one number, so that of a million splits takes 16 MB.
    """
    placed = materialize(
        lines.withColumn("_split", F.xxhash64("file", "block")).withColumn(
            "_id", F.monotonically_increasing_id()
        ),
        "lines",
    )
    splits = materialize(
        placed.groupBy("file", "block", "_split").agg(
            F.min("_id").alias("_first"), F.count("*").alias("_lines")
        ),
        "splits",
    )
    sizes = splits.agg(F.count("*").alias("n"), F.count_distinct("_split").alias("keys")).first()
    if sizes["n"] != sizes["keys"]:
        raise ValueError("two file splits have the same hash; rename a file")
    files = splits.groupBy("file").agg(F.sum("_lines").alias("_lines"))
    # one row per file, then one row per split of a file
    earlier_files = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    earlier_splits = (
        Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    )
    bases = files.select("file", F.coalesce(F.sum("_lines").over(earlier_files), F.lit(0)).alias("_base"))
    offsets = splits.join(bases, "file").select(
        "_split",
        (
            F.col("_base")
            + F.coalesce(F.sum("_lines").over(earlier_splits), F.lit(0))
            - F.col("_first")
            + F.lit(1)
        ).alias("_shift"),
    )
    if sizes["n"] <= BROADCAST_SPLITS:
        offsets = F.broadcast(offsets)
    return placed.join(offsets, "_split").select(
        "file", (F.col("_id") + F.col("_shift")).alias("line_no"), "value"
    )


def unnumbered_lines(spark: SparkSession, path: str | list[str], on_error: str) -> DataFrame:
    """(file, block, value) of the text files under ``path``."""
    if on_error not in ("replace", "strict"):
        raise ValueError(f"on_error must be 'replace' or 'strict', got {on_error!r}")
    decode = F.make_valid_utf8 if on_error == "replace" else F.validate_utf8
    return spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        decode("value").alias("value"),
    )


def read_log_lines(spark: SparkSession, path: str | list[str], on_error: str = "replace") -> DataFrame:
    """Lines of the files under ``path`` as (file, line_no, value).

    ``on_error``: ``replace`` puts U+FFFD for bytes that are not UTF-8, ``strict`` fails.
    """
    return number_lines(unnumbered_lines(spark, path, on_error))
