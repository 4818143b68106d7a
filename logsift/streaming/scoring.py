"""Labels of a stream of lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from logsift.plans.model import LogModel
from logsift.streaming.batches import read_batches, write_batches


def stream_log_lines(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """(file, value) of text files as they appear under ``path``.

    A line number would need the earlier lines of its file, so a line is known by its file and text.
    """
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_batch).format("text").load(path)
    return lines.select(F.col("_metadata.file_path").alias("file"), F.make_valid_utf8("value").alias("value"))


def score_stream(model: LogModel, lines: DataFrame, path: str, **trigger) -> StreamingQuery:
    """Score every micro-batch of ``lines`` once and write it under ``path``.

    A query that is started again with the same path goes on where the last one stopped; a batch
    that was not finished is written anew in its place. The result has the key columns of the
    lines, their text, distances, label and flags, as ``LogModel.score``.
    """
    return write_batches(lines, path, lambda batch: model.score(batch, with_line=True), **trigger)


def read_scored(spark: SparkSession, path: str, model: LogModel) -> DataFrame:
    """The scored lines of all finished batches, with the number of the batch."""
    keys = "file string, line_no bigint, value string"
    names = ("d0", "d1") if model.anomaly == "euclidean" else ("s0", "s1")
    told = "label int, malformed boolean, overflow boolean"
    rows = read_batches(spark, path, f"{keys}, {', '.join(f'{n} double' for n in names)}, {told}")
    return rows
