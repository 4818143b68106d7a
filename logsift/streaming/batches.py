"""Results of a stream as one folder per micro-batch, so that a batch that runs again replaces itself.

The folder is named by the number of the batch, which a restarted query repeats with the same input.
The checkpoint lies in the same place: results and progress are kept or deleted together. A batch
counts once its folder has Spark's success marker, so readers never see half of one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from logsift.scratch import file_system

CHECKPOINT = "_checkpoint"
BATCH = "batch"
DONE = "_SUCCESS"


def write_batches(
    stream: DataFrame,
    path: str,
    result: Callable[[DataFrame], DataFrame] | None = None,
    output_mode: str = "append",
    **trigger,
) -> StreamingQuery:
    """Start a query that writes ``result`` of every micro-batch to ``path``; ``trigger`` as in Spark."""

    def write(batch: DataFrame, number: int) -> None:
        rows = result(batch) if result else batch
        rows.write.mode("overwrite").parquet(f"{path}/{BATCH}={number}")

    writer = stream.writeStream.outputMode(output_mode).option("checkpointLocation", f"{path}/{CHECKPOINT}")
    if trigger:
        writer = writer.trigger(**trigger)
    return writer.foreachBatch(write).start()


def finished_batches(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the batches that are written whole, ascending."""
    fs, jvm_path = file_system(spark, path)
    if not fs.exists(jvm_path(path)):
        return []
    names = [status.getPath().getName() for status in fs.listStatus(jvm_path(path))]
    numbers = [int(n.removeprefix(f"{BATCH}=")) for n in names if n.startswith(f"{BATCH}=")]
    return sorted(n for n in numbers if fs.exists(jvm_path(f"{path}/{BATCH}={n}/{DONE}")))


def read_batches(spark: SparkSession, path: str, schema) -> DataFrame:
    """The rows of all finished batches with their number as ``batch``."""
    done = finished_batches(spark, path)
    if not done:
        return spark.createDataFrame([], schema).selectExpr("*", f"CAST(NULL AS BIGINT) AS {BATCH}")
    folders = [f"{path}/{BATCH}={n}" for n in done]
    rows = spark.read.schema(schema).option("basePath", path).parquet(*folders)
    return rows.withColumn(BATCH, rows[BATCH].cast("long"))
