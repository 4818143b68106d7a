"""Intermediate tables in the shared folder of the cluster.

Multi-pass operators cut their lineage by writing a Parquet table and reading it
back. The files outlive any executor, and their real size is what Catalyst then
uses to choose between broadcast and shuffle joins.
"""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# A join key that matches more left rows than this is spread over several tasks.
HOT_KEY_ROWS = 200_000
# Most rows that are ever broadcast on request (each a key and a few numbers).
BROADCAST_ROWS = 200_000
# Low bits of monotonically_increasing_id that hold the row's place in its partition.
_PLACE_BITS = 33
_PLACE_MASK = (1 << _PLACE_BITS) - 1


# Paths written while a ``temporary_tables`` block is open, innermost block last.
_open_blocks: list[list[str]] = []


def scratch_base(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, which all executors share.

    Outside local mode an unset folder is an error (whether a set one is shared cannot be told from
    its name); in local mode an unset one is a temporary folder of the process.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return _local_base()


@cache
def _local_base() -> str:
    return tempfile.mkdtemp(prefix="logsift-")


def scratch_path(spark: SparkSession, name: str) -> str:
    path = f"{scratch_base(spark)}/logsift/{name}-{uuid.uuid4().hex}"
    if _open_blocks:
        _open_blocks[-1].append(path)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and return a DataFrame that reads the written table."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def temporary_tables(spark: SparkSession):
    """Tables written inside the block are deleted at its end; use its results before."""
    _open_blocks.append([])
    try:
        yield
    finally:
        for path in _open_blocks.pop():
            _delete(spark, path)


def file_system(spark: SparkSession, folder: str):
    """(file system that holds ``folder``, constructor of its paths)."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def _delete(spark: SparkSession, folder: str) -> None:
    fs, path = file_system(spark, folder)
    fs.delete(path(folder), True)


def discard(*written: DataFrame) -> None:
    """Delete the files of written tables that nothing reads any more."""
    for df in written:
        for folder in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
            _delete(df.sparkSession, folder)


def place_columns(partition: str = "_pid", place: str = "_pos"):
    """Partition number and place in it, both taken from one generated id."""
    row_id = F.monotonically_increasing_id()
    return [
        F.shiftright(row_id, _PLACE_BITS).alias(partition),
        row_id.bitwiseAND(F.lit(_PLACE_MASK)).alias(place),
    ]


def number_rows(df: DataFrame, order: list[str], name: str, first: int = 0) -> DataFrame:
    """Consecutive numbers in global ``order`` without a one-task window over the rows.

    Rows are range-partitioned and sorted; only one count per partition goes through
    the running sum.
    """
    placed = materialize(
        df.repartitionByRange(*order).sortWithinPartitions(*order).select("*", *place_columns()),
        "numbered",
    )
    per_partition = placed.groupBy("_pid").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_partition.select(
        "_pid", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset")
    )
    return (
        placed.join(F.broadcast(offsets), "_pid")  # one row per partition
        .withColumn(name, F.col("_offset") + F.col("_pos") + F.lit(first))
        .drop("_pid", "_pos", "_offset")
    )


def hot_keys(
    counts: DataFrame, keys: list[str], rows: str, limit: int | None = None
) -> DataFrame | None:
    """Keys of the written table ``counts`` with more than ``limit`` rows, or None.

    ``limit`` is HOT_KEY_ROWS unless given (less where the rows are wide).

    The result has the keys and ``_copies``, the number of tasks to deal their rows to;
    it is marked for broadcast only after its size has been looked up.
    """
    limit = limit or HOT_KEY_ROWS
    copies = _copies(rows, limit).alias("_copies")
    hot = counts.where(F.col(rows) > limit).select(*keys, copies)
    found = hot.limit(BROADCAST_ROWS + 1).count()
    if found == 0:
        return None
    return F.broadcast(hot) if found <= BROADCAST_ROWS else hot


def _copies(rows: str, limit: int) -> Column:
    return F.greatest(F.ceil(F.col(rows) / F.lit(limit)), F.lit(1)).cast("bigint")


def join_dealt(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    rows: str,
    hot: DataFrame | None,
    limit: int | None = None,
) -> DataFrame:
    """Inner equi-join in which the left rows of a hot key are dealt out over several tasks.

    ``rows`` is the column of ``right`` that counts the left rows of the key, so a right
    row of a hot key is repeated once per task and every pair still meets exactly once.
    """
    if hot is None:
        return left.join(right, keys)
    deal = F.pmod(F.xxhash64(*[F.col(c) for c in left.columns]), F.col("_copies"))
    dealt = (
        left.join(hot, keys, "left")
        .withColumn("_copy", F.coalesce(deal, F.lit(0).cast("bigint")))
        .drop("_copies")
    )
    start = F.lit(0).cast("bigint")
    last = _copies(rows, limit or HOT_KEY_ROWS) - F.lit(1)
    spread = right.withColumn("_copy", F.explode(F.sequence(start, last)))
    return dealt.join(spread, [*keys, "_copy"]).drop("_copy")


def join_counted(
    left: DataFrame, right: DataFrame, keys: list[str], rows: str, limit: int | None = None
) -> DataFrame:
    """``join_dealt`` to a written table, with the hot keys looked up in it."""
    hot = hot_keys(right, keys, rows, limit)
    return join_dealt(left, right, keys, rows, hot, limit).drop(rows)
