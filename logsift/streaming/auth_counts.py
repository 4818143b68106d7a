"""Login, badlogin and failed lines per (IP, userid) over a stream of imapd lines.

Lines are added up within each Arrow batch first, by key and minute, so a key that fills a third of
the stream sends a few rows to its task. The state of a key is its counts since it became active. It
is told after every batch in which it grew, and dropped by an event-time timer once the watermark is
``idle`` past its last line; a key that comes back starts a new period. Lines behind the watermark are
dropped. What is held is thus the keys active within ``idle``, however long the stream.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from logsift.operators.imapd_log import BADLOGIN, FAILED, LOGIN, imapd_auth_events
from logsift.streaming.batches import BATCH, read_batches, write_batches

KINDS = {"login": LOGIN, "badlogin": BADLOGIN, "failed": FAILED}
PARTIAL = "IP bigint, userid string, seen timestamp, login bigint, badlogin bigint, failed bigint"
TOLD = "IP bigint, userid string, since timestamp, login bigint, badlogin bigint, failed bigint, closed boolean"
_STATE = "since bigint, timer bigint, login bigint, badlogin bigint, failed bigint"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_PARTITIONS = "spark.sql.shuffle.partitions"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def added_up(events: DataFrame, time: str) -> DataFrame:
    """PARTIAL sums per key and minute of each batch of rows (what, IP, userid, time)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            what, address, user, seen = batch.columns
            counts = [pc.cast(pc.equal(what, pa.scalar(n, what.type)), pa.int64()) for n in KINDS.values()]
            minute = pc.floor_temporal(seen, unit="minute")
            table = pa.table([address, user, minute, seen, *counts], names=["IP", "userid", "minute", "seen", *KINDS])
            sums = table.group_by(["IP", "userid", "minute"]).aggregate([("seen", "max"), *[(k, "sum") for k in KINDS]])
            named = sums.select(["IP", "userid", "seen_max", *[f"{k}_sum" for k in KINDS]])
            yield from named.rename_columns(["IP", "userid", "seen", *KINDS]).combine_chunks().to_batches()

    chosen = events.where(F.col("what").isNotNull() & F.col(time).isNotNull())
    return chosen.select("what", "IP", "userid", F.col(time).cast("timestamp").alias("seen")).mapInArrow(rows, PARTIAL)


class ActiveKeys(StatefulProcessor):
    """Counts of one key since it became active, with a timer that ends its period."""

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("active", _STATE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        found = [(f["seen"].min(), f["seen"].max(), *(int(f[k].sum()) for k in KINDS)) for f in rows]
        ms = lambda t: int(t.timestamp() * 1000)
        since, timer, before = ms(min(f[0] for f in found)), 0, (0, 0, 0)
        if self.state.exists():
            since, timer, *before = self.state.get()
            self.handle.deleteTimer(timer)
        timer = max(timer, ms(max(f[1] for f in found)) + self.idle_ms)
        counts = tuple(b + sum(f[2 + i] for f in found) for i, b in enumerate(before))
        self.state.update((since, timer, *counts))
        self.handle.registerTimer(timer)
        yield self._told(key, since, counts, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        since, _, *counts = self.state.get()
        self.state.clear()
        yield self._told(key, since, counts, True)

    def _told(self, key, since, counts, closed) -> pd.DataFrame:
        row = (*key, pd.Timestamp(since, unit="ms"), *counts, closed)
        return pd.DataFrame([row], columns=["IP", "userid", "since", *KINDS, "closed"])

    def close(self) -> None:
        pass


def auth_count_updates(
    lines: DataFrame, time: str, delay: str = "10 minutes", idle_seconds: int = 3600, mode: str = "PERMISSIVE"
) -> DataFrame:
    """TOLD rows of the keys that grew or ended; a later row of a key and ``since`` replaces earlier ones."""
    events = imapd_auth_events(lines, mode=mode)
    return (
        added_up(events, time)
        .withWatermark("seen", delay)
        .groupBy("IP", "userid")
        .transformWithStateInPandas(ActiveKeys(idle_seconds * 1000), TOLD, "Update", "EventTime")
    )


def stream_auth_counts(
    lines: DataFrame,
    path: str,
    time: str,
    delay: str = "10 minutes",
    idle_seconds: int = 3600,
    mode: str = "PERMISSIVE",
    partitions: int | None = None,
    **trigger,
) -> StreamingQuery:
    """Count the stream ``lines`` (value and the event time column ``time``) under ``path``.

    Started again with the same path, the query goes on where it stopped. ``partitions`` of the state
    stay what they are at the first start, by default those of shuffles; each has a Python worker in
    every batch.
    """
    spark = lines.sparkSession
    updates = auth_count_updates(lines, time, delay, idle_seconds, mode)
    # Keyed state with timers needs the provider; a query keeps the settings of its start.
    settings = {_PROVIDER: _ROCKSDB} | ({_PARTITIONS: str(partitions)} if partitions else {})
    before = {key: spark.conf.get(key) for key in settings}
    try:
        for key, value in settings.items():
            spark.conf.set(key, value)
        return write_batches(updates, path, output_mode="update", **trigger)
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def read_auth_counts(spark: SparkSession, path: str) -> DataFrame:
    """Counts so far per (IP, userid), as ``imapd_auth_counts`` gives for the lines together."""
    rows = read_batches(spark, path, TOLD)
    last = rows.groupBy("IP", "userid", "since").agg(F.max_by(F.struct(*KINDS), BATCH).alias("last"))
    sums = [F.sum(F.col("last")[k]).alias(k) for k in KINDS]
    return last.groupBy("IP", "userid").agg(*sums).select(*KINDS, "IP", "userid")
