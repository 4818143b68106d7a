"""From parsed tables to numeric feature columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logsift.functions.fnv import DEFAULT_INIT, fnv1_64_unit
from logsift.functions.text import rest_from, token

# Columns that identify a line; they pass through every operator unchanged.
KEY_COLUMNS = ["file", "line_no"]

_CLOCK = ["request_time", "year", "month", "day", "hour", "minute", "second"]
_ACCESS_DROPS = [*_CLOCK, "final_status"]
# Columns of each format's raw table that do not become features.
DROPPED = {
    "access": _ACCESS_DROPS,
    "access_request": [*_ACCESS_DROPS, "request"],
    "access_url": [*_ACCESS_DROPS, "request"],
    "access_url_agent": [*_ACCESS_DROPS, "request"],
    "error": [],
    "messages": ["date_time", "host"],
    "mail": ["date_time", "host", "daemon", "message_0"],
    "imapd": ["date_time", "host"],
    "imapd_filtered": ["date_time", "host"],
    "imapd_auth": [],
    "imapd_counts": [],
}


def expand_tokens(
    table: DataFrame, array_col: str, prefix: str, width: int | None = None, joint: str = " "
) -> DataFrame:
    """Array column to ``prefix_0 .. prefix_{w-1}``, short rows padded with NULL.

    Without ``width`` one aggregate finds the longest row; a streaming table needs it given.
    The last column of a longer row holds all that is left, joined by ``joint``.
    """
    if width is None:
        width = table.agg(F.max(F.size(array_col))).head()[0] or 0
    others = [c for c in table.columns if c != array_col]
    parts = [token(F.col(array_col), i) for i in range(width)]
    if width:
        rest = F.array_join(rest_from(F.col(array_col), width - 1), joint)
        parts[-1] = F.when(F.size(array_col) > width, rest).otherwise(parts[-1])
    return table.select(*others, *[p.alias(f"{prefix}_{i}") for i, p in enumerate(parts)])


def select_features(table: DataFrame, log_format: str) -> DataFrame:
    """Drop the time, host and message-id columns that the format does not use as features."""
    return table.drop(*DROPPED[log_format], "_corrupt")


def feature_columns(table: DataFrame) -> list[str]:
    return [c for c in table.columns if c not in KEY_COLUMNS]


def hash_encode(
    table: DataFrame,
    columns: list[str] | None = None,
    init: int = DEFAULT_INIT,
    engine: str = "arrow",
) -> DataFrame:
    """Hash every string feature into [0, 1], leave numeric features alone.

    A narrow projection: repeated values are hashed once per Arrow batch, so no join
    with a table of distinct values is needed. A missing byte count becomes 0.
    """
    chosen = set(columns if columns is not None else feature_columns(table))

    def encoded(field: T.StructField):
        if field.name not in chosen:
            return F.col(field.name)
        if isinstance(field.dataType, T.StringType):
            return fnv1_64_unit(field.name, init, engine).alias(field.name)
        if field.name == "bytes_sent":
            return F.coalesce(field.name, F.lit(0).cast(field.dataType)).alias(field.name)
        return F.col(field.name)

    return table.select(*[encoded(f) for f in table.schema.fields])
