"""Linux messages log to columns, and the head that all syslog files share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logsift.functions.text import before, handle_malformed, rest_from, token

HEAD_COLUMNS = ["date_time", "host", "daemon"]
MESSAGES_SPLITS = 6


def squeezed(line: Column) -> Column:
    """Two passes of double space to single space, no more: longer runs stay visible."""
    once = F.replace(line, F.lit("  "), F.lit(" "))
    return F.replace(once, F.lit("  "), F.lit(" "))


def syslog_head(lines: DataFrame, text: Column, max_split: int) -> DataFrame:
    """Add ``_t`` (tokens) and the head columns date_time, host and daemon."""
    cut = lines.withColumn("_t", F.split(text, " ", max_split + 1))
    t = F.col("_t")
    return cut.withColumns(
        {
            "date_time": F.concat_ws(" ", F.slice(t, 1, 3)),
            "host": token(t, 3),
            "daemon": before(token(t, 4), "["),
        }
    )


def syslog_table(lines: DataFrame, text: Column, max_split: int, mode: str, tokens=None) -> DataFrame:
    """Head columns plus the remaining tokens as the array ``message``."""
    keep = [c for c in lines.columns if c != "value"]
    headed = syslog_head(lines, text, max_split)
    rest = rest_from(F.col("_t"), 5)
    parsed = headed.withColumn("message", tokens(rest) if tokens else rest)
    return handle_malformed(parsed, F.size("_t") >= 5, [*HEAD_COLUMNS, "message"], keep, mode)


def parse_messages(
    lines: DataFrame, max_split: int = MESSAGES_SPLITS, mode: str = "PERMISSIVE"
) -> DataFrame:
    return syslog_table(lines, squeezed(F.col("value")), max_split, mode)
