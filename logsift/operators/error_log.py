"""Apache error log to columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logsift.functions.text import before, handle_malformed, strip_end, token

ERROR_COLUMNS = ["date_time", "source_ip", "message", "referer"]
REFERER_MARK = ", referer: "


def parse_error_log(lines: DataFrame, mode: str = "PERMISSIVE") -> DataFrame:
    """date_time, source_ip, message and referer ("NONE" when absent)."""
    keep = [c for c in lines.columns if c != "value"]
    cut = lines.withColumn("_p", F.split("value", r"\] "))
    text = token(F.col("_p"), 4)
    pieces = F.split(text, REFERER_MARK)
    has_referer = F.contains(text, F.lit(REFERER_MARK))
    parsed = cut.select(
        *keep,
        "value",
        F.substring(token(F.col("_p"), 0), 2, 1 << 30).alias("date_time"),
        before(F.substring(token(F.col("_p"), 3), 9, 1 << 30), ":").alias("source_ip"),
        F.when(has_referer, token(pieces, 0)).otherwise(strip_end(text)).alias("message"),
        F.when(has_referer, strip_end(token(pieces, 1))).otherwise(F.lit("NONE")).alias("referer"),
        ((F.size("_p") >= 5) & (F.size(pieces) <= 2)).alias("_whole"),
    )
    return handle_malformed(parsed, F.col("_whole"), ERROR_COLUMNS, keep, mode)
