"""Linux mail log: message id, host name and IP found by position."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logsift.functions.text import count_of, handle_malformed, rest_from, token
from logsift.operators.syslog import HEAD_COLUMNS, squeezed, syslog_head

MAIL_SPLITS = 15
# What an integer looks like to the int() of Python.
INTEGER = r"^\s*[+-]?\d+(_\d+)*\s*$"


def parse_mail(
    lines: DataFrame, max_split: int = MAIL_SPLITS, mode: str = "PERMISSIVE"
) -> DataFrame:
    """Head columns plus ``message`` = [message id, host name, ip, remaining tokens ...].

    A cursor column walks over the tokens; it moves on only past a token that was taken.
    """
    keep = [c for c in lines.columns if c != "value"]
    t = F.col("_t")
    head = syslog_head(lines, squeezed(F.col("value")), max_split)

    first = token(t, 5)
    has_id = F.contains(first, F.lit(":")) & (F.length(first) > 8)
    with_id = head.withColumns(
        {
            "_id": F.when(has_id, F.replace(first, F.lit(":"), F.lit(""))).otherwise("No_Message_ID"),
            "_at": F.when(has_id, 6).otherwise(5),
        }
    )

    here = token(t, F.col("_at"))
    dots = count_of(here, ".")
    address = ~F.contains(here, F.lit("from=")) & ~F.contains(here, F.lit("to="))
    second_label = token(F.split(here, r"\."), 1)
    is_host = address & ((dots == 2) | ((dots == 3) & ~second_label.rlike(INTEGER)))
    with_host = with_id.withColumns(
        {
            "_host": F.when(is_host, here).otherwise("No_Hostname"),
            "_next": F.col("_at") + F.when(is_host, 1).otherwise(0),
        }
    )

    there = token(t, F.col("_next"))
    is_ip = (count_of(there, ".") == 3) & ~F.contains(there, F.lit("from="))
    with_ip = with_host.withColumns(
        {
            "_ip": F.when(is_ip, F.translate(there, "[]", "")).otherwise("No_IP_Address"),
            "_rest": F.col("_next") + F.when(is_ip, 1).otherwise(0),
        }
    )

    parsed = with_ip.withColumn(
        "message", F.concat(F.array("_id", "_host", "_ip"), rest_from(t, F.col("_rest")))
    )
    whole = (F.size("_t") > F.col("_at")) & (F.size("_t") > F.col("_next"))
    return handle_malformed(parsed, whole, [*HEAD_COLUMNS, "message"], keep, mode)
