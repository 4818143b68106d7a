"""Log formats: lines to raw table, raw table to features."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logsift.operators.access_log import parse_access, split_request, split_url, split_user_agent
from logsift.operators.error_log import parse_error_log
from logsift.operators.features import expand_tokens
from logsift.operators.imapd_log import (
    imapd_auth_counts,
    imapd_auth_events,
    parse_imapd,
    parse_imapd_filtered,
)
from logsift.operators.mail_log import parse_mail
from logsift.operators.syslog import parse_messages
from logsift.scratch import number_rows


def _access_request(lines: DataFrame, mode: str) -> DataFrame:
    return split_request(parse_access(lines, mode), mode)


def _access_url(lines: DataFrame, mode: str) -> DataFrame:
    return split_url(_access_request(lines, mode))


PARSERS: dict[str, Callable[[DataFrame, str], DataFrame]] = {
    "access": parse_access,
    "access_request": _access_request,
    "access_url": _access_url,
    "access_url_agent": lambda lines, mode: split_user_agent(_access_url(lines, mode)),
    "error": parse_error_log,
    "messages": lambda lines, mode: parse_messages(lines, mode=mode),
    "mail": lambda lines, mode: parse_mail(lines, mode=mode),
    "imapd": lambda lines, mode: parse_imapd(lines, mode=mode),
    "imapd_filtered": lambda lines, mode: parse_imapd_filtered(lines, mode=mode),
    "imapd_auth": lambda lines, mode: imapd_auth_events(lines, mode=mode),
    "imapd_counts": lambda lines, mode: imapd_count_rows(imapd_auth_events(lines, mode=mode)),
}
# Array columns of the parsed tables and the prefix of the columns they become.
TOKEN_ARRAYS = {"url_split": "url_split", "user_agent_split": "user_agent_split", "message": "message"}
# What stands between the parts of such an array in the line.
JOINTS = {"url_split": "/", "user_agent_split": " ", "message": " "}
# The plain formats whose ``message`` is text, not tokens.
TEXT_MESSAGE = {"error"}


def imapd_count_rows(events: DataFrame) -> DataFrame:
    """The count table with its row number in the order of the table as ``line_no``."""
    counts = imapd_auth_counts(events, False).withColumn("_ip", F.col("IP").cast("string"))
    return number_rows(counts, ["_ip", "userid"], "line_no", first=1).drop("_ip")


def parse_format(lines: DataFrame, log_format: str, mode: str = "PERMISSIVE") -> DataFrame:
    """Parsed table of a named format, ragged parts still as arrays."""
    if log_format not in PARSERS:
        raise ValueError(f"log_format must be one of {sorted(PARSERS)}, got {log_format!r}")
    return PARSERS[log_format](lines, mode)


def widen(table: DataFrame, log_format: str, widths: dict[str, int] | None = None) -> DataFrame:
    """All token arrays of a parsed table as columns, as wide as the longest row or as given."""
    for array, prefix in TOKEN_ARRAYS.items():
        if array in table.columns and log_format not in TEXT_MESSAGE:
            table = expand_tokens(table, array, prefix, (widths or {}).get(array), JOINTS[array])
    return table
