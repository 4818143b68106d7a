"""Linux imapd log: token table, filtered token table, authentication events and counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logsift.functions.text import handle_malformed, token
from logsift.operators.syslog import squeezed, syslog_table

IMAPD_SPLITS = 25
AUTH_SPLITS = 15
# Field names that carry no information.
FIELD_NAMES = [
    "os",
    "os-version",
    "vendor",
    "name",
    "version",
    "user:",
    "sys:",
    "login:",
    "starttls:",
    "counts:",
    "cipher",
    "bits",
    "with",
]
# Number of each kind of authentication line.
LOGIN, BADLOGIN, FAILED = 0, 1, 2
AUTH_COLUMNS = ["what", "IP", "userid"]
# Fixed value: the characters that \s stands for.
BLANKS = " \t\n\x0b\f\r"
BRACKETED_IPV4 = r"^\[\d+\.\d+\.\d+\.\d+\]$"


def _unquoted(line: Column) -> Column:
    return F.replace(squeezed(line), F.lit('"'), F.lit(""))


def parse_imapd(
    lines: DataFrame, max_split: int = IMAPD_SPLITS, mode: str = "PERMISSIVE"
) -> DataFrame:
    return syslog_table(lines, _unquoted(F.col("value")), max_split, mode)


def parse_imapd_filtered(
    lines: DataFrame, max_split: int = IMAPD_SPLITS, mode: str = "PERMISSIVE"
) -> DataFrame:
    """As ``parse_imapd`` without the field-name words; repeated other tokens stay."""

    def drop_field_names(tokens: Column) -> Column:
        return F.filter(tokens, lambda word: ~word.isin(FIELD_NAMES))

    return syslog_table(lines, _unquoted(F.col("value")), max_split, mode, drop_field_names)


def _is_ip(word: Column) -> Column:
    return F.coalesce(word.rlike(BRACKETED_IPV4), F.lit(False))


def _ipv4_number(word: Column) -> Column:
    """Dotted quad as one integer; NULL if an octet is over 255."""
    octets = F.split(F.translate(word, "[]", ""), r"\.")
    number = F.aggregate(
        F.transform(octets, lambda octet: F.when(F.length(octet) <= 3, octet.try_cast("bigint"))),
        F.lit(0).cast("bigint"),
        lambda so_far, octet: so_far * 256 + F.when(octet <= 255, octet),
    )
    return number


def imapd_auth_events(
    lines: DataFrame, max_split: int = AUTH_SPLITS, mode: str = "PERMISSIVE"
) -> DataFrame:
    """One row per login, badlogin or failed line: what, IP as integer, userid.

    Other lines are dropped. A line that ends before its IP or user is malformed.
    """
    keep = [c for c in lines.columns if c != "value"]
    t = F.col("_t")
    stripped = F.btrim(F.col("value"), F.lit(BLANKS))
    cut = lines.withColumn("_t", F.split(stripped, r"\s+", max_split + 1))
    word = token(t, 5)
    failed_at = F.array_position(
        F.slice(t, 7, F.greatest(F.size(t) - 6, F.lit(0))), F.lit("failed:")
    ).cast("int")
    kinds = cut.withColumns(
        {
            "what": F.when(word == "login:", LOGIN)
            .when(word == "badlogin:", BADLOGIN)
            .when(failed_at > 0, FAILED),
            "_x": F.when(word.isin("login:", "badlogin:"), 5).otherwise(failed_at + 5),
        }
    )
    near, far = token(t, F.col("_x") + 1), token(t, F.col("_x") + 2)
    tested = kinds.withColumns({"_near": _is_ip(near), "_far": _is_ip(far)})
    found = tested.withColumn("_at", F.col("_x") + F.when(F.col("_near"), 1).otherwise(2))
    after = token(t, F.col("_at") + 1)
    plaintext = (F.col("what") == BADLOGIN) & (after == "plaintext")
    parsed = found.withColumns(
        {
            "IP": F.when(F.col("_near") | F.col("_far"), _ipv4_number(token(t, F.col("_at")))).otherwise(
                F.lit(0).cast("bigint")
            ),
            "userid": F.when(F.col("what") == LOGIN, after)
            .when(plaintext, token(t, F.col("_at") + 2))
            .when((F.col("what") == BADLOGIN) & after.isNull(), F.lit(None))
            .otherwise("unknown"),
        }
    )
    whole = (
        F.col("what").isNotNull()
        & near.isNotNull()
        & (F.col("_near") | far.isNotNull())
        & F.col("IP").isNotNull()
        & F.col("userid").isNotNull()
    )
    # lines without a sixth token are malformed, lines of another kind are not wanted
    wanted = F.col("what").isNotNull() | (F.size("_t") < 6)
    return handle_malformed(parsed, whole, AUTH_COLUMNS, keep, mode, wanted=wanted)


def imapd_auth_counts(events: DataFrame, ordered: bool = True) -> DataFrame:
    """Numbers of login, badlogin and failed lines per (IP, userid), IP ordered as text."""

    def lines_of(kind: int, name: str) -> Column:
        return F.count_if(F.col("what") == kind).cast("bigint").alias(name)

    counts = (
        events.where(F.col("what").isNotNull())
        .groupBy("IP", "userid")
        .agg(lines_of(LOGIN, "login"), lines_of(BADLOGIN, "badlogin"), lines_of(FAILED, "failed"))
        .select("login", "badlogin", "failed", "IP", "userid")
    )
    return counts.orderBy(F.col("IP").cast("string"), "userid") if ordered else counts
