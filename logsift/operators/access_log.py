"""Apache access log (COMBINED format) to typed columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logsift.functions.text import before, handle_malformed, token

# Fixed pattern: %h %l %u %t "%r" %>s %b "%{Referer}i" "%{User-Agent}i". The quoted parts
# use possessive loops, so long or broken lines cost neither backtracking nor stack.
_QUOTED = r'"([^"\\]*+(?:\\.[^"\\]*+)*+)"'
COMBINED = rf'^(\S+) (\S+) (\S+) \[([^\]]+)\] {_QUOTED} (\d{{3}}) (\d+|-) {_QUOTED} {_QUOTED}$'
COMBINED_GROUPS = 9
# Fixed value: the months as the server writes them.
MONTHS = "JanFebMarAprMayJunJulAugSepOctNovDec"
# Escape letters of the server and what they stand for.
CONTROLS = {"b": "\b", "f": "\f", "n": "\n", "r": "\r", "t": "\t", "v": "\v"}

TIME_COLUMNS = ["request_time", "year", "month", "day", "hour", "minute", "second"]
BASE_COLUMNS = [
    "remote_host",
    *TIME_COLUMNS,
    "request",
    "final_status",
    "bytes_sent",
    "status",
    "referer",
    "user_agent",
]
REQUEST_COLUMNS = ["command", "url", "parameters", "version"]
URL_SPLITS = 8
USER_AGENT_SPLITS = 10


def status_class(final_status: str | Column) -> Column:
    """0.1 for 1xx up to 0.5 for 5xx, 0.0 for anything else."""
    code = F.col(final_status) if isinstance(final_status, str) else final_status
    return (
        F.when(code.between(100, 199), F.lit(0.1))
        .when(code.between(200, 299), F.lit(0.2))
        .when(code.between(300, 399), F.lit(0.3))
        .when(code.between(400, 499), F.lit(0.4))
        .when(code.between(500, 599), F.lit(0.5))
        .otherwise(F.lit(0.0))
    )


def _present(text: Column) -> Column:
    return F.nullif(text, F.lit("-"))


def unescape(text: Column) -> Column:
    """Undo the server's escapes: ``\\xHH`` is one Latin-1 character, ``\\n`` and the like are controls."""
    pieces = F.regexp_extract_all(text, F.lit(r"(?s)(\\x[0-9A-Fa-f]{2}|\\.|[^\\]+)"), F.lit(1))

    def plain(piece: Column) -> Column:
        after = F.substring(piece, 2, 1)
        done = F.when(~F.startswith(piece, F.lit("\\")), piece)
        done = done.when(F.length(piece) == 4, F.char(F.conv(F.substring(piece, 3, 2), 16, 10).cast("int")))
        for letter, control in CONTROLS.items():
            done = done.when(after == letter, F.lit(control))
        return done.otherwise(after)

    return F.when(F.contains(text, F.lit("\\")), F.array_join(F.transform(pieces, plain), "")).otherwise(text)


def parse_access(lines: DataFrame, mode: str = "PERMISSIVE") -> DataFrame:
    """Columns of a COMBINED line; ``-`` becomes NULL, clock fields keep the line's own offset."""
    keep = [c for c in lines.columns if c != "value"]
    # One regex pass per line: the groups come back separated by newlines, which a line cannot
    # hold; a line that does not match comes back whole.
    groups = "\n".join(f"${i}" for i in range(1, COMBINED_GROUPS + 1))
    cut = lines.withColumn("_c", F.split(F.regexp_replace("value", COMBINED, groups), "\n"))
    single = ~F.contains(F.col("value"), F.lit("\n"))
    cut = cut.withColumn("_g", F.when((F.size("_c") == COMBINED_GROUPS) & single, F.col("_c")))
    quoted = {"_request": 4, "_referer": 7, "_user_agent": 8}
    cut = cut.withColumns({name: _present(token(F.col("_g"), i)) for name, i in quoted.items()})
    when = token(F.col("_g"), 3)
    month = F.instr(F.lit(MONTHS), F.substring(when, 4, 3))

    def clock(start: int, length: int) -> Column:
        return F.substring(when, start, length).try_cast("int")

    parsed = cut.select(
        *keep,
        "value",
        token(F.col("_g"), 0).alias("remote_host"),
        F.try_to_timestamp(when, F.lit("dd/MMM/yyyy:HH:mm:ss Z")).alias("request_time"),
        clock(8, 4).alias("year"),
        ((month + 2) / 3).cast("int").alias("month"),
        clock(1, 2).alias("day"),
        clock(13, 2).alias("hour"),
        clock(16, 2).alias("minute"),
        clock(19, 2).alias("second"),
        unescape(F.col("_request")).alias("request"),
        token(F.col("_g"), 5).cast("int").alias("final_status"),
        _present(token(F.col("_g"), 6)).try_cast("bigint").alias("bytes_sent"),
        unescape(F.col("_referer")).alias("referer"),
        unescape(F.col("_user_agent")).alias("user_agent"),
        status_class(token(F.col("_g"), 5).cast("int")).alias("status"),
    )
    return handle_malformed(
        parsed, F.col("request_time").isNotNull(), BASE_COLUMNS, keep, mode
    )


def split_request(table: DataFrame, mode: str = "PERMISSIVE") -> DataFrame:
    """Add command, url, parameters and version.

    A missing request gives "None" four times, ``OPTIONS`` has no url; everything after
    the first ``?`` of the target is parameters. A request that lacks the needed tokens
    is malformed.
    """
    none = F.lit("None")
    parts = F.split(F.coalesce("request", none), " ")
    cut = table.withColumn("_p", parts).withColumn("command", F.trim(token(F.col("_p"), 0)))
    missing = F.col("command") == none
    options = F.col("command") == "OPTIONS"
    target = token(F.col("_p"), 1)
    mark = F.instr(target, "?")
    split = cut.withColumns(
        {
            "url": F.when(missing | options, none).otherwise(before(target, "?")),
            "parameters": F.when(missing | options | (mark == 0), none).otherwise(
                F.substring(target, mark + 1, F.length(target))
            ),
            "version": F.when(missing, none).otherwise(token(F.col("_p"), 2)),
        }
    )
    malformed_line = F.col("request").isNotNull() & F.col("version").isNull()
    if "_corrupt" in table.columns:
        # an already corrupt line has no request: leave the parts empty as well
        good = ~malformed_line & F.col("_corrupt").isNull()
    else:
        good = ~malformed_line
    return handle_malformed(split, good, REQUEST_COLUMNS, table.columns, mode, line="request")


def url_parts(url: Column, max_splits: int = URL_SPLITS) -> Column:
    """Outer slashes removed, at most ``max_splits`` cuts, the last part keeps the remainder."""
    return F.split(F.btrim(url, F.lit("/")), "/", max_splits + 1)


def user_agent_parts(user_agent: Column, max_splits: int = USER_AGENT_SPLITS) -> Column:
    """Cut at ``;`` and at brackets; a missing agent is one part "No_User_Agent"."""
    text = F.translate(F.coalesce(user_agent, F.lit("No_User_Agent")), "()", ";;")
    return F.split(F.btrim(text, F.lit(";")), ";", max_splits + 1)


def split_url(table: DataFrame, max_splits: int = URL_SPLITS) -> DataFrame:
    """Replace ``url`` by the token array ``url_split``."""
    return table.withColumn("url_split", url_parts(F.col("url"), max_splits)).drop("url")


def split_user_agent(table: DataFrame, max_splits: int = USER_AGENT_SPLITS) -> DataFrame:
    """Replace ``user_agent`` by the token array ``user_agent_split``."""
    parts = user_agent_parts(F.col("user_agent"), max_splits)
    if "_corrupt" in table.columns:
        parts = F.when(F.col("_corrupt").isNull(), parts)
    return table.withColumn("user_agent_split", parts).drop("user_agent")
