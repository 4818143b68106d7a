"""Queries and SQL for readers, parsers and the sink."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logsift.checks.views import line_stream, lines, table, view_sql
from logsift.operators.access_log import (
    REQUEST_COLUMNS,
    parse_access,
    split_request,
    split_url,
    split_user_agent,
)
from logsift.operators.error_log import parse_error_log
from logsift.operators.features import expand_tokens, select_features
from logsift.operators.imapd_log import (
    FIELD_NAMES,
    imapd_auth_counts,
    imapd_auth_events,
    parse_imapd,
    parse_imapd_filtered,
)
from logsift.operators.mail_log import parse_mail
from logsift.operators.syslog import parse_messages
from logsift.plans.formats import widen
from logsift.scratch import scratch_path
from logsift.sources.labels import label_of, read_labels
from logsift.sources.log_lines import read_log_lines
from logsift.sources.results import CSV_READ, save_results
from logsift.streaming.auth_counts import read_auth_counts, stream_auth_counts

MODE = "DROPMALFORMED"


def utc(column: str):
    """A timestamp as zone-less UTC, whatever the zone of the session."""
    local = F.col(column).cast("timestamp_ntz")
    return F.convert_timezone(F.current_timezone(), F.lit("UTC"), local).alias(column)


# ---------------------------------------------------------------- sources and sink


def read_log_lines_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "log")
    lines(spark, sf_dir, "access_lines").orderBy("line_no").select("value").write.text(path)
    return read_log_lines(spark, path).select("line_no", "value")


def read_labels_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "labels")
    rows = lines(spark, sf_dir, "label_rows").orderBy("line_no")
    rows.select(F.concat_ws(",", "c0", "c1").alias("value")).write.text(path)
    return read_labels(spark, path)


def label_rows_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lines(spark, sf_dir, "label_rows")
    return rows.select("line_no", label_of(F.col("c0"), F.col("c1")).alias("label"))


def save_results_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "results")
    raw = parse_access(lines(spark, sf_dir, "access_lines"), MODE)
    events = imapd_auth_events(lines(spark, sf_dir, "imapd_lines"), mode=MODE)
    save_results(
        {"raw_data": raw.select("line_no", "request", "referer", "status"), "auth": events},
        path,
        {"log_format": "access"},
    )
    schema = "line_no BIGINT, request STRING, referer STRING, status DOUBLE"
    back = spark.read.schema(schema).options(**CSV_READ).csv(f"{path}/raw_data")
    auth = (
        spark.read.schema("line_no BIGINT, what INT, IP BIGINT, userid STRING")
        .options(**CSV_READ)
        .csv(f"{path}/auth")
    )
    return back.join(auth, "line_no", "left")


# ---------------------------------------------------------------- parsers


def parse_access_query(spark, sf_dir):
    parsed = parse_access(lines(spark, sf_dir, "access_lines"), MODE)
    return parsed.withColumn("request_time", utc("request_time")).drop("status")


def status_class_query(spark, sf_dir):
    parsed = parse_access(lines(spark, sf_dir, "access_lines"), MODE)
    return parsed.groupBy("final_status", "status").agg(F.count("*").alias("n"))


def _requests(spark, sf_dir):
    return split_request(parse_access(lines(spark, sf_dir, "access_lines"), MODE), MODE)


def split_request_query(spark, sf_dir):
    return _requests(spark, sf_dir).select("line_no", *REQUEST_COLUMNS)


def requests_per_status_query(spark, sf_dir):
    return _requests(spark, sf_dir).groupBy("command", "status").agg(F.count("*").alias("n"))


def split_url_query(spark, sf_dir):
    cut = split_url(_requests(spark, sf_dir)).select("line_no", "url_split")
    return expand_tokens(cut, "url_split", "url_split", 9)


def split_user_agent_query(spark, sf_dir):
    parsed = parse_access(lines(spark, sf_dir, "access_lines"), MODE)
    cut = split_user_agent(parsed).select("line_no", "user_agent_split")
    return expand_tokens(cut, "user_agent_split", "user_agent_split", 11)


def parse_error_log_query(spark, sf_dir):
    return parse_error_log(lines(spark, sf_dir, "error_lines"), MODE)


def _widened(parser, view, width):
    def query(spark, sf_dir):
        return expand_tokens(parser(lines(spark, sf_dir, view), mode=MODE), "message", "message", width)

    return query


def imapd_auth_events_query(spark, sf_dir):
    return imapd_auth_events(lines(spark, sf_dir, "imapd_lines"), mode=MODE)


def imapd_auth_counts_query(spark, sf_dir):
    return imapd_auth_counts(imapd_auth_events_query(spark, sf_dir))


def stream_auth_counts_query(spark, sf_dir):
    """The same counts from a stream of the files of the table, by keyed state."""
    path = scratch_path(spark, "auth_counts")
    stream = line_stream(spark, sf_dir, "imapd_lines", "ts")
    stream_auth_counts(stream, path, "ts", mode=MODE, partitions=8, availableNow=True).awaitTermination()
    return read_auth_counts(spark, path)


def expand_tokens_query(spark, sf_dir):
    """Width found from the data; the longest row decides how many columns there are."""
    parsed = parse_messages(lines(spark, sf_dir, "syslog_lines"), mode=MODE)
    return expand_tokens(parsed.select("line_no", "message"), "message", "message")


def select_features_query(spark, sf_dir):
    table_ = widen(split_user_agent(split_url(_requests(spark, sf_dir))), "access_url_agent",
                   {"url_split": 9, "user_agent_split": 11})
    return select_features(table_, "access_url_agent")


def page_urls_query(spark, sf_dir):
    """URL splitting on the addresses of the pages table."""
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("line_no"), "url")
    return expand_tokens(split_url(pages), "url_split", "url_split", 9)


QUERIES = {
    "read_log_lines": read_log_lines_query,
    "read_labels": read_labels_query,
    "label_rows": label_rows_query,
    "save_results": save_results_query,
    "parse_access": parse_access_query,
    "status_class": status_class_query,
    "split_request": split_request_query,
    "requests_per_status": requests_per_status_query,
    "split_url": split_url_query,
    "split_url_pages": page_urls_query,
    "split_user_agent": split_user_agent_query,
    "parse_error_log": parse_error_log_query,
    "parse_messages": _widened(parse_messages, "syslog_lines", 2),
    "parse_mail": _widened(parse_mail, "mail_lines", 7),
    "parse_imapd": _widened(parse_imapd, "syslog_lines", 12),
    "parse_imapd_filtered": _widened(parse_imapd_filtered, "syslog_lines", 12),
    "imapd_auth_events": imapd_auth_events_query,
    "imapd_auth_counts": imapd_auth_counts_query,
    "stream_auth_counts": stream_auth_counts_query,
    "expand_tokens": expand_tokens_query,
    "select_features": select_features_query,
}


# ---------------------------------------------------------------- SQL

COMBINED_SQL = (
    r'^(\S+) (\S+) (\S+) \[([^\]]+)\] "((?:[^"\\]|\\.)*)" (\d{3}) (\d+|-) '
    r'"((?:[^"\\]|\\.)*)" "((?:[^"\\]|\\.)*)"$'
)
ACCESS_CTE = f"""{view_sql('access_lines')},
groups AS (SELECT line_no, regexp_extract(value, '{COMBINED_SQL}', ['host', 'l', 'u', 't', 'r', 's', 'b', 'ref', 'ua']) AS m FROM access_lines),
access AS (SELECT line_no, m.host AS remote_host, m.t AS t, nullif(m.r, '-') AS request, CAST(m.s AS INTEGER) AS final_status,
  CAST(nullif(m.b, '-') AS BIGINT) AS bytes_sent, nullif(m.ref, '-') AS referer, nullif(m.ua, '-') AS user_agent,
  CASE CAST(m.s AS INTEGER) // 100 WHEN 1 THEN 0.1::DOUBLE WHEN 2 THEN 0.2::DOUBLE WHEN 3 THEN 0.3::DOUBLE WHEN 4 THEN 0.4::DOUBLE WHEN 5 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS status
  FROM groups)"""

REQUEST_CTE = f"""{ACCESS_CTE},
tok AS (SELECT *, string_split(coalesce(request, 'None'), ' ') AS p FROM access),
requests AS (SELECT line_no, remote_host, bytes_sent, status, referer, user_agent, p[1] AS command,
  CASE WHEN p[1] IN ('None', 'OPTIONS') THEN 'None' ELSE split_part(p[2], '?', 1) END AS url,
  CASE WHEN p[1] IN ('None', 'OPTIONS') OR instr(p[2], '?') = 0 THEN 'None' ELSE substr(p[2], instr(p[2], '?') + 1) END AS parameters,
  CASE WHEN p[1] = 'None' THEN 'None' ELSE p[3] END AS version FROM tok)"""


def limited(list_sql: str, keep: int, separator: str) -> str:
    """A split list cut after ``keep`` pieces, the last one holding the remainder."""
    return (
        f"list_concat({list_sql}[1:{keep - 1}], CASE WHEN len({list_sql}) > {keep - 1} "
        f"THEN [array_to_string({list_sql}[{keep}:], '{separator}')] ELSE [] END)"
    )


def columns_of(list_name: str, prefix: str, width: int) -> str:
    return ", ".join(f"{list_name}[{i + 1}] AS {prefix}_{i}" for i in range(width))


URL_LIST = "string_split(trim(url, '/'), '/')"
AGENT_LIST = "string_split(trim(translate(coalesce(user_agent, 'No_User_Agent'), '()', ';;'), ';'), ';')"

SPLITS_CTE = f"""{REQUEST_CTE},
lists AS (SELECT *, {URL_LIST} AS ul, {AGENT_LIST} AS al FROM requests),
cuts AS (SELECT *, {limited('ul', 9, '/')} AS us, {limited('al', 11, ';')} AS uas FROM lists)"""


def syslog_sql(view: str, max_split: int, width: int, unquote: bool, filtered: bool) -> str:
    squeezed = "replace(replace(value, '  ', ' '), '  ', ' ')"
    text = f"replace({squeezed}, '\"', '')" if unquote else squeezed
    words = ", ".join(f"'{w}'" for w in FIELD_NAMES)
    rest = "list_filter(t[6:], lambda w: w NOT IN (" + words + "))" if filtered else "t[6:]"
    return f"""WITH {view_sql(view)},
raw AS (SELECT line_no, string_split({text}, ' ') AS w FROM {view}),
tok AS (SELECT line_no, {limited('w', max_split + 1, ' ')} AS t FROM raw),
cut AS (SELECT line_no, t[1] || ' ' || t[2] || ' ' || t[3] AS date_time, t[4] AS host, split_part(t[5], '[', 1) AS daemon, {rest} AS m FROM tok)
SELECT line_no, date_time, host, daemon, {columns_of('m', 'message', width)} FROM cut"""


DOTS = "(length({0}) - length(replace({0}, '.', '')))"

MAIL_SQL = f"""WITH {view_sql('mail_lines')},
raw AS (SELECT line_no, string_split(replace(replace(value, '  ', ' '), '  ', ' '), ' ') AS w FROM mail_lines),
tok AS (SELECT line_no, {limited('w', 16, ' ')} AS t FROM raw),
ids AS (SELECT *, contains(t[6], ':') AND length(t[6]) > 8 AS has_id FROM tok),
s1 AS (SELECT *, CASE WHEN has_id THEN replace(t[6], ':', '') ELSE 'No_Message_ID' END AS id, CASE WHEN has_id THEN 7 ELSE 6 END AS a FROM ids),
s2 AS (SELECT *, t[a] AS h FROM s1),
s3 AS (SELECT *, NOT contains(h, 'from=') AND NOT contains(h, 'to=') AND ({DOTS.format('h')} = 2 OR ({DOTS.format('h')} = 3 AND NOT regexp_matches(split_part(h, '.', 2), '^[+-]?\\d+(_\\d+)*$'))) AS is_host FROM s2),
s4 AS (SELECT *, CASE WHEN is_host THEN h ELSE 'No_Hostname' END AS hostname, a + CASE WHEN is_host THEN 1 ELSE 0 END AS b FROM s3),
s5 AS (SELECT *, t[b] AS i FROM s4),
s6 AS (SELECT *, {DOTS.format('i')} = 3 AND NOT contains(i, 'from=') AS is_ip FROM s5),
s7 AS (SELECT *, CASE WHEN is_ip THEN replace(replace(i, ']', ''), '[', '') ELSE 'No_IP_Address' END AS ip, b + CASE WHEN is_ip THEN 1 ELSE 0 END AS c FROM s6),
s8 AS (SELECT *, list_concat([id, hostname, ip], t[c:]) AS m FROM s7)
SELECT line_no, t[1] || ' ' || t[2] || ' ' || t[3] AS date_time, t[4] AS host, split_part(t[5], '[', 1) AS daemon, {columns_of('m', 'message', 7)} FROM s8"""

_QUAD = "'^\\[\\d+\\.\\d+\\.\\d+\\.\\d+\\]$'"
AUTH_CTE = f"""{view_sql('imapd_lines')},
tok AS (SELECT line_no, string_split_regex(trim(value), '\\s+') AS t FROM imapd_lines),
kind AS (SELECT *, CASE WHEN t[6] = 'login:' THEN 0 WHEN t[6] = 'badlogin:' THEN 1 WHEN list_contains(t[7:], 'failed:') THEN 2 END AS what,
  CASE WHEN t[6] IN ('login:', 'badlogin:') THEN 6 ELSE 6 + list_position(t[7:], 'failed:') END AS x FROM tok),
ip AS (SELECT *, coalesce(regexp_matches(t[x + 1], {_QUAD}), false) AS near, coalesce(regexp_matches(t[x + 2], {_QUAD}), false) AS far FROM kind WHERE what IS NOT NULL),
spot AS (SELECT *, CASE WHEN near THEN x + 1 ELSE x + 2 END AS a FROM ip),
quad AS (SELECT *, string_split(replace(replace(t[a], '[', ''), ']', ''), '.') AS o FROM spot),
auth AS (SELECT line_no, CAST(what AS INTEGER) AS what,
  CASE WHEN near OR far THEN CAST(o[1] AS BIGINT) * 16777216 + CAST(o[2] AS BIGINT) * 65536 + CAST(o[3] AS BIGINT) * 256 + CAST(o[4] AS BIGINT) ELSE 0 END AS "IP",
  CASE WHEN what = 0 THEN t[a + 1] WHEN what = 1 AND t[a + 1] = 'plaintext' THEN t[a + 2] ELSE 'unknown' END AS userid FROM quad)"""

ORACLES = {
    "read_log_lines": f"WITH {view_sql('access_lines')} SELECT row_number() OVER (ORDER BY line_no) AS line_no, value FROM access_lines",
    "read_labels": f"WITH {view_sql('label_rows')} SELECT row_number() OVER (ORDER BY line_no) AS line_no, CAST(CASE WHEN c0 = '0' AND c1 = '0' THEN 0 ELSE 1 END AS INTEGER) AS label FROM label_rows",
    "label_rows": f"WITH {view_sql('label_rows')} SELECT line_no, CAST(CASE WHEN c0 = '0' AND c1 = '0' THEN 0 ELSE 1 END AS INTEGER) AS label FROM label_rows",
    "save_results": f"WITH {ACCESS_CTE}, {AUTH_CTE} SELECT a.line_no, a.request, a.referer, a.status, u.what, u.\"IP\", u.userid FROM access a LEFT JOIN auth u ON u.line_no = a.line_no",
    "parse_access": f"""WITH {ACCESS_CTE} SELECT line_no, remote_host, strptime(substr(t, 1, 20), '%d/%b/%Y:%H:%M:%S') AS request_time,
  CAST(substr(t, 8, 4) AS INTEGER) AS year, CAST((instr('JanFebMarAprMayJunJulAugSepOctNovDec', substr(t, 4, 3)) + 2) // 3 AS INTEGER) AS month,
  CAST(substr(t, 1, 2) AS INTEGER) AS day, CAST(substr(t, 13, 2) AS INTEGER) AS hour, CAST(substr(t, 16, 2) AS INTEGER) AS minute, CAST(substr(t, 19, 2) AS INTEGER) AS second,
  request, final_status, bytes_sent, referer, user_agent FROM access""",
    "status_class": f"WITH {ACCESS_CTE} SELECT final_status, status, count(*) AS n FROM access GROUP BY final_status, status",
    "split_request": f"WITH {REQUEST_CTE} SELECT line_no, command, url, parameters, version FROM requests",
    "requests_per_status": f"WITH {REQUEST_CTE} SELECT command, status, count(*) AS n FROM requests GROUP BY command, status",
    "split_url": f"WITH {SPLITS_CTE} SELECT line_no, {columns_of('us', 'url_split', 9)} FROM cuts",
    "split_url_pages": f"WITH lists AS (SELECT page_id AS line_no, {URL_LIST} AS ul FROM pages), cuts AS (SELECT line_no, {limited('ul', 9, '/')} AS us FROM lists) SELECT line_no, {columns_of('us', 'url_split', 9)} FROM cuts",
    "split_user_agent": f"WITH {SPLITS_CTE} SELECT line_no, {columns_of('uas', 'user_agent_split', 11)} FROM cuts",
    "parse_error_log": f"""WITH {view_sql('error_lines')}, tok AS (SELECT line_no, string_split(value, '] ') AS p FROM error_lines)
SELECT line_no, substr(p[1], 2) AS date_time, split_part(substr(p[4], 9), ':', 1) AS source_ip,
  split_part(p[5], ', referer: ', 1) AS message, CASE WHEN contains(p[5], ', referer: ') THEN split_part(p[5], ', referer: ', 2) ELSE 'NONE' END AS referer FROM tok""",
    "parse_messages": syslog_sql("syslog_lines", 6, 2, False, False),
    "parse_mail": MAIL_SQL,
    "parse_imapd": syslog_sql("syslog_lines", 25, 12, True, False),
    "parse_imapd_filtered": syslog_sql("syslog_lines", 25, 12, True, True),
    "imapd_auth_events": f"WITH {AUTH_CTE} SELECT line_no, what, \"IP\", userid FROM auth",
    "imapd_auth_counts": f"WITH {AUTH_CTE} SELECT count_if(what = 0)::BIGINT AS login, count_if(what = 1)::BIGINT AS badlogin, count_if(what = 2)::BIGINT AS failed, \"IP\", userid FROM auth GROUP BY \"IP\", userid",
    "stream_auth_counts": f"WITH {AUTH_CTE} SELECT count_if(what = 0)::BIGINT AS login, count_if(what = 1)::BIGINT AS badlogin, count_if(what = 2)::BIGINT AS failed, \"IP\", userid FROM auth GROUP BY \"IP\", userid",
    "expand_tokens": f"""WITH {view_sql('syslog_lines')}, raw AS (SELECT line_no, string_split(replace(replace(value, '  ', ' '), '  ', ' '), ' ') AS w FROM syslog_lines),
tok AS (SELECT line_no, ({limited('w', 7, ' ')})[6:] AS m FROM raw) SELECT line_no, m[1] AS message_0, m[2] AS message_1 FROM tok""",
    "select_features": f"WITH {SPLITS_CTE} SELECT line_no, remote_host, bytes_sent, status, referer, command, parameters, version, {columns_of('us', 'url_split', 9)}, {columns_of('uas', 'user_agent_split', 11)} FROM cuts",
}
