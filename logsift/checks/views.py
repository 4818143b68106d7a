"""Log lines and matrices derived from the given tables, as SQL that Spark and DuckDB both run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ACCESS_LINES = """
SELECT event_id AS line_no, concat('10.0.', user_id % 4, '.', user_id % 250, ' - - [', lpad(concat('', day(ts)), 2, '0'), '/', substr('JanFebMarAprMayJunJulAugSepOctNovDec', CAST(3 * month(ts) - 2 AS INT), 3), '/', year(ts), ':', lpad(concat('', hour(ts)), 2, '0'), ':', lpad(concat('', minute(ts)), 2, '0'), ':', lpad(concat('', second(ts)), 2, '0'), ' +0000] "',
  CASE event_type WHEN 'click' THEN concat('GET /en/', event_id % 40, '/item/', user_id, '?k=', user_id % 13, '&u=http://a.example/x?y=1 HTTP/1.1')
    WHEN 'view' THEN concat('GET /en/', event_id % 40, '/ HTTP/1.1')
    WHEN 'signup' THEN concat('POST /signup/', user_id % 7, '/a/b/c/d/e/f/g/h/i HTTP/1.0')
    WHEN 'purchase' THEN CASE WHEN event_id % 10 = 0 THEN 'OPTIONS * HTTP/1.0' ELSE concat('PUT /cart/', event_id % 11, ' HTTP/1.1') END
    ELSE CASE WHEN event_id % 5 = 0 THEN '-' ELSE concat('GET /wp-admin/', event_id % 17, '.php HTTP/1.1') END END,
  '" ', CASE event_type WHEN 'click' THEN '200' WHEN 'view' THEN CASE WHEN event_id % 6 = 0 THEN '304' ELSE '200' END WHEN 'signup' THEN CASE WHEN event_id % 50 = 0 THEN '100' ELSE '201' END WHEN 'purchase' THEN '500' ELSE '404' END,
  ' ', CASE WHEN event_id % 20 = 0 THEN '-' ELSE concat('', (event_id * 37) % 5000) END,
  ' "', CASE WHEN event_id % 3 = 0 THEN '-' ELSE concat('http://ref.example/', user_id % 9) END, '" "',
  CASE user_id % 4 WHEN 0 THEN concat('Mozilla/5.0 (X11; Linux x86_64) Gecko/', user_id % 5) WHEN 1 THEN 'curl/8.0' WHEN 2 THEN '-' ELSE '(compatible; bot/1.0; +http://b.example)' END, '"') AS value FROM {events}
"""

ERROR_LINES = """
SELECT event_id AS line_no, concat('[', ts_s, '] [core:error] [pid ', user_id, '] [client 10.0.', user_id % 4, '.', user_id % 250, ':', 1000 + event_id % 9000, '] AH', lpad(concat('', event_id % 300), 5, '0'), ': File does not exist: /srv/', event_id % 23, CASE WHEN event_id % 4 = 0 THEN concat(', referer: http://ref.example/', user_id % 9) ELSE '' END) AS value
FROM (SELECT *, concat('Mon Jan ', lpad(concat('', day(ts)), 2, '0'), ' ', lpad(concat('', hour(ts)), 2, '0'), ':', lpad(concat('', minute(ts)), 2, '0'), ':00 ', year(ts)) AS ts_s FROM {events}) e
"""

SYSLOG_LINES = """
SELECT event_id AS line_no, concat('Jan ', CASE WHEN day(ts) < 10 THEN ' ' ELSE '' END, day(ts), ' ', lpad(concat('', hour(ts)), 2, '0'), ':', lpad(concat('', minute(ts)), 2, '0'), ':', lpad(concat('', second(ts)), 2, '0'), ' host', user_id % 3, ' ',
  CASE event_type WHEN 'error' THEN 'kernel:' WHEN 'view' THEN 'systemd[1]:' ELSE concat('sshd[', event_id, ']:') END, ' ',
  CASE event_type WHEN 'error' THEN concat('oops    at "', event_id % 19, '"') WHEN 'view' THEN 'Started session' WHEN 'click' THEN concat('login: user', user_id, ' os vendor name with cipher ', event_id % 5, ' bits') ELSE 'ok' END) AS value FROM {events}
"""

MAIL_LINES = """
SELECT event_id AS line_no, concat('Jan ', day(ts), ' ', lpad(concat('', hour(ts)), 2, '0'), ':00:00 mx1 sendmail[', event_id, ']: ',
  CASE event_type WHEN 'click' THEN concat('x', lpad(concat('', event_id), 9, '0'), ': mail.example.org [10.0.0.', user_id % 250, '] relay done')
    WHEN 'view' THEN concat('y', lpad(concat('', event_id), 9, '0'), ': a.b.example.org [10.0.1.', user_id % 250, '] stat=Sent')
    WHEN 'signup' THEN concat('z', lpad(concat('', event_id), 9, '0'), ': 10.0.2.', user_id % 250, ' probe ok')
    WHEN 'purchase' THEN concat('short: from=u', user_id, '@a.b.c, size=', event_id % 100)
    ELSE concat('plain text ', event_id % 7) END) AS value FROM {events}
"""

IMAPD_LINES = """
SELECT event_id AS line_no, concat('Jan ', day(ts), ' ', lpad(concat('', hour(ts)), 2, '0'), ':00:00 mx1 imapd[', event_id, ']: ',
  CASE event_type WHEN 'click' THEN concat('login: [10.0.0.', user_id % 50, '] user', user_id % 10, ' plaintext+TLS User logged in')
    WHEN 'view' THEN concat('login: h', user_id % 5, '.example.org [10.0.1.', user_id % 50, '] user', user_id % 10, ' plaintext')
    WHEN 'signup' THEN CASE WHEN event_id % 2 = 0 THEN concat('badlogin: [10.0.0.', user_id % 50, '] plaintext user', user_id % 10, ' invalid user') ELSE concat('badlogin: h.example.org [10.0.3.', user_id % 50, '] plain [SASL(-13)]') END
    WHEN 'purchase' THEN concat('TLS negotiation failed: h.example.org [10.0.4.', user_id % 50, ']')
    ELSE CASE WHEN event_id % 2 = 0 THEN 'login: localhost [::1] mailadm plaintext' ELSE 'accepted connection now' END END) AS value FROM {events}
"""

LABEL_ROWS = """
SELECT doc_id AS line_no, CASE WHEN quality = 1 THEN '0' ELSE 'low' END AS c0, CASE WHEN toxic = 0 THEN '0' ELSE 'toxic' END AS c1 FROM {labels}
"""

LINES = {
    "access_lines": ACCESS_LINES,
    "error_lines": ERROR_LINES,
    "syslog_lines": SYSLOG_LINES,
    "mail_lines": MAIL_LINES,
    "imapd_lines": IMAPD_LINES,
    "label_rows": LABEL_ROWS,
}
TABLES = ["events", "labels", "embeddings", "pages"]

DIMS = 64  # all values of an embedding
# The numeric matrix for DuckDB; ``matrix`` below builds the same one in Spark.
MATRIX_SQL = (
    "SELECT vec_id AS line_no, "
    + ", ".join(f"CAST(embedding[{i + 1}] AS DOUBLE) AS e{i}" for i in range(DIMS))
    + ", label, CASE WHEN label < 5 THEN 0.2::DOUBLE ELSE 0.4::DOUBLE END AS status FROM embeddings"
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the derived line views over its whole table."""
    source = "labels" if name == "label_rows" else "events"
    return spark.sql(LINES[name], **{source: table(spark, sf_dir, source)})


def line_stream(spark: SparkSession, sf_dir: str, name: str, *beside: str) -> DataFrame:
    """A view over ``events`` as a stream of its files, with further columns of the table."""
    # As a pattern, because a stream takes a single file by none but a pattern.
    events = spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parque[t]")
    text = LINES[name].replace("event_id AS line_no", ", ".join([*beside, "event_id AS line_no"]), 1)
    return spark.sql(text, events=events)


def matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(line_no, e0..e63, label, status) from the embeddings."""
    source = table(spark, sf_dir, "embeddings")
    cells = [F.get("embedding", F.lit(i)).cast("double").alias(f"e{i}") for i in range(DIMS)]
    status = F.when(F.col("label") < 5, F.lit(0.2)).otherwise(F.lit(0.4)).alias("status")
    return source.select(F.col("vec_id").alias("line_no"), *cells, "label", status)


def view_sql(name: str) -> str:
    """The view as one DuckDB common table expression ``name AS (...)``."""
    if name == "matrix":
        return f"matrix AS ({MATRIX_SQL})"
    text = LINES[name].format(**{t: t for t in TABLES})
    return f"{name} AS ({text})"


def rounded(column: str, alias: str | None = None):
    """Six places and no negative zero, the same on both sides of the check."""
    return (F.round(F.col(column), 6) + F.lit(0.0)).alias(alias or column)
