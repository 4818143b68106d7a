import os

import pytest
from pyspark.sql import functions as F

import logsift as ls
from logsift.checks.views import LINES, lines, table
from logsift.streaming import auth_counts
from logsift.streaming.auth_counts import read_auth_counts, stream_auth_counts
from logsift.streaming.batches import finished_batches
from logsift.streaming.scoring import read_scored, score_stream, stream_log_lines

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def model(spark):
    return ls.LogPipeline("access_url", "tsvd", "kmeans", "euclidean").run(lines(spark, SF, "access_lines")).fitted()


@pytest.fixture(scope="module")
def texts(spark):
    rows = lines(spark, SF, "access_lines").orderBy("line_no").limit(300).collect()
    return [r.value for r in rows] + ["garbage", ""]


def add(folder, name, some):
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/.{name}", "w") as file:
        file.write("".join(f"{t}\n" for t in some))
    os.rename(f"{folder}/.{name}", f"{folder}/{name}")


def finish(query):
    query.awaitTermination()
    assert query.exception() is None


def scored(spark, path, model):
    return sorted((r.value, r.label, r.d0, r.d1, r.malformed) for r in read_scored(spark, path, model).collect())


def test_scored_stream_stopped_and_started_again(spark, model, texts, tmp_path, monkeypatch):
    source, out = f"{tmp_path}/in", f"{tmp_path}/out"
    for i in range(4):
        add(source, f"{i}.log", texts[i * 50 : i * 50 + 50])

    def start():
        return score_stream(model, stream_log_lines(spark, source, 1), out, availableNow=True)

    # The query dies after the third batch is written but before it is known to be done.
    calls, real = [], type(model).score

    def failing(self, *args, **options):
        calls.append(1)
        if len(calls) == 3:
            raise RuntimeError("lost")
        return real(self, *args, **options)

    monkeypatch.setattr(type(model), "score", failing)
    with pytest.raises(Exception, match="lost"):
        start().awaitTermination()
    monkeypatch.undo()
    assert finished_batches(spark, out) == [0, 1]
    add(source, "4.log", texts[200:])
    finish(start())
    lines_ = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "line_no BIGINT, value STRING")
    want = sorted((r.value, r.label, r.d0, r.d1, r.malformed) for r in model.score(lines_, True).collect())
    assert scored(spark, out, model) == want
    assert finished_batches(spark, out) == [0, 1, 2, 3, 4]

    # A batch that runs again replaces itself; one without its marker does not count.
    last = read_scored(spark, out, model).where("batch = 4").count()
    os.unlink(f"{out}/batch=4/_SUCCESS")
    assert read_scored(spark, out, model).count() == len(texts) - last
    for name in os.listdir(f"{out}/_checkpoint/commits"):
        if name.lstrip(".").startswith("4"):
            os.unlink(f"{out}/_checkpoint/commits/{name}")
    finish(start())
    assert scored(spark, out, model) == want
    assert read_scored(spark, f"{tmp_path}/none", model).count() == 0


def imapd(spark, events):
    return spark.sql(LINES["imapd_lines"].replace("event_id AS line_no", "ts, event_id AS line_no"), events=events)


def counts_of(df):
    return sorted((r.login, r.badlogin, r.failed, r.IP, r.userid) for r in df.collect())


def test_counts_of_a_stream(spark, tmp_path):
    """Files in the order of time, stopped and started between them: the counts of all lines together."""
    events = table(spark, SF, "events").orderBy("ts").collect()
    source, out = f"{tmp_path}/in", f"{tmp_path}/out"
    schema = table(spark, SF, "events").schema
    third = len(events) // 3
    for part in range(3):
        some = events[part * third : (part + 1) * third if part < 2 else None]
        spark.createDataFrame(some, schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
        finish(stream_auth_counts(imapd(spark, stream), out, "ts", "1 day", 86400, availableNow=True))
        seen = spark.createDataFrame(events[: third * (part + 1)] if part < 2 else events, schema)
        want = ls.imapd_auth_counts(ls.imapd_auth_events(imapd(spark, seen)), False)
        assert counts_of(read_auth_counts(spark, out)) == counts_of(want)
    told = spark.read.parquet(f"{out}/batch=*")
    assert told.where("closed").count() > 0


def test_state_is_bounded_by_the_timer_and_late_lines_drop(spark, tmp_path):
    def line(day, hour, user):
        value = f"Jan {day} {hour:02d}:00:00 mx1 imapd[1]: login: [10.0.0.1] {user} plaintext User logged in"
        return (f"2024-01-{day:02d} {hour:02d}:00:00", value)

    source, out = f"{tmp_path}/in", f"{tmp_path}/out"
    parts = [
        [line(1, 1, "a"), line(1, 1, "b"), line(1, 2, "a")],
        [line(2, 1, "c")],  # a day later: a and b are idle from the next batch on
        [line(2, 2, "c"), line(1, 1, "a")],  # a's line is behind the watermark
        [line(2, 3, "a")],  # a comes back
    ]
    sizes = []
    for rows in parts:
        df = spark.createDataFrame(rows, "ts STRING, value STRING").select(F.col("ts").cast("timestamp"), "value")
        df.coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema("ts TIMESTAMP, value STRING").parquet(source)
        query = stream_auth_counts(stream, out, "ts", "10 minutes", 3 * 3600, availableNow=True)
        finish(query)
        sizes.append([p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]][-1])
    got = {(r.userid, r.login) for r in read_auth_counts(spark, out).collect()}
    assert got == {("a", 3), ("b", 1), ("c", 2)}
    told = spark.read.parquet(f"{out}/batch=*")
    assert {r.userid for r in told.where("closed").collect()} == {"a", "b"}
    assert told.where("userid = 'a'").select("since").distinct().count() == 2


def test_rows_are_added_up_before_the_shuffle(spark):
    rows = [(0, 5, "u", f"2024-01-01 00:00:{i % 60:02d}") for i in range(5000)] + [(None, 5, "u", "2024-01-01 00:00:00")]
    events = spark.createDataFrame(rows, "what INT, IP BIGINT, userid STRING, ts STRING").withColumn("ts", F.col("ts").cast("timestamp"))
    sums = auth_counts.added_up(events.coalesce(1), "ts").collect()
    assert sum(r.login for r in sums) == 5000 and len(sums) < 5 and {r.failed for r in sums} == {0}

