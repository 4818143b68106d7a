import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import logsift as ls
from logsift.checks.views import lines
from tests import brute

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def access_run(spark):
    log = lines(spark, SF, "access_lines")
    return log, ls.LogPipeline("access_url", "tsvd", "kmeans", "euclidean").run(log)


def test_access_tables(spark, access_run):
    log, run = access_run
    n = log.count()
    tables = run.tables
    for name in ("raw_data", "ml_ready_data", "US", "KMeans_Results", "identified_anomalies"):
        assert tables[name].count() == n, name
    assert tables["KMeans_Centroids"].count() == 2
    labels = {r.line_no: r.label for r in tables["identified_anomalies"].collect()}
    distances = {r.line_no: (r.d0, r.d1) for r in tables["anomaly_reduction_results"].collect()}
    plain = {k: 0 if d[0] < d[1] else 1 for k, d in distances.items()}
    status = {r.line_no: r.status for r in tables["raw_data"].collect()}
    failed = [k for k in plain if status[k] != 0.2]
    flip = sum(plain[k] for k in failed) > sum(1 - plain[k] for k in failed)
    assert labels == {k: 1 - v if flip else v for k, v in plain.items()}
    assert {r.line_no for r in tables["reduced_log"].collect()} == {k for k, v in labels.items() if v == 1}


def test_distances_use_the_space_of_the_centroids(access_run):
    _, run = access_run
    points = run.output.orderBy("line_no").collect()
    x = np.array([[r[c] for c in run.columns] for r in points])
    assert np.allclose(x.mean(axis=0), 0, atol=1e-9) and np.allclose(x.std(axis=0), 1)


def test_malformed_lines_are_kept(spark, access_run):
    log, run = access_run
    bad = spark.createDataFrame([(-1, "garbage"), (-2, "")], "line_no BIGINT, value STRING")
    mixed = log.where("line_no % 3 = 0").unionByName(bad)
    kept = ls.LogPipeline("access_url", "tsvd", "kmeans", "euclidean").run(mixed)
    assert {(r.line_no, r.value) for r in kept.tables["corrupt_lines"].collect()} == {(-1, "garbage"), (-2, "")}
    reduced = kept.tables["reduced_log"]
    assert "Exchange" not in reduced._jdf.queryExecution().executedPlan().toString()
    labels = kept.tables["identified_anomalies"].where("label = 1").count()
    assert reduced.count() == labels + 2 and {-1, -2} <= {r.line_no for r in reduced.collect()}
    scored = {r.line_no: r for r in run.score(mixed).collect()}
    assert scored[-1].malformed and scored[-1].label == 1 and scored[-1].d0 is None
    dropped = ls.LogPipeline("access", "tsvd", mode="DROPMALFORMED").run(mixed)
    assert "corrupt_lines" not in dropped.tables
    assert dropped.options["log_format"] == "access"


def test_missing_values_are_named(spark):
    table = spark.createDataFrame([(1, 1.0, None), (2, 2.0, 3.0)], "line_no BIGINT, a DOUBLE, b DOUBLE")
    for run in (lambda: ls.tsvd(table, ["a", "b"], 1), lambda: ls.tsvd(table, ["a", "b"], 1, False), lambda: ls.kmeans(table, ["a", "b"])):
        with pytest.raises(ValueError, match="missing values: b"):
            run()


def test_new_lines_get_the_same_labels(access_run):
    log, run = access_run
    again = {r.line_no: r.label for r in run.score(log.where("line_no % 3 = 0")).collect()}
    first = {r.line_no: r.label for r in run.tables["identified_anomalies"].collect()}
    assert again and all(first[k] == v for k, v in again.items())


def test_points_with_centroids(access_run):
    log, run = access_run
    labels = log.select("line_no", (F.col("line_no") % 2).alias("label"))
    points = run.points(2, labels)
    assert {r.label for r in points.collect()} == {"0", "1", "Centroid 0", "Centroid 1"}
    assert points.count() == log.count() + 2


def test_density_of_the_mail_log(spark):
    log = lines(spark, SF, "mail_lines")
    run = ls.LogPipeline("mail", "dbscan").run(log)
    features = run.tables["ml_ready_data"].orderBy("line_no").collect()
    cols = [c for c in run.tables["ml_ready_data"].columns if c != "line_no"]
    x = np.array([[r[c] for c in cols] for r in features])
    spread = x.std(axis=0)
    z = (x - x.mean(axis=0)) / np.where(spread > 1e-12, spread, 1.0)
    want, _, core = brute.density(z, 1.0, 5)
    got = run.tables["DBSCAN_Results"].orderBy("line_no").collect()
    assert [(r.label, r.is_core) for r in got] == list(zip(want, core))


@pytest.mark.parametrize("log_format,view", [
    ("access", "access_lines"), ("access_request", "access_lines"), ("access_url_agent", "access_lines"),
    ("error", "error_lines"), ("messages", "syslog_lines"), ("imapd", "syslog_lines"),
    ("imapd_filtered", "syslog_lines"), ("imapd_auth", "imapd_lines")])
def test_every_format_reaches_the_features(spark, log_format, view):
    log = lines(spark, SF, view)
    run = ls.LogPipeline(log_format, "tsvd_srss", reduce_options={"split": 1, "maximum": 2}).run(log)
    kinds = {f.dataType.typeName() for f in run.tables["ml_ready_data"].schema.fields}
    assert kinds <= {"double", "integer", "long"}
    assert run.tables["srss_reduction"].columns[-2:] == ["r0", "r1"]


def test_other_stages(spark):
    log = lines(spark, SF, "imapd_lines")
    run = ls.LogPipeline("imapd_auth", "tsvd_distance", "kmeans", "cosine").run(log)
    assert run.tables["distance"].count() == run.tables["identified_anomalies"].count()
    run = ls.LogPipeline("imapd_auth", "tsvd_score").run(log)
    scores = [r.score for r in run.tables["anomaly_score"].collect()]
    assert min(scores) == 0.0 and max(scores) == 1.0
    run = ls.LogPipeline("imapd_auth", "dbscan", "kmeans", "euclidean", reduce_options={"rtol": 0.01}).run(log)
    assert run.tables["DBSCAN_Samples"].agg(F.sum("weight")).head()[0] == run.tables["raw_data"].count()
    assert "sample" in run.tables["identified_anomalies"].columns
    doubled = ls.LogPipeline("imapd_auth", lambda t: t.select("line_no", (F.col("IP") * 2.0).alias("a"), (F.col("what") * 1.0).alias("b")), "kmeans").run(log)
    assert doubled.columns == ["a", "b"]
    with pytest.raises(ValueError):
        ls.LogPipeline("imapd_auth", "tsvd", anomaly="euclidean").run(log)
    with pytest.raises(ValueError):
        ls.LogPipeline("nothing").run(log)


def test_entry(spark):
    assert entry.entry(spark).columns == ["line_no", "label"]
