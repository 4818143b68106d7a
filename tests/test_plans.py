"""Shape of the physical plans and independence from the partitioning."""

import re

import pytest
from pyspark.sql import functions as F

import logsift as ls
from logsift.checks.analysis import E, QUERIES
from logsift.checks.views import lines, matrix

SF = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("view,parse", [
    ("access_lines", lambda d: ls.split_user_agent(ls.split_url(ls.split_request(ls.parse_access(d, "DROPMALFORMED"), "DROPMALFORMED")))),
    ("error_lines", lambda d: ls.parse_error_log(d, "DROPMALFORMED")),
    ("mail_lines", lambda d: ls.parse_mail(d, mode="DROPMALFORMED")),
    ("imapd_lines", lambda d: ls.imapd_auth_events(d, mode="DROPMALFORMED")),
    ("syslog_lines", lambda d: ls.parse_imapd_filtered(d, mode="DROPMALFORMED"))])
def test_parsing_is_one_narrow_pass(spark, view, parse):
    plan = plan_of(parse(lines(spark, SF, view)))
    assert "Exchange" not in plan and "Python" not in plan
    # each line is cut once, whatever is selected and dropped afterwards
    assert len(re.findall(r"split\(regexp_replace\(value", plan)) == (1 if view == "access_lines" else 0)


def test_hashing_is_one_python_stage_without_shuffle(spark):
    parsed = ls.parse_access(lines(spark, SF, "access_lines"), "DROPMALFORMED")
    plan = plan_of(ls.hash_encode(ls.select_features(parsed, "access")))
    assert plan.count("ArrowEvalPython") == 1 and "Exchange" not in plan


@pytest.mark.parametrize("name", ["euclidean_to_centroids", "tsvd", "srss", "standardize", "orient_labels_euclidean", "reconstruction_anomaly_score"])
def test_projections_do_not_shuffle_rows(spark, name):
    plan = plan_of(QUERIES[name](spark, SF))
    main = plan.split("Subqueries")[0]
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert "Window" not in plan
    assert not re.search(r"Exchange hashpartitioning", main)


def test_scan_reads_only_needed_columns(spark):
    df = ls.standardize(matrix(spark, SF), E).select("line_no", "e0")
    schema = re.search(r"ReadSchema: \S+", plan_of(df)).group()
    assert "label" not in schema and "vec_id" in schema


@pytest.mark.parametrize("name", ["tsvd", "dbscan", "combine_near_duplicates", "orient_labels_cosine", "kmeans"])
def test_results_do_not_depend_on_partitions(spark, monkeypatch, name):
    from logsift.checks import analysis

    results = []
    for parts in (1, 4, 17):
        monkeypatch.setattr(analysis, "matrix", lambda s, d: matrix(s, d).repartition(parts, F.rand(parts)))
        rows = QUERIES[name](spark, SF).collect()
        # sums over partitions differ in the last digits
        plain = [[round(v, 9) if isinstance(v, float) else v for v in row] for row in rows]
        results.append(sorted(map(str, plain)))
    assert results[0] == results[1] == results[2]
