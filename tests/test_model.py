import json
import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

import logsift as ls
from logsift.checks.views import lines
from logsift.plans import model as module
from logsift.plans.model import TABLES, load_model, model_versions

SF = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
LOAD = """
import sys
from tests.session import make_session
from logsift.plans.model import load_model
from logsift.checks.views import lines
spark = make_session("2")
load_model(spark, sys.argv[1]).score(lines(spark, sys.argv[2], "access_lines")).write.parquet(sys.argv[3])
"""


@pytest.fixture(scope="module")
def log(spark):
    return lines(spark, SF, "access_lines")


@pytest.fixture(scope="module")
def access_run(log):
    return ls.LogPipeline("access_url", "tsvd", "kmeans", "euclidean").run(log)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_loaded_in_another_process(spark, log, access_run, tmp_path):
    path, out = f"{tmp_path}/model", f"{tmp_path}/scored"
    assert access_run.save_model(path) == 1
    subprocess.run([sys.executable, "-c", LOAD, path, SF, out], check=True, cwd=ROOT, env={**os.environ, "PYTHONPATH": ROOT})
    assert rows(spark.read.parquet(out)) == rows(access_run.score(log))
    assert load_model(spark, path) == load_model(spark, path, 1)


@pytest.mark.parametrize(
    "plan",
    [
        {"log_format": "access", "reduce": "tsvd_srss", "then": "kmeans", "anomaly": "cosine", "reduce_options": {"maximum": 3, "split": 1}},
        {"log_format": "access", "reduce": "kmeans", "anomaly": "euclidean", "orient": False, "mode": "DROPMALFORMED"},
        {"log_format": "messages", "reduce": "tsvd", "then": "kmeans", "anomaly": "euclidean", "reduce_options": {"normalize": False}},
    ],
)
def test_every_kind_of_step(spark, tmp_path, plan):
    log = lines(spark, SF, "syslog_lines" if plan["log_format"] == "messages" else "access_lines")
    run = ls.LogPipeline(**plan).run(log)
    assert [run.save_model(str(tmp_path)) for _ in range(2)] == [1, 2]
    again = load_model(spark, str(tmp_path))
    assert rows(again.score(log)) == rows(run.score(log))
    bad = spark.createDataFrame([(-1, "garbage"), (-2, None)], "line_no BIGINT, value STRING")
    assert rows(again.score(bad, with_line=True)) == rows(run.fitted().score(bad, with_line=True))


def test_a_stopped_save_is_not_loadable(spark, access_run, tmp_path, monkeypatch):
    path = str(tmp_path)
    monkeypatch.setattr(module, "_commit", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt))
    with pytest.raises(KeyboardInterrupt):
        access_run.save_model(path)
    monkeypatch.undo()
    assert os.listdir(path) and model_versions(spark, path) == []
    with pytest.raises(FileNotFoundError):
        load_model(spark, path)
    assert access_run.save_model(path) == 1
    with pytest.raises(FileNotFoundError):
        load_model(spark, path, 2)
    # A manifest that another save put there first is passed over, not replaced.
    versions = f"{path}/_versions"
    first = open(f"{versions}/00000001.json").read()
    monkeypatch.setattr(module, "model_versions", lambda *a: [])
    assert access_run.save_model(path) == 2
    assert open(f"{versions}/00000001.json").read() == first


def test_damaged_models_are_told(spark, access_run, tmp_path):
    path = str(tmp_path)
    access_run.save_model(path)
    name = f"{path}/_versions/00000001.json"
    manifest = json.loads(open(name).read())
    assert set(manifest["rows"]) == set(TABLES)
    for change, error in (({"layout": 99}, "layout"), ({"rows": {**manifest["rows"], "centroids": 3}}, "centroids")):
        os.unlink(f"{path}/_versions/.00000001.json.crc") if os.path.exists(f"{path}/_versions/.00000001.json.crc") else None
        with open(name, "w") as file:
            json.dump({**manifest, **change}, file)
        with pytest.raises(ValueError, match=error):
            load_model(spark, path)


def test_what_cannot_be_stored(spark, log, tmp_path):
    own = ls.LogPipeline("access", lambda t: t.withColumn("bytes_sent", F.col("bytes_sent") * 2), "kmeans", "euclidean").run(log)
    assert own.score(log).count() == log.count()
    with pytest.raises(ValueError, match="function of its own"):
        own.save_model(str(tmp_path))
    with pytest.raises(ValueError, match="no label step"):
        ls.LogPipeline("access", "tsvd").run(log).save_model(str(tmp_path))
