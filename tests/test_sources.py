import glob
import json
import os

import pandas as pd
import pytest

import logsift as ls
from logsift.scratch import materialize, temporary_tables
from logsift.sources.results import CSV_READ


def test_line_numbers_over_many_splits(spark, tmp_path):
    folder = tmp_path / "logs"
    folder.mkdir()
    want = []
    for name, count in (("a.log", 700), ("b.log", 3), ("c.log", 900)):
        texts = [f"{name} line {i} {'x' * (i % 50)}" for i in range(count)]
        (folder / name).write_text("\n".join(texts) + "\n")
        want += texts
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("2000", "100000000"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            got = ls.read_log_lines(spark, str(folder)).orderBy("line_no").collect()
            assert [r.line_no for r in got] == list(range(1, len(want) + 1))
            assert [r.value for r in got] == want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_line_numbers_survive_a_changed_plan(spark, tmp_path):
    """Split sizes that change between definition and use neither lose nor renumber lines."""
    want = []
    for name, count in (("a.log", 800), ("b.log", 500)):
        texts = [f"{name} {i} {'y' * (i % 40)}" for i in range(count)]
        (tmp_path / name).write_text("\n".join(texts) + "\n")
        want += texts
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.minPartitionNum")
    old = {k: spark.conf.get(k, None) for k in keys}
    try:
        spark.conf.set(keys[0], "3000")
        read = ls.read_log_lines(spark, str(tmp_path))
        for size, number in (("100000000", "1"), ("1000", "40")):
            spark.conf.set(keys[0], size)
            spark.conf.set(keys[1], number)
            got = read.orderBy("line_no").collect()
            assert [(r.line_no, r.value) for r in got] == list(enumerate(want, 1))
    finally:
        for k, v in old.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def test_csv_reads_back(spark, tmp_path):
    texts = ['say "hi"', "back\\slash", "two\nlines", 'a,"b"\\', None, ""]
    table = spark.createDataFrame(list(enumerate(texts)), "n INT, t STRING")
    ls.save_results({"t": table.coalesce(1)}, str(tmp_path))
    back = spark.read.schema("n INT, t STRING").options(**CSV_READ).csv(str(tmp_path / "t"))
    assert [r.t for r in back.orderBy("n").collect()] == texts
    files = [pd.read_csv(f, keep_default_na=False) for f in glob.glob(f"{tmp_path}/t/*.csv")]
    assert [t or None for t in pd.concat(files)["t"]] == [t or None for t in texts]


def test_temporary_tables_go(spark):
    df = spark.range(5)
    with temporary_tables(spark):
        written = materialize(df, "kept")
        folder = written.inputFiles()[0].rsplit("/", 1)[0].removeprefix("file:")
        assert written.count() == 5 and os.path.isdir(folder)
    assert not os.path.exists(folder)


def test_invalid_bytes(spark, tmp_path):
    path = tmp_path / "x.log"
    path.write_bytes(b"ok\n\nbad \xff byte \xe2\x82 end\r\nlast")
    got = [r.value for r in ls.read_log_lines(spark, str(path)).orderBy("line_no").collect()]
    assert got == ["ok", "", "bad � byte � end", "last"]
    with pytest.raises(Exception, match="UTF"):
        ls.read_log_lines(spark, str(path), on_error="strict").collect()
    with pytest.raises(ValueError):
        ls.read_log_lines(spark, str(path), on_error="other")


@pytest.mark.parametrize(
    "text,want",
    [
        ("0,0\n0,1\n1,0\n", [0, 1, 1]),
        ("0,0\nfoothold,0\n0,dirb\nescalate,webshell\n", [0, 1, 1, 1]),
        ("0,0\n\n0,1\n   \n1,1,extra\n", [0, 1, 1]),
        (' 0 , 0\n"0","0"\n"a,b",0\n', [0, 0, 1]),
    ],
)
def test_labels(spark, tmp_path, text, want):
    path = tmp_path / "labels.csv"
    path.write_text(text)
    got = ls.read_labels(spark, str(path)).orderBy("line_no").collect()
    assert [(r.line_no, r.label) for r in got] == list(enumerate(want, 1))


def test_save_results(spark, tmp_path):
    df = spark.createDataFrame([(1, "a,b", None, [1, 2]), (2, "", "x", [])], "line_no BIGINT, t STRING, u STRING, l ARRAY<INT>")
    ls.save_results({"raw": df}, str(tmp_path / "csv"), {"eps": 0.5, "k": 2})
    reader = spark.read.option("header", True).option("nullValue", "\\N")
    back = reader.csv(str(tmp_path / "csv" / "raw")).orderBy("line_no").collect()
    assert [(r.t, r.u) for r in back] == [("a,b", None), ("", "x")]
    assert json.loads(back[0].l) == [1, 2]
    options = spark.read.option("header", True).csv(str(tmp_path / "csv" / "options")).collect()
    assert {(r.name, r.value) for r in options} == {("eps", "0.5"), ("k", "2")}
    ls.save_results({"raw": df}, str(tmp_path / "pq"), file_format="parquet")
    assert spark.read.parquet(str(tmp_path / "pq" / "raw")).count() == 2
    with pytest.raises(ValueError):
        ls.save_results({"raw": df}, str(tmp_path / "x"), file_format="xml")
