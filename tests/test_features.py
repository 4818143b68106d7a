import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import logsift as ls
from logsift.functions.fnv import FNV_OFFSET_BASIS, fnv1_64_array
from tests import brute

TEXTS = ["", "a", "hello world", "grüße ☃ \U0001f600", "x" * 5000, "None", "\x00\x01"] + [str(i) * 3 for i in range(60)]


@pytest.mark.parametrize("init", [0, FNV_OFFSET_BASIS])
def test_array_hash_is_the_integer_hash(init):
    got = fnv1_64_array(pa.array(TEXTS), init)
    assert [int(v) for v in got] == [brute.fnv1_64(t.encode(), init) for t in TEXTS]
    sliced = pa.array(TEXTS)[3:9]
    assert [int(v) for v in fnv1_64_array(sliced, init)] == [brute.fnv1_64(t.encode(), init) for t in TEXTS[3:9]]
    assert len(fnv1_64_array(pa.array([], pa.string()))) == 0


@pytest.mark.parametrize("engine", ["arrow", "native"])
@pytest.mark.parametrize("init", [0, FNV_OFFSET_BASIS])
def test_unit_hash_in_spark(spark, engine, init):
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*TEXTS, None])], "line_no BIGINT, t STRING")
    got = {r.line_no: r.h for r in df.select("line_no", ls.fnv1_64_unit("t", init, engine).alias("h")).collect()}
    want = [brute.fnv1_64(t.encode(), init) / 2**64 for t in [*TEXTS, "None"]]
    assert [got[i] for i in range(len(want))] == want


def test_hash_encode_leaves_numbers(spark):
    df = spark.createDataFrame(
        [(1, "f", "a", None, 0.2), (2, "f", None, 7, 0.4)],
        "line_no BIGINT, file STRING, t STRING, bytes_sent BIGINT, status DOUBLE",
    )
    got = ls.hash_encode(df).orderBy("line_no").collect()
    assert [(r.file, r.bytes_sent, r.status) for r in got] == [("f", 0, 0.2), ("f", 7, 0.4)]
    assert got[1].t == brute.fnv1_64(b"None") / 2**64


def test_standardize(spark):
    x = np.random.default_rng(0).normal(3, 2, (50, 2))
    df = spark.createDataFrame([(i, float(a), float(b), 5.0) for i, (a, b) in enumerate(x)], "line_no BIGINT, a DOUBLE, b DOUBLE, c DOUBLE")
    got = ls.standardize(df, ["a", "b", "c"]).orderBy("line_no").collect()
    want = (x - x.mean(axis=0)) / x.std(axis=0)
    assert np.allclose([[r.a, r.b] for r in got], want) and all(r.c == 0.0 for r in got)
    unscaled = ls.fit_scaler(df, ["a"], with_mean=False, with_std=False)
    assert (unscaled.means, unscaled.deviations) == ([0.0], [1.0])


@pytest.mark.parametrize("parts", [1, 7])
def test_profile(spark, parts):
    rng = np.random.default_rng(1)
    numbers = rng.integers(0, 9, 101).astype(float)
    numbers[:40] = 4.0
    words = ["b", "a", "a", "b", None] * 20 + ["z"]
    df = spark.createDataFrame(
        [(i, w, float(n)) for i, (w, n) in enumerate(zip(words, numbers))], "line_no BIGINT, w STRING, n DOUBLE"
    ).repartition(parts)
    got = {r["column"]: r for r in ls.profile(df).collect()}
    assert (got["w"]["count"], got["w"]["unique"], got["w"]["top"], got["w"]["freq"]) == (81, 3, "a", 40)
    n = got["n"]
    assert n["count"] == 101 and n["unique"] is None
    assert np.allclose([n["mean"], n["std"], n["min"], n["max"]], [numbers.mean(), numbers.std(ddof=1), numbers.min(), numbers.max()])
    assert np.allclose([n["q25"], n["q50"], n["q75"]], np.percentile(numbers, [25, 50, 75]))
    rough = {r["column"]: r for r in ls.profile(df, exact=False).collect()}
    assert rough["w"]["top"] == "a" and rough["n"]["q50"] == 4.0


def test_access_file_order_and_hash_columns(spark):
    df = spark.range(3).select(F.col("id").alias("line_no"), F.lit("x").alias("a"), F.lit("x").alias("b"))
    row = ls.hash_encode(df).first()
    assert row.a == row.b
