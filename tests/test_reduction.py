import numpy as np
import pytest

import logsift as ls
from logsift.operators.svd import gramian, reconstruct, tsvd

rng = np.random.default_rng(3)


def frame(spark, x, parts=3):
    cols = [f"v{i}" for i in range(x.shape[1])]
    schema = "line_no BIGINT, " + ", ".join(f"{c} DOUBLE" for c in cols)
    return spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], schema).repartition(parts), cols


def values(df, cols):
    return np.array([[r[c] for c in cols] for r in df.orderBy("line_no").collect()])


@pytest.mark.parametrize("d", [2, 9])
@pytest.mark.parametrize("parts", [1, 4, 17])
def test_gramian_both_ways(spark, d, parts):
    x = rng.normal(0, 1, (60, d))
    df, cols = frame(spark, x, parts)
    assert np.allclose(gramian(df, cols), x.T @ x)


@pytest.mark.parametrize("normalize", [True, False])
@pytest.mark.parametrize("d,k", [(4, 2), (8, 8)])
def test_tsvd_is_the_svd(spark, d, k, normalize):
    x = rng.normal(1, 1, (80, d)) @ rng.normal(0, 1, (d, d))
    df, cols = frame(spark, x)
    svd = tsvd(df, cols, k, normalize)
    z = (x - x.mean(axis=0)) / x.std(axis=0) if normalize else x
    u, s, vt = np.linalg.svd(z, full_matrices=False)
    assert np.allclose(svd.singular_values, s[:k])
    assert np.allclose(np.abs(svd.components), np.abs(vt[:k]), atol=1e-6)
    assert all(c[int(np.argmax(np.abs(c)))] > 0 for c in svd.components)
    us = values(svd.transform(df), svd.reduced_columns)
    assert np.allclose(us, z @ np.array(svd.components).T)
    error = ls.reconstruction_error(df, svd).head().error
    assert np.isclose(error, np.linalg.norm(us @ np.array(svd.components) - z), atol=1e-8)
    ratios = [r.variance_ratio for r in ls.variance_ratios(df, svd).orderBy("component").collect()]
    assert np.allclose(ratios, us.var(axis=0) / z.var(axis=0).sum())
    curve = [r.t for r in svd.tables(spark)["T"].orderBy("component").collect()]
    kept = s[:k] ** 2
    assert np.allclose(curve, np.cumsum(kept) / kept.sum())
    if k == d:
        assert np.allclose(values(reconstruct(df, svd), cols), z)


def test_constant_column_and_bad_k(spark):
    x = np.column_stack([rng.normal(0, 1, 30), np.full(30, 7.0)])
    df, cols = frame(spark, x)
    svd = tsvd(df, cols, 2)
    assert np.isclose(svd.singular_values[1], 0.0)
    with pytest.raises(ValueError):
        tsvd(df, cols, 3)


def test_srss_distance_score(spark):
    x = rng.normal(0, 1, (70, 4)) * [3, 2, 1, 0.5]
    df, cols = frame(spark, x)
    svd, reduced = ls.tsvd_srss(df, cols, 1, 3)
    us = values(svd.transform(df), svd.reduced_columns)
    want = np.column_stack([np.abs(us[:, 0]), np.sqrt((us[:, 1:3] ** 2).sum(axis=1))])
    assert np.allclose(values(reduced, ["r0", "r1"]), want)
    svd, far = ls.tsvd_centroid_distance(df, cols)
    us = values(svd.transform(df), svd.reduced_columns)
    assert np.allclose(values(far, ["distance"])[:, 0], np.linalg.norm(us - us.mean(axis=0), axis=1))
    _, _, vt = np.linalg.svd(x, full_matrices=False)
    loss = ((x - x @ vt[:2].T @ vt[:2]) ** 2).sum(axis=1)
    score = values(ls.reconstruction_anomaly_score(df, cols, 2), ["score"])[:, 0]
    assert np.allclose(score, (loss - loss.min()) / (loss.max() - loss.min()))
    same, names = frame(spark, np.ones((5, 2)))
    assert set(values(ls.reconstruction_anomaly_score(same, names, 2), ["score"])[:, 0]) == {0.0}


def test_kmeans_is_a_fixed_point(spark):
    x = np.vstack([rng.normal(0, 0.5, (40, 2)), rng.normal(4, 0.5, (25, 2))])
    df, cols = frame(spark, x)
    fitted = ls.kmeans(df, cols, 2)
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    found = fitted.transform(df).orderBy("line_no").collect()
    labels = np.array([r.cluster for r in found])
    centers = np.array(fitted.centroids)
    assert np.allclose([[r[c] for c in cols] for r in found], z)
    assert (labels == ((z[:, None] - centers[None]) ** 2).sum(axis=2).argmin(axis=1)).all()
    assert np.allclose([z[labels == i].mean(axis=0) for i in (0, 1)], centers, atol=1e-3)
    assert (labels == 0).sum() == 40


def test_kmeans_more_clusters_than_points(spark):
    df, cols = frame(spark, np.array([[1.0, 1.0]] * 4 + [[2.0, 0.0]] * 2))
    fitted = ls.kmeans(df, cols, 3)
    assert fitted.transform(df).where("cluster = 0").count() == 4


def test_whole_vector_queries(spark):
    import __spark_entry__ as entry
    from logsift.checks.analysis import E
    from logsift.checks.views import matrix

    sf = "/root/testdata/sf0.001"
    run = lambda name: entry.queries()[f"{name}_whole"](spark, sf)
    x = values(matrix(spark, sf), E)
    assert x.shape[1] == 64

    def svd(m):
        _, s, vt = np.linalg.svd(m, full_matrices=False)
        size = np.abs(vt)
        lead = (size >= size.max(axis=1, keepdims=True) - 1e-9).argmax(axis=1)
        vt = vt * np.where(vt[np.arange(len(vt)), lead] < 0, -1, 1)[:, None]
        return s, vt, m @ vt.T

    _, _, us = svd((x - x.mean(axis=0)) / x.std(axis=0))
    assert np.allclose(values(run("tsvd"), ["c0", "c1"]), us[:, :2], atol=2e-6)
    s, vt, us = svd(x)
    assert np.allclose(values(run("tsvd_unscaled"), ["c0", "c1"]), us[:, :2], atol=2e-6)
    curve = run("energy_curve").toPandas().sort_values("component")
    assert np.allclose(curve["singular_value"], s, atol=2e-6)
    assert np.allclose(curve["t"], np.cumsum(s**2) / (s**2).sum(), atol=2e-6)
    vectors = curve[E].to_numpy()
    assert np.allclose(vectors @ vectors.T, np.eye(64), atol=1e-4)
    ratios = run("variance_ratios").toPandas().sort_values("component")["variance_ratio"]
    assert np.allclose(ratios, us[:, :2].var(axis=0) / x.var(axis=0).sum(), atol=2e-6)
    assert abs(run("reconstruction_error").head().error - np.sqrt((s[2:] ** 2).sum())) < 2e-6
    r = np.abs(us[:, :2])
    assert np.allclose(values(run("tsvd_srss"), ["r0", "r1"]), r, atol=2e-6)
    loss = (us[:, 2:] ** 2).sum(axis=1)
    score = (loss - loss.min()) / (loss.max() - loss.min())
    assert np.allclose(values(run("reconstruction_anomaly_score"), ["score"])[:, 0], score, atol=2e-6)
