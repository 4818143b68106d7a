import numpy as np
import pytest

from logsift import scratch
from logsift.operators import density_blocks, near_duplicates
from logsift.operators.components import connected_components
from logsift.operators.density import cluster_centroids, cluster_sizes, dbscan, optics
from logsift.operators.near_duplicates import combine_near_duplicates
from logsift.scratch import materialize, number_rows
from tests import brute


def frame(spark, x, parts=3):
    rows = [(i, *map(float, row)) for i, row in enumerate(x)]
    cols = [f"v{i}" for i in range(x.shape[1])]
    schema = "line_no BIGINT, " + ", ".join(f"{c} DOUBLE" for c in cols)
    return spark.createDataFrame(rows, schema).repartition(parts), cols


def labels_of(df):
    return {r.line_no: (r.label, r.is_core) for r in df.select("line_no", "label", "is_core").collect()}


def check(spark, x, eps, ms, both=True, **options):
    df, cols = frame(spark, x)
    want_db, want_op, core = brute.density(x, eps, ms)
    got = labels_of(dbscan(df, cols, eps, ms, normalize=False, **options))
    assert [got[i] for i in range(len(x))] == list(zip(want_db, core))
    if not both:
        return
    got = labels_of(optics(df, cols, eps, ms, normalize=False, **options))
    assert [got[i] for i in range(len(x))] == list(zip(want_op, core))


def cloud(seed, n, d, grid=None, copies=0):
    rng = np.random.default_rng(seed)
    centers = rng.uniform(-3, 3, (5, d))
    x = centers[rng.integers(0, 5, n)] + rng.normal(0, 0.35, (n, d))
    x[: n // 4] = rng.uniform(-4, 4, (n // 4, d))
    if grid:
        x = np.round(x / grid) * grid
    if copies:
        x[rng.integers(0, n, copies)] = x[0]
    return x


@pytest.mark.parametrize(
    "seed,n,d,eps,ms,grid,copies",
    [
        (1, 400, 2, 0.3, 5, None, 0),
        (2, 400, 2, 0.25, 8, 0.1, 130),
        (3, 300, 1, 0.05, 4, None, 0),
        (4, 400, 3, 0.5, 6, None, 0),
        (5, 300, 5, 0.9, 4, None, 50),
        (6, 300, 2, 0.2, 1, 0.2, 0),
    ],
)
def test_same_as_sequential(spark, seed, n, d, eps, ms, grid, copies):
    # the border rules differ on plain clouds and on copies; elsewhere one of them is enough
    check(spark, cloud(seed, n, d, grid, copies), eps, ms, both=seed in (1, 2))


@pytest.mark.parametrize("chunk", [7, 512])
def test_blocks_in_many_columns(spark, monkeypatch, chunk):
    monkeypatch.setattr(density_blocks, "CHUNK", chunk)
    monkeypatch.setattr(density_blocks, "HOT_CELL", 10)
    check(spark, cloud(11, 250, 6, 0.2, 60), 1.0, 5)


def test_blocks_write_in_proportion(spark, monkeypatch):
    """Ten columns, full neighbourhoods: no table grows with the pairs of points."""
    rows = {}

    def counted(df, name):
        out = materialize(df, name)
        rows[name] = rows.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(density_blocks, "materialize", counted)
    sizes = []
    for n in (200, 400):
        rows.clear()
        x = np.random.default_rng(3).normal(0, 0.4, (n, 10))
        df, cols = frame(spark, x)
        dbscan(df, cols, 1.0, 5, normalize=False).count()
        assert max(rows.values()) <= 27 * n and rows["edges"] <= rows["dealt"]
        sizes.append(rows["dealt"])
    assert sizes[1] < 3 * sizes[0]


def test_tables_grow_with_the_points_in_one_crowd(spark, monkeypatch):
    """Points of one cell beyond a chunk: twice the points make about twice the rows of every table."""
    rows = {}

    def counted(df, name):
        out = materialize(df, name)
        rows[name] = rows.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(density_blocks, "materialize", counted)
    seen = []
    for n in (2048, 4096):
        rows.clear()
        x = np.random.default_rng(5).normal(0, 0.1, (n, 6))
        x[:, :3] = np.abs(x[:, :3]) / 100  # one cell of the leading columns
        x[: n // 8, 3:] *= 8
        df, cols = frame(spark, x)
        found = dbscan(df, cols, 0.5, 20, normalize=False)
        assert found.where("label = 0").count() > n // 2
        seen.append(dict(rows))
    assert all(seen[0][name] <= 2 * 2048 and seen[1][name] <= 2 * 4096 for name in seen[0])
    big = [name for name in seen[0] if seen[0][name] > 200]
    assert {"dealt", "core"} <= set(big) and all(seen[1][name] < 2.5 * seen[0][name] for name in big)


def test_chunks_hold_every_point_once(spark, monkeypatch):
    monkeypatch.setattr(density_blocks, "CHUNK", 50)
    x = cloud(12, 700, 6)
    df, cols = frame(spark, x)
    points = df.selectExpr("line_no AS id", "1 AS w", *cols)
    dealt = density_blocks._dealt(points, cols, cols[:3], 1.0)
    chunks = density_blocks._chunks(dealt, 6).collect()
    assert sorted(i for c in chunks for i in c.ids) == list(range(700)) and max(c.n for c in chunks) <= 50
    for c in chunks:
        mine = np.array(c.x).reshape(-1, 6)
        assert np.allclose(mine, x[c.ids]) and {tuple(np.floor(r[:3] / (1 + 1e-6)).astype(int)) for r in mine} == {tuple(c.key)}
        assert np.sqrt(((mine - np.array(c.centre)) ** 2).sum(axis=1)).max() <= c.radius * (1 + 1e-12)


def test_pairs_of_chunks_do_not_grow_with_the_square(spark, monkeypatch):
    """Points that chunks settle inside and along the order are not compared with all others."""
    monkeypatch.setattr(density_blocks, "CHUNK", 20)
    rows = {}

    def counted(df, name):
        out = materialize(df, name)
        rows[name] = rows.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(density_blocks, "materialize", counted)
    seen = []
    for n in (400, 800):
        rows.clear()
        df, cols = frame(spark, np.abs(np.random.default_rng(4).normal(0, 0.1, (n, 5))))
        assert dbscan(df, cols, 1.0, 5, normalize=False).where("label = 0 and is_core").count() == n
        seen.append(dict(rows))
    assert all(seen[1][name] <= 3 * seen[0].get(name, 0) + 50 for name in seen[1])


def test_products_decide_as_sums_do():
    rng = np.random.default_rng(2)
    for shift in (0.0, 1e6):
        p, q = (np.round(rng.uniform(-1, 1, (60, 4)) * 4) / 4 + shift for _ in range(2))
        p[3, 1], q[5, 2], q[7, 0] = np.nan, np.inf, 1e200
        want = sum((p[:, None, c] - q[None, :, c]) ** 2 for c in range(4)) <= 1.0
        assert (density_blocks._Block._close(p, q, 1.0) == want).all() and want.any()


def test_large_cells_are_halved(spark):
    rng = np.random.default_rng(7)
    # two crowded cells that touch in one spot, two that do not
    a = rng.uniform(0, 0.6, (150, 2))
    b = rng.uniform(0, 0.6, (150, 2)) + [0.75, 0.0]
    c = rng.uniform(0, 0.6, (150, 2)) + [5.0, 5.0]
    d = rng.uniform(0, 0.3, (150, 2)) + [6.5, 6.5]
    x = np.vstack([a, b, c, d])
    check(spark, x[rng.permutation(len(x))], 1.0, 5, both=False, budget=40)


def test_hot_keys_are_dealt(spark, monkeypatch):
    monkeypatch.setattr(scratch, "HOT_KEY_ROWS", 5)
    check(spark, cloud(8, 250, 2, 0.1, 80), 0.3, 6, both=False)


def test_weights_from_combining(spark):
    x = cloud(9, 300, 2, 0.05, 60)
    df, cols = frame(spark, x)
    got = dbscan(df, cols, 0.4, 6, normalize=False, rtol=0.05).orderBy("sample").collect()
    reps, counts = brute.walk(x, 0.05)
    assert [r.weight for r in got] == counts
    assert np.allclose([[r.v0, r.v1] for r in got], reps)
    want, _, core = brute.density(reps, 0.4, 6, counts)
    assert [(r.label, r.is_core) for r in got] == list(zip(want, core))


@pytest.mark.parametrize("walk_rows,rtol", [(1_000, 0.08), (37, 0.001), (37, 0.6), (9, 0.08), (9, 0.6)])
def test_combining_is_the_sequential_walk(spark, walk_rows, rtol):
    x = cloud(10, 240, 2, 0.05, 40)
    df, cols = frame(spark, x, 5)
    reps, counts = brute.walk(x, rtol)
    got = combine_near_duplicates(df, cols, rtol, walk_rows).orderBy("sample").collect()
    assert [r.sample for r in got] == list(range(len(reps)))
    assert np.array_equal(np.array([[r.v0, r.v1] for r in got]), reps)
    assert [r.weight for r in got] == counts


def test_walks_are_short_where_rows_are_wide(spark, monkeypatch):
    """The numbers that a walk holds do not grow with the columns."""
    monkeypatch.setattr(near_duplicates, "WALK_CELLS", 600)
    seen = []
    monkeypatch.setattr(near_duplicates, "materialize", lambda df, name: seen.append((name, materialize(df, name))) or seen[-1][1])
    x = np.round(np.random.default_rng(3).normal(0, 1, (300, 12)), 2)
    df, cols = frame(spark, x, 4)
    reps, counts = brute.walk(x, 0.6)
    got = combine_near_duplicates(df, cols, 0.6).orderBy("sample").collect()
    assert np.array_equal(np.array([[r[c] for c in cols] for r in got]), reps) and [r.weight for r in got] == counts
    ranged = dict(seen)["ranged"]
    assert max(r["count"] for r in ranged.groupBy("_pid").count().collect()) < 150


def test_components_of_paths_and_stars(spark, monkeypatch):
    monkeypatch.setattr(scratch, "HOT_KEY_ROWS", 10)
    path = [(i, i + 1) for i in range(100, 160)]
    star = [(7, i) for i in range(10, 60)]
    ids = sorted({i for e in path + star for i in e} | {500})
    nodes = materialize(spark.createDataFrame([(i,) for i in ids], "id BIGINT"), "t")
    edges = spark.createDataFrame(path + star + [(7, 7)], "u BIGINT, v BIGINT")
    roots = {r.id: r.root for r in connected_components(nodes, edges).collect()}
    assert roots == {i: 100 if 100 <= i <= 160 else 500 if i == 500 else 7 for i in ids}


def test_empty_graph_and_noise_only(spark):
    x = np.array([[0.0, 0.0], [10.0, 0.0], [0.0, 10.0]])
    check(spark, x, 0.5, 2)


def test_sizes_and_centroids(spark):
    x = cloud(11, 200, 2)
    df, cols = frame(spark, x)
    found = dbscan(df, cols, 0.4, 5, normalize=False)
    labels, _, _ = brute.density(x, 0.4, 5)
    size = cluster_sizes(found).head()
    assert (size.n_clusters, size.n_noise) == (labels.max() + 1, (labels == -1).sum())
    for row in cluster_centroids(found, cols).collect():
        assert np.allclose([row.v0, row.v1], x[labels == row.cluster].mean(axis=0))


def test_numbers_follow_global_order(spark):
    df = spark.range(1000).selectExpr("(id * 7919) % 1000 AS v").repartition(7)
    got = number_rows(df, ["v"], "n").collect()
    assert all(r.v == r.n for r in got) and len(got) == 1000
