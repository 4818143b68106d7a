import random

import numpy as np
import pytest

import logsift as ls
from logsift.operators import kmeans as module


def table(spark, n, parts=4, seed=3):
    rnd = random.Random(seed)
    middles = [(0, 0, 0), (4, 0, 1), (0, 5, 2), (6, 6, 3)]
    rows = [(i, *(m + rnd.gauss(0, 1) for m in rnd.choices(middles, (8, 4, 2, 1))[0])) for i in range(n)]
    return spark.createDataFrame(rows, "line_no BIGINT, a DOUBLE, b DOUBLE, c DOUBLE").repartition(parts)


COLUMNS = ["a", "b", "c"]


def cost(df, fitted):
    x = np.array([[r[c] for c in COLUMNS] for r in fitted.scaled(df).collect()])
    return ((x[:, None] - np.array(fitted.centroids)) ** 2).sum(axis=2).min(axis=1).sum()


def test_same_result_in_one_task_and_in_many(spark, monkeypatch):
    want = ls.kmeans(table(spark, 3000), COLUMNS, 4)
    assert want.converged and cost(table(spark, 3000), want) > 0
    for parts in (1, 3, 17):
        assert ls.kmeans(table(spark, 3000, parts), COLUMNS, 4).centroids == want.centroids
    monkeypatch.setattr(module, "CELLS_PER_TASK", 0)
    monkeypatch.setattr(module, "ROWS_PER_TASK", 700)
    for parts in (3, 17):
        assert ls.kmeans(table(spark, 3000, parts), COLUMNS, 4).centroids == want.centroids


def test_cost_against_many_plain_runs(spark, monkeypatch):
    """As cheap as the best of twenty runs from random rows, with all rows as candidates or some."""
    df = table(spark, 1500)
    x = np.array([[r[c] for c in COLUMNS] for r in ls.standardize(df, COLUMNS).collect()])
    best = np.inf
    for seed in range(20):
        centers = x[np.random.default_rng(seed).choice(len(x), 4, replace=False)]
        for _ in range(100):
            near = ((x[:, None] - centers) ** 2).sum(axis=2).argmin(axis=1)
            centers = np.array([x[near == k].mean(axis=0) if (near == k).any() else centers[k] for k in range(4)])
        best = min(best, ((x[:, None] - centers) ** 2).sum(axis=2).min(axis=1).sum())
    assert cost(df, ls.kmeans(df, COLUMNS, 4)) <= best * 1.0001
    monkeypatch.setattr(module, "START_ROWS", 10)
    assert cost(df, ls.kmeans(df, COLUMNS, 4)) <= best * 1.0001


def test_rounds_that_do_not_suffice_are_told(spark, monkeypatch):
    monkeypatch.setattr(module, "START_ROWS", 10)
    with pytest.warns(UserWarning, match="fixed point"):
        fitted = ls.kmeans(table(spark, 500), COLUMNS, 4, max_iter=1)
    assert not fitted.converged


def test_draws_follow_cost_and_values_alone():
    rnd = np.random.default_rng(2)
    x, n = rnd.normal(size=(5000, 3)), np.ones(5000)
    centers = x[:2]
    total = module._sums(x, n, centers)[:, 1].sum()
    drawn = module._drawn(x, n, centers, total, 40, 11)
    assert 15 < len(drawn) < 80
    shuffled = rnd.permutation(5000)
    assert sorted(map(tuple, module._drawn(x[shuffled], n, centers, total, 40, 11))) == sorted(map(tuple, drawn))
    assert len(module._drawn(x, n, x, 0.0, 40, 11)) == 0
    zero = np.array([[0.0, 1.0], [-0.0, 1.0]])
    assert len(set(module._ranks(zero, 1))) == 1


def test_rounds_read_the_rows_near_a_border(spark, monkeypatch):
    """Fewer passes over all rows than rounds, and the fixed point of passes over all rows alone."""
    monkeypatch.setattr(module, "CELLS_PER_TASK", 0)
    monkeypatch.setattr(module, "START_ROWS", 10)
    rnd = np.random.default_rng(5)
    df = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(rnd.normal(size=(4000, 3)))], "line_no BIGINT, a DOUBLE, b DOUBLE, c DOUBLE")
    passes, whole = [], module._SparkPasses.rounds
    monkeypatch.setattr(module._SparkPasses, "rounds", lambda self, starts: passes.append(self.rows) or whole(self, starts))
    got = ls.kmeans(df, COLUMNS, 2, restarts=1)
    read = sum(n for n in passes if n == 4000)
    passes.clear()
    monkeypatch.setattr(module._SparkPasses, "ahead", module._LocalPasses.ahead)
    want = ls.kmeans(df, COLUMNS, 2, restarts=1)
    assert got.centroids == want.centroids and got.converged and want.converged
    assert read < 0.7 * sum(passes)


def test_assignment_by_products_is_that_by_differences():
    rnd = np.random.default_rng(4)
    for shift in (0.0, 1e6, 1e9):
        x = np.round(rnd.normal(size=(3000, 4)), 1) + shift
        centers = np.concatenate([x[:3], x[:1]])  # equal centres: the first is taken
        near, gap, lead = module._assigned(x, centers)
        gaps = module._gaps(x, centers)
        assert (near == gaps.argmin(axis=1)).all() and (near < 3).all()
        assert np.allclose(gap, gaps.min(axis=1), atol=1e-6)
        two = np.sqrt(np.sort(gaps, axis=1)[:, :2])
        assert np.allclose(lead, two[:, 1] - two[:, 0], rtol=1e-3, atol=1e-6)


def test_leads_bound_what_a_move_changes():
    rnd = np.random.default_rng(6)
    x, centers = rnd.normal(size=(5000, 5)), rnd.normal(size=(4, 5))
    near, _, lead = module._assigned(x, centers)
    moved = centers + rnd.normal(size=centers.shape) * 0.05
    kept = lead > module._reach(moved, centers)
    assert kept.any() and (module._assigned(x, moved)[0][kept] == near[kept]).all()
    assert module._classes(lead).sum() == 5000
    assert not module._holds([(centers, 0.01)], moved) and module._holds([(centers, 10.0)], moved)


def test_one_task_reads_the_whole_table(spark, monkeypatch):
    """However many tasks a pass has, what runs in one task sees all rows of its table."""
    want = ls.kmeans(table(spark, 3000), COLUMNS, 4).centroids
    monkeypatch.setattr(module, "TASK_CELLS", 100)
    monkeypatch.setattr(module, "PACKED", 300)
    assert ls.kmeans(table(spark, 3000, 5), COLUMNS, 4).centroids == want
    monkeypatch.setattr(module, "ROWS_PER_TASK", 1500)
    walked, walk = [], module._SparkPasses.walk_in_one_task

    def walk_and_compare(self, base, bounds, centers, left):
        got = walk(self, base, bounds, centers, left)
        assert got == module._walk(module._LocalPasses(*self.all_rows()), base, bounds, centers, left)
        walked.append(got[1])
        return got

    monkeypatch.setattr(module._SparkPasses, "walk_in_one_task", walk_and_compare)
    assert ls.kmeans(table(spark, 3000, 5), COLUMNS, 4).centroids == want
    assert sum(walked) > 1
