import math
import random
from collections import defaultdict

import pytest

import logsift as ls

rnd = random.Random(5)
# A crowd in one corner, a few points elsewhere, points that cannot be drawn.
ROWS = [(i, rnd.random() / 50, rnd.random() / 50, rnd.choice("ab")) for i in range(3000)]
ROWS += [(3000 + i, rnd.random(), rnd.random(), "a") for i in range(40)] + [(9000, 1.0, 1.0, "rare"), (9001, 0.0, 0.0, None)]
ODD = [(9100, None, 0.5, "a"), (9101, float("nan"), 0.5, "a")]


def points(spark, rows, parts=4):
    return spark.createDataFrame(rows, "line_no BIGINT, x DOUBLE, y DOUBLE, label STRING").repartition(parts)


def found(df):
    return sorted((r.line_no, round(r.weight, 9)) for r in df.collect())


def test_every_box_keeps_points_whatever_the_partitions(spark):
    want = found(ls.thin_points(points(spark, ROWS + ODD), 3, 10))
    for parts in (1, 17):
        assert found(ls.thin_points(points(spark, ROWS + ODD, parts), 3, 10)) == want
    of = {r[0]: (min(int(r[1] * 10), 9), min(int(r[2] * 10), 9), r[3]) for r in ROWS}
    boxes, kept, weights = defaultdict(int), defaultdict(int), defaultdict(float)
    for box in of.values():
        boxes[box] += 1
    for line, weight in want:
        kept[of[line]] += 1
        weights[of[line]] += weight
    assert {b: min(n, 3) for b, n in boxes.items()} == kept
    assert all(math.isclose(weights[b], n) for b, n in boxes.items())
    assert {9000, 9001} <= {line for line, _ in want} and not {9100, 9101} & {line for line, _ in want}


def test_tasks_send_few_points_of_a_box(spark):
    plan = ls.thin_points(points(spark, ROWS), 3, 10)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 2


def test_odd_tables(spark):
    assert ls.thin_points(points(spark, []), 3).count() == 0
    one = points(spark, [(1, 2.0, 3.0, "a"), (2, 2.0, 5.0, "a")]).drop("label")
    assert found(ls.thin_points(one, 1, 4)) == [(1, 1.0), (2, 1.0)]
    assert found(ls.thin_points(points(spark, [(i, 1.0, 1.0, "a") for i in range(5)]), 1))[0][1] == 5.0
    for wrong in (0, 1001):
        with pytest.raises(ValueError, match="per_box"):
            ls.thin_points(one, wrong)
