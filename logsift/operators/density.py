"""Density clustering (DBSCAN and the DBSCAN extraction of OPTICS) by grid cells.

Rows are points in a grid whose cells have the diagonal eps. All points of a cell are
neighbours of each other, so a cell that weighs at least min_samples is a single unit of
core points however many rows it holds, and a lighter cell holds fewer than min_samples
points. Neighbour pairs are therefore spelled out only from light cells; inside a heavy
cell none are (Gunawan 2013; Gan and Tao 2015). Two heavy cells are linked by one pair of
points, looked for in halves of halves when the cells are large. Boxes around the points
decide most cases; because rounding is monotonic a box decision never contradicts the
distances of its points. With more than three columns nearly all cells would be light, so
there points of neighbouring cells are compared in blocks (``density_blocks``).
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logsift import scratch
from logsift.operators.components import connected_components
from logsift.operators.density_blocks import cluster_by_blocks
from logsift.operators.near_duplicates import combine_near_duplicates
from logsift.operators.scaling import standardize
from logsift.scratch import hot_keys, join_counted, join_dealt, materialize, number_rows

# Columns in which cells are cut; with more columns points are compared in blocks instead.
LEVEL_COLUMNS = 3
# Point pairs of two heavy cells that are compared directly; larger pairs are halved first.
PAIR_BUDGET = 10_000


@dataclass(frozen=True)
class _Space:
    d: int
    eps: float
    order: list[int]  # columns, most selective first
    coarse: int  # leading columns of the coarse level, and columns halved at once

    @property
    def names(self) -> list[str]:
        return [f"x{i}" for i in range(self.d)]

    @property
    def limit(self) -> Column:
        return F.lit(self.eps * self.eps)

    def key(self) -> Column:
        """Coarse cell numbers of the leading columns, then fine numbers of all columns."""
        coarse_width = self.eps * (1 + 1e-6)
        fine_width = self.eps / math.sqrt(self.d) * (1 - 1e-9)
        parts = [F.floor(F.col(f"x{i}") / F.lit(coarse_width)) for i in self.order[: self.coarse]]
        parts += [F.floor(F.col(f"x{i}") / F.lit(fine_width)) for i in self.order]
        return F.array(*[p.cast("bigint") for p in parts])

    def boxes(self) -> list[Column]:
        return [
            *[F.min(f"x{i}").alias(f"lo{i}") for i in range(self.d)],
            *[F.max(f"x{i}").alias(f"hi{i}") for i in range(self.d)],
        ]

    def box_names(self) -> list[str]:
        return [f"lo{i}" for i in range(self.d)] + [f"hi{i}" for i in range(self.d)]

    # The distances are written as SQL text: one call builds the whole expression.
    def box_gap(self, a: str, b: str) -> Column:
        """Smallest squared distance between two boxes, given by their column prefixes."""
        return _squares(
            [f"greatest({a}lo{i} - {b}hi{i}, {b}lo{i} - {a}hi{i}, 0D)" for i in range(self.d)]
        )

    def box_span(self, a: str, b: str) -> Column:
        """Largest squared distance between two boxes."""
        return _squares(
            [f"greatest({a}hi{i} - {b}lo{i}, {b}hi{i} - {a}lo{i})" for i in range(self.d)]
        )

    def point_gap(self, point: str, box: str) -> Column:
        """Smallest squared distance between a point and a box."""
        return _squares(
            [f"greatest({box}lo{i} - {point}{i}, {point}{i} - {box}hi{i}, 0D)" for i in range(self.d)]
        )

    def point_span(self, point: str, box: str) -> Column:
        """Largest squared distance between a point and a box."""
        return _squares(
            [f"greatest({point}{i} - {box}lo{i}, {box}hi{i} - {point}{i})" for i in range(self.d)]
        )

    def points_apart(self, a: str, b: str) -> Column:
        return _squares([f"{a}{i} - {b}{i}" for i in range(self.d)])


def _squares(gaps: list[str]) -> Column:
    return F.expr(" + ".join(f"({gap}) * ({gap})" for gap in gaps))


# Tables of pairs are flat (a_key, a_lo0, .., b_key, ..), and columns are renamed before a
# distance filter, never after it: renaming above a filter, or taking fields out of a struct
# below it, makes Catalyst derive exponentially many copies of the filter as constraints.
def _prefixed(table: DataFrame, prefix: str, *extra: Column) -> DataFrame:
    return table.select(*[F.expr(f"{c} AS {prefix}{c}") for c in table.columns], *extra)


def _plan_space(points: DataFrame, d: int, eps: float) -> _Space:
    """For more than LEVEL_COLUMNS columns the ones with most occupied cells come first."""
    order = list(range(d))
    if d > LEVEL_COLUMNS:
        used = points.agg(
            *[
                F.approx_count_distinct(F.floor(F.col(f"x{i}") / F.lit(eps))).alias(f"n{i}")
                for i in range(d)
            ]
        ).head()
        order.sort(key=lambda i: -used[i])
    return _Space(d, eps, order, min(LEVEL_COLUMNS, d))


def _neighbour_keys(key: str, length: int) -> Column:
    """All 3^length coarse keys around a coarse key."""
    keys = [
        ", ".join(f"{key}[{i}] + {step}L" for i, step in enumerate(steps))
        for steps in product((-1, 0, 1), repeat=length)
    ]
    return F.expr("array(" + ", ".join(f"array({k})" for k in keys) + ")")


def _cell_pairs(cells: DataFrame, space: _Space) -> DataFrame:
    """Pairs a <= b of cells whose boxes come within eps, with prefixes ``a_`` and ``b_``.

    One equi-join on the coarse key, whose cells are as wide as eps.
    """
    around = F.explode(_neighbour_keys("key", space.coarse)).alias("_at")
    left = _prefixed(cells, "a_", around)
    right = _prefixed(cells, "b_", F.slice("key", 1, space.coarse).alias("_at"))
    close = (F.col("a_key") <= F.col("b_key")) & (space.box_gap("a_", "b_") <= space.limit)
    return materialize(left.join(right, "_at").where(close).drop("_at"), "pairs")


def _links(
    points: DataFrame, pairs: DataFrame, space: _Space, hot_cells: DataFrame | None
) -> DataFrame:
    """(p, u, heavy, w): neighbours of each point of a light cell, with their weight.

    ``u`` is the node of a heavy cell (all its points in reach added up) or a single point
    of a light cell.
    """
    fields = ["key", "n", "w", "node", *space.box_names()]
    directed = [
        pairs.where(~F.col(f"{src}heavy") & keep).select(
            F.col(f"{src}key").alias("key"),
            F.col(f"{src}n").alias("n"),
            F.col(f"{dst}heavy").alias("heavy"),
            *[F.col(f"{dst}{c}").alias(f"d_{c}") for c in fields],
        )
        for src, dst, keep in [
            ("a_", "b_", F.lit(True)),
            ("b_", "a_", F.col("a_key") != F.col("b_key")),
        ]
    ]
    whole = F.col("heavy") & (space.point_span("px", "d_") <= space.limit)
    start = points.select(
        "key", F.col("id").alias("p"), *[F.col(x).alias(f"p{x}") for x in space.names]
    )
    reach = materialize(
        join_dealt(start, directed[0].union(directed[1]), ["key"], "n", hot_cells)
        .where(space.point_gap("px", "d_") <= space.limit)
        .select(
            "p",
            *[f"p{x}" for x in space.names],
            *["d_key", "d_n", "d_node", "d_w", "heavy"],
            whole.alias("whole"),
        ),
        "reach",
    )
    at_once = reach.where("whole").select(
        "p", F.col("d_node").alias("u"), "heavy", F.col("d_w").alias("w")
    )
    single = reach.where(~F.col("whole")).drop("d_w", "whole").withColumnRenamed("d_key", "key")
    met = join_dealt(points, single, ["key"], "d_n", hot_cells).where(
        space.points_apart("x", "px") <= space.limit
    )
    unit = F.when(F.col("heavy"), F.col("d_node")).otherwise(F.col("id"))
    one_by_one = met.groupBy("p", unit.alias("u"), "heavy").agg(F.sum("w").alias("w"))
    return materialize(at_once.unionByName(one_by_one), "links")


def _meeting(
    pairs: DataFrame, units: DataFrame, space: _Space, hot_cells: DataFrame | None
) -> DataFrame:
    """(u, v) of the pairs that have two points within eps, by comparing the points."""
    first = units.select(
        F.col("key").alias("a_key"), *[F.col(x).alias(f"p{x}") for x in space.names]
    )
    second = units.withColumnRenamed("key", "b_key")
    hot_a, hot_b = (
        None if hot_cells is None else hot_cells.withColumnRenamed("key", k) for k in ("a_key", "b_key")
    )
    beside_b = join_dealt(first, pairs, ["a_key"], "a_n", hot_a).where(
        space.point_gap("px", "b_") <= space.limit
    )
    return (
        join_dealt(second, beside_b, ["b_key"], "b_n", hot_b)
        .where(
            (space.point_gap("x", "a_") <= space.limit)
            & (space.points_apart("x", "px") <= space.limit)
        )
        .select("u", "v")
        .distinct()
    )


def _halves(
    units: DataFrame, boxes: DataFrame, space: _Space, hot_cells: DataFrame | None
) -> DataFrame:
    """Cut every box at the middle of its widest columns; the bits go to the end of the key.

    ``hot_cells`` are the hot keys of ``units``, also those without a box.
    """
    by_width = F.sort_array(
        F.array(
            *[
                F.struct(
                    (F.col(f"hi{i}") - F.col(f"lo{i}")).alias("width"),
                    F.lit(i).alias("at"),
                    F.col(f"lo{i}").alias("low"),
                    F.col(f"hi{i}").alias("high"),
                )
                for i in range(space.d)
            ]
        ),
        asc=False,
    )
    cuts = boxes.select("key", "n", F.slice(by_width, 1, space.coarse).alias("cuts"))
    cells = F.array(*space.names)

    def upper(cut: Column) -> Column:
        x = F.get(cells, cut["at"])
        middle = cut["low"] + cut["width"] / 2
        return ((x > middle) | ((x == cut["high"]) & (cut["low"] < cut["high"]))).cast("bigint")

    return join_dealt(units, cuts, ["key"], "n", hot_cells).select(
        F.concat("key", F.transform("cuts", upper)).alias("key"), *space.names
    )


def _touching(
    pairs: DataFrame,
    points: DataFrame,
    space: _Space,
    budget: int,
    hot_cells: DataFrame | None,
) -> DataFrame:
    """(u, v) of the undecided pairs of heavy cells that have two points within eps.

    Pairs of few points are compared directly. Larger ones are halved until the boxes
    decide or the parts are small; one close pair of parts settles the whole pair.
    """
    box = ["key", "n", *space.box_names()]
    sides = [f"{s}{c}" for s in ("a_", "b_") for c in box]
    cost = F.col("a_n") * F.col("b_n")
    pending = pairs.select("u", "v", *sides)
    units = points.select("key", *space.names)
    found = []
    while True:
        found.append(_meeting(pending.where(cost <= budget), units, space, hot_cells))
        large = pending.where(cost > budget)
        if large.isEmpty():
            return reduce(DataFrame.union, found)
        boxes = [large.select(*[F.col(f"{s}{c}").alias(c) for c in box]) for s in ("a_", "b_")]
        boxes = boxes[0].union(boxes[1]).distinct()
        units = materialize(_halves(units, boxes, space, hot_cells), "halves")
        parts = materialize(units.groupBy("key").agg(F.count("*").alias("n"), *space.boxes()), "parts")
        hot_cells = None if hot_cells is None else hot_keys(parts, ["key"], "n")
        parent = F.slice("key", 1, F.size("key") - space.coarse)
        finer = materialize(
            large.select("u", "v", F.col("a_key").alias("_pa"), F.col("b_key").alias("_pb"))
            .join(_prefixed(parts, "a_", parent.alias("_pa")), "_pa")
            .join(_prefixed(parts, "b_", parent.alias("_pb")), "_pb")
            .where(space.box_gap("a_", "b_") <= space.limit)
            .select("u", "v", *sides),
            "finer",
        )
        settled = finer.where(space.box_span("a_", "b_") <= space.limit).select("u", "v").distinct()
        found.append(settled)
        pending = materialize(finer.join(settled, ["u", "v"], "left_anti"), "pending")


def _cluster_points(
    table: DataFrame,
    columns: list[str],
    eps: float,
    min_samples: int,
    index: str,
    weight: str | None,
    budget: int,
) -> DataFrame:
    """Distinct points (x0.., rows, core, root, cluster); root NULL for noise.

    ``root`` is the lowest index of a core row of the cluster, ``cluster`` its rank.
    """
    d = len(columns)
    weight_of = F.col(weight) if weight else F.lit(1)
    cells_of = [(F.col(c).cast("double") + F.lit(0.0)).alias(f"x{i}") for i, c in enumerate(columns)]
    distinct = table.groupBy(*cells_of).agg(
        F.sum(weight_of).alias("w"), F.count("*").alias("rows"), F.min(index).alias("id")
    )
    if d > LEVEL_COLUMNS:
        distinct = materialize(distinct, "distinct")
        space = _plan_space(distinct, d, eps)
        lead = [f"x{i}" for i in space.order[:LEVEL_COLUMNS]]
        return cluster_by_blocks(distinct, space.names, lead, eps, min_samples)
    space = _plan_space(distinct, d, eps)
    points = materialize(distinct.withColumn("key", space.key()), "points")
    # every point of a heavy cell is core; the box check guards against rounding of the key
    heavy = (F.col("w") >= min_samples) & (
        _squares([f"hi{i} - lo{i}" for i in range(d)]) <= space.limit
    )
    cells = materialize(
        points.groupBy("key")
        .agg(F.count("*").alias("n"), F.sum("w").alias("w"), F.min("id").alias("node"), *space.boxes())
        .withColumn("heavy", heavy),
        "cells",
    )
    pairs = _cell_pairs(cells, space)
    # with fewer points than that no cell can be hot, so nothing has to be looked up
    crowded = points.count() > scratch.HOT_KEY_ROWS
    hot_cells = hot_keys(cells, ["key"], "n") if crowded else None
    links = _links(points, pairs, space, hot_cells)

    weights = links.groupBy("p").agg(F.sum("w").alias("w"))
    nodes = materialize(
        cells.where("heavy")
        .select(F.col("node").alias("id"), F.lit(False).alias("light"))
        .union(weights.where(F.col("w") >= min_samples).select("p", F.lit(True))),
        "nodes",
    )
    light_core = nodes.where("light").select("id")
    apart = pairs.withColumns({"u": F.col("a_node"), "v": F.col("b_node")}).where(
        F.col("a_heavy") & F.col("b_heavy") & (F.col("a_key") != F.col("b_key"))
    )
    decided = space.box_span("a_", "b_") <= space.limit
    from_core = links.join(light_core.withColumnRenamed("id", "p"), "p", "left_semi")
    edges = (
        apart.where(decided)
        .select("u", "v")
        .union(_touching(apart.where(~decided), points, space, budget, hot_cells))
        .union(from_core.where("heavy").select("p", "u"))
        .union(
            from_core.where(~F.col("heavy"))
            .join(light_core.withColumnRenamed("id", "u"), "u", "left_semi")
            .select("p", "u")
        )
    )
    members = connected_components(nodes.select("id"), edges)
    numbered = number_rows(members.where("id = root").select("root"), ["root"], "cluster")
    if crowded:
        sizes = members.groupBy("root").agg(F.count("*").alias("_rows"))
        numbered = materialize(numbered.join(sizes, "root"), "clusters")
        members = join_counted(members, numbered, ["root"], "_rows")
    else:
        members = members.join(numbered, "root")

    best = F.min(F.struct("root", "cluster")).alias("best")
    reached = members.withColumnRenamed("id", "u")
    if crowded:
        times = links.groupBy("u").agg(F.count("*").alias("_rows"))
        linked = join_counted(links, materialize(reached.join(times, "u"), "reached"), ["u"], "_rows")
    else:
        linked = links.join(reached, "u")
    light_root = (
        linked.groupBy("p")
        .agg(best)
        .select(
            F.col("p").alias("id"),
            F.col("best.root").alias("root"),
            F.col("best.cluster").alias("cluster"),
        )
    )
    is_core = light_core.withColumn("_core", F.lit(True))
    nothing = F.lit(None).cast("bigint")
    cell_root = (
        cells.where("heavy")
        .select("key", "n", F.col("node").alias("id"))
        .join(members, "id")
        .select("key", "n", F.lit(True).alias("heavy"), F.col("root").alias("_root"), F.col("cluster").alias("_cluster"))
        .union(cells.where("not heavy").select("key", "n", F.lit(False), nothing, nothing))
    )
    placed = join_dealt(points, cell_root, ["key"], "n", hot_cells)
    inside = placed.where("heavy").select(
        *space.names,
        "rows",
        F.lit(True).alias("core"),
        F.col("_root").alias("root"),
        F.col("_cluster").alias("cluster"),
    )
    outside = (
        placed.where(~F.col("heavy"))
        .join(light_root, "id", "left")
        .join(is_core, "id", "left")
        .select(*space.names, "rows", F.coalesce("_core", F.lit(False)).alias("core"), "root", "cluster")
    )
    return materialize(inside.unionByName(outside), "labelled")


def _labelled(
    table: DataFrame,
    columns: list[str],
    eps: float,
    min_samples: int,
    index: str,
    weight: str | None,
    border: str,
    budget: int,
) -> DataFrame:
    found = _cluster_points(table, columns, eps, min_samples, index, weight, budget)
    names = [f"x{i}" for i in range(len(columns))]
    keyed = table.withColumns(
        {n: F.col(c).cast("double") + F.lit(0.0) for n, c in zip(names, columns)}
    )
    joined = join_counted(keyed, found, names, "rows")
    member = F.col("root").isNotNull()
    if border == "optics":
        # a border row belongs to the cluster only if the ordering reaches it after the cluster's start
        member = member & (F.col("core") | (F.col("root") < F.col(index)))
    return joined.select(
        *table.columns,
        F.when(member, F.col("cluster")).otherwise(-1).cast("int").alias("label"),
        F.col("core").alias("is_core"),
    )


def _matrix(table: DataFrame, columns: list[str], normalize: bool) -> DataFrame:
    return standardize(table, columns) if normalize else table


def dbscan(
    table: DataFrame,
    columns: list[str],
    eps: float = 1.0,
    min_samples: int = 5,
    normalize: bool = True,
    rtol: float = 0.0,
    budget: int = PAIR_BUDGET,
) -> DataFrame:
    """The (standardised) table with ``label`` (-1 = noise) and ``is_core``.

    A row counts itself as a neighbour. Clusters are numbered by their lowest core line; a
    border row takes the lowest adjacent cluster. With ``rtol`` the rows are combined
    first and the result has one row per combined ``sample`` with its ``weight``.
    """
    matrix = _matrix(table, columns, normalize)
    if rtol:
        samples = materialize(combine_near_duplicates(matrix, columns, rtol), "samples")
        return _labelled(samples, columns, eps, min_samples, "sample", "weight", "dbscan", budget)
    return _labelled(matrix, columns, eps, min_samples, "line_no", None, "dbscan", budget)


def optics(
    table: DataFrame,
    columns: list[str],
    eps: float = 1.0,
    min_samples: int = 5,
    normalize: bool = True,
    budget: int = PAIR_BUDGET,
) -> DataFrame:
    """Clusters of OPTICS (max_eps = eps) extracted at eps; same output as ``dbscan``.

    Core rows get the clusters of DBSCAN. A border row joins the lowest adjacent cluster
    if that one starts at an earlier line, otherwise it is noise.
    """
    matrix = _matrix(table, columns, normalize)
    return _labelled(matrix, columns, eps, min_samples, "line_no", None, "optics", budget)


def cluster_centroids(labelled: DataFrame, columns: list[str]) -> DataFrame:
    """Mean of the rows of each cluster, noise left out, one row per cluster."""
    return (
        labelled.where(F.col("label") >= 0)
        .groupBy(F.col("label").alias("cluster"))
        .agg(*[F.avg(F.col(c).cast("double")).alias(c) for c in columns])
    )


def cluster_sizes(labelled: DataFrame) -> DataFrame:
    """Number of clusters and of noise rows."""
    per_label = labelled.groupBy("label").agg(F.count("*").alias("n"))
    return per_label.agg(
        F.count_if(F.col("label") >= 0).alias("n_clusters"),
        F.coalesce(F.sum(F.when(F.col("label") == -1, F.col("n"))), F.lit(0)).alias("n_noise"),
    )
