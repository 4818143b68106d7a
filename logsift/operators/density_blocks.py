"""Density clustering in many columns, by blocks of points that lie together.

Cells are cut in the leading columns only, so all neighbours of a point lie in its cell or in one
next to it. The points of a cell are ordered by the nearest of a net of pivots and their distance to
it, and cut into chunks: one row each, with the centre of its points and the radius around it. Two chunks
whose centres are too far apart for their radii are not a pair; inside a pair the same holds for
tiles of points, and tiles that lie closer than their radii allow any distance beyond eps are near
as a whole. Only what is left is computed. A point is written once, a pair of chunks is one row, and
blocks report sums over points and links between groups of linked points of two chunks, never pairs.

Chunks are not all compared with each other. What a chunk holds inside settles most points: who is
core already there, and who is linked to whom. Points still open (not core yet, or core but outside the
largest group) are cut into chunks of their own, which ask the others in rounds, the nearest centres
first, until they are settled or have asked every chunk within reach. So the work is the points times
the rounds of the open ones; only points that are noise in the end are compared with all chunks around.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logsift.operators.components import connected_components
from logsift.scratch import hot_keys, join_dealt, materialize, number_rows

# Points of a chunk; a block compares two chunks. Points of a tile of it.
CHUNK, TILE = 1024, 128
# Points, chosen by the hash of their id, around which the others are ordered.
PIVOTS = 256
# Chunks of a cell that one task pairs.
HOT_CELL = 500
# Chunks that an open chunk asks in the first round, and times as many in each further one.
NEAREST, WIDER = 8, 8
# Share by which a bound must be clear before it decides in place of distances.
MARGIN = 1e-6
# Rounding per column by which a distance from products may be off, as a share of the squared lengths.
ROUNDING = 4e-15

CHUNKS = (
    "chunk bigint, key array<bigint>, n int, ids array<bigint>, w array<double>, x array<double>,"
    " centre array<double>, radius double"
)


def _around(key: str, length: int) -> Column:
    keys = [
        ", ".join(f"{key}[{i}] + {step}L" for i, step in enumerate(steps))
        for steps in product((-1, 0, 1), repeat=length)
    ]
    return F.expr("array(" + ", ".join(f"array({k})" for k in keys) + ")")


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, d)


def _dealt(points: DataFrame, names: list[str], lead: list[str], eps: float) -> DataFrame:
    """(id, w, x, key, pivot, far): every point with its cell, nearest pivot and distance to it."""
    width, d = eps * (1 + MARGIN), len(names)
    key = F.array(*[F.floor(F.col(c) / F.lit(width)).cast("bigint") for c in lead])
    cells = points.select("id", "w", F.array(*names).alias("x"), key.alias("key"))
    first = cells.orderBy(F.xxhash64("id"), "id").limit(PIVOTS).select("x").collect()
    pivots = np.array([r.x for r in first], float).reshape(-1, d)

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(2), d)
            far, which = np.full(len(x), np.inf), np.zeros(len(x), np.int32)
            for k, pivot in enumerate(pivots):
                gap = ((x - pivot) ** 2).sum(axis=1)
                which[gap < far] = k
                far = np.minimum(far, gap)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(which), pa.array(np.sqrt(far))], names=[*batch.schema.names, "pivot", "far"]
            )

    schema = "id bigint, w double, x array<double>, key array<bigint>, pivot int, far double"
    return materialize(cells.withColumn("w", F.col("w").cast("double")).mapInArrow(nearest, schema), "dealt")


def _chunks(dealt: DataFrame, d: int, name: str = "chunks", inner: tuple[str, ...] = ()) -> DataFrame:
    """CHUNKS: up to CHUNK points of one cell that follow each other in the order of the net.

    ``inner``: further columns that come before the net in the order.
    """
    size = CHUNK

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        held: list[pa.RecordBatch] = []

        def row(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            nonlocal number
            table = pa.Table.from_batches(parts).combine_chunks()
            x = _matrix(table.column("x").chunk(0), d)
            centre = x.mean(axis=0)
            radius = float(np.sqrt(((x - centre) ** 2).sum(axis=1)).max())
            number += 1
            one = [
                number - 1, table.column("key")[0].as_py(), len(x), table.column("id").to_pylist(),
                table.column("w").to_pylist(), x.reshape(-1), centre, radius,
            ]
            kinds = [pa.int64(), pa.list_(pa.int64()), pa.int32(), pa.list_(pa.int64()), *[pa.list_(pa.float64())] * 3, pa.float64()]
            names = ["chunk", "key", "n", "ids", "w", "x", "centre", "radius"]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(one, kinds, strict=True)], names=names)

        for batch in batches:
            keys = _matrix(batch.column(3), len(batch.column(3)[0]) if batch.num_rows else 1)
            start = 0
            for stop in [*(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), batch.num_rows]:
                while start < stop:  # rows start : stop are of one cell
                    have = sum(h.num_rows for h in held)
                    if held and (have >= size or held[0].column(3)[0] != batch.column(3)[start]):
                        yield row(held)
                        held, have = [], 0
                    part = min(stop, start + size - have)
                    held.append(batch.slice(start, part - start))
                    start = part
        if held:
            yield row(held)

    order = ["key", *inner, "pivot", "far", "id"]
    ranged = dealt.repartitionByRange(*order).sortWithinPartitions(*order).drop(*inner)
    return materialize(ranged.mapInArrow(cut, CHUNKS), name)


def _gap(a: str, b: str) -> Column:
    """Distance of two centres."""
    steps = F.zip_with(a, b, lambda p, q: (p - q) * (p - q))
    return F.sqrt(F.aggregate(steps, F.lit(0.0), lambda s, v: s + v))


def _in_reach(gap: str, eps: float) -> Column:
    return F.col(gap) <= (F.col("ra") + F.col("rb") + F.lit(eps)) * F.lit(1 + MARGIN)


def _asked(open_: DataFrame, chunks: DataFrame, length: int, eps: float, name: str) -> DataFrame:
    """(a, near): the chunks that may hold neighbours of each open chunk a, the nearest first."""
    some = materialize(chunks.select("chunk", "key", "centre", "radius"), f"summary_{name}")
    cells = materialize(some.groupBy("key").agg(F.count("*").alias("n")), f"cells_{name}")
    left = open_.select(
        F.col("chunk").alias("a"), F.col("centre").alias("ca"), F.col("radius").alias("ra"),
        F.explode(_around("key", length)).alias("key"),
    )
    right = some.join(cells, "key").select(
        "key", F.col("chunk").alias("b"), F.col("centre").alias("cb"), F.col("radius").alias("rb"), "n"
    )
    met = join_dealt(left, right, ["key"], "n", hot_keys(cells, ["key"], "n", HOT_CELL), HOT_CELL)
    found = met.withColumn("gap", _gap("ca", "cb")).where(_in_reach("gap", eps))
    listed = found.groupBy("a").agg(F.sort_array(F.collect_list(F.struct("gap", "b"))).alias("found"))
    return materialize(listed.select("a", F.col("found.b").alias("near")), f"asked_{name}")


def _rounds(asked: DataFrame) -> Iterator[DataFrame]:
    """Pairs (a, b) of ``asked`` round by round, the nearest of each open chunk first."""
    last, start, size = asked.agg(F.max(F.size("near"))).first()[0] or 0, 0, NEAREST
    while start < last:
        yield asked.select("a", F.explode(F.slice("near", start + 1, size)).alias("b"))
        start, size = start + size, size * WIDER


def _meet(pairs: DataFrame, left: DataFrame, right: DataFrame, *columns: str):
    """The two chunks of every pair, grouped; ``columns`` go with the ids and values of their points."""
    first = pairs.select("a", "b", F.col("a").alias("chunk"), F.lit(True).alias("side")).join(left, "chunk")
    second = pairs.select("a", "b", F.col("b").alias("chunk"), F.lit(False).alias("side")).join(right, "chunk")
    side = ["a", "b", "side", "ids", "x", *columns]
    return first.select(*side).union(second.select(*side)).groupBy("a", "b")


def _strides(chunks: DataFrame, eps: float) -> DataFrame:
    """(a, b): chunks that follow each other in the order of the net, at growing steps."""
    some = chunks.select("chunk", "centre", "radius")
    placed = materialize(number_rows(some, ["chunk"], "at"), "places")
    steps, last = [], placed.agg(F.max("at")).first()[0] or 0
    while WIDER ** len(steps) <= last:
        steps.append(WIDER ** len(steps))
    if not steps:
        steps = [1]
    left = placed.select(
        F.col("chunk").alias("a"), F.col("centre").alias("ca"), F.col("radius").alias("ra"),
        F.explode(F.array(*[F.col("at") + F.lit(step) for step in steps])).alias("at"),
    )
    right = placed.select("at", F.col("chunk").alias("b"), F.col("centre").alias("cb"), F.col("radius").alias("rb"))
    met = left.join(right, "at").withColumn("gap", _gap("ca", "cb")).where(_in_reach("gap", eps))
    return materialize(met.select("a", "b"), "strides")


def _numbers(values: pa.Array) -> np.ndarray:
    """A list as an array; -1 where an id is missing."""
    filled = values.fill_null(-1) if pa.types.is_integer(values.type) else values
    return filled.to_numpy(zero_copy_only=False)


class _Block:
    """Two chunks (the same one twice in a block of one) and who is near whom."""

    def __init__(self, group: pa.Table, d: int, eps: float):
        group = group.combine_chunks()
        order = [0] if group.num_rows == 1 else sorted((0, 1), key=lambda i: group.column("side")[i].as_py() is False)
        cells = [{name: group.column(name)[i] for name in group.column_names} for i in order]
        cells = [{k: _numbers(v.values) for k, v in c.items() if pa.types.is_list(v.type) and v.is_valid} for c in cells]
        self.alone = len(cells) == 1
        self.a, self.b = cells[0], cells[-1]
        xa, xb = (c["x"].reshape(-1, d) for c in (self.a, self.b))
        self.near = np.zeros((len(xa), len(xb)), bool)
        tiles_a = self._tiles(xa)
        tiles_b = tiles_a if self.alone else self._tiles(xb)
        for i, (ca, ra) in enumerate(tiles_a):
            rows_ = slice(i * TILE, (i + 1) * TILE)
            for j, (cb, rb) in enumerate(tiles_b):
                columns, gap = slice(j * TILE, (j + 1) * TILE), float(np.sqrt(((ca - cb) ** 2).sum()))
                if gap > (ra + rb + eps) * (1 + MARGIN):
                    continue
                if (gap + ra + rb) * (1 + MARGIN) <= eps:
                    self.near[rows_, columns] = True
                    continue
                self.near[rows_, columns] = self._close(xa[rows_], xb[columns], eps)

    @staticmethod
    def _close(p: np.ndarray, q: np.ndarray, eps: float) -> np.ndarray:
        """Who is within eps: by products, and column by column where rounding might decide."""
        with np.errstate(over="ignore", invalid="ignore"):
            pp, qq = (p * p).sum(axis=1), (q * q).sum(axis=1)
            lengths = pp[:, None] + qq[None, :]
            beyond = lengths - 2 * (p @ q.T) - eps * eps
            near = beyond <= 0
            doubt = ~(np.abs(beyond) > ROUNDING * (p.shape[1] + 8) * (lengths + eps * eps))
            # a missing value is near nothing
            doubt &= ~np.isnan(p).any(axis=1)[:, None] & ~np.isnan(q).any(axis=1)[None, :]
            i, j = np.nonzero(doubt)
            if len(i):
                gaps = np.zeros(len(i))
                for c in range(p.shape[1]):  # summed column by column, as everywhere else
                    step = p[i, c] - q[j, c]
                    gaps += step * step
                near[i, j] = gaps <= eps * eps
        return near

    @staticmethod
    def _tiles(x: np.ndarray) -> list[tuple[np.ndarray, float]]:
        out = []
        for start in range(0, len(x), TILE):
            part = x[start : start + TILE]
            centre = part.mean(axis=0)
            out.append((centre, float(np.sqrt(((part - centre) ** 2).sum(axis=1)).max())))
        return out


def _rows(found: list[tuple[np.ndarray, np.ndarray]], names: list[str], kind: pa.DataType) -> pa.Table:
    first, second = (np.concatenate(x) for x in zip(*found, strict=True)) if found else ([], [])
    return pa.table({names[0]: pa.array(first, pa.int64()), names[1]: pa.array(second, kind)})


def _gathered(d: int, eps: float):
    """(id, w): weight near the points of a chunk, inside it or in the chunk it asks."""

    def block(group: pa.Table) -> pa.Table:
        it = _Block(group, d, eps)
        return _rows([(it.a["ids"], it.near @ it.b["w"])], ["id", "w"], pa.float64())

    return block


def _forest(near: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """(component of each row, of each column, links (row, column) that span them); -1 without any."""
    of_row, of_column = np.full(near.shape[0], -1), np.full(near.shape[1], -1)
    links: list[tuple[int, int]] = []
    number = 0
    for start in np.flatnonzero(near.any(axis=1)):
        if of_row[start] >= 0:
            continue
        of_row[start] = number
        queue = [int(start)]
        while queue:
            row = queue.pop()
            for column in np.flatnonzero(near[row] & (of_column < 0)).tolist():
                of_column[column] = number
                links.append((row, column))
                back = np.flatnonzero(near[:, column] & (of_row < 0))
                of_row[back] = number
                links += [(r, column) for r in back.tolist()]
                queue += back.tolist()
        number += 1
    return of_row, of_column, links


def _linked_inside(d: int, eps: float):
    """(id, root) of the core points of a chunk: the lowest id that they are linked to inside it."""

    def block(group: pa.Table) -> pa.Table:
        it = _Block(group, d, eps)
        core = it.a["core"].astype(bool)
        of, _, _ = _forest(it.near & core[:, None] & core[None, :])
        ids, of = it.a["ids"][core], of[core]
        low = np.full(int(of.max(initial=-1)) + 1, np.iinfo(np.int64).max)
        np.minimum.at(low, of, ids)
        return _rows([(ids, low[of])], ["id", "root"], pa.int64())

    return block


def _linked_across(d: int, eps: float):
    """Links (u, v) between the groups that two chunks have inside."""

    def block(group: pa.Table) -> pa.Table:
        it = _Block(group, d, eps)
        names, which = [], []
        for side in (it.a, it.b):
            found, number = np.unique(side["root"], return_inverse=True)
            names.append(found)
            which.append(number)
        met = np.zeros((len(names[0]), len(names[1])), bool)
        i, j = np.nonzero(it.near)
        met[which[0][i], which[1][j]] = True
        met[names[0] == -1] = False
        met[:, names[1] == -1] = False
        links = [(int(names[0][r]), int(names[1][c])) for r, c in _forest(met)[2]]
        u, v = zip(*links, strict=True) if links else ((), ())
        return _rows([(np.array(u, np.int64), np.array(v, np.int64))], ["u", "v"], pa.int64())

    return block


def _adjacent(d: int, eps: float):
    """(id, root): the lowest cluster in a chunk next to each point of the chunk that asks."""

    def block(group: pa.Table) -> pa.Table:
        none, it = np.iinfo(np.int64).max, _Block(group, d, eps)
        other = np.where(it.b["root"] < 0, none, it.b["root"])
        low = np.where(it.near, other[None, :], none).min(axis=1)
        keep = low < none
        return _rows([(it.a["ids"][keep], low[keep])], ["id", "root"], pa.int64())

    return block


def _beside(chunks: DataFrame, values: DataFrame, name: str) -> DataFrame:
    """The chunks with an array of ``name`` of (id, ``name``) for their points, NULL where there is none."""
    places = chunks.select("chunk", F.posexplode("ids").alias("_at", "id"))
    cell = F.struct("_at", name)
    arrays = places.join(values, "id", "left").groupBy("chunk").agg(F.array_sort(F.collect_list(cell)).alias("_cells"))
    found = F.transform("_cells", lambda c: c[name]).alias(name)
    return materialize(chunks.join(arrays.select("chunk", found), "chunk"), f"chunks_{name}")


def _holding(chunks: DataFrame, ids: DataFrame) -> DataFrame:
    """(chunk) of the chunks that hold one of the ids."""
    places = chunks.select("chunk", F.explode("ids").alias("id"))
    return places.join(ids.select("id"), "id", "left_semi").select("chunk").distinct()


def _cores(dealt: DataFrame, chunks: DataFrame, length: int, d: int, eps: float, min_samples: int) -> DataFrame:
    """(id, core) of every point: settled inside its chunk, or by rounds over the chunks around."""
    enough = F.round("w", 6) >= min_samples
    inside = chunks.select("chunk", "ids", "x", "w").groupBy("chunk").applyInArrow(_gathered(d, eps), "id long, w double")
    own = materialize(inside.groupBy("id").agg(F.sum("w").alias("w")), "own")
    open_ = own.where(~enough).select("id")
    if open_.isEmpty():
        return materialize(own.select("id", F.lit(True).alias("core")), "core")
    queries = _chunks(dealt.join(open_, "id", "left_semi"), d, "queries")
    asked = _asked(queries, chunks, length, eps, "cores")
    total = open_.withColumn("w", F.lit(0.0))
    for turn, pairs in enumerate(_rounds(asked)):
        if turn:
            left = total.where(~enough)
            if left.isEmpty():
                break
            pairs = pairs.join(_holding(queries, left).withColumnRenamed("chunk", "a"), "a", "left_semi")
        found = _meet(pairs, queries, chunks, "w").applyInArrow(_gathered(d, eps), "id long, w double")
        total = materialize(total.union(found).groupBy("id").agg(F.sum("w").alias("w")), "total")
    settled = own.where(enough).select("id", F.lit(True).alias("core"))
    return materialize(settled.union(total.select("id", enough.alias("core"))), "core")


def _members(dealt: DataFrame, chunks: DataFrame, core: DataFrame, length: int, d: int, eps: float) -> DataFrame:
    """(id, root) of the core points, root the lowest id of the cluster.

    First the groups inside chunks are linked along the order of the net. Then the core points outside
    the largest group ask the chunks around; two chunks of one and the same group are not compared.
    """
    inside = (
        _beside(chunks, core.where("core"), "core")
        .select("chunk", "ids", "x", "core")
        .groupBy("chunk")
        .applyInArrow(_linked_inside(d, eps), "id long, root long")
    )
    local = materialize(inside, "local")
    rooted = _beside(chunks, local, "root")
    heads = materialize(local.groupBy(F.col("root").alias("id")).agg(F.count("*").alias("n")), "nodes")

    def held(of: DataFrame, name: str) -> DataFrame:
        """(name, id): the groups that a chunk has points of."""
        roots = of.select(F.col("chunk").alias(name), F.explode(F.array_distinct("root")).alias("id"))
        return materialize(roots.where("id is not null"), f"held_{name}")

    def span(groups: DataFrame, of: DataFrame, name: str) -> DataFrame:
        """(name, low, high): the least and greatest root of the groups of each chunk."""
        return of.join(groups, "id").groupBy(name).agg(
            F.min("root").alias(f"{name}_low"), F.max("root").alias(f"{name}_high")
        )

    def members(groups: DataFrame) -> DataFrame:
        roots = groups.withColumnRenamed("id", "head")
        return materialize(local.withColumnRenamed("root", "head").join(roots, "head").select("id", "root"), "members")

    across = _meet(_strides(chunks, eps), rooted, rooted, "root").applyInArrow(_linked_across(d, eps), "u long, v long")
    edges = materialize(across, "edges")
    groups = connected_components(heads.select("id"), edges)
    sizes = heads.join(groups, "id").groupBy("root").agg(F.sum("n").alias("n"))
    largest = sizes.orderBy(F.desc("n"), "root").head()
    if largest is None:
        return members(groups)
    outer = groups.where(F.col("root") != largest.root).select(F.col("id").alias("head"), F.col("root").alias("group"))
    loose = local.withColumnRenamed("root", "head").join(outer, "head").select("id", "group")
    if loose.isEmpty():
        return members(groups)
    cut = _chunks(dealt.join(loose, "id"), d, "loose", ("group",))
    queries = _beside(cut, local, "root")
    held_a, held_b = held(queries, "a"), held(rooted, "b")
    for turn, pairs in enumerate(_rounds(_asked(queries, rooted, length, eps, "links"))):
        if turn:
            groups = connected_components(heads.select("id"), edges)
        # the group that holds the root of the largest one, whatever its root is by now
        main = groups.where(F.col("id") == largest.root).head().root
        one = (F.col("a_low") == F.col("a_high")) & (F.col("b_low") == F.col("b_high")) & (F.col("a_low") == F.col("b_low"))
        todo = (
            pairs.join(span(groups, held_a, "a"), "a")
            .where((F.col("a_low") != main) | (F.col("a_high") != main))
            .join(span(groups, held_b, "b"), "b")
            .where(~one)
            .select("a", "b")
        )
        found = _meet(todo, queries, rooted, "root").applyInArrow(_linked_across(d, eps), "u long, v long")
        edges = edges.union(materialize(found, "edges"))
    return members(connected_components(heads.select("id"), edges))


def cluster_by_blocks(
    points: DataFrame, names: list[str], lead: list[str], eps: float, min_samples: int
) -> DataFrame:
    """``points`` (id, w, rows and ``names``) with core, root and cluster; root NULL for noise."""
    d, length = len(names), len(lead)
    dealt = _dealt(points, names, lead, eps)
    chunks = _chunks(dealt, d)
    core = _cores(dealt, chunks, length, d, eps, min_samples)
    members = _members(dealt, chunks, core, length, d, eps)
    numbered = number_rows(members.where("id = root").select("root"), ["root"], "cluster")
    roots = members
    outside = dealt.join(core.where("not core").select("id"), "id", "left_semi")
    if not (members.isEmpty() or outside.isEmpty()):
        queries = _chunks(outside, d, "outside")
        queries = queries.withColumn("root", F.lit(None).cast("array<bigint>"))
        around = _beside(chunks.join(_holding(chunks, members), "chunk", "left_semi"), members, "root")
        asked = _asked(queries, around, length, eps, "border")
        met = _meet(asked.select("a", F.explode("near").alias("b")), queries, around, "root")
        beside = met.applyInArrow(_adjacent(d, eps), "id long, root long")
        roots = members.union(beside.groupBy("id").agg(F.min("root").alias("root")))
    return materialize(
        points.join(core, "id").join(roots.join(numbered, "root"), "id", "left").select(*names, "rows", "core", "root", "cluster"),
        "labelled",
    )
