"""k-means labels and centroids.

The start is k-means|| (Bahmani et al. 2012): in each of a few passes every row draws by a hash of its
values, with a chance in proportion to its cost, whether it becomes a candidate; the candidates, weighted
by the rows nearest to them, are then clustered on the driver. All restarts go through each pass
together. A pass sums in Arrow batches inside the tasks and sends k x columns numbers; a table that
fits one task goes through all passes inside that task, by the same code.

A row whose second nearest centroid is farther than its nearest by more than two centroids have moved
together keeps its cluster (triangle inequality). So the rounds after a pass over all rows read only the
rows nearer to a border than that, set aside in a table, and add the sums of the rest, until the
centroids have moved too far for it; a fixed point found so is confirmed by a pass over all rows.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logsift.functions.vectors import literals, squared_distance
from logsift.operators.scaling import Scaler, fit_scaler, require_filled
from logsift.scratch import discard, scratch_path

DEFAULT_SEED = 12345
# Up to this many distinct rows all are candidates for the start.
START_ROWS = 2_000
# Passes that draw candidates, and draws expected in each for every cluster.
DRAWS, DRAWN = 5, 2
# Distinct rows for which a task is worth starting in every round, and numbers that fit one task.
ROWS_PER_TASK, CELLS_PER_TASK = 100_000, 8_000_000
# Digits of a centroid that are kept, so that the order of a sum does not matter.
DIGITS = 9
# Starts tried on the candidates.
TRIES = 8
# Rows near a border are set aside if these are one in SMALLER at most, and last for STEPS such moves as the last.
SMALLER, STEPS = 4, 8
# Classes of the lead of the nearest centroid, so many to a power of two, on either side of 1.
_OCTAVE, _SIDE = 4, 240
# Numbers in one row of the packed table and rows in one file, and numbers for which a task is worth starting.
PACKED, PACKED_ROWS, TASK_CELLS = 1 << 20, 2, 1 << 20
# Share of |x|^2 + |c|^2 below which two distances are too close for the product form.
CLOSE = 1e-7
_PACKED = pa.schema([("x", pa.binary()), ("n", pa.binary()), ("rows", pa.int64())])


@dataclass(frozen=True)
class KMeansResult:
    columns: list[str]
    scaler: Scaler | None
    centroids: list[list[float]]
    converged: bool = True

    def scaled(self, table: DataFrame) -> DataFrame:
        return self.scaler.transform(table) if self.scaler else table

    def nearest(self) -> Column:
        """Number of the nearest centroid as an expression over the scaled columns."""
        return _nearest(self.columns, self.centroids)

    def transform(self, table: DataFrame) -> DataFrame:
        """The (scaled) table with ``cluster``, in the space of the centroids."""
        return self.scaled(table).withColumn("cluster", self.nearest())

    def centroid_table(self, spark) -> DataFrame:
        names = ", ".join(f"`{c}` DOUBLE" for c in self.columns)
        return spark.createDataFrame(
            [(i, *c) for i, c in enumerate(self.centroids)], f"cluster INT, {names}"
        )


def _nearest(columns: list[str], centroids: list[list[float]]) -> Column:
    x = [F.col(c).cast("double") for c in columns]
    gaps = F.array(*[squared_distance(x, literals(c)) for c in centroids])
    return (F.array_position(gaps, F.array_min(gaps)) - 1).cast("int")


def _rounded(values) -> list[float]:
    return [round(float(v), DIGITS) + 0.0 for v in values]


def _ranks(x: np.ndarray, seed: int) -> np.ndarray:
    """A number in [0, 1) drawn by each row from its values and the seed."""
    with np.errstate(over="ignore"):
        h = np.full(len(x), np.uint64(seed * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        for bits in np.ascontiguousarray((x + 0.0).T).view(np.uint64):
            h = (h ^ bits) * np.uint64(0xBF58476D1CE4E5B9)
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
            h ^= h >> np.uint64(32)
    return h.astype(float) / 2.0**64


def _gaps(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return np.stack([((x - c) ** 2).sum(axis=1) for c in centers], axis=1)


def _assigned(x: np.ndarray, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(nearest centre, squared distance to it, how much farther the second nearest is) of each row.

    Distances come from products; rows that these cannot decide are computed again by differences.
    """
    size = np.einsum("ij,ij->i", x, x)[:, None] + (centers**2).sum(axis=1)
    gaps = np.maximum(size - 2 * np.einsum("ij,kj->ik", x, centers), 0)
    if len(centers) == 1:
        return np.zeros(len(x), int), gaps[:, 0], np.full(len(x), np.inf)
    two = np.partition(gaps, 1, axis=1)[:, :2]
    close = np.flatnonzero(two[:, 1] - two[:, 0] <= CLOSE * size.max(axis=1))
    if len(close):
        gaps[close] = _gaps(x[close], centers)
        two[close] = np.partition(gaps[close], 1, axis=1)[:, :2]
    roots = np.sqrt(two).sum(axis=1)
    lead = (two[:, 1] - two[:, 0]) / np.where(roots > 0, roots, 1)
    return gaps.argmin(axis=1), two[:, 0], lead


def _classes(leads: np.ndarray) -> np.ndarray:
    """Numbers of rows by class of their lead; class i begins at ``_class_start(i)``."""
    with np.errstate(divide="ignore"):
        place = np.clip(np.floor(np.log2(leads) * _OCTAVE), -_SIDE, _SIDE)
    return np.bincount(place.astype(int) + _SIDE, minlength=2 * _SIDE + 1).astype(float)


def _class_start(i: int) -> float:
    return 2.0 ** ((i - _SIDE) / _OCTAVE)


def _reach(centers: list[list[float]], at: list[list[float]]) -> float:
    """How far the two centres that moved most since ``at`` have moved together."""
    moves = np.sort(np.sqrt(((np.array(centers) - np.array(at)) ** 2).sum(axis=1)))
    return float(moves[-2:].sum())


def _holds(bounds: list[tuple], centers: list[list[float]]) -> bool:
    """Whether rows set apart by a lead of more than each gap are still where they were."""
    return all(_reach(centers, at) < gap * 0.999 for at, gap in bounds)


def _moved(total: np.ndarray, centers: list[list[float]]) -> list[list[float]]:
    return [_rounded(t[2:] / t[0]) if t[0] else list(c) for t, c in zip(total, centers, strict=True)]


def _sums(x: np.ndarray, n: np.ndarray, centers: np.ndarray, assigned: tuple | None = None) -> np.ndarray:
    """Per centre: weight, cost and weighted sum of the rows nearest to it."""
    near, gap, _ = assigned or _assigned(x, centers)
    out = np.zeros((len(centers), x.shape[1] + 2))
    out[:, 0] = np.bincount(near, weights=n, minlength=len(centers))
    out[:, 1] = np.bincount(near, weights=gap * n, minlength=len(centers))
    for c in range(len(centers)):
        out[c, 2:] = np.einsum("i,ij->j", np.where(near == c, n, 0), x)
    return out


def _drawn(x: np.ndarray, n: np.ndarray, centers: np.ndarray, cost: float, number: int, seed: int) -> np.ndarray:
    """Rows that become candidates: ``number`` of them in expectation if ``cost`` is the cost of all."""
    chance = number * n * _gaps(x, centers).min(axis=1) / cost if cost > 0 else np.zeros(len(x))
    return x[_ranks(x, seed) < chance]


class _LocalPasses:
    """Passes over rows and weights in memory."""

    def __init__(self, x: np.ndarray, n: np.ndarray):
        self.x, self.n, self.rows = x, n, len(x)

    def all_rows(self) -> tuple[np.ndarray, np.ndarray]:
        return self.x, self.n

    def first(self, seed: int) -> np.ndarray:
        """The row of lowest rank."""
        rank = _ranks(self.x, seed)
        return self.x[min(np.flatnonzero(rank == rank.min()), key=lambda i: self.x[i].tolist())]

    def sums(self, starts: list[np.ndarray]) -> list[np.ndarray]:
        return [_sums(self.x, self.n, c) for c in starts]

    def rounds(self, starts: list[np.ndarray]) -> list[tuple[np.ndarray, None]]:
        return [(total, None) for total in self.sums(starts)]

    def ahead(self, _classes, _total, _base, _bounds, _at, centers, _left):
        """Nothing is set aside: all rows are at hand."""
        return centers, 0

    def drawn(self, starts: list[np.ndarray], costs: list[float], number: int, seeds: list[int]) -> list[np.ndarray]:
        return [_drawn(self.x, self.n, c, f, number, s) for c, f, s in zip(starts, costs, seeds, strict=True)]


def _chunk(x: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([{"x": x.tobytes(), "n": n.tobytes(), "rows": len(x)}], schema=_PACKED)


def _packed(points: DataFrame, shift: np.ndarray, scale: np.ndarray) -> DataFrame:
    """Rows (x, _n), scaled, as a table of blocks of numbers, which a pass reads without touching each."""
    most = PACKED // len(shift) or 1

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = (batch.column(0).flatten().to_numpy().reshape(-1, len(shift)) - shift) / scale
            n = batch.column(1).to_numpy().astype(float)
            for at in range(0, len(x), most):
                yield _chunk(x[at : at + most], n[at : at + most])

    return points.select("x", "_n").mapInArrow(task, "x binary, n binary, rows long")


def _written(packed: DataFrame) -> DataFrame:
    """The packed table in files small enough for all cores to share it."""
    path = scratch_path(packed.sparkSession, "points")
    packed.write.option("maxRecordsPerFile", PACKED_ROWS).parquet(path)
    return packed.sparkSession.read.schema(packed.schema).parquet(path)


@dataclass(frozen=True)
class _Reader:
    """Packed batches as scaled rows and weights."""

    columns: int

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for batch in batches:
            for x, n in zip(batch.column(0), batch.column(1), strict=True):
                yield np.frombuffer(x.as_buffer(), float).reshape(-1, self.columns), np.frombuffer(n.as_buffer(), float)


class _SparkPasses:
    """The same passes over a written packed table, a job each."""

    def __init__(self, points: DataFrame, rows: int, columns: int):
        tasks = max(-(-rows // ROWS_PER_TASK), rows * columns // TASK_CELLS, 1)
        self.written, self.points = points, points.coalesce(tasks)
        self.rows, self.columns = rows, columns

    def _found(self, task, schema: str, whole: bool = False) -> DataFrame:
        """Rows of ``task`` for each part of the table, or for the table as one part."""
        read, points = _Reader(self.columns), self.written.coalesce(1) if whole else self.points
        return points.mapInArrow(lambda batches: task(read(batches)), schema)

    def all_rows(self) -> tuple[np.ndarray, np.ndarray]:
        rows = self.points.select("x", "n").collect()  # START_ROWS at most
        x = [np.frombuffer(r[0], float).reshape(-1, self.columns) for r in rows]
        return np.concatenate(x), np.concatenate([np.frombuffer(r[1], float) for r in rows])

    def first(self, seed: int) -> np.ndarray:
        def task(parts):
            for x, n in parts:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([_ranks(x, seed).min()]), pa.array([_LocalPasses(x, n).first(seed).tolist()])], ["rank", "x"]
                )

        return np.array(self._found(task, "rank double, x array<double>").orderBy("rank", "x").head()["x"])

    def sums(self, starts: list[np.ndarray]) -> list[np.ndarray]:
        return [total for total, _ in self.rounds(starts)]

    def rounds(self, starts: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
        """(sums, numbers of rows by class of their lead) for each of ``starts``."""

        def task(parts):
            total = [np.zeros((len(c), c.shape[1] + 2)) for c in starts]
            classes = [np.zeros(2 * _SIDE + 1) for _ in starts]
            for x, n in parts:
                for t, k, c in zip(total, classes, starts, strict=True):
                    assigned = _assigned(x, c)
                    t += _sums(x, n, c, assigned)
                    k += _classes(assigned[2])
            flat = np.concatenate([t.reshape(-1) for t in total + classes])
            yield pa.RecordBatch.from_arrays([pa.array([flat.tobytes()])], ["sums"])

        flat = np.zeros(sum(len(c) * (c.shape[1] + 2) for c in starts) + len(starts) * (2 * _SIDE + 1))
        for row in self._found(task, "sums binary").collect():  # a row of each task
            flat += np.frombuffer(row.sums, float)
        out = []
        for c in starts:
            size = len(c) * (c.shape[1] + 2)
            out.append(flat[:size].reshape(len(c), -1))
            flat = flat[size:]
        return list(zip(out, flat.reshape(len(starts), -1), strict=True))

    def near(self, centers: list[list[float]], gap: float, rows: int) -> _SparkPasses:
        """Passes over the ``rows`` rows at most whose lead is below ``gap``, written to a table."""
        at = np.array(centers)

        def task(parts):
            for x, n in parts:
                mine = _assigned(x, at)[2] < gap
                if mine.any():
                    yield _chunk(x[mine], n[mine])

        found = self._found(task, "x binary, n binary, rows long")
        return _SparkPasses(_written(found), rows, self.columns)

    def ahead(
        self, classes: np.ndarray, total: np.ndarray, base: np.ndarray, bounds: list[tuple],
        at: list[list[float]], centers: list[list[float]], left: int,
    ) -> tuple[list[list[float]], int]:
        """(centroids, rounds done) after rounds over the rows near a border of ``at`` alone, if these are few.

        ``total`` are the sums of the rows here for ``at``, ``base`` those of rows set apart before
        under ``bounds``; ``centers`` are the means that follow.
        """
        below = np.cumsum(classes) - classes  # rows with a lead below the start of each class
        least = STEPS * _reach(centers, at)
        fits = min(ROWS_PER_TASK, CELLS_PER_TASK // self.columns)
        for most in (min(fits, self.rows // SMALLER), self.rows // SMALLER):
            place = int(np.flatnonzero(below <= most)[-1])
            gap, rows = _class_start(place), int(below[place])
            if gap >= least:
                break
        else:
            return centers, 0
        near = self.near(at, gap, rows)
        rest = base + total - near.sums([np.array(at)])[0]
        walk = near.walk_in_one_task if rows <= fits else near.walk
        result = walk(rest, [*bounds, (at, gap)], centers, left)
        discard(near.written)
        return result

    def walk(self, base: np.ndarray, bounds: list[tuple], centers: list[list[float]], left: int) -> tuple[list[list[float]], int]:
        return _walk(self, base, bounds, centers, left)

    def walk_in_one_task(self, base: np.ndarray, bounds: list[tuple], centers: list[list[float]], left: int) -> tuple[list[list[float]], int]:
        def task(parts):
            found = [(np.empty((0, base.shape[1] - 2)), np.empty(0)), *parts]
            local = _LocalPasses(*(np.concatenate(a) for a in zip(*found, strict=True)))
            reached, used = _walk(local, base, bounds, centers, left)
            yield pa.RecordBatch.from_arrays([pa.array([reached]), pa.array([used])], ["centers", "used"])

        row = self._found(task, "centers array<array<double>>, used long", whole=True).head()
        if row is None:  # no row near a border, so no task
            return _walk(_LocalPasses(np.empty((0, base.shape[1] - 2)), np.empty(0)), base, bounds, centers, left)
        return [list(c) for c in row.centers], row.used

    def drawn(self, starts: list[np.ndarray], costs: list[float], number: int, seeds: list[int]) -> list[np.ndarray]:
        def task(parts):
            for x, n in parts:
                for k, (c, cost, seed) in enumerate(zip(starts, costs, seeds, strict=True)):
                    rows = _drawn(x, n, c, cost, number, seed)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(rows), k, np.int32)), pa.array(rows.tolist(), pa.list_(pa.float64()))], ["start", "x"]
                    )

        out: list[list] = [[] for _ in starts]
        for row in self._found(task, "start int, x array<double>").collect():  # a few times ``number``
            out[row.start].append(row.x)
        return [np.array(sorted(rows), float).reshape(-1, self.columns) for rows in out]


def _chosen(x: np.ndarray, n: np.ndarray, k: int, seed: int) -> np.ndarray:
    """The best of a few k-means runs on weighted candidates, each from a start drawn by cost."""
    order = np.lexsort(x.T[::-1])
    x, n = x[order], n[order]
    best, found = None, x[:k]
    for draw in range(TRIES):
        random = np.random.default_rng([seed, draw])
        centers = [x[random.choice(len(x), p=n / n.sum())]]
        while len(centers) < k:
            chance = n * _gaps(x, np.array(centers)).min(axis=1)
            if not chance.sum():
                break
            centers.append(x[random.choice(len(x), p=chance / chance.sum())])
        centers = np.array(centers)
        for _ in range(100):
            sums = _sums(x, n, centers)
            moved = np.where(sums[:, :1] > 0, sums[:, 2:] / np.maximum(sums[:, :1], 1e-300), centers)
            if np.allclose(moved, centers, rtol=0, atol=1e-12):
                break
            centers = moved
        cost = round(float(_sums(x, n, centers)[:, 1].sum()), 6)
        if len(centers) == k and (best is None or cost < best):
            best, found = cost, centers
    return found


def _starts(passes, k: int, seeds: list[int]) -> list[np.ndarray]:
    """First centroids of each restart."""
    if passes.rows <= START_ROWS:
        x, n = passes.all_rows()
        return [_chosen(x, n, k, seed) for seed in seeds]
    found = [passes.first(seed)[None] for seed in seeds]
    for turn in range(DRAWS):
        costs = [round(float(s[:, 1].sum()), 6) for s in passes.sums(found)]
        draws = passes.drawn(found, costs, DRAWN * k, [seed + 7919 * (turn + 1) for seed in seeds])
        found = [np.unique(np.concatenate([a, b]), axis=0) for a, b in zip(found, draws, strict=True)]
    sums = passes.sums(found)
    return [_chosen(c, s[:, 0], k, seed) for c, s, seed in zip(found, sums, seeds, strict=True)]


def _walk(passes, base: np.ndarray, bounds: list[tuple], centers: list[list[float]], left: int) -> tuple[list[list[float]], int]:
    """(centroids, rounds done) after rounds over ``passes`` and ``base`` while ``bounds`` hold and centroids move."""
    used = 0
    while used < left and _holds(bounds, centers):
        total, classes = passes.rounds([np.array(centers)])[0]
        moved = _moved(total + base, centers)
        if moved == centers:
            break
        used += 1
        centers, more = passes.ahead(classes, total, base, bounds, centers, moved, left - used)
        used += more
    return centers, used


def _fitted(passes, k: int, seeds: list[int], max_iter: int) -> tuple[list[int], list[list[float]], bool]:
    """(sizes, centroids, fixed point reached) of the cheapest restart."""
    runs = {i: [_rounded(c) for c in start] for i, start in enumerate(_starts(passes, min(k, passes.rows), seeds))}
    done: dict[int, tuple] = {}
    turns = dict.fromkeys(runs, 0)
    while len(done) < len(runs):
        open_ = [i for i in runs if i not in done]
        for i, (total, classes) in zip(open_, passes.rounds([np.array(runs[i]) for i in open_]), strict=True):
            turns[i] += 1
            moved = _moved(total, runs[i])
            result = (round(float(total[:, 1].sum()), 6), [int(t) for t in total[:, 0]], runs[i])
            if moved == runs[i]:
                done[i] = (*result, True)
            elif turns[i] >= max_iter:
                done[i] = (*result, False)
            else:
                runs[i], used = passes.ahead(classes, total, np.zeros_like(total), [], runs[i], moved, max_iter - 1 - turns[i])
                turns[i] += used
    _, sizes, centers, fixed = min((done[i] for i in sorted(done)), key=lambda d: d[0])
    return sizes, centers, fixed


def kmeans(
    table: DataFrame,
    columns: list[str],
    k: int = 2,
    normalize: bool = True,
    seed: int = DEFAULT_SEED,
    restarts: int = 2,
    max_iter: int = 300,
) -> KMeansResult:
    """Fit k-means on the (standardised) columns; of ``restarts`` runs the cheapest is kept.

    Each run starts from centroids drawn over all rows by hashes of their values and repeats
    assignment and means until no centroid moves, so the result does not depend on how the rows lie
    in partitions (sums are rounded to DIGITS places, which makes another path by another order of
    summation unlikely, not impossible). ``converged`` is false, with a warning, if ``max_iter``
    rounds do not get there. Fewer distinct rows than ``k`` make fewer clusters, missing values are
    an error. Clusters are numbered by size, largest first, equal sizes by centroid.
    """
    scaler = fit_scaler(table, columns) if normalize else None
    require_filled(table, columns, scaler)
    # Equal rows move together, so each is kept once with its weight.
    cells = F.array(*[F.col(c).cast("double") for c in columns]).alias("x")
    shift = np.array(scaler.means if scaler else [0.0] * len(columns))
    scale = np.array(scaler.deviations if scaler else [1.0] * len(columns))
    points = _written(_packed(table.select(cells).groupBy("x").agg(F.count("*").alias("_n")), shift, scale))
    rows = points.agg(F.sum("rows")).first()[0]
    if not rows:
        raise ValueError("k-means needs at least one row")
    seeds = [seed + run for run in range(restarts)]
    passes = _SparkPasses(points, rows, len(columns))
    if rows <= ROWS_PER_TASK and rows * len(columns) <= CELLS_PER_TASK:
        sizes, centers, fixed = _in_one_task(passes, k, seeds, max_iter)
    else:
        sizes, centers, fixed = _fitted(passes, k, seeds, max_iter)
    if not fixed:
        warnings.warn(f"k-means has not reached a fixed point in {max_iter} rounds", stacklevel=2)
    ranked = sorted(zip(sizes, centers), key=lambda item: (-item[0], item[1]))
    return KMeansResult(list(columns), scaler, [center for _, center in ranked], fixed)


def _in_one_task(passes: _SparkPasses, k: int, seeds: list[int], max_iter: int) -> tuple[list[int], list[list[float]], bool]:
    """All passes inside the one task that reads the table."""

    def task(parts):
        found = list(parts)
        if found:
            local = _LocalPasses(*(np.concatenate(a) for a in zip(*found, strict=True)))
            order = np.lexsort(local.x.T[::-1])
            local.x, local.n = local.x[order], local.n[order]
            sizes, centers, fixed = _fitted(local, k, seeds, max_iter)
            yield pa.RecordBatch.from_arrays([pa.array([sizes]), pa.array([centers]), pa.array([fixed])], ["sizes", "centers", "fixed"])

    row = passes._found(task, "sizes array<long>, centers array<array<double>>, fixed boolean", whole=True).head()
    return list(row.sizes), [list(c) for c in row.centers], row.fixed
