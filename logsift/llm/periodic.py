"""Runs of words that repeat with a period at least four times, found by block convolution.

A run of period q from L to 2L - 1 is at least 4q long, so it holds a whole block of L words (blocks
start at multiples of L) and the same block again q words later. For each L = 1, 2, 4, ... all blocks
are convolved with the 3L words that follow their start: the sum of squared differences at a distance
is zero where the block occurs. It is exact in integers modulo a prime, by number-theoretic transforms
of many blocks at once. Each distance found is a seed: it is extended to both sides as far as words q
apart are equal, and the stretch is a run if it is long enough. A difference that is a multiple of
the prime would seed in vain only, as what is reported has been compared word by word.

Words that a text has fewer than four times lie in no run, so only the stretches between them are
looked through; a distance inside a run already known by a period that divides it is that run again.

Defined results: a null text has no words; a row without id is never made periodic; repeated rows have
their own result each; an empty table gives no row; work is in n log^2 n for a text of n words.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from logsift.llm.common import mixed, pieces, spread, text_bytes

BATCH_BYTES = 2 << 20
LEAST, REPEATS = 6, 4
# Cells of a matrix of blocks.
CELLS = 1 << 20
# Primes of the form k 2^n + 1 with 3 as a generator: one to transform by, both for fingerprints.
PRIME, SECOND = 998244353, 469762049
_GENERATOR = 3


@cache
def _powers(half: int, inverse: bool) -> np.ndarray:
    """Powers 0 to half - 1 of a root of unity of order 2 half."""
    root = pow(_GENERATOR, (PRIME - 1) // (2 * half), PRIME)
    if inverse:
        root = pow(root, -1, PRIME)
    out = np.ones(1, np.uint64)
    while len(out) < half:
        out = np.concatenate([out, out * np.uint64(pow(root, len(out), PRIME)) % np.uint64(PRIME)])
    return out[:half]


def transform(rows: np.ndarray) -> np.ndarray:
    """Number-theoretic transform of each row (a power of two long), in bit-reversed order."""
    p, n = np.uint64(PRIME), rows.shape[1]
    half = n // 2
    while half:
        cut = rows.reshape(len(rows), -1, 2, half)
        a, b = cut[:, :, 0], cut[:, :, 1]
        out = np.empty_like(cut)
        np.remainder(a + b, p, out=out[:, :, 0])
        np.remainder((a + p - b) * _powers(half, False), p, out=out[:, :, 1])
        rows, half = out.reshape(rows.shape), half // 2
    return rows


def restore(rows: np.ndarray) -> np.ndarray:
    """Inverse of ``transform``."""
    p, n = np.uint64(PRIME), rows.shape[1]
    half = 1
    while half < n:
        cut = rows.reshape(len(rows), -1, 2, half)
        a, b = cut[:, :, 0], cut[:, :, 1] * _powers(half, True) % p
        out = np.empty_like(cut)
        np.remainder(a + b, p, out=out[:, :, 0])
        np.remainder(a + p - b, p, out=out[:, :, 1])
        rows, half = out.reshape(rows.shape), half * 2
    return rows * np.uint64(pow(n, -1, PRIME)) % p


def mismatches(blocks: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """Sum of squared differences, modulo PRIME, of each block and its window at shifts 0 to L - 1.

    Blocks are L long, windows 2L; a shift reads no more than 2L - 1 of them, so nothing wraps.
    """
    p, size = np.uint64(PRIME), blocks.shape[1]
    turned = np.zeros_like(windows)
    turned[:, 0] = blocks[:, 0]
    turned[:, size + 1 :] = blocks[:, :0:-1]
    products = restore(transform(turned) * transform(windows) % p)[:, :size]
    sums = np.zeros((len(windows), 2 * size + 1), np.uint64)
    np.cumsum(windows * windows % p, axis=1, out=sums[:, 1:])
    squares = sums[:, size : 2 * size] - sums[:, :size] + (blocks * blocks % p).sum(axis=1, keepdims=True)
    return (squares % p + (p - products) * np.uint64(2)) % p


class _Prints:
    """Fingerprints of all stretches of x: equal ones for equal stretches."""

    def __init__(self, x: np.ndarray):
        self.tables = []
        for prime in (PRIME, SECOND):
            p = np.uint64(prime)
            base = np.ones(1, np.uint64)
            while len(base) < len(x):
                factor = np.uint64(pow(1_000_003, len(base), prime))
                base = np.concatenate([base, base * factor % p])
            base = base[: len(x)]
            self.tables.append((p, base, np.append(np.uint64(0), np.cumsum(x % p * base % p)) % p))

    def equal(self, at: np.ndarray, size: int, shift: np.ndarray) -> np.ndarray:
        """Are x[at : at + size] and the stretch ``shift`` further on alike?"""
        out = np.ones(len(at), bool)
        for p, base, sums in self.tables:
            near = (sums[at + size] + p - sums[at]) * base[shift] % p
            out &= near == (sums[at + shift + size] + p - sums[at + shift]) % p
        return out


def _extended(prints: _Prints, n: int, at: np.ndarray, size: int, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of the stretch around at : at + size in which cells d apart are alike."""
    start, end = at.copy(), at + size
    step = 1 << max(n.bit_length() - 1, 0)
    while step:
        room = np.flatnonzero(end + d + step <= n)
        end[room[prints.equal(end[room], step, d[room])]] += step
        room = np.flatnonzero(start >= step)
        start[room[prints.equal(start[room] - step, step, d[room])]] -= step
        step >>= 1
    return start, end + d


def _exact(x: np.ndarray, start: int, end: int, d: int) -> Iterator[tuple[int, int]]:
    """The stretches in it that hold when compared cell by cell; fingerprints never make one too short."""
    same = x[start : end - d] == x[start + d : end]
    edges = start + np.flatnonzero(np.diff(np.concatenate([[0], same.astype(np.int8), [0]])))
    return zip(edges[::2].tolist(), (edges[1::2] + d).tolist(), strict=True)


def _seeds(x: np.ndarray, first: np.ndarray, last: np.ndarray, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(block start, distance) of each block's occurrences ``size`` to 2 ``size`` - 1 cells later.

    ``first`` and ``last`` bound the stretches; a distance is at most a quarter of its stretch.
    """
    number = (last - first) // size - 1
    owner = np.repeat(np.arange(len(first)), number)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(number) - number, number)
    block = first[owner] + nth * size
    most = (last - first)[owner] // REPEATS
    at_once = max(1, CELLS // (2 * size))
    for k in range(0, len(block), at_once):
        b = block[k : k + at_once]
        cells = b[:, None] + np.arange(size)
        windows = np.minimum(b[:, None] + size + np.arange(2 * size), len(x) - 1)
        row, shift = np.nonzero(mismatches(x[cells], x[windows]) == 0)
        d = shift + size
        who = owner[k : k + at_once][row]
        good = (d <= most[k : k + at_once][row]) & (b[row] + d + size <= last[who])
        yield b[row[good]], d[good]


def stretches(codes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(flat cells, start, end) of the stretches of words that their text has REPEATS times or more."""
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    _, cell, counts = np.unique(owner * (codes.max(initial=0) + 1) + codes, return_inverse=True, return_counts=True)
    live = counts[cell] >= REPEATS
    edge = np.diff(np.concatenate([[0], live.astype(np.int8), [0]]))
    cut = np.zeros(len(codes) + 1, bool)
    cut[bounds] = True
    starts = np.flatnonzero((edge == 1) | (cut & np.append(live, False)))
    ends = np.flatnonzero((edge == -1) | (cut & np.append(False, live)))
    long = ends - starts >= LEAST
    return cell, starts[long], ends[long]


def find_runs(codes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of all runs of the texts bounds[i] : bounds[i + 1] of ``codes``.

    Starts count over all texts; no run crosses a bound. Codes are not negative.
    """
    none = np.empty(0, np.int64)
    cell, starts, ends = stretches(codes, bounds)
    if not len(starts):
        return none, none, none
    # Stretches one after the other, each closed by a cell that nothing equals.
    sizes = ends - starts
    first = 1 + np.cumsum(sizes + 1) - (sizes + 1)
    last = first + sizes
    total = int(last[-1]) + 1
    name = np.zeros(total, np.uint64)
    inside = spread(first, sizes)
    name[inside] = cell[spread(starts, sizes)]
    closing = np.ones(total, bool)
    closing[inside] = False
    name[closing] = np.uint64(len(cell)) + np.arange(int(closing.sum()), dtype=np.uint64)
    with np.errstate(over="ignore"):
        x = mixed(name + np.uint64(1)) % np.uint64(PRIME)
    prints = _Prints(x)
    found: dict[tuple[int, int], int] = {}
    size = 1
    while (wide := sizes >= max(LEAST, REPEATS * size)).any():
        reach, period = _known(found, total)
        for at, d in _seeds(x, first[wide], last[wide], size):
            new = (reach[at] < at + d + size) | (d % period[at] != 0)
            at, d = at[new], d[new]
            if not len(at):
                continue
            begin, end = _extended(prints, total, at, size, d)
            long = end - begin >= np.maximum(LEAST, REPEATS * d)
            for *stretch, q in np.unique(np.stack([begin[long], end[long], d[long]], axis=1), axis=0).tolist():
                for a, b in _exact(name, *stretch, q):
                    if b - a >= max(LEAST, REPEATS * q):
                        found[a, b] = min(q, found.get((a, b), q))
        size *= 2
    if not found:
        return none, none, none
    spans = np.array([(a, b, q) for (a, b), q in found.items()])
    at = spans[:, 0] + (starts - first)[np.searchsorted(first, spans[:, 0], "right") - 1]
    order = np.lexsort((spans[:, 2], at))
    return at[order], (spans[:, 1] - spans[:, 0])[order], spans[:, 2][order]


def _known(found: dict[tuple[int, int], int], n: int) -> tuple[np.ndarray, np.ndarray]:
    """End and period of the longest known run at each cell."""
    reach, period = np.zeros(n, np.int64), np.ones(n, np.int64)
    for (a, b), q in sorted(found.items(), key=lambda f: f[0][1] - f[0][0]):
        reach[a:b], period[a:b] = b, q
    return reach, period


def made_periodic(doc_id: int | None, n: int) -> np.ndarray | None:
    """Places of the words of a text that is made periodic from some word on, or None if it stays."""
    if doc_id is None or n == 0:
        return None
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    at = np.arange(n)
    return np.where(at < a, at, a + (at - a) % p)


RUNS = "doc_id long, n_words long, runs array<struct<start long, length long, period long>>, collapsed binary"
_RUNS = pa.schema(
    [
        ("doc_id", pa.int64()), ("n_words", pa.int64()),
        ("runs", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))),
        ("collapsed", pa.binary()),
    ]
)


def periodic_runs(docs: DataFrame, altered=None) -> DataFrame:
    """RUNS of every row of ``docs`` (doc_id, text): all runs by start and period, and the text without
    what they repeat.

    A word goes if a run holds it after its first period. ``altered`` gives for (doc_id, number of
    words) the places of the words to take instead of the text's own, or None.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, BATCH_BYTES):
            ids = batch.column(0).to_pylist()
            texts = [(t or b"").split() for t in batch.column(1).to_pylist()]
            if altered:
                for i, places in enumerate(map(altered, ids, map(len, texts))):
                    if places is not None:
                        texts[i] = [texts[i][k] for k in places.tolist()]
            bounds = np.append(0, np.cumsum([len(t) for t in texts])).astype(np.int64)
            words = pa.array([w for t in texts for w in t], pa.binary()).dictionary_encode()
            start, length, period = find_runs(words.indices.to_numpy().astype(np.int64), bounds)
            owner = np.searchsorted(bounds, start, "right") - 1
            at = np.searchsorted(owner, np.arange(len(ids) + 1))
            gone = np.zeros(int(bounds[-1]) + 1, np.int64)
            np.add.at(gone, start + period, 1)
            np.add.at(gone, start + length, -1)
            stay = np.cumsum(gone)[:-1] == 0
            local = start - bounds[owner]
            runs = pa.StructArray.from_arrays([pa.array(local), pa.array(length), pa.array(period)], names=["start", "length", "period"])
            kept = [
                b" ".join(t if at[i] == at[i + 1] else [t[k] for k in np.flatnonzero(stay[bounds[i] : bounds[i + 1]]).tolist()])
                for i, t in enumerate(texts)
            ]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).cast(pa.int64()),
                    pa.array(np.diff(bounds)),
                    pa.ListArray.from_arrays(pa.array(at, pa.int32()), runs),
                    pa.array(kept, pa.binary()),
                ],
                schema=_RUNS,
            )

    return text_bytes(docs).mapInArrow(rows, RUNS)
