"""Benchmark decontamination with a positional inverted index.

The index is a table with one row per block of documents: for every term of the block the
ascending list of its positions in the block. It is written once and holds every word of every
text. A phrase is searched term by term, rarest first: each list, less the term's offset in the
phrase, is intersected with what is left, so most phrases end after two short lists. Proximity
search merges the lists of all terms and looks at the shortest stretch that ends at each position.

Words are runs of 0-9, a-z (A-Z lower-cased) and non-ASCII characters. Defined results: a null or
wordless text has no words and no hits; an item without words has no window; an item without id
marks words but is not listed; repeated document rows each have their own result; empty tables
give no matches.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from logsift.llm.common import WordHashes, pieces, text_bytes, trimmed
from logsift.scratch import materialize

WINDOW = 10
# Text of a block in bytes; a longer document is a block of its own.
BLOCK_BYTES = 3 << 20
# Query words that one pass over the index takes along; more queries take more passes.
PASS_WORDS = 1_000_000

_KEPT = bytes(range(ord("0"), ord("9") + 1)) + bytes(range(ord("a"), ord("z") + 1)) + bytes(range(128, 256))
_LOWERED = bytes(ord(" ") if c not in _KEPT else c for c in bytes(range(256)).lower())


def alnum_words(text: bytes | None) -> list[bytes]:
    return text.translate(_LOWERED).split() if text else []


INDEX = (
    "block long, docs array<long>, lengths array<int>, terms binary, offsets binary,"
    " low binary, high binary"
)


def positional_index(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row per block: its documents and word counts, and the position list of every term."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, block = WordHashes(), TaskContext.get().partitionId() << 32
        for batch in pieces(batches, BLOCK_BYTES):
            words, lengths = [], []
            for text in batch.column(1).to_pylist():
                found = alnum_words(text)
                words += found
                lengths.append(len(found))
            values = hashes.of(words)
            order = np.argsort(values, kind="stable")
            ranked = values[order]
            first = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]])) if len(words) else order
            offsets = np.append(first, len(words)).astype(np.uint32)
            yield pa.RecordBatch.from_pylist(
                [
                    {
                        "block": block,
                        "docs": batch.column(0).to_pylist(),
                        "lengths": lengths,
                        "terms": ranked[first].tobytes(),
                        "offsets": offsets.tobytes(),
                        "low": order.astype(np.uint16).tobytes(),
                        "high": (order >> 16).astype(np.uint16).tobytes(),
                    }
                ],
                schema=_INDEX_ARROW,
            )
            block += 1
            del words, values, order, ranked

    return text_bytes(docs, key).mapInArrow(trimmed(rows), INDEX)


_INDEX_ARROW = pa.schema(
    [
        ("block", pa.int64()),
        ("docs", pa.list_(pa.int64())),
        ("lengths", pa.list_(pa.int32())),
        ("terms", pa.binary()),
        ("offsets", pa.binary()),
        ("low", pa.binary()),
        ("high", pa.binary()),
    ]
)


class Block:
    """Position lists of one index row."""

    def __init__(self, row: dict):
        self.terms = np.frombuffer(row["terms"], np.uint64)
        self.offsets = np.frombuffer(row["offsets"], np.uint32).astype(np.int64)
        self.low = np.frombuffer(row["low"], np.uint16)
        self.high = np.frombuffer(row["high"], np.uint16)
        self.ends = np.cumsum(np.array(row["lengths"], np.int64))

    def find(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of each term in the block and its number of positions (0 if absent)."""
        if not len(self.terms):
            return np.zeros(terms.shape, np.int64), np.zeros(terms.shape, np.int64)
        place = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        count = np.where(self.terms[place] == terms, self.offsets[place + 1] - self.offsets[place], 0)
        return place, count

    def positions(self, place: int) -> np.ndarray:
        part = slice(self.offsets[place], self.offsets[place + 1])
        return self.low[part].astype(np.int64) | self.high[part].astype(np.int64) << 16

    def document(self, positions: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.ends, positions, side="right")

    def phrase(self, places: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Positions where the terms stand one after the other in one document."""
        left = None
        for i in np.argsort(counts, kind="stable"):
            shifted = self.positions(places[i]) - i
            if left is None:
                left = shifted
            else:
                at = np.minimum(np.searchsorted(shifted, left), len(shifted) - 1)
                left = left[shifted[at] == left]
            if not len(left):
                return left
        left = left[left >= 0]
        return left[self.document(left) == self.document(left + len(places) - 1)]

    def near(self, places: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """(first, last) of stretches of at most ``width`` words with all terms in one document."""
        lists = [self.positions(p) for p in np.unique(places)]
        at = np.concatenate(lists)
        which = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
        order = np.argsort(at, kind="stable")
        at, which = at[order], which[order]
        first = at.copy()
        for term in range(len(lists)):
            last = np.maximum.accumulate(np.where(which == term, at, -1))
            first = np.minimum(first, last)
        good = (first >= 0) & (at - first < width)
        first, at = first[good], at[good]
        same = self.document(first) == self.document(at)
        return first[same], at[same]


def windows_of(words: list[bytes], size: int) -> list[tuple[bytes, ...]]:
    """Windows of ``size`` words; a shorter item is one window, an empty one none."""
    if len(words) < size:
        return [tuple(words)] if words else []
    return [tuple(words[i : i + size]) for i in range(len(words) - size + 1)]


MATCHES = "block long, place int, doc_id long, item_id long, start int, stop int"


def _merged(starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Overlapping or touching stretches, sorted by start, joined."""
    reach = np.maximum.accumulate(stops)
    new = np.concatenate([[True], starts[1:] > reach[:-1]])
    last = np.append(np.flatnonzero(new)[1:] - 1, len(starts) - 1)
    return starts[new], reach[last]


def _search(index: DataFrame, items: list[tuple[int | None, bytes | None]], size: int, slop: int | None) -> DataFrame:
    hashes = WordHashes()
    by_length: dict[int, list[tuple[int, np.ndarray]]] = {}
    for number, (_, text) in enumerate(items):
        for window in set(windows_of(alnum_words(text), size)):
            by_length.setdefault(len(window), []).append((number, hashes.of(list(window))))
    queries = {n: (np.array([x[0] for x in q]), np.stack([x[1] for x in q])) for n, q in by_length.items()}
    names = [item for item, _ in items]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):  # one block at a time in memory
                row = {name: batch.column(k)[at].as_py() for k, name in enumerate(batch.schema.names)}
                block, found = Block(row), {}
                for length, (owners, terms) in queries.items():
                    places, counts = block.find(terms)
                    for k in np.flatnonzero((counts > 0).all(axis=1)):
                        if slop is None:
                            first = block.phrase(places[k], counts[k])
                            last = first + length - 1
                        else:
                            first, last = block.near(places[k], length + slop)
                        if len(first):
                            found.setdefault(owners[k], []).append((first, last + 1))
                yield _match_rows(row, block, found, names)

    return index.mapInArrow(trimmed(rows), MATCHES)


def _match_rows(row: dict, block: Block, found: dict, names: list) -> pa.RecordBatch:
    """Stretches of each item by document, as word positions in it."""
    out = []
    begins = block.ends - np.array(row["lengths"], np.int64)
    for owner, parts in found.items():
        starts, stops = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(starts, kind="stable")
        starts, stops = starts[order], stops[order]
        docs = block.document(starts)
        edge = np.flatnonzero(np.diff(docs)) + 1
        for s, e, d in zip(np.split(starts, edge), np.split(stops, edge), np.split(docs, edge), strict=True):
            s, e = _merged(s, e)
            for a, b in zip((s - begins[d[0]]).tolist(), (e - begins[d[0]]).tolist(), strict=True):
                out.append(
                    {"block": row["block"], "place": int(d[0]), "doc_id": row["docs"][d[0]], "item_id": names[owner], "start": a, "stop": b}
                )
    return pa.RecordBatch.from_pylist(
        out,
        schema=pa.schema(
            [("block", pa.int64()), ("place", pa.int32()), ("doc_id", pa.int64()), ("item_id", pa.int64()), ("start", pa.int32()), ("stop", pa.int32())]
        ),
    )


def phrase_matches(index: DataFrame, items: DataFrame, size: int = WINDOW, slop: int | None = None) -> DataFrame:
    """(block, place, doc_id, item_id, start, stop): words of a document inside windows of an item.

    ``index``: written table of :func:`positional_index`; ``items``: (item_id, text). With ``slop``
    the words of a window may stand in any order within that many more words. The items go along
    with the tasks in portions of about PASS_WORDS words, one pass over the index for each.
    """
    queries = text_bytes(items, "item_id")
    words = queries.agg(F.sum(F.length("text"))).first()[0] or 0
    passes = math.ceil(words / 6 / PASS_WORDS) or 1
    found = None
    for k in range(passes):
        part = queries.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == k)
        rows = _search(index, [(r[0], None if r[1] is None else bytes(r[1])) for r in part.collect()], size, slop)
        found = rows if found is None else found.union(rows)
    return found


def contamination(docs: DataFrame, items: DataFrame, size: int = WINDOW) -> DataFrame:
    """Per document row: doc_id, n_words, n_hit, n_items, items (ids as sorted strings), contaminated."""
    index = materialize(positional_index(docs), "positions")
    hits = materialize(phrase_matches(index, items, size), "hits")
    row = ["block", "place"]
    before = Window.partitionBy(*row).orderBy("start", "stop").rowsBetween(Window.unboundedPreceding, -1)
    covered = F.greatest(
        F.col("stop") - F.greatest("start", F.coalesce(F.max("stop").over(before), F.lit(0))), F.lit(0)
    )
    per_row = (
        hits.withColumn("covered", covered)
        .groupBy(*row)
        .agg(
            F.sum("covered").alias("n_hit"),
            F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("items"),
        )
    )
    rows = index.select("block", F.posexplode(F.arrays_zip("docs", "lengths")).alias("place", "doc")).select(
        "block", "place", F.col("doc.docs").alias("doc_id"), F.col("doc.lengths").cast("long").alias("n_words")
    )
    items_of = F.coalesce("items", F.array().cast("array<string>"))
    return rows.join(per_row, row, "left").select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.size(items_of).cast("long").alias("n_items"),
        items_of.alias("items"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )
