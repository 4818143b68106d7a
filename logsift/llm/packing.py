"""Packing of tokenised documents into sequences by minimum bin slack.

A document is its token ids and an end id. One that is longer than a sequence is cut into pieces
of full length, the first piece taking the remainder. Only the number of pieces of each length
matters for the packing, and there are at most as many lengths as a sequence has tokens, so this
histogram is the one thing that is planned in one place: the longest length left opens a bin, a
subset-sum dynamic programme over the lengths still available (a bitset of reachable sums) finds
the fullest completion, and the combination is repeated as often as its lengths last. Pieces then
find their place in parallel from their rank among the pieces of their length.

Defined results: a null or empty text is the end id alone; repeated rows are packed each by
itself; an empty table gives no piece.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from logsift.llm.common import pieces, text_batches, trimmed
from logsift.llm.tokens import TokenCoder, vocabulary_size
from logsift.scratch import materialize

CAPACITY = 2048


def fullest(counts: dict[int, int], lengths: list[int], room: int) -> dict[int, int]:
    """Copies by length with the largest sum within ``room``; ``lengths`` in descending order."""
    reach, layers = 1, []
    mask = (1 << (room + 1)) - 1
    for length in lengths:
        copies = min(counts[length], room // length)
        take = 1
        while copies > 0:
            take = min(take, copies)
            layers.append((length, take, reach))
            reach |= (reach << (length * take)) & mask
            copies -= take
            take *= 2
        if reach >> room:
            break
    left, chosen = reach.bit_length() - 1, {}
    for length, take, before in reversed(layers):
        if not before >> left & 1:
            chosen[length] = chosen.get(length, 0) + take
            left -= length * take
    return chosen


def slack_plan(histogram: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """(copies by length, number of sequences) until every piece of the histogram is placed."""
    counts = {n: c for n, c in histogram.items() if c > 0}
    order = sorted(counts, reverse=True)
    plan = []
    while order:
        longest = order[0]
        counts[longest] -= 1
        room = capacity - longest
        need = fullest(counts, [n for n in order if n <= room and counts[n]], room)
        counts[longest] += 1
        need[longest] = need.get(longest, 0) + 1
        times = min(counts[n] // k for n, k in need.items())
        for n, k in need.items():
            counts[n] -= k * times
        plan.append((need, times))
        order = [n for n in order if counts[n]]
    return plan


class Places:
    """Sequence and offset of the r-th piece of a length, by search in one sorted table."""

    _SHIFT = 1 << 44

    def __init__(self, plan: list[tuple[dict[int, int], int]]):
        rows, used, first = [], {}, 0
        for need, times in plan:
            offset = 0
            for length in sorted(need, reverse=True):
                copies = need[length]
                base = used.get(length, 0)
                rows.append((length * self._SHIFT + base, copies, first, offset))
                used[length] = base + copies * times
                offset += length * copies
            first += times
        self.sequences = first
        columns = zip(*sorted(rows), strict=True) if rows else ([], [], [], [])
        self.keys, self.copies, self.first, self.offset = (np.array(c, np.int64) for c in columns)

    def of(self, lengths: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys = lengths * self._SHIFT + ranks
        row = np.searchsorted(self.keys, keys, side="right") - 1
        nth, slot = np.divmod(keys - self.keys[row], self.copies[row])
        return self.first[row] + nth, self.offset[row] + slot * lengths


PIECES = "shard long, doc_id long, piece int, start long, length long, ids_crc32 long, ids binary, place long"


def token_pieces(
    docs: DataFrame,
    tokenizer: str,
    end_id: int,
    spaced: bool,
    capacity: int,
    keep_ids: bool = False,
    narrow: bool = False,
) -> DataFrame:
    """Pieces of all documents, each with its place among the pieces of its length in the task.

    Ids that are kept take four bytes each, or two if ``narrow``.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, shard = TokenCoder(tokenizer, spaced), TaskContext.get().partitionId()
        kind = np.dtype("<u2" if narrow else "<u4")
        end, seen = np.array([end_id], np.uint32), np.zeros(capacity + 1, np.int64)
        for batch in pieces(batches, 4 << 20):
            out = {name: [] for name in ("shard", "doc_id", "piece", "start", "length", "ids_crc32", "ids", "place")}
            for name, ids in zip(batch.column(0).to_pylist(), coder.encode(batch.column(1)), strict=True):
                ids = np.concatenate([ids, end])
                first = len(ids) % capacity or capacity
                for piece, stop in enumerate(range(first, len(ids) + 1, capacity)):
                    start = 0 if piece == 0 else stop - capacity
                    part = ids[start:stop]
                    out["shard"].append(shard)
                    out["doc_id"].append(name)
                    out["piece"].append(piece)
                    out["start"].append(start)
                    out["length"].append(len(part))
                    out["ids_crc32"].append(zlib.crc32(part))
                    out["ids"].append(part.astype(kind).tobytes() if keep_ids else None)
                    out["place"].append(int(seen[len(part)]))
                    seen[len(part)] += 1
            yield pa.RecordBatch.from_pydict(out, schema=_PIECES_ARROW)

    return docs.select("doc_id", "text").mapInArrow(trimmed(rows), PIECES)


_PIECES_ARROW = pa.schema(
    [(n, pa.int64()) for n in ("shard", "doc_id")]
    + [("piece", pa.int32())]
    + [(n, pa.int64()) for n in ("start", "length", "ids_crc32")]
    + [("ids", pa.binary()), ("place", pa.int64())]
)


def widened(ids: pa.Array) -> pa.Array:
    """Binaries of two-byte ids as binaries of four-byte ids; null stays null."""
    bounds = np.frombuffer(ids.buffers()[1], np.int32)[ids.offset : ids.offset + len(ids) + 1]
    data = np.frombuffer(ids.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]]
    wide = data.view("<u2").astype("<u4")
    offsets = ((bounds - bounds[0]) * 2).astype(np.int32)
    filled = pa.Array.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(offsets), pa.py_buffer(wide)])
    return pc.if_else(ids.is_valid(), filled, pa.scalar(None, pa.binary()))


def packed(cut: DataFrame, capacity: int = CAPACITY, narrow: bool = False) -> DataFrame:
    """The pieces with ``sequence_id`` and ``offset``; ``cut`` is a written table of pieces.

    Needs ``length``, ``shard`` and ``place``, a number from 0 among the rows of equal length and
    shard; other columns are kept, ``ids`` that are ``narrow`` with four bytes each.
    """
    per_shard = cut.groupBy("length", "shard").agg(F.count("*").alias("_n"))
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    places = Places(slack_plan(histogram, capacity))  # at most ``capacity`` lengths
    before = Window.partitionBy("length").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_shard.select("length", "shard", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "_rank"))
            sequence, offset = places.of(length.astype(np.int64), rank.astype(np.int64))
            columns = batch.columns[:-1]
            if narrow:
                columns = [widened(c) if n == "ids" else c for n, c in zip(batch.schema.names, columns, strict=False)]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())],
                names=[*batch.schema.names[:-1], "sequence_id", "offset"],
            )

    kept = [c for c in cut.columns if c not in ("shard", "place")]
    ranked = cut.join(offsets, ["length", "shard"]).select(
        *kept, (F.col("_before") + F.col("place")).alias("_rank")
    )
    schema = cut.select(*kept).schema.add("sequence_id", "long").add("offset", "long")
    return ranked.mapInArrow(trimmed(rows), schema)


def pack_documents(
    docs: DataFrame,
    tokenizer: str,
    end_id: int,
    spaced: bool = True,
    capacity: int = CAPACITY,
    keep_ids: bool = False,
) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, ids, sequence_id, offset) of (doc_id, text).

    Ids (null unless kept) are little-endian and four bytes long; as long as they travel with their
    pieces they take two, if the vocabulary allows.
    """
    narrow = keep_ids and max(vocabulary_size(tokenizer), end_id + 1) <= 1 << 16
    with text_batches(docs.sparkSession):
        cut = materialize(token_pieces(docs, tokenizer, end_id, spaced, capacity, keep_ids, narrow), "pieces")
    return packed(cut, capacity, narrow)


def assembled(placed: DataFrame) -> DataFrame:
    """(sequence_id, length, ids): the ids of every sequence as bytes, from pieces with their ids."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return placed.groupBy("sequence_id").agg(
        F.sum("length").alias("length"),
        F.unhex(F.array_join(F.transform(parts, lambda p: F.hex(p.getField("ids"))), "")).alias("ids"),
    )
