"""Chat formatting from event logs.

A log holds events of conversations in sequence: a ``message`` opens a message, ``delta`` streams
more text to one, ``edit`` replaces its text, ``regenerate`` empties it for a new stream of deltas
and takes back every message that was opened between it and this event. ``fold_events`` brings the
log to final messages with windows over a conversation's sequence; ``render`` turns messages into
formatted turns with a loss mask, and ``read_back`` parses the formatted text again.

A turn is ``### role: text</turn>`` and a line break. Inside role and text a backslash stands
before every backslash, ``###`` and ``</turn>`` (in a role before ``:`` too), which undoes exactly.
The mask covers the texts of assistant turns.

Conversations are never gathered: they are dealt by id, sorted by sequence and read as a stream
with one hash state, so one of any length needs no more memory than its longest message. The digest
of a conversation is sequential by nature, so one task reads all of one conversation.

Defined results: a null text is empty, a null role is the empty role; equal rows are turns of their
own, ordered by (turn, role, text); a null conversation id is a conversation; an event for a
message that was never opened is ignored; empty tables give no row.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

OPEN, CLOSE = "### ", "</turn>"
ASSISTANT = "assistant"
_TEXT = re.compile(r"\\|###|</turn>")
_ROLE = re.compile(r"\\|###|</turn>|:")
_HEAD = re.compile(r"### ((?:[^\\:]|\\(?:\\|###|</turn>|:))*+): ")
_BODY = re.compile(r"(?:[^\\<]++|\\(?:\\|###|</turn>)|<(?!/turn>))*+</turn>\n")
_UNDO = re.compile(r"\\(\\|###|</turn>|:)")


def escaped(text: str) -> str:
    return _TEXT.sub(lambda m: "\\" + m[0], text)


def unescaped(text: str) -> str:
    return _UNDO.sub(r"\1", text)


def fold_events(events: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) of a log (conv_id, seq, kind, message, role, text).

    ``message`` names a message within its conversation; ``turn`` is the seq that opened it.
    """
    key = ["conv_id", "message"]
    log = events.select("conv_id", "seq", "kind", "message", "role", "text")
    so_far = Window.partitionBy(*key).orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*key)
    opened = F.min(F.when(F.col("kind") == "message", F.col("seq"))).over(so_far)
    sets = F.max(F.when(F.col("kind").isin("message", "edit", "regenerate"), F.col("seq"))).over(whole)
    seen = log.withColumn("turn", opened).where("turn IS NOT NULL").withColumn("set_at", sets)

    # A regenerated message takes back what was opened after it and before the event.
    marks = seen.where("kind = 'regenerate'").select("conv_id", F.col("turn").alias("at"), F.col("seq").alias("until"), F.lit(None).cast("string").alias("message"))
    heads = seen.where("kind = 'message' AND seq = turn").select("conv_id", F.col("turn").alias("at"), F.lit(None).cast("long").alias("until"), "message")
    earlier = Window.partitionBy("conv_id").orderBy("at").rangeBetween(Window.unboundedPreceding, -1)
    kept = (
        heads.union(marks.select("conv_id", "at", "until", "message"))
        .withColumn("gone_until", F.max("until").over(earlier))
        .where("until IS NULL AND (gone_until IS NULL OR gone_until < at)")
        .select("conv_id", "message")
    )
    parts = (
        seen.where("seq >= set_at")
        .groupBy(*key, "turn")
        .agg(
            F.first("role", ignorenulls=True).alias("late_role"),
            F.array_join(
                F.transform(
                    F.sort_array(F.collect_list(F.struct("seq", F.coalesce("text", F.lit("")).alias("text")))),
                    lambda x: x.getField("text"),
                ),
                "",
            ).alias("text"),
        )
    )
    roles = seen.where("kind = 'message' AND seq = turn").select(*key, "role")
    same = lambda a, b: [a[c].eqNullSafe(b[c]) for c in key]
    out = parts.join(kept, same(parts, kept), "left_semi")
    return out.join(roles, same(out, roles)).select(out.conv_id, "turn", "role", "text")


CHUNKS = "conv_id long, place long, role string, formatted string, mask_start int, mask_stop int"


def render(messages: DataFrame) -> DataFrame:
    """Formatted turns of (conv_id, turn, role, text); the mask is in code points of ``formatted``.

    ``place`` counts the turns of a conversation; its text is its turns in this order.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, place = object(), 0
        for batch in batches:
            out = []
            for conv, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                place = place + 1 if conv == current else 0
                current = conv
                role = role or ""
                head = OPEN + _ROLE.sub(lambda m: "\\" + m[0], role) + ": "
                body = escaped(text or "")
                mask = (len(head), len(head) + len(body)) if role == ASSISTANT else (None, None)
                out.append((conv, place, role, head + body + CLOSE + "\n", *mask))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(zip(*out, strict=True) if out else [[]] * 6, _CHUNKS, strict=True)],
                schema=_CHUNKS,
            )

    ordered = messages.select("conv_id", "turn", "role", "text").repartition("conv_id")
    ordered = ordered.sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.select("conv_id", "role", "text").mapInArrow(rows, CHUNKS)


_CHUNKS = pa.schema(
    [("conv_id", pa.int64()), ("place", pa.int64()), ("role", pa.string()), ("formatted", pa.string()), ("mask_start", pa.int32()), ("mask_stop", pa.int32())]
)

DIGESTS = (
    "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string,"
    " formatted_chars long"
)


def parsed(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of every turn of formatted text."""
    turns, at = [], 0
    while at < len(formatted):
        head = _HEAD.match(formatted, at)
        stop = _BODY.match(formatted, head.end()).end()
        turns.append((unescaped(head[1]), unescaped(formatted[head.end() : stop - len(CLOSE) - 1])))
        at = stop
    return turns


class _Digest:
    def __init__(self, conv):
        self.conv, self.turns, self.loss_chars, self.chars = conv, 0, 0, 0
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, formatted: str, start: int | None, stop: int | None):
        self.chars += len(formatted)
        for role, text in parsed(formatted):
            self.turns += 1
            self.all.update(f"{role}\n{text}\n".encode())
        if start is not None:
            masked = unescaped(formatted[start:stop])
            self.loss_chars += len(masked)
            self.loss.update(masked.encode())

    def row(self):
        return (self.conv, self.turns, self.all.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars)


def read_back(chunks: DataFrame) -> DataFrame:
    """Per conversation what its formatted text says: turns, their digest, and the masked text."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        for batch in batches:
            done = []
            for conv, formatted, start, stop in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if state is None or conv != state.conv:
                    if state is not None:
                        done.append(state.row())
                    state = _Digest(conv)
                state.add(formatted, start, stop)
            yield _digest_rows(done)
        if state is not None:
            yield _digest_rows([state.row()])

    ordered = chunks.repartition("conv_id").sortWithinPartitions("conv_id", "place")
    return ordered.select("conv_id", "formatted", "mask_start", "mask_stop").mapInArrow(rows, DIGESTS)


def _digest_rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    columns = zip(*rows, strict=True) if rows else [[]] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)
