"""Token files in a Simple-8b word-aligned code.

A document is its token ids followed by an end id. Documents in ascending doc_id order go into
file images of about FILE_IDS ids. An image is

    magic "S8B1" | n_docs u32 | n_ids u64 | n_blocks u32 | n_words u64 | n_escapes u64
    doc ids i64[n_docs] | doc lengths u64[n_docs]
    block word offsets u64[n_blocks + 1] | block escape offsets u64[n_blocks + 1]
    words u64[n_words] | escapes u32[n_escapes]

all little-endian. Every block holds BLOCK_IDS ids (the last one fewer) and starts at a new word,
so any block is decoded alone by its offsets. A word is a 4-bit selector and as many fields of
equal width as fit into 60 bits; a field of all ones is an escape, whose id is the next one in
the block's escape list. At each place the selector with the fewest bytes per id is taken, escapes
counted. Decoding handles all words of one selector at once.

The images are rows of a Parquet table, so Spark's commit protocol makes the output whole after
lost executors or repeated tasks, in any store that Spark reaches; :func:`save_images` writes them
out as plain files.

Defined results: a null text is an empty document (the end id alone); documents without doc_id
come first; repeated doc_ids stay separate documents; an empty table gives no image.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from logsift.llm.common import pieces
from logsift.llm.tokens import TokenCoder

# Fields per word by selector; a field has 60 // n bits.
FIELDS = (60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1)
BLOCK_IDS = 4096
FILE_IDS = 4 << 20
_HEAD = "<4sIQIQQ"
_MAGIC = b"S8B1"


def _selectors(ids: np.ndarray) -> np.ndarray:
    """For each place the selector with the fewest bytes per id, if a word starts there.

    A word ends with its block; a shorter rest counts as full, which changes no choice that matters.
    """
    n = len(ids)
    best = np.full(n, len(FIELDS) - 1, np.uint8)
    cost = np.full(n, 8, np.float32)
    over = np.zeros(n + FIELDS[0] + 1, np.int32)
    for code in range(len(FIELDS) - 2, -1, -1):
        fields = FIELDS[code]
        wide = ids >= (1 << (60 // fields)) - 1
        # Three fields of 20 bits cost 8 / 3 bytes per id; only with this many narrow ids can more
        # fields cost less.
        least = fields // 3 + 2
        narrow = np.flatnonzero(~wide)
        if fields > 3 and not (narrow[least - 1 :] - narrow[: max(0, len(narrow) - least + 1)] < fields).any():
            continue
        np.cumsum(wide, out=over[1 : n + 1])
        over[n + 1 :] = over[n]
        spent = (over[fields : fields + n] - over[:n]).astype(np.float32)
        spent *= 4 / fields
        spent += 8 / fields
        better = spent < cost
        if better.any():
            best[better] = code
            np.minimum(cost, spent, out=cost)
    return best


def encode_blocks(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(words, word offsets, escapes, escape offsets) of all blocks of ``ids``."""
    best = _selectors(ids)
    fields_at = np.array(FIELDS, np.uint8)[best].tolist()
    starts: list[int] = []
    word_offsets = [0]
    for block in range(0, len(ids), BLOCK_IDS):
        at, stop = block, min(block + BLOCK_IDS, len(ids))
        while at < stop:
            starts.append(at)
            at += fields_at[at]
        word_offsets.append(len(starts))
    begin = np.array(starts, np.int64)
    chosen = best[begin]
    stop = np.minimum((begin // BLOCK_IDS + 1) * BLOCK_IDS, len(ids))
    words = chosen.astype(np.uint64) << np.uint64(60)
    escaped = np.zeros(len(ids), bool)
    for code in np.unique(chosen):
        fields = FIELDS[code]
        bits = 60 // fields
        ones = (1 << bits) - 1
        mine = np.flatnonzero(chosen == code)
        packed = words[mine]
        for i in range(fields):
            place = begin[mine] + i
            inside = place < stop[mine]
            value = ids[np.where(inside, place, 0)]
            if bits < 33:
                escaped[place[inside & (value >= ones)]] = True
                value = np.minimum(value, np.uint32(ones))
            packed |= np.where(inside, value, 0).astype(np.uint64) << np.uint64(i * bits)
        words[mine] = packed
    places = np.flatnonzero(escaped)
    edges = np.arange(0, len(ids) + BLOCK_IDS, BLOCK_IDS)[: len(word_offsets)]
    return words, np.array(word_offsets, np.uint64), ids[places], np.searchsorted(places, edges).astype(np.uint64)


def decode_blocks(words: np.ndarray, counts: np.ndarray, offsets: np.ndarray, escapes: np.ndarray) -> np.ndarray:
    """Ids of consecutive blocks: ``counts`` ids each, words of block k at offsets[k]:offsets[k + 1]."""
    codes = (words >> np.uint64(60)).astype(np.int64)
    held = np.array(FIELDS + (0, 0))[codes]
    # The last word of a block may have spare fields: it holds what is left of the count.
    block = np.repeat(np.arange(len(counts)), np.diff(offsets))
    sums = np.cumsum(held) - held
    within = sums - sums[offsets[:-1][block]] if len(words) else sums
    held = np.minimum(held, counts[block] - within)
    begin = np.cumsum(held) - held
    out = np.empty(int(counts.sum()), np.uint64)
    escaped = np.zeros(len(out), bool)
    for code in np.unique(codes):
        fields = FIELDS[code]
        bits = 60 // fields
        ones = np.uint64((1 << bits) - 1)
        mine = np.flatnonzero(codes == code)
        for i in range(fields):
            here = mine[held[mine] > i]
            value = (words[here] >> np.uint64(i * bits)) & ones
            out[begin[here] + i] = value
            escaped[begin[here] + i] = value == ones
    out[escaped] = escapes
    return out.astype(np.uint32)


def image_of(doc_ids: list[int | None], documents: list[np.ndarray]) -> bytes:
    """File image of documents given as arrays of ids; a missing doc_id is stored as the least long."""
    lengths = np.array([len(d) for d in documents], np.uint64)
    ids = np.concatenate(documents) if documents else np.empty(0, np.uint32)
    words, word_offsets, escapes, escape_offsets = encode_blocks(ids)
    head = struct.pack(
        _HEAD, _MAGIC, len(documents), len(ids), len(word_offsets) - 1, len(words), len(escapes)
    )
    named = np.array([NO_ID if d is None else d for d in doc_ids], np.int64)
    parts = (named, lengths, word_offsets, escape_offsets, words, escapes)
    return head + b"".join(x.tobytes() for x in parts)


NO_ID = -(1 << 63)


def read_image(image: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """(doc ids, document lengths, all ids) of a file image."""
    magic, docs, n, blocks, n_words, n_escapes = struct.unpack_from(_HEAD, image)
    if magic != _MAGIC:
        raise ValueError("not a token file")
    at, parts = struct.calcsize(_HEAD), []
    for kind, size in (
        (np.int64, docs), (np.uint64, docs), (np.uint64, blocks + 1), (np.uint64, blocks + 1),
        (np.uint64, n_words), (np.uint32, n_escapes),
    ):
        parts.append(np.frombuffer(image, kind, size, at))
        at += parts[-1].nbytes
    named, lengths, offsets, _, words, escapes = parts
    counts = np.minimum(BLOCK_IDS, n - np.arange(blocks) * BLOCK_IDS).astype(np.int64)
    ids = decode_blocks(words, counts, offsets.astype(np.int64), escapes)
    return [None if d == NO_ID else d for d in named.tolist()], lengths.astype(np.int64), ids


IMAGES = "shard long, file long, n_ids long, image binary"


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int, spaced: bool = False) -> None:
    """Write ``docs`` (doc_id, text) as file images in ascending doc_id order below ``folder``.

    Images are ordered by (shard, file). ``tokenizer`` is a file that every node has.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, shard = TokenCoder(tokenizer, spaced), TaskContext.get().partitionId()
        end, file = np.array([end_id], np.uint32), 0
        names, held, size = [], [], 0

        def image():
            return pa.RecordBatch.from_pydict(
                {"shard": [shard], "file": [file], "n_ids": [size], "image": [image_of(names, held)]}
            )

        for batch in pieces(batches, 4 << 20):
            for name, ids in zip(batch.column(0).to_pylist(), coder.encode(batch.column(1)), strict=True):
                names.append(name)
                held.append(np.concatenate([ids, end]))
                size += len(held[-1])
                if size >= FILE_IDS:
                    yield image()
                    file, names, held, size = file + 1, [], [], 0
        if held:
            yield image()

    ordered = (
        docs.select("doc_id", "text").repartitionByRange(F.col("doc_id").asc()).sortWithinPartitions("doc_id")
    )
    ordered.mapInArrow(rows, IMAGES).write.parquet(folder)


READ = "shard long, file long, doc_id long, local long, n_tokens long, ids_crc32 long"


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) decoded from the images; start counts all earlier ids."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):  # one image at a time in memory
                row = {name: batch.column(k)[at].as_py() for k, name in enumerate(batch.schema.names)}
                names, lengths, ids = read_image(row["image"])
                stops = np.cumsum(lengths)
                starts = stops - lengths
                sums = [zlib.crc32(ids[a:b]) for a, b in zip(starts.tolist(), stops.tolist(), strict=True)]
                n = len(names)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([row["shard"]] * n, pa.int64()),
                        pa.array([row["file"]] * n, pa.int64()),
                        pa.array(names, pa.int64()),
                        pa.array(starts),
                        pa.array(lengths),
                        pa.array(sums, pa.int64()),
                    ],
                    names=["shard", "file", "doc_id", "local", "n_tokens", "ids_crc32"],
                )

    images = spark.read.schema(IMAGES).parquet(folder)
    # One row per file image goes through this running sum, never the ids.
    before = Window.orderBy("shard", "file").rowsBetween(Window.unboundedPreceding, -1)
    bases = images.select(
        "shard", "file", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("base")
    )
    return (
        images.mapInArrow(rows, READ)
        .join(bases, ["shard", "file"])
        .select("doc_id", (F.col("base") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")
    )


def save_images(spark: SparkSession, folder: str, write) -> None:
    """Hand every image to ``write(name, bytes)`` on the executors, e.g. to upload plain files."""

    def each(rows):
        for row in rows:
            write(f"{row.shard:08d}-{row.file:06d}.s8b", bytes(row.image))

    spark.read.schema(IMAGES).parquet(folder).foreachPartition(each)
