"""Words, hashes and batches that several operators share."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from functools import cache, wraps

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

GOLDEN = np.uint64(0x9E3779B97F4A7C15)
# Words whose hash a Python worker remembers before it starts anew.
CACHED_WORDS = 200_000
# Rows of whole texts that an executor sends to a Python worker together.
TEXT_ROWS = 500


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@contextmanager
def text_batches(spark: SparkSession):
    """Jobs run inside the block send TEXT_ROWS rows at once to Python workers, or fewer if so set before."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    if not 0 < int(before) <= TEXT_ROWS:
        spark.conf.set(name, str(TEXT_ROWS))
    try:
        yield
    finally:
        spark.conf.set(name, before)


@cache
def _libc() -> ctypes.CDLL:
    return ctypes.CDLL(None)


def give_back() -> None:
    """Returns memory of this process that is free, but kept by Arrow and the C library, to the system."""
    pa.default_memory_pool().release_unused()
    if hasattr(_libc(), "malloc_trim"):  # glibc alone has it
        _libc().malloc_trim(0)


def trimmed(rows: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``rows`` for mapInArrow, after whose last batch the worker keeps no free memory.

    Workers outlive their tasks and stand beside the next stage's JVM, so what they hold adds to its.
    """

    @wraps(rows)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from rows(batches)
        finally:
            give_back()

    return run


def text_bytes(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, text) with the UTF-8 bytes of the text; a null text stays null."""
    return docs.select(F.col(key), F.col("text").cast("binary").alias("text"))


def lower_words(text: bytes | None) -> list[bytes]:
    """Words between the blanks \\x20 and \\x09-\\x0D, A-Z in lower case; none of null."""
    return text.lower().split() if text else []


def mixed(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64 over an array of unsigned 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """64-bit hash by word; the table of a worker is emptied when it is full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def rolled(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of each window of ``size`` consecutive word hashes, in order."""
    n = len(hashes) - size + 1
    if n <= 0:
        return hashes[:0]
    out = hashes[:n].copy()
    for i in range(1, size):
        out = out * GOLDEN + hashes[i : i + n]
    return mixed(out)


def pieces(batches: Iterable[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``most`` bytes of text at most (one row at least).

    Each is a copy: string kernels of Arrow misread some casts of slices.
    """
    for batch in batches:
        column = batch.column(batch.schema.get_field_index("text"))
        sizes = np.diff(np.asarray(_offsets(column)))
        start = held = 0
        for i, size in enumerate(sizes):
            if held and held + size > most:
                yield batch.take(pa.array(range(start, i)))
                start, held = i, 0
            held += int(size)
        if batch.num_rows > start:
            yield batch.take(pa.array(range(start, batch.num_rows)))


def _offsets(column: pa.Array) -> np.ndarray:
    kind = np.int64 if column.type in (pa.large_binary(), pa.large_string()) else np.int32
    whole = np.frombuffer(column.buffers()[1], kind)
    return whole[column.offset : column.offset + len(column) + 1]


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Indices of all cells of ranges, range after range."""
    ends = np.cumsum(sizes)
    out = np.repeat(starts - ends + sizes, sizes)
    out += np.arange(len(out))
    return out


def signed(x: np.ndarray) -> np.ndarray:
    """Unsigned 64-bit numbers as the longs of Spark."""
    return x.view(np.int64)
