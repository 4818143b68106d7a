"""FNV-1 64-bit hash of a string, scaled to the unit interval."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Published FNV-1 64-bit prime and offset basis.
FNV_PRIME = 1099511628211
FNV_OFFSET_BASIS = 14695981039346656037

# Start value used for features: with 0 the 32-bit variant gives the example value
# published for the hashing library (FNV-1 32 of "hello world" = 2805756500).
DEFAULT_INIT = 0

_LOW = (1 << 32) - 1
_FULL = (1 << 64) - 1
# Below this many strings left, bytes are cheaper in plain integers than in numpy calls.
_FEW = 24


def fnv1_64_array(strings: pa.Array, init: int = DEFAULT_INIT) -> np.ndarray:
    """Unsigned 64-bit FNV-1 values of a non-null Arrow string array."""
    binary = strings.cast(pa.large_binary())
    count = len(binary)
    if count == 0:
        return np.zeros(0, dtype=np.uint64)
    _, offsets_buffer, data_buffer = binary.buffers()
    offsets = np.frombuffer(offsets_buffer, dtype=np.int64)[binary.offset : binary.offset + count + 1]
    data = (
        np.frombuffer(data_buffer, dtype=np.uint8)
        if data_buffer is not None
        else np.zeros(0, dtype=np.uint8)
    )
    lengths = np.diff(offsets)
    longest_first = np.argsort(-lengths, kind="stable")
    starts = offsets[:-1][longest_first]
    lengths = lengths[longest_first]
    # alive[p] = how many strings are longer than p bytes
    alive = np.searchsorted(-lengths, -np.arange(lengths[0]), side="left")
    state = np.full(count, init, dtype=np.uint64)
    prime = np.uint64(FNV_PRIME)
    place = 0
    while place < lengths[0] and alive[place] >= _FEW:
        n = alive[place]
        state[:n] = (state[:n] * prime) ^ data[starts[:n] + place]
        place += 1
    if place < lengths[0]:
        for row in range(alive[place]):
            value = int(state[row])
            for byte in data[starts[row] + place : starts[row] + lengths[row]].tobytes():
                value = ((value * FNV_PRIME) & _FULL) ^ byte
            state[row] = value
    result = np.empty_like(state)
    result[longest_first] = state
    return result


def _unit_batch(strings: pa.Array, init: int) -> pa.Array:
    encoded = strings.fill_null("None").dictionary_encode()
    unit = fnv1_64_array(encoded.dictionary, init).astype(np.float64) / 2.0**64
    return pa.array(unit[encoded.indices.to_numpy(zero_copy_only=False)])


def _arrow_unit(init: int):
    @F.arrow_udf("double")
    def hash_to_unit(strings: pa.Array) -> pa.Array:
        return _unit_batch(strings, init)

    return hash_to_unit


def _native_unit(text: Column, init: int) -> Column:
    """The same value from built-in expressions: 32-bit halves keep the products in BIGINT."""
    pairs = F.regexp_extract_all(F.hex(F.encode(text, "UTF-8")), F.lit("(..)"), F.lit(1))
    octets = F.transform(pairs, lambda pair: F.conv(pair, 16, 10).cast("bigint"))

    def mix(state: Column, octet: Column) -> Column:
        low = state["lo"] * F.lit(435)
        high = state["hi"] * F.lit(435) + F.shiftright(low, 32) + state["lo"] * F.lit(256)
        return F.struct(
            high.bitwiseAND(F.lit(_LOW)).alias("hi"),
            low.bitwiseAND(F.lit(_LOW)).bitwiseXOR(octet).alias("lo"),
        )

    def scale(state: Column) -> Column:
        whole = state["hi"].cast("decimal(20,0)") * F.lit(1 << 32) + state["lo"].cast("decimal(20,0)")
        return whole.cast("double") / F.lit(2.0**64)

    start = F.struct(
        F.lit(init >> 32).cast("bigint").alias("hi"), F.lit(init & _LOW).cast("bigint").alias("lo")
    )
    return F.aggregate(octets, start, mix, scale)


def fnv1_64_unit(column: str | Column, init: int = DEFAULT_INIT, engine: str = "arrow") -> Column:
    """FNV-1 64 of the UTF-8 bytes divided by 2^64; a missing value hashes as "None".

    ``arrow`` hashes the distinct values of each Arrow batch with numpy, all columns of
    a projection in one Python stage; ``native`` stays in the JVM but runs byte by byte
    in interpreted higher-order functions.
    """
    text = F.col(column) if isinstance(column, str) else column
    if engine == "arrow":
        return _arrow_unit(init)(text)
    if engine == "native":
        return _native_unit(F.coalesce(text, F.lit("None")), init)
    raise ValueError(f"engine must be 'arrow' or 'native', got {engine!r}")
