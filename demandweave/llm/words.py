"""Words of Arrow text batches, found for a whole batch at a time.

A byte table turns separators into blanks (and letters into lower case); only ASCII bytes change, so
UTF-8 stays valid. Words come back as one flat array with an offset per row, so no row makes a Python
list of its words.
"""

from __future__ import annotations

import contextlib
import ctypes
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession

from demandweave.session import ship_package

SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
#: Rows handled together at most hold so many text bytes (one longer row still goes whole).
BATCH_BYTES = 1 << 20
#: Arrow batches go to the workers when they hold so many bytes (one longer row still goes whole): a little less than
#: whole pieces of BATCH_BYTES, so that no small piece is left over. Spark's own 64 MB are held several times over.
ARROW_BYTES = 15 * BATCH_BYTES // 4

_A = np.uint64(0x9E3779B97F4A7C15)
_B = np.uint64(0xC2B2AE3D27D4EB4F)
_S = np.uint64(29)


def byte_table(separators: bytes = SPACES, lower: bool = False) -> np.ndarray:
    """256 bytes: what each byte of a text becomes before it is split at blanks."""
    table = np.arange(256, dtype=np.uint8)
    if lower:
        table[65:91] += 32
    table[list(separators)] = 32
    return table


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a text column and an offset per row; null counts as empty."""
    column = pc.fill_null(column.cast(pa.string()), "")
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None else np.empty(0, np.uint8)
    return data, ends.astype(np.int64) - int(ends[0])


def flat_words(column: pa.Array, table: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """All words of a text column in order, and an offset per row into them."""
    data, ends = text_buffer(column)
    text = pa.Array.from_buffers(
        pa.string(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(table[data])]
    )
    parts = pc.ascii_split_whitespace(text)
    flat, bounds = parts.flatten(), parts.offsets.to_numpy().astype(np.int64)
    full = pc.greater(pc.binary_length(flat), 0)
    kept = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))])
    return flat.filter(full), kept[bounds]


def word_hashes(flat: pa.Array) -> np.ndarray:
    """A 64-bit hash per word; each distinct word is hashed once."""
    coded = flat.dictionary_encode()
    distinct = np.fromiter(
        (xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary)
    )
    return distinct[coded.indices.to_numpy()] if len(flat) else np.empty(0, np.uint64)


#: Words are hashed together up to so many bytes at a time (one longer word still goes whole).
SLICE = 1 << 17
_BASES = (0x9E3779B97F4A7C1B, 0xD6E8FEB86659FD93)


@functools.cache
def _hash_tables(n: int):
    """Per base: a random value per byte, the powers of the base and those of its inverse, n of each."""
    def power(base):
        factors = np.full(n, base, np.uint64)
        factors[0] = 1
        return np.cumprod(factors, dtype=np.uint64)

    out = []
    for k, base in enumerate(_BASES):
        values = mixed(mixed(np.arange(1, 257, dtype=np.uint64) * _B + np.uint64(k)) * _A)
        out.append((values, power(base), power(pow(base, -1, 1 << 64))))
    return out


def hashed_words(column: pa.Array, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash per word of a text column in order, and an offset per row into them.

    A word's bytes are the digits of a number to an odd base, made from running sums, so no word becomes an object.
    Two such numbers with random digits are mixed into one hash."""
    data, ends = text_buffer(column)
    data = table[data]
    inside = np.concatenate([data != 32, [False]])
    edge = np.zeros(len(data) + 1, bool)
    edge[0] = edge[ends] = True
    first, last = inside.copy(), np.zeros(len(data) + 1, bool)
    first[1:] &= ~inside[:-1] | edge[1:]
    last[1:] = inside[:-1] & (~inside[1:] | edge[1:])
    starts, stops = np.flatnonzero(first), np.flatnonzero(last)
    hashes, i = np.empty(len(starts), np.uint64), 0
    while i < len(starts):
        at = int(starts[i])
        j = max(i + 1, int(np.searchsorted(stops, at + SLICE, "right")))
        n = int(stops[j - 1]) - at
        a, b, own = starts[i:j] - at, stops[i:j] - at, data[at : at + n]
        sums = []
        for values, power, inverse in _hash_tables(SLICE if n <= SLICE else 1 << n.bit_length()):
            run = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values[own] * power[:n], dtype=np.uint64)])
            sums.append((run[b] - run[a]) * inverse[a])
        hashes[i:j] = mixed(mixed(sums[0]) * _B + sums[1])
        i = j
    return hashes, np.searchsorted(starts, ends)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _S)) * _A
    return x ^ (x >> np.uint64(32))


def window_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of each window of ``size`` words of the flat array (windows may cross rows)."""
    n = max(0, len(hashes) - size + 1)
    out = np.full(n, size, np.uint64)
    for j in range(size):
        out = mixed(out * _B + hashes[j : j + n])
    return out


def release() -> None:
    """Give unused memory back: the worker lives on, and other stages need it."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # other C libraries do without
        ctypes.CDLL(None).malloc_trim(0)


def small_batches(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """The same rows in pieces of about BATCH_BYTES of text."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy().astype(np.int64)
        group = np.cumsum(sizes) // BATCH_BYTES
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(sizes)]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                yield batch.slice(a, b - a)
    release()


def with_columns(batch: pa.RecordBatch, **columns: pa.Array) -> pa.RecordBatch:
    """The batch with columns set, in the place they already have."""
    return pa.RecordBatch.from_pydict({c: columns.get(c, batch.column(c)) for c in batch.schema.names})


def bound_batches(spark: SparkSession) -> None:
    """Have the session send Arrow batches of ARROW_BYTES; a lower limit of its own stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    limit = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name, "64m"))
    if limit > ARROW_BYTES:
        spark.conf.set(name, ARROW_BYTES)


def in_batches(df: DataFrame, run, schema) -> DataFrame:
    """``df`` through a function on iterators of Arrow batches; the workers get this package first."""
    ship_package(df.sparkSession)
    bound_batches(df.sparkSession)
    return df.mapInArrow(run, schema)
