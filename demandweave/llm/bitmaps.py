"""A table's hashes as a bitmap of fixed size, to pass over rows that have no partner before they are shuffled.

The size is fixed whatever the table: a full bitmap passes everything, which costs time and loses nothing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import in_batches

PARTS = 64


def bitmap(hashes: DataFrame, bits: int) -> np.ndarray:
    """Packed bits of the long column ``hash``; ``bits`` is a power of two, the driver receives bits / 8 bytes."""
    width = bits // PARTS

    def mark(batches):
        parts: dict[int, np.ndarray] = {}
        for batch in batches:
            at = batch.column("bit").to_numpy()
            part = at // width
            for p in np.unique(part).tolist():
                parts.setdefault(p, np.zeros(width, bool))[at[part == p] % width] = True
        cols = {"part": pa.array(list(parts), pa.int64()), "bits": pa.array([np.packbits(v).tobytes() for v in parts.values()], pa.binary())}
        yield pa.RecordBatch.from_pydict(cols)

    bit = F.col("hash").bitwiseAND(bits - 1)
    marked = hashes.select(bit.alias("bit"), F.floor(bit / width).alias("part")).repartition(PARTS, "part")
    out = np.zeros((PARTS, width // 8), np.uint8)
    for part, packed in in_batches(marked.select("bit"), mark, "part long, bits binary").collect():
        out[part] |= np.frombuffer(packed, np.uint8)
    return out.reshape(-1)


def found(mask: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether each 64-bit hash may be in the table of the bitmap."""
    at = hashes.view(np.int64) & np.int64(8 * len(mask) - 1)
    return (mask[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1
