"""Shards by jump consistent hashing.

A key and the number of shards decide the shard; there is no ring table and no state. When a shard is
appended, a key either stays or moves to the new shard, so about 1 / (n + 1) of the rows move. Slots number
the rows of a shard without gaps: rows are counted per shard and bucket (a table whose size is fixed), and
numbered within their bucket behind the buckets before it, so no task orders a whole shard.

Defined cases: a null key counts as key 0. Null text has no bytes (size is the fixed overhead) and checksum
0. Repeated rows get the same shard and slots of their own. An empty table gives an empty one. Other columns
pass through; a column that bears an output's name is replaced.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from demandweave.session import ship_package

OVERHEAD = 16
#: Parts in which a shard's rows are numbered; a task orders one at a time.
BUCKETS = 256


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each 64-bit key; the generator's multiplier and the method's shape are fixed values."""
    state, found = keys.astype(np.uint64), np.zeros(len(keys), np.int64)
    at, rest = np.zeros(len(keys), np.int64), np.arange(len(keys))
    with np.errstate(over="ignore"):
        while len(rest):
            found[rest] = at[rest]
            state[rest] = state[rest] * np.uint64(2862933555777941757) + np.uint64(1)
            draw = (state[rest] >> np.uint64(33)).astype(np.float64) + 1.0
            at[rest] = np.floor((found[rest] + 1) * (float(1 << 31) / draw)).astype(np.int64)
            rest = rest[at[rest] < shards]
    return found


def shard_of(key, shards: int) -> F.Column:
    """Shard column of a whole-number key column."""

    @F.pandas_udf("int")
    def jump(keys: pd.Series) -> pd.Series:
        return pd.Series(jump_hash(keys.to_numpy(np.int64), shards).astype(np.int32))

    return jump(F.coalesce(key.cast("long"), F.lit(0).cast("long")))


def into_shards(docs: DataFrame, shards: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the text, with size, text_crc32, law, shard, slot and grown_shard (the shard if there
    were one more)."""
    if shards < 1:
        raise ValueError("shards must be at least 1")
    ship_package(docs.sparkSession)
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    rows = docs.withColumns(
        {
            "size": (F.octet_length(body) + OVERHEAD).cast("long"),
            "text_crc32": F.crc32(body),
            "law": F.lit("key"),
            "shard": shard_of(F.col(key), shards),
            "grown_shard": shard_of(F.col(key), shards + 1),
        }
    ).drop(text, "slot")
    rows = rows.withColumn("__bucket", F.pmod(F.xxhash64(key, "text_crc32", "size"), F.lit(BUCKETS)))
    counts = rows.groupBy("shard", "__bucket").agg(F.count("*").alias("__n"))
    before = Window.partitionBy("shard").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "__bucket", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    order = Window.partitionBy("shard", "__bucket").orderBy(key, "text_crc32", "size")
    return (
        rows.withColumn("__row", F.row_number().over(order))
        .join(F.broadcast(offsets), ["shard", "__bucket"])  # shards * BUCKETS rows at most
        .withColumn("slot", (F.col("__before") + F.col("__row") - 1).cast("long"))
        .drop("__bucket", "__before", "__row")
    )
