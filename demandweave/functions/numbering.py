"""Consecutive numbering of a whole table without sorting it in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


#: Keys from which the bucket borders are taken: the first of all distinct keys by their hash.
BORDER_KEYS = 4096


def global_row_number(df: DataFrame, text_key: str, order: list[str], name: str = "row_number",
                      buckets: int = 64) -> DataFrame:
    """1-based row number by (text_key, order...).

    Rows are spread over order-preserving buckets of the whole key, numbered inside each bucket, and shifted by
    the rows of the earlier buckets, a table of at most ``buckets`` rows. The borders are whole keys out of a
    bounded sample, so keys that share any prefix still part.
    """
    key = F.coalesce(F.col(text_key).cast("string"), F.lit(""))
    sample = df.select(key.alias("k")).distinct().orderBy(F.xxhash64("k"), "k").limit(BORDER_KEYS)
    chosen = sample.agg(F.array_sort(F.collect_list("k")).alias("k")).select(F.transform(
        F.sequence(F.lit(1), F.lit(buckets - 1)),
        lambda i: F.get("k", F.floor(i * F.size("k") / buckets).cast("int"))).alias("s")).scalar()
    below = F.size(F.filter("__splits", lambda s: s < key))
    bucketed = df.withColumn("__splits", chosen).withColumn("__bucket", below).drop("__splits")
    counts = bucketed.groupBy("__bucket").agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(W.orderBy("__bucket").rowsBetween(W.unboundedPreceding, -1))
    offsets = counts.select("__bucket", F.coalesce(before, F.lit(0)).alias("__before"))
    inside = F.row_number().over(W.partitionBy("__bucket").orderBy(text_key, *order))
    return (
        bucketed.withColumn("__rn", inside).join(F.broadcast(offsets), "__bucket")
        .withColumn(name, F.col("__rn") + F.col("__before"))
        .drop("__bucket", "__rn", "__before")
    )
