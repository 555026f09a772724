"""Exact distinct counts that merge: per period a set of ids as bitmaps, from which coarser periods, overlaps and
counts follow without the rows.

A set is several rows of 32,768 ids each, so a set of any size is spread over tasks and no row is larger than 4 KB.
Bitmaps of few ids are almost all zeros and shrink to a hundredth when they are sent, so Spark, which sizes tasks by
the bytes sent, would give a task gigabytes of them: ids are sent instead, or the bitmaps are dealt to enough tasks.
Keys that are not whole numbers, or are far apart, get consecutive ids from a dictionary, which may be extended: ids once given stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.guards import require_columns
from ..functions.numbering import global_row_number


def key_ids(rows: DataFrame, key: str, known: DataFrame | None = None) -> DataFrame:
    """(key, id) of every key of ``rows`` that is not null, ids from 1 without a gap; ids of ``known`` are kept and new
    keys follow after them. One row per key is numbered, whatever the share of a hot key."""
    require_columns(rows, [key])
    keys = rows.select(F.col(key).alias("key")).where("key is not null").distinct()
    if known is None:
        return global_row_number(keys, "key", [], "id").select("key", "id")
    new = global_row_number(keys.join(known, "key", "left_anti"), "key", [], "id")
    taken = known.agg(F.coalesce(F.max("id"), F.lit(0))).scalar()
    return known.select("key", "id").unionByName(new.select("key", (F.col("id") + taken).alias("id")))


def day_sets(rows: DataFrame, by: list[str], key: str, name: str, ids: DataFrame | None = None) -> DataFrame:
    """(by, name, bucket, ids): the keys that occur per value of ``by``.

    ``key`` holds whole numbers, or ``ids`` gives them. Null keys belong to no set. Rows combine to one per ``by`` and
    key before they meet the dictionary, so a hot key comes to it once a day.
    """
    require_columns(rows, [*by, key])
    pairs = rows.select(*by, F.col(key).alias("key")).where("key is not null")
    pairs = pairs.distinct()
    place = F.col("key").cast("long") if ids is None else F.col("id")
    found = (pairs if ids is None else pairs.join(ids, "key")).select(
        *by, F.bitmap_bucket_number(place).alias("bucket"), F.bitmap_bit_position(place).alias("bit"))
    # the ids of a cell meet before they become a bitmap
    return found.repartition(*by, "bucket").groupBy(*by, F.lit(name).alias("name"), "bucket").agg(
        F.bitmap_construct_agg("bit").alias("ids"))


#: Bitmaps of 4 KB that one task sorts: 64 MB.
TASK_SETS = 1 << 14


def _dealt(sets: DataFrame, by: list[str]) -> DataFrame:
    """The rows placed by ``by`` over as many tasks as their bitmaps need before compression."""
    return sets.repartition(max(1, -(-sets.count() // TASK_SETS)), *by)


def roll_up(sets: DataFrame, by: dict[str, Column] | list[str]) -> DataFrame:
    """The same sets by coarser periods: columns of the sets, or expressions on them by name."""
    by = by if isinstance(by, dict) else {c: F.col(c) for c in by}
    coarse = sets.select(*[c.alias(n) for n, c in by.items()], "name", "bucket", "ids")
    return _dealt(coarse, [*by, "bucket"]).groupBy(*by, "name", "bucket").agg(
        F.bitmap_or_agg("ids").alias("ids"))


def set_sizes(sets: DataFrame, by: list[str], names: list[str]) -> DataFrame:
    """Distinct keys per value of ``by``, a column per name; a name without keys has 0."""
    size = F.bitmap_count("ids")
    return sets.groupBy(*by).agg(*[
        F.coalesce(F.sum(F.when(F.col("name") == n, size)), F.lit(0)).alias(n) for n in names])


def overlap_sizes(sets: DataFrame, period: str, step: int, name: str) -> DataFrame:
    """(period, size, kept, kept_pct): keys per period, and those among them that occur ``step`` periods earlier too.

    ``period`` is a whole number that counts periods. Every row goes to its own period and to the one that looks back
    at it; where both are there, their bits are combined.
    """
    own = sets.where(F.col("name") == name).select(period, "bucket", "ids")
    both = own.select(F.explode(F.array(
        F.struct(F.col(period).alias(period), F.lit(True).alias("own")),
        F.struct((F.col(period) + step).alias(period), F.lit(False).alias("own")))).alias("p"), "bucket", "ids")
    both = _dealt(both.select(f"p.{period}", "p.own", "bucket", "ids"), [period, "bucket"])
    cells = both.groupBy(period, "bucket").agg(
        F.sum(F.when(F.col("own"), F.bitmap_count("ids"))).alias("size"),
        F.when(F.count("*") == 2, F.bitmap_count(F.bitmap_and_agg("ids"))).otherwise(0).alias("kept"))
    out = cells.groupBy(period).agg(F.sum("size").alias("size"), F.sum(
        F.when(F.col("size").isNotNull(), F.col("kept"))).alias("kept")).where("size is not null")
    return out.withColumn("kept_pct", F.col("kept") * 100 / F.col("size"))
