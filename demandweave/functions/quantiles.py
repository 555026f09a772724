"""Exact global quantiles without gathering a column into one task.

``percentile`` keeps a value->count map in one final task, which is fine per series (bounded by
the calendar) and wrong for a whole table. Here a value becomes a 64-bit number in the same order, and a wanted rank
is found digit by digit: a histogram over 16 bits tells the digit, and only the values that share it are looked at
again. Four histograms of at most 65,536 bins per rank are all that is ever held, however many rows or equal values
there are.
"""

from __future__ import annotations

import math
import struct

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import stored

DIGIT, DIGITS = 16, 4


def order_key(v: Column) -> Column:
    """A long in the order of the doubles, the two zeros being one: the bits of the absolute value, by plain
    arithmetic that is exact in each step, and the sign."""
    size = F.abs(v)
    # the logarithm may be off by one next to a power of two
    e = F.greatest(F.least(F.floor(F.log2(size)), F.lit(1023)), F.lit(-1022))
    m = size / F.pow(F.lit(2.0), e)
    e, m = (
        F.when(m >= 2, e + 1).when(m < 1, e - 1).otherwise(e),
        F.when(m >= 2, m / 2).when(m < 1, m * 2).otherwise(m),
    )
    bits = F.shiftleft((e + 1023).cast("long"), 52) + ((m - 1) * 2.0**52).cast("long")
    small = (size * 2.0**537 * 2.0**537).cast("long")
    bits = F.when(size < 2.0**-1022, small).when(size == math.inf, 0x7FF << 52).otherwise(bits)
    return F.when(v < 0, -bits).otherwise(bits)


def key_value(key: int) -> float:
    return math.copysign(struct.unpack("<d", struct.pack("<q", abs(key)))[0], key)


def exact_quantiles(df: DataFrame, column: str, probs: list[float], by: str | None = None) -> DataFrame:
    """Rows ([by,] prob, value): linear-interpolated quantiles of one column, nulls and NaN ignored.

    ``by`` names a column with few values (such as the columns of a profile); per-item quantiles
    are a plain grouped ``percentile``. The driver holds two ranks per probability and group.
    """
    spark, v = df.sparkSession, F.col("v")
    group = F.col(by) if by else F.lit("all")
    keys = df.select(group.alias("g"), F.col(column).cast("double").alias("v")).where(v.isNotNull() & ~F.isnan("v"))
    keys = stored(keys.select("g", order_key(v).alias("key")), "keys")
    kind, key = keys.schema["g"].dataType, F.col("key")
    place = T.StructType([T.StructField("g", kind), T.StructField("prefix", T.LongType())])
    target = T.StructType([*place, *(T.StructField(n, t) for n, t in (
        ("prob", T.DoubleType()), ("side", T.IntegerType()), ("rank", T.LongType())))])
    same = lambda a, b: (F.col(f"{a}.prefix") == F.col(f"{b}.prefix")) & F.col(f"{a}.g").eqNullSafe(F.col(f"{b}.g"))
    found, total, left = {}, {}, None
    for shift in range(DIGIT * (DIGITS - 1), -1, -DIGIT):
        if left is None:
            inside = keys.withColumn("prefix", F.lit(0).cast("long"))
        else:
            wanted = spark.createDataFrame(list({(r["g"], r["prefix"]) for r in left}), place)
            inside = keys.withColumn("prefix", F.shiftright(key, shift + DIGIT))
            inside = inside.alias("k").join(F.broadcast(wanted).alias("w"), same("k", "w"), "left_semi")
        bins = inside.groupBy("g", "prefix", F.shiftright(key, shift).alias("bin")).agg(
            F.count("*").alias("c"), F.min("key").alias("lo"), F.max("key").alias("hi"))
        whole = W.partitionBy("g", "prefix")
        bins = bins.withColumns({"upto": F.sum("c").over(whole.orderBy("bin")), "n": F.sum("c").over(whole)})
        if left is None:
            at = [(p, F.lit(p) * (F.col("n") - 1)) for p in probs]
            ends = [(p, side, end(x)) for p, x in at for side, end in enumerate((F.floor, F.ceil))]
            ends = F.array(*[F.struct(F.lit(float(p)).alias("prob"), F.lit(side).alias("side"), x.cast("long").alias("rank"))
                             for p, side, x in ends])
            bins = bins.select("*", F.inline(ends))
        else:
            targets = spark.createDataFrame([tuple(r[c] for c in target.names) for r in left], target)
            bins = bins.alias("b").join(F.broadcast(targets).alias("t"), same("b", "t")).select("b.*", "prob", "side", "rank")
        start = F.col("upto") - F.col("c")
        hits = bins.where((start <= F.col("rank")) & (F.col("rank") < F.col("upto"))).select(
            "g", F.col("bin").alias("prefix"), "prob", "side", (F.col("rank") - start).alias("rank"), "lo", "hi", "n")
        left = hits.collect()
        for r in left:
            total.setdefault(r["g"], r["n"])  # of the first histogram, which counts all
            if r["lo"] == r["hi"]:
                found[r["g"], r["prob"], r["side"]] = key_value(r["lo"])
        left = [r for r in left if r["lo"] != r["hi"]]
        if not left:
            break
    out = []
    for g, n in total.items():
        for p in map(float, probs):
            at, below, above = p * (n - 1), found[g, p, 0], found[g, p, 1]
            out.append((g, p, below + (above - below) * (at - math.floor(at)) if above != below else below))
    schema = T.StructType([T.StructField("g", kind), T.StructField("prob", T.DoubleType()), T.StructField("value", T.DoubleType())])
    rows = spark.createDataFrame(out, schema)
    return rows.withColumnRenamed("g", by) if by else rows.drop("g")


def quantile_map(df: DataFrame, column: str, probs: list[float]) -> Column:
    """Scalar map prob -> exact quantile; attach it to a frame once and read it from there."""
    return exact_quantiles(df, column, probs).agg(
        F.map_from_entries(F.collect_list(F.struct("prob", "value"))).alias("m")).scalar()


def quartile_bucket(df: DataFrame, column: str, labels: list[str], name: str) -> DataFrame:
    """Label of the right-closed quartile; the lowest value belongs to the first one."""
    inner = [0.25, 0.5, 0.75]
    cuts = df.withColumn("__cuts", quantile_map(df, column, inner))
    above = sum(((F.col(column) > F.element_at("__cuts", F.lit(p))).cast("int") for p in inner), F.lit(1))
    label = F.element_at(F.array(*[F.lit(x) for x in labels]), above)
    return cuts.withColumn(name, label).drop("__cuts")
