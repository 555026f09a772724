"""Quantiles by digits against sorting."""

import math
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from demandweave.functions.quantiles import exact_quantiles, key_value, order_key, quartile_bucket

PROBS = [0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0]


def test_keys_are_the_bits_in_order(spark):
    rng = random.Random(1)
    values = [struct.unpack("<d", struct.pack("<Q", rng.getrandbits(64)))[0] for _ in range(4000)]
    values = [v for v in values if not math.isnan(v)]
    values += [0.0, -0.0, 5e-324, -5e-324, 2.0**-1022, 2.0**-1023, 1.7976931348623157e308, math.inf, -math.inf, 1.0, -1.0]
    values += [math.nextafter(2.0**e, d) for e in range(-1022, 1023, 7) for d in (-math.inf, math.inf)] + [2.0**e for e in range(-1074, 1024, 5)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for r in df.select("v", order_key(F.col("v")).alias("k")).collect():
        bits = struct.unpack("<q", struct.pack("<d", abs(r["v"])))[0]
        assert r["k"] == (-bits if r["v"] < 0 else bits), r["v"]
        assert key_value(r["k"]) == r["v"]


def quantiles(df, **more):
    return {(r["g"] if "g" in r else None, r["prob"]): r["value"] for r in exact_quantiles(df, "v", PROBS, **more).collect()}


@pytest.mark.parametrize("kind", ["distinct", "equal", "near", "few"])
def test_a_million_values(spark, kind):
    v = {"distinct": "(id * 2654435761) % 1000003 - 500000.25", "equal": "7.5D", "near": "1 + id * 2.220446049250313e-16",
         "few": "cast(id % 3 as double)"}[kind]
    df = spark.range(1_000_000).selectExpr(f"cast({v} as double) AS v").repartition(4)
    values = df.toPandas()["v"].to_numpy()
    for (_, p), got in quantiles(df).items():
        at, ordered = p * (len(values) - 1), np.sort(values)
        low, high = ordered[math.floor(at)], ordered[math.ceil(at)]
        assert got == low + (high - low) * (at - math.floor(at))


def test_groups_nulls_and_empty_tables(spark):
    rng = random.Random(2)
    rows = [(g, rng.choice([None, float("nan"), rng.gauss(0, 10), -0.0, 3.0])) for g in ("a", "b", None) for _ in range(300)] + [("c", 1.0), ("d", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    found = quantiles(df, by="g")
    assert {g for g, _ in found} == {"a", "b", "c", None}
    for (g, p), got in found.items():
        own = [v for x, v in rows if x == g and v is not None and not math.isnan(v)]
        assert got == pytest.approx(np.quantile(own, p), rel=1e-12, abs=1e-12)
    assert exact_quantiles(df.limit(0), "v", PROBS).count() == 0
    labelled = quartile_bucket(spark.range(8).selectExpr("cast(id as double) AS v"), "v", ["q1", "q2", "q3", "q4"], "q")
    assert [r["q"] for r in labelled.orderBy("v").collect()] == ["q1", "q1", "q2", "q2", "q3", "q3", "q4", "q4"]
