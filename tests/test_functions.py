import random
import statistics

import pytest
from pyspark.sql import functions as F

from demandweave.functions import cleaning as C
from demandweave.functions import guards as G
from demandweave.functions import metrics as M
from demandweave.functions.numbering import global_row_number
from demandweave.functions.quantiles import exact_quantiles


def values(df, column):
    return [r[column] for r in df.collect()]


def test_trim_and_case(spark):
    df = spark.createDataFrame([(" \tab c\n", " x "), (None, None)], "a string, b string")
    out = C.normalize_text(C.trim_whitespace(df, ["a"]), ["b", "absent"])
    assert [tuple(r) for r in out.collect()] == [("ab c", "X"), (None, None)]


def test_fill_checks_types(spark):
    df = spark.createDataFrame([(None, None, None), (float("nan"), "x", True)],
                               "n double, t string, b boolean")
    out = C.fill_missing_boolean(C.fill_missing_text(C.fill_missing_numeric(df, ["n"]), ["t"]), ["b"])
    assert [tuple(r) for r in out.collect()] == [(0.0, "UNKNOWN", False), (0.0, "x", True)]
    with pytest.raises(TypeError):
        C.fill_missing_numeric(df, ["t"])


def test_dates_and_numbers(spark):
    df = spark.createDataFrame([("2024-02-30",), ("2024-02-29 10:00:00",), (None,)], "d string")
    out = C.convert_to_datetime(df, "d")
    assert [v is None for v in values(out, "d")] == [True, False, True]
    assert C.count_invalid_datetime(df, "d").first()[0] == 1
    parts = C.extract_date_parts(spark.sql("select timestamp'2021-01-03 00:00:00' as d"), "d").first()
    assert (parts["week"], parts["day_name"], parts["month_name"], parts["quarter"]) == (
        53, "Sunday", "January", 1)
    n = spark.createDataFrame([("1.5",), ("x",)], "v string").select(C.to_number(F.col("v")).alias("v"))
    assert values(n, "v") == [1.5, None]


def test_safe_divide_and_rounding(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 0.0), (None, 3.0)], "n double, d double")
    out = df.select(C.safe_divide(F.col("n"), F.col("d"), -1.0).alias("q"))
    assert values(out, "q") == [0.5, -1.0, -1.0]
    half = spark.createDataFrame([(0.125,), (0.375,)], "v double")
    assert values(C.round_numeric_columns(half, ["v"]), "v") == [0.12, 0.38]


def test_right_closed_bins(spark):
    df = spark.createDataFrame([(v,) for v in (-1.0, 0.0, 10.0, 10.5, 50.0, 100.0, 1e9)], "v double")
    out = df.select(C.bin_right_closed(
        F.col("v"), [0, 10, 50, 100, float("inf")], ["S", "M", "L", "B"]).alias("b"))
    assert values(out, "b") == [None, None, "S", "M", "M", "L", "B"]


def test_month_tags_order_by_time(spark):
    df = spark.createDataFrame([(t,) for t in ("APR-19", "JAN-18", "DEC-95", "mar-2020", "bad")], "t string")
    got = [str(v) for v in values(df.select(C.source_month_date(F.col("t")).alias("d")), "d")]
    assert got == ["2019-04-01", "2018-01-01", "1995-12-01", "2020-03-01", "None"]


def test_guards(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, None)], "k int, v string")
    assert G.duplicate_key_count(df, ["k"]).first()[0] == 1
    with pytest.raises(KeyError):
        G.require_columns(df, ["zz"])
    with pytest.raises(G.ContractError):
        G.require_unique(df, ["k"])
    with pytest.raises(G.ContractError):
        G.require_no_nulls(df, ["v"])
    with pytest.raises(G.ContractError):
        G.require_not_empty(df.where("k > 5"))


@pytest.mark.parametrize("n,distinct", [(1, 1), (2, 2), (7, 3), (500, 40), (60000, 50000)])
def test_exact_quantiles(spark, n, distinct):
    rnd = random.Random(n)
    data = [float(rnd.randrange(distinct)) ** 2 for _ in range(n)]
    data += [0.0] * (n // 3)  # one value holding a quarter of the rows
    df = spark.createDataFrame([(v,) for v in data] + [(None,)], "v double")
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 1.0]
    got = {r["prob"]: r["value"] for r in exact_quantiles(df, "v", probs).collect()}
    s = sorted(data)
    for p in probs:
        at = p * (len(s) - 1)
        lo, hi = int(at), min(int(at) + 1, len(s) - 1)
        assert got[p] == pytest.approx(s[lo] + (s[hi] - s[lo]) * (at - lo)), p
    assert got[0.5] == pytest.approx(statistics.median(data))


def test_exact_quantiles_by_group(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 10.0), ("b", 5.0)], "g string, v double")
    got = {r["g"]: r["value"] for r in exact_quantiles(df, "v", [0.5], by="g").collect()}
    assert got == {"a": 2.0, "b": 5.0}


def test_global_numbering_matches_one_sort(spark):
    rnd = random.Random(3)
    keys = [f"item-{rnd.randrange(400):05d}" for _ in range(3000)] + ["item-00007"] * 1500
    rows = [(k, i) for i, k in enumerate(keys)]
    df = spark.createDataFrame(rows, "k string, i int").repartition(6)
    got = {r["i"]: r["n"] for r in global_row_number(df, "k", ["i"], "n").collect()}
    for n, (k, i) in enumerate(sorted(rows), start=1):
        assert got[i] == n
    odd = [("é", 0), ("az", 1), ("aé", 2), ("b", 3), ("", 4), ("aéééééééé", 5), ("zz", 6), ("a", 7)]
    df = spark.createDataFrame(odd, "k string, i int")
    got = [r["i"] for r in global_row_number(df, "k", ["i"], "n").orderBy("n").collect()]
    assert got == [i for _, i in sorted(odd, key=lambda r: r[0].encode())]


def test_ratios(spark):
    one = spark.range(1)
    lit = F.lit
    row = one.select(
        M.rate(lit(1.0), lit(3.0)).alias("a"), M.rate(lit(1.0), lit(0.0)).alias("b"),
        M.growth_rate(lit(150.0), lit(100.0)).alias("c"), M.profit_margin(lit(20.0), lit(80.0)).alias("d"),
        M.days_of_inventory(M.inventory_turnover(lit(730.0), lit(100.0))).alias("e"),
        M.pct(lit(1.0), lit(0.0)).alias("f")).first()
    assert tuple(row) == (33.33, 0.0, 50.0, 25.0, 50.0, None)


def test_metric_arrays(spark):
    df = spark.createDataFrame([(10.0, 10.0, 5.0, 15.0), (20.0, 20.0, 15.0, 25.0), (30.0, 30.0, 25.0, 35.0)],
                               "Actual double, Predicted double, P10 double, P90 double")
    row = df.agg(*M.accuracy_aggregates(p10="P10", p90="P90", decimals=2)).first()
    assert (row["WAPE_Pct"], row["MAE"], row["P10_P90_Coverage_Pct"]) == (0.0, 0.0, 100.0)
    df = spark.createDataFrame([(100.0, 110.0), (200.0, 180.0)], "Actual double, Predicted double")
    row = df.agg(*M.accuracy_aggregates(decimals=2)).first()
    assert (row["WAPE_Pct"], row["MAE"], row["MBE"]) == (10.0, 15.0, -5.0)
    empty = df.where("Actual > 1000").agg(*M.accuracy_aggregates(decimals=2)).first()
    assert empty["WAPE_Pct"] == 0.0 and empty["Sample_Count"] == 0
