import datetime as dt

import pytest
from pyspark.sql import functions as F

from demandweave import schemas as S
from demandweave.functions.guards import ContractError
from demandweave.operators import joins as J
from demandweave.operators import quality as Q
from demandweave.operators import silver
from demandweave.operators import warehouse as W

D = dt.date


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_calendar_edges(spark):
    cal = {r["full_date"]: r for r in W.build_dim_date(spark, "2018-01-01", "2026-05-31").collect()}
    assert len(cal) == 3073 and list(next(iter(cal.values())).asDict()) == S.DIM_DATE
    a, b = cal[D(2023, 3, 31)], cal[D(2023, 4, 1)]
    assert (a["financial_year"], a["financial_month"]) == ("FY 2022-23", 12)
    assert (b["financial_year"], b["financial_month"]) == ("FY 2023-24", 1)
    assert a["is_month_end"] and a["is_quarter_end"] and not a["is_year_end"] and b["is_month_start"]
    assert cal[D(2019, 12, 31)]["is_year_end"] and cal[D(2019, 12, 31)]["week"] == 1
    assert cal[D(2020, 2, 29)]["month_year"] == "Feb-2020" and cal[D(2020, 2, 29)]["is_weekend"]
    with pytest.raises(ValueError):
        W.build_dim_date(spark, "2020-01-02", "2020-01-01")


def test_latest_snapshot_by_time_or_text(spark):
    src = spark.createDataFrame(
        [("1", "old", "APR-18"), ("1", "new", "JAN-19"), ("1", "mid", "SEP-18"), ("2", "x", "JAN-18")],
        "SCODE string, SNAME string, SOURCE_MONTH string")
    assert sorted(rows(W.build_dim_salesperson(src).select("SCODE", "SNAME"))) == [("1", "new"), ("2", "x")]
    assert ("1", "mid") in rows(W.build_dim_salesperson(src, "lexical").select("SCODE", "SNAME"))


def test_fact_keeps_one_row_per_key_and_demands_columns(spark):
    cols = S.FACT_PURCHASE_HEADER
    base = dict.fromkeys(cols, None)
    data = [{**base, "PINVNO": "1", "SOURCE_MONTH": "JAN-20", "CALVAL": v} for v in (3.0, 1.0, 2.0)]
    data.append({**base, "PINVNO": "1", "SOURCE_MONTH": "FEB-20", "CALVAL": 9.0})
    src = spark.createDataFrame([tuple(r[c] for c in cols) for r in data], ", ".join(
        f"{c} {'double' if c == 'CALVAL' else 'string'}" for c in cols))
    fact = W.build_fact_purchase_header(src)
    assert sorted(rows(fact.select("SOURCE_MONTH", "CALVAL"))) == [("FEB-20", 9.0), ("JAN-20", 1.0)]
    with pytest.raises(KeyError):
        W.build_fact_purchase_header(src.drop("TRADT"))


def test_hot_key_dedupe_sends_few_rows(spark):
    src = spark.range(20000).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"), F.col("id").alias("v"))
    out = W.first_per_key(src, ["k"], [F.col("v")])
    plan = out._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan
    assert out.where("k = 0").first()["v"] == 0


def test_merge_dimension(spark):
    fact = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "k string, x int")
    dim = spark.createDataFrame([("a", 7, "p"), ("c", 8, "q")], "kk string, x int, y string")
    out = J.merge_dimension(fact, dim, "k", "kk")
    assert out.columns == ["k", "x", "y"]
    assert sorted(rows(out), key=str) == [("a", 1, "p"), ("b", 2, None), (None, 3, None)]
    dup = dim.union(dim)
    with pytest.raises(ContractError):
        J.merge_dimension_composite(fact, dup, ["k"], ["kk"])
    nulls = spark.createDataFrame([(None, "n")], "kk string, y string")
    assert J.merge_dimension(fact, nulls, "k", "kk", null_safe=True).where("y = 'n'").count() == 1


def test_salted_join_equals_plain_join(spark):
    fact = spark.range(6000).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise((F.col("id") % 50).cast("string")).alias("k"),
        F.col("id").alias("x"))
    fact = fact.union(spark.sql("select cast(null as string), -1L"))
    dim = spark.range(40).select(F.col("id").cast("string").alias("k"), F.col("id").alias("y")).union(
        spark.sql("select 'hot', 99L"))
    for how in ("left", "inner"):
        assert sorted(rows(J.salted_join(fact, dim, "k", how, salts=8)), key=str) == sorted(
            rows(fact.join(dim, "k", how)), key=str)


def test_duplicate_report_counts_all_members(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (None, "d"), (None, "e")], "k int, v string")
    r = Q.duplicate_report(df, "T", ["k"]).first()
    assert (r["total_rows"], r["duplicate_rows"], r["duplicate_percent"], r["status"]) == (
        5, 4, 80.0, "WARNING")
    assert rows(Q.duplicate_samples(df, ["k"], 3)) == [(None, "d"), (None, "e"), (1, "a")]
    assert Q.duplicate_report(df, "T", ["zz"]).first()["status"] == "FAILED"
    assert Q.duplicate_report(df, "T", ["v"]).first()["status"] == "PASSED"


def test_orphans_include_null_keys(spark):
    child = spark.createDataFrame([("a",), ("a",), ("x",), (None,)], "k string")
    parent = spark.createDataFrame([("a",), ("b",), (None,)], "k string")
    r = Q.orphan_report(child, parent, "c", "C", "P", "k", "k").first()
    assert (r["child_rows"], r["orphan_rows"], r["orphan_percent"], r["status"]) == (4, 2, 50.0, "WARNING")
    assert rows(Q.orphan_samples(child, parent, "k", "k")) == [(None,), ("x",)]
    assert Q.orphan_report(child, parent, "c", "C", "P", "zz", "k").first()["status"] == "FAILED"


def test_profile(spark):
    df = spark.createDataFrame([(1.0, "a"), (2.0, "a"), (4.0, None), (None, "b")], "n double, t string")
    p = {r["column"]: r for r in Q.profile_dataframe(df, "T").collect()}
    n, t = p["n"], p["t"]
    assert (n["null_count"], n["unique_count"], n["min"], n["max"], n["median"]) == (1, 3, 1.0, 4.0, 2.0)
    assert n["mean"] == pytest.approx(7 / 3)
    assert (t["null_percent"], t["min"], t["is_constant"]) == (25.0, None, False)
    assert [(v["value"], v["n"]) for v in t["top_values"]] == [("a", 2), (None, 1), ("b", 1)]


def test_schema_and_type_reports(spark):
    s, types = Q.landed_schemas([
        ("T", "APR-19", spark.createDataFrame([], "a int, b string, d int").schema),
        ("T", "JAN-19", spark.createDataFrame([], "a double, b string").schema),
        ("T", "FEB-19", spark.createDataFrame([], "b string, a double").schema)], spark)
    months = spark.createDataFrame([(m,) for m in ("JAN-19", "FEB-19", "APR-19", "MAY-19")], "month string")
    r = {x["month"]: x for x in Q.schema_report(s, months, ["T"]).collect()}
    assert r["JAN-19"]["matches_reference"] and r["APR-19"]["reference_month"] == "JAN-19"
    assert r["APR-19"]["extra_columns"] == ["d"] and not r["FEB-19"]["matches_reference"]
    assert r["FEB-19"]["missing_columns"] == [] and r["MAY-19"]["error"] == "File not found"
    bad = Q.datatype_report(types).collect()
    assert [(x["column"], x["dtypes_found"]) for x in bad] == [("a", ["double", "int"])]


def test_silver_features(spark):
    sales = spark.createDataFrame(
        [("1", 10.0, 100.0, 80.0, 9999.0, 12000.0, "2001-07-31"), ("2", 10.5, 1000.5, 0.0, 10000.0, 9000.0, None)],
        "INVNO string, QTY double, RATE double, PRATE double, NET_AMT double, TOT_AMT double, EXP string")
    a, b = silver.sales_features(sales, "2001-08-01").orderBy("INVNO").collect()
    assert (a["Sales_Size"], a["Price_Category"], a["High_Value_Order_Flag"], a["Profit_Percentage"],
            a["Expired_Medicine_Sold"]) == ("SMALL", "LOW", False, 25.0, True)
    assert (b["Sales_Size"], b["Price_Category"], b["High_Value_Order_Flag"], b["Profit_Percentage"],
            b["Expired_Medicine_Sold"]) == ("MEDIUM", "PREMIUM", True, None, False)
    inv = spark.createDataFrame([(0.0, 2.0, D(2001, 8, 1)), (10.0, 2.0, D(2001, 8, 31)), (11.0, 2.0, D(2003, 1, 1))],
                                "SOH double, PRATE double, EXP date")
    got = [(r["Stock_Status"], r["Reorder_Flag"], r["Expiry_Bucket"]) for r in
           silver.inventory_features(inv, "2001-08-01").orderBy("SOH").collect()]
    assert got == [("Out Of Stock", True, "Expired"), ("Low Stock", True, "0-30 Days"),
                   ("In Stock", False, ">365 Days")]
    sup = spark.createDataFrame([("1", " n ", None, "r", "a ", "", None, "d", " ")],
                                "SUPNO string, SUPNAME string, SUPCODE string, RNAME string, RADD1 string, "
                                "RADD2 string, RADD3 string, RADD4 string, RPHON string")
    r = silver.build_supplier(sup).first()
    assert (r["Supplier_Display"], r["Has_Contact"], r["Supplier_Address"]) == (
        "UNKNOWN - N", False, "a, UNKNOWN, d")


def test_sales_clean_filters_and_flags(spark):
    df = spark.createDataFrame([("1", 1.0, 5.0, 1), ("1", 1.0, 5.0, 1), ("2", 0.0, 5.0, None), ("3", 2.0, None, None)],
                               "INVNO string, QTY double, NET_AMT double, CANCEL_ID int")
    assert silver.sales_clean(df).count() == 1
    assert silver.sales_clean(df, drop_cancelled=True).count() == 0
