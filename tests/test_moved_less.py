"""Lines that land are made and written once; daily demand carries no columns of other grains."""

import datetime

import pytest
from pyspark.sql import functions as F

from demandweave.catalog import demand as D
from demandweave.catalog import landed as L
from demandweave.catalog.registry import QUERIES


@pytest.fixture
def own_tables(spark, tmp_path):
    """Four orders of 1996 to 1999, number 3 of the corrected year lands late; a line of order 1 is there twice."""
    day = lambda y: datetime.date(y, 3, 5)
    orders = [(k, 7, day(y), "1-URGENT", 10.0, "O") for k, y in ((1, 1996), (2, 1997), (3, 1997), (4, 1999))]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderdate date, o_orderpriority string, "
                          "o_totalprice double, o_orderstatus string").write.parquet(f"{tmp_path}/orders.parquet")
    lines = [(1, 5, 9, 1, 2.0), (1, 5, 9, 1, 2.0), (2, 5, 9, 1, 3.0), (3, 6, 8, 1, 4.0), (4, 6, 8, 1, 5.0), (4, 5, 9, 2, 1.0)]
    spark.createDataFrame(
        [(o, p, s, n, q, q * 10, 0.0, 0.02, "N", day(1998)) for o, p, s, n, q in lines],
        "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, "
        "l_discount double, l_tax double, l_returnflag string, l_shipdate date").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(5, 1.0, "Brand#1", "TIN"), (6, 2.0, "Brand#2", "STEEL")],
                          "p_partkey long, p_retailprice double, p_brand string, p_type string").write.parquet(f"{tmp_path}/part.parquet")
    return str(tmp_path)


def test_arriving_lines_are_made_once(spark, own_tables, monkeypatch):
    made = []
    view = L.V.invdet
    monkeypatch.setattr(L.V, "invdet", lambda *a: made.append(1) or view(*a))
    rows = {(r["y"], r["items"], r["Demand_Qty"], r["run"], r["later_months"]) for r in QUERIES["arrived_months"](spark, own_tables).collect()}
    assert rows == {(1996, 1, 2.0, 1, 0), (1997, 2, 7.0, 2, 0), (1999, 2, 6.0, 2, 0)}
    assert len(made) == 1


def test_staged_files_are_moved_and_an_empty_year_lands(spark, own_tables, tmp_path):
    root = str(tmp_path / "landing")
    early = F.col("INVNO") != "3"
    staged = L.stage_lines(spark, own_tables, early)
    L.land_lines(spark, staged, root, [1997, 1998], [True])
    count = lambda y: spark.read.parquet(f"{root}/JAN-{y}/INVDET").count()
    assert (count(97), count(98)) == (1, 0)
    L.land_lines(spark, staged, root, [1997], [False])
    assert count(97) == 2
    left = spark.read.parquet(staged["INVDET"][0]).select("__year").distinct().collect()
    assert {r[0] for r in left} == {1996, 1999}


def test_daily_demand_reads_the_columns_of_its_grain(spark, own_tables):
    plan = lambda grain: D.daily(spark, own_tables, grain)._jdf.queryExecution().executedPlan().toString()
    assert "p_type" not in plan("sup") and "p_brand" not in plan("sup")
    assert "p_brand" in plan("brand") and "p_type" not in plan("brand")
    assert {(r["MDCODE"], r["Demand_Qty"]) for r in D.daily(spark, own_tables, "sup").collect()} == {
        ("9", 2.0), ("9", 3.0), ("8", 4.0), ("8", 5.0), ("9", 1.0)}
