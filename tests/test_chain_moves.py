"""The warehouse chain: order lines are made once, and what meets by number is stored by it."""

import datetime as dt

import pytest

from demandweave.catalog import all_queries
from demandweave.catalog import views as V
from demandweave.operators import silver, warehouse
from demandweave.session import scratch_schema
from demandweave.sources import tables


def rows(df):
    return sorted(map(str, df.collect()))


@pytest.fixture
def own_tables(spark, tmp_path):
    """A line twice, lines without an order, a part or any key, a part and an order twice, a part without a price."""
    day = lambda y: dt.date(y, 3, 5)
    orders = [(1, 7, day(1996)), (2, 7, day(1997)), (2, 7, day(1998)), (3, 8, None), (None, 8, day(1997))]
    spark.createDataFrame([(k, c, "O", 10.0, d, "1-URGENT") for k, c, d in orders],
                          "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate date, "
                          "o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    lines = [(1, 5, 9, 1), (1, 5, 9, 1), (2, 6, 9, 1), (2, 4, 8, 2), (3, 5, None, 1), (9, 5, 9, 1), (None, 5, 9, 1), (1, None, 8, 2), (1, 3, 9, 3)]
    spark.createDataFrame(
        [(o, p, s, n, 2.0, 20.0, 0.0, 0.02 * n, "R" if n == 2 else "N", day(1999)) for o, p, s, n in lines],
        "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, "
        "l_discount double, l_tax double, l_returnflag string, l_shipdate date").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(5, "a", "B", "TIN", 11, 1.0), (6, "b", "B", "TIN", 30, 2.0), (6, "c", "B", "TIN", 3, 3.0), (3, "d", "B", "TIN", 3, None)],
                          "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double"
                          ).write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame([(9, "S9", 1, 5.0), (8, "S8", 2, -1.0)], "s_suppkey long, s_name string, s_nationkey int, s_acctbal double"
                          ).write.parquet(f"{tmp_path}/supplier.parquet")
    return str(tmp_path)


def test_landed_tables_of_stored_lines_are_the_same(spark, own_tables):
    stored = tables.store_by(V.order_lines(spark, own_tables), "order_lines", scratch_schema(spark, "own"), "number")
    plain, kept = V.landed_tables(spark, own_tables), V.landed_tables(spark, own_tables, stored)
    assert plain.keys() == kept.keys()
    for name, df in plain.items():
        want = df.drop("BRAND", "KIND") if name == "INVDET" else df
        assert kept[name].columns == want.columns and rows(kept[name]) == rows(want), name
    assert kept["INVDET"].count() == 8


def test_the_chain_makes_lines_once(spark, sf, monkeypatch):
    def again(*_):
        raise AssertionError("lines are made again")

    monkeypatch.setattr(V, "lines", again)
    monkeypatch.setattr(V, "priced_lines", again)
    made = []
    view = V.order_lines
    monkeypatch.setattr(V, "order_lines", lambda *a: made.append(1) or view(*a))
    assert all_queries()["warehouse_chain"](spark, sf).count() == 15 and len(made) == 1


def test_stored_by_number_meets_where_it_lies(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        schema = scratch_schema(spark, "met")
        df = spark.createDataFrame([(str(i % 5), "JAN-20", i) for i in range(50)] + [(None, None, 1)], "INVNO string, SOURCE_MONTH string, v long")
        a, b = tables.store_by(df, "a", schema, "INVNO"), tables.store_by(df, "b", schema, "INVNO")
        assert rows(a) == rows(df)
        met = warehouse.first_per_key(a, ["INVNO", "SOURCE_MONTH"], [a["v"]]).join(b.select("INVNO"), "INVNO").groupBy("INVNO", "v").count()
        assert "Exchange" not in met._jdf.queryExecution().executedPlan().toString()
        assert tables.store_by(df.limit(0), "none", schema, "INVNO").count() == 0
        # rows that a grouping has dealt are written without being dealt again
        log = spark.sql(f"EXPLAIN SELECT /*+ REPARTITION(4, INVNO) */ INVNO, count(*) FROM {schema}.a GROUP BY INVNO").first()[0]
        assert "Exchange" not in log
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("named", [False, True])
def test_inventory_told_apart_by_number(spark, named):
    day = dt.date(2020, 1, 2)
    line = [("1", "M1", " b", 3.0), ("1", "M1", "b", 3.0), ("2", "M2", None, None), ("2", "M2", None, 0.0), (None, None, "b", 1.0), ("3", "M1", "b", 3.0)]
    line = spark.createDataFrame([(n, m, b, s, 1.0, 2.0, day, *([" x"] if named else [])) for n, m, b, s in line],
                                 "PINVNO string, MDCODE string, BAT string, SOH double, PRATE double, MRP double, EXP date"
                                 + (", SUPCODE string" if named else ""))
    product = spark.createDataFrame([("M1", "one ", None), ("M1", "One", "unknown"), ("M1", "One", "z"), ("M3", "x", "y")],
                                    "MDCODE string, MDNAME string, SUPCODE string")
    dates = warehouse.build_dim_date(spark, "2020-01-01", "2020-01-05")
    want = silver.build_inventory(line, product, dates, "2020-06-01")
    got = silver.build_inventory(line, product, dates, "2020-06-01", by_number=True)
    assert got.columns == want.columns and rows(got) == rows(want) and got.count() == (4 if named else 6)
