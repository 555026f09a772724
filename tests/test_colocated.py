"""Tables bucketed alike: joins and dedupes without a shuffle of their rows."""

import datetime

import pytest

from demandweave.catalog import landed
from demandweave.catalog import views as V
from demandweave.functions.guards import ContractError
from demandweave.operators import series, warehouse
from demandweave.session import scratch_schema
from demandweave.sources import tables


def _plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]


def test_only_the_sums_are_shuffled(spark, sf):
    kept = landed.colocated(spark, sf)
    plan = _plan(series.colocated_demand(kept["invdet"], kept["invoice"]))
    assert plan.count("Exchange hashpartitioning") == 1 and "BroadcastExchange" not in plan
    assert "SortMergeJoin" in plan and "Bucketed: true" in plan
    assert "Exchange" not in _plan(landed.colocated_sales_lines(spark, sf))


def test_equals_the_shuffled_way(spark, sf):
    kept = landed.colocated(spark, sf)
    heads = V.invoice_header(spark, sf).select("INVNO", "SOURCE_MONTH", "INVDT", "CANCEL_ID")
    lines = warehouse.build_fact_sales_line(V.invdet(spark, sf))
    want = series.prepare_demand(lines, heads)
    got = series.colocated_demand(kept["invdet"], kept["invoice"])
    assert got.columns == want.columns and got.count() > 1000
    assert not got.exceptAll(want).count() and not want.exceptAll(got).count()


def test_keys_are_stripped_and_must_be_there(spark):
    rows = [(" 1", "JAN-20", datetime.date(2020, 1, 2)), ("2 ", "JAN-20", datetime.date(2020, 1, 3))]
    shape = "INVNO string, SOURCE_MONTH string, INVDT date"
    schema = scratch_schema(spark, "stripped")
    kept = tables.store_colocated({"heads": spark.createDataFrame(rows, shape)}, ["INVNO", "SOURCE_MONTH"], 4, schema)
    assert sorted(r["INVNO"] for r in kept["heads"].collect()) == ["1", "2"]
    none = spark.createDataFrame([(None, "JAN-20", None)], shape)
    with pytest.raises(ContractError):
        tables.store_colocated({"other": none}, ["INVNO", "SOURCE_MONTH"], 4, schema)


def test_buckets_grow_with_the_table():
    assert tables.buckets_for(0, 300) == 8
    assert tables.buckets_for(10**9, 300) == 1024
    assert tables.buckets_for(300 * 10**9, 300) == 1 << 18
