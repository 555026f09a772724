"""Months picked up as they land."""

import datetime
import os

import pytest
from pyspark.sql import functions as F

from demandweave import schemas as S
from demandweave.functions.guards import ContractError
from demandweave.operators import routing as R
from demandweave.plans import monthly
from demandweave.streaming import arrivals


def _land(spark, root, month, table, rows):
    """Lines as (INVNO, MDCODE, BATCH, QTY), invoices as (INVNO, INVDT)."""
    if table == "INVDET":
        df = spark.createDataFrame(rows, "INVNO string, MDCODE string, BATCH string, QTY double")
        missing = [c for c in S.FACT_SALES_LINE if c not in df.columns and c != "SOURCE_MONTH"]
        df = df.withColumns({c: F.lit(None).cast("int" if c == "CANCEL_ID" else "string") for c in missing})
    else:
        df = spark.createDataFrame(rows, "INVNO string, INVDT date").withColumn("CANCEL_ID", F.lit(0))
    df.coalesce(1).write.mode("append").parquet(f"{root}/{month}/{table}")


def _demand(spark, store):
    return sorted((r["MDCODE"], r["INVDT"].isoformat(), r["Demand_Qty"]) for r in monthly.arrived_demand(spark, store).collect())


def _files(store):
    return {os.path.join(d, f) for d, _, names in os.walk(f"{store}/demand") for f in names if f.endswith(".parquet")}


@pytest.fixture
def folders(tmp_path):
    os.makedirs(tmp_path / "landed")
    return str(tmp_path / "landed"), str(tmp_path / "store")


def test_months_follow_what_lands(spark, folders):
    root, store = folders
    assert monthly.pick_up_demand(spark, root, store) == []
    jan, feb = datetime.date(2020, 1, 30), datetime.date(2020, 2, 2)
    _land(spark, root, "JAN-20", "INVDET", [("1", "a", "x", 2.0), ("1", "a", "y", 3.0), ("1", "a", "x", 2.0)])
    _land(spark, root, "JAN-20", "INVOICE", [("1", jan), ("1", jan)])
    _land(spark, root, "DEC-19", "INVDET", [("9", "b", "x", 1.0)])
    # a month without its invoices waits
    assert monthly.pick_up_demand(spark, root, store) == ["JAN-20"]
    assert _demand(spark, store) == [("a", "2020-01-30", 5.0)]
    before = _files(store)
    # an invoice of February's folder that is dated in January joins January's day
    _land(spark, root, "FEB-20", "INVDET", [("2", "a", "x", 4.0), ("3", "a", "x", 7.0)])
    _land(spark, root, "FEB-20", "INVOICE", [("2", feb), ("3", jan)])
    _land(spark, root, "DEC-19", "INVOICE", [("9", datetime.date(2019, 12, 31))])
    assert monthly.pick_up_demand(spark, root, store) == ["DEC-19", "FEB-20"]
    assert before < _files(store)  # January's partition was not written again
    want = [("a", "2020-01-30", 12.0), ("a", "2020-02-02", 4.0), ("b", "2019-12-31", 1.0)]
    assert _demand(spark, store) == want
    # a later file of a month brings the whole month anew, once
    _land(spark, root, "JAN-20", "INVDET", [("1", "a", "z", 10.0)])
    assert monthly.pick_up_demand(spark, root, store) == ["JAN-20"]
    assert _demand(spark, store)[0] == ("a", "2020-01-30", 22.0)
    kept = _files(store)
    assert monthly.pick_up_demand(spark, root, store) == [] and _files(store) == kept
    runs = {(r["month"], r["run"]) for r in arrivals.applied(spark, store).collect()}
    assert runs == {("JAN-20", 1), ("DEC-19", 2), ("FEB-20", 2), ("JAN-20", 3)}


def test_a_failed_run_is_done_again(spark, folders):
    root, store = folders
    _land(spark, root, "JAN-20", "INVDET", [("1", "a", "x", 2.0)])
    _land(spark, root, "JAN-20", "INVOICE", [("1", datetime.date(2020, 1, 5))])

    def fails(months):
        monthly.refresh_demand(spark, root, store, months)
        raise RuntimeError("lost after the write")

    with pytest.raises(RuntimeError):
        arrivals.catch_up(spark, root, store, fails)
    assert arrivals.pending(spark, store).count() == 2 and not arrivals.applied(spark, store).count()
    assert monthly.pick_up_demand(spark, root, store) == ["JAN-20"]
    assert _demand(spark, store) == [("a", "2020-01-05", 2.0)]


def test_a_month_without_rows_keeps_no_partition(spark, tmp_path):
    path = str(tmp_path / "parts")
    df = spark.createDataFrame([("a", "JAN-20"), ("b", "FEB-20"), ("c", "MAR-20")], "v string, SOURCE_MONTH string")
    arrivals.replace_months(df, path, ["JAN-20", "FEB-20", "MAR-20"])
    arrivals.replace_months(df.where("v <> 'b'"), path, ["JAN-20", "FEB-20"])
    left = {(r["v"], r["SOURCE_MONTH"]) for r in spark.read.parquet(path).collect()}
    assert left == {("a", "JAN-20"), ("c", "MAR-20")}
    assert not os.path.exists(f"{path}/SOURCE_MONTH=FEB-20")


def test_arrivals_to_alerts(spark, folders):
    root, store = folders
    start = datetime.date(2019, 1, 1)
    days = [start + datetime.timedelta(3 * i) for i in range(120)]
    for month in ("JAN-19", "FEB-19"):
        part = days[:100] if month == "JAN-19" else days[100:]
        _land(spark, root, month, "INVDET", [(str(d.toordinal()), "item0", "x", 4.0) for d in part])
        _land(spark, root, month, "INVOICE", [(str(d.toordinal()), d) for d in part])
    shape = "Medicine_ID string, Validation_Advantage_Pct double, Selected_Model string, Threshold double"
    broken = spark.createDataFrame([("item0", 50.0, R.BASELINE, 30.0)], shape)  # against its own rule
    with pytest.raises(ContractError):
        monthly.run_arrivals(spark, root, broken, store, "r0")
    routing = spark.createDataFrame([("item0", 10.0, R.BASELINE, 30.0)], shape)
    done = monthly.run_arrivals(spark, root, routing, store, "r1")
    assert done["published"] and done["months"] == ["JAN-19", "FEB-19"]
    assert monthly.run_arrivals(spark, root, routing, store, "r2") is None
