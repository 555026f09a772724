"""Cases in which rows, reasons or columns used to get lost, or a key gathered in one task."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from demandweave.functions.guards import ContractError
from demandweave.functions.numbering import global_row_number
from demandweave.operators import joins as J
from demandweave.operators import quality as Q
from demandweave.operators import routing as R
from demandweave.operators import serving as SV
from demandweave.operators import warehouse as WH
from demandweave.plans import monthly
from demandweave.session import stored, work_folder
from demandweave.sources import publish, tables

D = dt.date
ROUTING = "Medicine_ID string, Validation_Advantage_Pct double, Selected_Model string, Threshold double"


def daily(spark, days, names=("MDCODE", "INVDT", "Demand_Qty")):
    rows = [(i, D(2020, 1, 1) + dt.timedelta(days=k), float(k % 3)) for i, n in days.items() for k in range(n)]
    return spark.createDataFrame(rows, f"{names[0]} string, {names[1]} date, {names[2]} double")


def routed(spark, *items):
    return spark.createDataFrame([(i, 50.0, R.CHALLENGER, 30.0) for i in items], ROUTING)


def test_model_runs_once_and_reasons_are_kept(spark, tmp_path):
    calls = spark.sparkContext.accumulator(0)

    def model(values, horizon, levels):
        import numpy as np

        calls.add(1)
        if len(values) == 40:
            raise RuntimeError("GPU lost")
        return np.ones((horizon, len(levels)))

    history = daily(spark, {"a": 50, "b": 40, "c": 30, "tiny": 1})
    forecast, failed = SV.forecast_batch(history, routed(spark, "a", "b", "c", "tiny"), model=model)
    m = publish.write_run(forecast, history.select(F.col("MDCODE").alias("Medicine_ID")), failed, str(tmp_path), "r1")
    assert calls.value == 3 and m["medicines_succeeded"] == 2 and m["published"]
    lost = {r["Medicine_ID"]: r["reason"] for r in spark.read.parquet(f"{tmp_path}/runs/run_id=r1/failed").collect()}
    assert lost == {"b": "GPU lost", "tiny": "1 days of history, minimum is 3"}


def test_pointers_are_added_not_replaced(spark, tmp_path):
    root = str(tmp_path)
    assert publish.latest_forecast(spark, root) is None
    for run, items in (("r1", ("a",)), ("r2", ("a", "b"))):
        history = daily(spark, dict.fromkeys(items, 50))
        forecast, failed = SV.forecast_batch(history, routed(spark, *items))
        publish.write_run(forecast, history.select(F.col("MDCODE").alias("Medicine_ID")), failed, root, run)
    assert len(list((tmp_path / "pointers").iterdir())) == 2
    assert publish.latest_forecast(spark, root).select("Medicine_ID").distinct().count() == 2


def test_monthly_forecast_takes_aliased_history(spark, tmp_path):
    history = daily(spark, {"a": 50, "b": 60}, ("item_id", "timestamp", "target"))
    m = monthly.run_monthly_forecast(spark, history, routed(spark, "a"), str(tmp_path), "r1")
    assert m["published"] and m["medicines_succeeded"] == 2


def test_stock_column_falls_back_to_quantity(spark):
    f = spark.createDataFrame([("1", D(2025, 6, d), 10.0) for d in range(1, 31)],
                              "Medicine_ID string, Forecast_Date date, Predicted_Demand double")
    inventory = spark.createDataFrame([("1", 50.0)], "MDCODE string, QTY double")
    assert SV.scan_alerts(f, inventory=inventory).first()["alert_type"] == "STOCKOUT_RISK"
    with pytest.raises(ContractError):
        SV.scan_alerts(f, inventory=inventory.drop("QTY"))


def test_nan_is_null_in_profiles(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (2.0,), (None,)], "n double")
    r = Q.profile_dataframe(df, "T").first()
    assert (r["null_count"], r["unique_count"], r["max"], r["mean"], r["median"]) == (2, 2, 2.0, 1.5, 1.5)


def test_validations_of_some_tables(spark):
    df = spark.createDataFrame([("x", "1")], "OTHER string, KEY string")
    reports = Q.run_all_validations({"OTHER": df})
    assert set(reports) == {"profile"}
    child = spark.createDataFrame([("1", "m"), ("2", "m"), (None, "n")], "INVNO string, MDCODE string")
    parent = spark.createDataFrame([("1",)], "INVNO string")
    three = Q.validate_orphans({"INVDET": child, "INVOICE": parent, "MEDIMAST": parent.limit(0).withColumnRenamed("INVNO", "MDCODE")})
    got = three.collect()  # an empty parent is not checked
    assert [(r["parent_table"], r["child_rows"], r["orphan_rows"], r["orphan_percent"]) for r in got] == [("INVOICE", 3, 2, 66.67)]


def test_dimensions_keep_their_contract(spark):
    source = spark.createDataFrame([("1", "a", "JAN-18")], "MDCODE string, MDNAME string, SOURCE_MONTH string")
    dim = WH.build_dim_product(source)
    assert dim.columns == WH.S.DIM_PRODUCT and dim.first()["SUPNO"] is None


def test_rows_without_key_are_spread(spark):
    fact = spark.createDataFrame([(None, i) for i in range(400)] + [("h", i) for i in range(400)] + [("c", 1)], "k string, v int")
    dim = spark.createDataFrame([("h", "hot"), ("c", "cold")], "k string, name string")
    salted = J.salted_join(fact, dim, "k", salts=8)
    plain = fact.join(dim, "k", "left").select("k", "v", "name")
    assert sorted(map(str, salted.select("k", "v", "name").collect())) == sorted(map(str, plain.collect()))
    plan = salted._jdf.queryExecution().optimizedPlan().toString()
    assert "isnull(k" in plan


def test_numbers_of_keys_that_share_a_prefix(spark):
    ids = [f"MED-{i:020d}" for i in range(5000)] + ["A", "é", ""]
    df = spark.createDataFrame([(k, r) for k in ids for r in (2, 1)], "k string, r int").repartition(4)
    got = [(x["k"], x["r"]) for x in global_row_number(df, "k", ["r"], "n").orderBy("n").collect()]
    assert got == [(k, r) for k in sorted(ids, key=str.encode) for r in (1, 2)]
    plan = global_row_number(df, "k", ["r"], "n").drop("n")
    assert plan.count() == len(got)


def test_upload_runs_its_plan_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    df = spark.range(100).mapInArrow(count, "id long")
    assert tables.upload_dataframe(df, "once") == 100 and seen.value == 100
    with pytest.raises(ContractError):
        tables.upload_dataframe(df.limit(0), "once")
    assert spark.table("once").count() == 100


def test_stored_tables_live_in_the_work_folder(spark):
    df = stored(spark.range(5).withColumn("x", F.lit("y")))
    folder = work_folder(spark).split(":", 1)[-1].lstrip("/")
    assert df.count() == 5 and all(folder in f for f in df.inputFiles())


def test_orphans_compare_keys_of_unlike_types(spark):
    child = spark.createDataFrame([(1,), (2,), (None,)], "k int")
    for kind in ("double", "bigint", "decimal(12,2)", "float"):
        parent = spark.createDataFrame([(1,), (3,)], "k int").select(F.col("k").cast(kind))
        report = Q.orphan_report(child, parent, "c", "child", "parent", "k", "k").first()
        assert (report["child_rows"], report["orphan_rows"]) == (3, 2)
        assert [r["k"] for r in Q.orphan_samples(child, parent, "k", "k").collect()] == [None, 2]


def test_absent_dimension_columns_have_the_contract_types(spark):
    source = spark.createDataFrame([("1", "JAN-01")], "TCODE string, SOURCE_MONTH string")
    types = dict(WH.build_dim_tax(source).dtypes)
    assert types["IGST"] == "double" and types["STATUS"] == "string"
    product = spark.createDataFrame([("1", "JAN-01")], "MDCODE string, SOURCE_MONTH string")
    assert dict(WH.build_dim_product(product).dtypes)["NEWDT"] == "date"
