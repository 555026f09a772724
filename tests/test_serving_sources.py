import datetime as dt
import os
import struct

import pytest
from pyspark.sql import functions as F

from demandweave.functions.guards import ContractError, require_no_violations
from demandweave.operators import forecast as FC
from demandweave.operators import quality as Q
from demandweave.operators import routing as R
from demandweave.operators import serving as SV
from demandweave.plans import etl, monthly
from demandweave.sources import landing, publish, tables

D = dt.date


def flat(spark, item, value, days=30, lo=0.7, hi=1.3, step=0.0):
    return spark.createDataFrame(
        [(item, D(2025, 6, 1) + dt.timedelta(days=i), value + step * i, (value + step * i) * lo,
          value + step * i, (value + step * i) * hi) for i in range(days)],
        "Medicine_ID string, Forecast_Date date, Predicted_Demand double, P10 double, P50 double, P90 double")


def test_stockout_alert(spark):
    inv = spark.createDataFrame([("101", 50.0)], "Medicine_ID string, Stock_On_Hand double")
    a = SV.scan_alerts(flat(spark, "101", 10.0), inventory=inv).collect()
    assert [(x["id"], x["severity"], x["alert_type"], x["metric_value"]) for x in a] == [
        ("ALT-0001", "CRITICAL", "STOCKOUT_RISK", 250.0)]


def test_spike_and_uncertainty_alerts(spark):
    history = spark.createDataFrame([("202", D(2025, 1, 1) + dt.timedelta(days=i), 10.0) for i in range(90)],
                                    "MDCODE string, INVDT date, Demand_Qty double")
    f = flat(spark, "202", 50.0).union(flat(spark, "303", 5.0, lo=0.0, hi=3.0))
    a = SV.scan_alerts(f, history).orderBy("id").collect()
    assert [(x["id"], x["Medicine_ID"], x["alert_type"], x["metric_value"]) for x in a] == [
        ("ALT-0001", "202", "DEMAND_SPIKE", 400.0), ("ALT-0002", "303", "HIGH_UNCERTAINTY", 450.0)]
    s = SV.alert_summary(SV.scan_alerts(f, history)).first()
    assert tuple(s) == (2, 0, 1, 1)
    bare = SV.scan_alerts(f.drop("P10", "P50", "P90"), history)
    assert bare.count() == 1


def test_summary_trend_and_tools(spark):
    f = flat(spark, "42", 10.0, step=0.5).union(flat(spark, "7", 3.0))
    s = {r["Medicine_ID"]: r for r in SV.forecast_summary(f).collect()}
    assert s["42"]["trend"] == "increasing" and s["7"]["trend"] == "stable"
    assert s["42"]["total_predicted_demand"] == pytest.approx(30 * 10 + 0.5 * 435)
    assert [r["Medicine_ID"] for r in SV.top_demand(f, 1).collect()] == ["42"]
    assert [r["Medicine_ID"] for r in SV.by_trend(f, "flat").collect()] == ["7"]
    assert [r["Medicine_ID"] for r in SV.compare(f, ["7", "nope", "42"]).collect()] == ["7", "42"]
    assert SV.most_uncertain(f, 5).first()["relative_uncertainty_pct"] == 60.0
    one = SV.forecast_summary(flat(spark, "1", 4.0, days=1)).first()
    assert (one["trend"], one["first_half_avg"], one["second_half_avg"]) == ("stable", 4.0, 4.0)
    step = flat(spark, "s", 5.0, days=15).union(flat(spark, "s", 10.0, days=15).withColumn(
        "Forecast_Date", F.date_add("Forecast_Date", 15)))
    assert SV.forecast_summary(step).first()["trend_pct_change"] == 100.0
    assert SV.run_tool(f, "get_trend", medicine_id="42").first()["trend"] == "increasing"
    assert "error" in SV.run_tool(f, "get_summary", medicine_id="none").columns
    assert "error" in SV.run_tool(f, "drop_table").columns
    assert SV.run_tool(f, "compare_medicines", medicine_ids=["7"]).count() == 1
    assert len(SV.run_tool(f, "get_forecast", medicine_id="7").first()["days"]) == 30


def test_nested_fallbacks(spark):
    f = flat(spark, "1", 10.0, days=2).withColumn(
        "P90", F.when(F.col("Forecast_Date") == "2025-06-01", F.col("P90")))
    d = SV.nested_forecast(f).first()["days"]
    assert d[0]["quantiles"]["p30"] == 7.0 and d[0]["quantiles"]["p70"] == 10.0
    assert set(d[1]["quantiles"].asDict().values()) == {10.0}


def history(spark, spec):
    rows = [(i, D(2020, 1, 1) + dt.timedelta(days=k), float(v)) for i, y in spec.items()
            for k, v in enumerate(y) if v or k in (0, len(y) - 1)]
    return spark.createDataFrame(rows, "MDCODE string, INVDT date, Demand_Qty double")


ROUTING = "Medicine_ID string, Validation_Advantage_Pct double, Selected_Model string, Threshold double"


def test_routed_batch_and_contracts(spark):
    h = history(spark, {"a": [2, 0, 3] * 100, "b": [0, 5] * 50, "new": [1] * 20, "tiny": [1]})
    routing = spark.createDataFrame([("a", 50.0, R.CHALLENGER, 30.0), ("b", 10.0, R.BASELINE, 30.0),
                                     ("gone", 80.0, R.CHALLENGER, 30.0)], ROUTING)
    for form, expect in (("service", {"a", "b", "new"}), ("router", {"a", "b"})):
        out, failed = SV.forecast_batch(h, routing, form)
        got = {r["Medicine_ID"]: r["Selected_Model"] for r in out.select("Medicine_ID", "Selected_Model").distinct().collect()}
        assert set(got) == expect and got["a"] == R.CHALLENGER and got["b"] == R.BASELINE
        assert out.groupBy("Medicine_ID").count().where("count <> 30").count() == 0
        lost = {r["Medicine_ID"] for r in failed.collect()}
        assert lost == ({"tiny"} if form == "service" else {"gone"})
        full = out if form == "router" else out.withColumns(
            {c: F.lit(None).cast("double") for c in FC.S.QUANTILE_COLUMNS if c not in out.columns})
        require_no_violations(Q.check_forecast(full, [R.CHALLENGER, R.BASELINE], [R.CHALLENGER], form=form))
        if form == "router":
            assert len(out.columns) == 21
            assert out.where("Medicine_ID = 'b' and P10 <> Predicted_Demand").count() == 0
        else:
            assert out.columns[:4] == ["Medicine_ID", "Forecast_Date", "Predicted_Demand", "Selected_Model"]
            assert out.where("Medicine_ID = 'b' and P50 is not null").count() == 0
    one, _ = SV.forecast_one(h, routing, "b")
    assert one.select("Medicine_ID").distinct().count() == 1
    with_slot, _ = SV.forecast_batch(h, routing, model=FC.last_week_mean)
    assert with_slot.where("Medicine_ID = 'a'").count() == 30


def test_contract_catches_bad_rows(spark):
    f = flat(spark, "1", 10.0, days=29).withColumns(
        {"Selected_Model": F.lit("other"), **{c: F.lit(1.0) for c in FC.S.QUANTILE_COLUMNS}})
    r = Q.check_forecast(f, ["m"], ["m"], form="router").first()
    assert r["wrong_horizon"] == 1 and r["unknown_model"] == 29 and r["median_off_point"] == 29


def test_publish_gate(spark, tmp_path):
    root = str(tmp_path / "store")
    assert publish.latest_forecast(spark, root) is None
    ids = spark.createDataFrame([("a",), ("b",)], "Medicine_ID string")
    none = spark.createDataFrame([], "Medicine_ID string, reason string")
    f = flat(spark, "a", 1.0).withColumn("Model_ID", F.lit("tsb"))
    m = publish.write_run(f, ids, none, root, "r1")
    assert m["published"] and m["medicines_failed"] == 1
    latest = publish.latest_forecast(spark, root)
    assert latest.count() == 30 and latest.first()["Prediction_Length"] == 30
    assert latest.first()["Selected_Model"] == "tsb"
    three = ids.union(spark.createDataFrame([("c",)], "Medicine_ID string"))
    m = publish.write_run(flat(spark, "a", 9.0), three, none, root, "r2")
    assert not m["published"]
    assert publish.latest_forecast(spark, root).agg(F.max("Predicted_Demand")).first()[0] == 1.0
    lost = spark.read.parquet(f"{root}/runs/run_id=r2/failed")
    assert {r[0] for r in lost.select("Medicine_ID").collect()} == {"b", "c"}


def test_tables_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "x"), (2, None)], "k int, v string")
    tables.save_parquet(df, str(tmp_path / "p"))
    tables.save_csv(df, str(tmp_path / "c"))
    assert tables.load_parquet(spark, str(tmp_path / "p")).count() == 2
    assert tables.load_csv(spark, str(tmp_path / "c"), "k int, v string").where("k = 1").first()["v"] == "x"
    assert tables.run_database(spark, {"t1": df}, "wh") == {"t1": 2}
    assert tables.run_database(spark, {"t1": df}, "wh", "append") == {"t1": 2}
    assert tables.read_multiple_tables(spark, ["t1"], "wh")["t1"].count() == 4
    assert tables.table_exists(spark, "t1", "wh") and not tables.table_exists(spark, "t2", "wh")
    with pytest.raises(ValueError):
        tables.upload_dataframe(df, "t1", "wh", "merge")
    with pytest.raises(ContractError):
        tables.upload_dataframe(df.where("k > 9"), "t3", "wh")
    with pytest.raises(ContractError):
        tables.verify_upload(spark, 3, "t1", "wh")


def binary_file(path, fields, records):
    """fields: (name, type, width); records: (deleted, [text])"""
    head = 32 + 32 * len(fields) + 1
    size = 1 + sum(w for _, _, w in fields)
    raw = bytes([3, 20, 1, 1]) + struct.pack("<IHH", len(records), head, size) + bytes(20)
    for n, k, w in fields:
        raw += n.encode().ljust(11, b"\0") + k.encode() + bytes(4) + bytes([w, 0]) + bytes(14)
    raw += b"\r"
    for deleted, row in records:
        raw += (b"*" if deleted else b" ") + b"".join(
            v.encode("latin-1").ljust(w) for v, (_, _, w) in zip(row, fields))
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(raw + b"\x1a")


def test_binary_landing(spark, tmp_path):
    root = str(tmp_path / "landing")
    f = [("SCODE", "C", 4), ("AMT", "N", 8), ("DAY", "D", 8), ("OK", "L", 1)]
    binary_file(f"{root}/JAN-18/SFILE.DAT", f, [(False, ["a", "1.50", "20180102", "T"]), (True, ["x", "9", "", ""])])
    binary_file(f"{root}/APR-18/SFILE.DAT", f[:2], [(False, ["b", "bad"]), (False, ["é", ""])])
    got = sorted((tuple(r) for r in landing.read_binary_table(spark, root, "SFILE", range_bytes=1).collect()), key=str)
    assert got == sorted([("a", 1.5, D(2018, 1, 2), True, "JAN-18"), ("b", None, None, None, "APR-18"),
                          ("é", None, None, None, "APR-18")], key=str)
    one = landing.read_month(spark, root, "APR-18", ["SFILE"], "binary")["SFILE"]
    assert one.columns == ["SCODE", "AMT", "SOURCE_MONTH"] and one.count() == 2
    with pytest.raises(FileNotFoundError):
        landing.read_month(spark, root, "APR-18", ["TFILE"], "binary")
    os.makedirs(f"{root}/MAY-18")
    wired = Q.run_all_validations(
        {}, landing.file_listing(spark, root), landing.landed_columns(spark, root, ["SFILE"], "binary"),
        [landing.file_name("SFILE", "binary")], landing.months(spark, root))
    assert sorted((r["month"], r["exists"]) for r in wired["files"].collect()) == [
        ("APR-18", True), ("JAN-18", True), ("MAY-18", False)]
    assert {r["month"]: r["missing_columns"] for r in wired["schemas"].where("table = 'SFILE'").collect()} == {"JAN-18": [], "APR-18": ["DAY", "OK"]}
    grid = {(r["month"], r["file"]): r for r in Q.file_report(
        landing.file_listing(spark, root), ["SFILE.DAT", "TFILE.DAT"]).collect()}
    assert len(grid) == 4 and grid[("JAN-18", "SFILE.DAT")]["exists"]
    assert not grid[("APR-18", "TFILE.DAT")]["exists"]
    out = landing.run_extract(spark, root, ["SFILE"], "binary")
    assert out["SFILE"].count() == 3
    with pytest.raises(FileNotFoundError):
        landing.run_extract(spark, root, ["TFILE"], "binary")


def test_months_that_differ(spark, tmp_path):
    root = str(tmp_path / "differ")
    f = [("SCODE", "C", 4), ("AMT", "N", 8)]
    binary_file(f"{root}/JAN-19/SFILE.DAT", [*f, ("GRADE", "C", 2)], [(False, ["c", "3", "g"])])
    binary_file(f"{root}/APR-18/SFILE.DAT", f, [(False, [f"k{i}", str(i)]) for i in range(100)])
    binary_file(f"{root}/JAN-18/SFILE.DAT", [f[1], ("DAY", "N", 8)], [(False, ["1", "5"])])
    binary_file(f"{root}/FEB-18/SFILE.DAT", [("DAY", "D", 8)], [(False, ["20180201"]), (False, ["20189999"])])
    df = landing.run_extract(spark, root, ["SFILE"], "binary", range_bytes=64)["SFILE"]
    assert df.dtypes == [("AMT", "double"), ("DAY", "string"), ("SCODE", "string"), ("GRADE", "string"), ("SOURCE_MONTH", "string")]
    assert df.count() == 104 and df.agg(F.sum("AMT")).first()[0] == 1 + 3 + sum(range(100))
    assert {tuple(r) for r in df.where("GRADE is not null or SOURCE_MONTH = 'FEB-18'").select("GRADE", "DAY").collect()} == {
        ("g", None), (None, "20180201"), (None, "20189999")}
    for fmt in ("csv", "parquet"):
        for m, row in (("JAN-18", "1 as A, 'x' as B"), ("FEB-18", "'y' as B, 2 as A, 9 as C"), ("MAR-18", "'t' as A")):
            spark.sql(f"select {row}").write.option("header", True).format(fmt).save(f"{root}/{fmt}/{m}/T.{fmt}")
            spark.sql("select 'other' as A").write.option("header", True).format(fmt).save(f"{root}/{fmt}/{m}/TOTAL.{fmt}")
        t = landing.read_table(spark, f"{root}/{fmt}", "T", fmt)
        assert sorted(map(str, ([r[c] for c in ("A", "B", "C", "SOURCE_MONTH")] for r in t.collect()))) == [
            "['1', 'x', None, 'JAN-18']", "['2', 'y', 9, 'FEB-18']", "['t', None, None, 'MAR-18']"]


def test_landing_to_silver_and_monthly_cycle(spark, sf, tmp_path):
    from demandweave.catalog import views as V
    root = str(tmp_path / "months")
    for name, view in V.LANDED.items():
        df = view(spark, sf).where("SOURCE_MONTH in ('JAN-00', 'FEB-00', 'MAR-00')")
        for m in ("JAN-00", "FEB-00", "MAR-00"):
            df.where(F.col("SOURCE_MONTH") == m).drop("SOURCE_MONTH").coalesce(1).write.parquet(
                f"{root}/{m}/{name}")
    t = landing.read_all_months(spark, root)
    assert {r[0] for r in t["INVOICE"].select("SOURCE_MONTH").distinct().collect()} == {"JAN-00", "FEB-00", "MAR-00"}
    one = landing.read_month(spark, root, "FEB-00")
    assert one["INVOICE"].count() == t["INVOICE"].where("SOURCE_MONTH = 'FEB-00'").count()
    written = etl.load_warehouse(spark, root, "wh2", start="2000-01-01", end="2000-12-31",
                                 report_path=str(tmp_path / "reports"))
    assert len(written) == 10 and written["dim_date"] == 366
    assert spark.read.parquet(str(tmp_path / "reports/orphans")).count() == 7
    assert spark.read.parquet(str(tmp_path / "reports/files")).where("not exists").count() == 0
    assert spark.read.parquet(str(tmp_path / "reports/schemas")).where("not matches_reference").count() == 0
    assert os.path.isdir(tmp_path / "reports/duplicate_samples/INVDET") and os.path.isdir(tmp_path / "reports/datatypes")
    built = etl.run_silver(spark, str(tmp_path / "silver"), "wh2", "2001-08-01")
    assert set(built) == {"medicine", "supplier", "inventory", "purchase", "sales"}
    assert spark.read.parquet(str(tmp_path / "silver/sales")).count() > 0


def test_monthly_cycle(spark, sf, tmp_path):
    from demandweave.catalog import demand as DM
    from demandweave.catalog import etl as E
    line = E.fact_line(spark, sf).withColumn("MDCODE", F.col("KIND"))
    heads = DM.invoice_heads(spark, sf)
    daily = DM.daily(spark, sf, "kind")
    study = monthly.study_routing(daily, DM.MONTH_VALIDATION, DM.MONTH_HOLDOUT)
    root = str(tmp_path / "store")
    first = monthly.monthly_cycle(spark, line, heads, study["routing"], root, "m1")
    assert first["published"] and first["medicines_requested"] == daily.select("MDCODE").distinct().count()
    second = monthly.monthly_cycle(spark, line, heads, study["routing"], root, "m2")
    assert second["published"] and publish.latest_forecast(spark, root).count() == 30 * second["medicines_succeeded"]
    # the first forecast starts after the last sale, so nothing overlaps: one overall row of zeros
    ev = publish.load_documents(spark, f"{root}/evaluations", "Is_Overall boolean, Sample_Count bigint").collect()
    assert [(r["Is_Overall"], r["Sample_Count"]) for r in ev] == [(True, 0)]
    assert publish.load_documents(spark, f"{root}/nothing", "id string").count() == 0


@pytest.mark.parametrize("form", ["service", "router"])
def test_one_state_serves_both_models(spark, form):
    import datetime

    from demandweave.operators import forecast as FC
    from demandweave.operators import routing as R
    from demandweave.operators import serving
    from demandweave.operators.series import prepare_history

    start = datetime.date(2020, 1, 1)
    rows = [(f"i{i}", start + datetime.timedelta((i + 3) * d), float(d % (i + 2))) for i in range(6) for d in range(80)]
    rows += [("short", start, 1.0), ("short", start + datetime.timedelta(1), 2.0)]
    history = spark.createDataFrame(rows, "Medicine_ID string, Date date, Actual double").withColumnsRenamed(
        {"Date": "INVDT", "Actual": "Demand_Qty"})
    routing = spark.createDataFrame([("i0", 50.0), ("i1", 5.0), ("i2", 30.0), ("short", 90.0), ("gone", 90.0)],
                                    "Medicine_ID string, Validation_Advantage_Pct double")
    out, failed = serving.forecast_batch(history, routing, form, horizon=4, context=100)
    got = {(r["Medicine_ID"], r["Forecast_Date"]): r for r in out.collect()}
    kept = ["i0", "i1", "i2"] + (["i3", "i4", "i5"] if form == "service" else [])
    assert {k[0] for k in got} == set(kept) and len(got) == 4 * len(kept)
    series = prepare_history(history, "strict" if form == "service" else "lenient")
    point = FC.forecast_tsb(series, 4, variant="router" if form == "router" else "daily", min_observations=3)
    for r in point.collect():
        key = (r["Medicine_ID"], r["Forecast_Date"])
        if key in got and got[key]["Selected_Model"] == R.BASELINE:
            assert got[key]["Predicted_Demand"] == r["Predicted_Demand"]
            assert got[key]["P90"] == (r["Predicted_Demand"] if form == "router" else None)
    for r in FC.monotone_quantiles(FC.native_quantile_forecast(series, 4, 100)).collect():
        key = (r["Medicine_ID"], r["Forecast_Date"])
        if key in got and got[key]["Selected_Model"] == R.CHALLENGER:
            assert (got[key]["P10"], got[key]["P90"]) == (r["P10"], r["P90"])
            assert got[key]["Predicted_Demand"] == got[key]["P50"] == round(r["P50"], 2)
            assert got[key]["Context_Length_Used"] == r["Context_Length_Used"]
    models = {k[0]: r["Selected_Model"] for k, r in got.items()}
    assert models["i0"] == models["i2"] == R.CHALLENGER and models["i1"] == R.BASELINE
    missing = {r["Medicine_ID"] for r in failed.collect()}
    assert missing == ({"short"} if form == "service" else {"short", "gone"})
