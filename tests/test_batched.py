"""Models called for many items at once, against the slot that calls them one by one."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from demandweave.operators import batched as B
from demandweave.operators import forecast as FC
from demandweave.operators import routing as R
from demandweave.operators import serving as SV

D = dt.date
LEVELS = FC.S.QUANTILE_LEVELS


def history(spark, spec):
    rows = [(i, D(2020, 1, 1) + dt.timedelta(days=k), float(v)) for i, y in spec.items()
            for k, v in enumerate(y) if v or k in (0, len(y) - 1)]
    return spark.createDataFrame(rows, "MDCODE string, INVDT date, Demand_Qty double")


def test_isolation_costs_few_calls():
    calls, bad = [], {3, 77}

    def call(batch):
        calls.append(len(batch.items))
        if bad & set(batch.items):
            raise RuntimeError(f"bad {sorted(bad & set(batch.items))}")
        return [i * 10 for i in batch.items]

    n = 128
    out = B.isolate(call, B.Batch(list(range(n)), [None] * n, np.zeros(n)))
    assert [o for o in out if not isinstance(o, Exception)] == [i * 10 for i in range(n) if i not in bad]
    assert [str(out[i]) for i in sorted(bad)] == ["bad [3]", "bad [77]"]
    assert len(calls) <= 2 * 2 * 7 + 1
    calls.clear()
    bad.clear()
    B.isolate(call, B.Batch(list(range(n)), [None] * n, np.zeros(n)))
    assert calls == [n]
    short = B.isolate(lambda b: [1], B.Batch(["a", "b"], [None] * 2, np.zeros(2)))
    assert short == [1, 1]  # the wrong number of results for two is right for one


@pytest.mark.parametrize("batch_items", [1, 3, 256])
def test_equals_the_slot_of_single_items(spark, batch_items):
    rng = np.random.default_rng(5)
    spec = {f"i{k}": rng.poisson(0.4, n).tolist() for k, n in enumerate([800, 730, 731, 60, 31, 30, 5, 1, 200])}
    h = history(spark, spec)
    one = FC.quantile_slot(h, FC.last_week_mean)
    many = B.batched_quantile_slot(h, B.last_week_means, batch_items=batch_items, tasks=2)
    columns = [c for c in one.columns if c != "error"]
    rows = lambda df: sorted(map(repr, (tuple(r) for r in df.select(*columns, F.col("error").isNull().alias("fine")).collect())))
    assert rows(many) == rows(one)
    assert many.where("Order_Repaired").count() == 0


def test_contexts_are_dense_and_summed(spark):
    day = D(2020, 1, 1)
    df = spark.createDataFrame([("a", day, 1.0), ("a", day, 2.0), ("a", D(2020, 1, 4), None), ("b", day, 7.0)],
                               "MDCODE string, INVDT date, Demand_Qty double")
    packed = B.pack_contexts(df, 10).orderBy("MDCODE").toArrow().to_batches()[0]
    sizes, starts, values = B.dense(packed, 10)
    assert sizes.tolist() == [4, 1] and values.tolist() == [3.0, 0, 0, 0, 7.0]
    sizes, starts, values = B.dense(packed.slice(1, 1), 10)
    assert sizes.tolist() == [1] and values.tolist() == [7.0]
    assert B.pack_contexts(df.limit(0), 10).count() == 0
    assert B.batched_quantile_slot(df.limit(0), B.last_week_means).count() == 0


def test_faults_of_raw_output():
    days = np.datetime64("2020-01-01") + np.arange(3)
    good = np.ones((3, 2))
    assert B.output_fault(days, good, 3, 2) is None
    assert B.output_fault(days, good[:, ::-1], 3, 2) is None
    assert "expected (3, 2)" in B.output_fault(days[:2], good, 3, 2)
    assert "expected (3, 2)" in B.output_fault(days, good[:2], 3, 2)
    assert "not sorted" in B.output_fault(days[[1, 0, 2]], good, 3, 2)
    assert "twice" in B.output_fault(days[[0, 0, 1]], good, 3, 2)
    assert "twice" in B.output_fault(days[[0, 1, 0]], good, 3, 2)
    assert "invalid" in B.output_fault(np.array(["NaT"] * 3, "datetime64[D]"), good, 3, 2)
    assert "negative" in B.output_fault(days, good - 2, 3, 2)
    assert "finite" in B.output_fault(days, good * np.inf, 3, 2)


def test_faulty_items_take_no_other_with_them(spark):
    spec = {k: [1] * 40 for k in ("fails", "negative", "shape", "unsorted", "falling", "dates", "fine")} | {"short": [1, 1]}

    def load():
        def model(batch, horizon, levels):
            if "fails" in batch.items:
                raise RuntimeError("no")
            flat = np.ones((horizon, len(levels)))
            own = {"negative": -flat, "shape": flat[:5], "falling": flat * np.arange(len(levels), 0, -1),
                   "unsorted": ((batch.last_days[0] + np.arange(horizon))[::-1], flat), "dates": (np.arange(horizon), "x")}
            return [own.get(i, flat) for i in batch.items]

        return model

    out = B.batched_quantile_slot(history(spark, spec), load, factory=True, tasks=1)
    good, failed = FC.split_failures(out)
    reasons = {r["Medicine_ID"]: r["error"] for r in failed.collect()}
    assert set(reasons) == {"fails", "negative", "shape", "unsorted", "short", "dates"}
    assert reasons["fails"] == "no" and "negative" in reasons["negative"] and "minimum is" in reasons["short"]
    rows = {r["Medicine_ID"]: r for r in good.collect()}
    assert set(rows) == {"fine", "falling"} and good.count() == 60
    assert rows["falling"]["Order_Repaired"] and rows["falling"]["P90"] == rows["falling"]["P10"] == len(LEVELS)
    assert not rows["fine"]["Order_Repaired"]


def test_calls_are_counted_and_the_routed_batch_takes_it(spark):
    h = history(spark, {f"m{i}": [1, 0, 2] * 20 for i in range(40)} | {"new": [1] * 20})
    seen = spark.sparkContext.accumulator(0)

    def model(batch, horizon, levels):
        seen.add(1)
        if "m3" in batch.items:
            raise RuntimeError("no such item")
        return np.ones((len(batch.items), horizon, len(levels)))

    B.batched_quantile_slot(h, model, tasks=1, batch_items=16).collect()
    assert 3 <= seen.value <= 3 + 2 * 4 + 1  # three batches, one of them halved down to its bad item
    routing = spark.createDataFrame([(f"m{i}", 50.0, R.CHALLENGER, 30.0) for i in range(40)],
                                    "Medicine_ID string, Validation_Advantage_Pct double, Selected_Model string, Threshold double")
    out, failed = SV.forecast_batch(h, routing, model=model, slot=B.batched_quantile_slot)
    assert {tuple(r) for r in failed.collect()} == {("m3", "no such item")}
    assert out.select("Medicine_ID").distinct().count() == 40
