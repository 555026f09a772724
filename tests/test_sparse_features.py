"""Features from observed days alone against the same features on the dense series."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from demandweave.operators import features, series

SCHEMA = "MDCODE string, INVDT date, Demand_Qty double"


@pytest.fixture(scope="module")
def observed(spark):
    draw, first = random.Random(7), datetime.date(2020, 2, 20)
    rows = [("one", first, 5.0), ("zero", first, 0.0), ("zero", first + datetime.timedelta(3), 0.0)]
    rows += [("daily", first + datetime.timedelta(d), float(draw.randrange(9))) for d in range(80)]
    rows += [("large", first + datetime.timedelta(d), 1e9 + draw.random()) for d in range(0, 90, 2)]
    for i in range(6):
        days = sorted(draw.sample(range(400), 60))
        rows += [(f"item{i}", first + datetime.timedelta(d), float(draw.randrange(-3, 40))) for d in days]
    return spark.createDataFrame(rows, SCHEMA)


def _by_key(df):
    return {(r["MDCODE"], r["INVDT"]): r.asDict() for r in df.collect()}


@pytest.mark.parametrize("dense, sparse", [
    (features.rolling_features, features.sparse_rolling_features),
    (features.lag_features, features.sparse_lag_features)])
def test_equals_the_dense_series(observed, dense, sparse):
    full = _by_key(dense(series.fill_calendar(observed, "MDCODE", "INVDT", "Demand_Qty")))
    got = _by_key(sparse(observed))
    assert len(got) == observed.count()
    for key, row in got.items():
        for name, value in row.items():
            want = full[key][name]
            if isinstance(want, float):
                # a deviation of nearly equal large values keeps the scale's last digits only
                scale = 1e9 if key[0] == "large" else 1.0
                assert value == pytest.approx(want, rel=1e-9, abs=1e-9 * scale), (key, name)
            else:
                assert value == want, (key, name)


def test_nothing_is_generated(observed):
    plan = features.sparse_rolling_features(observed)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and plan.count("Exchange hashpartitioning") == 1


def test_nulls_and_empty_tables(spark):
    rows = [("a", datetime.date(2020, 1, 1), None), ("a", datetime.date(2020, 1, 3), 4.0), ("a", None, 2.0)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r["INVDT"]: r for r in features.sparse_rolling_features(df).collect()}
    last = got[datetime.date(2020, 1, 3)]
    assert last["Rolling_Mean_7"] == 0 and last["Rolling_STD_7"] == 0 and last["Rolling_Max_7"] == 0
    assert got[None]["Rolling_Mean_7"] is None and got[None]["Rolling_Min_7"] is None
    lags = {r["INVDT"]: r for r in features.sparse_lag_features(df).collect()}
    assert lags[datetime.date(2020, 1, 3)]["Lag_1"] == 0 and lags[datetime.date(2020, 1, 3)]["Lag_3"] is None
    assert lags[None]["Lag_1"] is None
    none = df.where(F.lit(False))
    assert features.sparse_rolling_features(none).count() == features.sparse_lag_features(none).count() == 0
