"""Merged smoothing states against states computed from the whole history."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from demandweave.operators import forecast, smoothing

COLUMNS = ["n", "k", "f", "z", "occ", "interval", "last_value", "newest_age", "sum_qty", "cutoff"]


def series(spark, seed, items=12, days=200):
    rng, start = random.Random(seed), datetime.date(2001, 1, 15)
    rows = []
    for i in range(items):
        share, begin = rng.choice([0.02, 0.1, 0.5, 1.0]), rng.randrange(120)
        for d in range(begin, days):
            if rng.random() < share or d == begin:
                rows.append((f"m{i}", start + datetime.timedelta(d), rng.choice([0.0, 1.0, 2.5, 7.0, -1.0])))
    rows += [("never", start, 0.0), ("once", start, 4.0), ("late", start + datetime.timedelta(150), 3.0)]
    return spark.createDataFrame(rows, "MDCODE string, INVDT date, Demand_Qty double")


def by_item(state):
    out = {}
    for r in state.collect():
        tail = [round(x, 9) for x in r["tail"]]
        out[r["MDCODE"]] = [None if r[c] is None else r[c] if c == "cutoff" else round(float(r[c]), 9) for c in COLUMNS] + [tail]
    return out


def whole(daily):
    return by_item(forecast.smoothing_state(forecast.history_rows(daily)))


@pytest.mark.parametrize("seed", [1, 2])
def test_states_of_months_merge_to_the_state_of_all(spark, seed):
    daily = series(spark, seed)
    months = smoothing.segment_states(daily.withColumn("month", F.trunc("INVDT", "month")), ["month"])
    assert by_item(smoothing.model_state(smoothing.combine_all(months, "month"))) == whole(daily)
    assert by_item(smoothing.model_state(smoothing.segment_states(daily))) == whole(daily)


def test_any_grouping_gives_the_same_state(spark):
    daily = series(spark, 3)
    cuts = ["2001-02-20", "2001-05-05"]
    parts = [daily.where(F.col("INVDT") < cuts[0]), daily.where(F.col("INVDT").between(cuts[0], cuts[1])), daily.where(F.col("INVDT") > cuts[1])]
    a, b, c = (smoothing.segment_states(p) for p in parts)
    left = smoothing.combine(smoothing.combine(a, b), c)
    right = smoothing.combine(a, smoothing.combine(b, c))
    assert by_item(smoothing.model_state(left)) == by_item(smoothing.model_state(right)) == whole(daily)
    nothing = smoothing.segment_states(daily.limit(0))
    assert by_item(smoothing.model_state(smoothing.combine(nothing, a))) == by_item(smoothing.model_state(a))
    assert by_item(smoothing.model_state(smoothing.combine(a, nothing))) == by_item(smoothing.model_state(a))


def test_quiet_days_are_added_as_rows_without_demand(spark):
    daily, day = series(spark, 4), F.lit("2001-09-30").cast("date")
    ended = daily.unionByName(daily.select("MDCODE").distinct().select("MDCODE", day.alias("INVDT"), F.lit(0.0).alias("Demand_Qty")))
    states = smoothing.as_of(smoothing.segment_states(daily), day)
    assert by_item(smoothing.model_state(states)) == whole(ended)


def test_store_reads_one_month_and_may_be_repeated(spark, tmp_path):
    daily = series(spark, 5)
    months = [str(r[0]) for r in daily.select(F.trunc("INVDT", "month")).distinct().orderBy(F.trunc("INVDT", "month")).collect()]
    store = smoothing.StateStore(spark, str(tmp_path / "states"))
    assert store.months() == []
    store.load(daily.where(F.col("INVDT") < months[-2]))
    for month in months[-2:]:
        for _ in range(2):
            states = store.add_month(month, daily)
    assert by_item(smoothing.model_state(states)) == whole(daily)
    assert store.months() == months[-3:] and store.months("segments") == months
    # the next month reads its own segment and the states before it, no history
    read = {f.split("/upto/")[-1].split("/segments/")[-1].rpartition("/")[0] for f in store.extended(months[-1]).inputFiles()}
    assert read == {f"month={months[-2]}", f"month={months[-1]}"}
    # a correction of an old month reaches the states through the segments
    fixed = daily.where(~((F.col("MDCODE") == "m1") & (F.trunc("INVDT", "month") == months[1])))
    store.add_month(months[1], fixed)
    assert by_item(smoothing.model_state(store.rebuild(months[-1]))) == whole(fixed)


def test_forecasts_from_states_are_those_from_the_series(spark):
    daily = series(spark, 6)
    rows = lambda df: sorted((r["Medicine_ID"], r["h"], r["Model"], round(r["Predicted"], 9)) for r in df.collect())
    assert rows(smoothing.forecast_states(smoothing.segment_states(daily), 9)) == rows(forecast.forecast_daily(daily, horizon=9))
