"""Lines are moved and read no more often than the work needs; bitmaps are dealt by their real size."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from demandweave.catalog import all_queries
from demandweave.catalog import etl as E
from demandweave.functions.guards import ContractError
from demandweave.operators import distinct_sets as DS
from demandweave.operators import joins as J
from demandweave.sources import tables


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_the_dedupe_of_lines_moves_no_line_again(spark, sf, no_broadcast):
    # lines to their part, then to their order: two sides each, and nothing for the dedupe
    assert plan(E.fact_line(spark, sf)).count("Exchange hashpartitioning") == 4
    assert plan(E.warehouse.build_fact_purchase_line(E.V.purchase(spark, sf))).count("Exchange hashpartitioning") == 4


@pytest.mark.parametrize("name", ["history_strict", "conservation_breaks", "salted_product_join"])
def test_lines_read_twice_are_written_once(spark, sf, name):
    files = all_queries()[name](spark, sf).inputFiles()
    assert any("/cut-" in f for f in files)
    if name != "salted_product_join":  # its products come from the lines too
        assert not any("lineitem" in f for f in files)


def test_salted_join_counts_the_fact_once(spark, monkeypatch):
    kept = []
    monkeypatch.setattr(J, "stored", lambda df, hint: kept.append(df.collect()) or df)
    fact = spark.createDataFrame([("a", i) for i in range(8)] + [("b", 9), (None, 10)], "k string, v int")
    dim = spark.createDataFrame([("a", "A"), ("b", "B")], "k string, name string")
    out = J.salted_join(fact, dim, "k", salts=4, hot_share=0.5)
    assert sorted(map(tuple, kept[0]), key=str) == [("a", 8), ("b", 1), (None, 1)] and len(kept) == 1
    assert sorted((r["v"], r["name"]) for r in out.collect() if r["name"]) == [(i, "A") for i in range(8)] + [(9, "B")]


def sparse(spark):
    """Ids of 40 days far apart, so that each bitmap holds one of them."""
    return spark.createDataFrame([(dt.date(2020, 1, 1) + dt.timedelta(d), d * 100_000 + i * 32_768)
                                  for d in range(40) for i in range(5)] * 2, "day date, number long")


def test_ids_meet_before_they_become_bitmaps(spark):
    text = plan(DS.day_sets(sparse(spark), ["day"], "number", "Number"))
    below = text[:text.index("partial_bitmap_construct_agg")]
    assert "Exchange" not in below


def test_sparse_bitmaps_are_dealt_by_their_real_size(spark, monkeypatch):
    sets = DS.day_sets(sparse(spark), ["day"], "number", "Number")
    monkeypatch.setattr(DS, "TASK_SETS", 25)
    month = DS.roll_up(sets, {"m": F.month("day")})
    assert month.rdd.getNumPartitions() == 8
    assert {r["m"]: r["Number"] for r in DS.set_sizes(month, ["m"], ["Number"]).collect()} == {1: 155, 2: 45}
    kept = DS.overlap_sizes(month, "m", 1, "Number").collect()
    assert {r["m"]: (r["size"], r["kept"]) for r in kept} == {1: (155, 0), 2: (45, 0)}


@pytest.mark.parametrize("name", ["sales_silver", "purchase_silver"])
def test_rows_are_told_apart_without_the_calendar(spark, sf, name):
    keys = [x for x in plan(all_queries()[name](spark, sf)).split("\n") if "Aggregate(keys=[" in x and "QTY" in x]
    assert keys and not any("day_name" in x for x in keys)


@pytest.mark.parametrize("numbers", [["1", "1", "2"], ["1", " 1 ", "2"]])
def test_enriched_sales_from_clean_and_unclean_keys(spark, sf, numbers):
    line = spark.createDataFrame(
        [(n, "m1", "b", 3.0, "5", "JAN-20", i // 2 * 1.0) for i, n in enumerate(numbers)] + [("9", None, None, 1.0, "5", "JAN-20", 0.0)] * 2,
        "INVNO string, MDCODE string, BATCH string, QTY double, TCODE string, SOURCE_MONTH string, PRATE double").withColumns(
        {"RATE": F.lit(2.0), "EXP": F.lit("2020-05-01").cast("date")})
    invoice = spark.createDataFrame(
        [(n, dt.date(2020, 1, 2), "s", 9.0, 8.0, "JAN-20") for n in dict.fromkeys(numbers)] + [("9", None, "t", 9.0, 8.0, "JAN-20")],
        "INVNO string, INVDT date, SCODE string, TOT_AMT double, NET_AMT double, SOURCE_MONTH string")
    person = spark.createDataFrame([("s", "Sam", "JAN-20")], "SCODE string, SNAME string, SOURCE_MONTH string")
    product = spark.createDataFrame([("m1", "One", "JAN-20"), ("m1", "One", "FEB-20")], "MDCODE string, MDNAME string, SOURCE_MONTH string")
    dates = E.warehouse.build_dim_date(spark, "2020-01-01", "2020-01-03")
    got = E.silver.build_sales(line, invoice, person, product, dates, "2020-06-01")
    want = E.silver.sales_features(E.silver.sales_clean(E.silver.sales_join(line, invoice, person, product, dates)), "2020-06-01")
    assert got.columns == want.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_a_new_table_is_written_once(spark, monkeypatch):
    kept = []
    monkeypatch.setattr(tables, "stored", lambda df, hint: kept.append(hint) or df)
    df = spark.range(20).withColumn("k", F.col("id") % 3)
    assert tables.upload_dataframe(df, "new_once", bucket_by=(2, ["k"])) == 20 and not kept
    with pytest.raises(ContractError):
        tables.upload_dataframe(df.limit(0), "new_empty")
    assert not tables.table_exists(spark, "new_empty")
