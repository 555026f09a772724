"""Lines that are stored by their number are dealt once, where they meet their order."""

import pytest

from demandweave.catalog import landed
from demandweave.catalog import views as V
from demandweave.functions.guards import ContractError
from demandweave.session import scratch_schema
from demandweave.sources import tables

KEYS = ["INVNO", "SOURCE_MONTH"]
SHAPE = "INVNO string, SOURCE_MONTH string, v long"


def rows(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("partitions", ["4", "24"])
def test_lines_are_not_dealt_again_to_be_stored(spark, sf, partitions, monkeypatch):
    dealt = []
    upload = tables.upload_dataframe

    def seen(df, name, schema, bucket_by, **options):
        plan = df.repartition(bucket_by[0], *bucket_by[1]).groupBy("INVNO").count()._jdf.queryExecution().executedPlan().toString()
        dealt.append((name, plan.count(f"hashpartitioning(INVNO#") + plan.count("hashpartitioning(INVNO, ")))
        return upload(df, name, schema, bucket_by=bucket_by, **options)

    monkeypatch.setattr(tables, "upload_dataframe", seen)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        found = landed.colocated_sales_lines(spark, sf)
        assert found.count() == V.invdet(spark, sf).select("INVNO", "MDCODE", "BATCH", "SOURCE_MONTH").distinct().count()
        # lines and orders for their join; before, the lines once more
        assert dealt == [("invdet", 2), ("invoice", 1)]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("by", [None, ["INVNO"]])
def test_keys_are_stripped_whatever_the_buckets(spark, by):
    odd = spark.createDataFrame([(" 1", "JAN-20", 1), ("1", " JAN-20", 2), ("2", "FEB-20 ", 3)], SHAPE)
    kept = tables.store_colocated({"odd": odd}, KEYS, 4, scratch_schema(spark, "odd"), by=by)
    assert sorted(map(tuple, kept["odd"].collect())) == [("1", "JAN-20", 1), ("1", "JAN-20", 2), ("2", "FEB-20", 3)]


@pytest.mark.parametrize("by", [None, ["INVNO"]])
@pytest.mark.parametrize("row", [("1", None, 1), (None, "JAN-20", 1)])
def test_rows_without_a_key_are_refused(spark, by, row):
    schema = scratch_schema(spark, "none")
    with pytest.raises(ContractError, match="has nulls"):
        tables.store_colocated({"none": spark.createDataFrame([row, ("2", "JAN-20", 2)], SHAPE)}, KEYS, 4, schema, by=by)
    assert not tables.table_exists(spark, "none", schema)
    tables.store_colocated({"there": spark.createDataFrame([("2", "JAN-20", 2)], SHAPE)}, KEYS, 4, schema, by=by)
    with pytest.raises(ContractError, match="has nulls"):
        tables.store_colocated({"there": spark.createDataFrame([row], SHAPE)}, KEYS, 4, schema, by=by)
    assert tables.read_table(spark, "there", schema).count() == 1  # a table that is there is not touched
