import math

import duckdb
import pytest

import __spark_entry__ as entry

# one per family; scripts/check_oracles.py runs all of them
FAMILIES = ["dim_product_latest", "fact_sales_line", "dup_report", "orphan_report", "monthly_sales",
            "order_kpis", "iqr_outliers", "series_quality_supplier", "demand_profile", "fc_daily_models",
            "bt_daily", "bt_monthly", "comparison", "rule_grid", "forecast_service", "fc_summary", "alerts"]


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in ("customer", "supplier", "part", "orders", "lineitem", "events", "documents"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def test_every_query_has_an_oracle():
    own = {name for name in entry.queries() if name != "pipeline" and not name.startswith("op")}
    assert own <= set(entry.oracle_sql()) and len(own) > 120


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.count() == 10 and df.columns[0] == "Medicine_ID"


@pytest.mark.parametrize("name", FAMILIES)
def test_against_sql(spark, duck, sf, name):
    df = entry.queries()[name](spark, sf)
    cols = sorted(df.columns)
    rel = duck.execute(entry.oracle_sql()[name])
    order = [[d[0] for d in rel.description].index(c) for c in cols]
    plain = lambda v: "nan" if isinstance(v, float) and math.isnan(v) else v
    ours = sorted(repr([plain(r[c]) for c in cols]) for r in df.collect())
    theirs = sorted(repr([plain(r[i]) for i in order]) for r in rel.fetchall())
    assert ours == theirs and ours
