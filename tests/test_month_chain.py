"""One month from the landing folders to alerts."""

import os

from pyspark.sql import functions as F

from demandweave.catalog import views as V
from demandweave.operators import routing as R
from demandweave.plans import monthly
from demandweave.sources import publish

MONTHS = ["JAN-00", "FEB-00", "MAR-00", "APR-00", "MAY-00", "JUN-00", "JUL-00", "AUG-00", "SEP-00"]


def test_the_whole_month(spark, sf, tmp_path):
    landed, root = str(tmp_path / "landed"), str(tmp_path / "store")
    for name, view in V.LANDED.items():
        df = view(spark, sf).where(F.col("SOURCE_MONTH").isin(MONTHS))
        if name == "INVDET":  # one item with demand on most days
            df = df.withColumn("MDCODE", F.lit("item0"))
        df = df.persist()
        for m in MONTHS:
            df.where(F.col("SOURCE_MONTH") == m).drop("SOURCE_MONTH").coalesce(1).write.parquet(f"{landed}/{m}/{name}")
        df.unpersist()
    routing = spark.createDataFrame([("item0", 50.0, R.CHALLENGER, 30.0), ("item1", 10.0, R.BASELINE, 30.0)],
                                    "Medicine_ID string, Validation_Advantage_Pct double, Selected_Model string, Threshold double")
    done = monthly.run_month(spark, landed, routing, root, "2000-07", schema="chain", start="2000-01-01", end="2000-12-31",
                             as_of="2000-08-01")
    assert done["published"] and done["medicines_requested"] == 1
    assert done["warehouse_rows"]["dim_date"] == 366 and len(done["warehouse_rows"]) == 10
    assert set(done["enriched_tables"]) == {"medicine", "supplier", "inventory", "purchase", "sales"}
    rows = publish.latest_forecast(spark, root)
    assert rows.count() == 30 and rows.select("Medicine_ID").distinct().count() == 1
    assert os.path.isdir(f"{root}/reports/orphans") and os.path.isdir(f"{root}/alerts")
