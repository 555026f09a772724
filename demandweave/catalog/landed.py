"""Registered queries of the landing, report, catalog and publishing operators: tables derived from the driver's
are landed as yearly snapshots in the work folder and read back through the operators.

Snapshots before 1998 lack a column of the salesperson file and store another as a number, and the last one lacks
the tax file, so that unions, type clashes and the reports on them have something to show.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import cleaning as C
from ..functions.guards import require_no_nulls, require_not_empty, require_unique
from ..operators import joins, quality, series, warehouse
from ..plans import monthly
from ..session import remember, scratch_schema, work_folder
from ..sources import landing, publish, tables
from ..sources.fixedwidth import write_binary_table
from ..streaming import arrivals
from . import views as V
from .etl import LINE_EXTRA
from .registry import query
from .sqlbase import define

FILES = ["SFILE", "TFILE"]

define("yearly", """
SELECT DISTINCT 'JAN-' || strftime(o_orderdate, '%y') AS SOURCE_MONTH, year(o_orderdate) AS y,
  substr(o_orderpriority, 1, 1) AS SCODE, substr(o_orderpriority, 3) AS SNAME FROM orders""")
define("yearly_tax", """
SELECT DISTINCT 'JAN-' || strftime(day, '%y') AS SOURCE_MONTH, year(day) AS y,
  CAST(CAST(floor(l_tax * 100 + 0.5) AS INTEGER) AS VARCHAR) AS TCODE FROM lines""")


def land(spark, sf, fmt="parquet") -> str:
    """Write the snapshots and return their folder."""
    root = f"{work_folder(spark)}/landing-{uuid.uuid4().hex}"
    day = F.to_date("o_orderdate")
    people = V.table(spark, sf, "orders").select(
        F.date_format(day, "yy").alias("y"), F.substring("o_orderpriority", 1, 1).alias("SCODE"),
        F.expr("substring(o_orderpriority, 3)").alias("SNAME")).distinct()
    taxes = V.lines(spark, sf).select(F.date_format("day", "yy").alias("y"), V.tax_code().alias("TCODE")).distinct()
    years = sorted(r[0] for r in people.select("y").distinct().collect())  # one row per snapshot
    last = max(years, key=lambda y: (int(y) < 90, y))
    for y in years:
        old = int(y) in (95, 96, 97)
        own = people.where(F.col("y") == y).drop("y")
        own = own.drop("SNAME").withColumn("SCODE", F.col("SCODE").cast("int")) if old else own
        own.coalesce(1).write.option("header", True).format(fmt).save(f"{root}/JAN-{y}/{landing.file_name('SFILE', fmt)}")
        if y != last:
            taxes.where(F.col("y") == y).drop("y").coalesce(1).write.option("header", True).format(fmt).save(
                f"{root}/JAN-{y}/{landing.file_name('TFILE', fmt)}")
    return root


@query("landed_people", """
SELECT DISTINCT SCODE, CASE WHEN y >= 1998 THEN SNAME END AS SNAME, SOURCE_MONTH FROM yearly""")
def landed_people(spark, sf):
    return landing.read_table(spark, land(spark, sf), "SFILE")


@query("landed_extract", """
SELECT 'SFILE' AS "table", SOURCE_MONTH, count(DISTINCT SCODE) AS rows FROM yearly GROUP BY 2 UNION ALL
SELECT 'TFILE', SOURCE_MONTH, count(DISTINCT TCODE) FROM yearly_tax
WHERE y < (SELECT max(y) FROM yearly_tax) GROUP BY 2""")
def landed_extract(spark, sf):
    found = landing.run_extract(spark, land(spark, sf, "csv"), FILES, "csv")
    return quality.union_all([df.groupBy("SOURCE_MONTH").agg(F.count("*").alias("rows")).select(
        F.lit(t).alias("table"), "SOURCE_MONTH", "rows") for t, df in found.items()])


@query("landed_month", "SELECT SCODE, SNAME, SOURCE_MONTH FROM yearly WHERE y = 1999")
def landed_month(spark, sf):
    return landing.read_month(spark, land(spark, sf), "JAN-99", ["SFILE"])["SFILE"]


@query("landed_files", """
SELECT m.SOURCE_MONTH AS month, f.file, f.file = 'SFILE.parquet' OR y < (SELECT max(y) FROM yearly) AS "exists"
FROM (SELECT DISTINCT SOURCE_MONTH, y FROM yearly) m, (VALUES ('SFILE.parquet'), ('TFILE.parquet')) f(file)""")
def landed_files(spark, sf):
    root = land(spark, sf)
    report = quality.file_report(
        landing.file_listing(spark, root), [landing.file_name(t, "parquet") for t in FILES], landing.months(spark, root))
    return report.select("month", "file", "exists")


@query("landed_schemas", """
SELECT 'SFILE' AS "table", SOURCE_MONTH AS month, CASE WHEN y < 1998 THEN 1 ELSE 2 END AS column_count,
  y < 1998 AS matches_reference, 'JAN-95' AS reference_month, CASE WHEN y < 1998 THEN '' ELSE 'SNAME' END AS extra
FROM (SELECT DISTINCT SOURCE_MONTH, y FROM yearly) m""")
def landed_schemas(spark, sf):
    root = land(spark, sf)
    columns = landing.landed_columns(spark, root, ["SFILE"])
    report = quality.run_all_validations({}, columns=columns)["schemas"].where("table = 'SFILE'")
    return report.select("table", "month", "column_count", "matches_reference", "reference_month",
                         F.array_join("extra_columns", ",").alias("extra"))


@query("landed_datatypes", """
SELECT 'SFILE' AS "table", 'SCODE' AS "column", 2 AS dtype_count, 'int,string' AS dtypes,
  count(DISTINCT SOURCE_MONTH) AS months FROM yearly""")
def landed_datatypes(spark, sf):
    report = quality.datatype_report(landing.landed_columns(spark, land(spark, sf), ["SFILE"]))
    return report.select("table", "column", "dtype_count", F.array_join("dtypes_found", ",").alias("dtypes"),
                         F.size("months_affected").cast("bigint").alias("months"))


@query("landed_profile", """
SELECT 'SFILE' AS "table", 'SNAME' AS "column", count(*) AS total_rows, count(*) FILTER (WHERE y < 1998) AS null_count,
  count(DISTINCT SNAME) FILTER (WHERE y >= 1998) AS unique_count FROM yearly""")
def landed_profile(spark, sf):
    people = landing.read_table(spark, land(spark, sf), "SFILE")
    # codes of early snapshots have no name, and repeat for as many names as they had
    report = quality.profile_tables({"SFILE": people.select("SNAME")})
    return report.select("table", "column", "total_rows", "null_count", "unique_count")


LANDED_ORDERS = """
SELECT CAST(o_orderkey AS BIGINT) AS ORDERKEY, CAST(o_custkey AS BIGINT) AS CUSTOMER, CAST(o_orderdate AS DATE) AS ORDERDATE,
  o_totalprice AS PRICE, o_orderstatus = 'F' AS DONE, o_orderpriority AS PRIORITY,
  CASE WHEN year(o_orderdate) >= 1998 THEN o_orderkey % 7 END AS GRADE, 'JAN-' || strftime(o_orderdate, '%y') AS SOURCE_MONTH
FROM orders WHERE o_orderstatus <> 'P'"""


def land_orders(spark, sf) -> str:
    """All orders as fixed-width files, a folder per year. Early years lack a column; pending orders are there as
    deleted records."""
    root = f"{work_folder(spark)}/landing-{uuid.uuid4().hex}"
    remember(spark, root)
    day = F.to_date("o_orderdate")
    rows = V.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("ORDERKEY"), F.col("o_custkey").alias("CUSTOMER"), day.alias("ORDERDATE"),
        F.col("o_totalprice").alias("PRICE"), (F.col("o_orderstatus") == "F").alias("DONE"),
        F.col("o_orderpriority").alias("PRIORITY"), F.pmod("o_orderkey", F.lit(7)).alias("GRADE"),
        F.date_format(day, "'JAN-'yy").alias("SOURCE_MONTH"), (F.col("o_orderstatus") == "P").alias("pending"))
    name = landing.file_name("ORDERS", "binary")
    old = F.year("ORDERDATE") < 1998
    write_binary_table(rows.where(old).drop("GRADE"), root, name, {"PRIORITY": 15}, "pending")
    write_binary_table(rows.where(~old), root, name, {"PRIORITY": 15}, "pending")
    return root


@query("landed_orders", LANDED_ORDERS)
def landed_orders(spark, sf):
    df = landing.run_extract(spark, land_orders(spark, sf), ["ORDERS"], "binary")["ORDERS"]
    return df.withColumns({c: F.col(c).cast("bigint") for c in ("ORDERKEY", "CUSTOMER", "GRADE")})


@query("landed_orders_month", LANDED_ORDERS + " AND year(o_orderdate) = 1999")
def landed_orders_month(spark, sf):
    df = landing.read_month(spark, land_orders(spark, sf), "JAN-99", ["ORDERS"], "binary")["ORDERS"]
    return df.withColumns({c: F.col(c).cast("bigint") for c in ("ORDERKEY", "CUSTOMER", "GRADE")})


@query("landed_orders_columns", """
SELECT month, count(*) AS parts_columns, max(position) AS last_position, max(dtype) FILTER (WHERE "column" = 'PRICE') AS price
FROM (SELECT DISTINCT 'JAN-' || strftime(o_orderdate, '%y') AS month, year(o_orderdate) AS y FROM orders) m,
  (VALUES ('ORDERKEY', 0, 'double'), ('CUSTOMER', 1, 'double'), ('ORDERDATE', 2, 'date'), ('PRICE', 3, 'double'),
    ('DONE', 4, 'boolean'), ('PRIORITY', 5, 'string'), ('GRADE', 6, 'double')) c("column", position, dtype)
WHERE y >= 1998 OR "column" <> 'GRADE' GROUP BY month""")
def landed_orders_columns(spark, sf):
    found = landing.landed_columns(spark, land_orders(spark, sf), ["ORDERS"], "binary").distinct()
    return found.groupBy("month").agg(
        F.count("*").alias("parts_columns"), F.max("position").alias("last_position"),
        F.max(F.when(F.col("column") == "PRICE", F.col("dtype"))).alias("price"))


@query("catalog_tables", """
SELECT 'suppliers' AS "table", count(*) AS written, count(*) AS stored, sum(s_nationkey) AS checked FROM supplier
UNION ALL SELECT 'parts', count(*), count(*), sum(p_size) FROM part""")
def catalog_tables(spark, sf):
    schema = scratch_schema(spark, "roundtrip")
    frames = {"suppliers": V.table(spark, sf, "supplier"), "parts": V.table(spark, sf, "part")}
    for name, df in frames.items():
        require_not_empty(df, name)
    require_unique(frames["parts"], ["p_partkey"], "parts")
    require_no_nulls(frames["suppliers"], ["s_suppkey"], "suppliers")
    written = tables.run_database(spark, frames, schema)
    back = tables.read_multiple_tables(spark, list(frames), schema)
    sums = {"suppliers": "s_nationkey", "parts": "p_size"}
    return quality.union_all([back[t].agg(
        F.lit(t).alias("table"), F.lit(written[t]).cast("bigint").alias("written"), F.count("*").alias("stored"),
        F.sum(sums[t]).cast("bigint").alias("checked")) for t in frames])


@query("file_tables", """
SELECT format, count(*) AS rows, sum(n_nationkey) AS checked FROM nation, (VALUES ('csv'), ('parquet')) f(format)
GROUP BY format""")
def file_tables(spark, sf):
    root = f"{work_folder(spark)}/files-{uuid.uuid4().hex}"
    nation = V.table(spark, sf, "nation")
    tables.save_csv(nation, f"{root}/csv")
    tables.save_parquet(nation, f"{root}/parquet")
    back = {"csv": tables.load_csv(spark, f"{root}/csv", inferSchema=True), "parquet": tables.load_parquet(spark, f"{root}/parquet")}
    return quality.union_all([df.agg(F.lit(k).alias("format"), F.count("*").alias("rows"),
                                     F.sum("n_nationkey").cast("bigint").alias("checked")) for k, df in back.items()])


@query("published_forecast", """
SELECT CAST(s_suppkey AS VARCHAR) AS Medicine_ID, count(*) AS days, sum(CAST(s_nationkey AS DOUBLE)) AS total
FROM supplier, generate_series(1, 30) AS g(d) WHERE s_suppkey % 5 <> 0 GROUP BY s_suppkey""")
def published_forecast(spark, sf):
    root = f"{work_folder(spark)}/store-{uuid.uuid4().hex}"
    items = V.table(spark, sf, "supplier").select(F.col("s_suppkey").cast("string").alias("Medicine_ID"), "s_suppkey", "s_nationkey")
    days = items.withColumn("d", F.explode(F.sequence(F.lit(1), F.lit(30))))
    forecast = days.where("s_suppkey % 5 <> 0").select(
        "Medicine_ID", F.date_add(F.lit("2001-08-01").cast("date"), F.col("d")).alias("Forecast_Date"),
        F.col("s_nationkey").cast("double").alias("Predicted_Demand"), F.lit("tsb").alias("Model_ID"))
    failed = items.where("s_suppkey % 5 = 0").select("Medicine_ID", F.lit("no usable history").alias("reason"))
    publish.write_run(forecast, items, failed, root, "r1")
    publish.write_run(forecast.where("Medicine_ID = '1'"), items, failed, root, "r2")  # below the gate
    latest = publish.latest_forecast(spark, root)
    return latest.groupBy("Medicine_ID").agg(F.count("*").alias("days"), F.sum("Predicted_Demand").alias("total"))


@query("publish_failures", """
SELECT CASE WHEN s_suppkey % 5 = 0 THEN 'no usable history' ELSE 'neither forecast nor reported as failed' END AS reason,
  count(*) AS items FROM supplier WHERE s_suppkey % 5 = 0 OR s_suppkey % 7 = 0 GROUP BY 1""")
def publish_failures(spark, sf):
    root = f"{work_folder(spark)}/store-{uuid.uuid4().hex}"
    items = V.table(spark, sf, "supplier").select(F.col("s_suppkey").cast("string").alias("Medicine_ID"), "s_suppkey")
    forecast = items.where("s_suppkey % 5 <> 0 and s_suppkey % 7 <> 0").select(
        "Medicine_ID", F.lit("2001-08-02").cast("date").alias("Forecast_Date"), F.lit(1.0).alias("Predicted_Demand"))
    failed = items.where("s_suppkey % 5 = 0").select("Medicine_ID", F.lit("no usable history").alias("reason"))
    m = publish.write_run(forecast, items, failed, root, "r1")
    lost = spark.read.parquet(m["output_path"].replace("/forecast", "/failed"))
    return lost.groupBy("reason").agg(F.count("*").alias("items"))


@query("cleaned_orders", """
SELECT o_orderkey, coalesce(CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus = 'F' END, false) AS done,
  CASE WHEN o_orderkey % 3 <> 0 THEN CAST(o_orderdate AS DATE) END AS day,
  round_even(o_totalprice / 1000, 0) AS thousands FROM orders""")
def cleaned_orders(spark, sf):
    o = V.table(spark, sf, "orders").select(
        "o_orderkey", F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus") == "F").alias("done"),
        F.when(F.col("o_orderkey") % 3 == 0, "no date").otherwise(F.col("o_orderdate").cast("string")).alias("day"),
        (F.col("o_totalprice") / 1000).alias("thousands"))
    o = C.convert_to_datetime(C.fill_missing_boolean(o, ["done"]), "day")
    return C.round_numeric_columns(o, ["thousands"], 0).withColumn("day", F.to_date("day"))


@query("invalid_dates", "SELECT count(*) FILTER (WHERE o_orderkey % 3 = 0) AS invalid_count FROM orders")
def invalid_dates(spark, sf):
    text = F.when(F.col("o_orderkey") % 3 == 0, "no date").otherwise(F.col("o_orderdate").cast("string"))
    return C.count_invalid_datetime(V.table(spark, sf, "orders").select(text.alias("day")), "day")


@query("composite_join", """
SELECT l.INVNO, l.SOURCE_MONTH, count(*) AS lines, min(h.NET_AMT) AS amount FROM (
  SELECT CAST(l_orderkey AS VARCHAR) AS INVNO, SOURCE_MONTH FROM lines) l
LEFT JOIN (SELECT CAST(o_orderkey AS VARCHAR) AS INVNO, upper(strftime(o_orderdate, '%b-%y')) AS SOURCE_MONTH,
  o_totalprice AS NET_AMT FROM orders WHERE o_orderstatus = 'F') h
ON l.INVNO = h.INVNO AND l.SOURCE_MONTH = h.SOURCE_MONTH GROUP BY 1, 2""")
def composite_join(spark, sf):
    line = V.lines(spark, sf).select(F.col("l_orderkey").cast("string").alias("INVNO"), "SOURCE_MONTH")
    orders = V.table(spark, sf, "orders").where("o_orderstatus = 'F'").select(
        F.col("o_orderkey").cast("string").alias("NO"), V.month_tag(F.to_date("o_orderdate")).alias("MONTH"),
        F.col("o_totalprice").alias("NET_AMT"))
    both = joins.merge_dimension_composite(line, orders, ["INVNO", "SOURCE_MONTH"], ["NO", "MONTH"])
    return both.groupBy("INVNO", "SOURCE_MONTH").agg(F.count("*").alias("lines"), F.min("NET_AMT").alias("amount"))


@query("duplicate_sample", """
SELECT l_orderkey, l_linenumber, count(*) AS n FROM (SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem
  WHERE (l_orderkey, l_linenumber) IN (SELECT (l_orderkey, l_linenumber) FROM lineitem GROUP BY l_orderkey, l_linenumber
    HAVING count(*) > 1) ORDER BY 1, 2, 3 LIMIT 50) t GROUP BY 1, 2""")
def duplicate_sample(spark, sf):
    lines = V.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    found = quality.duplicate_samples(lines, ["l_orderkey", "l_linenumber"])
    return found.groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n"))


@query("orphan_sample", """
SELECT user_id, event_id FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer)
ORDER BY user_id, event_id LIMIT 100""")
def orphan_sample(spark, sf):
    events = V.table(spark, sf, "events").select("user_id", "event_id")
    return quality.orphan_samples(events, V.table(spark, sf, "customer"), "user_id", "c_custkey")


@query("comparison_splits", """
SELECT CAST(count(*) FILTER (WHERE NOT v) AS INTEGER) AS missing_validation, CAST(count(*) FILTER (WHERE NOT h) AS INTEGER) AS missing_holdout
FROM (SELECT bool_or(CAST(o_orderdate AS DATE) < DATE '2001-01-01') AS v, bool_or(CAST(o_orderdate AS DATE) >= DATE '2001-01-01') AS h FROM orders) s""")
def comparison_splits(spark, sf):
    split = F.when(F.to_date("o_orderdate") < "2001-01-01", "validation").otherwise("holdout")
    rows = V.table(spark, sf, "orders").select("o_orderkey", split.alias("Split"))
    return quality.check_comparison_input(rows, ["o_orderkey"])


# ================================================================ tables that meet without a shuffle
def colocated(spark, sf):
    """Landed lines and invoices, bucketed alike on the number alone, by which lines lie when they met their order. The
    width of a line is the contract's, about 300 bytes; a task that makes a bucket or dedupes it sorts it more than once,
    so a bucket is a quarter of what one task may hold. Spark joins in no fewer tasks than its shuffles have, so there are
    no fewer buckets: lines are dealt once, to meet their order."""
    least = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    buckets = tables.buckets_for(V.table(spark, sf, "lineitem").count(), 300, tables.BUCKET_BYTES // 4, least)
    return tables.store_colocated(
        {"invdet": V.invdet(spark, sf, buckets=buckets), "invoice": V.invoice_header(spark, sf)}, ["INVNO", "SOURCE_MONTH"],
        buckets, scratch_schema(spark, "colocated"), by=["INVNO"])


@query("colocated_demand", "SELECT * FROM daily_part")
def colocated_demand(spark, sf):
    kept = colocated(spark, sf)
    return series.colocated_demand(kept["invdet"], kept["invoice"])


@query("colocated_sales_lines", "SELECT f.*, i.INVDT, i.CCODE, i.SCODE FROM fact_line f JOIN invoice i "
       "ON f.INVNO = i.INVNO AND f.SOURCE_MONTH = i.SOURCE_MONTH")
def colocated_sales_lines(spark, sf):
    kept = colocated(spark, sf)
    heads = kept["invoice"].select("INVNO", "SOURCE_MONTH", "INVDT", "CCODE", "SCODE")
    facts = warehouse.build_fact_sales_line(kept["invdet"], extra=LINE_EXTRA)
    return joins.join_sales_invoice_line(facts, heads.hint("merge"), "inner", by_first=True)


# ================================================================ months as they land
CORRECTED = 1997


def stage_lines(spark, sf, early) -> dict:
    """Order lines and invoices, each made and written once: folders per year and per whether they land ``early``, and
    the columns, by table."""
    staged = {}
    for name, view in (("INVDET", V.invdet), ("INVOICE", V.invoice_header)):
        rows, path = view(spark, sf), f"{work_folder(spark)}/staged-{uuid.uuid4().hex}"
        remember(spark, path)
        year = F.year(C.source_month_date(F.col("SOURCE_MONTH")))
        rows.withColumns({"__year": year, "__early": early}).drop("SOURCE_MONTH").write.partitionBy("__year", "__early").parquet(path)
        staged[name] = path, rows.drop("SOURCE_MONTH").schema
    return staged


def land_lines(spark, staged, root, years, early=(True, False)) -> None:
    """Staged lines and invoices of the given years as further files of their snapshot folders. The files are moved, so
    nothing is written twice and a folder never shows half a file."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = hadoop(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for name, (path, schema) in staged.items():
        for y in years:
            to = f"{root}/JAN-{y % 100:02}/{name}"
            files = []
            for e in (str(e).lower() for e in early):
                part = hadoop(f"{path}/__year={y}/__early={e}")
                # a task's files have one name in all folders
                files += [(f.getPath(), f"early-{e}-{f.getPath().getName()}") for f in fs.listStatus(part)] if fs.exists(part) else []
            fs.mkdirs(hadoop(to))
            for file, own in files:
                if not fs.rename(file, hadoop(to, own)):
                    raise OSError(f"{file} cannot be landed in {to}")
            if not files:  # a year without rows lands as an empty file
                spark.createDataFrame([], schema).write.mode("append").parquet(to)


@query("arrived_months", f"""
SELECT year(INVDT) AS y, INVDT, count(*) AS items, sum(Demand_Qty) AS Demand_Qty,
  CASE WHEN year(INVDT) IN ({CORRECTED}, (SELECT max(year(o_orderdate)) FROM orders)) THEN 2 ELSE 1 END AS run,
  0 AS later_months FROM daily_part GROUP BY INVDT""")
def arrived_months(spark, sf):
    """Lines land in two parts: all years but the last, of one year only two thirds of the orders; then the rest. The
    second run touches those two years alone, a third one nothing."""
    root, store = (f"{work_folder(spark)}/{k}-{uuid.uuid4().hex}" for k in ("landing", "store"))
    remember(spark, root)
    remember(spark, store)
    day = F.year("o_orderdate")
    first, last = V.table(spark, sf, "orders").agg(F.min(day), F.max(day)).first()
    early = F.expr(f"SOURCE_MONTH NOT LIKE '%-{CORRECTED % 100}' OR CAST(INVNO AS BIGINT) % 3 <> 0")
    staged = stage_lines(spark, sf, early)
    land_lines(spark, staged, root, range(first, last), [True])
    monthly.pick_up_demand(spark, root, store)
    land_lines(spark, staged, root, [CORRECTED], [False])
    land_lines(spark, staged, root, [last])
    monthly.pick_up_demand(spark, root, store)
    later = len(monthly.pick_up_demand(spark, root, store))
    runs = arrivals.applied(spark, store).groupBy((F.year(C.source_month_date(F.col("month")))).alias("y")).agg(
        F.max("run").alias("run"))
    days = monthly.arrived_demand(spark, store).groupBy(F.year("INVDT").alias("y"), "INVDT").agg(
        F.count("*").alias("items"), F.sum("Demand_Qty").alias("Demand_Qty"))
    return days.join(runs, "y").withColumn("later_months", F.lit(later))
