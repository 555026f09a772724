"""Registered queries: warehouse, quality, silver, KPIs, exploratory."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import schemas as S
from ..functions import cleaning as C
from ..operators import distinct_sets, eda, joins, kpi, quality, silver, warehouse
from ..plans.etl import silver_tables
from ..session import cut_lineage, scratch_schema
from ..sources import tables
from . import views as V
from .registry import query
from .sqlbase import define, month_start

AS_OF = V.AS_OF


# ================================================================ SQL twins of dims and facts
def _first(source, keys, order, columns="*"):
    part, by = ", ".join(keys), ", ".join(order)
    return (f"SELECT * EXCLUDE (rn) FROM (SELECT {columns}, row_number() OVER "
            f"(PARTITION BY {part} ORDER BY {by}) AS rn FROM {source}) AS x WHERE rn = 1")


def _ties(columns, keys):
    return [f"{c} ASC NULLS FIRST" for c in columns if c not in keys]


def _latest(source, key, columns):
    return _first(source, [key], [f"{month_start('SOURCE_MONTH')} DESC NULLS LAST",
                                  *_ties(columns, [key])], ", ".join(columns))


def _fact(source, columns, keys, extra=()):
    cols = [*columns, *extra]
    return _first(source, keys, _ties(cols, keys), ", ".join(cols))


PRODUCT = [c for c in S.DIM_PRODUCT if c not in ("SUPNO", "TCODE")]
SUPPLIER = [c for c in S.DIM_SUPPLIER if c != "OLDCODE"]
TAX = ["TCODE", "IGST", "CGST", "SGST", "SOURCE_MONTH"]
LINE_EXTRA = ("BRAND", "KIND")

define("dim_product", _latest("medimast", "MDCODE", PRODUCT))
define("dim_supplier", _latest("supmast", "SUPNO", SUPPLIER))
define("dim_salesperson", _latest("sfile", "SCODE", S.DIM_SALESPERSON))
define("dim_tax", _latest("tfile", "TCODE", TAX))
define("fact_invoice", _fact("invoice", S.FACT_SALES_INVOICE, ["SOURCE_MONTH", "INVNO"]))
define("fact_line", _fact("invdet", S.FACT_SALES_LINE,
                          ["SOURCE_MONTH", "INVNO", "MDCODE", "BATCH"], LINE_EXTRA))
define("fact_purchase_head", _fact("compur", S.FACT_PURCHASE_HEADER, ["SOURCE_MONTH", "PINVNO"]))
define("fact_purchase_det", _fact("purchase", S.FACT_PURCHASE_LINE,
                                  ["SOURCE_MONTH", "PINVNO", "MDCODE", "BAT"]))

CALENDAR = """
SELECT CAST(strftime(d, '%Y%m%d') AS INTEGER) AS date_key, d AS full_date,
  CAST(day(d) AS INTEGER) AS day, dayname(d) AS day_name,
  CAST(isodow(d) AS INTEGER) AS day_of_week, CAST(week(d) AS INTEGER) AS week,
  CAST(month(d) AS INTEGER) AS month, monthname(d) AS month_name,
  strftime(d, '%b-%Y') AS month_year, CAST(quarter(d) AS INTEGER) AS quarter,
  CAST(year(d) AS INTEGER) AS year, isodow(d) >= 6 AS is_weekend, day(d) = 1 AS is_month_start,
  d = last_day(d) AS is_month_end,
  d = last_day(CAST(date_trunc('quarter', d) + INTERVAL 2 MONTH AS DATE)) AS is_quarter_end,
  month(d) = 12 AND day(d) = 31 AS is_year_end,
  CASE WHEN month(d) >= 4
    THEN 'FY ' || year(d) || '-' || lpad(CAST((year(d) + 1) % 100 AS VARCHAR), 2, '0')
    ELSE 'FY ' || (year(d) - 1) || '-' || lpad(CAST(year(d) % 100 AS VARCHAR), 2, '0')
  END AS financial_year,
  CAST(CASE WHEN month(d) >= 4 THEN month(d) - 3 ELSE month(d) + 9 END AS INTEGER) AS financial_month
FROM (SELECT CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS d FROM ({span}) AS s) AS t
"""
define("dim_date", CALENDAR.replace(
    "{span}", "SELECT min(o_orderdate)::DATE AS lo, max(o_orderdate)::DATE AS hi FROM orders"))
define("dim_date_expiry", CALENDAR.replace(
    "{span}", "SELECT min(EXP) AS lo, max(EXP) AS hi FROM purchase"))


# ================================================================ Spark sides
def dim_date(spark, sf):
    days = V.table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("d"))
    return warehouse.dim_date_for(days, ["d"])


def fact_line(spark, sf):
    return warehouse.build_fact_sales_line(V.invdet(spark, sf), extra=LINE_EXTRA)


def fact_invoice(spark, sf):
    return warehouse.build_fact_sales_invoice(V.invoice(spark, sf))


def dim_product(spark, sf):
    return warehouse.build_dim_product(V.medimast(spark, sf))


def dim_supplier(spark, sf):
    return warehouse.build_dim_supplier(V.supmast(spark, sf))


query("dim_date", "SELECT * FROM dim_date")(dim_date)
# contract columns that the driver tables have no source for are null
NO_SOURCE = {"dim_product": [c for c in S.DIM_PRODUCT if c not in PRODUCT],
             "dim_supplier": [c for c in S.DIM_SUPPLIER if c not in SUPPLIER],
             "dim_tax": [c for c in S.DIM_TAX if c not in TAX]}


def _no_source(dim):
    kind = {"string": "VARCHAR"}
    types = {c: S.DIMENSION_TYPES.get(c, "string") for c in NO_SOURCE[dim]}
    return ", ".join(f"CAST(NULL AS {kind.get(t, t)}) AS {c}" for c, t in types.items())


def _whole(dim):
    return f"SELECT *, {_no_source(dim)} FROM {dim}"


query("dim_product_latest", _whole("dim_product"))(dim_product)
query("dim_supplier_latest", _whole("dim_supplier"))(dim_supplier)
query("dim_salesperson_latest", "SELECT * FROM dim_salesperson")(
    lambda s, sf: warehouse.build_dim_salesperson(V.sfile(s, sf)))
query("dim_tax_latest", _whole("dim_tax"))(
    lambda s, sf: warehouse.build_dim_tax(V.tfile(s, sf)))
query("fact_sales_invoice", "SELECT * FROM fact_invoice")(fact_invoice)
query("fact_sales_line", "SELECT * EXCLUDE (BRAND, KIND) FROM fact_line")(
    lambda s, sf: fact_line(s, sf).drop(*LINE_EXTRA))
query("fact_purchase_header", "SELECT * FROM fact_purchase_head")(
    lambda s, sf: warehouse.build_fact_purchase_header(V.compur(s, sf)))
query("fact_purchase_line", "SELECT * FROM fact_purchase_det")(
    lambda s, sf: warehouse.build_fact_purchase_line(V.purchase(s, sf)))
query("fact_invoice_due",
      _fact("invoice", S.FACT_INVOICE_DUE, ["SOURCE_MONTH", "INVNO"]).replace(
          "SELECT * EXCLUDE (rn)", "SELECT * EXCLUDE (rn), CAST(DUEDT - INVDT AS INTEGER) AS DUE_DAYS")
      )(lambda s, sf: warehouse.build_fact_invoice_due(V.invoice(s, sf)))


# ================================================================ quality
def _dup_sql(table, source, keys):
    return f"""SELECT '{table}' AS "table", '{','.join(keys)}' AS duplicate_key,
  CAST(sum(n) AS BIGINT) AS total_rows,
  CAST(sum(CASE WHEN n > 1 THEN n ELSE 0 END) AS BIGINT) AS duplicate_rows,
  sum(CASE WHEN n > 1 THEN n ELSE 0 END) * CAST(100 AS DOUBLE) / sum(n) AS duplicate_percent,
  CASE WHEN max(n) > 1 THEN 'WARNING' ELSE 'PASSED' END AS status,
  CASE WHEN max(n) > 1 THEN 'Duplicate records found' ELSE 'No duplicates found' END AS message
FROM (SELECT count(*) AS n FROM {source} GROUP BY {', '.join(keys)}) AS k"""


SOURCE = {t: t.lower() for t in S.LANDING_TABLES}


@query("dup_report", " UNION ALL ".join(
    _dup_sql(t, SOURCE[t], k) for t, k in S.DUPLICATE_KEYS.items()), cut="duplicate_percent")
def dup_report(spark, sf):
    return quality.validate_duplicates(V.landed_tables(spark, sf), decimals=None).withColumn(
        "duplicate_key", F.array_join("duplicate_key", ","))


@query("dup_samples", """
SELECT * EXCLUDE (n) FROM (
  SELECT *, count(*) OVER (PARTITION BY SOURCE_MONTH, INVNO, MDCODE, BATCH) AS n FROM invdet) AS x
WHERE n > 1 ORDER BY SOURCE_MONTH, INVNO, MDCODE, BATCH, EXP, QTY, FQTY, RATE, SERATE, ACRATE, PRATE,
  MRP, TCODE, CANCEL_ID NULLS FIRST, SUPNO LIMIT 50""")
def dup_samples(spark, sf):
    return quality.duplicate_samples(V.invdet(spark, sf), S.DUPLICATE_KEYS["INVDET"])


def _orphan_sql(child, parent, key):
    return f"""SELECT '{child} {key} exists in {parent}' AS check_name, '{parent}' AS parent_table,
  '{child}' AS child_table, '{key}' AS parent_key, '{key}' AS child_key, count(*) AS child_rows,
  count(*) FILTER (WHERE o) AS orphan_rows,
  count(*) FILTER (WHERE o) * CAST(100 AS DOUBLE) / count(*) AS orphan_percent,
  CASE WHEN bool_or(o) THEN 'WARNING' ELSE 'PASSED' END AS status,
  CASE WHEN bool_or(o) THEN 'Orphan records found' ELSE 'No orphan records found' END AS message
FROM (SELECT c.{key} IS NULL OR p.k IS NULL AS o FROM {SOURCE[child]} AS c LEFT JOIN
  (SELECT DISTINCT {key} AS k FROM {SOURCE[parent]}) AS p ON c.{key} = p.k) AS t"""


@query("orphan_report", " UNION ALL ".join(_orphan_sql(*c) for c in S.REFERENCE_CHECKS),
       cut="orphan_percent")
def orphan_report(spark, sf):
    return quality.validate_orphans(V.landed_tables(spark, sf), decimals=None)


@query("orphan_users", """
SELECT 'events user exists in customer' AS check_name, 'customer' AS parent_table,
  'events' AS child_table, 'c_custkey' AS parent_key, 'user_id' AS child_key, count(*) AS child_rows,
  count(*) FILTER (WHERE c_custkey IS NULL) AS orphan_rows,
  count(*) FILTER (WHERE c_custkey IS NULL) * CAST(100 AS DOUBLE) / count(*) AS orphan_percent,
  CASE WHEN bool_or(c_custkey IS NULL) THEN 'WARNING' ELSE 'PASSED' END AS status,
  CASE WHEN bool_or(c_custkey IS NULL) THEN 'Orphan records found'
    ELSE 'No orphan records found' END AS message
FROM events LEFT JOIN (SELECT DISTINCT c_custkey FROM customer) AS c ON user_id = c_custkey""",
       cut="orphan_percent")
def orphan_users(spark, sf):
    return quality.orphan_report(
        V.table(spark, sf, "events"), V.table(spark, sf, "customer"),
        "events user exists in customer", "events", "customer", "user_id", "c_custkey", decimals=None)


ORDER_COLS = {
    "o_orderkey": ("bigint", 1), "o_custkey": ("bigint", 1), "o_orderstatus": ("string", 0),
    "o_totalprice": ("double", 1), "o_orderpriority": ("string", 0),
}


def _profile_sql(col, dtype, numeric):
    num = f"CAST({col} AS DOUBLE)" if numeric else "CAST(NULL AS DOUBLE)"
    text = f"CAST({col} AS VARCHAR)" if dtype != "double" else "NULL"
    top = "NULL" if dtype == "double" else (
        f"(SELECT string_agg(v || '=' || n, ';' ORDER BY n DESC, v) FROM (SELECT {text} AS v, "
        f"count(*) AS n FROM orders GROUP BY 1 ORDER BY n DESC, v LIMIT 5) AS t)")
    return f"""SELECT 'orders' AS "table", '{col}' AS "column", '{dtype}' AS dtype,
  count(*) AS total_rows, count(*) - count({col}) AS null_count,
  (count(*) - count({col})) * CAST(100 AS DOUBLE) / count(*) AS null_percent,
  count({col}) AS non_null_count, count(DISTINCT {col}) AS unique_count,
  count(DISTINCT {col}) * CAST(100 AS DOUBLE) / count(*) AS unique_percent,
  count(DISTINCT {col}) <= 1 AS is_constant, min({num}) AS "min", max({num}) AS "max",
  {'sum(CAST(' + col + ' AS DECIMAL(18,2)))::DOUBLE / count(' + col + ')' if numeric
   else 'CAST(NULL AS DOUBLE)'} AS mean,
  quantile_cont({num}, 0.5) AS median, {top} AS top_values FROM orders"""


@query("profile_report", " UNION ALL ".join(_profile_sql(c, *v) for c, v in ORDER_COLS.items()),
       cut="null_percent unique_percent mean median")
def profile_report(spark, sf):
    orders = V.table(spark, sf, "orders").select(*ORDER_COLS)
    top = F.array_join(F.transform("top_values", lambda x: F.concat_ws(
        "=", x["value"], x["n"].cast("string"))), ";")
    # the text form of a double differs between engines, so its top values are not compared
    return quality.profile_dataframe(orders, "orders", decimals=None).withColumn(
        "top_values", F.when(F.col("dtype") != "double", top))


@query("null_report", "SELECT " + ", ".join(
    f"count(*) - count({c}) AS {c}" for c in S.FACT_SALES_LINE) + " FROM invdet")
def null_report(spark, sf):
    from ..functions.guards import null_counts
    return null_counts(V.invdet(spark, sf), S.FACT_SALES_LINE)


@query("duplicate_key_count", """
SELECT CAST(count(*) - count(DISTINCT (l_orderkey, l_linenumber)) AS BIGINT) AS duplicate_count
FROM lineitem""")
def duplicate_key_count(spark, sf):
    from ..functions.guards import duplicate_key_count
    return duplicate_key_count(V.table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


# ================================================================ cleaning, joins
@query("clean_text", """
SELECT doc_id, upper(regexp_replace(lang, '^\\s+|\\s+$', '', 'g')) AS lang,
  coalesce(source, 'UNKNOWN') AS source, md5(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) AS text_md5
FROM documents""")
def clean_text(spark, sf):
    df = V.table(spark, sf, "documents").select("doc_id", "lang", "source", "text")
    df = C.fill_missing_text(C.normalize_text(C.trim_whitespace(df, ["text"]), ["lang"]), ["source"])
    return df.select("doc_id", "lang", "source", F.md5("text").alias("text_md5"))


@query("date_parts", """
SELECT event_id, CAST(year(ts) AS INTEGER) AS year, CAST(month(ts) AS INTEGER) AS month,
  monthname(ts) AS month_name, CAST(quarter(ts) AS INTEGER) AS quarter,
  CAST(week(ts) AS INTEGER) AS week, CAST(day(ts) AS INTEGER) AS day, dayname(ts) AS day_name,
  coalesce(value / nullif(CAST(user_id AS DOUBLE), 0), 0) AS value_per_user
FROM events""", cut="value_per_user")
def date_parts(spark, sf):
    df = C.extract_date_parts(V.table(spark, sf, "events"), "ts")
    return df.select("event_id", *C.DATE_PARTS,
                     C.safe_divide(F.col("value"), F.col("user_id")).alias("value_per_user"))


@query("line_invoice_inner", """
SELECT l.INVNO, l.MDCODE, l.BATCH, l.SOURCE_MONTH, l.QTY, i.INVDT
FROM fact_line l JOIN fact_invoice i ON l.INVNO = i.INVNO AND l.SOURCE_MONTH = i.SOURCE_MONTH
WHERE (l.CANCEL_ID IS NULL OR l.CANCEL_ID = 0) AND (i.CANCEL_ID IS NULL OR i.CANCEL_ID = 0)""")
def line_invoice_inner(spark, sf):
    line = fact_line(spark, sf).where(C.not_cancelled())
    head = fact_invoice(spark, sf).where(C.not_cancelled()).select("INVNO", "SOURCE_MONTH", "INVDT")
    return joins.merge_dimension(line, head, ["INVNO", "SOURCE_MONTH"], how="inner").select(
        "INVNO", "MDCODE", "BATCH", "SOURCE_MONTH", "QTY", "INVDT")


@query("keys_without_match", """
SELECT DISTINCT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)""")
def keys_without_match(spark, sf):
    lines = V.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return joins.keys_without_match(V.table(spark, sf, "orders"), lines, ["o_orderkey"])


@query("salted_product_join", """
SELECT INVNO, d.MDCODE, BATCH, QTY, MDNAME, SUPCODE FROM fact_line d
LEFT JOIN dim_product p ON d.MDCODE = p.MDCODE""")
def salted_product_join(spark, sf):
    # hot keys are counted before the join, so the lines are written once
    line = cut_lineage(fact_line(spark, sf).select("INVNO", "MDCODE", "BATCH", "QTY"))
    product = dim_product(spark, sf).select("MDCODE", "MDNAME", "SUPCODE")
    return joins.salted_join(line, product, "MDCODE")


# ================================================================ silver
DATE_COLS = [c for c in S.DIM_DATE if c != "full_date"]
define("sales_base", """
SELECT DISTINCT INVNO, MDCODE, BATCH, EXP, QTY, FQTY, RATE, SERATE, ACRATE, PRATE, MRP, TCODE,
  CANCEL_ID, SUPNO, LPDT, RATCHG, SOURCE_MONTH, INVDT, TIME, DUEDT, CCODE, ACODE, SCODE, TOT_AMT,
  DISC_PER, FDISC_AMT, ST_AMT, NET_AMT, REMARK, SNAME, MDNAME, PACKG, DETAIL, SUPCODE, HSN, UQC,
  NEWDT, SMDT, """ + ", ".join(DATE_COLS) + """
FROM (SELECT * EXCLUDE (BRAND, KIND) FROM fact_line) AS f
LEFT JOIN (SELECT * EXCLUDE (CANCEL_ID) FROM fact_invoice) AS i USING (INVNO, SOURCE_MONTH)
LEFT JOIN (SELECT SCODE, SNAME FROM dim_salesperson) AS s USING (SCODE)
LEFT JOIN (SELECT * EXCLUDE (SOURCE_MONTH) FROM dim_product) AS p USING (MDCODE)
LEFT JOIN dim_date AS d ON INVDT = d.full_date
WHERE QTY > 0 AND NET_AMT > 0""")
define("sales_full", """
SELECT *, TOT_AMT - NET_AMT AS Discount_Amount, RATE - PRATE AS Profit_Per_Unit,
  (RATE - PRATE) * QTY AS Total_Profit,
  (RATE - PRATE) / nullif(PRATE, 0) * 100 AS Profit_Percentage,
  NET_AMT >= 10000 AS High_Value_Order_Flag,
  CASE WHEN RATE > 0 AND RATE <= 100 THEN 'LOW' WHEN RATE > 100 AND RATE <= 500 THEN 'MEDIUM'
    WHEN RATE > 500 AND RATE <= 1000 THEN 'HIGH' WHEN RATE > 1000 THEN 'PREMIUM' END AS Price_Category,
  CASE WHEN QTY > 0 AND QTY <= 10 THEN 'SMALL' WHEN QTY > 10 AND QTY <= 50 THEN 'MEDIUM'
    WHEN QTY > 50 AND QTY <= 100 THEN 'LARGE' WHEN QTY > 100 THEN 'BULK' END AS Sales_Size,
  coalesce(EXP < DATE '2001-08-01', false) AS Expired_Medicine_Sold
FROM sales_base""")


def sales_silver(spark, sf):
    # a stored dimension has a known size, so invoices need not move before Spark learns how small it is
    return silver.build_sales(
        warehouse.build_fact_sales_line(V.invdet(spark, sf)), fact_invoice(spark, sf),
        cut_lineage(warehouse.build_dim_salesperson(V.sfile(spark, sf))), dim_product(spark, sf),
        dim_date(spark, sf), as_of=AS_OF, rounded=False)


query("sales_silver", "SELECT * FROM sales_full",
      cut="Discount_Amount Profit_Per_Unit Total_Profit Profit_Percentage")(sales_silver)

define("purchase_full", """
SELECT *, QTY * PRATE AS Purchase_Value, SRATE - PRATE AS Margin_Per_Unit,
  (SRATE - PRATE) / nullif(PRATE, 0) * 100 AS Margin_Percentage,
  CASE WHEN PRATE > 0 AND PRATE <= 100 THEN 'LOW' WHEN PRATE > 100 AND PRATE <= 500 THEN 'MEDIUM'
    WHEN PRATE > 500 AND PRATE <= 1000 THEN 'HIGH' WHEN PRATE > 1000 THEN 'PREMIUM' END AS Price_Category,
  CASE WHEN QTY > 0 AND QTY <= 10 THEN 'SMALL' WHEN QTY > 10 AND QTY <= 50 THEN 'MEDIUM'
    WHEN QTY > 50 AND QTY <= 100 THEN 'LARGE' WHEN QTY > 100 THEN 'BULK' END AS Purchase_Size,
  QTY * PRATE >= 10000 AS Large_Purchase_Flag,
  coalesce(EXP < DATE '2001-08-01', false) AS Expired_Batch
FROM (SELECT DISTINCT PINVNO, MDCODE, BAT, EXP, QTY, FQTY, PRATE, SRATE, MRP, TCODE, SOH, PINVDT,
    TRADT, PACODE, SUPNO, CALVAL, INVAMT, ADDDTL, ADDAMT, SUPNAME,
    upper(trim(SUPCODE)) AS SUPCODE, RNAME, RADD1, RADD2, RADD3, RADD4, RPHON,
    upper(MDNAME) AS MDNAME, PACKG, DETAIL, HSN, UQC, NEWDT, SMDT, """ + ", ".join(DATE_COLS) + """
  FROM fact_purchase_det AS f
  LEFT JOIN fact_purchase_head AS h USING (PINVNO, SOURCE_MONTH)
  LEFT JOIN (SELECT * EXCLUDE (SOURCE_MONTH) FROM dim_supplier) AS s USING (SUPNO)
  LEFT JOIN (SELECT * EXCLUDE (SOURCE_MONTH, SUPCODE) FROM dim_product) AS p USING (MDCODE)
  LEFT JOIN dim_date AS d ON PINVDT = d.full_date
  WHERE QTY > 0 AND PRATE > 0) AS b""")


def purchase_silver(spark, sf):
    return silver.build_purchase(
        warehouse.build_fact_purchase_line(V.purchase(spark, sf)),
        warehouse.build_fact_purchase_header(V.compur(spark, sf)),
        cut_lineage(dim_supplier(spark, sf)), dim_product(spark, sf), dim_date(spark, sf), as_of=AS_OF, rounded=False)


query("purchase_silver", f"SELECT *, {_no_source('dim_supplier')} FROM purchase_full",
      cut="Purchase_Value Margin_Per_Unit Margin_Percentage")(purchase_silver)

define("inventory_full", """
SELECT *, SOH * PRATE AS Inventory_Value, EXP AS Expiry_Date,
  CAST(EXP - DATE '2001-08-01' AS INTEGER) AS Days_To_Expiry,
  CASE WHEN EXP - DATE '2001-08-01' <= -99999 THEN NULL
    WHEN EXP - DATE '2001-08-01' <= 0 THEN 'Expired'
    WHEN EXP - DATE '2001-08-01' <= 30 THEN '0-30 Days'
    WHEN EXP - DATE '2001-08-01' <= 90 THEN '31-90 Days'
    WHEN EXP - DATE '2001-08-01' <= 180 THEN '91-180 Days'
    WHEN EXP - DATE '2001-08-01' <= 365 THEN '181-365 Days'
    WHEN EXP - DATE '2001-08-01' <= 99999 THEN '>365 Days' END AS Expiry_Bucket,
  CASE WHEN SOH <= 0 THEN 'Out Of Stock' WHEN SOH <= 10 THEN 'Low Stock' ELSE 'In Stock'
    END AS Stock_Status,
  SOH <= 10 AS Reorder_Flag
FROM (SELECT DISTINCT PINVNO, MDCODE, BAT, EXP, QTY, FQTY, PRATE, SRATE, MRP, TCODE, SOH,
    f.SOURCE_MONTH, upper(MDNAME) AS MDNAME, PACKG, DETAIL,
    coalesce(upper(SUPCODE), 'UNKNOWN') AS SUPCODE, HSN, UQC, NEWDT, SMDT, """ + ", ".join(
        DATE_COLS) + """
  FROM fact_purchase_det AS f LEFT JOIN dim_product AS p USING (MDCODE)
  LEFT JOIN dim_date_expiry AS d ON EXP = d.full_date) AS b""")


def inventory_silver(spark, sf):
    line = warehouse.build_fact_purchase_line(V.purchase(spark, sf))
    ship = V.table(spark, sf, "lineitem").select(
        F.date_add(F.to_date("l_shipdate"), 365).alias("EXP"))
    return silver.build_inventory(line, dim_product(spark, sf),
                                  warehouse.dim_date_for(ship, ["EXP"]), as_of=AS_OF)


query("inventory_silver", "SELECT *, CAST(NULL AS VARCHAR) AS SUPNO FROM inventory_full", cut="Inventory_Value")(inventory_silver)

query("medicine_silver", """
SELECT MDCODE, upper(trim(MDNAME)) AS MDNAME, upper(trim(PACKG)) AS PACKG, 'UNKNOWN' AS DETAIL,
  upper(trim(SUPCODE)) AS SUPCODE, HSN, 'UNKNOWN' AS UQC, NEWDT, SMDT, SOURCE_MONTH,
  trim(upper(trim(MDNAME)) || ' ' || upper(trim(PACKG))) AS Product_Display_Name,
  CAST(DATE '2001-08-01' - NEWDT AS INTEGER) AS Product_Age_Days,
  CASE WHEN SMDT IS NOT NULL THEN 'ACTIVE' ELSE 'INACTIVE' END AS Product_Status,
  coalesce(SUPCODE, '') <> '' AS Supplier_Available, HSN IS NOT NULL AS HSN_Available,
  """ + _no_source("dim_product") + """
FROM dim_product""")(lambda s, sf: silver.build_medicine(dim_product(s, sf), AS_OF))

query("supplier_silver", """
SELECT SUPNO, upper(trim(SUPNAME)) AS SUPNAME, upper(trim(SUPCODE)) AS SUPCODE, 'UNKNOWN' AS RNAME,
  RADD1, RADD2, trim(RADD3) AS RADD3, RADD4, trim(RPHON) AS RPHON, SOURCE_MONTH,
  upper(trim(SUPCODE)) || ' - ' || upper(trim(SUPNAME)) AS Supplier_Display,
  trim(RPHON) <> '' AS Has_Contact, RADD1 || ', ' || trim(RADD3) AS Supplier_Address,
  """ + _no_source("dim_supplier") + """
FROM dim_supplier""")(lambda s, sf: silver.build_supplier(dim_supplier(s, sf)))


# ---------------------------------------------------------------- the whole chain
BY_NUMBER = {"fact_sales_invoice": "INVNO", "fact_sales_line": "INVNO", "fact_purchase_header": "PINVNO", "fact_purchase_line": "PINVNO"}


@query("warehouse_chain", """
SELECT 'dim_date' AS "table", CAST(CAST('2001-08-01' AS DATE) - CAST('1992-01-01' AS DATE) + 1 AS BIGINT) AS rows UNION ALL """ + " UNION ALL ".join(
    f"SELECT '{name}', count(*) FROM {cte}" for name, cte in {
        "dim_product": "dim_product", "dim_supplier": "dim_supplier", "dim_salesperson": "dim_salesperson",
        "dim_tax": "dim_tax", "fact_sales_invoice": "fact_invoice", "fact_invoice_due": "fact_invoice",
        "fact_sales_line": "fact_line", "fact_purchase_header": "fact_purchase_head",
        "fact_purchase_line": "fact_purchase_det", "silver medicine": "dim_product", "silver supplier": "dim_supplier",
        "silver inventory": "(SELECT DISTINCT * FROM fact_purchase_det) AS d", "silver purchase": "purchase_full",
        "silver sales": "sales_full"}.items()))
def warehouse_chain(spark, sf):
    """All ten tables from the landed ones, written and read back, and the five enriched tables from them. Order lines
    are made and stored once for all; they, the lines of both kinds and their heads are stored by number, so that dedupes,
    heads and lines meet where they lie."""
    schema = scratch_schema(spark, "chain")
    stored = tables.store_by(V.order_lines(spark, sf), "order_lines", schema, "number")
    built = warehouse.build_warehouse(V.landed_tables(spark, sf, stored), "1992-01-01", "2001-08-01")
    kept = {name: tables.store_by(df, name, schema, BY_NUMBER[name]) if name in BY_NUMBER else cut_lineage(df)
            for name, df in built.items()}
    made = {f"silver {name}": df for name, df in silver_tables(kept, AS_OF, by_number=True).items()}
    return quality.union_all([df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("table"), "rows")
                              for name, df in (kept | made).items()])


# ================================================================ KPIs
def _lines_money(spark, sf):
    """Line amounts as decimals, so sums are exact whatever the order of addition."""
    return V.table(spark, sf, "lineitem").join(
        V.table(spark, sf, "orders").select(
            "o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("day")),
        F.col("l_orderkey") == F.col("o_orderkey"),
    ).select(
        F.col("l_orderkey").alias("INVNO"), F.col("o_custkey").alias("CCODE"),
        F.col("day").alias("INVDT"), F.year("day").alias("year"), F.month("day").alias("month"),
        F.col("l_partkey").alias("MDCODE"), F.col("l_quantity").alias("QTY"),
        F.col("l_extendedprice").cast("decimal(18,2)").alias("LINE_AMT"),
        (F.col("l_returnflag") == "R").alias("RETURNED"), F.col("l_suppkey").alias("SUPNO"),
    )


define("order_lines", """
SELECT l_orderkey AS INVNO, o_custkey AS CCODE, CAST(o_orderdate AS DATE) AS INVDT,
  CAST(year(o_orderdate) AS INTEGER) AS year, CAST(month(o_orderdate) AS INTEGER) AS month,
  l_partkey AS MDCODE, l_quantity AS QTY, CAST(l_extendedprice AS DECIMAL(18,2)) AS LINE_AMT,
  l_returnflag = 'R' AS RETURNED, l_suppkey AS SUPNO
FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")


def _sum_query(name, fn, keys, out, sql_amount="LINE_AMT", agg="sum"):
    cols = ", ".join(keys)
    expr = f"CAST(sum({sql_amount}) AS DOUBLE)" if agg == "sum" else (
        f"CAST(sum({sql_amount}) AS DOUBLE) / count({sql_amount})")
    query(name, f"SELECT {cols}, {expr} AS {out} FROM order_lines GROUP BY {cols}", cut=out)(
        lambda s, sf: fn(_lines_money(s, sf)).withColumn(out, F.col(out).cast("double")))


_sum_query("daily_sales", lambda d: kpi.daily_sales(d, amount="LINE_AMT"), ["INVDT"], "Daily_Sales")
_sum_query("monthly_sales", lambda d: kpi.monthly_sales(d, amount="LINE_AMT"), ["year", "month"],
           "Monthly_Sales")
_sum_query("yearly_sales", lambda d: kpi.yearly_sales(d, amount="LINE_AMT"), ["year"], "Yearly_Sales")
_sum_query("customer_sales", lambda d: kpi.customer_sales(d, amount="LINE_AMT"), ["CCODE"],
           "Customer_Sales")
_sum_query("product_sales", lambda d: kpi.product_sales(d, amount="LINE_AMT"), ["MDCODE"],
           "Product_Sales")
_sum_query("avg_customer_order",
           lambda d: kpi.average_customer_order(
               d.withColumn("QTY", F.col("QTY").cast("double")), amount="QTY"),
           ["CCODE"], "Average_Order_Value", "QTY", "avg")


def _purchases(spark, sf):
    """Purchase lines valued at list price, decimal."""
    part = V.table(spark, sf, "part").select("p_partkey", "p_retailprice")
    qty = F.col("QTY").cast("decimal(18,2)")
    return _lines_money(spark, sf).join(part, F.col("MDCODE") == F.col("p_partkey")).withColumns({
        "PINVDT": F.col("INVDT"),
        "Purchase_Value": (qty * F.col("p_retailprice").cast("decimal(18,2)")).cast("decimal(18,2)"),
    })


define("purchase_values", """
SELECT o.*, INVDT AS PINVDT, CAST(CAST(QTY AS DECIMAL(18,2)) * CAST(p_retailprice AS DECIMAL(18,2))
  AS DECIMAL(18,2)) AS Purchase_Value FROM order_lines AS o JOIN part ON MDCODE = p_partkey""")


def _purchase_query(name, fn, keys, out):
    cols = ", ".join(keys)
    query(name, f"SELECT {cols}, CAST(sum(Purchase_Value) AS DOUBLE) AS {out} FROM purchase_values "
                f"GROUP BY {cols}", cut=out)(
        lambda s, sf: fn(_purchases(s, sf)).withColumn(out, F.col(out).cast("double")))


_purchase_query("daily_purchase", kpi.daily_purchase, ["PINVDT"], "Daily_Purchase")
_purchase_query("monthly_purchase", kpi.monthly_purchase, ["year", "month"], "Monthly_Purchase")
_purchase_query("yearly_purchase", kpi.yearly_purchase, ["year"], "Yearly_Purchase")
_purchase_query("supplier_purchase", kpi.supplier_purchase, ["SUPNO"], "Supplier_Purchase")
_purchase_query("medicine_purchase", kpi.medicine_purchase, ["MDCODE"], "Medicine_Purchase")

query("avg_supplier_order", """
SELECT SUPNO, sum(QTY) / count(QTY) AS Average_Supplier_Order FROM order_lines GROUP BY SUPNO""",
      cut="Average_Supplier_Order")(
    lambda s, sf: kpi.average_supplier_order(_lines_money(s, sf), amount="QTY"))

query("top_products", """
SELECT MDCODE, sum(QTY) AS Quantity_Sold FROM order_lines GROUP BY MDCODE
ORDER BY Quantity_Sold DESC, MDCODE LIMIT 10""")(
    lambda s, sf: kpi.top_selling_products(_lines_money(s, sf)))
query("top_purchased", """
SELECT MDCODE, sum(QTY) AS Quantity_Purchased FROM purchase_values GROUP BY MDCODE
ORDER BY Quantity_Purchased DESC, MDCODE LIMIT 10""")(
    lambda s, sf: kpi.top_purchased_medicines(_purchases(s, sf)))

GROWTH_SQL = """
SELECT year, month, amt AS {name}, lag(amt) OVER (ORDER BY year, month) AS Previous,
  coalesce((amt - lag(amt) OVER (ORDER BY year, month))
    / nullif(lag(amt) OVER (ORDER BY year, month), 0) * 100, 0) AS Growth_Pct
FROM (SELECT year, month, CAST(sum({col}) AS DOUBLE) AS amt FROM {src} GROUP BY year, month) AS m"""


@query("sales_growth", GROWTH_SQL.format(name="Monthly_Sales", col="LINE_AMT", src="order_lines"),
       cut="Monthly_Sales Previous Growth_Pct")
def sales_growth(spark, sf):
    m = kpi.monthly_sales(_lines_money(spark, sf), amount="LINE_AMT").withColumn(
        "Monthly_Sales", F.col("Monthly_Sales").cast("double"))
    return kpi.growth(m, ["year", "month"], "Monthly_Sales", rounded=False)


@query("purchase_growth", GROWTH_SQL.format(
    name="Monthly_Purchase", col="Purchase_Value", src="purchase_values"),
    cut="Monthly_Purchase Previous Growth_Pct")
def purchase_growth(spark, sf):
    m = kpi.monthly_purchase(_purchases(spark, sf)).withColumn(
        "Monthly_Purchase", F.col("Monthly_Purchase").cast("double"))
    return kpi.growth(m, ["year", "month"], "Monthly_Purchase", rounded=False)


def _contribution(name, key):
    query(name, f"""
SELECT {key}, CAST(sum(LINE_AMT) AS DOUBLE) AS Amount, CAST(sum(LINE_AMT) AS DOUBLE) /
  (SELECT CAST(sum(LINE_AMT) AS DOUBLE) FROM order_lines) * 100 AS Contribution_Pct
FROM order_lines GROUP BY {key}""", cut="Amount Contribution_Pct")(
        lambda s, sf: kpi.contribution(_lines_money(s, sf), key, "LINE_AMT", rounded=False).withColumn(
            "Amount", F.col("Amount").cast("double")))


_contribution("product_contribution", "MDCODE")
_contribution("customer_contribution", "CCODE")

RAW_RATIOS = {
    "Average_Order_Value": ("Total_Sales", "Total_Orders", 1),
    "Average_Items_Per_Order": ("Total_Quantity", "Total_Orders", 1),
    "Sales_Per_Customer": ("Total_Sales", "Total_Customers", 1),
    "Sales_Per_Day": ("Total_Sales", "Sales_Days", 1),
    "Return_Rate": ("Returned_Orders", "Total_Orders", 100),
    "Repeat_Customer_Rate": ("Repeat_Customers", "Total_Customers", 100),
}


def _doubles(df):
    """Decimal results as doubles, for the comparison at four decimals."""
    return df.withColumns({c: F.col(c).cast("double") for c, kind in df.dtypes if kind.startswith("decimal")})


# ---------------------------------------------------------------- distinct keys by period
SETS = ["Customers", "Orders", "Items"]
define("active", """
SELECT 'day' AS level, INVDT AS period, CCODE, INVNO, MDCODE FROM order_lines UNION ALL
SELECT 'month', CAST(date_trunc('month', INVDT) AS DATE), CCODE, INVNO, MDCODE FROM order_lines UNION ALL
SELECT 'year', CAST(date_trunc('year', INVDT) AS DATE), CCODE, INVNO, MDCODE FROM order_lines""")


def active_sets(spark, sf):
    """Customers, orders and items of each day, written once. Customers are named by text here, so they take their ids
    from a dictionary; the others are numbers already."""
    lines = _lines_money(spark, sf).withColumn("CCODE", F.concat(F.lit("C-"), F.col("CCODE")))
    ids = distinct_sets.key_ids(lines, "CCODE")
    keys = {"Customers": ("CCODE", ids), "Orders": ("INVNO", None), "Items": ("MDCODE", None)}
    return cut_lineage(quality.union_all([
        distinct_sets.day_sets(lines, ["INVDT"], key, name, own) for name, (key, own) in keys.items()]))


@query("active_by_period", """
SELECT level, period, count(DISTINCT CCODE) AS Customers, count(DISTINCT INVNO) AS Orders,
  count(DISTINCT MDCODE) AS Items FROM active GROUP BY 1, 2""")
def active_by_period(spark, sf):
    day = active_sets(spark, sf)
    month = distinct_sets.roll_up(day, {"period": F.trunc("INVDT", "month")})
    year = distinct_sets.roll_up(month, {"period": F.trunc("period", "year")})
    levels = {"day": day.withColumnRenamed("INVDT", "period"), "month": month, "year": year}
    return quality.union_all([
        distinct_sets.set_sizes(df, ["period"], SETS).withColumn("level", F.lit(n)) for n, df in levels.items()])


MONTH_NUMBER = "CAST(year(period) * 12 + month(period) AS INTEGER)"


@query("kept_customers", f"""
SELECT a.m AS month_number, count(*) AS size, count(b.CCODE) AS kept, count(b.CCODE) * 100 / CAST(count(*) AS DOUBLE) AS kept_pct
FROM (SELECT DISTINCT {MONTH_NUMBER} AS m, CCODE FROM active WHERE level = 'month') AS a
LEFT JOIN (SELECT DISTINCT {MONTH_NUMBER} AS m, CCODE FROM active WHERE level = 'month') AS b
  ON a.CCODE = b.CCODE AND b.m = a.m - 1 GROUP BY 1""", cut="kept_pct")
def kept_customers(spark, sf):
    number = F.year("INVDT") * 12 + F.month("INVDT")
    months = distinct_sets.roll_up(active_sets(spark, sf), {"month_number": number})
    return distinct_sets.overlap_sizes(months, "month_number", 1, "Customers")


@query("order_kpis", """
SELECT *, """ + ", ".join(f"{n} / CAST({d} AS DOUBLE) * {k} AS {o}"
                          for o, (n, d, k) in RAW_RATIOS.items()) + """
FROM (SELECT count(*) AS Total_Orders, sum(q) AS Total_Quantity, CAST(sum(a) AS DOUBLE) AS Total_Sales,
    CAST(sum(r) AS BIGINT) AS Returned_Orders, count(DISTINCT INVDT) AS Sales_Days,
    count(DISTINCT CCODE) AS Total_Customers,
    (SELECT count(*) FROM (SELECT CCODE FROM order_lines GROUP BY CCODE
       HAVING count(DISTINCT INVNO) > 1) AS rc) AS Repeat_Customers
  FROM (SELECT INVNO, min(CCODE) AS CCODE, min(INVDT) AS INVDT, sum(QTY) AS q, sum(LINE_AMT) AS a,
      max(CASE WHEN RETURNED THEN 1 ELSE 0 END) AS r FROM order_lines GROUP BY INVNO) AS o) AS t""",
       cut=" ".join(["Total_Sales", *RAW_RATIOS]))
def order_kpis(spark, sf):
    # compared before rounding: built-in rounding differs between engines at ties
    return _doubles(kpi.order_kpis(_lines_money(spark, sf), decimals=None))


@query("margin_kpis", """
SELECT year, CAST(sum(LINE_AMT) AS DOUBLE) AS Revenue, CAST(sum(Purchase_Value) AS DOUBLE) AS Cost,
  CAST(sum(LINE_AMT) - sum(Purchase_Value) AS DOUBLE) AS Profit,
  CAST(sum(LINE_AMT) - sum(Purchase_Value) AS DOUBLE) / CAST(sum(LINE_AMT) AS DOUBLE) * 100
    AS Profit_Margin
FROM purchase_values GROUP BY year""", cut="Revenue Cost Profit Profit_Margin")
def margin_kpis(spark, sf):
    return _doubles(kpi.margin_kpis(_purchases(spark, sf), "LINE_AMT", "Purchase_Value", ["year"], decimals=None))


@query("sales_totals", """
SELECT CAST(sum(LINE_AMT) AS DOUBLE) AS Total_Sales, sum(QTY) / count(QTY) AS Average_Quantity,
  count(DISTINCT CCODE) AS Customers, count(DISTINCT SUPNO) AS Suppliers,
  count(DISTINCT INVNO) AS Orders FROM order_lines""", cut="Total_Sales Average_Quantity")
def sales_totals(spark, sf):
    d = _lines_money(spark, sf)
    return _doubles(kpi.totals(d, {"Total_Sales": "LINE_AMT"}, {"Average_Quantity": "QTY"},
                               {"Customers": "CCODE", "Suppliers": "SUPNO", "Orders": "INVNO"}))


INV_RATIOS = {
    "Reorder_Rate": ("Reorder_Items", "Total_Items"), "Low_Stock_Rate": ("Low_Stock_Items", "Total_Items"),
    "Stock_Out_Rate": ("Stock_Out_Items", "Total_Items"),
    "Dead_Stock_Rate": ("Dead_Stock_Items", "Total_Items"),
    "Stock_Utilization": ("Sold_Quantity", "Total_Stock"),
    "Stock_Availability": ("Total_Stock", "Sold_Quantity"),
}


@query("inventory_kpis", """
SELECT *, """ + ", ".join(f"{n} / CAST({d} AS DOUBLE) * 100 AS {o}"
                          for o, (n, d) in INV_RATIOS.items()) + """,
  Cost_Of_Goods / Average_Inventory_Value AS Inventory_Turnover,
  365 / (Cost_Of_Goods / Average_Inventory_Value) AS Days_Of_Inventory
FROM (SELECT count(*) AS Total_Items, sum(SOH) AS Total_Stock, sum(SOH) / count(SOH) AS Average_Stock,
    CAST(sum(v) AS DOUBLE) AS Inventory_Value, CAST(sum(v) AS DOUBLE) / count(v) AS Average_Inventory_Value,
    count(*) FILTER (WHERE Reorder_Flag) AS Reorder_Items,
    count(*) FILTER (WHERE Stock_Status = 'Low Stock') AS Low_Stock_Items,
    count(*) FILTER (WHERE Stock_Status = 'Out Of Stock') AS Stock_Out_Items,
    count(*) FILTER (WHERE Days_To_Expiry <= 0) AS Dead_Stock_Items,
    (SELECT sum(QTY) FROM order_lines WHERE NOT RETURNED) AS Sold_Quantity,
    (SELECT CAST(sum(Purchase_Value) AS DOUBLE) FROM purchase_values WHERE NOT RETURNED) AS Cost_Of_Goods
  FROM (SELECT *, CAST(Inventory_Value AS DECIMAL(18,2)) AS v FROM inventory_full) AS f) AS t""",
       cut=" ".join(["Average_Stock Inventory_Value Average_Inventory_Value Cost_Of_Goods",
                     *INV_RATIOS, "Inventory_Turnover Days_Of_Inventory"]))
def inventory_kpis(spark, sf):
    inv = inventory_silver(spark, sf).withColumn(
        "Inventory_Value", F.col("Inventory_Value").cast("decimal(18,2)"))
    kept = _purchases(spark, sf).where(~F.col("RETURNED"))
    both = kept.agg(F.struct(F.sum("QTY").alias("qty"), F.sum("Purchase_Value").cast("double").alias("cost"))).scalar()
    return _doubles(kpi.inventory_kpis(inv, both["qty"], both["cost"], decimals=None))


@query("unit_cost", """
SELECT CAST(sum(Purchase_Value) AS DOUBLE) / sum(QTY) AS Average_Unit_Cost,
  CAST(sum(Purchase_Value) AS DOUBLE) / count(DISTINCT INVNO) AS Average_Purchase_Order_Value,
  CAST(sum(Purchase_Value) AS DOUBLE) AS Inventory_Value FROM purchase_values""",
       cut="Average_Unit_Cost Average_Purchase_Order_Value Inventory_Value")
def unit_cost(spark, sf):
    p = _purchases(spark, sf)
    order = kpi.average_order_value(p, "INVNO", "Purchase_Value", decimals=None)
    worth = kpi.inventory_value(p.withColumn("one", F.lit(1)), "Purchase_Value", "one")
    return _doubles(kpi.average_unit_cost(p, decimals=None).withColumns({
        "Average_Purchase_Order_Value": order.scalar(), "Inventory_Value": worth.scalar()}))


# ================================================================ exploratory
define("sales_days", """
SELECT MDCODE, INVDT, sum(QTY) AS Demand_Qty FROM order_lines WHERE NOT RETURNED
GROUP BY MDCODE, INVDT""")


def _item_days(spark, sf):
    kept = _lines_money(spark, sf).where(~F.col("RETURNED"))
    return kept.groupBy("MDCODE", "INVDT").agg(F.sum("QTY").alias("Demand_Qty"))


query("iqr_outliers", """
SELECT MDCODE, INVDT, Demand_Qty FROM sales_days, (
  SELECT quantile_cont(Demand_Qty, 0.25) AS q1, quantile_cont(Demand_Qty, 0.75) AS q3
  FROM sales_days) AS q
WHERE Demand_Qty < q1 - 1.5 * (q3 - q1) OR Demand_Qty > q3 + 1.5 * (q3 - q1)""")(
    lambda s, sf: eda.iqr_outliers(_item_days(s, sf), "Demand_Qty"))

query("top20_share", """
SELECT MDCODE, t AS Total, t / (SELECT sum(Demand_Qty) FROM sales_days) * 100 AS Share_Pct
FROM (SELECT MDCODE, sum(Demand_Qty) AS t FROM sales_days GROUP BY MDCODE) AS x
ORDER BY t DESC, MDCODE LIMIT 20""", cut="Share_Pct")(
    lambda s, sf: eda.top_share(_item_days(s, sf), "MDCODE", "Demand_Qty", 20))

query("period_totals", """
SELECT 'day' AS Period, strftime(INVDT, '%Y-%m-%d') AS Label, sum(Demand_Qty) AS Total
FROM sales_days GROUP BY 1, 2 UNION ALL
SELECT 'month', strftime(INVDT, '%Y-%m'), sum(Demand_Qty) FROM sales_days GROUP BY 1, 2 UNION ALL
SELECT 'quarter', year(INVDT) || '-Q' || quarter(INVDT), sum(Demand_Qty) FROM sales_days
GROUP BY 1, 2""")(lambda s, sf: eda.period_totals(_item_days(s, sf), "INVDT", "Demand_Qty"))

query("seasonality", """
SELECT 'weekend' AS Kind, CASE WHEN isodow(INVDT) >= 6 THEN 'Weekend' ELSE 'Weekday' END AS Label,
  sum(Demand_Qty) AS Total, sum(Demand_Qty) / count(*) AS Average FROM sales_days GROUP BY 1, 2
UNION ALL SELECT 'weekday', dayname(INVDT), sum(Demand_Qty), sum(Demand_Qty) / count(*)
FROM sales_days GROUP BY 1, 2
UNION ALL SELECT 'month', monthname(INVDT), sum(Demand_Qty), sum(Demand_Qty) / count(*)
FROM sales_days GROUP BY 1, 2""", cut="Average")(
    lambda s, sf: eda.seasonality(_item_days(s, sf), "INVDT", "Demand_Qty"))

CORR = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
query("correlations", " UNION ALL ".join(
    f"SELECT '{a}' AS Left_Column, '{b}' AS Right_Column, corr({a}, {b}) AS Correlation FROM lineitem"
    for i, a in enumerate(CORR) for b in CORR[i:]), cut="Correlation")(
    lambda s, sf: eda.correlations(V.table(s, sf, "lineitem"), CORR))

query("histogram", """
SELECT least(CAST(floor((Demand_Qty - lo) / ((hi - lo) / 40)) AS INTEGER) + 1, 40) AS Bin,
  count(*) AS Rows FROM sales_days, (
  SELECT min(Demand_Qty) AS lo, max(Demand_Qty) AS hi FROM sales_days) AS r GROUP BY 1""")(
    lambda s, sf: eda.histogram(_item_days(s, sf), "Demand_Qty", 40).select("Bin", "Rows"))
