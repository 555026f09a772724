"""Driver tables reshaped as landed ERP tables.

The line tables need the order month, so each view that reads lines joins lineitem with two columns
of orders. Line tables meet orders last and on the invoice number as text, so their rows come out placed by the column
that the fact's key begins with, and the dedupe moves no line again. Everything is lazy: a query that needs three
columns scans three columns. Invoices and purchase headers meet the sums of their lines on the number as text too, and so
lie with the lines of their number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = "2001-08-01"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """One driver table, by its own footer."""
    return spark.read.parquet(f"{sf}/{name}.parquet")


def month_tag(c) -> F.Column:
    return F.upper(F.date_format(c, "MMM-yy"))


def _text(c) -> F.Column:
    return F.col(c).cast("string")


def lines(spark, sf) -> DataFrame:
    """Order lines with the order's day and month tag."""
    orders = table(spark, sf, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day"))
    return table(spark, sf, "lineitem").join(
        orders, F.col("l_orderkey") == F.col("o_orderkey")
    ).withColumn("SOURCE_MONTH", month_tag(F.col("day")))


def priced_lines(spark, sf, number, *columns, buckets: int | None = None) -> DataFrame:
    """Order lines with columns of their part and the order's month tag, the order's key as text named ``number``; dealt
    by it, over ``buckets`` tasks where that is given."""
    part = table(spark, sf, "part").select("p_partkey", *columns)
    line = table(spark, sf, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey"))
    orders = table(spark, sf, "orders").select(
        _text("o_orderkey").alias(number), month_tag(F.to_date("o_orderdate")).alias("SOURCE_MONTH"))
    line = line.withColumn(number, _text("l_orderkey"))
    if buckets:
        line, orders = (df.repartition(buckets, F.col(number)) for df in (line, orders))
    return line.join(orders, number)


def order_lines(spark, sf) -> DataFrame:
    """What the landed tables that are made of lines take from them, for a caller who stores it once: lines by the order's
    key as text, named ``number``, with the order's day and month tag, their part's price and whether the part is known."""
    line = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_tax", "l_returnflag", "l_shipdate")
    part = table(spark, sf, "part").select("p_partkey", "p_retailprice")
    priced = line.join(part, F.col("l_partkey") == F.col("p_partkey"), "left").withColumns(
        {"number": _text("l_orderkey"), "known": F.col("p_partkey").isNotNull()}).drop("l_orderkey", "p_partkey")
    day = F.to_date("o_orderdate")
    orders = table(spark, sf, "orders").select(_text("o_orderkey").alias("number"), day.alias("day"), month_tag(day).alias("SOURCE_MONTH"))
    return priced.join(orders, "number")


def _priced(stored: DataFrame, number: str) -> DataFrame:
    return stored.where("known").withColumnRenamed("number", number)


def tax_code() -> F.Column:
    return F.floor(F.col("l_tax") * 100 + 0.5).cast("int").cast("string")


def invoice(spark, sf) -> DataFrame:
    amounts = table(spark, sf, "lineitem").groupBy(_text("l_orderkey").alias("INVNO")).agg(
        F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double").alias("TOT_AMT"))
    day = F.to_date("o_orderdate")
    return table(spark, sf, "orders").withColumn("INVNO", _text("o_orderkey")).join(amounts, "INVNO", "left").select(
        "INVNO",
        day.alias("INVDT"),
        F.lit("00:00").alias("TIME"),
        F.date_add(day, 30).alias("DUEDT"),
        month_tag(day).alias("SOURCE_MONTH"),
        _text("o_custkey").alias("CCODE"),
        _text("o_custkey").alias("ACODE"),
        F.substring("o_orderpriority", 1, 1).alias("SCODE"),
        "TOT_AMT",
        F.lit(0.0).alias("DISC_PER"),
        F.lit(0.0).alias("FDISC_AMT"),
        F.lit(0.0).alias("ST_AMT"),
        F.col("o_totalprice").alias("NET_AMT"),
        F.lit(0).alias("CANCEL_ID"),
        F.col("o_orderstatus").alias("REMARK"),
    )


def invoice_header(spark, sf) -> DataFrame:
    """The invoice columns that need no line totals (no aggregate, no join)."""
    day = F.to_date("o_orderdate")
    return table(spark, sf, "orders").select(
        _text("o_orderkey").alias("INVNO"), day.alias("INVDT"), month_tag(day).alias("SOURCE_MONTH"),
        _text("o_custkey").alias("CCODE"), F.substring("o_orderpriority", 1, 1).alias("SCODE"),
        F.date_add(day, 30).alias("DUEDT"), F.col("o_totalprice").alias("NET_AMT"),
        F.lit(0).alias("CANCEL_ID"),
    )


def invdet(spark, sf, stored=None, buckets: int | None = None) -> DataFrame:
    """Of ``stored`` order lines, without the part's brand and type, where these are given."""
    rate = F.col("l_extendedprice") / F.col("l_quantity")
    line = (priced_lines(spark, sf, "INVNO", "p_retailprice", "p_brand", "p_type", buckets=buckets) if stored is None
            else _priced(stored, "INVNO"))
    return line.select(
        "INVNO",
        _text("l_partkey").alias("MDCODE"),
        _text("l_linenumber").alias("BATCH"),
        F.date_add(F.to_date("l_shipdate"), 365).alias("EXP"),
        F.col("l_quantity").alias("QTY"),
        F.lit(0.0).alias("FQTY"),
        rate.alias("RATE"),
        rate.alias("SERATE"),
        rate.alias("ACRATE"),
        F.col("p_retailprice").alias("PRATE"),
        (rate * 1.2).alias("MRP"),
        tax_code().alias("TCODE"),
        F.when(F.col("l_returnflag") == "R", 1).alias("CANCEL_ID"),
        _text("l_suppkey").alias("SUPNO"),
        F.to_date("l_shipdate").alias("LPDT"),
        F.lit(0).alias("RATCHG"),
        "SOURCE_MONTH",
        *([F.col("p_brand").alias("BRAND"), F.col("p_type").alias("KIND")] if stored is None else []),
    )


def medimast(spark, sf, stored=None) -> DataFrame:
    seen = (lines(spark, sf) if stored is None else stored).groupBy("SOURCE_MONTH", "l_partkey").agg(
        F.min(F.trunc("day", "month")).alias("first"))
    part = table(spark, sf, "part")
    return seen.join(part, F.col("l_partkey") == F.col("p_partkey")).select(
        _text("p_partkey").alias("MDCODE"),
        F.col("p_name").alias("MDNAME"),
        F.col("p_type").alias("PACKG"),
        F.lit(None).cast("string").alias("DETAIL"),
        F.col("p_brand").alias("SUPCODE"),
        F.when(F.col("p_size") > 10, _text("p_size")).alias("HSN"),
        F.lit(None).cast("string").alias("UQC"),
        F.col("first").alias("NEWDT"),
        F.when(F.col("p_size") > 25, F.col("first")).alias("SMDT"),
        "SOURCE_MONTH",
    )


def purchase(spark, sf, stored=None) -> DataFrame:
    rate = F.col("l_extendedprice") / F.col("l_quantity")
    line = priced_lines(spark, sf, "PINVNO", "p_retailprice") if stored is None else _priced(stored, "PINVNO")
    return line.select(
        "PINVNO",
        _text("l_partkey").alias("MDCODE"),
        _text("l_linenumber").alias("BAT"),
        F.date_add(F.to_date("l_shipdate"), 365).alias("EXP"),
        F.col("l_quantity").alias("QTY"),
        F.lit(0.0).alias("FQTY"),
        F.col("p_retailprice").alias("PRATE"),
        rate.alias("SRATE"),
        (rate * 1.2).alias("MRP"),
        tax_code().alias("TCODE"),
        F.col("l_quantity").alias("SOH"),
        "SOURCE_MONTH",
    )


def compur(spark, sf) -> DataFrame:
    heads = table(spark, sf, "lineitem").groupBy(_text("l_orderkey").alias("PINVNO")).agg(
        F.min("l_suppkey").alias("supplier"),
        F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double").alias("CALVAL"))
    day = F.to_date("o_orderdate")
    return table(spark, sf, "orders").withColumn("PINVNO", _text("o_orderkey")).join(heads, "PINVNO").select(
        "PINVNO",
        day.alias("PINVDT"),
        day.alias("TRADT"),
        _text("o_custkey").alias("PACODE"),
        _text("supplier").alias("SUPNO"),
        "CALVAL",
        F.col("o_totalprice").alias("INVAMT"),
        F.lit(0.0).alias("ADDDTL"),
        F.lit(0.0).alias("ADDAMT"),
        month_tag(day).alias("SOURCE_MONTH"),
    )


def supmast(spark, sf, stored=None) -> DataFrame:
    seen = (lines(spark, sf) if stored is None else stored).select("SOURCE_MONTH", "l_suppkey").distinct()
    supplier = table(spark, sf, "supplier")
    return seen.join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).select(
        _text("s_suppkey").alias("SUPNO"),
        F.col("s_name").alias("SUPNAME"),
        F.concat(F.lit(" s"), _text("s_suppkey")).alias("SUPCODE"),
        F.lit(None).cast("string").alias("RNAME"),
        F.concat(F.lit("Region "), _text("s_nationkey")).alias("RADD1"),
        F.lit("").alias("RADD2"),
        F.lit("Depot ").alias("RADD3"),
        F.lit("").alias("RADD4"),
        F.when(F.col("s_acctbal") > 0, _text("s_suppkey")).otherwise(" ").alias("RPHON"),
        "SOURCE_MONTH",
    )


def sfile(spark, sf) -> DataFrame:
    return table(spark, sf, "orders").select(
        F.substring("o_orderpriority", 1, 1).alias("SCODE"),
        F.expr("substring(o_orderpriority, 3)").alias("SNAME"),
        month_tag(F.to_date("o_orderdate")).alias("SOURCE_MONTH"),
    ).distinct()


def tfile(spark, sf, stored=None) -> DataFrame:
    rate = F.floor(F.col("l_tax") * 100 + 0.5).cast("double")
    return (lines(spark, sf) if stored is None else stored).select(
        tax_code().alias("TCODE"), rate.alias("IGST"), (rate / 2).alias("CGST"),
        (rate / 2).alias("SGST"), "SOURCE_MONTH",
    ).distinct()


LANDED = {
    "INVOICE": invoice, "INVDET": invdet, "MEDIMAST": medimast, "PURCHASE": purchase,
    "COMPUR": compur, "SUPMAST": supmast, "SFILE": sfile, "TFILE": tfile,
}


OF_LINES = ("INVDET", "MEDIMAST", "PURCHASE", "SUPMAST", "TFILE")


def landed_tables(spark, sf, stored=None) -> dict[str, DataFrame]:
    """The eight landed tables, five of them of ``stored`` order lines (see ``order_lines``) where these are given."""
    return {name: view(spark, sf, stored) if stored is not None and name in OF_LINES else view(spark, sf)
            for name, view in LANDED.items()}
