"""Star schema: five dimensions, five facts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions.cleaning import source_month_date
from ..functions.guards import require_columns


# ---------------------------------------------------------------- calendar

def financial_year(d) -> F.Column:
    """April-start year label such as FY 2023-24."""
    y = F.year(F.add_months(d, -3))
    return F.concat(F.lit("FY "), y.cast("string"), F.lit("-"),
                    F.lpad(((y + 1) % 100).cast("string"), 2, "0"))


def financial_month(d) -> F.Column:
    return F.month(F.add_months(d, -3))


def calendar_columns(days: DataFrame, day: str = "full_date") -> DataFrame:
    """The 18 calendar attributes of a frame of days."""
    d = F.col(day)
    last = F.last_day(d)
    quarter_last = F.last_day(F.add_months(F.trunc(d, "quarter"), 2))
    return days.select(
        F.date_format(d, "yyyyMMdd").cast("int").alias("date_key"),
        d.alias("full_date"),
        F.dayofmonth(d).alias("day"),
        F.date_format(d, "EEEE").alias("day_name"),
        (F.weekday(d) + 1).alias("day_of_week"),
        F.weekofyear(d).alias("week"),
        F.month(d).alias("month"),
        F.date_format(d, "MMMM").alias("month_name"),
        F.date_format(d, "MMM-yyyy").alias("month_year"),
        F.quarter(d).alias("quarter"),
        F.year(d).alias("year"),
        (F.weekday(d) >= 5).alias("is_weekend"),
        (F.dayofmonth(d) == 1).alias("is_month_start"),
        (d == last).alias("is_month_end"),
        (d == quarter_last).alias("is_quarter_end"),
        ((F.month(d) == 12) & (F.dayofmonth(d) == 31)).alias("is_year_end"),
        financial_year(d).alias("financial_year"),
        financial_month(d).alias("financial_month"),
    )


def build_dim_date(spark: SparkSession, start: str, end: str) -> DataFrame:
    """One row per day from start to end, both included."""
    if start > end:
        raise ValueError("start must not be after end")
    days = spark.range(1).select(
        F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))).alias("full_date")
    )
    return calendar_columns(days)


def dim_date_for(df: DataFrame, day_columns: list[str]) -> DataFrame:
    """Calendar that spans the days found in the data."""
    lo = F.least(*[F.min(c) for c in day_columns]) if len(day_columns) > 1 else F.min(day_columns[0])
    hi = F.greatest(*[F.max(c) for c in day_columns]) if len(day_columns) > 1 else F.max(
        day_columns[0])
    span = df.agg(lo.alias("lo"), hi.alias("hi"))
    return calendar_columns(span.select(F.explode(F.sequence("lo", "hi")).alias("full_date")))


# ---------------------------------------------------------------- keep one row per key

def first_per_key(df: DataFrame, keys: list[str], order: list[F.Column]) -> DataFrame:
    """First row of each key under a total order.

    The rank filter lets Spark apply a group limit before the shuffle, so a hot key sends one row
    per map task instead of its whole group.
    """
    ranked = df.withColumn("__rn", F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    return ranked.where(F.col("__rn") == 1).drop("__rn")


def _tie_order(df: DataFrame, keys: list[str]) -> list[F.Column]:
    return [F.col(c).asc_nulls_first() for c in df.columns if c not in keys]


def latest_snapshot(source: DataFrame, key: str, columns: list[str],
                    order: str = "chronological") -> DataFrame:
    """Row of the newest month per key. ``order='lexical'`` sorts the month tag as text instead."""
    require_columns(source, [key, "SOURCE_MONTH"], "snapshot table")
    # the contract's schema is fixed: a column that the source lacks is there, null and of the contract's type
    df = source.select(*[
        F.col(c) if c in source.columns else F.lit(None).cast(S.DIMENSION_TYPES.get(c, "string")).alias(c)
        for c in columns])
    month = F.col("SOURCE_MONTH") if order == "lexical" else source_month_date(F.col("SOURCE_MONTH"))
    return first_per_key(df, [key], [month.desc_nulls_last(), *_tie_order(df, [key])])


def build_dim_product(source, order="chronological"):
    return latest_snapshot(source, "MDCODE", S.DIM_PRODUCT, order)


def build_dim_supplier(source, order="chronological"):
    return latest_snapshot(source, "SUPNO", S.DIM_SUPPLIER, order)


def build_dim_salesperson(source, order="chronological"):
    return latest_snapshot(source, "SCODE", S.DIM_SALESPERSON, order)


def build_dim_tax(source, order="chronological"):
    return latest_snapshot(source, "TCODE", S.DIM_TAX, order)


# ---------------------------------------------------------------- facts

def build_fact(source: DataFrame, columns: list[str], keys: list[str], extra=()) -> DataFrame:
    """Contract projection with one row per business key; ``extra`` columns ride along.

    Keys are listed most selective first: Spark's sort compares the first key's leading bytes, and a
    month tag in front would tie almost everywhere.

    Rows carry no order in Spark, so a reader who wants the fact sorted sorts its own slice.
    """
    require_columns(source, columns, "fact source")
    df = source.select(*columns, *[c for c in extra if c not in columns])
    return first_per_key(df, keys, _tie_order(df, keys))


def build_fact_sales_invoice(source, extra=()):
    return build_fact(source, S.FACT_SALES_INVOICE, ["INVNO", "SOURCE_MONTH"], extra)


def build_fact_sales_line(source, extra=()):
    return build_fact(source, S.FACT_SALES_LINE, ["INVNO", "MDCODE", "BATCH", "SOURCE_MONTH"], extra)


def build_fact_purchase_header(source, extra=()):
    return build_fact(source, S.FACT_PURCHASE_HEADER, ["PINVNO", "SOURCE_MONTH"], extra)


def build_fact_purchase_line(source, extra=()):
    return build_fact(source, S.FACT_PURCHASE_LINE, ["PINVNO", "MDCODE", "BAT", "SOURCE_MONTH"],
                      extra)


def build_fact_invoice_due(source, extra=()):
    fact = build_fact(source, S.FACT_INVOICE_DUE, ["INVNO", "SOURCE_MONTH"], extra)
    return fact.withColumn("DUE_DAYS", F.datediff("DUEDT", "INVDT"))


def run_dimensions(tables: dict[str, DataFrame], start: str, end: str) -> dict[str, DataFrame]:
    spark = next(iter(tables.values())).sparkSession
    return {
        "dim_date": build_dim_date(spark, start, end),
        "dim_product": build_dim_product(tables["MEDIMAST"]),
        "dim_supplier": build_dim_supplier(tables["SUPMAST"]),
        "dim_salesperson": build_dim_salesperson(tables["SFILE"]),
        "dim_tax": build_dim_tax(tables["TFILE"]),
    }


def run_facts(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    return {
        "fact_sales_invoice": build_fact_sales_invoice(tables["INVOICE"]),
        "fact_sales_line": build_fact_sales_line(tables["INVDET"]),
        "fact_purchase_header": build_fact_purchase_header(tables["COMPUR"]),
        "fact_purchase_line": build_fact_purchase_line(tables["PURCHASE"]),
        "fact_invoice_due": build_fact_invoice_due(tables["INVOICE"]),
    }


def build_warehouse(tables, start="2018-01-01", end="2026-05-31") -> dict[str, DataFrame]:
    """All ten tables, lazily."""
    return {**run_dimensions(tables, start, end), **run_facts(tables)}
