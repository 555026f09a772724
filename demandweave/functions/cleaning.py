"""Projection-only cleaning steps; every one stays inside whole-stage codegen."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def strip(c: Column) -> Column:
    """Strip all surrounding white space (trim() alone strips blanks only)."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def trim_whitespace(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: strip(F.col(c)) for c in columns if c in df.columns})


def normalize_text(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: F.upper(strip(F.col(c))) for c in columns if c in df.columns})


def _fill(df: DataFrame, columns: list[str], value, allowed, what: str) -> DataFrame:
    present = [c for c in columns if c in df.columns]
    for c in present:
        if not isinstance(df.schema[c].dataType, allowed):
            raise TypeError(f"column {c} is not {what}")
    return df.na.fill(value, present) if present else df


def fill_missing_numeric(df: DataFrame, columns: list[str], value: float = 0) -> DataFrame:
    present = [c for c in columns if c in df.columns]
    df = _fill(df, present, value, T.NumericType, "numeric")
    floats = [c for c in present if isinstance(df.schema[c].dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.nanvl(F.col(c), F.lit(float(value))) for c in floats})


def fill_missing_text(df: DataFrame, columns: list[str], value: str = "UNKNOWN") -> DataFrame:
    return _fill(df, columns, value, T.StringType, "text")


def fill_missing_boolean(df: DataFrame, columns: list[str], value: bool = False) -> DataFrame:
    return _fill(df, columns, value, T.BooleanType, "boolean")


def convert_to_datetime(df: DataFrame, column: str) -> DataFrame:
    """Unparsable text becomes null."""
    return df.withColumn(column, F.try_to_timestamp(F.col(column).cast("string")))


def count_invalid_datetime(df: DataFrame, column: str) -> DataFrame:
    bad = F.col(column).isNotNull() & F.try_to_timestamp(F.col(column).cast("string")).isNull()
    return df.agg(F.count_if(bad).alias("invalid_count"))


def to_number(c: Column) -> Column:
    """Numeric coercion; text that is no number becomes null."""
    return c.try_cast("double")


def to_day(c: Column) -> Column:
    """Midnight-normalised date."""
    return F.to_date(c)


# (output column, expression) of each date part
DATE_PARTS = {
    "year": F.year,
    "month": F.month,
    "month_name": lambda c: F.date_format(c, "MMMM"),
    "quarter": F.quarter,
    "week": F.weekofyear,
    "day": F.dayofmonth,
    "day_name": lambda c: F.date_format(c, "EEEE"),
}


def extract_date_parts(df: DataFrame, column: str, parts: list[str] | None = None,
                       prefix: str = "") -> DataFrame:
    return df.withColumns(
        {prefix + p: DATE_PARTS[p](F.col(column)) for p in (parts or list(DATE_PARTS))}
    )


def round_numeric_columns(df: DataFrame, columns: list[str], decimals: int = 2) -> DataFrame:
    """Half-even rounding."""
    return df.withColumns({c: F.bround(F.col(c), decimals) for c in columns if c in df.columns})


def safe_divide(n: Column, d: Column, default: float = 0.0) -> Column:
    """n / d, or the default where either side is missing or d is 0."""
    return F.coalesce(F.try_divide(n.cast("double"), d.cast("double")), F.lit(default))


def not_cancelled(column: str = "CANCEL_ID") -> Column:
    return F.col(column).isNull() | (F.col(column) == 0)


def bin_right_closed(c: Column, edges: list[float], labels: list[str]) -> Column:
    """Right-closed bins (e0, e1], (e1, e2], ...; null outside. The last edge may be inf."""
    out = None
    for lo, hi, label in zip(edges, edges[1:], labels):
        hit = c > lo if hi == float("inf") else (c > lo) & (c <= hi)
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out


def source_month_date(c: Column, century_pivot: int = 70) -> Column:
    """First day of a month tag such as APR-18; two-digit years >= pivot fall in the 1900s."""
    names = F.lit("JANFEBMARAPRMAYJUNJULAUGSEPOCTNOVDEC")
    tag = F.upper(strip(c))
    month = (F.instr(names, F.substring(tag, 1, 3)) + 2) / 3
    year_text = F.regexp_extract(tag, r"(\d{2,4})\s*$", 1)
    yy = year_text.try_cast("int")
    year = F.when(F.length(year_text) == 4, yy).otherwise(
        yy + F.when(yy >= century_pivot, 1900).otherwise(2000)
    )
    return F.make_date(year, month.cast("int"), F.lit(1))

