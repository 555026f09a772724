"""Contract guards. Column guards run at analysis time; data guards run one aggregate."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class ContractError(ValueError):
    """Raised when data breaks a declared contract."""


def require_columns(df: DataFrame, columns: list[str], name: str = "table") -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise KeyError(f"{name} lacks columns {missing}")


def require_not_empty(df: DataFrame, name: str = "table") -> None:
    if df.isEmpty():
        raise ContractError(f"{name} is empty")


def duplicate_key_count(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row: rows beyond the first of each key. Two-level aggregate, so hot keys combine early."""
    per_key = df.groupBy(*keys).agg(F.count("*").alias("n"))
    return per_key.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_count"))


def require_unique(df: DataFrame, keys: list[str], name: str = "table") -> None:
    require_columns(df, keys, name)
    found = duplicate_key_count(df, keys).first()[0]
    if found:
        raise ContractError(f"{name} has {found} rows repeating key {keys}")


def null_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row, one count per column, one pass."""
    return df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])


def require_no_nulls(df: DataFrame, columns: list[str], name: str = "table") -> None:
    require_columns(df, columns, name)
    row = null_counts(df, columns).first().asDict()
    bad = {c: n for c, n in row.items() if n}
    if bad:
        raise ContractError(f"{name} has nulls: {bad}")


def require_no_violations(report: DataFrame, name: str = "table") -> None:
    """Raise if any counter of a one-row violations report is above zero."""
    row = report.first().asDict()
    bad = {c: n for c, n in row.items() if isinstance(n, int) and n > 0}
    if bad:
        raise ContractError(f"{name} breaks its contract: {bad}")


def any_of(conditions):
    """Disjunction of column conditions."""
    return reduce(lambda a, b: a | b, conditions)
