"""Registry of queries and their SQL oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import functions as F

from . import sqlbase

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, cut: str = ""):
    """Register a query; ``cut`` names the double columns compared at four decimals."""

    def wrap(fn):
        def run(spark, sf):
            df = fn(spark, sf)
            return df.withColumns({c: r4(F.col(c)) for c in cut.split()}) if cut else df

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sqlbase.rounded(sqlbase.sql(sql), cut) if cut else sqlbase.sql(sql)
        return fn

    return wrap


def r4(c) -> F.Column:
    """Four decimals by plain arithmetic. The offset is irrational, so means and ratios of whole
    numbers never sit on the cut, where the last bit would decide."""
    return F.floor(c * 1e4 + sqlbase.OFFSET) / 1e4


def money(c) -> F.Column:
    """Exact decimal sum of a money column, as double."""
    return F.sum(F.col(c).cast("decimal(18,2)")).cast("double")
