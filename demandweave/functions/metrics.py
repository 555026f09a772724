"""Accuracy metrics and KPI ratios as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def pct(n: Column, d: Column, on_zero: Column | float | None = None) -> Column:
    """100 * n / d; ``on_zero`` (null by default) where d is 0 or missing."""
    out = F.try_divide(n.cast("double"), d.cast("double")) * 100
    return out if on_zero is None else F.coalesce(out, F.lit(on_zero).cast("double"))


def wape(error: Column, actual: Column, on_zero=None) -> Column:
    return pct(error, actual, on_zero)


def accuracy_aggregates(actual: str = "Actual", predicted: str = "Predicted",
                        p10: str | None = None, p90: str | None = None,
                        decimals: int | None = None) -> list[Column]:
    """Aggregates of one evaluation group; all of them combine before the shuffle."""
    a, p = F.col(actual).cast("double"), F.col(predicted).cast("double")
    err = F.abs(a - p)
    smape = F.when(F.abs(a) + F.abs(p) > 0, 200 * err / (F.abs(a) + F.abs(p))).otherwise(0.0)

    def r(c: Column) -> Column:
        return c if decimals is None else F.bround(c, decimals)

    if p10 and p90:
        hit = F.when((a >= F.col(p10)) & (a <= F.col(p90)), 100.0).otherwise(0.0)
        coverage = F.coalesce(F.avg(hit), F.lit(0.0))
    else:
        coverage = F.lit(0.0)
    return [
        F.count("*").alias("Sample_Count"),
        r(F.coalesce(F.sum(a), F.lit(0.0))).alias("Total_Actual"),
        r(F.coalesce(F.sum(p), F.lit(0.0))).alias("Total_Predicted"),
        r(F.coalesce(F.sum(err), F.lit(0.0))).alias("Total_Absolute_Error"),
        r(F.when(F.sum(a) > 0, F.sum(err) / F.sum(a) * 100).otherwise(0.0)).alias("WAPE_Pct"),
        r(F.coalesce(F.avg(err), F.lit(0.0))).alias("MAE"),
        r(F.coalesce(F.avg(smape), F.lit(0.0))).alias("sMAPE_Pct"),
        r(F.coalesce(F.avg(p - a), F.lit(0.0))).alias("MBE"),
        r(coverage).alias("P10_P90_Coverage_Pct"),
    ]


def pooled_aggregates(actual: str, predicted: str) -> list[Column]:
    """WAPE, predicted/actual ratio, bias and mean error over a whole group."""
    a, p = F.col(actual), F.col(predicted)
    err = F.abs(a - p)
    return [
        F.count("*").alias("Rows"),
        F.sum(a).alias("Actual"),
        F.sum(p).alias("Predicted"),
        F.sum(err).alias("Absolute_Error"),
        wape(F.sum(err), F.sum(a)).alias("WAPE_Pct"),
        F.try_divide(F.sum(p), F.sum(a)).alias("Ratio"),
        F.avg(p - a).alias("MBE"),
        F.avg(err).alias("MAE"),
    ]


# --- scalar KPI expressions: n, d may be columns or aggregates ---

def profit(revenue: Column, cost: Column) -> Column:
    return revenue - cost


def at(c: Column, decimals: int | None) -> Column:
    """Rounded half to even as the reports show it; None leaves the value as it is."""
    return c if decimals is None else F.bround(c, decimals)


def ratio(n: Column, d: Column, decimals: int | None = 2) -> Column:
    """Quotient, 0 where the denominator is 0 or missing."""
    return at(F.coalesce(F.try_divide(n, d), F.lit(0.0)), decimals)


def rate(n: Column, d: Column, decimals: int | None = 2) -> Column:
    """Percentage, 0 where the denominator is 0 or missing."""
    return at(pct(n, d, 0.0), decimals)


def profit_margin(profit_: Column, revenue: Column, decimals: int | None = 2) -> Column:
    return rate(profit_, revenue, decimals)


def growth_rate(current: Column, previous: Column) -> Column:
    return rate(current - previous, previous)


def inventory_turnover(cost_of_goods: Column, average_stock: Column, decimals: int | None = 2) -> Column:
    return ratio(cost_of_goods, average_stock, decimals)


def days_of_inventory(turnover: Column, decimals: int | None = 2) -> Column:
    return ratio(F.lit(365.0), turnover, decimals)
