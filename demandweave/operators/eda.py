"""Exploratory aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.quantiles import exact_quantiles
from .kpi import sum_by


def iqr_bounds(df: DataFrame, column: str, k: float = 1.5) -> DataFrame:
    """One row (Q1, Q3, lower, upper) from exact quartiles."""
    q = exact_quantiles(df, column, [0.25, 0.75]).agg(
        F.max(F.when(F.col("prob") == 0.25, F.col("value"))).alias("Q1"),
        F.max(F.when(F.col("prob") == 0.75, F.col("value"))).alias("Q3"),
    )
    iqr = F.col("Q3") - F.col("Q1")
    return q.withColumns({"Lower": F.col("Q1") - k * iqr, "Upper": F.col("Q3") + k * iqr})


def iqr_outliers(df: DataFrame, column: str, k: float = 1.5) -> DataFrame:
    """Rows outside the whiskers."""
    b = iqr_bounds(df, column, k).select(F.struct("Lower", "Upper").alias("b")).scalar()
    return df.where((F.col(column) < b["Lower"]) | (F.col(column) > b["Upper"]))


def top_share(df: DataFrame, key: str, amount: str, n: int = 20) -> DataFrame:
    """Top n keys with their share of the grand total."""
    whole = df.agg(F.sum(amount)).scalar()
    top = sum_by(df, key, amount, "Total").orderBy(F.col("Total").desc(), key).limit(n)
    return top.withColumn("Share_Pct", F.try_divide(F.col("Total"), whole) * 100)


def _labelled(kind_column: str, labels: dict) -> F.Column:
    """Several labellings of the same row, as generated rows of one grouping."""
    return F.explode(F.array(*[
        F.struct(F.lit(k).alias(kind_column), c.alias("Label")) for k, c in labels.items()]))


def period_totals(df: DataFrame, day: str, amount: str) -> DataFrame:
    """Daily, monthly and quarterly totals. Days are summed first, so the three labellings multiply
    calendar rows, not sales rows."""
    per_day = df.groupBy(day).agg(F.sum(amount).alias("t"))
    d = F.col(day)
    tag = _labelled("Period", {
        "day": F.date_format(d, "yyyy-MM-dd"), "month": F.date_format(d, "yyyy-MM"),
        "quarter": F.concat(F.year(d).cast("string"), F.lit("-Q"), F.quarter(d).cast("string")),
    })
    return per_day.select("t", tag.alias("p")).groupBy("p.Period", "p.Label").agg(
        F.sum("t").alias("Total"))


def seasonality(df: DataFrame, day: str, amount: str) -> DataFrame:
    """Totals and means by weekend flag, weekday name and month name."""
    per_day = df.groupBy(day).agg(F.sum(amount).alias("t"), F.count(amount).alias("n"))
    d = F.col(day)
    tag = _labelled("Kind", {
        "weekend": F.when(F.weekday(d) >= 5, "Weekend").otherwise("Weekday"),
        "weekday": F.date_format(d, "EEEE"), "month": F.date_format(d, "MMMM"),
    })
    return per_day.select("t", "n", tag.alias("p")).groupBy("p.Kind", "p.Label").agg(
        F.sum("t").alias("Total"), (F.sum("t") / F.sum("n")).alias("Average"))


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pairwise Pearson correlations (upper triangle with diagonal) in one pass."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    one = df.agg(*[F.corr(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    return one.select(F.inline(F.array(*[
        F.struct(F.lit(a).alias("Left_Column"), F.lit(b).alias("Right_Column"),
                 F.col(f"c{i}").alias("Correlation")) for i, (a, b) in enumerate(pairs)])))


def histogram(df: DataFrame, column: str, bins: int = 10) -> DataFrame:
    """Equal-width bin counts; the last bin includes the maximum. Empty bins are absent."""
    r = df.agg(F.struct(F.min(column).alias("lo"), F.max(column).alias("hi")).alias("r")).scalar()
    width = (r["hi"] - r["lo"]) / bins
    b = F.when(width > 0, F.least(
        F.floor((F.col(column) - r["lo"]) / width).cast("int") + 1, F.lit(bins))).otherwise(1)
    return df.where(F.col(column).isNotNull()).groupBy(b.alias("Bin")).agg(
        F.count("*").alias("Rows")).withColumns({
            "From": r["lo"] + (F.col("Bin") - 1) * width, "To": r["lo"] + F.col("Bin") * width})
