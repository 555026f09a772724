"""Window features of a daily series. Rows per item are bounded by the calendar; all frames of one
call share one shuffle and one sort. The ``sparse_`` forms take observed days only and count the days between as
zeros; their frames are ranges of calendar days."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

LAGS = [1, 2, 3, 7, 14, 30]
WINDOWS = [7, 14, 30]
EXTREME_WINDOWS = [7, 30]
CALENDAR_FLAGS = ["is_month_start", "is_month_end", "is_quarter_end", "is_year_end"]


def _order(item: str, day: str):
    return W.partitionBy(item).orderBy(day)


def lag_features(df: DataFrame, item="MDCODE", day="INVDT", qty="Demand_Qty", lags=LAGS):
    w = _order(item, day)
    return df.withColumns({f"Lag_{k}": F.lag(qty, k).over(w) for k in lags})


def rolling_features(df: DataFrame, item="MDCODE", day="INVDT", qty="Demand_Qty",
                     windows=WINDOWS, extremes=EXTREME_WINDOWS) -> DataFrame:
    """Trailing statistics that exclude the current row."""
    w = _order(item, day)
    out = {}
    for n in windows:
        out[f"Rolling_Mean_{n}"] = F.avg(qty).over(w.rowsBetween(-n, -1))
        out[f"Rolling_STD_{n}"] = F.stddev_samp(qty).over(w.rowsBetween(-n, -1))
    for n in extremes:
        out[f"Rolling_Max_{n}"] = F.max(qty).over(w.rowsBetween(-n, -1))
        out[f"Rolling_Min_{n}"] = F.min(qty).over(w.rowsBetween(-n, -1))
    return df.withColumns(out)


def _span(item: str, day: str, least: int, most: int):
    """Frame over the calendar days from ``least`` to ``most`` days before the row's own."""
    return W.partitionBy(item).orderBy(F.unix_date(F.col(day))).rangeBetween(-most, -least)


def _age(item: str, day: str):
    """Calendar days since the item's first observation."""
    return F.unix_date(F.col(day)) - F.min(F.unix_date(F.col(day))).over(W.partitionBy(item))


def sparse_lag_features(df: DataFrame, item="MDCODE", day="INVDT", qty="Demand_Qty", lags=LAGS):
    """Demand of the day ``k`` calendar days before: 0 where nothing was observed, null before the first
    observation. The observed days' rows of ``lag_features`` on the dense series, without that series.

    One row per item and day is expected; a null day has null lags, a null demand counts as 0.
    """
    age = _age(item, day)
    known = F.coalesce(F.col(qty), F.lit(0.0))
    return df.withColumns({
        f"Lag_{k}": F.when(age >= k, F.coalesce(F.max(known).over(_span(item, day, k, k)), F.lit(0.0)))
        for k in lags})


def sparse_rolling_features(df: DataFrame, item="MDCODE", day="INVDT", qty="Demand_Qty",
                            windows=WINDOWS, extremes=EXTREME_WINDOWS) -> DataFrame:
    """Trailing statistics over calendar days that exclude the row's own, from observed days alone: what
    ``rolling_features`` gives on the dense series at the observed days.

    A frame covers min(n, age) days; those without a row are zeros and enter by arithmetic. With k observed
    days of mean m and squared deviations v, and z zeros, the deviations of all are v + m^2 * k * z / (k + z).
    No day is generated, so rows and frames are bounded by the observed days.

    One row per item and day is expected; a null day has null statistics, a null demand counts as 0.
    """
    age = _age(item, day)
    known = F.coalesce(F.col(qty), F.lit(0.0))
    out = {}
    for n in sorted({*windows, *extremes}):
        frame = _span(item, day, 1, n)
        days = F.when(age.isNotNull(), F.least(age, F.lit(n)))
        seen = F.count(known).over(frame)
        zeros = days - seen
        if n in windows:
            mean = F.coalesce(F.avg(known).over(frame), F.lit(0.0))
            own = F.coalesce(F.var_pop(known).over(frame), F.lit(0.0)) * seen
            out[f"Rolling_Mean_{n}"] = F.when(days > 0, mean * seen / days)
            out[f"Rolling_STD_{n}"] = F.when(
                days > 1, F.sqrt((own + mean * mean * seen * zeros / days) / (days - 1)))
        if n in extremes:
            for name, pick, edge in (("Max", F.max, F.greatest), ("Min", F.min, F.least)):
                found = pick(known).over(frame)
                # both skip a null, so a frame without rows is zeros alone
                out[f"Rolling_{name}_{n}"] = F.when(
                    days > 0, F.when(zeros > 0, edge(found, F.lit(0.0))).otherwise(found))
    return df.withColumns(out)


def trend_features(df: DataFrame, item="MDCODE", day="INVDT", qty="Demand_Qty") -> DataFrame:
    w = _order(item, day)
    q, prev = F.col(qty), F.lag(qty).over(w)
    return df.withColumns({
        "Demand_Diff_1": q - prev,
        "Demand_Growth_Rate": F.try_divide(q - prev, prev),
        "Weekly_Trend": q - F.lag(qty, 7).over(w),
    })


def calendar_features(df: DataFrame, dates: DataFrame, day="INVDT") -> DataFrame:
    """Calendar flags by day. The calendar is one row per day of the span, which bounds what is
    broadcast."""
    flags = dates.select(F.col("full_date").alias("__day"), *CALENDAR_FLAGS)
    return df.join(F.broadcast(flags), F.col(day) == F.col("__day"), "left").drop("__day")


def price_features(df: DataFrame, item="MDCODE", day="INVDT", selling="Selling_Rate",
                   purchase="Purchase_Rate", mrp="Maximum_Retail_Price") -> DataFrame:
    s, p, m = F.col(selling), F.col(purchase), F.col(mrp)
    prev = F.lag(selling).over(_order(item, day))
    return df.withColumns({
        "Profit_Margin": s - p,
        "Profit_Percentage": F.try_divide(s - p, p) * 100,
        "Discount_Percentage": F.try_divide(m - s, m) * 100,
        "Price_Change": s - prev,
        "Price_Growth": F.try_divide(s - prev, prev),
    })


def item_features(df: DataFrame, item="MDCODE", day="INVDT", qty="Demand_Qty") -> DataFrame:
    """Whole-series statistics on every row, over an unordered window (one shuffle, no join)."""
    w = W.partitionBy(item)
    return df.withColumns({
        "Medicine_Frequency": F.count("*").over(w),
        "Medicine_Avg_Demand": F.avg(qty).over(w),
        "Medicine_Demand_STD": F.stddev_samp(qty).over(w),
        "Medicine_Max_Demand": F.max(qty).over(w),
        # one row per (item, day), so counting days counts distinct days
        "Medicine_Selling_Days": F.count(day).over(w),
    })


def last_rows(df: DataFrame, n: int, item="MDCODE", day="INVDT") -> DataFrame:
    """Last n rows of each series."""
    rn = F.row_number().over(W.partitionBy(item).orderBy(F.col(day).desc()))
    return df.withColumn("__rn", rn).where(F.col("__rn") <= n).drop("__rn")
