"""Demand series: construction, quality, calendars, profiles, regimes.

Grain argument used throughout: rows are first summed to (item, day), combining before the shuffle,
so from then on an item owns at most one row per calendar day. Per-item windows are bounded by the
calendar however hot the item is in the raw lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions.cleaning import not_cancelled, strip
from ..functions.guards import require_columns, require_no_violations, require_unique
from .joins import keys_without_match, merge_dimension
from .quality import check_series
from .warehouse import build_fact, build_fact_sales_line


# ---------------------------------------------------------------- T1

def prepare_demand(line: DataFrame, invoice: DataFrame, item: str = "MDCODE",
                   check: bool = False, by: list[str] = ()) -> DataFrame:
    """Daily demand (MDCODE, INVDT, Demand_Qty) of uncancelled lines on uncancelled invoices.

    ``item`` picks the series grain. ``check=True`` runs the key and value guards as jobs. ``by`` names key columns
    (INVNO, SOURCE_MONTH) that the sums are kept apart by and that lead the result's columns.
    """
    require_columns(line, ["INVNO", "SOURCE_MONTH", "QTY", "CANCEL_ID", item], "sales line")
    require_columns(invoice, ["INVNO", "SOURCE_MONTH", "INVDT", "CANCEL_ID"], "sales invoice")
    keys = ["INVNO", "SOURCE_MONTH"]
    trim_keys = {k: strip(F.col(k)) for k in keys}
    active = line.where(not_cancelled()).withColumns(trim_keys)
    heads = invoice.where(not_cancelled()).withColumns(trim_keys).select(*keys, "INVDT")
    if check:
        require_unique(heads, keys, "invoice")
    joined = merge_dimension(active.select(*keys, item, "QTY"), heads, keys, how="inner")
    day, qty = F.to_date("INVDT"), F.col("QTY").try_cast("double")
    if check:
        require_no_violations(joined.agg(
            F.count_if(day.isNull()).alias("invalid_dates"),
            F.count_if(qty.isNull()).alias("invalid_qty")), "demand lines")
    daily = joined.where(F.col(item).isNotNull()).groupBy(
        *by, F.col(item).alias("MDCODE"), day.alias("INVDT")
    ).agg(F.coalesce(F.sum(qty), F.lit(0.0)).alias("Demand_Qty"))
    if check:
        require_no_violations(check_series(daily), "daily demand")
    return daily


def colocated_demand(line: DataFrame, invoice: DataFrame, item: str = "MDCODE") -> DataFrame:
    """``prepare_demand`` of landed lines and invoices that are stored bucketed alike on INVNO, keys stripped
    (``sources.tables.store_colocated``).

    Both dedupes group by keys that begin with the bucketing's and the join is on it, the month a condition, so all three
    work bucket by bucket: the only shuffle is that of the sums to (item, day), combined before. The join is a merge whatever the
    sides' size, as a broadcast would give up what the storage has paid for.
    """
    keys = ["INVNO", "SOURCE_MONTH"]
    require_columns(line, [*keys, "MDCODE", "BATCH", "QTY", "CANCEL_ID", item], "sales line")
    require_columns(invoice, [*keys, "INVDT", "CANCEL_ID"], "sales invoice")
    heads = build_fact(invoice, [*keys, "INVDT", "CANCEL_ID"], keys).where(not_cancelled()).select(*keys, "INVDT")
    lines = build_fact_sales_line(line, extra=[item]).where(not_cancelled()).select(*keys, item, "QTY")
    joined = merge_dimension(lines, heads.hint("merge"), keys, how="inner", by_first=True)
    return joined.where(F.col(item).isNotNull()).groupBy(
        F.col(item).alias("MDCODE"), F.to_date("INVDT").alias("INVDT")
    ).agg(F.coalesce(F.sum(F.col("QTY").try_cast("double")), F.lit(0.0)).alias("Demand_Qty"))


def unmatched_line_keys(line: DataFrame, invoice: DataFrame) -> DataFrame:
    """Active line keys without an active invoice: reported, not fatal."""
    return keys_without_match(line.where(not_cancelled()), invoice.where(not_cancelled()),
                              ["INVNO", "SOURCE_MONTH"])


# ---------------------------------------------------------------- T2, T3

def series_quality(daily: DataFrame) -> DataFrame:
    """Observed-day statistics per item, with class and candidate flag."""
    q = F.col("Demand_Qty")
    df = daily.groupBy("MDCODE").agg(
        F.min("INVDT").alias("first_sale_date"),
        F.max("INVDT").alias("last_sale_date"),
        F.count("*").alias("observation_count"),
        F.count_if(q > 0).alias("active_days"),
        F.count_if(q == 0).alias("zero_days_observed"),
        F.sum(q).alias("total_demand"),
        F.avg(q).alias("mean_demand"),
        F.percentile(q, 0.5).alias("median_demand"),
        F.stddev_samp(q).alias("std_demand"),
        F.max(q).alias("max_demand"),
    )
    span = F.datediff("last_sale_date", "first_sale_date") + 1
    df = df.withColumn("calendar_days", span)
    df = df.withColumns({
        "missing_days": F.col("calendar_days") - F.col("observation_count"),
        "activity_rate": F.col("observation_count") / F.col("calendar_days"),
        "demand_activity_rate": F.col("active_days") / F.col("calendar_days"),
    })
    return classify_series(df)


def classify_series(quality: DataFrame, min_obs=30, sparse_obs=90, high_rate=0.05, rate=0.20,
                    candidate_obs=90, candidate_days=180) -> DataFrame:
    n, r = F.col("observation_count"), F.col("demand_activity_rate")
    return quality.withColumns({
        "series_class": F.when(n < min_obs, "INSUFFICIENT_HISTORY")
        .when(n < sparse_obs, "SPARSE_HISTORY")
        .when(r < high_rate, "HIGHLY_INTERMITTENT")
        .when(r < rate, "INTERMITTENT")
        .otherwise("REGULAR"),
        "forecast_candidate": (n >= candidate_obs) & (F.col("calendar_days") >= candidate_days),
    })


def candidates_only(daily: DataFrame, quality: DataFrame) -> DataFrame:
    keep = quality.where("forecast_candidate").select("MDCODE")
    return daily.join(keep, "MDCODE", "left_semi")


# ---------------------------------------------------------------- calendars

def fill_calendar(df: DataFrame, item: str, when: str, qty: str, step: str = "day") -> DataFrame:
    """Dense series from first to last observation, gaps filled with 0.

    Each row generates its own gap up to the next observation, so the dense rows are produced
    map-side after one shuffle of the sparse rows; no calendar table, no join on (item, day).
    """
    nxt = F.lead(when).over(W.partitionBy(item).orderBy(when))
    if step == "day":
        stop, every = F.coalesce(F.date_sub(nxt, 1), F.col(when)), F.expr("interval 1 day")
    else:
        stop = F.coalesce(F.add_months(nxt, -1), F.col(when))
        every = F.expr("interval 1 month")
    spans = df.select(item, when, qty, stop.alias("__stop"))
    out = spans.select(item, F.col(when).alias("__at"), qty,
                       F.explode(F.sequence(F.col(when), F.col("__stop"), every)).alias(when))
    value = F.when(F.col(when) == F.col("__at"), F.col(qty)).otherwise(0.0)
    return out.select(item, when, value.alias(qty))


def forecasting_series(daily: DataFrame, quality: DataFrame | None = None) -> DataFrame:
    """Dense daily series of the forecast candidates."""
    quality = series_quality(daily) if quality is None else quality
    return fill_calendar(candidates_only(daily, quality), "MDCODE", "INVDT", "Demand_Qty")


def monthly_demand(daily: DataFrame) -> DataFrame:
    """Dense monthly totals (MDCODE, Month, Demand_Qty)."""
    m = daily.groupBy("MDCODE", F.trunc("INVDT", "month").alias("Month")).agg(
        F.sum("Demand_Qty").alias("Demand_Qty"))
    return fill_calendar(m, "MDCODE", "Month", "Demand_Qty", "month")


def monthly_experiment(daily: DataFrame) -> DataFrame:
    """Monthly series under the names of the model studies."""
    return monthly_demand(daily).withColumnsRenamed(
        {"MDCODE": "Medicine_ID", "Demand_Qty": "Actual"})


def monthly_statistics(monthly: DataFrame) -> DataFrame:
    a = F.col("Actual")
    df = monthly.groupBy("Medicine_ID").agg(
        F.count(a).alias("count"), F.avg(a).alias("mean"), F.stddev_samp(a).alias("std"),
        F.sum(a).alias("sum"),
        (F.count_if(a == 0) * 100.0 / F.count("*")).alias("Zero_Month_Pct"),
    )
    ratio = F.try_divide("std", "mean")
    return df.withColumn("CV2", ratio * ratio)


# ---------------------------------------------------------------- T7-T10

def classify_demand(adi: Column, cv2: Column, labels=("SMOOTH", "ERRATIC", "INTERMITTENT", "LUMPY"),
                    adi_cut: float = S.ADI_CUT, cv2_cut: float = S.CV2_CUT) -> Column:
    smooth, erratic, intermittent, lumpy = labels
    return (
        F.when((adi < adi_cut) & (cv2 < cv2_cut), smooth)
        .when(adi < adi_cut, erratic)
        .when(cv2 < cv2_cut, intermittent)
        .otherwise(lumpy)
    )


def _with_bounds(series: DataFrame) -> DataFrame:
    item = W.partitionBy("MDCODE")
    return series.withColumns({
        "first_date": F.min("INVDT").over(item), "last_date": F.max("INVDT").over(item)})


def demand_profile(series: DataFrame) -> DataFrame:
    """25-column profile per item.

    Works on the sparse series: zero days enter only through day positions, so the dense calendar
    is never built. The window and the aggregate share one shuffle by item.
    """
    q = F.col("Demand_Qty")
    v = F.when(q > 0, q)
    days = F.datediff("last_date", "first_date") + 1
    age = F.datediff("last_date", "INVDT")
    early = F.datediff("INVDT", "first_date") < F.floor(days / 2)
    recent = lambda n: F.coalesce(F.sum(F.when(age < n, q)), F.lit(0.0)).alias(f"recent_{n}_demand")
    df = _with_bounds(series).groupBy("MDCODE").agg(
        F.first("first_date").alias("first_date"),
        F.first("last_date").alias("last_date"),
        F.first(days).alias("calendar_days"),
        F.sum(q).alias("total_demand"),
        F.count(v).alias("positive_demand_days"),
        F.coalesce(F.avg(v), F.lit(0.0)).alias("mean_positive_demand"),
        F.coalesce(F.percentile(v, 0.5), F.lit(0.0)).alias("median_positive_demand"),
        F.coalesce(F.stddev_samp(v), F.lit(0.0)).alias("std_positive_demand"),
        recent(30), recent(90), recent(180), recent(365),
        F.coalesce(F.sum(F.when(early, q)), F.lit(0.0)).alias("__early"),
        F.coalesce(F.sum(F.when(~early, q)), F.lit(0.0)).alias("__late"),
    )
    n, pos = F.col("calendar_days"), F.col("positive_demand_days")
    mid = F.floor(n / 2)
    cv = F.coalesce(F.try_divide("std_positive_demand", "mean_positive_demand"), F.lit(0.0))
    adi = F.when(pos > 0, n / pos).otherwise(F.lit(float("inf")))
    df = df.withColumns({
        "zero_demand_days": n - pos,
        "demand_activity_rate": pos / n,
        "zero_demand_ratio": (n - pos) / n,
        "cv": cv,
        "cv2": cv * cv,
        "adi": adi,
        "avg_daily_demand": F.col("total_demand") / n,
        "first_half_avg": F.when(mid >= 2, F.col("__early") / mid).otherwise(0.0),
        "second_half_avg": F.when(mid >= 2, F.col("__late") / (n - mid)).otherwise(0.0),
    })
    recent_avg = F.col("recent_365_demand") / F.least(F.lit(365), n)
    zero = F.lit(0.0)
    return df.withColumns({
        "recent_vs_historical_ratio": F.coalesce(
            F.try_divide(recent_avg, F.col("avg_daily_demand")), zero),
        "trend_ratio": F.coalesce(F.try_divide("second_half_avg", "first_half_avg"), zero),
        "demand_class": classify_demand(F.col("adi"), F.col("cv2")),
    }).drop("__early", "__late")


def demand_regimes(series: DataFrame, ddof: int = 1, empty_cv2: float | None = None) -> DataFrame:
    """ADI / CV2 regime per item; ``ddof=0`` is the population variant, whose CV2 without demand
    is infinite."""
    q = F.col("Demand_Qty")
    v = F.when(q > 0, q)
    var = F.var_samp(v) if ddof == 1 else F.var_pop(v)
    if empty_cv2 is None:
        empty_cv2 = 0.0 if ddof == 1 else float("inf")
    df = series.groupBy("MDCODE").agg(
        (F.datediff(F.max("INVDT"), F.min("INVDT")) + 1).alias("Days"),
        F.count(v).alias("NonZero_Days"),
        F.avg(v).alias("__mean"), var.alias("__var"),
        F.sum(q).alias("Total_Demand"),
    )
    adi = F.when(F.col("NonZero_Days") > 0, F.col("Days") / F.col("NonZero_Days")).otherwise(
        F.lit(float("inf")))
    cv2 = F.when(F.col("NonZero_Days") == 0, F.lit(empty_cv2)).otherwise(
        F.coalesce(F.col("__var") / (F.col("__mean") * F.col("__mean")), F.lit(0.0)))
    df = df.withColumns({"ADI": adi, "CV2": cv2})
    labels = ("Smooth", "Erratic", "Intermittent", "Lumpy")
    return df.withColumn("Regime", classify_demand(F.col("ADI"), F.col("CV2"), labels)).select(
        F.col("MDCODE").alias("Medicine_ID"), "Days", "NonZero_Days", "ADI", "CV2", "Total_Demand",
        "Regime")


def regime_summary(regimes: DataFrame) -> DataFrame:
    return regimes.groupBy("Regime").agg(
        F.count("Medicine_ID").alias("Medicines"), F.avg("ADI").alias("Avg_ADI"),
        F.avg("CV2").alias("Avg_CV2"), F.sum("Total_Demand").alias("Total_Demand"))


# ---------------------------------------------------------------- T11-T13

def prepare_history(history: DataFrame, mode: str = "strict", dense: bool = False) -> DataFrame:
    """Forecast input (MDCODE, INVDT, Demand_Qty), one row per item and day.

    ``lenient`` drops unusable rows and lifts negatives to 0 before adding up a day;
    ``strict`` rejects them (one violations job).
    """
    df = S.canonicalise(history)
    require_columns(df, ["Medicine_ID", "Forecast_Date", "Demand_Qty"], "history")
    df = df.select(
        strip(F.col("Medicine_ID").cast("string")).alias("MDCODE"),
        F.to_date(F.col("Forecast_Date").try_cast("timestamp")).alias("INVDT"),
        F.col("Demand_Qty").try_cast("double").alias("Demand_Qty"),
    )
    q = F.col("Demand_Qty")
    unusable = (
        F.col("MDCODE").isNull() | (F.col("MDCODE") == "") | F.col("INVDT").isNull()
        | q.isNull() | F.isnan(q) | (F.abs(q) == float("inf"))
    )
    if mode == "lenient":
        df = df.where(~unusable).withColumn("Demand_Qty", F.greatest(q, F.lit(0.0)))
    elif mode == "strict":
        require_no_violations(check_series(df).drop("duplicate_day"), "history")
    else:
        raise ValueError(f"unknown mode {mode}")
    df = df.groupBy("MDCODE", "INVDT").agg(F.sum("Demand_Qty").alias("Demand_Qty"))
    return fill_calendar(df, "MDCODE", "INVDT", "Demand_Qty") if dense else df


def context_window(series: DataFrame, length: int = S.CONTEXT_LENGTH,
                   min_observations: int = S.MIN_OBSERVATIONS) -> DataFrame:
    """Last ``length`` calendar days of each series whose dense history is long enough."""
    df = _with_bounds(series)
    days = F.datediff("last_date", "first_date") + 1
    age = F.datediff("last_date", "INVDT")
    return df.where((age < length) & (days >= min_observations)).drop("first_date", "last_date")
