"""Backtests. Cutoffs are rows, not loops: one pass over the sparse series scores every model on
every cutoff. The actuals after a cutoff ride in the same group as its history (at most ``horizon``
entries), so forecasts are scored without joining back to the series.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions.metrics import accuracy_aggregates, pooled_aggregates, wape
from . import forecast as FC

CLASSICAL = ["naive", "seasonal_naive", "croston", "sba", "tsb"]
MIN_HISTORY = 730
MIN_MONTHS = 12


def _future(h: Column) -> Column:
    return F.coalesce(F.element_at("ahead", h), F.lit(0.0))


# ---------------------------------------------------------------- cutoffs

def fixed_cutoffs(series: DataFrame, cutoffs: list[str], horizon: int = S.HORIZON,
                  min_history: int = MIN_HISTORY, item="MDCODE", day="INVDT") -> DataFrame:
    """(item, cutoff) pairs with enough calendar days before and after."""
    span = series.groupBy(item).agg(F.min(day).alias("first"), F.max(day).alias("last"))
    points = F.array(*[F.lit(c).cast("date") for c in cutoffs])
    return span.select(item, "first", "last", F.explode(points).alias("cutoff")).where(
        (F.datediff("cutoff", "first") + 1 >= min_history)
        & (F.datediff("last", "cutoff") >= horizon)
    ).select(item, "cutoff")


def rolling_cutoffs(series: DataFrame, windows: int, horizon: int = S.HORIZON,
                    min_history: int = MIN_HISTORY, item="MDCODE", day="INVDT") -> DataFrame:
    """(item, cutoff) pairs at evenly spaced positions of each series' calendar."""
    span = series.groupBy(item).agg(F.min(day).alias("first"), F.max(day).alias("last"))
    n = F.datediff("last", "first") + 1
    lo, hi = F.lit(min_history - 1), n - horizon - 1
    count = F.least(F.lit(windows), hi - lo + 1)
    step = F.when(count > 1, (hi - lo) / (count - 1)).otherwise(0.0)
    index = F.transform(F.sequence(F.lit(0), count - 1),
                        lambda i: F.floor(lo + i * step).cast("int"))
    return span.where((n >= min_history + horizon) & (hi >= lo)).select(
        item, "first", F.explode(F.array_distinct(index)).alias("i")
    ).select(item, F.date_add("first", F.col("i")).alias("cutoff"))


# ---------------------------------------------------------------- daily

def _window_metrics(rows: DataFrame, decimals: int | None, interval: bool) -> DataFrame:
    p = ("P10", "P90") if interval else (None, None)
    return rows.groupBy("Model", "Cutoff_Date", "Medicine_ID").agg(
        *accuracy_aggregates("Actual", "Predicted", *p, decimals=decimals))


def _scored(state: DataFrame, horizon: int, min_history: int) -> DataFrame:
    """Horizon rows, with actuals, of the windows that have enough history and future."""
    enough = (F.col("n") >= min_history) & (F.datediff("last", "cutoff") >= horizon)
    return FC.over_horizon(state.where(enough), horizon).withColumn("Actual", _future(F.col("h")))


def _classical(rows: DataFrame, models, decimals) -> DataFrame:
    chosen = {m: c for m, c in FC.daily_models(F.col("h")).items() if m in (models or CLASSICAL)}
    return _window_metrics(rows.select(
        F.col("MDCODE").alias("Medicine_ID"), F.col("cutoff").alias("Cutoff_Date"), "Actual",
        FC.model_rows(chosen)), decimals, interval=False)


def _quantile(rows: DataFrame, decimals) -> DataFrame:
    levels = {f"quantile-{c}": F.col(c) for c in S.QUANTILE_COLUMNS}
    return rows.select(
        F.col("MDCODE").alias("Medicine_ID"), F.col("cutoff").alias("Cutoff_Date"),
        F.col("context").alias("Context_Length"), "P10", "P90", "Actual", FC.model_rows(levels),
    ).groupBy("Context_Length", "Model", "Cutoff_Date", "Medicine_ID").agg(
        *accuracy_aggregates("Actual", "Predicted", "P10", "P90", decimals=decimals))


def daily_backtest(series: DataFrame, cutoffs: list[str], horizon: int = S.HORIZON,
                   min_history: int = MIN_HISTORY, models: list[str] | None = None,
                   decimals: int | None = None) -> DataFrame:
    """One metric row per (model, cutoff, item) for the classical models."""
    state = FC.smoothing_state(FC.history_rows(series, cutoffs, horizon), horizon=horizon)
    return _classical(_scored(state, horizon, min_history), models, decimals)


def quantile_backtest(series: DataFrame, cutoffs: list[str], contexts: list[int],
                      horizon: int = S.HORIZON, min_history: int = MIN_HISTORY,
                      decimals: int | None = None) -> DataFrame:
    """Metric rows of the trailing-window quantile challenger, one model per level and context."""
    q = FC.window_quantiles(FC.history_rows(series, cutoffs, horizon), contexts, horizon=horizon)
    return _quantile(_scored(q, horizon, min_history), decimals)


def run_backtest(series: DataFrame, cutoffs: list[str], context: int = S.CONTEXT_LENGTH,
                 horizon: int = S.HORIZON, min_history: int = MIN_HISTORY,
                 decimals: int | None = None) -> DataFrame:
    """Classical models and the quantile challenger, from one state per (item, cutoff)."""
    state = FC.quantile_levels(FC.smoothing_state(
        FC.history_rows(series, cutoffs, horizon), horizon=horizon, recent=context), [context])
    rows = _scored(state, horizon, min_history)
    models = {**FC.daily_models(F.col("h")),
              **{f"quantile-{c}": F.col(c) for c in S.QUANTILE_COLUMNS}}
    long = rows.select(
        F.col("MDCODE").alias("Medicine_ID"), F.col("cutoff").alias("Cutoff_Date"), "Actual",
        "P10", "P90", FC.model_rows(models))
    # the point models carry no interval, so their coverage is 0
    covered = F.col("Model").startswith("quantile-")
    bound = {c: F.when(covered, F.col(c)) for c in ("P10", "P90")}
    return _window_metrics(long.withColumns(bound), decimals, interval=True)


def backtest_summary(windows: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """Per model: totals, mean window metrics, pooled WAPE."""
    df = windows.groupBy(*(extra or []), "Model").agg(
        F.count("*").alias("Windows"),
        F.count_distinct("Medicine_ID").alias("Medicines"),
        F.sum("Sample_Count").alias("Samples"),
        F.sum("Total_Actual").alias("Total_Actual"),
        F.sum("Total_Predicted").alias("Total_Predicted"),
        F.sum("Total_Absolute_Error").alias("Total_Absolute_Error"),
        F.avg("MAE").alias("MAE"), F.avg("sMAPE_Pct").alias("sMAPE_Pct"), F.avg("MBE").alias("MBE"),
        F.avg("P10_P90_Coverage_Pct").alias("P10_P90_Coverage_Pct"),
    )
    return df.withColumn("WAPE_Pct", wape(F.col("Total_Absolute_Error"), F.col("Total_Actual")))


def context_sweep(series: DataFrame, cutoffs: list[str], contexts: list[int],
                  horizon: int = S.HORIZON, min_history: int = MIN_HISTORY) -> DataFrame:
    """Pooled accuracy per (context length, quantile level)."""
    return backtest_summary(
        quantile_backtest(series, cutoffs, contexts, horizon, min_history), ["Context_Length"])


def best_context(sweep: DataFrame, model: str = "quantile-P50") -> DataFrame:
    return sweep.where(F.col("Model") == model).orderBy("WAPE_Pct", "Context_Length").limit(1)


# ---------------------------------------------------------------- monthly

def monthly_backtest(monthly: DataFrame, cutoffs: list[str], context: int | None = None,
                     which: str = "classical", min_months: int = MIN_MONTHS) -> DataFrame:
    """One-step monthly forecasts of the ``classical`` models, the ``quantile`` levels over the last
    ``context`` months, or ``both`` from one state per (item, cutoff)."""
    rows = FC.history_rows(monthly, cutoffs, 1, "month", "Medicine_ID", "Month", "Actual")
    levels = {f"quantile-{c}": F.col(c) for c in S.QUANTILE_COLUMNS}
    if which == "quantile":
        state, models = FC.window_quantiles(rows, [context], step="month", item="Medicine_ID",
                                            horizon=1), levels
    elif which in ("classical", "both"):
        state = FC.smoothing_state(rows, step="month", item="Medicine_ID", tail=12, horizon=1,
                                   recent=context if which == "both" else 0)
        models = FC.monthly_models()
        if which == "both":
            state, models = FC.quantile_levels(state, [context]), {**models, **levels}
    else:
        raise ValueError(f"unknown model family {which}")
    target = F.add_months("cutoff", 1)
    long = state.where((F.col("n") >= min_months) & (target <= F.col("last"))).select(
        F.col("cutoff").alias("Cutoff_Date"), target.alias("Forecast_Month"), "Medicine_ID",
        _future(F.lit(1)).alias("Actual"), FC.model_rows(models))
    predicted = F.greatest("Predicted", F.lit(0.0))
    return long.withColumn("Predicted", predicted).withColumn(
        "Absolute_Error", F.abs(F.col("Actual") - F.col("Predicted")))


def add_split(df: DataFrame, validation: list[str], holdout: list[str]) -> DataFrame:
    day = F.col("Cutoff_Date")
    inside = lambda dates: day.isin([F.lit(d).cast("date") for d in dates])
    return df.withColumn("Split", F.when(inside(validation), "validation")
                         .when(inside(holdout), "holdout").otherwise("unknown"))


def monthly_summary(results: DataFrame, validation: list[str], holdout: list[str]) -> DataFrame:
    """Per (model, cutoff)."""
    df = results.groupBy("Model", "Cutoff_Date").agg(
        F.count_distinct("Medicine_ID").alias("Medicines"),
        F.sum("Actual").alias("Actual"), F.sum("Predicted").alias("Predicted"),
        F.sum("Absolute_Error").alias("Absolute_Error"), F.avg("Absolute_Error").alias("MAE"))
    df = df.withColumns({
        "WAPE": wape(F.col("Absolute_Error"), F.col("Actual")),
        "Ratio": F.try_divide("Predicted", "Actual"),
        "MBE": F.col("Predicted") - F.col("Actual"),
    })
    return add_split(df, validation, holdout)


def split_summary(summary: DataFrame) -> DataFrame:
    """Per (split, model): totals over cutoffs, pooled WAPE and ratio."""
    return summary.groupBy("Split", "Model").agg(
        F.avg("Medicines").alias("Medicines"), F.sum("Actual").alias("Actual"),
        F.sum("Predicted").alias("Predicted"), F.sum("Absolute_Error").alias("Absolute_Error"),
        F.avg("MAE").alias("MAE"),
        wape(F.sum("Absolute_Error"), F.sum("Actual")).alias("WAPE"),
        F.try_divide(F.sum("Predicted"), F.sum("Actual")).alias("Ratio"))


def best_on_validation(split_rows: DataFrame) -> DataFrame:
    """Model with the lowest validation WAPE."""
    return split_rows.where(F.col("Split") == "validation").orderBy("WAPE", "Model").limit(1)


# ---------------------------------------------------------------- evaluation

def evaluate_forecast(actuals: DataFrame, forecast: DataFrame,
                      decimals: int | None = 2) -> DataFrame:
    """Per item and overall (Medicine_ID null, Is_Overall true); no overlap gives the overall row
    with zeros."""
    a = S.canonicalise(actuals).select(
        F.col("Medicine_ID").cast("string").alias("Medicine_ID"),
        F.to_date("Forecast_Date").alias("Forecast_Date"), F.col("Demand_Qty").alias("Actual"))
    f = forecast.withColumns({
        "Medicine_ID": F.col("Medicine_ID").cast("string"),
        "Forecast_Date": F.to_date("Forecast_Date")})
    has = "P10" in forecast.columns and "P90" in forecast.columns
    both = f.join(a, ["Medicine_ID", "Forecast_Date"])
    aggs = accuracy_aggregates("Actual", "Predicted_Demand", *(("P10", "P90") if has else (None, None)),
                               decimals=decimals)
    # a grouping set gives no overall row on empty input, a plain aggregate does
    label = lambda overall: F.lit(overall).alias("Is_Overall")
    per_item = both.groupBy("Medicine_ID").agg(
        F.lit(1).cast("bigint").alias("Medicines"), *aggs).select("*", label(False))
    overall = both.agg(F.count_distinct("Medicine_ID").alias("Medicines"), *aggs).select(
        F.lit(None).cast("string").alias("Medicine_ID"), "*", label(True))
    return per_item.unionByName(overall)


def pooled_by_model(results: DataFrame, keys=("Model",)) -> DataFrame:
    """WAPE, ratio and bias pooled over all rows of each model."""
    return results.groupBy(*keys).agg(*pooled_aggregates("Actual", "Predicted"))


# ---------------------------------------------------------------- scale audit

def scale_audit(history: DataFrame, forecast: DataFrame, days: int = 90) -> DataFrame:
    """Forecast level against recent demand, one row per item."""
    last = history.groupBy("MDCODE").agg(F.max("INVDT").alias("last"))
    recent = history.join(last, "MDCODE").where(F.datediff("last", "INVDT") < days).groupBy(
        F.col("MDCODE").alias("Medicine_ID")).agg(F.sum("Demand_Qty").alias("Recent_90D_Total"))
    p = F.col("Predicted_Demand")
    extra = [F.avg(c).alias(f"{c}_Daily_Mean") for c in ("P50", "P90") if c in forecast.columns]
    carried = [F.first(c).alias(c) for c in ("Selected_Model", "Validation_Advantage_Pct")
               if c in forecast.columns]
    level = forecast.groupBy("Medicine_ID").agg(
        *carried, F.sum(p).alias("Forecast_30D_Total"), F.avg(p).alias("Forecast_Daily_Mean"),
        *extra, F.min(p).alias("Forecast_Min"), F.max(p).alias("Forecast_Max"))
    out = level.join(recent, "Medicine_ID").withColumn(
        "Recent_90D_Daily_Mean", F.col("Recent_90D_Total") / days)
    ratio = F.when(F.col("Recent_90D_Daily_Mean") > 0,
                   F.col("Forecast_Daily_Mean") / F.col("Recent_90D_Daily_Mean"))
    return out.withColumn("Forecast_to_Recent_Ratio", ratio).withColumn(
        "Near_Zero", F.coalesce(ratio < 0.10, F.lit(False)))


def scale_audit_summary(audit: DataFrame) -> DataFrame:
    """Count, mean, median, min, max of the level columns per model."""
    from ..functions.quantiles import exact_quantiles
    from .quality import union_all

    columns = ["Recent_90D_Daily_Mean", "Forecast_Daily_Mean", "Forecast_to_Recent_Ratio"]
    long = audit.select("Selected_Model", F.inline(F.array(*[
        F.struct(F.lit(c).alias("Measure"), F.col(c).alias("Value")) for c in columns])))
    stats = long.groupBy("Selected_Model", "Measure").agg(
        F.count("Value").alias("count"), F.avg("Value").alias("mean"),
        F.min("Value").alias("min"), F.max("Value").alias("max"))
    tag = F.concat_ws("|", "Selected_Model", "Measure")
    medians = exact_quantiles(long.withColumn("tag", tag), "Value", [0.5], by="tag").select(
        "tag", F.col("value").alias("median"))
    return stats.withColumn("tag", tag).join(F.broadcast(medians), "tag", "left").drop("tag")
