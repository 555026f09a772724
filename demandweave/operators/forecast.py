"""Forecasters.

Exponential smoothing of a series is a weighted sum whose weights depend only on distance from the
end: EWMA(u0; x) = (1-a)^m u0 + sum a (1-a)^(m-j) x_j. With ages measured from the end of history,
TSB, Croston and SBA therefore become ordinary aggregates over the *positive* rows: zero days appear
only as powers. No dense calendar, no Python worker, no recursion.

The one ordered quantity is how many positive days follow a row; it comes from one running count per
(item, cutoff), which shares its shuffle with the aggregate.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions.metrics import wape
from ..session import ship_by_value

ALPHA = 0.1
BETA = 0.1
PERIOD = 7


def _gap(step: str, hi, lo) -> Column:
    if step == "day":
        return F.datediff(hi, lo)
    return F.months_between(hi, lo).cast("int")


def _forward(step: str, start: Column, n: Column) -> Column:
    return F.date_add(start, n) if step == "day" else F.add_months(start, n)


# ---------------------------------------------------------------- history per cutoff

def history_rows(series: DataFrame, cutoffs: list[str] | None = None, horizon: int = 0,
                 step: str = "day", item="MDCODE", when="INVDT", qty="Demand_Qty") -> DataFrame:
    """Rows (item, cutoff, age, qty, first, last): age counts periods back from the cutoff and is
    negative for the ``horizon`` periods after it. Without cutoffs a series ends at its last row.

    Cutoffs are a parameter list, so the generated rows are a small multiple of the sparse series.
    """
    w = W.partitionBy(item)
    df = series.select(
        F.col(item), F.col(when).alias("at"), F.col(qty).cast("double").alias("qty"),
        F.min(when).over(w).alias("first"), F.max(when).over(w).alias("last"))
    if cutoffs is None:
        df = df.withColumn("cutoff", F.col("last"))
    else:
        points = F.array(*[F.lit(c).cast("date") for c in cutoffs])
        reachable = F.filter(points, lambda c: (
            (F.col("at") <= _forward(step, c, F.lit(horizon))) & (c >= F.col("first"))))
        df = df.withColumn("cutoff", F.explode(reachable))
    return df.select(item, "cutoff", "first", "last", "qty",
                     _gap(step, F.col("cutoff"), F.col("at")).alias("age"))


def smoothing_state(rows: DataFrame, alpha: float = ALPHA, beta: float = BETA, step: str = "day",
                    item="MDCODE", tail: int = PERIOD, horizon: int = 0,
                    recent: int = 0) -> DataFrame:
    """Sufficient statistics of every smoothing model, one row per (item, cutoff).

    n periods, k positive periods, f position of the first, z smoothed size, occ the recursive part
    of the occurrence probability, gap_part the recursive part of the interval, tail the last
    ``tail`` values (oldest first), ahead: quantities of the ``horizon`` periods after the cutoff, and
    recent: the positive values of the last ``recent`` periods, for the quantile challenger.
    """
    keys = [item, "cutoff"]
    past = F.col("age") >= 0
    hit = past & (F.col("qty") > 0)
    newest_first = W.partitionBy(*keys).orderBy("age")
    later = F.coalesce(
        F.sum(hit.cast("int")).over(newest_first.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    df = rows.withColumns({"hit": hit, "later": later})
    v = F.when(F.col("hit"), F.col("qty"))
    age = F.when(F.col("hit"), F.col("age"))
    n = _gap(step, F.first("cutoff"), F.first("first")) + 1
    size_weight = alpha * F.pow(F.lit(1 - alpha), F.col("later"))
    occ_weight = beta * F.pow(F.lit(1 - beta), F.col("age"))
    # sum_j a(1-a)^(k-j) (pos_j - pos_{j-1}), regrouped by position so that no lag is needed
    inner = F.when(F.col("later") == 0, -alpha * age).otherwise(
        alpha * alpha * F.pow(F.lit(1 - alpha), F.col("later") - 1) * age)
    total = lambda c: F.coalesce(F.sum(c), F.lit(0.0))
    aggs = [
        F.first("first").alias("first"), F.first("last").alias("last"),
        n.alias("n"),
        F.count(v).alias("k"),
        F.max(age).alias("oldest_age"),
        F.min(age).alias("newest_age"),
        F.max_by(v, age).alias("v1"),
        total(F.when(F.col("hit"), size_weight * F.col("qty"))).alias("size_sum"),
        total(F.when(F.col("hit"), occ_weight)).alias("occ"),
        total(F.when(F.col("hit"), inner)).alias("gap_sum"),
        total(v).alias("sum_qty"),
        F.array(*[total(F.when(F.col("age") == a, F.greatest("qty", F.lit(0.0))))
                  for a in range(tail - 1, -1, -1)]).alias("tail"),
    ]
    aggs += _lists(recent, horizon)
    df = df.groupBy(*keys).agg(*aggs)
    k = F.col("k")
    keep = lambda rate, m: F.pow(F.lit(1 - rate), m)
    position = lambda a: F.col("n") - 1 - F.col(a)
    df = df.withColumns({
        "f": position("oldest_age"),
        "z": F.when(k > 0, F.col("size_sum") + keep(alpha, k) * F.col("v1")).otherwise(0.0),
        # positions are n-1-age: the constant (n-1) carries total weight a*(1-a)^(k-1)
        "gap": F.col("gap_sum") + alpha * keep(alpha, k - 1) * (F.col("n") - 1)
        + alpha * keep(alpha, k - 1),
    })
    return df.withColumns({
        "interval": F.when(k > 0, F.col("gap") + keep(alpha, k) * (F.col("f") + 1)),
        "last_value": F.element_at("tail", -1),
    }).drop("size_sum", "gap_sum", "gap", "first")


def _lists(recent: int, horizon: int) -> list[Column]:
    """Collected per (item, cutoff): at most ``recent`` past values and ``horizon`` future ones."""
    age, qty, out = F.col("age"), F.col("qty"), []
    if recent:
        out.append(F.collect_list(F.when(
            age.between(0, recent - 1) & (qty > 0), F.struct("age", "qty"))).alias("recent"))
    if horizon:
        out.append(F.map_from_entries(F.collect_list(F.when(
            age < 0, F.struct((-age).alias("h"), qty.alias("q"))))).alias("ahead"))
    return out


# ---------------------------------------------------------------- models over the state

def croston() -> Column:
    return F.when(F.col("k") > 0, F.greatest(
        F.try_divide(F.col("z"), F.col("interval")), F.lit(0.0))).otherwise(0.0)


def sba(alpha: float = ALPHA) -> Column:
    return croston() * (1 - alpha / 2)


def tsb(beta: float = BETA, variant: str = "daily") -> Column:
    """Occurrence probability times size.

    ``daily``: starts at 1/(f+1), updated from position 0. ``router``: updated from f+1.
    ``monthly``: starts at one half, updated from position 0.
    """
    n, f = F.col("n"), F.col("f")
    keep = lambda m: F.pow(F.lit(1 - beta), m)
    if variant == "daily":
        p = keep(n) / (f + 1) + F.col("occ")
    elif variant == "router":
        p = keep(n - 1 - f) / (f + 1) + F.col("occ") - beta * keep(n - 1 - f)
    elif variant == "monthly":
        p = keep(n) * 0.5 + F.col("occ")
    else:
        raise ValueError(f"unknown TSB variant {variant}")
    return F.when(F.col("k") > 0, F.greatest(p * F.col("z"), F.lit(0.0))).otherwise(0.0)


def naive() -> Column:
    return F.greatest("last_value", F.lit(0.0))


def seasonal_naive(h: Column, period: int = PERIOD) -> Column:
    """Value one season back; a history shorter than a season repeats its last value."""
    return F.when(F.col("n") < period, naive()).otherwise(
        F.greatest(F.element_at("tail", F.pmod(h - 1, F.lit(period)).cast("int") + 1), F.lit(0.0)))


def monthly_croston() -> Column:
    """Mean size over mean interval; a single sale counts one interval of the whole history."""
    covered = F.when(F.col("k") == 1, F.col("n")).otherwise(F.col("n") - F.col("newest_age"))
    return F.when(F.col("k") > 0, F.col("sum_qty") / covered).otherwise(0.0)


def monthly_models() -> dict[str, Column]:
    """Next-month forecasts over a state whose tail holds 12 months."""
    return {
        "naive": naive(),
        "seasonal_naive": F.when(F.col("n") < 12, naive()).otherwise(F.element_at("tail", 1)),
        "croston": monthly_croston(),
        "sba": monthly_croston() * 0.95,
        "tsb": tsb(variant="monthly"),
    }


def daily_models(h: Column) -> dict[str, Column]:
    return {"naive": naive(), "seasonal_naive": seasonal_naive(h), "croston": croston(),
            "sba": sba(), "tsb": tsb()}


def model_rows(models: dict[str, Column]) -> Column:
    """Generator of (Model, Predicted) pairs."""
    return F.inline(F.array(*[
        F.struct(F.lit(m).alias("Model"), c.cast("double").alias("Predicted"))
        for m, c in models.items()]))


def over_horizon(state: DataFrame, horizon: int, item="MDCODE") -> DataFrame:
    """One row per future day of each (item, cutoff)."""
    return state.withColumn("h", F.explode(F.sequence(F.lit(1), F.lit(horizon)))).withColumn(
        "Forecast_Date", F.date_add("cutoff", F.col("h")))


def forecast_daily(series: DataFrame, models: list[str] | None = None, horizon: int = S.HORIZON,
                   alpha=ALPHA, beta=BETA, item="MDCODE") -> DataFrame:
    """Horizon rows of the classical daily models from the end of each series."""
    state = smoothing_state(history_rows(series, item=item), alpha, beta, item=item)
    rows = over_horizon(state, horizon)
    chosen = {m: c for m, c in daily_models(F.col("h")).items() if models is None or m in models}
    return rows.select(F.col(item).alias("Medicine_ID"), "Forecast_Date", "h", model_rows(chosen))


def forecast_tsb(series: DataFrame, horizon: int = S.HORIZON, alpha=ALPHA, beta=BETA,
                 variant: str = "daily", decimals: int | None = 2,
                 min_observations: int | None = None) -> DataFrame:
    """Production TSB. The router variant needs three days of history."""
    for name, value in (("alpha", alpha), ("beta", beta)):
        if not 0 < value <= 1:
            raise ValueError(f"{name} must lie in (0, 1]")
    if horizon < 1:
        raise ValueError("horizon must be positive")
    state = smoothing_state(history_rows(series), alpha, beta)
    if min_observations is None:
        min_observations = S.MIN_OBSERVATIONS if variant == "router" else 1
    point = tsb(beta, variant)
    point = point if decimals is None else F.bround(point, decimals)
    ok = state.where(F.col("n") >= min_observations).withColumn("Predicted_Demand", point)
    return over_horizon(ok, horizon).select(
        F.col("MDCODE").alias("Medicine_ID"), "Forecast_Date", "Predicted_Demand",
        F.col("n").alias("History_Days"))


# ---------------------------------------------------------------- quantile challenger

def _sorted_value(rank: Column, zeros: Column, values: Column) -> Column:
    """Order statistic of a window holding ``zeros`` zeros below its sorted positive values."""
    return F.when(rank < zeros, 0.0).otherwise(
        F.get(values, (rank - zeros).cast("int")))


def quantile_levels(state: DataFrame, contexts: list[int], levels=S.QUANTILE_LEVELS) -> DataFrame:
    """Empirical quantiles of the last ``context`` periods of each state row, zero periods included:
    one row per context. Zeros are counted, not generated."""
    df = state.withColumn("context", F.explode(F.array(*[F.lit(c) for c in contexts])))
    inside = F.filter("recent", lambda x: x["age"] < F.col("context"))
    df = df.withColumns({
        "values": F.array_sort(F.transform(inside, lambda x: x["qty"])),
        "length": F.least("n", "context"),
    })
    zeros, out = F.col("length") - F.size("values"), {}
    for level, name in zip(levels, _quantile_names(levels)):
        at = F.lit(level) * (F.col("length") - 1)
        lo = _sorted_value(F.floor(at), zeros, F.col("values"))
        hi = _sorted_value(F.ceil(at), zeros, F.col("values"))
        out[name] = lo + (hi - lo) * (at - F.floor(at))
    return df.withColumns(out).drop("values", "recent")


def window_quantiles(rows: DataFrame, contexts: list[int], levels=S.QUANTILE_LEVELS, step="day",
                     item="MDCODE", horizon: int = 0) -> DataFrame:
    """Quantile levels per (item, cutoff, context) straight from history rows."""
    n = _gap(step, F.first("cutoff"), F.first("first")) + 1
    state = rows.groupBy(item, "cutoff").agg(
        F.first("last").alias("last"), n.alias("n"), *_lists(max(contexts), horizon))
    return quantile_levels(state, contexts, levels)


def _quantile_names(levels) -> list[str]:
    return [f"P{int(round(q * 100))}" for q in levels]


def monotone_quantiles(df: DataFrame, columns=S.QUANTILE_COLUMNS) -> DataFrame:
    """Clip at 0, then running maximum across levels."""
    clipped = F.array(*[F.greatest(F.col(c), F.lit(0.0)) for c in columns])
    fixed = df.withColumn("__q", clipped)
    return fixed.withColumns({
        c: F.array_max(F.slice("__q", 1, i + 1)) for i, c in enumerate(columns)}).drop("__q")


def quantile_slot(history: DataFrame, fn: Callable, horizon: int = S.HORIZON,
                  context: int = S.CONTEXT_LENGTH, levels=S.QUANTILE_LEVELS,
                  point_level: float = 0.5, min_observations: int = S.MIN_OBSERVATIONS) -> DataFrame:
    """Pluggable quantile model: ``fn(values, horizon, levels) -> array (horizon, len(levels))``.

    ``history`` is any (MDCODE, INVDT, Demand_Qty) series; each item's last ``context`` days go, as
    one dense array, to a Python worker. A failing item yields one row with ``error`` set and
    leaves the others alone. Group size is bounded by ``context``.
    """
    import numpy as np
    import pandas as pd

    ship_by_value()
    names = _quantile_names(levels)
    schema = ("Medicine_ID string, Forecast_Date date, " + ", ".join(f"{c} double" for c in names)
              + ", Context_Length_Used int, error string")
    w = W.partitionBy("MDCODE")
    tail = history.withColumns({
        "first": F.min("INVDT").over(w), "last": F.max("INVDT").over(w)}).where(
        F.datediff("last", "INVDT") < context).select(
        F.col("MDCODE").cast("string").alias("MDCODE"), "INVDT", "Demand_Qty", "first", "last")

    def run(key, pdf):
        item = key[0]
        empty = {c: [None] for c in names}
        try:
            last = pd.Timestamp(pdf["last"].iloc[0])
            days = (last - pd.Timestamp(pdf["first"].iloc[0])).days + 1
            if days < min_observations:
                raise ValueError(f"{days} observations, minimum is {min_observations}")
            size = min(days, context)
            values = np.zeros(size)
            age = (last - pd.to_datetime(pdf["INVDT"])).dt.days.to_numpy()
            np.add.at(values, size - 1 - age, pdf["Demand_Qty"].to_numpy(dtype=float))
            q = np.asarray(fn(values, horizon, list(levels)), dtype=float)
            if q.shape != (horizon, len(levels)) or not np.isfinite(q).all():
                raise ValueError(f"model returned shape {q.shape} or non-finite values")
            dates = [(last + pd.Timedelta(days=h)).date() for h in range(1, horizon + 1)]
            return pd.DataFrame({"Medicine_ID": item, "Forecast_Date": dates,
                                 **{c: q[:, i] for i, c in enumerate(names)},
                                 "Context_Length_Used": size, "error": None})
        except Exception as e:  # noqa: BLE001  one item's failure is data, not a job failure
            return pd.DataFrame({"Medicine_ID": [item], "Forecast_Date": [None], **empty,
                                 "Context_Length_Used": [None], "error": [str(e)]})

    out = tail.groupBy("MDCODE").applyInPandas(run, schema)
    point = names[list(levels).index(point_level)]
    return monotone_quantiles(out, names).withColumn(
        "Predicted_Demand", F.bround(F.col(point), 2)).withColumns(
        {c: F.when(F.col("error").isNull(), F.col(c)) for c in [*names, "Predicted_Demand"]})


def split_failures(slot: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(forecast rows, failed ids with reason)."""
    return (slot.where(F.col("error").isNull()).drop("error"),
            slot.where(F.col("error").isNotNull()).select("Medicine_ID", "error"))


def last_week_mean(values, horizon, levels):
    """Deterministic stub model: mean of the last 7 days times twice the level."""
    import numpy as np

    return np.tile(np.mean(values[-7:]) * 2 * np.asarray(levels), (horizon, 1))


def native_quantile_forecast(series: DataFrame, horizon: int = S.HORIZON,
                             context: int = S.CONTEXT_LENGTH,
                             min_observations: int = S.MIN_OBSERVATIONS) -> DataFrame:
    """Challenger without a Python worker: trailing-window empirical quantiles, flat over the
    horizon. A series shorter than the minimum is left out."""
    q = window_quantiles(history_rows(series), [context]).where(F.col("n") >= min_observations)
    return over_horizon(q, horizon).select(
        F.col("MDCODE").alias("Medicine_ID"), "Forecast_Date",
        F.col("P50").alias("Predicted_Demand"), *S.QUANTILE_COLUMNS,
        F.col("length").alias("Context_Length_Used"))


# ---------------------------------------------------------------- one state for both routed models

def routable_state(series: DataFrame, context: int = S.CONTEXT_LENGTH,
                   min_observations: int = S.MIN_OBSERVATIONS) -> DataFrame:
    """One row per item (Medicine_ID) that serves the classical models and the native quantile challenger alike.
    Series shorter than the minimum are left out."""
    state = smoothing_state(history_rows(series), recent=context)
    levels = quantile_levels(state.where(F.col("n") >= min_observations), [context])
    return monotone_quantiles(levels).withColumnRenamed("MDCODE", "Medicine_ID")


def routed_rows(state: DataFrame, challenger: str, baseline: str, variant: str = "daily", horizon: int = S.HORIZON,
                fill: bool = False) -> DataFrame:
    """Horizon rows of ``routable_state`` with a Selected_Model: the challenger's quantiles and median, or the
    smoothed point, whose quantiles are the point (``fill``) or null. Items of any other model have no rows."""
    mine = F.col("Selected_Model") == challenger
    point = F.bround(F.when(mine, F.col("P50")).otherwise(tsb(BETA, variant)), 2)
    otherwise = F.col("Predicted_Demand") if fill else F.lit(None).cast("double")
    quantiles = {c: F.when(mine, F.col("Predicted_Demand") if fill and c == "P50" else F.col(c)).otherwise(otherwise)
                 for c in S.QUANTILE_COLUMNS}
    rows = state.where(F.col("Selected_Model").isin(challenger, baseline)).withColumn(
        "Predicted_Demand", point).withColumns({**quantiles, "Context_Length_Used": F.col("length")})
    return over_horizon(rows, horizon, "Medicine_ID")


# ---------------------------------------------------------------- calibration and ensemble

# --- fixed values ---
SHRINKAGE = [0.5, 1.0, 2.0, 4.0, 8.0, 16.0]
FACTOR_RANGE = (0.5, 1.5)
WEIGHTS = [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]
# --- end of fixed values ---


def calibration_factors(results: DataFrame) -> DataFrame:
    """Per-item factor Actual/Predicted on validation, clipped; empty ratios take the global one."""
    v = results.where(F.col("Split") == "validation")
    per = v.groupBy("Medicine_ID").agg(
        F.sum("Actual").alias("Validation_Actual"), F.sum("Predicted").alias("Validation_Predicted"),
        F.count("Predicted").alias("Validation_Samples"))
    # the global ratio comes from the per-item sums, not from another pass over the rows
    per = per.withColumn("Global_Factor", per.agg(F.try_divide(
        F.sum("Validation_Actual"), F.sum("Validation_Predicted"))).scalar())
    raw = F.coalesce(F.try_divide("Validation_Actual", "Validation_Predicted"), F.col("Global_Factor"))
    lo, hi = FACTOR_RANGE
    return per.withColumn("Raw_Factor", F.least(F.greatest(raw, F.lit(lo)), F.lit(hi)))


def calibration_study(results: DataFrame, lambdas=SHRINKAGE) -> DataFrame:
    """Raw, global and shrunken per-item calibration, scored on both splits in one pass.

    ``results`` holds one model's rows (Split, Medicine_ID, Actual, Predicted).
    """
    factors = calibration_factors(results).select(
        "Medicine_ID", "Raw_Factor", F.col("Validation_Samples").alias("samples"))
    glob = results.where(F.col("Split") == "validation").agg(
        F.try_divide(F.sum("Actual"), F.sum("Predicted"))).scalar()
    df = results.where(F.col("Split").isin("validation", "holdout")).join(
        factors, "Medicine_ID", "left").withColumn("g", glob)
    n = F.coalesce(F.col("samples"), F.lit(0))
    own = F.coalesce(F.col("Raw_Factor"), F.col("g"))
    ways = [("raw", F.lit(1.0), F.lit(1.0)), ("global", F.col("g"), F.col("g"))] + [
        ("item_shrinkage", F.lit(lam), F.col("g") + n / (n + lam) * (own - F.col("g")))
        for lam in lambdas]
    method = F.explode(F.array(*[
        F.struct(F.lit(m).alias("Method"), p.cast("double").alias("Parameter"),
                 f.cast("double").alias("factor")) for m, p, f in ways]))
    df = df.select("Split", "Actual", "Predicted", method.alias("m"))
    cal = F.greatest(F.col("Predicted") * F.col("m.factor"), F.lit(0.0))
    a = F.col("Actual")
    return df.groupBy("Split", "m.Method", "m.Parameter").agg(
        F.sum(a).alias("Actual"), F.sum(cal).alias("Predicted"),
        F.sum(F.abs(a - cal)).alias("Absolute_Error"),
        wape(F.sum(F.abs(a - cal)), F.sum(a)).alias("WAPE"),
        F.try_divide(F.sum(cal), F.sum(a)).alias("Ratio"),
        (F.sum(cal) - F.sum(a)).alias("MBE"),
    )


def ensemble_weights(comparison: DataFrame, weights=WEIGHTS, challenger="Challenger_Predicted",
                     baseline="Baseline_Predicted") -> DataFrame:
    """Validation WAPE of every weight, the best one flagged (lowest weight wins a tie)."""
    v = comparison.where(F.col("Split") == "validation").select(
        "Actual", challenger, baseline, F.explode(F.array(*map(F.lit, weights))).alias("w"))
    blend = F.col("w") * F.col(challenger) + (1 - F.col("w")) * F.col(baseline)
    err, act = F.abs(F.col("Actual") - blend), F.abs("Actual")
    table = v.groupBy("w").agg(wape(F.sum(err), F.sum(act)).alias("Validation_WAPE"))
    # one row per weight: the window sees as many rows as the weight list
    best = F.row_number().over(W.orderBy(F.col("Validation_WAPE").asc_nulls_last(), "w")) == 1
    return table.select(
        F.col("w").alias("Challenger_Weight"), F.bround(1 - F.col("w"), 1).alias("Baseline_Weight"),
        "Validation_WAPE", best.alias("Selected"))


def _with_best_weight(comparison: DataFrame, challenger: str, baseline: str, weights) -> DataFrame:
    best = ensemble_weights(comparison, weights, challenger, baseline).where("Selected")
    return comparison.withColumn("__w", best.select("Challenger_Weight").scalar())


def _blends(challenger: str, baseline: str) -> dict[str, Column]:
    c, b, best = F.col(challenger), F.col(baseline), F.col("__w")
    return {"challenger": c, "baseline": b, "simple_ensemble": 0.5 * c + 0.5 * b,
            "adaptive_ensemble": best * c + (1 - best) * b}


def ensemble_summary(comparison: DataFrame, weights=WEIGHTS, challenger="Challenger_Predicted",
                     baseline="Baseline_Predicted") -> DataFrame:
    """Both models, their mean and the validation-chosen blend, per split."""
    models = _blends(challenger, baseline)
    df = _with_best_weight(comparison, challenger, baseline, weights).select("Split", "Medicine_ID", "Actual", model_rows(models))
    a, p = F.col("Actual"), F.col("Predicted")
    return df.groupBy("Split", "Model").agg(
        F.count_distinct("Medicine_ID").alias("Medicines"), F.sum(a).alias("Actual"),
        F.sum(p).alias("Predicted"), F.sum(F.abs(a - p)).alias("Absolute_Error"),
        wape(F.sum(F.abs(a - p)), F.sum(F.abs(a))).alias("WAPE"))


def ensemble_by_item(comparison: DataFrame, weights=WEIGHTS, challenger="Challenger_Predicted",
                     baseline="Baseline_Predicted") -> DataFrame:
    """Holdout errors per item and whether the blend beats each model."""
    models = _blends(challenger, baseline)
    h = _with_best_weight(comparison, challenger, baseline, weights).where(
        F.col("Split") == "holdout").groupBy("Medicine_ID").agg(
        F.sum("Actual").alias("Actual"),
        *[F.sum(c).alias(f"{m}_predicted") for m, c in models.items()])
    h = h.withColumns({f"{m}_ae": F.abs(F.col("Actual") - F.col(f"{m}_predicted")) for m in models})
    ad = F.col("adaptive_ensemble_ae")
    return h.withColumns({
        "adaptive_beats_challenger": ad < F.col("challenger_ae"),
        "adaptive_beats_baseline": ad < F.col("baseline_ae"),
        "adaptive_beats_both": (ad < F.col("challenger_ae")) & (ad < F.col("baseline_ae")),
    })
