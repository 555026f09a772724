"""Production forecasts and the queries served from the published table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions.guards import ContractError
from ..functions.numbering import global_row_number
from ..session import cut_lineage
from . import forecast as FC
from . import routing as R
from .series import prepare_history

TREND_THRESHOLD = 5.0


# ---------------------------------------------------------------- routed batch forecast

def forecast_batch(history: DataFrame, routing: DataFrame, form: str = "service",
                   ids: DataFrame | None = None, horizon: int = S.HORIZON,
                   context: int = S.CONTEXT_LENGTH, challenger: str = R.CHALLENGER,
                   baseline: str = R.BASELINE, model: Callable | None = None,
                   generated_at: Column | None = None,
                   min_observations: int = S.MIN_OBSERVATIONS,
                   slot: Callable = FC.quantile_slot) -> tuple[DataFrame, DataFrame]:
    """(forecast rows, failed ids with reason).

    ``service``: strict history, every item of the history (or ``ids``), baseline quantiles null.
    ``router``: lenient history, items of the routing table, baseline quantiles equal the point.
    Without ``model`` an item has one state, from which its routed model's rows are computed: the history is grouped
    once and decisions meet one row per item. With ``model``, challenger items go through the Python slot;
    ``slot=batched_quantile_slot`` calls it for many items at once.
    """
    if form not in ("service", "router"):
        raise ValueError(f"unknown form {form}")
    series = prepare_history(history, "strict" if form == "service" else "lenient")
    wanted = ids.select(F.col("Medicine_ID").cast("string")).distinct() if ids is not None else (
        routing.select("Medicine_ID").distinct() if form == "router"
        else series.select(F.col("MDCODE").alias("Medicine_ID")).distinct())
    decided = R.routing_decisions(routing, challenger, baseline)
    with_fallback = lambda df: df.withColumns({
        "Selected_Model": F.coalesce("Selected_Model", F.lit(baseline)),
        "Reason": F.coalesce("Reason", F.lit(
            f"No valid validation advantage available; using {baseline} fallback")),
        "Routing_Rule": F.coalesce("Routing_Rule", F.lit(R.rule_name(challenger, baseline)))})
    variant = "router" if form == "router" else "daily"
    broken = None
    if model is None:
        every = form == "service" and ids is None
        chosen = series if every else series.join(
            wanted.select(F.col("Medicine_ID").alias("MDCODE")), "MDCODE", "left_semi")
        state = FC.routable_state(chosen, context, min_observations)
        rows = FC.routed_rows(with_fallback(state.join(decided, "Medicine_ID", "left")), challenger,
                              baseline, variant, horizon, fill=form == "router")
    else:
        decisions = with_fallback(decided.join(wanted, "Medicine_ID", "right"))
        routed = series.join(decisions.select(
            F.col("Medicine_ID").alias("MDCODE"), "Selected_Model"), "MDCODE")
        mine = lambda m: routed.where(F.col("Selected_Model") == m).drop("Selected_Model")
        point = FC.forecast_tsb(mine(baseline), horizon, decimals=2, variant=variant,
                                min_observations=min_observations)
        fill = F.col("Predicted_Demand") if form == "router" else F.lit(None).cast("double")
        point = point.select("Medicine_ID", "Forecast_Date", "Predicted_Demand",
                             *[fill.alias(c) for c in S.QUANTILE_COLUMNS],
                             F.least("History_Days", F.lit(context)).alias("Context_Length_Used"))
        # stored: the model runs once per item, whoever asks for rows or for failures
        prob, broken = FC.split_failures(cut_lineage(slot(
            mine(challenger), model, horizon, context, min_observations=min_observations)))
        rows = point.unionByName(prob.select(*point.columns)).join(decisions, "Medicine_ID")
    rows = rows.withColumns({
        "Prediction_Length": F.lit(horizon),
        "Forecast_Type": F.when(F.col("Selected_Model") == challenger, "probabilistic").otherwise(
            "point"),
        "Model_ID": F.col("Selected_Model"),
        "Generated_At": F.current_timestamp() if generated_at is None else generated_at,
    })
    # told from the history and the model's own failures, so asking for them forecasts nothing again
    seen = series.groupBy(F.col("MDCODE").alias("Medicine_ID")).agg(
        (F.datediff(F.max("INVDT"), F.min("INVDT")) + 1).alias("days"))
    reason = F.when(F.col("days").isNull(), F.lit("no usable history")).when(
        F.col("days") < min_observations,
        F.concat(F.col("days").cast("string"), F.lit(f" days of history, minimum is {min_observations}")))
    failed = wanted.join(seen, "Medicine_ID", "left").select("Medicine_ID", reason.alias("reason"))
    if broken is not None:
        failed = failed.join(broken, "Medicine_ID", "left").select(
            "Medicine_ID", F.coalesce("reason", "error").alias("reason"))
    failed = failed.where("reason is not null")
    common = ["Medicine_ID", "Forecast_Date", "Predicted_Demand"]
    if form == "service":
        out = rows.select(
            *common, "Selected_Model", "P10", "P50", "P90",
            F.col("Validation_Advantage_Pct").alias("Routing_Advantage_Pct"),
            F.col("Reason").alias("Routing_Reason"), "Context_Length_Used", "Prediction_Length",
            "Generated_At")
    else:
        out = rows.select(
            *common, *S.QUANTILE_COLUMNS, "Selected_Model", "Forecast_Type", "Routing_Rule",
            "Validation_Advantage_Pct", F.col("Reason").alias("Routing_Reason"),
            "Context_Length_Used", "Prediction_Length", "Model_ID", "Generated_At")
    return out, failed


def forecast_one(history: DataFrame, routing: DataFrame, medicine_id: str, **kw):
    """Single-item form: the filter reaches the scan, then the batch form runs on one item."""
    df = S.canonicalise(history).where(F.trim(F.col("Medicine_ID").cast("string")) == medicine_id)
    return forecast_batch(df, routing.where(F.col("Medicine_ID") == medicine_id), **kw)


# ---------------------------------------------------------------- stored forecast

def repair_snapshot(forecast: DataFrame) -> DataFrame:
    """Fill columns older snapshots lack."""
    df = forecast
    if "Selected_Model" not in df.columns and "Model_ID" in df.columns:
        df = df.withColumn("Selected_Model", F.col("Model_ID"))
    if "Prediction_Length" not in df.columns:
        from pyspark.sql import Window as W
        # rows per item are bounded by the horizon
        df = df.withColumn("Prediction_Length",
                           F.count("*").over(W.partitionBy("Medicine_ID")).cast("int"))
    return df.withColumns({"Medicine_ID": F.trim(F.col("Medicine_ID").cast("string")),
                           "Forecast_Date": F.to_date("Forecast_Date")})


def _days() -> Column:
    return F.array_sort(F.collect_list(F.struct(F.col("Forecast_Date").alias("d"),
                                                F.col("Predicted_Demand").cast("double").alias("v"))))


def _mean(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + v) / F.size(values)


def forecast_summary(forecast: DataFrame) -> DataFrame:
    """Totals, half means and trend per item; one grouping, at most ``horizon`` days collected per
    item."""
    carried = [F.first(c).alias(c) for c in ("Selected_Model", "Generated_At") if c in forecast.columns]
    df = forecast.groupBy("Medicine_ID").agg(_days().alias("days"), *carried)
    df = df.withColumn("v", F.transform("days", lambda x: x["v"])).drop("days")
    n = F.size("v")
    split = F.floor(n / 2).cast("int")
    first = F.when(n == 1, F.col("v")).otherwise(F.slice("v", 1, F.greatest(split, F.lit(1))))
    second = F.when(n == 1, F.col("v")).otherwise(
        F.slice("v", split + 1, F.greatest(n - split, F.lit(1))))
    df = df.withColumns({
        "prediction_length": n,
        "total_predicted_demand": F.aggregate("v", F.lit(0.0), lambda a, x: a + x),
        "avg_daily_demand": _mean(F.col("v")),
        "first_half_avg": _mean(first), "second_half_avg": _mean(second),
    }).drop("v")
    a, b = F.col("first_half_avg"), F.col("second_half_avg")
    df = df.withColumn("trend_pct_change", F.when(a > 0, (b - a) / a * 100).when(
        b > 0, 100.0).otherwise(0.0))
    t = F.col("trend_pct_change")
    return df.withColumn("trend", F.when(t > TREND_THRESHOLD, "increasing").when(
        t < -TREND_THRESHOLD, "decreasing").otherwise("stable"))


def list_ids(forecast: DataFrame) -> DataFrame:
    return forecast.select("Medicine_ID").distinct().orderBy("Medicine_ID")


def top_demand(forecast: DataFrame, n: int = 10) -> DataFrame:
    return forecast_summary(forecast).orderBy(
        F.col("total_predicted_demand").desc(), "Medicine_ID").limit(max(n, 0))


def by_trend(forecast: DataFrame, trend: str, n: int = 10) -> DataFrame:
    wanted = {"flat": "stable"}.get(trend.strip().lower(), trend.strip().lower())
    return forecast_summary(forecast).where(F.col("trend") == wanted).orderBy(
        F.abs("trend_pct_change").desc(), "Medicine_ID").limit(max(n, 0))


def most_uncertain(forecast: DataFrame, n: int = 10, rounded: bool = True) -> DataFrame:
    """Relative P10-P90 spread; items without quantiles are skipped."""
    df = forecast.groupBy("Medicine_ID").agg(
        F.avg("P50").alias("avg_p50"), F.avg(F.col("P90") - F.col("P10")).alias("avg_p10_p90_spread"),
        F.count("P10").alias("__a"), F.count("P90").alias("__b"),
    ).where((F.col("__a") > 0) & (F.col("__b") > 0) & F.col("avg_p50").isNotNull())
    rel = F.when(F.col("avg_p50") > 0, F.col("avg_p10_p90_spread") / F.col("avg_p50") * 100).otherwise(
        0.0)
    df = df.withColumn("relative_uncertainty_pct", rel).drop("__a", "__b")
    if rounded:
        df = df.withColumns({"avg_p50": F.bround("avg_p50", 2),
                             "avg_p10_p90_spread": F.bround("avg_p10_p90_spread", 2),
                             "relative_uncertainty_pct": F.bround("relative_uncertainty_pct", 1)})
    return df.orderBy(F.col("relative_uncertainty_pct").desc(), "Medicine_ID").limit(max(n, 0))


def compare(forecast: DataFrame, ids: list[str]) -> DataFrame:
    """Summaries of the listed items in the given order; unknown ids are skipped."""
    spark = forecast.sparkSession
    listed = spark.range(1).select(
        F.posexplode(F.array(*[F.lit(str(i)) for i in ids])).alias("position", "Medicine_ID"))
    rows = forecast.where(F.col("Medicine_ID").isin([str(i) for i in ids]))
    return forecast_summary(rows).join(F.broadcast(listed), "Medicine_ID").orderBy("position")


def nested_forecast(forecast: DataFrame) -> DataFrame:
    """One document per item: ordered days with a quantile struct. A day without P10, P50 or P90
    takes the point for all levels; single missing levels fall back to P10 or P50."""
    have = [c for c in S.QUANTILE_COLUMNS if c in forecast.columns]
    point = F.col("Predicted_Demand").cast("double")
    col = lambda c: F.col(c) if c in have else F.lit(None).cast("double")
    broken = col("P10").isNull() | col("P50").isNull() | col("P90").isNull()
    back = {c: ("P10" if c in ("P20", "P30", "P40") else "P50") for c in S.QUANTILE_COLUMNS}
    q = F.struct(*[F.when(broken, point).otherwise(F.coalesce(col(c), col(back[c]))).alias(c.lower())
                   for c in S.QUANTILE_COLUMNS])
    day = F.struct(F.col("Forecast_Date").alias("forecast_date"), point.alias("predicted_demand"),
                   q.alias("quantiles"))
    carried = [F.first(c).alias(c) for c in ("Selected_Model", "Generated_At", "Context_Length_Used")
               if c in forecast.columns]
    return forecast.groupBy("Medicine_ID").agg(
        *carried, F.array_sort(F.collect_list(day)).alias("days")).withColumn(
        "prediction_length", F.size("days"))


# ---------------------------------------------------------------- named queries

def _lookup(forecast: DataFrame, medicine_id: str) -> DataFrame:
    return forecast.where(F.col("Medicine_ID") == str(medicine_id).strip())


TOOLS: dict[str, Callable[..., DataFrame]] = {
    "get_forecast": lambda f, medicine_id="": nested_forecast(_lookup(f, medicine_id)),
    "get_trend": lambda f, medicine_id="": forecast_summary(_lookup(f, medicine_id)).select(
        "Medicine_ID", "trend", "trend_pct_change"),
    "get_summary": lambda f, medicine_id="": forecast_summary(_lookup(f, medicine_id)),
    "get_top_demand_medicines": lambda f, n=10: top_demand(f, n),
    "get_demand_trend_medicines": lambda f, trend="increasing", n=10: by_trend(f, trend, n),
    "get_most_uncertain_medicines": lambda f, n=10: most_uncertain(f, n),
    "compare_medicines": lambda f, medicine_ids=(): compare(f, list(medicine_ids)),
}


def run_tool(forecast: DataFrame, name: str, **arguments) -> DataFrame:
    """Named query; an unknown name or an unknown item gives one row with ``error`` set."""
    spark = forecast.sparkSession
    error = lambda text: spark.range(1).select(F.lit(text).alias("error"))
    if name not in TOOLS:
        return error(f"Unknown tool: {name}")
    if name.startswith("get_") and "medicine_id" in arguments:
        if _lookup(forecast, arguments["medicine_id"]).isEmpty():
            return error(f"No forecast available for medicine_id={arguments['medicine_id']}.")
    return TOOLS[name](forecast, **arguments)


# ---------------------------------------------------------------- alerts

def scan_alerts(forecast: DataFrame, history: DataFrame | None = None,
                inventory: DataFrame | None = None, decimals: int | None = 1,
                numbered: bool = True) -> DataFrame:
    """Stockout, demand-spike and uncertainty alerts, numbered in (item, rule) order."""
    p = F.col("Predicted_Demand")
    low = F.sum("P10") if "P10" in forecast.columns else F.sum(p) * 0.7
    high = F.sum("P90") if "P90" in forecast.columns else F.sum(p) * 1.3
    df = forecast.groupBy(F.col("Medicine_ID").cast("string").alias("Medicine_ID")).agg(
        F.sum(p).alias("total"), F.avg(p).alias("daily"),
        F.coalesce(high, F.lit(0.0)).alias("p90"), F.coalesce(low, F.lit(0.0)).alias("p10"))
    if history is not None:
        h = S.canonicalise(history, ["Medicine_ID", "Demand_Qty"])
        df = df.join(h.groupBy(F.col("Medicine_ID").cast("string").alias("Medicine_ID")).agg(
            F.avg("Demand_Qty").alias("past")), "Medicine_ID", "left")
    if inventory is not None:
        inv = S.canonicalise(inventory, ["Medicine_ID"])
        stock = next((c for c in ("Stock_On_Hand", "SOH", "QTY") if c in inv.columns), None)
        if stock is None:
            raise ContractError("inventory has none of Stock_On_Hand, SOH, QTY")
        df = df.join(inv.groupBy(F.col("Medicine_ID").cast("string").alias("Medicine_ID")).agg(
            F.sum(stock).alias("stock")), "Medicine_ID", "left")
    zero = F.lit(0.0)
    df = df.withColumns({
        "past": F.coalesce("past", zero) if history is not None else zero,
        "stock": F.coalesce("stock", zero) if inventory is not None else zero,
    })
    total, daily, past, stock = (F.col(c) for c in ("total", "daily", "past", "stock"))
    shortage, spread = total - stock, F.col("p90") - F.col("p10")
    rise = (daily - past) / past * 100
    r = (lambda c: c) if decimals is None else (lambda c: F.bround(c, decimals))
    num = lambda c, d: F.format_string(f"%.{d}f", c)

    def alert(rule, when, severity, kind, title, text, action, metric):
        return F.when(when, F.struct(
            F.lit(rule).alias("rule"), severity.alias("severity"), F.lit(kind).alias("alert_type"),
            F.concat(F.lit(title), F.col("Medicine_ID")).alias("title"), text.alias("description"),
            action.alias("recommended_action"), r(metric).alias("metric_value")))

    alerts = F.array(
        alert(1, (stock > 0) & (stock < total),
              F.when(shortage > 0.3 * total, "CRITICAL").otherwise("WARNING"), "STOCKOUT_RISK",
              "Stockout risk for item ",
              F.concat(F.lit("Stock of "), num(stock, 0), F.lit(" units is below the forecast of "),
                       num(total, 0), F.lit(" units")),
              F.concat(F.lit("Order at least "), num(shortage, 0), F.lit(" units")), shortage),
        alert(2, (past > 0) & (daily > 1.5 * past), F.lit("WARNING"), "DEMAND_SPIKE",
              "Demand spike for item ",
              F.concat(F.lit("Forecast of "), num(daily, 1), F.lit(" units a day is "), num(rise, 1),
                       F.lit("% above past demand")),
              F.lit("Review lead times and buffer stock"), rise),
        alert(3, (total > 10) & (spread > 2.5 * total), F.lit("INFO"), "HIGH_UNCERTAINTY",
              "Uncertain forecast for item ",
              F.concat(F.lit("P10 "), num(F.col("p10"), 0), F.lit(" to P90 "), num(F.col("p90"), 0),
                       F.lit(" units")),
              F.lit("Watch weekly sales"), spread),
    )
    rows = df.select("Medicine_ID", F.explode(F.filter(alerts, lambda a: a.isNotNull())).alias("a")
                     ).select("Medicine_ID", "a.*")
    return number_alerts(rows) if numbered else rows


def number_alerts(rows: DataFrame) -> DataFrame:
    """Ids ALT-0001.. in (item, rule) order. Reads its input three times: store it first when it is
    expensive."""
    rows = global_row_number(rows, "Medicine_ID", ["rule"], "__n")
    n = F.col("__n").cast("string")
    return rows.withColumn("id", F.concat(F.lit("ALT-"), F.when(
        F.length(n) < 4, F.lpad(n, 4, "0")).otherwise(n))).drop("__n")


def alert_summary(alerts: DataFrame) -> DataFrame:
    return alerts.agg(
        F.count("*").alias("total_alerts"),
        F.count_if(F.col("severity") == "CRITICAL").alias("critical_count"),
        F.count_if(F.col("severity") == "WARNING").alias("warning_count"),
        F.count_if(F.col("severity") == "INFO").alias("info_count"))
