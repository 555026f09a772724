"""Monthly forecast cycle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions.guards import require_no_violations
from ..operators import backtest, quality, routing, series, serving, smoothing, warehouse
from ..session import stored
from ..sources import landing, publish, tables
from ..streaming import arrivals
from . import etl


def study_routing(daily: DataFrame, validation: list[str], holdout: list[str],
                  context_months: int = 12) -> dict[str, DataFrame]:
    """Backtest both models by month and derive the routing table."""
    monthly = series.monthly_experiment(daily)
    cutoffs = [*validation, *holdout]
    results = backtest.add_split(
        backtest.monthly_backtest(monthly, cutoffs, context_months, "both"), validation, holdout)
    regimes = series.demand_regimes(series.candidates_only(daily, series.series_quality(daily)))
    comparison = routing.build_comparison(results, regimes)
    return {"results": results, "regimes": regimes, "comparison": comparison,
            "routing": routing.build_routing_table(comparison)}


def run_monthly_forecast(spark: SparkSession, history: DataFrame, routing_table: DataFrame, root: str,
                         run_id: str, model: Callable | None = None,
                         horizon: int = S.HORIZON) -> dict:
    """Contracts, routed forecast, output contract, versioned write, gate, manifest."""
    history = S.canonicalise(history)
    require_no_violations(quality.check_series(history, *S.ALIASES).drop("duplicate_day"), "demand history")
    models = [routing.CHALLENGER, routing.BASELINE]
    require_no_violations(quality.check_routing(routing_table, models, routing.CHALLENGER), "routing")
    forecast, failed = serving.forecast_batch(history, routing_table, model=model, horizon=horizon)
    requested = history.select(
        F.trim(F.col("Medicine_ID").cast("string")).alias("Medicine_ID")).distinct()
    return publish.write_run(forecast, requested, failed, root, run_id)


def extend_states(spark: SparkSession, root: str, month: str, demand: DataFrame, horizon: int = S.HORIZON,
                  models: list[str] | None = None) -> DataFrame:
    """One month's demand added to the stored smoothing states, and the forecasts of the classical models from
    them. Neither the lines nor the series of earlier months are read; a repeated run changes nothing."""
    states = smoothing.StateStore(spark, root).add_month(month, demand)
    return smoothing.forecast_states(states, horizon, models)


def monthly_cycle(spark: SparkSession, line: DataFrame, invoice: DataFrame, routing_table: DataFrame,
                  root: str, run_id: str, inventory: DataFrame | None = None) -> dict:
    """Demand preparation, evaluation of the previous forecast on new actuals, forecast, alerts.

    The demand table is written once and re-read by the later steps, which cuts its lineage.
    """
    demand_path = f"{root}/daily_demand"
    tables.save_parquet(series.prepare_demand(line, invoice), demand_path)
    return cycle_from_demand(spark, spark.read.parquet(demand_path), routing_table, root, run_id, inventory)


def cycle_from_demand(spark: SparkSession, demand: DataFrame, routing_table: DataFrame, root: str, run_id: str,
                      inventory: DataFrame | None = None) -> dict:
    """The cycle's steps after demand preparation. ``demand`` is read several times: pass a stored table."""
    require_no_violations(quality.check_series(demand), "daily demand")
    previous = publish.latest_forecast(spark, root)
    if previous is not None:
        publish.save_documents(backtest.evaluate_forecast(demand, previous), f"{root}/evaluations")
    candidates = series.candidates_only(demand, series.series_quality(demand))
    manifest = run_monthly_forecast(spark, candidates, routing_table, root, run_id)
    forecast = spark.read.parquet(manifest["output_path"])
    now = F.current_timestamp()
    alerts = serving.scan_alerts(forecast, demand, inventory).withColumns({"created_at": now, "last_updated": now})
    publish.save_documents(alerts, f"{root}/alerts")
    return manifest


def run_month(spark: SparkSession, landed: str, routing_table: DataFrame, root: str, run_id: str,
              schema: str | None = None, fmt: str = "parquet", start="2018-01-01", end="2026-05-31",
              as_of=None, inventory: DataFrame | None = None) -> dict:
    """The whole month from the landing folders on: reports, warehouse tables, enriched tables, demand, evaluation,
    forecast, alerts. Every step reads what the one before has written, so a step that failed may run again.

    Returns the manifest of the forecast with the rows written per warehouse table and the enriched tables' names.
    """
    written = etl.load_warehouse(spark, landed, schema, fmt, start=start, end=end, report_path=f"{root}/reports")
    enriched = etl.run_silver(spark, f"{root}/silver", schema, as_of)
    facts = tables.read_multiple_tables(spark, ["fact_sales_line", "fact_sales_invoice"], schema)
    manifest = monthly_cycle(spark, facts["fact_sales_line"], facts["fact_sales_invoice"], routing_table, root, run_id,
                             inventory)
    return {**manifest, "warehouse_rows": written, "enriched_tables": enriched}


def refresh_demand(spark: SparkSession, landed: str, store: str, months: list[str], item: str = "MDCODE",
                   fmt: str = "parquet") -> None:
    """Daily demand of the given months, made anew from all their landed files; only their partitions of
    ``<store>/demand`` are replaced."""
    found = [landing.read_month(spark, landed, m, ["INVDET", "INVOICE"], fmt) for m in months]
    line, invoice = (landing.union_months([f[t] for f in found]) for t in ("INVDET", "INVOICE"))
    heads = invoice.select("INVNO", "SOURCE_MONTH", "INVDT", "CANCEL_ID")
    heads = warehouse.build_fact(heads, heads.columns, ["INVNO", "SOURCE_MONTH"])
    lines = warehouse.build_fact_sales_line(line, extra=[item])
    arrivals.replace_months(series.prepare_demand(lines, heads, item, by=["SOURCE_MONTH"]), f"{store}/demand", months)


def arrived_demand(spark: SparkSession, store: str) -> DataFrame:
    """Daily demand over all months picked up so far; a day may have lines in two months' files."""
    parts = spark.read.schema("MDCODE string, INVDT date, Demand_Qty double, SOURCE_MONTH string").parquet(f"{store}/demand")
    return parts.groupBy("MDCODE", "INVDT").agg(F.sum("Demand_Qty").alias("Demand_Qty"))


def pick_up_demand(spark: SparkSession, landed: str, store: str, item: str = "MDCODE", fmt: str = "parquet") -> list[str]:
    """Demand brought up to what has landed: months with new line or invoice files are read, no other. Returns
    those months, oldest first; a run with nothing new changes nothing."""
    return arrivals.catch_up(spark, landed, store, lambda months: refresh_demand(spark, landed, store, months, item, fmt),
                             needs=["INVDET", "INVOICE"])


def run_arrivals(spark: SparkSession, landed: str, routing_table: DataFrame, root: str, run_id: str,
                 inventory: DataFrame | None = None, item: str = "MDCODE", fmt: str = "parquet") -> dict | None:
    """Pick up the months that have landed; if there are any, evaluate, forecast and alert on the whole demand.

    Returns the manifest with the months, or None where nothing is new. The months count as applied once the whole
    run is through: after a failure the next call takes them again.
    """
    manifest = {}

    def apply(months: list[str]) -> None:
        refresh_demand(spark, landed, root, months, item, fmt)
        demand = stored(arrived_demand(spark, root), "demand")
        manifest.update(cycle_from_demand(spark, demand, routing_table, root, run_id, inventory))

    months = arrivals.catch_up(spark, landed, root, apply, needs=["INVDET", "INVOICE"])
    return {**manifest, "months": months} if months else None
