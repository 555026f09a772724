"""Registered queries: series, features, forecasters, backtests."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .. import schemas as S
from ..operators import backtest as BT
from ..operators import batched, features, quality, series, smoothing
from ..operators import forecast as FC
from ..operators.warehouse import _tie_order, build_fact_sales_line, first_per_key
from ..session import cut_lineage, remember, work_folder
from . import views as V
from .etl import dim_date, fact_line
from .registry import query
from .sqlbase import define

DAILY_VALIDATION = ["2000-12-31", "2001-01-31", "2001-02-28", "2001-03-31"]
DAILY_HOLDOUT = ["2001-04-30", "2001-05-31"]
DAILY_CUTOFFS = DAILY_VALIDATION + DAILY_HOLDOUT
MONTH_VALIDATION = ["2001-01-01", "2001-02-01", "2001-03-01", "2001-04-01"]
MONTH_HOLDOUT = ["2001-05-01", "2001-06-01"]
MONTH_CUTOFFS = MONTH_VALIDATION + MONTH_HOLDOUT
CONTEXTS = [90, 180, 365, 730]
CONTEXT_MONTHS = 12
GRAINS = {"brand": "BRAND", "sup": "SUPNO", "kind": "KIND", "part": "MDCODE"}
QCOLS = S.QUANTILE_COLUMNS
QSQL = {c: q for c, q in zip(QCOLS, S.QUANTILE_LEVELS)}


def sql_dates(days):
    return "(SELECT unnest([" + ", ".join(f"DATE '{d}'" for d in days) + "]) AS cutoff)"


# ================================================================ series
define("demand_lines", """
SELECT f.*, i.INVDT FROM fact_line f
JOIN (SELECT DISTINCT INVNO, SOURCE_MONTH, INVDT, CANCEL_ID FROM invoice) i
  ON f.INVNO = i.INVNO AND f.SOURCE_MONTH = i.SOURCE_MONTH
WHERE (f.CANCEL_ID IS NULL OR f.CANCEL_ID = 0) AND (i.CANCEL_ID IS NULL OR i.CANCEL_ID = 0)""")
for g, col in GRAINS.items():
    define(f"daily_{g}", f"SELECT {col} AS MDCODE, INVDT, sum(QTY) AS Demand_Qty FROM demand_lines "
                         f"GROUP BY 1, 2")
    define(f"dense_{g}", f"""
SELECT c.MDCODE, c.INVDT, coalesce(d.Demand_Qty, CAST(0 AS DOUBLE)) AS Demand_Qty
FROM (SELECT MDCODE, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS INVDT
  FROM (SELECT MDCODE, min(INVDT) AS lo, max(INVDT) AS hi FROM daily_{g} GROUP BY 1) AS b) AS c
LEFT JOIN daily_{g} AS d ON c.MDCODE = d.MDCODE AND c.INVDT = d.INVDT""")


def invoice_heads(spark, sf):
    head = V.invoice_header(spark, sf).select("INVNO", "SOURCE_MONTH", "INVDT", "CANCEL_ID")
    return first_per_key(head, ["INVNO", "SOURCE_MONTH"], _tie_order(head, ["INVNO", "SOURCE_MONTH"]))


def daily(spark, sf, grain="sup"):
    # of the columns that only ride along, the grain's own: others are last in the fact's order and decide nothing here
    line = build_fact_sales_line(V.invdet(spark, sf), extra=[GRAINS[grain]])
    return series.prepare_demand(line, invoice_heads(spark, sf), GRAINS[grain])


def stored_daily(spark, sf, grain="sup"):
    """Daily demand written once for queries that read it several times, as the monthly cycle does:
    the joins and the line dedupe behind it then run once."""
    return cut_lineage(daily(spark, sf, grain))


query("daily_demand", "SELECT * FROM daily_brand")(lambda s, sf: daily(s, sf, "brand"))
query("daily_demand_part", "SELECT * FROM daily_part")(lambda s, sf: daily(s, sf, "part"))
query("unmatched_line_keys", """
SELECT DISTINCT INVNO, SOURCE_MONTH FROM fact_line WHERE (CANCEL_ID IS NULL OR CANCEL_ID = 0) AND
 (INVNO, SOURCE_MONTH) NOT IN (SELECT (INVNO, SOURCE_MONTH) FROM invoice WHERE REMARK <> 'F')""")(
    lambda s, sf: series.unmatched_line_keys(
        fact_line(s, sf), V.table(s, sf, "orders").where("o_orderstatus <> 'F'").select(
            F.col("o_orderkey").cast("string").alias("INVNO"),
            V.month_tag(F.to_date("o_orderdate")).alias("SOURCE_MONTH"), F.lit(0).alias("CANCEL_ID"))))

QUALITY = """
SELECT *, calendar_days - observation_count AS missing_days,
  observation_count / CAST(calendar_days AS DOUBLE) AS activity_rate,
  active_days / CAST(calendar_days AS DOUBLE) AS demand_activity_rate,
  CASE WHEN observation_count < 30 THEN 'INSUFFICIENT_HISTORY'
    WHEN observation_count < 90 THEN 'SPARSE_HISTORY'
    WHEN active_days / CAST(calendar_days AS DOUBLE) < 0.05 THEN 'HIGHLY_INTERMITTENT'
    WHEN active_days / CAST(calendar_days AS DOUBLE) < 0.2 THEN 'INTERMITTENT'
    ELSE 'REGULAR' END AS series_class,
  observation_count >= 90 AND calendar_days >= 180 AS forecast_candidate
FROM (SELECT MDCODE, min(INVDT) AS first_sale_date, max(INVDT) AS last_sale_date,
  count(*) AS observation_count, count(*) FILTER (WHERE Demand_Qty > 0) AS active_days,
  count(*) FILTER (WHERE Demand_Qty = 0) AS zero_days_observed, sum(Demand_Qty) AS total_demand,
  avg(Demand_Qty) AS mean_demand, quantile_cont(Demand_Qty, 0.5) AS median_demand,
  stddev_samp(Demand_Qty) AS std_demand, max(Demand_Qty) AS max_demand,
  CAST(max(INVDT) - min(INVDT) + 1 AS INTEGER) AS calendar_days
  FROM {src} GROUP BY MDCODE) AS q"""
define("quality_sup", QUALITY.format(src="daily_sup"))
define("quality_part", QUALITY.format(src="daily_part"))
QUALITY_CUT = "activity_rate demand_activity_rate mean_demand median_demand std_demand"
query("series_quality", "SELECT * FROM quality_part", cut=QUALITY_CUT)(
    lambda s, sf: series.series_quality(daily(s, sf, "part")))
query("series_quality_supplier", "SELECT * FROM quality_sup", cut=QUALITY_CUT)(
    lambda s, sf: series.series_quality(daily(s, sf, "sup")))


@query("forecast_candidates", """
SELECT MDCODE, INVDT, Demand_Qty FROM daily_sup
WHERE MDCODE IN (SELECT MDCODE FROM quality_sup WHERE forecast_candidate)""")
def forecast_candidates(spark, sf):
    d = stored_daily(spark, sf)
    return series.candidates_only(d, series.series_quality(d))


query("dense_daily", "SELECT * FROM dense_brand")(
    lambda s, sf: series.fill_calendar(daily(s, sf, "brand"), "MDCODE", "INVDT", "Demand_Qty"))
query("forecasting_series", """
SELECT * FROM dense_sup WHERE MDCODE IN (SELECT MDCODE FROM quality_sup WHERE forecast_candidate)""")(
    lambda s, sf: series.forecasting_series(stored_daily(s, sf)))

define("month_sup", """
SELECT c.Medicine_ID, c.Month, coalesce(t.q, CAST(0 AS DOUBLE)) AS Actual
FROM (SELECT MDCODE AS Medicine_ID, CAST(unnest(generate_series(lo, hi, INTERVAL 1 MONTH)) AS DATE)
    AS Month
  FROM (SELECT MDCODE, date_trunc('month', min(INVDT)) AS lo, date_trunc('month', max(INVDT)) AS hi
    FROM daily_sup GROUP BY 1) AS b) AS c
LEFT JOIN (SELECT MDCODE, CAST(date_trunc('month', INVDT) AS DATE) AS m, sum(Demand_Qty) AS q
  FROM daily_sup GROUP BY 1, 2) AS t ON c.Medicine_ID = t.MDCODE AND c.Month = t.m""")
query("dense_monthly", "SELECT Medicine_ID AS MDCODE, Month, Actual AS Demand_Qty FROM month_sup")(
    lambda s, sf: series.monthly_demand(daily(s, sf)))
query("monthly_stats", """
SELECT Medicine_ID, count(*) AS "count", avg(Actual) AS mean, stddev_samp(Actual) AS std,
  sum(Actual) AS "sum", avg(CASE WHEN Actual = 0 THEN 100.0::DOUBLE ELSE 0 END) AS Zero_Month_Pct,
  pow(stddev_samp(Actual) / nullif(avg(Actual), 0), 2) AS CV2
FROM month_sup GROUP BY 1""", cut="mean std CV2 Zero_Month_Pct")(
    lambda s, sf: series.monthly_statistics(series.monthly_experiment(daily(s, sf))))


@query("conservation_check", """
SELECT d.MDCODE, daily_total, monthly_total, abs(daily_total - monthly_total) AS difference
FROM (SELECT MDCODE, sum(Demand_Qty) AS daily_total FROM daily_sup GROUP BY 1) d
FULL JOIN (SELECT Medicine_ID AS MDCODE, sum(Actual) AS monthly_total FROM month_sup GROUP BY 1) m
  ON d.MDCODE = m.MDCODE
WHERE abs(coalesce(daily_total, 0) - coalesce(monthly_total, 0)) > 1e-8""")
def conservation_check(spark, sf):
    d = stored_daily(spark, sf)
    return quality.conservation_check(d, series.monthly_demand(d))


# the same check on totals that do differ: cancelled lines are in one side only
@query("conservation_breaks", """
SELECT a.MDCODE, daily_total, monthly_total, abs(daily_total - monthly_total) AS difference
FROM (SELECT MDCODE, sum(Demand_Qty) AS daily_total FROM daily_part GROUP BY 1) a
FULL JOIN (SELECT MDCODE, sum(QTY) AS monthly_total FROM fact_line GROUP BY 1) b
  ON a.MDCODE = b.MDCODE
WHERE abs(coalesce(daily_total, 0) - coalesce(monthly_total, 0)) > 1e-8""")
def conservation_breaks(spark, sf):
    # the lines are read by both sides, so they are written once, in the columns that the check needs
    line = cut_lineage(fact_line(spark, sf).select("INVNO", "SOURCE_MONTH", "MDCODE", "QTY", "CANCEL_ID"))
    return quality.conservation_check(series.prepare_demand(line, invoice_heads(spark, sf)),
                                      line.withColumnRenamed("QTY", "Demand_Qty"))


CLASSIFY = ("CASE WHEN {a} < 1.32 AND {c} < 0.49 THEN '{0}' WHEN {a} < 1.32 THEN '{1}' "
            "WHEN {c} < 0.49 THEN '{2}' ELSE '{3}' END")
UPPER = ("SMOOTH", "ERRATIC", "INTERMITTENT", "LUMPY")
TITLE = ("Smooth", "Erratic", "Intermittent", "Lumpy")
query("demand_profile", """
SELECT *, """ + CLASSIFY.format(*UPPER, a="adi", c="cv2") + """ AS demand_class FROM (
SELECT *, calendar_days - positive_demand_days AS zero_demand_days,
  positive_demand_days / CAST(calendar_days AS DOUBLE) AS demand_activity_rate,
  (calendar_days - positive_demand_days) / CAST(calendar_days AS DOUBLE) AS zero_demand_ratio,
  std_positive_demand / mean_positive_demand AS cv,
  pow(std_positive_demand / mean_positive_demand, 2) AS cv2,
  calendar_days / CAST(positive_demand_days AS DOUBLE) AS adi,
  total_demand / calendar_days AS avg_daily_demand,
  (recent_365_demand / least(365, calendar_days)) / (total_demand / calendar_days)
    AS recent_vs_historical_ratio,
  coalesce(second_half_avg / nullif(first_half_avg, 0), 0) AS trend_ratio
FROM (SELECT MDCODE, min(INVDT) AS first_date, max(INVDT) AS last_date,
    CAST(count(*) AS INTEGER) AS calendar_days,
    sum(Demand_Qty) AS total_demand, count(*) FILTER (WHERE Demand_Qty > 0) AS positive_demand_days,
    avg(Demand_Qty) FILTER (WHERE Demand_Qty > 0) AS mean_positive_demand,
    quantile_cont(Demand_Qty, 0.5) FILTER (WHERE Demand_Qty > 0) AS median_positive_demand,
    coalesce(stddev_samp(Demand_Qty) FILTER (WHERE Demand_Qty > 0), 0) AS std_positive_demand,
    sum(Demand_Qty) FILTER (WHERE rn <= 30) AS recent_30_demand,
    sum(Demand_Qty) FILTER (WHERE rn <= 90) AS recent_90_demand,
    sum(Demand_Qty) FILTER (WHERE rn <= 180) AS recent_180_demand,
    sum(Demand_Qty) FILTER (WHERE rn <= 365) AS recent_365_demand,
    CASE WHEN count(*) // 2 >= 2 THEN avg(Demand_Qty) FILTER (WHERE n - rn < n // 2) ELSE 0 END
      AS first_half_avg,
    CASE WHEN count(*) // 2 >= 2 THEN avg(Demand_Qty) FILTER (WHERE n - rn >= n // 2) ELSE 0 END
      AS second_half_avg
  FROM (SELECT *, row_number() OVER (PARTITION BY MDCODE ORDER BY INVDT DESC) AS rn,
      count(*) OVER (PARTITION BY MDCODE) AS n FROM dense_sup) AS r GROUP BY MDCODE) AS a) AS p""",
      cut="demand_activity_rate zero_demand_ratio mean_positive_demand median_positive_demand "
          "std_positive_demand cv cv2 adi avg_daily_demand recent_vs_historical_ratio first_half_avg "
          "second_half_avg trend_ratio")(lambda s, sf: series.demand_profile(daily(s, sf)))

REGIMES = """
SELECT *, """ + CLASSIFY.format(*TITLE, a="ADI", c="CV2") + """ AS Regime FROM (
SELECT MDCODE AS Medicine_ID, CAST(count(*) AS INTEGER) AS Days,
  count(*) FILTER (WHERE Demand_Qty > 0) AS NonZero_Days,
  count(*) / CAST(count(*) FILTER (WHERE Demand_Qty > 0) AS DOUBLE) AS ADI,
  coalesce({var}(Demand_Qty) FILTER (WHERE Demand_Qty > 0)
    / pow(avg(Demand_Qty) FILTER (WHERE Demand_Qty > 0), 2), 0) AS CV2,
  sum(Demand_Qty) AS Total_Demand FROM dense_sup GROUP BY MDCODE) AS r"""
define("regime_sup", REGIMES.format(var="var_samp"))
query("regimes", "SELECT * FROM regime_sup", cut="ADI CV2")(
    lambda s, sf: series.demand_regimes(daily(s, sf)))
query("regimes_ddof0", REGIMES.format(var="var_pop"), cut="ADI CV2")(
    lambda s, sf: series.demand_regimes(daily(s, sf), ddof=0))
query("regime_summary", """
SELECT Regime, count(*) AS Medicines, avg(ADI) AS Avg_ADI, avg(CV2) AS Avg_CV2,
  sum(Total_Demand) AS Total_Demand FROM regime_sup GROUP BY 1""", cut="Avg_ADI Avg_CV2")(
    lambda s, sf: series.regime_summary(series.demand_regimes(daily(s, sf))))


def _raw_history(spark, sf):
    """Events as a messy history: padded ids, several rows a day, signed values."""
    return V.table(spark, sf, "events").select(
        F.concat(F.lit(" "), F.col("event_type"), F.lit(" ")).alias("item_id"),
        F.col("ts").alias("timestamp"), (F.col("value") - 10).cast("decimal(18,2)").alias("target"))


query("history_lenient", """
SELECT c.MDCODE, c.INVDT, coalesce(q, 0) AS Demand_Qty FROM (
  SELECT MDCODE, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS INVDT FROM (
    SELECT event_type AS MDCODE, min(CAST(ts AS DATE)) AS lo, max(CAST(ts AS DATE)) AS hi
    FROM events GROUP BY 1) AS b) AS c
LEFT JOIN (SELECT event_type, CAST(ts AS DATE) AS d,
    CAST(sum(greatest(CAST(value - 10 AS DECIMAL(18,2)), 0)) AS DOUBLE) AS q
  FROM events GROUP BY 1, 2) AS t ON c.MDCODE = t.event_type AND c.INVDT = t.d""", cut="Demand_Qty")(
    lambda s, sf: series.prepare_history(_raw_history(s, sf), "lenient", dense=True))


@query("history_strict", "SELECT * FROM dense_kind")
def history_strict(spark, sf):
    # the contract is checked in a job of its own, so the demand is written once
    return series.prepare_history(stored_daily(spark, sf, "kind"), "strict", dense=True)


@query("series_contract", """
SELECT CAST(0 AS BIGINT) AS missing_id, CAST(0 AS BIGINT) AS bad_date, CAST(0 AS BIGINT) AS missing_qty,
  CAST(0 AS BIGINT) AS infinite_qty,
  (SELECT count(*) FROM events WHERE CAST(value - 10 AS DECIMAL(18,2)) < 0) AS negative_qty,
  count(*) - count(DISTINCT (event_type, CAST(ts AS DATE))) AS duplicate_day FROM events""")
def series_contract(spark, sf):
    return quality.check_series(_raw_history(spark, sf), "item_id", "timestamp", "target")


query("context_window", """
SELECT d.* FROM daily_sup d JOIN (SELECT MDCODE, max(INVDT) AS hi FROM daily_sup GROUP BY 1
  HAVING max(INVDT) - min(INVDT) + 1 >= 3) AS b ON d.MDCODE = b.MDCODE WHERE hi - INVDT < 730""")(
    lambda s, sf: series.context_window(daily(s, sf)))

# ================================================================ features
W = "(PARTITION BY MDCODE ORDER BY INVDT{})"
query("lag_features", "SELECT *, " + ", ".join(
    f"lag(Demand_Qty, {k}) OVER {W.format('')} AS Lag_{k}" for k in features.LAGS)
      + " FROM daily_sup")(lambda s, sf: features.lag_features(daily(s, sf)))


def _roll(fn, n, name):
    frame = f" ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING"
    return f"{fn}(Demand_Qty) OVER {W.format(frame)} AS {name}_{n}"


query("rolling_features", "SELECT *, " + ", ".join(
    [_roll(fn, n, nm) for n in features.WINDOWS
     for fn, nm in (("avg", "Rolling_Mean"), ("stddev_samp", "Rolling_STD"))]
    + [_roll(fn, n, nm) for n in features.EXTREME_WINDOWS
       for fn, nm in (("max", "Rolling_Max"), ("min", "Rolling_Min"))]) + " FROM daily_sup",
      cut=" ".join(f"Rolling_{k}_{n}" for k in ("Mean", "STD") for n in features.WINDOWS))(
    lambda s, sf: features.rolling_features(daily(s, sf)))
SPARSE_ROLL = ", ".join(
    [_roll(fn, n, nm) for n in features.WINDOWS
     for fn, nm in (("avg", "Rolling_Mean"), ("stddev_samp", "Rolling_STD"))]
    + [_roll(fn, n, nm) for n in features.EXTREME_WINDOWS
       for fn, nm in (("max", "Rolling_Max"), ("min", "Rolling_Min"))])
OBSERVED = " AS d SEMI JOIN daily_part AS o ON d.MDCODE = o.MDCODE AND d.INVDT = o.INVDT"
query("sparse_rolling_features", f"SELECT d.* FROM (SELECT *, {SPARSE_ROLL} FROM dense_part)" + OBSERVED,
      cut=" ".join(f"Rolling_{k}_{n}" for k in ("Mean", "STD") for n in features.WINDOWS))(
    lambda s, sf: features.sparse_rolling_features(daily(s, sf, "part")))
query("sparse_lag_features", "SELECT d.* FROM (SELECT *, " + ", ".join(
    f"lag(Demand_Qty, {k}) OVER {W.format('')} AS Lag_{k}" for k in features.LAGS) + " FROM dense_part)" + OBSERVED)(
    lambda s, sf: features.sparse_lag_features(daily(s, sf, "part")))
query("trend_features", f"""
SELECT *, Demand_Qty - lag(Demand_Qty) OVER {W.format('')} AS Demand_Diff_1,
  (Demand_Qty - lag(Demand_Qty) OVER {W.format('')}) / nullif(lag(Demand_Qty) OVER {W.format('')}, 0)
    AS Demand_Growth_Rate,
  Demand_Qty - lag(Demand_Qty, 7) OVER {W.format('')} AS Weekly_Trend FROM daily_sup""",
      cut="Demand_Growth_Rate")(lambda s, sf: features.trend_features(daily(s, sf)))
query("calendar_features", """
SELECT s.*, is_month_start, is_month_end, is_quarter_end, is_year_end
FROM daily_sup s LEFT JOIN dim_date d ON s.INVDT = d.full_date""")(
    lambda s, sf: features.calendar_features(daily(s, sf), dim_date(s, sf)))
define("price_days", """
SELECT MDCODE, INVDT, avg(RATE) AS Selling_Rate, avg(PRATE) AS Purchase_Rate,
  avg(MRP) AS Maximum_Retail_Price FROM demand_lines GROUP BY 1, 2""")


@query("price_features", f"""
SELECT *, Selling_Rate - Purchase_Rate AS Profit_Margin,
  (Selling_Rate - Purchase_Rate) / Purchase_Rate * 100 AS Profit_Percentage,
  (Maximum_Retail_Price - Selling_Rate) / Maximum_Retail_Price * 100 AS Discount_Percentage,
  Selling_Rate - lag(Selling_Rate) OVER {W.format('')} AS Price_Change,
  (Selling_Rate - lag(Selling_Rate) OVER {W.format('')}) / lag(Selling_Rate) OVER {W.format('')}
    AS Price_Growth FROM price_days""",
       cut="Selling_Rate Purchase_Rate Maximum_Retail_Price Profit_Margin Profit_Percentage "
           "Discount_Percentage Price_Change Price_Growth")
def price_features(spark, sf):
    from ..functions.cleaning import not_cancelled
    from ..operators.joins import merge_dimension
    lines = merge_dimension(fact_line(spark, sf).where(not_cancelled()),
                            invoice_heads(spark, sf), ["INVNO", "SOURCE_MONTH"], how="inner")
    prices = lines.groupBy("MDCODE", "INVDT").agg(
        F.avg("RATE").alias("Selling_Rate"), F.avg("PRATE").alias("Purchase_Rate"),
        F.avg("MRP").alias("Maximum_Retail_Price"))
    return features.price_features(prices)


query("item_features", """
SELECT *, count(*) OVER w AS Medicine_Frequency, avg(Demand_Qty) OVER w AS Medicine_Avg_Demand,
  stddev_samp(Demand_Qty) OVER w AS Medicine_Demand_STD, max(Demand_Qty) OVER w AS Medicine_Max_Demand,
  count(INVDT) OVER w AS Medicine_Selling_Days FROM daily_sup WINDOW w AS (PARTITION BY MDCODE)""",
      cut="Medicine_Avg_Demand Medicine_Demand_STD")(
    lambda s, sf: features.item_features(daily(s, sf)))
query("last_rows", f"""
SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER {W.format(' DESC')} AS rn FROM daily_sup) AS x
WHERE rn <= 30""")(lambda s, sf: features.last_rows(daily(s, sf), 30))


# ================================================================ forecasters
# Oracle side: the plain recursions over dense lists, so both sides share no formula.
def state_sql(hist, p0="1.0 / (f + 1)", start="1"):
    """Recursive smoothing over lists; hist has (id, cutoff, y). p starts at p0 and is updated from
    list position ``start``."""
    return f"""
SELECT *,
  CASE WHEN k = 0 THEN 0 ELSE list_reduce(vals, lambda a, v: a + 0.1::DOUBLE * (v - a)) END AS z,
  CASE WHEN k = 0 THEN NULL ELSE list_reduce(
    list_prepend(CAST(f + 1 AS DOUBLE), list_transform(range(2, k + 1),
      lambda j: CAST(pos[j] - pos[j - 1] AS DOUBLE))),
    lambda a, v: a + 0.1::DOUBLE * (v - a)) END AS gap,
  CASE WHEN k = 0 THEN 0 ELSE list_reduce(
    list_prepend(CAST({p0} AS DOUBLE), list_transform(y[{start}:],
      lambda v: CASE WHEN v > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)),
    lambda a, v: a + 0.1::DOUBLE * (v - a)) END AS p
FROM (SELECT *, len(vals) AS k, pos[1] - 1 AS f FROM (
  SELECT *, len(y) AS n, list_filter(y, lambda v: v > 0) AS vals,
    list_filter(range(1, len(y) + 1), lambda i: y[i] > 0) AS pos FROM {hist}) AS a) AS b"""


def models_sql(state, h):
    return {
        "naive": "y[n]",
        "seasonal_naive": f"CASE WHEN n < 7 THEN y[n] ELSE y[n - 6 + ({h} - 1) % 7] END",
        "croston": "CASE WHEN k = 0 THEN 0 ELSE z / gap END",
        "sba": "CASE WHEN k = 0 THEN 0 ELSE z / gap * 0.95::DOUBLE END",
        "tsb": "CASE WHEN k = 0 THEN 0 ELSE p * z END",
    }


def unpivot_sql(models, columns, source):
    return " UNION ALL ".join(f"SELECT {columns}, '{m}' AS Model, CAST({e} AS DOUBLE) AS Predicted "
                              f"FROM {source}" for m, e in models.items())


for g in ("brand", "sup"):
    define(f"hist_end_{g}", f"""SELECT MDCODE, max(INVDT) AS cutoff, list(Demand_Qty ORDER BY INVDT) AS y
FROM dense_{g} GROUP BY 1""")
    define(f"state_end_{g}", state_sql(f"hist_end_{g}"))
define("ahead30", "SELECT unnest(range(1, 31)) AS h")
query("fc_daily_models", unpivot_sql(
    models_sql("", "h"), "MDCODE AS Medicine_ID, CAST(cutoff + CAST(h AS INTEGER) AS DATE) AS "
    "Forecast_Date, CAST(h AS INTEGER) AS h", "state_end_brand, ahead30"), cut="Predicted")(
    lambda s, sf: FC.forecast_daily(daily(s, sf, "brand")))



def monthly_states(spark, sf, grain, alone=3):
    """States of a demand history of which the last months arrive one by one."""
    d = stored_daily(spark, sf, grain).withColumn("month", F.trunc("INVDT", "month"))
    last = d.agg(F.max("month")).first()[0]
    store = smoothing.StateStore(spark, f"{work_folder(spark)}/states-{uuid.uuid4().hex}")
    remember(spark, store.root)
    if last is None:
        return smoothing.segment_states(d)
    store.load(d.where(F.col("month") <= F.add_months(F.lit(last), -alone)))
    for k in range(alone - 1, -1, -1):
        month = spark.range(1).select(F.add_months(F.lit(last), -k).cast("string")).first()[0]
        states = store.add_month(month, d)
    return states


query("fc_daily_models_monthly", unpivot_sql(
    models_sql("", "h"), "MDCODE AS Medicine_ID, CAST(cutoff + CAST(h AS INTEGER) AS DATE) AS "
    "Forecast_Date, CAST(h AS INTEGER) AS h", "state_end_brand, ahead30"), cut="Predicted")(
    lambda s, sf: smoothing.forecast_states(monthly_states(s, sf, "brand"), S.HORIZON))

TSB_SQL = """
SELECT MDCODE AS Medicine_ID, CAST(cutoff + CAST(h AS INTEGER) AS DATE) AS Forecast_Date,
  CASE WHEN k = 0 THEN 0 ELSE p * z END AS Predicted_Demand, CAST(n AS INTEGER) AS History_Days
FROM {state}, ahead30"""
query("fc_tsb", TSB_SQL.format(state="state_end_sup"), cut="Predicted_Demand")(
    lambda s, sf: FC.forecast_tsb(daily(s, sf), decimals=None))
query("fc_tsb_monthly", TSB_SQL.format(state="state_end_sup"), cut="Predicted_Demand")(
    lambda s, sf: FC.over_horizon(smoothing.model_state(monthly_states(s, sf, "sup")), S.HORIZON).select(
        F.col("MDCODE").alias("Medicine_ID"), "Forecast_Date", FC.tsb().alias("Predicted_Demand"),
        F.col("n").alias("History_Days")))
define("state_router_sup", state_sql("hist_end_sup", start="f + 2"))
query("fc_tsb_router", TSB_SQL.format(state="state_router_sup") + " WHERE n >= 3",
      cut="Predicted_Demand")(
    lambda s, sf: FC.forecast_tsb(daily(s, sf), variant="router", decimals=None))


def quantile_sql(values, levels=QSQL):
    return ", ".join(f"quantile_cont({values}, {q}) AS {c}" for c, q in levels.items())


define("native_q_sup", f"""
SELECT d.MDCODE, max(hi) AS cutoff, CAST(count(*) AS INTEGER) AS Context_Length_Used,
  {quantile_sql('Demand_Qty')}
FROM dense_sup d JOIN (SELECT MDCODE, max(INVDT) AS hi FROM dense_sup GROUP BY 1) b
  ON d.MDCODE = b.MDCODE WHERE hi - INVDT < 730 GROUP BY d.MDCODE HAVING count(*) >= 3""")
query("fc_quantile_native", """
SELECT MDCODE AS Medicine_ID, CAST(cutoff + CAST(h AS INTEGER) AS DATE) AS Forecast_Date,
  P50 AS Predicted_Demand, """ + ", ".join(QCOLS) + """, Context_Length_Used
FROM native_q_sup, ahead30""", cut=" ".join(["Predicted_Demand", *QCOLS]))(
    lambda s, sf: FC.native_quantile_forecast(daily(s, sf)))

query("fc_slot", """
SELECT MDCODE AS Medicine_ID, CAST(cutoff + CAST(h AS INTEGER) AS DATE) AS Forecast_Date,
  CAST(least(n, 730) AS INTEGER) AS Context_Length_Used, CAST(NULL AS VARCHAR) AS error, """ + ", ".join(
    f"list_avg(y[greatest(n - 6, 1):n]) * 2 * {q}::DOUBLE AS {c}" for c, q in QSQL.items()) + """
FROM (SELECT *, len(y) AS n FROM hist_end_sup) AS s, ahead30""", cut=" ".join(QCOLS))(
    lambda s, sf: FC.quantile_slot(daily(s, sf), FC.last_week_mean).drop("Predicted_Demand"))

# a model that is called for many items at once, refuses some and returns unusable output for others
FAULTS = {0: "no such item", 1: "values are negative", 2: "dates are not sorted", 3: None, 4: "values are not finite"}


def faulty_model(batch, horizon, levels):
    import numpy as np

    kind = [int(i) % 9 for i in batch.items]
    if 0 in kind:
        raise LookupError(FAULTS[0])
    ahead, out = np.arange(1, horizon + 1), batched.last_week_means(batch, horizon, levels)
    dates = {2: ahead[::-1]}
    change = {1: lambda q: -1 - q, 3: lambda q: q[:, ::-1], 4: lambda q: q * np.nan}
    return [(last + dates.get(k, ahead), change.get(k, lambda q: q)(q)) for k, last, q in zip(kind, batch.last_days, out)]


define("batch_sup", """
SELECT MDCODE, cutoff, CAST(least(n, 730) AS INTEGER) AS used, CAST(MDCODE AS INTEGER) % 9 AS kind,
  list_avg(y[greatest(n - 6, 1):n]) * 2 AS m FROM (SELECT *, len(y) AS n FROM hist_end_sup) AS s""")
query("fc_batched_slot", """
SELECT MDCODE AS Medicine_ID, CAST(cutoff + CAST(h AS INTEGER) AS DATE) AS Forecast_Date, used AS Context_Length_Used,
  kind = 3 AND m > 0 AS Order_Repaired, CAST(NULL AS VARCHAR) AS error, """ + ", ".join(
    f"m * CASE WHEN kind = 3 THEN {max(QSQL.values())}::DOUBLE ELSE {q}::DOUBLE END AS {c}" for c, q in QSQL.items()) + """
FROM batch_sup, ahead30 WHERE kind NOT IN (0, 1, 2, 4) UNION ALL
SELECT MDCODE, NULL, NULL, NULL, CASE kind """ + " ".join(f"WHEN {k} THEN '{v}'" for k, v in FAULTS.items() if v) + """ END, """ + ", ".join(
    "NULL" for _ in QSQL) + """
FROM batch_sup WHERE kind IN (0, 1, 2, 4)""", cut=" ".join(QCOLS))(
    lambda s, sf: batched.batched_quantile_slot(daily(s, sf), faulty_model, batch_items=16).drop("Predicted_Demand"))

query("monotone_quantiles", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate,
  greatest(l_extendedprice, 0) AS P10, greatest(l_extendedprice, l_quantity * 100, 0) AS P50,
  greatest(l_extendedprice, l_quantity * 100, l_discount, 0) AS P90 FROM lineitem""")(
    lambda s, sf: FC.monotone_quantiles(V.table(s, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate",
        F.col("l_extendedprice").alias("P10"), (F.col("l_quantity") * 100).alias("P50"),
        F.col("l_discount").alias("P90")), ["P10", "P50", "P90"]))

# ================================================================ daily backtests
for g in ("brand", "sup"):
    define(f"bt_hist_{g}", f"""
SELECT d.MDCODE, c.cutoff, list(Demand_Qty ORDER BY INVDT) FILTER (WHERE INVDT <= c.cutoff) AS y,
  list(Demand_Qty ORDER BY INVDT) FILTER (WHERE INVDT > c.cutoff AND INVDT <= c.cutoff + 30) AS fut
FROM dense_{g} d, {sql_dates(DAILY_CUTOFFS)} AS c GROUP BY 1, 2
HAVING count(*) FILTER (WHERE INVDT <= c.cutoff) >= 730
  AND count(*) FILTER (WHERE INVDT > c.cutoff) >= 30""")
define("bt_state_brand", state_sql("bt_hist_brand"))
define("bt_rows_brand", unpivot_sql(
    models_sql("", "h"), "MDCODE AS Medicine_ID, cutoff AS Cutoff_Date, fut[h] AS Actual",
    "bt_state_brand, ahead30"))

METRICS = """
  count(*) AS Sample_Count, sum(Actual) AS Total_Actual, sum(Predicted) AS Total_Predicted,
  sum(abs(Actual - Predicted)) AS Total_Absolute_Error,
  CASE WHEN sum(Actual) > 0 THEN sum(abs(Actual - Predicted)) / sum(Actual) * 100 ELSE 0 END AS WAPE_Pct,
  avg(abs(Actual - Predicted)) AS MAE,
  avg(CASE WHEN abs(Actual) + abs(Predicted) > 0
    THEN 200 * abs(Actual - Predicted) / (abs(Actual) + abs(Predicted)) ELSE 0 END) AS sMAPE_Pct,
  avg(Predicted - Actual) AS MBE, {cov} AS P10_P90_Coverage_Pct"""
COVER = "avg(CASE WHEN Actual >= P10 AND Actual <= P90 THEN 100.0::DOUBLE ELSE 0 END)"
METRIC_CUT = "Total_Predicted Total_Absolute_Error WAPE_Pct MAE sMAPE_Pct MBE P10_P90_Coverage_Pct"
define("bt_windows_brand", "SELECT Model, Cutoff_Date, Medicine_ID, "
       + METRICS.format(cov="CAST(0 AS DOUBLE)") + " FROM bt_rows_brand GROUP BY 1, 2, 3")
query("bt_daily", "SELECT * FROM bt_windows_brand", cut=METRIC_CUT)(
    lambda s, sf: BT.daily_backtest(daily(s, sf, "brand"), DAILY_CUTOFFS))

define("bt_quant_brand", f"""
SELECT MDCODE, cutoff, ctx, fut, {", ".join(
    f"list_aggregate(w, 'quantile_cont', {q}) AS {c}" for c, q in QSQL.items())}
FROM (SELECT MDCODE, cutoff, ctx, fut, y[greatest(len(y) - ctx + 1, 1):] AS w
  FROM bt_hist_brand, (SELECT unnest({CONTEXTS}) AS ctx) AS x) AS t""")
define("bt_quant_rows_brand", unpivot_sql(
    {f"quantile-{c}": c for c in QCOLS},
    "MDCODE AS Medicine_ID, cutoff AS Cutoff_Date, ctx AS Context_Length, P10, P90, fut[h] AS Actual",
    "bt_quant_brand, ahead30"))
define("bt_quant_windows_brand", "SELECT Context_Length, Model, Cutoff_Date, Medicine_ID, "
       + METRICS.format(cov=COVER) + " FROM bt_quant_rows_brand GROUP BY 1, 2, 3, 4")
query("bt_quantile", "SELECT * FROM bt_quant_windows_brand", cut=METRIC_CUT)(
    lambda s, sf: BT.quantile_backtest(daily(s, sf, "brand"), DAILY_CUTOFFS, CONTEXTS))

SUMMARY = """
  count(*) AS Windows, count(DISTINCT Medicine_ID) AS Medicines, CAST(sum(Sample_Count) AS BIGINT) AS Samples,
  sum(Total_Actual) AS Total_Actual, sum(Total_Predicted) AS Total_Predicted,
  sum(Total_Absolute_Error) AS Total_Absolute_Error, avg(MAE) AS MAE, avg(sMAPE_Pct) AS sMAPE_Pct,
  avg(MBE) AS MBE, avg(P10_P90_Coverage_Pct) AS P10_P90_Coverage_Pct,
  sum(Total_Absolute_Error) / nullif(sum(Total_Actual), 0) * 100 AS WAPE_Pct"""
query("bt_daily_summary", f"""
SELECT Model, {SUMMARY} FROM (SELECT * FROM bt_windows_brand UNION ALL
  SELECT * EXCLUDE (Context_Length) FROM bt_quant_windows_brand WHERE Context_Length = 730) AS w
GROUP BY Model""", cut=METRIC_CUT)(
    lambda s, sf: BT.backtest_summary(BT.run_backtest(daily(s, sf, "brand"), DAILY_CUTOFFS)))
define("sweep_brand", f"""
SELECT Context_Length, Model, {SUMMARY} FROM bt_quant_windows_brand GROUP BY 1, 2""")
query("context_sweep", "SELECT * FROM sweep_brand", cut=METRIC_CUT)(
    lambda s, sf: BT.context_sweep(daily(s, sf, "brand"), DAILY_CUTOFFS, CONTEXTS))
query("best_context", """
SELECT * FROM sweep_brand WHERE Model = 'quantile-P50' ORDER BY WAPE_Pct, Context_Length LIMIT 1""",
      cut=METRIC_CUT)(lambda s, sf: BT.best_context(
          BT.context_sweep(daily(s, sf, "brand"), DAILY_CUTOFFS, CONTEXTS)))

query("bt_cutoffs", "SELECT MDCODE, cutoff FROM bt_hist_sup")(
    lambda s, sf: BT.fixed_cutoffs(daily(s, sf), DAILY_CUTOFFS))
query("rolling_cutoffs", """
SELECT DISTINCT MDCODE, lo + CAST(floor(729 + i * (CASE WHEN m > 1
    THEN (n - 31 - 729) / CAST(m - 1 AS DOUBLE) ELSE 0 END)) AS INTEGER) AS cutoff
FROM (SELECT *, unnest(range(0, m)) AS i FROM (
  SELECT MDCODE, min(INVDT) AS lo, count(*) AS n, least(5, count(*) - 31 - 729 + 1) AS m
  FROM dense_sup GROUP BY 1 HAVING count(*) >= 760) AS a) AS b""")(
    lambda s, sf: BT.rolling_cutoffs(daily(s, sf), 5))

# ================================================================ monthly backtests
define("month_hist", f"""
SELECT m.Medicine_ID, c.cutoff, list(Actual ORDER BY Month) FILTER (WHERE Month <= c.cutoff) AS y,
  max(Actual) FILTER (WHERE Month = c.cutoff + INTERVAL 1 MONTH) AS Actual
FROM month_sup m, {sql_dates(MONTH_CUTOFFS)} AS c GROUP BY 1, 2
HAVING count(*) FILTER (WHERE Month <= c.cutoff) >= 12
  AND count(*) FILTER (WHERE Month = c.cutoff + INTERVAL 1 MONTH) = 1""")
define("month_state", state_sql("month_hist", p0="0.5"))
MONTH_MODELS = {
    "naive": "y[n]", "seasonal_naive": "y[n - 11]",
    "croston": "CASE WHEN k = 0 THEN 0 WHEN k = 1 THEN list_sum(vals) / n "
               "ELSE list_sum(vals) / pos[k] END",
    "sba": "0.95::DOUBLE * CASE WHEN k = 0 THEN 0 WHEN k = 1 THEN list_sum(vals) / n "
           "ELSE list_sum(vals) / pos[k] END",
    "tsb": "CASE WHEN k = 0 THEN 0 ELSE p * z END",
}
MONTH_COLS = ("cutoff AS Cutoff_Date, CAST(cutoff + INTERVAL 1 MONTH AS DATE) AS Forecast_Month, "
              "Medicine_ID, Actual")
define("month_quant", f"""
SELECT Medicine_ID, cutoff, Actual, {", ".join(
    f"list_aggregate(y[greatest(len(y) - {CONTEXT_MONTHS} + 1, 1):], 'quantile_cont', {q}) AS {c}"
    for c, q in QSQL.items())} FROM month_hist""")
define("month_rows_classic", "SELECT *, abs(Actual - Predicted) AS Absolute_Error FROM ("
       + unpivot_sql(MONTH_MODELS, MONTH_COLS, "month_state") + ") AS m")
define("month_rows_quant", "SELECT *, abs(Actual - Predicted) AS Absolute_Error FROM ("
       + unpivot_sql({f"quantile-{c}": c for c in QCOLS}, MONTH_COLS, "month_quant") + ") AS m")
SPLIT = ("CASE WHEN Cutoff_Date IN (" + ", ".join(f"DATE '{d}'" for d in MONTH_VALIDATION)
         + ") THEN 'validation' WHEN Cutoff_Date IN (" + ", ".join(f"DATE '{d}'" for d in MONTH_HOLDOUT)
         + ") THEN 'holdout' ELSE 'unknown' END AS Split")
define("month_results", f"SELECT *, {SPLIT} FROM (SELECT * FROM month_rows_classic UNION ALL "
                        "SELECT * FROM month_rows_quant) AS u")


def monthly(spark, sf):
    return series.monthly_experiment(daily(spark, sf))


def monthly_results(spark, sf, demand=None):
    """Classical and quantile rows together, with split."""
    m = monthly(spark, sf) if demand is None else series.monthly_experiment(demand)
    rows = BT.monthly_backtest(m, MONTH_CUTOFFS, CONTEXT_MONTHS, "both")
    return BT.add_split(rows, MONTH_VALIDATION, MONTH_HOLDOUT)


ROW_CUT = "Predicted Absolute_Error"
query("bt_monthly", "SELECT * FROM month_rows_classic", cut=ROW_CUT)(
    lambda s, sf: BT.monthly_backtest(monthly(s, sf), MONTH_CUTOFFS))
query("bt_monthly_quantile", "SELECT * FROM month_rows_quant", cut=ROW_CUT)(
    lambda s, sf: BT.monthly_backtest(monthly(s, sf), MONTH_CUTOFFS, CONTEXT_MONTHS, "quantile"))
define("month_summary", """
SELECT Model, Cutoff_Date, Split, count(DISTINCT Medicine_ID) AS Medicines, sum(Actual) AS Actual,
  sum(Predicted) AS Predicted, sum(Absolute_Error) AS Absolute_Error, avg(Absolute_Error) AS MAE,
  sum(Absolute_Error) / nullif(sum(Actual), 0) * 100 AS WAPE, sum(Predicted) / nullif(sum(Actual), 0) AS Ratio,
  sum(Predicted) - sum(Actual) AS MBE FROM month_results GROUP BY 1, 2, 3""")
MS_CUT = "Predicted Absolute_Error MAE WAPE Ratio"
query("bt_monthly_summary", "SELECT * FROM month_summary", cut=MS_CUT + " MBE")(
    lambda s, sf: BT.monthly_summary(monthly_results(s, sf).drop("Split"), MONTH_VALIDATION,
                                     MONTH_HOLDOUT))
define("month_split", """
SELECT Split, Model, avg(Medicines) AS Medicines, sum(Actual) AS Actual, sum(Predicted) AS Predicted,
  sum(Absolute_Error) AS Absolute_Error, avg(MAE) AS MAE,
  sum(Absolute_Error) / nullif(sum(Actual), 0) * 100 AS WAPE,
  sum(Predicted) / nullif(sum(Actual), 0) AS Ratio FROM month_summary GROUP BY 1, 2""")


def split_rows(spark, sf):
    return BT.split_summary(BT.monthly_summary(
        monthly_results(spark, sf).drop("Split"), MONTH_VALIDATION, MONTH_HOLDOUT))


query("bt_split_summary", "SELECT * FROM month_split", cut="Medicines " + MS_CUT)(split_rows)
query("best_on_validation", """
SELECT * FROM month_split WHERE Split = 'validation' ORDER BY WAPE, Model LIMIT 1""",
      cut="Medicines " + MS_CUT)(lambda s, sf: BT.best_on_validation(split_rows(s, sf)))
query("pooled_by_model", """
SELECT Split, Model, count(*) AS Rows, sum(Actual) AS Actual, sum(Predicted) AS Predicted,
  sum(Absolute_Error) AS Absolute_Error, sum(Absolute_Error) / nullif(sum(Actual), 0) * 100 AS WAPE_Pct,
  sum(Predicted) / nullif(sum(Actual), 0) AS Ratio, avg(Predicted - Actual) AS MBE,
  avg(Absolute_Error) AS MAE FROM month_results GROUP BY 1, 2""",
      cut="Predicted Absolute_Error WAPE_Pct Ratio MBE MAE")(
    lambda s, sf: BT.pooled_by_model(monthly_results(s, sf), ("Split", "Model")))
