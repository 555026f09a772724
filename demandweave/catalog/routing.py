"""Registered queries: calibration, ensembles, comparison, routing, serving, alerts."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .. import schemas as S
from ..operators import backtest as BT
from ..operators import forecast as FC
from ..operators import quality, series, serving
from ..operators import routing as R
from ..session import cut_lineage, remember, work_folder
from ..sources.documents import DocumentStore
from . import views as V
from .demand import QCOLS, daily, monthly_results, stored_daily
from .registry import query
from .sqlbase import define

C, B = R.CHALLENGER, R.BASELINE
REG = "Regime Days NonZero_Days ADI CV2 Total_Demand".split()

# ================================================================ calibration
define("cal_rows", f"SELECT * FROM month_results WHERE Model = '{C}'")
define("cal_global", """
SELECT sum(Actual) / sum(Predicted) AS g FROM cal_rows WHERE Split = 'validation'""")
define("cal_factors", """
SELECT Medicine_ID, sum(Actual) AS Validation_Actual, sum(Predicted) AS Validation_Predicted,
  count(Predicted) AS Validation_Samples,
  least(greatest(coalesce(sum(Actual) / nullif(sum(Predicted), 0), max(g)), 0.5), 1.5) AS Raw_Factor,
  max(g) AS Global_Factor
FROM cal_rows, cal_global WHERE Split = 'validation' GROUP BY 1""")
define("cal_ways", "SELECT 'raw' AS Method, CAST(1 AS DOUBLE) AS Parameter UNION ALL "
       "SELECT 'global', g FROM cal_global UNION ALL SELECT 'item_shrinkage', unnest("
       + str(FC.SHRINKAGE) + "::DOUBLE[])")
define("cal_scored", """
SELECT r.Split, w.Method, w.Parameter, r.Actual, greatest(r.Predicted * CASE w.Method WHEN 'raw' THEN 1
  WHEN 'global' THEN g ELSE g + coalesce(f.Validation_Samples, 0)
    / (coalesce(f.Validation_Samples, 0) + w.Parameter) * (coalesce(f.Raw_Factor, g) - g) END, 0) AS p
FROM cal_rows r CROSS JOIN cal_ways w CROSS JOIN cal_global
LEFT JOIN cal_factors f ON r.Medicine_ID = f.Medicine_ID
WHERE r.Split IN ('validation', 'holdout')""")


def challenger_rows(spark, sf):
    return cut_lineage(monthly_results(spark, sf).where(F.col("Model") == C))


query("calibration_factors", "SELECT * FROM cal_factors",
      cut="Raw_Factor Global_Factor Validation_Predicted")(
    lambda s, sf: FC.calibration_factors(challenger_rows(s, sf)))
query("calibration", """
SELECT Split, Method, Parameter, sum(Actual) AS Actual, sum(p) AS Predicted,
  sum(abs(Actual - p)) AS Absolute_Error, sum(abs(Actual - p)) / sum(Actual) * 100 AS WAPE,
  sum(p) / sum(Actual) AS Ratio, sum(p) - sum(Actual) AS MBE FROM cal_scored GROUP BY 1, 2, 3""",
      cut="Parameter Predicted Absolute_Error WAPE Ratio MBE")(
    lambda s, sf: FC.calibration_study(challenger_rows(s, sf)))

# ================================================================ comparison
define("cmp", f"""
SELECT *, Challenger_AE < Baseline_AE AS Challenger_Better,
  Baseline_AE - Challenger_AE AS Error_Difference,
  CASE WHEN Challenger_AE < Baseline_AE THEN '{C}' ELSE '{B}' END AS Winner,
  Challenger_AE / nullif(Actual, 0) * 100 AS Challenger_WAPE,
  Baseline_AE / nullif(Actual, 0) * 100 AS Baseline_WAPE, false AS Actual_Mismatch
FROM (SELECT c.Split, c.Medicine_ID, c.Actual, c.p AS Challenger_Predicted, c.e AS Challenger_AE,
    b.p AS Baseline_Predicted, b.e AS Baseline_AE
  FROM (SELECT Split, Medicine_ID, sum(Actual) AS Actual, sum(Predicted) AS p, sum(Absolute_Error) AS e
    FROM month_results WHERE Model = '{C}' AND Split <> 'unknown' GROUP BY 1, 2) AS c
  JOIN (SELECT Split, Medicine_ID, sum(Predicted) AS p, sum(Absolute_Error) AS e
    FROM month_results WHERE Model = '{B}' AND Split <> 'unknown' GROUP BY 1, 2) AS b
  ON c.Split = b.Split AND c.Medicine_ID = b.Medicine_ID) AS j
LEFT JOIN regime_sup USING (Medicine_ID)""")
CMP_CUT = ("Challenger_Predicted Challenger_AE Baseline_Predicted Baseline_AE Error_Difference "
           "Challenger_WAPE Baseline_WAPE ADI CV2")


def comparison(spark, sf, demand=None):
    d = stored_daily(spark, sf) if demand is None else demand
    return R.build_comparison(monthly_results(spark, sf, d), series.demand_regimes(d))


def stored_comparison(spark, sf):
    """For studies that read the comparison several times (one row per split and item)."""
    return cut_lineage(comparison(spark, sf))


query("model_errors", f"""
SELECT Split, Medicine_ID, sum(Actual) AS Actual, sum(Predicted) AS Baseline_Predicted,
  sum(Absolute_Error) AS Baseline_AE, sum(Absolute_Error) / nullif(sum(Actual), 0) * 100 AS Baseline_WAPE
FROM month_results WHERE Model = '{B}' GROUP BY 1, 2""",
      cut="Baseline_Predicted Baseline_AE Baseline_WAPE")(
    lambda s, sf: R.model_errors(monthly_results(s, sf), B, "Baseline"))
query("comparison", "SELECT * FROM cmp", cut=CMP_CUT)(comparison)

# ensembles work on the comparison
define("ens_w", f"SELECT unnest({FC.WEIGHTS}::DOUBLE[]) AS w")
define("ens_table", """
SELECT w AS Challenger_Weight, floor((1 - w) * 10 + 0.5) / 10 AS Baseline_Weight,
  sum(abs(Actual - (w * Challenger_Predicted + (1 - w) * Baseline_Predicted))) / sum(abs(Actual)) * 100
    AS Validation_WAPE FROM cmp, ens_w WHERE Split = 'validation' GROUP BY w""")
query("ensemble_weights", """
SELECT *, row_number() OVER (ORDER BY Validation_WAPE, Challenger_Weight) = 1 AS Selected
FROM ens_table""", cut="Validation_WAPE")(lambda s, sf: FC.ensemble_weights(comparison(s, sf)))
define("ens_best", """
SELECT Challenger_Weight AS bw FROM ens_table ORDER BY Validation_WAPE, Challenger_Weight LIMIT 1""")
BLENDS = {"challenger": "Challenger_Predicted", "baseline": "Baseline_Predicted",
          "simple_ensemble": "0.5::DOUBLE * Challenger_Predicted + 0.5::DOUBLE * Baseline_Predicted",
          "adaptive_ensemble": "bw * Challenger_Predicted + (1 - bw) * Baseline_Predicted"}
define("ens_rows", " UNION ALL ".join(
    f"SELECT Split, Medicine_ID, Actual, '{m}' AS Model, {e} AS p FROM cmp, ens_best"
    for m, e in BLENDS.items()))
query("ensemble_summary", """
SELECT Split, Model, count(DISTINCT Medicine_ID) AS Medicines, sum(Actual) AS Actual, sum(p) AS Predicted,
  sum(abs(Actual - p)) AS Absolute_Error, sum(abs(Actual - p)) / sum(abs(Actual)) * 100 AS WAPE
FROM ens_rows GROUP BY 1, 2""", cut="Predicted Absolute_Error WAPE")(
    lambda s, sf: FC.ensemble_summary(stored_comparison(s, sf)))
query("ensemble_by_item", """
SELECT *, adaptive_ensemble_ae < challenger_ae AS adaptive_beats_challenger,
  adaptive_ensemble_ae < baseline_ae AS adaptive_beats_baseline,
  adaptive_ensemble_ae < challenger_ae AND adaptive_ensemble_ae < baseline_ae AS adaptive_beats_both
FROM (SELECT *, """ + ", ".join(f"abs(Actual - {m}_predicted) AS {m}_ae" for m in BLENDS) + """
  FROM (SELECT Medicine_ID, Actual, """ + ", ".join(f"{e} AS {m}_predicted" for m, e in BLENDS.items())
      + " FROM cmp, ens_best WHERE Split = 'holdout') AS a) AS b",
      cut=" ".join(f"{m}_predicted {m}_ae" for m in BLENDS))(
    lambda s, sf: FC.ensemble_by_item(stored_comparison(s, sf)))

# ================================================================ stability
MEAS = ["Challenger_WAPE", "Baseline_WAPE", "Challenger_AE", "Baseline_AE", "Winner"]
define("stab", f"""
SELECT *, Validation_Winner = Holdout_Winner AS Winner_Stable,
  Validation_Winner || ' -> ' || Holdout_Winner AS Transition,
  Validation_Baseline_AE - Validation_Challenger_AE AS Validation_Advantage,
  Holdout_Baseline_AE - Holdout_Challenger_AE AS Holdout_Advantage,
  abs(Validation_Baseline_AE - Validation_Challenger_AE) AS Absolute_Validation_Advantage
FROM (SELECT v.Medicine_ID, {", ".join("v." + c for c in REG)},
  {", ".join(f"v.{m} AS Validation_{m}, h.{m} AS Holdout_{m}" for m in MEAS)}
  FROM cmp v JOIN cmp h ON v.Medicine_ID = h.Medicine_ID
  WHERE v.Split = 'validation' AND h.Split = 'holdout') AS s""")
STAB_CUT = ("ADI CV2 Validation_Advantage Holdout_Advantage Absolute_Validation_Advantage " + " ".join(
    f"{s}_{m}" for s in ("Validation", "Holdout") for m in MEAS[:4]))


def stability(spark, sf):
    return R.stability_table(comparison(spark, sf))


def stored_stability(spark, sf):
    return cut_lineage(stability(spark, sf))


query("stability", "SELECT * FROM stab", cut=STAB_CUT)(stability)
STABLE = """count(*) AS Medicines, count(*) FILTER (WHERE Winner_Stable) AS Stable,
  count(*) FILTER (WHERE Winner_Stable) * 100.0::DOUBLE / count(*) AS Stability_Percentage"""
query("stability_by_regime", f"SELECT Regime, {STABLE} FROM stab GROUP BY 1",
      cut="Stability_Percentage")(lambda s, sf: R.stability_by_regime(stability(s, sf)))
define("stab_bucket", """
SELECT *, CASE WHEN Total_Demand <= e1 THEN 'Q1_Low' WHEN Total_Demand <= e2 THEN 'Q2'
  WHEN Total_Demand <= e3 THEN 'Q3' ELSE 'Q4_High' END AS Demand_Bucket
FROM stab, (SELECT quantile_cont(Total_Demand, 0.25) AS e1, quantile_cont(Total_Demand, 0.5) AS e2,
  quantile_cont(Total_Demand, 0.75) AS e3 FROM stab) AS e""")
query("stability_by_volume", f"""
SELECT Demand_Bucket, {STABLE}, avg(Total_Demand) AS Avg_Demand FROM stab_bucket GROUP BY 1""",
      cut="Stability_Percentage Avg_Demand")(lambda s, sf: R.stability_by_volume(stored_stability(s, sf)))
query("transitions", """
SELECT Transition, count(*) AS Medicines, avg(Validation_Advantage) AS Mean_Validation_Advantage,
  avg(Holdout_Advantage) AS Mean_Holdout_Advantage FROM stab GROUP BY 1""",
      cut="Mean_Validation_Advantage Mean_Holdout_Advantage")(
    lambda s, sf: R.transition_summary(stability(s, sf)))

# ================================================================ routing table
RULE = R.rule_name()
define("routes", f"""
SELECT *, CASE WHEN Validation_Advantage_Pct >= 30 THEN '{C}' ELSE '{B}' END AS Selected_Model,
  '{RULE}' AS Routing_Rule, CAST(30 AS DOUBLE) AS Threshold
FROM (SELECT Medicine_ID, Challenger_AE AS Validation_Challenger_AE, Baseline_AE AS Validation_Baseline_AE,
    (Baseline_AE - Challenger_AE) / nullif(Baseline_AE, 0) * 100 AS Validation_Advantage_Pct
  FROM cmp WHERE Split = 'validation') AS r WHERE Validation_Advantage_Pct IS NOT NULL""")
ROUTE_CUT = "Validation_Challenger_AE Validation_Baseline_AE Validation_Advantage_Pct"


def routing_table(spark, sf, demand=None):
    return R.build_routing_table(comparison(spark, sf, demand))


query("routing_table", "SELECT * FROM routes", cut=ROUTE_CUT)(routing_table)
query("routing_decisions", f"""
SELECT Medicine_ID, Selected_Model, Routing_Rule, Validation_Advantage_Pct,
  'Validation advantage ' || printf('%.2f', Validation_Advantage_Pct) || '% '
  || CASE WHEN Validation_Advantage_Pct >= 30 THEN '>=' ELSE '<' END || ' 30% threshold' AS Reason
FROM routes""", cut="Validation_Advantage_Pct")(
    lambda s, sf: R.routing_decisions(routing_table(s, sf)))
query("routing_contract", """
SELECT CAST(0 AS BIGINT) AS duplicate_id, CAST(0 AS BIGINT) AS empty_id,
  count(*) FILTER (WHERE Validation_Advantage_Pct IS NULL) AS advantage_not_finite,
  CAST(0 AS BIGINT) AS unknown_model, count(*) FILTER (WHERE Threshold <> 20) AS wrong_threshold,
  count(*) FILTER (WHERE Validation_Advantage_Pct >= 20 AND Validation_Advantage_Pct < 30)
    AS decision_against_rule FROM routes""")(
    lambda s, sf: quality.check_routing(routing_table(s, sf), [C, B], C, threshold=20.0))
query("advantage_guard", f"""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, adv,
  CASE WHEN adv >= 30 THEN '{C}' ELSE '{B}' END AS Selected_Model
FROM (SELECT *, CASE WHEN l_discount > 0 THEN (l_discount - l_tax) / l_discount * 100 END AS adv
  FROM lineitem) AS t""", cut="adv")(
    lambda s, sf: V.table(s, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate",
        R.validation_advantage(F.col("l_tax"), F.col("l_discount")).alias("adv")
    ).withColumn("Selected_Model", R.select_model(F.col("adv"))))

# ================================================================ regime routing
define("reg_rules", f"""
SELECT *, CASE WHEN Challenger_WAPE < Baseline_WAPE THEN '{C}' ELSE '{B}' END AS Selected_Model,
  'validation_only' AS Selection_Basis
FROM (SELECT Regime, count(DISTINCT Medicine_ID) AS Medicines,
    sum(Challenger_AE) / nullif(sum(Actual), 0) * 100 AS Challenger_WAPE,
    sum(Baseline_AE) / nullif(sum(Actual), 0) * 100 AS Baseline_WAPE
  FROM cmp WHERE Split = 'validation' AND Regime IS NOT NULL GROUP BY 1) AS g""")
query("regime_rules", "SELECT * FROM reg_rules", cut="Challenger_WAPE Baseline_WAPE")(
    lambda s, sf: R.regime_rules(comparison(s, sf)))
define("routed_rows", f"""
SELECT c.*, coalesce(r.Selected_Model, '{B}') AS sel FROM cmp c
LEFT JOIN (SELECT Regime, Selected_Model FROM reg_rules) r ON c.Regime = r.Regime""")
query("routed_overall", " UNION ALL ".join(
    f"SELECT Split, '{m}' AS Model, count(DISTINCT Medicine_ID) AS Medicines, sum(Actual) AS Actual, "
    f"sum({e}) AS Absolute_Error, sum({e}) / nullif(sum(Actual), 0) * 100 AS WAPE FROM routed_rows "
    f"GROUP BY Split" for m, e in {
        C: "Challenger_AE", B: "Baseline_AE",
        "routed_hybrid": f"CASE WHEN sel = '{C}' THEN Challenger_AE ELSE Baseline_AE END"}.items()),
      cut="Absolute_Error WAPE")(lambda s, sf: (
          lambda c: R.routed_overall(c, R.regime_rules(c)))(stored_comparison(s, sf)))
define("exp_rows", f"""
SELECT c.Split, c.Medicine_ID, c.Actual, c.Predicted AS pc, b.Predicted AS pb,
  coalesce(r.Selected_Model, '{B}') AS sel
FROM month_results c JOIN month_results b ON c.Cutoff_Date = b.Cutoff_Date
  AND c.Medicine_ID = b.Medicine_ID AND c.Model = '{C}' AND b.Model = '{B}'
LEFT JOIN regime_sup g ON c.Medicine_ID = g.Medicine_ID
LEFT JOIN (SELECT Regime, Selected_Model FROM reg_rules) r ON g.Regime = r.Regime""")
query("regime_experiment", " UNION ALL ".join(
    f"SELECT Split, '{m}' AS Model, count(*) AS Rows, sum(Actual) AS Actual, sum({e}) AS Predicted, "
    f"sum(abs(Actual - {e})) AS Absolute_Error, sum(abs(Actual - {e})) / sum(Actual) * 100 AS WAPE_Pct, "
    f"sum({e}) / sum(Actual) AS Ratio, avg({e} - Actual) AS MBE, avg(abs(Actual - {e})) AS MAE "
    f"FROM exp_rows GROUP BY Split" for m, e in {
        C: "pc", B: "pb", "routed_hybrid": f"CASE WHEN sel = '{C}' THEN pc ELSE pb END"}.items()),
      cut="Predicted Absolute_Error WAPE_Pct Ratio MBE MAE")(
    lambda s, sf: (lambda d: R.regime_routing_experiment(
        cut_lineage(monthly_results(s, sf, d)), series.demand_regimes(d)))(stored_daily(s, sf)))

# ================================================================ frozen rule
define("frozen", f"""
SELECT h.*, v.adv AS Validation_Advantage_Pct,
  CASE WHEN v.adv >= 30 THEN '{C}' ELSE '{B}' END AS Selected_Model,
  CASE WHEN v.adv >= 30 THEN h.Challenger_Predicted ELSE h.Baseline_Predicted END AS sp
FROM cmp h JOIN (SELECT Medicine_ID, (Baseline_AE - Challenger_AE) / nullif(Baseline_AE, 0) * 100 AS adv
  FROM cmp WHERE Split = 'validation') v ON h.Medicine_ID = v.Medicine_ID WHERE h.Split = 'holdout'""")
FROZEN_VIEWS = {C: "Challenger_Predicted", B: "Baseline_Predicted",
                "simple_ensemble": "(Challenger_Predicted + Baseline_Predicted) / 2",
                "frozen_routing": "sp"}
define("frozen_m", " UNION ALL ".join(
    f"SELECT '{m}' AS Model, count(DISTINCT Medicine_ID) AS Medicines, sum(Actual) AS Actual, "
    f"sum({e}) AS Predicted, sum(abs(Actual - {e})) AS Absolute_Error, "
    f"sum(abs(Actual - {e})) / nullif(sum(Actual), 0) * 100 AS WAPE FROM frozen"
    for m, e in FROZEN_VIEWS.items()))
query("frozen_models", f"""
SELECT *, (SELECT WAPE FROM frozen_m WHERE Model = '{B}') - WAPE AS Improvement_vs_Baseline,
  (SELECT WAPE FROM frozen_m WHERE Model = '{C}') - WAPE AS Improvement_vs_Challenger,
  (SELECT WAPE FROM frozen_m WHERE Model = 'simple_ensemble') - WAPE AS Improvement_vs_Ensemble
FROM frozen_m""", cut="Predicted Absolute_Error WAPE Improvement_vs_Baseline "
                      "Improvement_vs_Challenger Improvement_vs_Ensemble")(
    lambda s, sf: R.frozen_rule_models(R.frozen_rule_holdout(comparison(s, sf))))
define("frozen_i", """
SELECT *, rh < ch AS Routing_Better_Than_Challenger, rh < bh AS Routing_Better_Than_Baseline,
  rh < ch AND rh < bh AS Routing_Better_Than_Both FROM (
SELECT Medicine_ID, Regime, ADI, CV2, Total_Demand, Validation_Advantage_Pct, Selected_Model,
  Actual AS Holdout_Actual, abs(Actual - Challenger_Predicted) AS ch, abs(Actual - Baseline_Predicted) AS bh,
  abs(Actual - sp) AS rh FROM frozen) AS i""")
query("frozen_items", """
SELECT Medicine_ID, Regime, ADI, CV2, Total_Demand, Validation_Advantage_Pct, Selected_Model,
  Holdout_Actual, ch AS Challenger_Holdout_AE, bh AS Baseline_Holdout_AE, rh AS Routing_Holdout_AE,
  ch / nullif(Holdout_Actual, 0) * 100 AS Challenger_Holdout_WAPE,
  bh / nullif(Holdout_Actual, 0) * 100 AS Baseline_Holdout_WAPE,
  rh / nullif(Holdout_Actual, 0) * 100 AS Routing_Holdout_WAPE, Routing_Better_Than_Challenger,
  Routing_Better_Than_Baseline, Routing_Better_Than_Both FROM frozen_i""",
      cut="ADI CV2 Validation_Advantage_Pct " + " ".join(
          f"{x}_Holdout_{k}" for x in ("Challenger", "Baseline", "Routing") for k in ("AE", "WAPE")))(
    lambda s, sf: R.frozen_rule_items(R.frozen_rule_holdout(comparison(s, sf))))
WAPES3 = ", ".join(f"sum({k}) / nullif(sum(Holdout_Actual), 0) * 100 AS {x}_WAPE"
                   for x, k in (("Routing", "rh"), ("Challenger", "ch"), ("Baseline", "bh")))
COUNTS = f"""count(*) FILTER (WHERE Selected_Model = '{C}') AS Challenger_Selected,
  count(*) FILTER (WHERE Selected_Model = '{B}') AS Baseline_Selected,
  count(*) FILTER (WHERE Routing_Better_Than_Baseline) AS Routing_Better_Than_Baseline,
  count(*) FILTER (WHERE Routing_Better_Than_Challenger) AS Routing_Better_Than_Challenger"""
query("frozen_regimes", f"""
SELECT Regime, count(*) AS Medicines, {WAPES3}, {COUNTS} FROM frozen_i WHERE Regime IS NOT NULL
GROUP BY 1""", cut="Routing_WAPE Challenger_WAPE Baseline_WAPE")(
    lambda s, sf: R.frozen_rule_regimes(R.frozen_rule_items(R.frozen_rule_holdout(comparison(s, sf)))))
query("frozen_summary", f"""
SELECT *, 'Frozen validation-to-holdout' AS Backtest_Type, CAST(30 AS DOUBLE) AS Advantage_Threshold_Pct,
  (SELECT count(DISTINCT Medicine_ID) FROM cmp WHERE Split = 'validation') AS Validation_Medicines,
  Challenger_Selected * 100.0::DOUBLE / Holdout_Medicines AS Challenger_Selection_Pct,
  Baseline_Selected * 100.0::DOUBLE / Holdout_Medicines AS Baseline_Selection_Pct,
  Baseline_WAPE - Routing_WAPE AS Routing_Improvement_vs_Baseline,
  Challenger_WAPE - Routing_WAPE AS Routing_Improvement_vs_Challenger,
  Ensemble_WAPE - Routing_WAPE AS Routing_Improvement_vs_Ensemble
FROM (SELECT count(*) AS Holdout_Medicines, {WAPES3}, {COUNTS},
  count(*) FILTER (WHERE Routing_Better_Than_Both) AS Routing_Better_Than_Both,
  (SELECT WAPE FROM frozen_m WHERE Model = 'simple_ensemble') AS Ensemble_WAPE FROM frozen_i) AS s""",
      cut="Routing_WAPE Challenger_WAPE Baseline_WAPE Ensemble_WAPE Challenger_Selection_Pct "
          "Baseline_Selection_Pct Routing_Improvement_vs_Baseline Routing_Improvement_vs_Challenger "
          "Routing_Improvement_vs_Ensemble")(lambda s, sf: (
              lambda c: R.frozen_rule_summary(c, R.frozen_rule_holdout(c)))(stored_comparison(s, sf)))

# ================================================================ rule grid
define("demand_cuts", """
SELECT quantile_cont(Total_Demand, 0.25) AS d1, quantile_cont(Total_Demand, 0.5) AS d2,
  quantile_cont(Total_Demand, 0.75) AS d3 FROM cmp
WHERE Split = 'validation' AND Medicine_ID IN (SELECT Medicine_ID FROM cmp WHERE Split = 'holdout')""")


def _grid_sql():
    rules = {"Baseline_only": "false", "Challenger_only": "true",
             "Challenger_Lumpy_Baseline_Intermittent": "v.Regime = 'Lumpy'",
             "Challenger_Intermittent_Baseline_Lumpy": "v.Regime = 'Intermittent'",
             "Validation_Winner": "v.Challenger_AE < v.Baseline_AE"}
    for t in R.ADI_GRID:
        rules[f"Challenger_ADI_ge_{t}"], rules[f"Challenger_ADI_lt_{t}"] = f"v.ADI >= {t}", f"v.ADI < {t}"
    for t in R.CV2_GRID:
        rules[f"Challenger_CV2_ge_{t}"], rules[f"Challenger_CV2_lt_{t}"] = f"v.CV2 >= {t}", f"v.CV2 < {t}"
    for p, d in zip(R.DEMAND_PROBS, ("d1", "d2", "d3")):
        rules[f"Challenger_Demand_ge_q{p}"] = f"v.Total_Demand >= {d}"
        rules[f"Challenger_Demand_lt_q{p}"] = f"v.Total_Demand < {d}"
    for m in R.MARGIN_GRID:
        rules[f"Validation_Challenger_Margin_gt_{m}"] = f"v.Challenger_AE + {m} < v.Baseline_AE"
    for t in R.ADVANTAGE_GRID:
        rules[f"Validation_Advantage_Pct_ge_{t}"] = (
            f"(v.Baseline_AE - v.Challenger_AE) / nullif(v.Baseline_AE, 0) * 100 >= {t}")
    picks = " UNION ALL ".join(
        f"SELECT '{n}' AS Rule, v.Medicine_ID, coalesce({r}, false) AS use FROM cmp v, demand_cuts "
        f"WHERE v.Split = 'validation'" for n, r in rules.items())
    return f"""
SELECT *, Baseline_WAPE - Holdout_WAPE AS Improvement_vs_Baseline FROM (
SELECT Rule, count(*) AS Medicines, count(*) FILTER (WHERE use) AS Challenger_Medicines,
  count(*) FILTER (WHERE NOT use) AS Baseline_Medicines,
  sum(abs(Actual - CASE WHEN use THEN Challenger_Predicted ELSE Baseline_Predicted END))
    / nullif(sum(Actual), 0) * 100 AS Holdout_WAPE,
  sum(Challenger_AE) / nullif(sum(Actual), 0) * 100 AS Challenger_WAPE,
  sum(Baseline_AE) / nullif(sum(Actual), 0) * 100 AS Baseline_WAPE
FROM ({picks}) AS p JOIN cmp h ON p.Medicine_ID = h.Medicine_ID AND h.Split = 'holdout'
GROUP BY Rule) AS g"""


define("grid", _grid_sql())
GRID_CUT = "Holdout_WAPE Challenger_WAPE Baseline_WAPE Improvement_vs_Baseline"
query("rule_grid", "SELECT * FROM grid", cut=GRID_CUT)(lambda s, sf: R.rule_grid(stored_comparison(s, sf)))
query("best_rule", """
SELECT * FROM grid ORDER BY floor(Holdout_WAPE * 1e9), Rule LIMIT 1""", cut=GRID_CUT)(
    lambda s, sf: R.rule_grid(stored_comparison(s, sf)).orderBy(
        F.floor(F.col("Holdout_WAPE") * 1e9), "Rule").limit(1))

# ================================================================ confidence, rolling, value
define("conf", f"""
SELECT *, abs(Validation_Advantage) AS Validation_Winner_Margin,
  abs(Holdout_Advantage) AS Holdout_Winner_Margin,
  CASE WHEN NOT Winner_Stable THEN 'LOW' WHEN abs(Validation_Advantage) >= 100 THEN 'HIGH'
    ELSE 'MEDIUM' END AS Confidence,
  CASE Regime WHEN 'Intermittent' THEN '{B}' WHEN 'Lumpy' THEN '{C}' ELSE 'fallback' END AS Regime_Model,
  CASE Regime WHEN 'Intermittent' THEN '{B}' WHEN 'Lumpy' THEN '{C}' ELSE 'fallback' END
    = Holdout_Winner AS Regime_Rule_Correct,
  CASE WHEN NOT Winner_Stable THEN 'fallback' ELSE Validation_Winner END AS Production_Recommendation
FROM stab""")
query("confidence", "SELECT * FROM conf",
      cut=STAB_CUT + " Validation_Winner_Margin Holdout_Winner_Margin")(
    lambda s, sf: R.routing_confidence(stability(s, sf)))
query("confidence_by_regime", """
SELECT Regime, count(*) AS Medicines, count(*) FILTER (WHERE Winner_Stable) AS Stable,
  count(*) FILTER (WHERE Regime_Rule_Correct) AS Regime_Rule_Correct,
  count(*) FILTER (WHERE Confidence = 'HIGH') AS HIGH, count(*) FILTER (WHERE Confidence = 'MEDIUM') AS MEDIUM,
  count(*) FILTER (WHERE Confidence = 'LOW') AS LOW,
  count(*) FILTER (WHERE Winner_Stable) * 100.0::DOUBLE / count(*) AS Stability_Percentage,
  count(*) FILTER (WHERE Regime_Rule_Correct) * 100.0::DOUBLE / count(*) AS Regime_Rule_Accuracy
FROM conf WHERE Regime IS NOT NULL GROUP BY 1""", cut="Stability_Percentage Regime_Rule_Accuracy")(
    lambda s, sf: R.confidence_by_regime(R.routing_confidence(stability(s, sf))))
define("roll", f"""
SELECT *, Rolling_AE < Challenger_Holdout_AE AS Rolling_Better_Than_Challenger,
  Rolling_AE < Baseline_Holdout_AE AS Rolling_Better_Than_Baseline,
  Rolling_AE < Ensemble_Holdout_AE AS Rolling_Better_Than_Ensemble,
  Validation_Winner = Holdout_Winner AS Winner_Stable,
  Validation_Winner || ' -> ' || Holdout_Winner AS Winner_Transition
FROM (SELECT v.Medicine_ID, v.Regime, v.Total_Demand, h.Actual,
  h.Challenger_AE AS Challenger_Holdout_AE, h.Baseline_AE AS Baseline_Holdout_AE,
  (h.Challenger_AE + h.Baseline_AE) / 2 AS Ensemble_Holdout_AE,
  CASE WHEN v.Challenger_AE <= v.Baseline_AE THEN '{C}' ELSE '{B}' END AS Validation_Winner,
  CASE WHEN h.Challenger_AE <= h.Baseline_AE THEN '{C}' ELSE '{B}' END AS Holdout_Winner,
  CASE WHEN v.Challenger_AE <= v.Baseline_AE THEN h.Challenger_AE ELSE h.Baseline_AE END AS Rolling_AE
  FROM cmp v JOIN cmp h ON v.Medicine_ID = h.Medicine_ID AND v.Split = 'validation'
    AND h.Split = 'holdout') AS r""")
query("rolling_selection", "SELECT * FROM roll",
      cut="Challenger_Holdout_AE Baseline_Holdout_AE Ensemble_Holdout_AE Rolling_AE")(
    lambda s, sf: R.rolling_selection(comparison(s, sf)))
ROLL = "count(*) AS Medicines, count(*) FILTER (WHERE Winner_Stable) AS Stable, sum(Actual) AS Actual, " + ", ".join(
    f"sum({c}) / nullif(sum(Actual), 0) * 100 AS {n}_WAPE" for n, c in (
        ("Rolling", "Rolling_AE"), ("Challenger", "Challenger_Holdout_AE"),
        ("Baseline", "Baseline_Holdout_AE"), ("Ensemble", "Ensemble_Holdout_AE"))) + (
    ", count(*) FILTER (WHERE Winner_Stable) * 100.0::DOUBLE / count(*) AS Stability_Percentage")
ROLL_CUT = "Rolling_WAPE Challenger_WAPE Baseline_WAPE Ensemble_WAPE Stability_Percentage"
query("rolling_overall", f"SELECT {ROLL}, " + ", ".join(
    f"count(*) FILTER (WHERE Rolling_Better_Than_{x}) AS Rolling_Better_Than_{x}"
    for x in ("Challenger", "Baseline", "Ensemble")) + " FROM roll", cut=ROLL_CUT)(
    lambda s, sf: R.rolling_overall(R.rolling_selection(comparison(s, sf))))
query("rolling_by_regime", f"SELECT Regime, {ROLL} FROM roll WHERE Regime IS NOT NULL GROUP BY 1",
      cut=ROLL_CUT)(lambda s, sf: R.rolling_by_regime(R.rolling_selection(comparison(s, sf))))
define("val", f"""
SELECT * EXCLUDE (e1, e2, e3), CASE WHEN Winner_Stable THEN Holdout_Winner ELSE 'unstable' END AS Stable_Winner,
  CASE WHEN Winner_Stable THEN Holdout_Winner ELSE '{B}' END AS Production_Candidate FROM stab_bucket""")
query("model_value", "SELECT * FROM val", cut=STAB_CUT)(
    lambda s, sf: R.model_value(stored_stability(s, sf)))
query("model_value_summary", " UNION ALL ".join(f"""
SELECT '{a}' AS Analysis, {g} AS "Group", count(*) AS Medicines,
  count(*) FILTER (WHERE Winner_Stable) AS Stable_Medicines, avg(Total_Demand) AS Avg_Demand,
  sum(Total_Demand) AS Total_Demand, avg(Validation_Advantage) AS Mean_Validation_Advantage,
  avg(Holdout_Advantage) AS Mean_Holdout_Advantage,
  count(*) FILTER (WHERE Winner_Stable) * 100.0::DOUBLE / count(*) AS Stability_Percentage
FROM val WHERE {g} IS NOT NULL GROUP BY 2""" for a, g in (
    ("regime", "Regime"), ("demand_volume", "Demand_Bucket"))),
      cut="Avg_Demand Mean_Validation_Advantage Mean_Holdout_Advantage Stability_Percentage")(
    lambda s, sf: R.model_value_summary(R.model_value(stored_stability(s, sf))))
query("high_value_items", "SELECT * FROM val ORDER BY Total_Demand DESC, Medicine_ID LIMIT 20",
      cut=STAB_CUT)(lambda s, sf: R.high_value_items(R.model_value(stored_stability(s, sf))))

# ================================================================ production forecasts
define("service_rows", f"""
SELECT t.MDCODE AS Medicine_ID, CAST(t.cutoff + CAST(h AS INTEGER) AS DATE) AS Forecast_Date,
  coalesce(r.Selected_Model, '{B}') AS Selected_Model, CASE WHEN t.k = 0 THEN 0 ELSE t.p * t.z END AS tsb_point,
  CASE WHEN u.k = 0 THEN 0 ELSE u.p * u.z END AS router_point, t.n, q.*, r.Validation_Advantage_Pct
FROM state_end_sup t JOIN native_q_sup q ON t.MDCODE = q.MDCODE
JOIN state_router_sup u ON t.MDCODE = u.MDCODE CROSS JOIN ahead30
LEFT JOIN routes r ON t.MDCODE = r.Medicine_ID""")
define("route_reason", f"""
SELECT Medicine_ID, 'Validation advantage ' || printf('%.2f', Validation_Advantage_Pct) || '% '
  || CASE WHEN Validation_Advantage_Pct >= 30 THEN '>=' ELSE '<' END || ' 30% threshold' AS reason
FROM routes""")


def routed(spark, sf, form):
    """Routed production forecast from one stored demand table and a stored routing table."""
    d = stored_daily(spark, sf)
    return serving.forecast_batch(d, cut_lineage(routing_table(spark, sf, d)), form)[0]


@query("forecast_service", f"""
SELECT s.Medicine_ID, Forecast_Date, Selected_Model,
  round_even(CASE WHEN Selected_Model = '{C}' THEN P50 ELSE tsb_point END, 2) AS Predicted_Demand,
  CASE WHEN Selected_Model = '{C}' THEN P10 END AS P10, CASE WHEN Selected_Model = '{C}' THEN P50 END AS P50,
  CASE WHEN Selected_Model = '{C}' THEN P90 END AS P90, Validation_Advantage_Pct AS Routing_Advantage_Pct,
  coalesce(reason, 'No valid validation advantage available; using {B} fallback') AS Routing_Reason,
  CAST(least(n, 730) AS INTEGER) AS Context_Length_Used, 30 AS Prediction_Length
FROM service_rows s LEFT JOIN route_reason x ON s.Medicine_ID = x.Medicine_ID""",
       cut="Predicted_Demand P10 P50 P90 Routing_Advantage_Pct")
def forecast_service(spark, sf):
    return routed(spark, sf, "service").drop("Generated_At")


@query("forecast_single", f"""
SELECT s.Medicine_ID, Forecast_Date, Selected_Model,
  round_even(CASE WHEN Selected_Model = '{C}' THEN P50 ELSE tsb_point END, 2) AS Predicted_Demand,
  coalesce(reason, 'No valid validation advantage available; using {B} fallback') AS Routing_Reason,
  CAST(least(n, 730) AS INTEGER) AS Context_Length_Used
FROM service_rows s LEFT JOIN route_reason x ON s.Medicine_ID = x.Medicine_ID WHERE s.Medicine_ID = '7'""")
def forecast_single(spark, sf):
    d = stored_daily(spark, sf)
    rows, _ = serving.forecast_one(d, cut_lineage(routing_table(spark, sf, d)), "7")
    return rows.select("Medicine_ID", "Forecast_Date", "Selected_Model", "Predicted_Demand", "Routing_Reason", "Context_Length_Used")


@query("forecast_router", f"""
SELECT s.Medicine_ID, Forecast_Date, Selected_Model,
  round_even(CASE WHEN Selected_Model = '{C}' THEN P50 ELSE router_point END, 2) AS Predicted_Demand, {", ".join(
    f"CASE WHEN Selected_Model = '{C}' THEN {c} ELSE round_even(router_point, 2) END AS {c}" for c in QCOLS)},
  CASE WHEN Selected_Model = '{C}' THEN 'probabilistic' ELSE 'point' END AS Forecast_Type,
  '{RULE}' AS Routing_Rule, Validation_Advantage_Pct,
  coalesce(reason, 'No valid validation advantage available; using {B} fallback') AS Routing_Reason,
  CAST(least(n, 730) AS INTEGER) AS Context_Length_Used, 30 AS Prediction_Length, Selected_Model AS Model_ID
FROM service_rows s JOIN route_reason x ON s.Medicine_ID = x.Medicine_ID""",
       cut="Validation_Advantage_Pct Predicted_Demand " + " ".join(QCOLS))
def forecast_router(spark, sf):
    return routed(spark, sf, "router").drop("Generated_At")


for _form in ("service", "router"):
    query(f"forecast_contract_{_form}", "SELECT " + ", ".join(
        f"CAST(0 AS BIGINT) AS {c}" for c in (
            "duplicate_date", "wrong_horizon", "date_gap", "not_finite", "negative", "unknown_model",
            "quantile_order", "quantile_presence", "median_off_point"))
          + " FROM (SELECT count(*) AS n FROM service_rows) AS s")(
        lambda s, sf, form=_form: quality.check_forecast(
            routed(s, sf, form).withColumns(
                {} if form == "router" else {
                    c: F.lit(None).cast("double") for c in QCOLS if c not in ("P10", "P50", "P90")}),
            [C, B], [C], form=form))

# ================================================================ serving queries
# Snapshot served below: seasonal-naive points (they vary over the horizon) with quantiles of the
# last 90 days.
define("snap", f"""
SELECT s.MDCODE AS Medicine_ID, CAST(s.cutoff + CAST(h AS INTEGER) AS DATE) AS Forecast_Date,
  CASE WHEN n < 7 THEN y[n] ELSE y[n - 6 + (h - 1) % 7] END AS Predicted_Demand, {", ".join(
    f"list_aggregate(y[greatest(n - 89, 1):], 'quantile_cont', {q}) AS {c}"
    for c, q in zip(QCOLS, S.QUANTILE_LEVELS))}
FROM (SELECT *, len(y) AS n FROM hist_end_sup) AS s, ahead30""")


def snapshot(spark, sf, demand=None):
    d = stored_daily(spark, sf) if demand is None else demand
    points = FC.forecast_daily(d, ["seasonal_naive"]).select(
        "Medicine_ID", "Forecast_Date", F.col("Predicted").alias("Predicted_Demand"))
    q = FC.window_quantiles(FC.history_rows(d), [90]).select(
        F.col("MDCODE").alias("Medicine_ID"), *QCOLS)
    return points.join(q, "Medicine_ID")


SUMMARY_SQL = """
SELECT *, CASE WHEN trend_pct_change > 5 THEN 'increasing' WHEN trend_pct_change < -5 THEN 'decreasing'
  ELSE 'stable' END AS trend FROM (
SELECT *, CASE WHEN first_half_avg > 0 THEN (second_half_avg - first_half_avg) / first_half_avg * 100
  WHEN second_half_avg > 0 THEN 100 ELSE 0 END AS trend_pct_change FROM (
SELECT Medicine_ID, CAST(count(*) AS INTEGER) AS prediction_length, sum(Predicted_Demand) AS total_predicted_demand,
  avg(Predicted_Demand) AS avg_daily_demand, avg(Predicted_Demand) FILTER (WHERE rn <= 15) AS first_half_avg,
  avg(Predicted_Demand) FILTER (WHERE rn > 15) AS second_half_avg
FROM (SELECT *, row_number() OVER (PARTITION BY Medicine_ID ORDER BY Forecast_Date) AS rn FROM {src}) AS r
GROUP BY 1) AS a) AS b"""
define("summ", SUMMARY_SQL.format(src="snap"))
SUM_CUT = "avg_daily_demand first_half_avg second_half_avg trend_pct_change"
query("fc_summary", "SELECT * FROM summ", cut=SUM_CUT)(
    lambda s, sf: serving.forecast_summary(snapshot(s, sf)))
query("list_ids", "SELECT DISTINCT Medicine_ID FROM snap ORDER BY 1")(
    lambda s, sf: serving.list_ids(snapshot(s, sf)))
define("tsb_brand_fc", """
SELECT MDCODE AS Medicine_ID, CAST(cutoff + CAST(h AS INTEGER) AS DATE) AS Forecast_Date,
  CASE WHEN k = 0 THEN 0 ELSE p * z END AS Predicted_Demand FROM state_end_brand, ahead30""")
query("top_demand", """
SELECT Medicine_ID, prediction_length, total_predicted_demand, avg_daily_demand FROM (
""" + SUMMARY_SQL.format(src="tsb_brand_fc") + """) AS t
ORDER BY total_predicted_demand DESC, Medicine_ID LIMIT 10""",
      cut="total_predicted_demand avg_daily_demand")(
    lambda s, sf: serving.top_demand(FC.forecast_tsb(daily(s, sf, "brand"), decimals=None), 10).select(
        "Medicine_ID", "prediction_length", "total_predicted_demand", "avg_daily_demand"))
query("by_trend", """
SELECT * FROM summ WHERE trend = 'increasing' ORDER BY abs(trend_pct_change) DESC, Medicine_ID LIMIT 10""",
      cut=SUM_CUT)(lambda s, sf: serving.by_trend(snapshot(s, sf), "increasing"))
query("by_trend_flat", """
SELECT * FROM summ WHERE trend = 'stable' ORDER BY abs(trend_pct_change) DESC, Medicine_ID LIMIT 10""",
      cut=SUM_CUT)(lambda s, sf: serving.by_trend(snapshot(s, sf), "flat"))
query("most_uncertain", """
SELECT Medicine_ID, avg(P50) AS avg_p50, avg(P90 - P10) AS avg_p10_p90_spread,
  CASE WHEN avg(P50) > 0 THEN avg(P90 - P10) / avg(P50) * 100 ELSE 0 END AS relative_uncertainty_pct
FROM snap GROUP BY 1 ORDER BY relative_uncertainty_pct DESC, Medicine_ID LIMIT 10""",
      cut="avg_p50 avg_p10_p90_spread relative_uncertainty_pct")(
    lambda s, sf: serving.most_uncertain(snapshot(s, sf), rounded=False))
query("compare", """
SELECT s.*, CAST(p AS INTEGER) AS position FROM summ s JOIN (SELECT unnest(['7', '3', 'none', '10']) AS id,
  unnest([0, 1, 2, 3]) AS p) AS w ON s.Medicine_ID = w.id""", cut=SUM_CUT)(
    lambda s, sf: serving.compare(snapshot(s, sf), ["7", "3", "none", "10"]))


@query("forecast_nested", """
SELECT Medicine_ID, CAST(30 AS INTEGER) AS prediction_length, CAST(rn AS INTEGER) AS day_number,
  Forecast_Date, Predicted_Demand, """ + ", ".join(QCOLS) + """
FROM (SELECT *, row_number() OVER (PARTITION BY Medicine_ID ORDER BY Forecast_Date) AS rn FROM snap) AS x""",
       cut=" ".join(QCOLS))
def forecast_nested(spark, sf):
    doc = serving.nested_forecast(snapshot(spark, sf))
    days = doc.select("Medicine_ID", "prediction_length", F.posexplode("days").alias("i", "d"))
    return days.select(
        "Medicine_ID", "prediction_length", (F.col("i") + 1).alias("day_number"),
        F.col("d.forecast_date").alias("Forecast_Date"),
        F.col("d.predicted_demand").alias("Predicted_Demand"),
        *[F.col(f"d.quantiles.{c.lower()}").alias(c) for c in QCOLS])


# ================================================================ evaluation, audit, alerts
define("eval_pairs", """
SELECT f.Medicine_ID, f.Predicted AS Predicted, a.Demand_Qty AS Actual, q.P10, q.P90
FROM (SELECT MDCODE AS Medicine_ID, cutoff, CAST(cutoff + CAST(h AS INTEGER) AS DATE) AS d,
    CASE WHEN k = 0 THEN 0 ELSE p * z END AS Predicted FROM bt_state_brand, ahead30
  WHERE cutoff = DATE '2001-05-31') AS f
JOIN dense_brand a ON a.MDCODE = f.Medicine_ID AND a.INVDT = f.d
JOIN bt_quant_brand q ON q.MDCODE = f.Medicine_ID AND q.cutoff = f.cutoff AND q.ctx = 730""")
_EV = """count(*) AS Sample_Count, sum(Actual) AS Total_Actual, sum(Predicted) AS Total_Predicted,
  sum(abs(Actual - Predicted)) AS Total_Absolute_Error,
  CASE WHEN sum(Actual) > 0 THEN sum(abs(Actual - Predicted)) / sum(Actual) * 100 ELSE 0 END AS WAPE_Pct,
  avg(abs(Actual - Predicted)) AS MAE, avg(CASE WHEN abs(Actual) + abs(Predicted) > 0 THEN
    200 * abs(Actual - Predicted) / (abs(Actual) + abs(Predicted)) ELSE 0 END) AS sMAPE_Pct,
  avg(Predicted - Actual) AS MBE,
  avg(CASE WHEN Actual >= P10 AND Actual <= P90 THEN 100.0::DOUBLE ELSE 0 END) AS P10_P90_Coverage_Pct"""


@query("eval_metrics", f"""
SELECT Medicine_ID, false AS Is_Overall, CAST(1 AS BIGINT) AS Medicines, {_EV} FROM eval_pairs GROUP BY 1
UNION ALL SELECT NULL, true, count(DISTINCT Medicine_ID), {_EV} FROM eval_pairs""",
       cut="Total_Predicted Total_Absolute_Error WAPE_Pct MAE sMAPE_Pct MBE P10_P90_Coverage_Pct")
def eval_metrics(spark, sf):
    """TSB with quantile bounds, forecast from 2001-05-31, against the days that followed."""
    d = stored_daily(spark, sf, "brand")
    cut = ["2001-05-31"]
    state = FC.smoothing_state(FC.history_rows(d, cut)).where(
        (F.col("n") >= 730) & (F.datediff("last", "cutoff") >= 30))
    fc = FC.over_horizon(state, 30).select(
        F.col("MDCODE").alias("Medicine_ID"), "Forecast_Date", FC.tsb().alias("Predicted_Demand"))
    q = FC.window_quantiles(FC.history_rows(d, cut), [730]).select(
        F.col("MDCODE").alias("Medicine_ID"), "P10", "P90")
    dense = series.fill_calendar(d, "MDCODE", "INVDT", "Demand_Qty")
    return BT.evaluate_forecast(dense, fc.join(q, "Medicine_ID"), decimals=None)


define("audit_rows", f"""
SELECT f.Medicine_ID, f.Selected_Model, f.tot AS Forecast_30D_Total, f.mean AS Forecast_Daily_Mean,
  f.lo AS Forecast_Min, f.hi AS Forecast_Max, r.t AS Recent_90D_Total, r.t / 90 AS Recent_90D_Daily_Mean,
  f.mean / nullif(r.t / 90, 0) AS Forecast_to_Recent_Ratio,
  coalesce(f.mean / nullif(r.t / 90, 0) < 0.1, false) AS Near_Zero
FROM (SELECT Medicine_ID, max(sel) AS Selected_Model, sum(v) AS tot, avg(v) AS mean, min(v) AS lo, max(v) AS hi
  FROM (SELECT Medicine_ID, Selected_Model AS sel,
      CASE WHEN Selected_Model = '{C}' THEN P50 ELSE tsb_point END AS v FROM service_rows) AS x
  GROUP BY 1) AS f
JOIN (SELECT d.MDCODE, sum(Demand_Qty) AS t FROM daily_sup d JOIN (
    SELECT MDCODE, max(INVDT) AS hi FROM daily_sup GROUP BY 1) b ON d.MDCODE = b.MDCODE
  WHERE hi - INVDT < 90 GROUP BY 1) AS r ON f.Medicine_ID = r.MDCODE""")


def audit(spark, sf):
    d = stored_daily(spark, sf)
    routes = cut_lineage(routing_table(spark, sf, d))
    routed = R.apply_routing(d.withColumnRenamed("MDCODE", "Medicine_ID"), routes).withColumnRenamed(
        "Medicine_ID", "MDCODE")
    pick = lambda m: routed.where(F.col("Selected_Model") == m).select("MDCODE", "INVDT", "Demand_Qty")
    cols = ["Medicine_ID", "Forecast_Date", "Predicted_Demand"]
    fc = FC.forecast_tsb(pick(B), decimals=None).select(*cols, F.lit(B).alias("Selected_Model")).unionByName(
        FC.native_quantile_forecast(pick(C)).select(*cols, F.lit(C).alias("Selected_Model")))
    return BT.scale_audit(d, fc)


query("scale_audit", "SELECT * FROM audit_rows",
      cut="Forecast_30D_Total Forecast_Daily_Mean Forecast_Min Forecast_Max Recent_90D_Daily_Mean "
          "Forecast_to_Recent_Ratio")(audit)
query("scale_audit_summary", " UNION ALL ".join(f"""
SELECT Selected_Model, '{m}' AS Measure, count({m}) AS "count", avg({m}) AS mean, min({m}) AS "min",
  max({m}) AS "max", quantile_cont({m}, 0.5) AS median FROM audit_rows GROUP BY 1""" for m in (
    "Recent_90D_Daily_Mean", "Forecast_Daily_Mean", "Forecast_to_Recent_Ratio")),
      cut="mean min max median")(lambda s, sf: BT.scale_audit_summary(cut_lineage(audit(s, sf))))

define("stock_sup", """
SELECT CAST(l_suppkey AS VARCHAR) AS id, sum(l_quantity) / 40 AS s FROM lineitem WHERE l_returnflag = 'A'
GROUP BY 1""")
define("alert_base", """
SELECT f.Medicine_ID, f.total, f.daily, f.p10, f.p90, coalesce(h.past, 0) AS past, coalesce(i.s, 0) AS stock
FROM (SELECT Medicine_ID, sum(Predicted_Demand) AS total, avg(Predicted_Demand) AS daily, sum(P10) AS p10,
    sum(P90) AS p90 FROM snap GROUP BY 1) AS f
LEFT JOIN (SELECT MDCODE, avg(Demand_Qty) AS past FROM dense_sup GROUP BY 1) AS h ON f.Medicine_ID = h.MDCODE
LEFT JOIN stock_sup AS i ON f.Medicine_ID = i.id""")
define("alert_rows", """
SELECT Medicine_ID, 1 AS rule, CASE WHEN total - stock > 0.3 * total THEN 'CRITICAL' ELSE 'WARNING' END
  AS severity, 'STOCKOUT_RISK' AS alert_type, total - stock AS metric_value FROM alert_base
WHERE stock > 0 AND stock < total
UNION ALL SELECT Medicine_ID, 2, 'WARNING', 'DEMAND_SPIKE', (daily - past) / past * 100 FROM alert_base
WHERE past > 0 AND daily > 1.5 * past
UNION ALL SELECT Medicine_ID, 3, 'INFO', 'HIGH_UNCERTAINTY', p90 - p10 FROM alert_base
WHERE total > 10 AND p90 - p10 > 2.5 * total""")


def alerts(spark, sf):
    d = stored_daily(spark, sf)
    stock = V.table(spark, sf, "lineitem").where("l_returnflag = 'A'").groupBy(
        F.col("l_suppkey").cast("string").alias("Medicine_ID")).agg(
        (F.sum("l_quantity") / 40).alias("Stock_On_Hand"))
    dense = series.fill_calendar(d, "MDCODE", "INVDT", "Demand_Qty")
    return cut_lineage(serving.scan_alerts(
        snapshot(spark, sf, d), dense, stock, decimals=None, numbered=False))


def numbered_alerts(spark, sf):
    return serving.number_alerts(alerts(spark, sf))


query("alerts", """
SELECT *, 'ALT-' || lpad(CAST(row_number() OVER (ORDER BY Medicine_ID, rule) AS VARCHAR), 4, '0') AS id
FROM alert_rows""", cut="metric_value")(
    lambda s, sf: numbered_alerts(s, sf).drop("title", "description", "recommended_action"))
query("alert_summary", """
SELECT count(*) AS total_alerts, count(*) FILTER (WHERE severity = 'CRITICAL') AS critical_count,
  count(*) FILTER (WHERE severity = 'WARNING') AS warning_count,
  count(*) FILTER (WHERE severity = 'INFO') AS info_count FROM alert_rows""")(
    lambda s, sf: serving.alert_summary(alerts(s, sf)))


# ================================================================ documents of several runs, named tools
def stored_alerts(spark, sf):
    """Alerts in two runs: the second has a field more, and only what is left open."""
    store = DocumentStore(spark, f"{work_folder(spark)}/alerts-{uuid.uuid4().hex}")
    remember(spark, store.root)
    rows = alerts(spark, sf).select("Medicine_ID", "severity", "alert_type", "metric_value")
    store.write(rows, "2001-08")
    store.write(rows.where("severity <> 'INFO'").withColumn("status", F.lit("OPEN")), "2001-09")
    store.write(rows.limit(0), "2001-07")
    return store


ALERT_FIELDS = "Medicine_ID string, severity string, alert_type string, metric_value double, status string"
query("alert_documents", """
SELECT '2001-08' AS run, Medicine_ID, severity, alert_type, metric_value, CAST(NULL AS VARCHAR) AS status FROM alert_rows
UNION ALL SELECT '2001-09', Medicine_ID, severity, alert_type, metric_value, 'OPEN' FROM alert_rows WHERE severity <> 'INFO'""",
      cut="metric_value")(lambda s, sf: stored_alerts(s, sf).load(ALERT_FIELDS))
query("alerts_latest", """
SELECT '2001-09' AS run, Medicine_ID, severity, alert_type, metric_value, 'OPEN' AS status FROM alert_rows
WHERE severity <> 'INFO'""", cut="metric_value")(lambda s, sf: stored_alerts(s, sf).latest(ALERT_FIELDS))


@query("evaluation_documents", f"""
SELECT r.run, Medicine_ID, Is_Overall, Sample_Count, MAE, CASE WHEN r.run = 'r2' THEN MAE > 50 END AS Poor
FROM (SELECT Medicine_ID, false AS Is_Overall, {_EV} FROM eval_pairs GROUP BY 1
  UNION ALL SELECT NULL, true, {_EV} FROM eval_pairs) AS e, (VALUES ('r1'), ('r2')) AS r(run)""", cut="MAE")
def evaluation_documents(spark, sf):
    store = DocumentStore(spark, f"{work_folder(spark)}/evaluations-{uuid.uuid4().hex}")
    remember(spark, store.root)
    found = cut_lineage(eval_metrics(spark, sf))
    store.write(found, "r1")
    store.write(found.withColumn("Poor", F.col("MAE") > 50), "r2")
    return store.load("Medicine_ID string, Is_Overall boolean, Sample_Count bigint, MAE double, Poor boolean")


@query("tool_results", """
SELECT 'trend' AS call, Medicine_ID, trend, CAST(NULL AS VARCHAR) AS error FROM summ WHERE Medicine_ID = '7' UNION ALL
SELECT 'increasing', Medicine_ID, trend, NULL FROM (SELECT * FROM summ WHERE trend = 'increasing'
  ORDER BY abs(trend_pct_change) DESC, Medicine_ID LIMIT 10) AS t UNION ALL
SELECT 'compare', Medicine_ID, trend, NULL FROM summ WHERE Medicine_ID IN ('3', '7') UNION ALL
SELECT 'missing', NULL, NULL, 'No forecast available for medicine_id=none.' UNION ALL
SELECT 'unknown', NULL, NULL, 'Unknown tool: drop_table'""")
def tool_results(spark, sf):
    f = cut_lineage(snapshot(spark, sf))
    calls = {"trend": ("get_trend", {"medicine_id": "7"}), "increasing": ("get_demand_trend_medicines", {}),
             "compare": ("compare_medicines", {"medicine_ids": ["7", "none", "3"]}),
             "missing": ("get_summary", {"medicine_id": "none"}), "unknown": ("drop_table", {})}
    text = lambda df, c: (F.col(c) if c in df.columns else F.lit(None)).cast("string").alias(c)
    found = {n: serving.run_tool(f, tool, **arguments) for n, (tool, arguments) in calls.items()}
    return quality.union_all([df.select(F.lit(n).alias("call"), *[text(df, c) for c in ("Medicine_ID", "trend", "error")])
                              for n, df in found.items()])
