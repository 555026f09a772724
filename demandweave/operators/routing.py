"""Model comparison, selection and routing.

The comparison has one row per (split, item). Both models' views come from one conditional
aggregate over the long result table instead of two aggregates and a join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions.metrics import pooled_aggregates, wape
from ..functions.quantiles import quantile_map, quartile_bucket

CHALLENGER = "quantile-P50"
BASELINE = "tsb"
# --- fixed values: study grids and labels ---
QUARTERS = ["Q1_Low", "Q2", "Q3", "Q4_High"]
ADI_GRID = [2, 3, 4, 5, 6, 8, 10, 12, 15]
CV2_GRID = [0.5, 0.7, 0.9, 1.0, 1.2, 1.5, 2.0]
DEMAND_PROBS = [0.25, 0.50, 0.75]
MARGIN_GRID = [50, 100, 200]
ADVANTAGE_GRID = [0, 5, 10, 20, 30, 50]
HIGH_MARGIN = 100
# --- end of fixed values ---
REGIME_COLUMNS = ["Medicine_ID", "Regime", "Days", "NonZero_Days", "ADI", "CV2", "Total_Demand"]


def model_errors(results: DataFrame, model: str, name: str) -> DataFrame:
    """Per (split, item) sums and WAPE of one model."""
    return results.where(
        (F.col("Model") == model) & F.col("Split").isin("validation", "holdout")
    ).groupBy("Split", "Medicine_ID").agg(
        F.sum("Actual").alias("Actual"), F.sum("Predicted").alias(f"{name}_Predicted"),
        F.sum("Absolute_Error").alias(f"{name}_AE"),
        wape(F.sum("Absolute_Error"), F.sum("Actual")).alias(f"{name}_WAPE"))


def _winner(c: Column, b: Column, challenger: str, baseline: str, ties: str = "baseline") -> Column:
    better = c <= b if ties == "challenger" else c < b
    return F.when(better, challenger).otherwise(baseline)


def build_comparison(results: DataFrame, regimes: DataFrame, challenger=CHALLENGER,
                     baseline=BASELINE) -> DataFrame:
    """Both models side by side per (split, item) with winner and regime attributes.

    ``Actual_Mismatch`` is true where the two models were scored on different actuals.
    """
    def of(model, column):
        return F.sum(F.when(F.col("Model") == model, F.col(column)))

    both = results.where(
        F.col("Model").isin(challenger, baseline) & F.col("Split").isin("validation", "holdout")
    ).groupBy("Split", "Medicine_ID").agg(
        of(challenger, "Actual").alias("Actual"), of(baseline, "Actual").alias("__actual_b"),
        of(challenger, "Predicted").alias("Challenger_Predicted"),
        of(challenger, "Absolute_Error").alias("Challenger_AE"),
        of(baseline, "Predicted").alias("Baseline_Predicted"),
        of(baseline, "Absolute_Error").alias("Baseline_AE"),
    ).where(F.col("Challenger_AE").isNotNull() & F.col("Baseline_AE").isNotNull())
    c, b = F.col("Challenger_AE"), F.col("Baseline_AE")
    out = both.withColumns({
        "Challenger_WAPE": wape(c, F.col("Actual")),
        "Baseline_WAPE": wape(b, F.col("Actual")),
        "Actual_Mismatch": F.abs(F.col("Actual") - F.col("__actual_b")) > 1e-9,
        "Challenger_Better": c < b,
        "Error_Difference": b - c,
        "Winner": _winner(c, b, challenger, baseline),
    }).drop("__actual_b")
    return out.join(regimes.select(*REGIME_COLUMNS), "Medicine_ID", "left")


def stability_table(comparison: DataFrame) -> DataFrame:
    """Validation against holdout, one row per item present in both."""
    measures = ["Challenger_WAPE", "Baseline_WAPE", "Challenger_AE", "Baseline_AE", "Winner"]

    def of(split, column):
        return F.max(F.when(F.col("Split") == split, F.col(column)))

    attributes = [c for c in REGIME_COLUMNS if c != "Medicine_ID"]
    wide = comparison.groupBy("Medicine_ID").agg(
        *[F.max(c).alias(c) for c in attributes],
        *[of(s, m).alias(f"{s.capitalize()}_{m}") for s in ("validation", "holdout")
          for m in measures],
    ).where(F.col("Validation_Winner").isNotNull() & F.col("Holdout_Winner").isNotNull())
    v = F.col("Validation_Baseline_AE") - F.col("Validation_Challenger_AE")
    h = F.col("Holdout_Baseline_AE") - F.col("Holdout_Challenger_AE")
    return wide.withColumns({
        "Winner_Stable": F.col("Validation_Winner") == F.col("Holdout_Winner"),
        "Transition": F.concat_ws(" -> ", "Validation_Winner", "Holdout_Winner"),
        "Validation_Advantage": v, "Holdout_Advantage": h,
        "Absolute_Validation_Advantage": F.abs(v),
    })


def _stability(stability: DataFrame, key: Column, name: str, *extra: Column) -> DataFrame:
    return stability.groupBy(key.alias(name)).agg(
        F.count("Medicine_ID").alias("Medicines"),
        F.count_if(F.col("Winner_Stable")).alias("Stable"), *extra,
    ).withColumn("Stability_Percentage", F.col("Stable") * 100.0 / F.col("Medicines"))


def stability_by_regime(stability: DataFrame) -> DataFrame:
    return _stability(stability, F.col("Regime"), "Regime")


def with_demand_bucket(df: DataFrame) -> DataFrame:
    """Demand quartile; edges are exact quantiles, lowest edge included."""
    return quartile_bucket(df, "Total_Demand", QUARTERS, "Demand_Bucket")


def stability_by_volume(stability: DataFrame) -> DataFrame:
    return _stability(with_demand_bucket(stability), F.col("Demand_Bucket"), "Demand_Bucket",
                      F.avg("Total_Demand").alias("Avg_Demand"))


def transition_summary(stability: DataFrame) -> DataFrame:
    return stability.groupBy("Transition").agg(
        F.count("Medicine_ID").alias("Medicines"),
        F.avg("Validation_Advantage").alias("Mean_Validation_Advantage"),
        F.avg("Holdout_Advantage").alias("Mean_Holdout_Advantage"))


# ---------------------------------------------------------------- frozen routing rule

def _finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))


def validation_advantage(challenger_ae: Column, baseline_ae: Column) -> Column:
    """Improvement over the baseline in percent; null where an error is unusable."""
    a, b = challenger_ae.try_cast("double"), baseline_ae.try_cast("double")
    usable = _finite(a) & _finite(b) & (a >= 0) & (b > 0)
    return F.when(usable, (b - a) / b * 100.0)


def select_model(advantage: Column, challenger=CHALLENGER, baseline=BASELINE,
                 threshold: float = S.ROUTING_THRESHOLD) -> Column:
    """Challenger at or above the threshold; anything unusable falls back to the baseline."""
    a = advantage.try_cast("double")
    return F.when(_finite(a) & (a >= threshold), challenger).otherwise(baseline)


def rule_name(challenger=CHALLENGER, baseline=BASELINE, threshold=S.ROUTING_THRESHOLD) -> str:
    return f"Validation_Advantage_Pct >= {threshold:.0f}% -> {challenger}; otherwise -> {baseline}"


def routing_decisions(df: DataFrame, challenger=CHALLENGER, baseline=BASELINE,
                      threshold: float = S.ROUTING_THRESHOLD) -> DataFrame:
    """Auditable decision per row of (Medicine_ID, Validation_Advantage_Pct)."""
    raw = F.col("Validation_Advantage_Pct").try_cast("double")
    adv = F.when(_finite(raw), raw)
    sign = F.when(adv >= threshold, ">=").otherwise("<")
    reason = F.when(adv.isNull(), f"No valid validation advantage available; using {baseline} fallback"
                    ).otherwise(F.concat(F.format_string("Validation advantage %.2f%% ", adv), sign,
                                         F.lit(f" {threshold:.0f}% threshold")))
    return df.select(
        "Medicine_ID", select_model(raw, challenger, baseline, threshold).alias("Selected_Model"),
        F.lit(rule_name(challenger, baseline, threshold)).alias("Routing_Rule"),
        adv.alias("Validation_Advantage_Pct"), reason.alias("Reason"))


def build_routing_table(comparison: DataFrame, challenger=CHALLENGER, baseline=BASELINE,
                        threshold: float = S.ROUTING_THRESHOLD) -> DataFrame:
    """Routing decided on validation alone; items without a usable advantage are left out and so
    fall back to the baseline when looked up."""
    c, b = F.col("Validation_Challenger_AE"), F.col("Validation_Baseline_AE")
    return comparison.where(F.col("Split") == "validation").select(
        "Medicine_ID", F.col("Challenger_AE").alias("Validation_Challenger_AE"),
        F.col("Baseline_AE").alias("Validation_Baseline_AE"),
    ).withColumn("Validation_Advantage_Pct", F.when(b != 0, (b - c) / b * 100.0)).where(
        F.col("Validation_Advantage_Pct").isNotNull()
    ).withColumns({
        "Selected_Model": select_model(F.col("Validation_Advantage_Pct"), challenger, baseline,
                                       threshold),
        "Routing_Rule": F.lit(rule_name(challenger, baseline, threshold)),
        "Threshold": F.lit(float(threshold)),
    })


def apply_routing(df: DataFrame, routing: DataFrame, baseline=BASELINE) -> DataFrame:
    """Left lookup by item with fallback to the baseline."""
    r = routing.select("Medicine_ID", "Selected_Model", "Validation_Advantage_Pct")
    return df.join(r, "Medicine_ID", "left").withColumn(
        "Selected_Model", F.coalesce("Selected_Model", F.lit(baseline)))


# ---------------------------------------------------------------- regime routing

def regime_rules(comparison: DataFrame, challenger=CHALLENGER, baseline=BASELINE) -> DataFrame:
    """Winner per regime on validation."""
    g = comparison.where(F.col("Split") == "validation").groupBy("Regime").agg(
        F.count_distinct("Medicine_ID").alias("Medicines"),
        wape(F.sum("Challenger_AE"), F.sum("Actual")).alias("Challenger_WAPE"),
        wape(F.sum("Baseline_AE"), F.sum("Actual")).alias("Baseline_WAPE"),
    ).where(F.col("Regime").isNotNull())
    return g.withColumns({
        "Selected_Model": _winner(F.col("Challenger_WAPE"), F.col("Baseline_WAPE"), challenger,
                                  baseline),
        "Selection_Basis": F.lit("validation_only")})


def _view(model: str, value: Column) -> Column:
    """One generated (Model, value) row."""
    return F.struct(F.lit(model).alias("Model"), value.alias("value"))


def _pick(c: str, b: str, challenger: str) -> Column:
    return F.when(F.col("Selected_Model") == challenger, F.col(c)).otherwise(F.col(b))


def routed_overall(comparison: DataFrame, rules: DataFrame, challenger=CHALLENGER,
                   baseline=BASELINE) -> DataFrame:
    """WAPE per split of each model and of regime routing; an unknown regime takes the baseline.
    There are at most five regimes, which bounds the broadcast."""
    df = comparison.join(F.broadcast(rules.select("Regime", "Selected_Model")), "Regime", "left")
    views = F.inline(F.array(
        _view(challenger, F.col("Challenger_AE")), _view(baseline, F.col("Baseline_AE")),
        _view("routed_hybrid", _pick("Challenger_AE", "Baseline_AE", challenger))))
    return df.select("Split", "Medicine_ID", "Actual", views).groupBy("Split", "Model").agg(
        F.count_distinct("Medicine_ID").alias("Medicines"), F.sum("Actual").alias("Actual"),
        F.sum("value").alias("Absolute_Error"), wape(F.sum("value"), F.sum("Actual")).alias("WAPE"))


def regime_routing_experiment(results: DataFrame, regimes: DataFrame, challenger=CHALLENGER,
                              baseline=BASELINE) -> DataFrame:
    """Row-level study: regime winners chosen on validation, three views scored per split."""
    def of(model, column):
        return F.max(F.when(F.col("Model") == model, F.col(column)))

    merged = results.where(F.col("Model").isin(challenger, baseline)).groupBy(
        "Split", "Cutoff_Date", "Forecast_Month", "Medicine_ID").agg(
        F.max("Actual").alias("Actual"),
        of(challenger, "Predicted").alias("c"), of(challenger, "Absolute_Error").alias("Challenger_AE"),
        of(baseline, "Predicted").alias("b"), of(baseline, "Absolute_Error").alias("Baseline_AE"),
    ).where(F.col("c").isNotNull() & F.col("b").isNotNull()).join(
        regimes.select("Medicine_ID", "Regime"), "Medicine_ID", "left")
    rules = regime_rules(merged, challenger, baseline)
    df = merged.join(F.broadcast(rules.select("Regime", "Selected_Model")), "Regime", "left")
    views = F.inline(F.array(
        _view(challenger, F.col("c")), _view(baseline, F.col("b")),
        _view("routed_hybrid", _pick("c", "b", challenger))))
    return df.where(F.col("Split").isin("validation", "holdout")).select(
        "Split", "Actual", views).groupBy("Split", "Model").agg(
        *pooled_aggregates("Actual", "value"))


# ---------------------------------------------------------------- frozen-rule backtest

def _decide_and_score(comparison: DataFrame, decision: Column, challenger: str,
                      baseline: str) -> DataFrame:
    """Holdout rows with the model decided from the same item's validation row."""
    decided = comparison.where(F.col("Split") == "validation").select(
        "Medicine_ID", decision.alias("Selected_Model"),
        F.when(F.col("Baseline_AE") != 0, F.col("Error_Difference") / F.col("Baseline_AE") * 100)
        .alias("Validation_Advantage_Pct"))
    df = comparison.where(F.col("Split") == "holdout").join(decided, "Medicine_ID")
    a = F.col("Actual")
    df = df.withColumn("Selected_Predicted",
                       _pick("Challenger_Predicted", "Baseline_Predicted", challenger))
    return df.withColumns({
        "Selected_AE": F.abs(a - F.col("Selected_Predicted")),
        "C_AE": F.abs(a - F.col("Challenger_Predicted")),
        "B_AE": F.abs(a - F.col("Baseline_Predicted")),
    })


def frozen_rule_holdout(comparison: DataFrame, challenger=CHALLENGER, baseline=BASELINE,
                        threshold=S.ROUTING_THRESHOLD) -> DataFrame:
    adv = F.when(F.col("Baseline_AE") != 0, F.col("Error_Difference") / F.col("Baseline_AE") * 100)
    return _decide_and_score(comparison, select_model(adv, challenger, baseline, threshold),
                             challenger, baseline)


def frozen_rule_models(holdout: DataFrame, challenger=CHALLENGER, baseline=BASELINE) -> DataFrame:
    """Challenger, baseline, 50/50 blend and frozen routing on holdout, with WAPE improvements."""
    blend = (F.col("Challenger_Predicted") + F.col("Baseline_Predicted")) / 2
    views = F.inline(F.array(
        _view(challenger, F.col("Challenger_Predicted")), _view(baseline, F.col("Baseline_Predicted")),
        _view("simple_ensemble", blend), _view("frozen_routing", F.col("Selected_Predicted"))))
    err = F.abs(F.col("Actual") - F.col("value"))
    per = holdout.select("Medicine_ID", "Actual", views).groupBy("Model").agg(
        F.count_distinct("Medicine_ID").alias("Medicines"), F.sum("Actual").alias("Actual"),
        F.sum("value").alias("Predicted"), F.sum(err).alias("Absolute_Error"),
        wape(F.sum(err), F.sum("Actual")).alias("WAPE"))
    # four rows from here on, so an unpartitioned window is fine and saves a second pass
    of = lambda m: F.max(F.when(F.col("Model") == m, F.col("WAPE"))).over(W.partitionBy(F.lit(1)))
    return per.withColumns({
        "Improvement_vs_Baseline": of(baseline) - F.col("WAPE"),
        "Improvement_vs_Challenger": of(challenger) - F.col("WAPE"),
        "Improvement_vs_Ensemble": of("simple_ensemble") - F.col("WAPE"),
    })


def frozen_rule_items(holdout: DataFrame) -> DataFrame:
    """Per item: errors of routing and of both models on holdout."""
    df = holdout.groupBy("Medicine_ID").agg(
        *[F.first(c).alias(c) for c in ("Regime", "ADI", "CV2", "Total_Demand",
                                        "Validation_Advantage_Pct", "Selected_Model")],
        F.sum("Actual").alias("Holdout_Actual"), F.sum("C_AE").alias("Challenger_Holdout_AE"),
        F.sum("B_AE").alias("Baseline_Holdout_AE"), F.sum("Selected_AE").alias("Routing_Holdout_AE"))
    r, c, b = (F.col(f"{x}_Holdout_AE") for x in ("Routing", "Challenger", "Baseline"))
    return df.withColumns({
        **{f"{x}_Holdout_WAPE": wape(F.col(f"{x}_Holdout_AE"), F.col("Holdout_Actual"))
           for x in ("Challenger", "Baseline", "Routing")},
        "Routing_Better_Than_Challenger": r < c, "Routing_Better_Than_Baseline": r < b,
        "Routing_Better_Than_Both": (r < c) & (r < b),
    })


def frozen_rule_regimes(items: DataFrame, challenger=CHALLENGER, baseline=BASELINE) -> DataFrame:
    a = F.sum("Holdout_Actual")
    return items.where(F.col("Regime").isNotNull()).groupBy("Regime").agg(
        F.count("*").alias("Medicines"),
        *[wape(F.sum(f"{x}_Holdout_AE"), a).alias(f"{x}_WAPE")
          for x in ("Routing", "Challenger", "Baseline")],
        F.count_if(F.col("Selected_Model") == challenger).alias("Challenger_Selected"),
        F.count_if(F.col("Selected_Model") == baseline).alias("Baseline_Selected"),
        F.count_if(F.col("Routing_Better_Than_Baseline")).alias("Routing_Better_Than_Baseline"),
        F.count_if(F.col("Routing_Better_Than_Challenger")).alias("Routing_Better_Than_Challenger"))


def frozen_rule_summary(comparison: DataFrame, holdout: DataFrame, challenger=CHALLENGER,
                        baseline=BASELINE, threshold=S.ROUTING_THRESHOLD) -> DataFrame:
    """One row."""
    items = frozen_rule_items(holdout)
    a, blend = F.col("Actual"), (F.col("Challenger_Predicted") + F.col("Baseline_Predicted")) / 2
    blend_wape = holdout.agg(wape(F.sum(F.abs(a - blend)), F.sum(a))).scalar()
    seen = comparison.where(F.col("Split") == "validation").agg(
        F.count_distinct("Medicine_ID")).scalar()
    t = F.sum("Holdout_Actual")
    one = items.agg(
        F.count("*").alias("Holdout_Medicines"),
        F.count_if(F.col("Selected_Model") == challenger).alias("Challenger_Selected"),
        F.count_if(F.col("Selected_Model") == baseline).alias("Baseline_Selected"),
        *[wape(F.sum(f"{x}_Holdout_AE"), t).alias(f"{x}_WAPE")
          for x in ("Routing", "Baseline", "Challenger")],
        *[F.count_if(F.col(f"Routing_Better_Than_{x}")).alias(f"Routing_Better_Than_{x}")
          for x in ("Baseline", "Challenger", "Both")])
    return one.withColumns({
        "Backtest_Type": F.lit("Frozen validation-to-holdout"),
        "Advantage_Threshold_Pct": F.lit(float(threshold)),
        "Validation_Medicines": seen, "Ensemble_WAPE": blend_wape,
        "Challenger_Selection_Pct": F.col("Challenger_Selected") * 100.0 / F.col("Holdout_Medicines"),
        "Baseline_Selection_Pct": F.col("Baseline_Selected") * 100.0 / F.col("Holdout_Medicines"),
    }).withColumns({
        f"Routing_Improvement_vs_{x}": F.col(f"{x}_WAPE") - F.col("Routing_WAPE")
        for x in ("Baseline", "Challenger", "Ensemble")})


# ---------------------------------------------------------------- rule grid

def candidate_rules() -> dict[str, Column]:
    """52 rules as boolean columns over a validation row: true picks the challenger. Demand
    thresholds are read from the row's ``cuts`` map."""
    adi, cv2, dem = F.col("ADI"), F.col("CV2"), F.col("Total_Demand")
    c, b = F.col("Challenger_AE"), F.col("Baseline_AE")
    rules = {
        "Baseline_only": F.lit(False), "Challenger_only": F.lit(True),
        "Challenger_Lumpy_Baseline_Intermittent": F.col("Regime") == "Lumpy",
        "Challenger_Intermittent_Baseline_Lumpy": F.col("Regime") == "Intermittent",
    }
    for t in ADI_GRID:
        rules[f"Challenger_ADI_ge_{t}"], rules[f"Challenger_ADI_lt_{t}"] = adi >= t, adi < t
    for t in CV2_GRID:
        rules[f"Challenger_CV2_ge_{t}"], rules[f"Challenger_CV2_lt_{t}"] = cv2 >= t, cv2 < t
    for p in DEMAND_PROBS:
        t = F.element_at("cuts", F.lit(p))
        rules[f"Challenger_Demand_ge_q{p}"], rules[f"Challenger_Demand_lt_q{p}"] = dem >= t, dem < t
    rules["Validation_Winner"] = c < b
    for m in MARGIN_GRID:
        rules[f"Validation_Challenger_Margin_gt_{m}"] = c + m < b
    adv = F.when(b != 0, (b - c) / b * 100)
    for t in ADVANTAGE_GRID:
        rules[f"Validation_Advantage_Pct_ge_{t}"] = adv >= t
    return rules


def rule_grid(comparison: DataFrame, challenger=CHALLENGER) -> DataFrame:
    """Every candidate rule decided on validation and scored on holdout, in one grouping."""
    validation = comparison.where(F.col("Split") == "validation")
    # demand thresholds come from validation items that also appear in holdout
    held = comparison.where(F.col("Split") == "holdout").select("Medicine_ID")
    base = validation.join(held, "Medicine_ID", "left_semi")
    decided = validation.withColumn(
        "cuts", quantile_map(base, "Total_Demand", DEMAND_PROBS)
    ).select("Medicine_ID", F.array(*[
        F.struct(F.lit(n).alias("Rule"), F.coalesce(r, F.lit(False)).alias("use"))
        for n, r in candidate_rules().items()]).alias("rules"))
    df = comparison.where(F.col("Split") == "holdout").join(decided, "Medicine_ID").select(
        "Actual", "Challenger_Predicted", "Baseline_Predicted", "Challenger_AE", "Baseline_AE",
        F.explode("rules").alias("r"))
    a = F.col("Actual")
    picked = F.when(F.col("r.use"), F.col("Challenger_Predicted")).otherwise(F.col("Baseline_Predicted"))
    return df.groupBy("r.Rule").agg(
        F.count("*").alias("Medicines"), F.count_if(F.col("r.use")).alias("Challenger_Medicines"),
        F.count_if(~F.col("r.use")).alias("Baseline_Medicines"),
        wape(F.sum(F.abs(a - picked)), F.sum(a)).alias("Holdout_WAPE"),
        wape(F.sum("Challenger_AE"), F.sum(a)).alias("Challenger_WAPE"),
        wape(F.sum("Baseline_AE"), F.sum(a)).alias("Baseline_WAPE"),
    ).withColumn("Improvement_vs_Baseline", F.col("Baseline_WAPE") - F.col("Holdout_WAPE"))


def best_rule(grid: DataFrame) -> DataFrame:
    return grid.orderBy("Holdout_WAPE", "Rule").limit(1)


# ---------------------------------------------------------------- confidence, rolling, value

def routing_confidence(stability: DataFrame, challenger=CHALLENGER, baseline=BASELINE) -> DataFrame:
    """Confidence in the validation winner and the recommendation that follows."""
    margin = F.abs("Validation_Advantage")
    conf = F.when(~F.col("Winner_Stable"), "LOW").when(margin >= HIGH_MARGIN, "HIGH").otherwise(
        "MEDIUM")
    by_regime = F.when(F.col("Regime") == "Intermittent", baseline).when(
        F.col("Regime") == "Lumpy", challenger).otherwise("fallback")
    return stability.withColumns({
        "Validation_Winner_Margin": margin, "Holdout_Winner_Margin": F.abs("Holdout_Advantage"),
        "Confidence": conf, "Regime_Model": by_regime,
        "Regime_Rule_Correct": by_regime == F.col("Holdout_Winner"),
        "Production_Recommendation": F.when(conf == "LOW", "fallback").otherwise(
            F.col("Validation_Winner")),
    })


def confidence_by_regime(confidence: DataFrame) -> DataFrame:
    g = confidence.where(F.col("Regime").isNotNull()).groupBy("Regime").agg(
        F.count("*").alias("Medicines"), F.count_if("Winner_Stable").alias("Stable"),
        F.count_if("Regime_Rule_Correct").alias("Regime_Rule_Correct"),
        *[F.count_if(F.col("Confidence") == k).alias(k) for k in ("HIGH", "MEDIUM", "LOW")])
    return g.withColumns({
        "Stability_Percentage": F.col("Stable") * 100.0 / F.col("Medicines"),
        "Regime_Rule_Accuracy": F.col("Regime_Rule_Correct") * 100.0 / F.col("Medicines")})


def rolling_selection(comparison: DataFrame, challenger=CHALLENGER, baseline=BASELINE) -> DataFrame:
    """Previous winner used next; a tie goes to the challenger; the blend's error is the mean of
    both errors."""
    def of(split, column):
        return F.max(F.when(F.col("Split") == split, F.col(column)))

    df = comparison.groupBy("Medicine_ID").agg(
        F.max("Regime").alias("Regime"), F.max("Total_Demand").alias("Total_Demand"),
        of("holdout", "Actual").alias("Actual"),
        of("validation", "Challenger_AE").alias("vc"), of("validation", "Baseline_AE").alias("vb"),
        of("holdout", "Challenger_AE").alias("Challenger_Holdout_AE"),
        of("holdout", "Baseline_AE").alias("Baseline_Holdout_AE"),
    ).where(F.col("vc").isNotNull() & F.col("Challenger_Holdout_AE").isNotNull())
    c, b = F.col("Challenger_Holdout_AE"), F.col("Baseline_Holdout_AE")
    df = df.withColumns({
        "Validation_Winner": _winner(F.col("vc"), F.col("vb"), challenger, baseline, "challenger"),
        "Holdout_Winner": _winner(c, b, challenger, baseline, "challenger"),
        "Ensemble_Holdout_AE": (c + b) / 2,
    }).drop("vc", "vb")
    used = F.when(F.col("Validation_Winner") == challenger, c).otherwise(b)
    return df.withColumns({
        "Rolling_AE": used, "Rolling_Better_Than_Challenger": used < c,
        "Rolling_Better_Than_Baseline": used < b,
        "Rolling_Better_Than_Ensemble": used < F.col("Ensemble_Holdout_AE"),
        "Winner_Stable": F.col("Validation_Winner") == F.col("Holdout_Winner"),
        "Winner_Transition": F.concat_ws(" -> ", "Validation_Winner", "Holdout_Winner"),
    })


def _rolling_aggregates() -> list[Column]:
    a = F.sum("Actual")
    return [
        F.count("*").alias("Medicines"), F.count_if("Winner_Stable").alias("Stable"),
        F.sum("Actual").alias("Actual"),
        wape(F.sum("Rolling_AE"), a).alias("Rolling_WAPE"),
        wape(F.sum("Challenger_Holdout_AE"), a).alias("Challenger_WAPE"),
        wape(F.sum("Baseline_Holdout_AE"), a).alias("Baseline_WAPE"),
        wape(F.sum("Ensemble_Holdout_AE"), a).alias("Ensemble_WAPE"),
        (F.count_if("Winner_Stable") * 100.0 / F.count("*")).alias("Stability_Percentage"),
    ]


def rolling_overall(rolling: DataFrame) -> DataFrame:
    return rolling.agg(*_rolling_aggregates(), *[
        F.count_if(f"Rolling_Better_Than_{x}").alias(f"Rolling_Better_Than_{x}")
        for x in ("Challenger", "Baseline", "Ensemble")])


def rolling_by_regime(rolling: DataFrame) -> DataFrame:
    return rolling.where(F.col("Regime").isNotNull()).groupBy("Regime").agg(*_rolling_aggregates())


def model_value(stability: DataFrame, baseline=BASELINE) -> DataFrame:
    """Per comparable item: demand quartile, stable winner and production candidate."""
    stable = F.col("Winner_Stable")
    return with_demand_bucket(stability).withColumns({
        "Stable_Winner": F.when(stable, F.col("Holdout_Winner")).otherwise("unstable"),
        "Production_Candidate": F.when(stable, F.col("Holdout_Winner")).otherwise(baseline),
    })


def model_value_summary(value: DataFrame) -> DataFrame:
    """Regime and volume summaries in one grouping, told apart by ``Analysis``."""
    groups = F.inline(F.array(
        F.struct(F.lit("regime").alias("Analysis"), F.col("Regime").alias("Group")),
        F.struct(F.lit("demand_volume").alias("Analysis"), F.col("Demand_Bucket").alias("Group"))))
    return value.select("*", groups).where(F.col("Group").isNotNull()).groupBy(
        "Analysis", "Group").agg(
        F.count("*").alias("Medicines"), F.count_if("Winner_Stable").alias("Stable_Medicines"),
        F.avg("Total_Demand").alias("Avg_Demand"), F.sum("Total_Demand").alias("Total_Demand"),
        F.avg("Validation_Advantage").alias("Mean_Validation_Advantage"),
        F.avg("Holdout_Advantage").alias("Mean_Holdout_Advantage"),
        (F.count_if("Winner_Stable") * 100.0 / F.count("*")).alias("Stability_Percentage"))


def high_value_items(value: DataFrame, n: int = 20) -> DataFrame:
    return value.orderBy(F.col("Total_Demand").desc(), "Medicine_ID").limit(n)
