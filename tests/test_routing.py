import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from demandweave.functions.guards import ContractError, require_no_violations
from demandweave.operators import backtest as BT
from demandweave.operators import forecast as FC
from demandweave.operators import quality as Q
from demandweave.operators import routing as R

C, B = R.CHALLENGER, R.BASELINE
D = dt.date


def results(spark, rows):
    """rows: (split, item, actual, challenger prediction, baseline prediction)"""
    out = []
    for i, (split, item, a, c, b) in enumerate(rows):
        for m, p in ((C, c), (B, b)):
            out.append((split, D(2020, 1 + i % 12, 1), D(2020, 2, 1), item, m, float(a), float(p),
                        abs(float(a) - p)))
    return spark.createDataFrame(out, "Split string, Cutoff_Date date, Forecast_Month date, Medicine_ID string, "
                                      "Model string, Actual double, Predicted double, Absolute_Error double")


def regimes(spark, ids):
    return spark.createDataFrame(
        [(i, ["Lumpy", "Intermittent"][k % 2], 100, 10, 1.0 + k, 0.3 + 0.2 * k, 100.0 * (k + 1))
         for k, i in enumerate(ids)],
        "Medicine_ID string, Regime string, Days int, NonZero_Days bigint, ADI double, CV2 double, "
        "Total_Demand double")


ROWS = [
    ("validation", "a", 100, 90, 50), ("holdout", "a", 100, 95, 60),      # challenger, stable
    ("validation", "b", 100, 40, 80), ("holdout", "b", 100, 90, 70),      # baseline, unstable
    ("validation", "c", 100, 80, 75), ("holdout", "c", 100, 50, 55),      # advantage 20 %
    ("validation", "d", 100, 90, 100), ("holdout", "d", 100, 70, 90),     # baseline exact
    ("validation", "e", 100, 90, 90), ("holdout", "e", 100, 80, 80),      # tie
    ("validation", "f", 100, 90, 10),                                     # no holdout
]


@pytest.fixture(scope="module")
def comparison(spark):
    return R.build_comparison(results(spark, ROWS), regimes(spark, "abcdef")).cache()


@pytest.mark.parametrize("value,expected", [
    ("69.069", C), ("30.0", C), ("29.999", B), ("0", B), ("-20", B), ("NaN", B), (None, B),
    ("Infinity", B), ("-Infinity", B), ("invalid", B)])
def test_policy(spark, value, expected):
    df = spark.createDataFrame([(value,)], "v string").select(R.select_model(F.col("v")).alias("m"))
    assert df.first()[0] == expected


def test_advantage_guards(spark):
    df = spark.createDataFrame([(50.0, 100.0), (-1.0, 100.0), (1.0, 0.0), (None, 1.0), (float("nan"), 1.0)],
                               "c double, b double")
    got = [r[0] for r in df.select(R.validation_advantage(F.col("c"), F.col("b"))).collect()]
    assert got == [50.0, None, None, None, None]


def test_comparison_and_ties(comparison):
    got = {(r["Split"], r["Medicine_ID"]): r["Winner"] for r in comparison.collect()}
    assert got[("validation", "a")] == C and got[("validation", "b")] == B
    assert got[("validation", "e")] == B and len(got) == 11
    assert not comparison.where("Actual_Mismatch").count()


def test_stability(comparison):
    s = R.stability_table(comparison)
    got = {r["Medicine_ID"]: (r["Transition"], r["Winner_Stable"], r["Validation_Advantage"]) for r in s.collect()}
    assert set(got) == set("abcde")
    assert got["a"] == (f"{C} -> {C}", True, 40.0) and got["b"] == (f"{B} -> {C}", False, -40.0)
    conf = {r["Medicine_ID"]: (r["Confidence"], r["Production_Recommendation"])
            for r in R.routing_confidence(s).collect()}
    assert conf["a"] == ("MEDIUM", C) and conf["b"] == ("LOW", "fallback")
    v = {r["Medicine_ID"]: (r["Demand_Bucket"], r["Production_Candidate"]) for r in R.model_value(s).collect()}
    assert [v[i][0] for i in "abcde"] == ["Q1_Low", "Q1_Low", "Q2", "Q3", "Q4_High"] and v["b"][1] == B


def test_routing_table_drops_null_advantage_and_falls_back(spark, comparison):
    table = R.build_routing_table(comparison)
    got = {r["Medicine_ID"]: r["Selected_Model"] for r in table.collect()}
    assert got == {"a": C, "b": B, "c": B, "e": B, "f": C}
    ids = spark.createDataFrame([("a",), ("d",), ("new",)], "Medicine_ID string")
    looked = {r["Medicine_ID"]: r["Selected_Model"] for r in R.apply_routing(ids, table).collect()}
    assert looked == {"a": C, "d": B, "new": B}
    require_no_violations(Q.check_routing(table, [C, B], C))
    with pytest.raises(ContractError):
        require_no_violations(Q.check_routing(table.withColumn("Selected_Model", F.lit(B)), [C, B], C))
    reasons = {r["Medicine_ID"]: r["Reason"] for r in R.routing_decisions(table).collect()}
    assert reasons["a"] == "Validation advantage 80.00% >= 30% threshold"


def test_frozen_rule(comparison):
    h = R.frozen_rule_holdout(comparison)
    m = {r["Model"]: r["Absolute_Error"] for r in R.frozen_rule_models(h).collect()}
    assert m == {C: 5 + 10 + 50 + 30 + 20, B: 40 + 30 + 45 + 10 + 20, "simple_ensemble": 22.5 + 20 + 47.5 + 20 + 20,
                 "frozen_routing": 5 + 30 + 45 + 10 + 20}
    one = R.frozen_rule_summary(comparison, h).first()
    assert (one["Holdout_Medicines"], one["Challenger_Selected"], one["Validation_Medicines"]) == (5, 1, 6)
    assert one["Routing_WAPE"] == pytest.approx(22.0)


def test_rule_grid_has_52_rules(comparison):
    g = {r["Rule"]: r for r in R.rule_grid(comparison).collect()}
    assert len(g) == 52
    assert g["Validation_Advantage_Pct_ge_30"]["Holdout_WAPE"] == pytest.approx(22.0)
    assert g["Baseline_only"]["Holdout_WAPE"] == pytest.approx(29.0)
    assert g["Challenger_only"]["Challenger_Medicines"] == 5
    best = R.best_rule(R.rule_grid(comparison)).first()
    assert best["Holdout_WAPE"] == min(r["Holdout_WAPE"] for r in g.values())


def test_rolling_ties_go_to_challenger(comparison):
    r = {x["Medicine_ID"]: x for x in R.rolling_selection(comparison).collect()}
    assert r["e"]["Validation_Winner"] == C and r["b"]["Rolling_AE"] == 30.0
    assert R.rolling_overall(R.rolling_selection(comparison)).first()["Medicines"] == 5


def test_regime_rules_and_unknown_regime(spark, comparison):
    rules = R.regime_rules(comparison)
    got = {r["Regime"]: r["Selected_Model"] for r in rules.collect()}
    assert got == {"Lumpy": C, "Intermittent": C}
    partial = rules.where("Regime = 'Lumpy'")
    hybrid = R.routed_overall(comparison, partial).where(
        "Split = 'holdout' and Model = 'routed_hybrid'").first()
    assert hybrid["Absolute_Error"] == (5 + 50 + 20) + (30 + 10)


def test_calibration_and_ensemble(spark):
    df = results(spark, ROWS).where(F.col("Model") == C)
    f = {r["Medicine_ID"]: r for r in FC.calibration_factors(df).collect()}
    assert f["b"]["Raw_Factor"] == 1.5 and f["a"]["Raw_Factor"] == pytest.approx(100 / 90)
    study = FC.calibration_study(df)
    assert study.count() == 16
    comparison = R.build_comparison(results(spark, ROWS), regimes(spark, "abcdef"))
    w = FC.ensemble_weights(comparison).where("Selected").first()
    v = [r for r in ROWS if r[0] == "validation"]
    errs = [(sum(abs(a - (k / 10 * c + (1 - k / 10) * b)) for _, _, a, c, b in v), k) for k in range(11)]
    assert w["Challenger_Weight"] == pytest.approx(min(errs)[1] / 10)


def test_monthly_backtest_equals_loop(spark):
    import reference_models as ref
    rng = np.random.default_rng(4)
    rows, data = [], {}
    for item, n in (("a", 30), ("b", 20), ("c", 8)):
        data[item] = [int(v) for v in rng.integers(0, 4, n) * rng.integers(0, 2, n)]
        data[item][0] = data[item][-1] = 3
        rows += [(item, D(2018 + i // 12, 1 + i % 12, 1), float(v)) for i, v in enumerate(data[item])]
    m = spark.createDataFrame(rows, "Medicine_ID string, Month date, Actual double")
    cut = ["2019-03-01", "2019-12-01"]
    got = {(r["Model"], str(r["Cutoff_Date"]), r["Medicine_ID"]): r for r in
           BT.monthly_backtest(m, cut, 12, "both").collect()}
    assert {k[2] for k in got} == {"a", "b"}
    for item, c, i in (("a", cut[0], 14), ("a", cut[1], 23), ("b", cut[0], 14)):
        y = data[item][:i + 1]
        hits = [k for k, v in enumerate(y) if v > 0]
        expected = {"naive": y[-1], "seasonal_naive": y[-12], "tsb": ref.tsb(y, p=0.5),
                    "croston": sum(y) / (hits[-1] + 1), "quantile-P50": float(np.quantile(y[-12:], 0.5))}
        for model, p in expected.items():
            r = got[(model, c, item)]
            assert r["Predicted"] == pytest.approx(p) and r["Actual"] == data[item][i + 1], (model, item)
