from __future__ import annotations

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loanweave.operators import evaluation as E
from loanweave.operators import models as M
from tests.conftest import loan_month


@pytest.fixture(scope="module")
def scored(spark):
    rng = random.Random(5)
    rows = []
    for i in range(600):
        p = rng.randrange(1, 40) / 40.0  # many ties
        rows.append((f"L{i}", dt.date(2020, 1, 1), int(rng.random() < p * 0.6), p,
                     float(rng.randrange(1, 9)), 2015 + i % 8))
    return spark.createDataFrame(
        rows, "loan_id string, scoring_date date, y int, p double, w double, origination_year bigint"
    )


def test_losses(scored):
    f = scored.toPandas()
    row = E.classification_metrics(scored, "y", "p", "w").first()
    assert row["brier_score"] == pytest.approx(np.average((f.p - f.y) ** 2, weights=f.w))
    ll = -np.average(f.y * np.log(np.clip(f.p, 1e-8, 1 - 1e-8))
                     + (1 - f.y) * np.log(1 - np.clip(f.p, 1e-8, 1 - 1e-8)), weights=f.w)
    assert row["log_loss"] == pytest.approx(ll)


def test_auc_equals_pair_counting(scored):
    f = scored.toPandas()
    pos, neg = f[f.y == 1], f[f.y == 0]
    wins = (pos.p.values[:, None] > neg.p.values) + 0.5 * (pos.p.values[:, None] == neg.p.values)
    pairs = pos.w.values[:, None] * neg.w.values
    row = E.roc_pr_auc(E.score_thresholds(scored, "y", "p", "w")).first()
    assert row["roc_auc"] == pytest.approx((wins * pairs).sum() / pairs.sum())
    ap, tp_before = 0.0, 0.0
    for s in sorted(set(f.p), reverse=True):
        top = f[f.p >= s]
        tp = (top.w * top.y).sum()
        ap += (tp - tp_before) / (f.w * f.y).sum() * tp / top.w.sum()
        tp_before = tp
    assert row["pr_auc"] == pytest.approx(ap)


def test_single_class_has_no_auc(scored):
    row = E.roc_pr_auc(E.score_thresholds(scored.where("y = 0"), "y", "p")).first()
    assert row["roc_auc"] is None and row["pr_auc"] is None


def test_captures_and_calibration(scored):
    f = scored.toPandas()
    cut = np.quantile(f.p, 0.9)
    row = E.top_decile_capture(scored, "y", "p").first()
    assert row["top_decile_capture_rate"] == pytest.approx(f.y[f.p >= cut].sum() / f.y.sum())
    best = f.sort_values(["p", "loan_id"], ascending=[False, True]).head(60)
    got = E.top_rows_capture(scored, "y", "p", ["loan_id"]).first()[0]
    assert got == pytest.approx(best.y.sum() / f.y.sum())
    edges = np.percentile(f.p, np.linspace(0, 100, 11))[1:-1]
    bins = np.searchsorted(edges, f.p)
    for r in E.calibration_curve(scored, "y", "p").collect():
        part = f[bins == r["bin"]]
        assert (len(part), part.p.mean(), part.y.mean()) == pytest.approx(
            (r["observations"], r["mean_predicted"], r["fraction_positive"]))
    points = E.curve_points(E.score_thresholds(scored, "y", "p")).orderBy("threshold").first()
    assert points["recall"] == 1.0 and points["false_positive_rate"] == 1.0


def test_severity_errors(spark):
    df = spark.createDataFrame([(0.5, 0.4, 1.0), (0.2, 0.4, 3.0), (None, 0.1, 9.0)],
                               "a double, b double, w double")
    row = E.severity_errors(df, "a", "b", "w").first()
    assert row["observations"] == 2 and row["mae"] == pytest.approx(0.15)
    assert row["prediction_bias"] == pytest.approx(0.05)
    assert row["rmse"] == pytest.approx(math.sqrt((0.01 + 0.04) / 2))
    assert row["balance_weighted_mae"] == pytest.approx((0.1 + 0.6) / 4)


def test_backtest_ignores_absent_dimensions(scored):
    rows = E.portfolio_backtest(scored, "y", "p", ["origination_year", "nothing"])
    assert rows.count() == 8
    assert E.portfolio_backtest(scored, "y", "p", ["nothing"]).columns[0] == "scoring_date"


# --- fits ----------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(7)
    out = []
    for i in range(2000):
        fico, ltv = rng.randrange(600, 800), rng.randrange(50, 100)
        risk = 1 / (1 + math.exp((fico - 640) / 25))
        loss = max(0.0, min(1.5, 0.01 * (ltv - 50) + rng.gauss(0, 0.02)))
        out.append((f"L{i}", None if i % 25 == 0 else fico, float(ltv), int(rng.random() < risk),
                    loss, 100.0))
    return spark.createDataFrame(
        out, "loan_id string, fico bigint, original_ltv double, event int, loss_severity double, "
        "zero_balance_removal_upb double")


FEATURES = ["fico", "original_ltv"]


def _auc(df):
    return E.roc_pr_auc(E.score_thresholds(df, "event", "s")).first()["roc_auc"]


def test_logistic_models_rank_by_risk(rows):
    model = M.fit_logistic(rows, "event", FEATURES)
    scored = M.score(model, rows, "s", FEATURES)
    assert scored.columns == [*rows.columns, "s"] and _auc(scored) > 0.8
    low, high = scored.where("fico < 640").agg(F.avg("s")).first()[0], scored.where(
        "fico > 760").agg(F.avg("s")).first()[0]
    assert low > high
    without = M.score(model, rows.drop("original_ltv"), "s", FEATURES)
    assert without.where("s is null").count() == 0
    full = M.fit_logistic_full(rows, "event", FEATURES)
    assert _auc(M.score(full, rows, "s", FEATURES, fill=0.0)) > 0.7
    with pytest.raises(ValueError):
        M.fit_logistic(rows.where("event = 0"), "event", FEATURES)


def test_boosted_trees(rows):
    model = M.fit_gbt(rows.where("hash(loan_id) % 2 = 0"), rows.where("hash(loan_id) % 2 != 0"),
                      "event", FEATURES, max_iter=5)
    assert _auc(M.score(model, rows, "s", FEATURES, fill=0.0)) > 0.8
    importance = M.feature_importance(model, "event", FEATURES).collect()
    assert importance[0]["feature"] == "fico"
    assert sum(r["importance"] for r in importance) == pytest.approx(1.0)


def test_ridge_is_the_closed_form(rows):
    """Coefficients on standardised features equal (X'X + alpha I)^-1 X'y."""
    clean = rows.where("fico is not null").limit(400).cache()
    alpha = 50.0
    model = M.fit_severity_ridge(clean, FEATURES, alpha)
    f = clean.toPandas()
    x = f[FEATURES].to_numpy(float)
    x = (x - x.mean(0)) / x.std(0, ddof=1)
    y = f["loss_severity"].to_numpy()
    expected = np.linalg.solve(x.T @ x + alpha * np.eye(2), x.T @ (y - y.mean()))
    assert np.array(model.coefficients) == pytest.approx(expected, rel=2e-2)
    predicted = M.predict_severity(model, rows, FEATURES)
    low, high = predicted.agg(F.min("loss_severity_score"), F.max("loss_severity_score")).first()
    assert 0.0 <= low <= high <= 1.5


def test_severity_trees(rows):
    model = M.fit_severity_gbt(rows.where("hash(loan_id) % 2 = 0"),
                               rows.where("hash(loan_id) % 2 != 0"), FEATURES, max_iter=5)
    row = E.severity_errors(M.predict_severity(model, rows, FEATURES), "loss_severity",
                            "loss_severity_score").first()
    assert row["mae"] < 0.13


def test_boosting_goes_on_while_it_helps(spark):
    """A smooth signal at a small step needs more than 50 trees, and gets them."""
    rows = spark.createDataFrame(
        [(600 + i % 200, 80.0, (i % 200) / 200.0) for i in range(1200)],
        "fico int, original_ltv double, loss_severity double")
    model = M.fit_severity_gbt(rows, rows, FEATURES, max_iter=120)
    assert M.tree_count(model) > 50


def test_boosting_stops_on_noise(spark):
    rng = random.Random(3)
    rows = spark.createDataFrame(
        [(rng.randint(600, 800), rng.uniform(50, 100), int(rng.random() < 0.5)) for _ in range(900)],
        "fico int, original_ltv double, event int")
    half = rows.randomSplit([0.5, 0.5], 1)
    assert M.tree_count(M.fit_gbt(half[0], half[1], "event", FEATURES)) < 40


@pytest.mark.parametrize("kind", ["class", "value"])
def test_late_trees_are_left_out_without_a_refit(spark, tmp_path, monkeypatch, kind):
    """The trees up to the best count are those of one long fit, and score as a fit of that length."""
    rng = random.Random(3)
    rows = spark.createDataFrame(
        [(rng.randint(600, 800), rng.uniform(50, 100), int(rng.random() < 0.5), rng.random(), 1.0) for _ in range(900)],
        "fico int, original_ltv double, event int, loss_severity double, flat double")
    half = [r.cache() for r in rows.randomSplit([0.5, 0.5], 1)]
    features, fits = [*FEATURES, "flat"], []
    booster, fit, column = {
        "class": (M.GBTClassifier, lambda: M.fit_gbt(*half, "event", features, max_iter=40), "probability"),
        "value": (M.GBTRegressor, lambda: M.fit_severity_gbt(*half, features, max_iter=40), "prediction"),
    }[kind]
    plain = booster.fit
    monkeypatch.setattr(booster, "fit", lambda self, df: fits.append((self, df)) or plain(self, df))
    model = fit()
    assert len(fits) == 1 and M.tree_count(model) < 40
    again = plain(fits[0][0].setMaxIter(M.tree_count(model)), fits[0][1])
    model.stages[-1].write().overwrite().save(f"{tmp_path}/m")
    for one in (model.stages[-1], type(again).load(f"{tmp_path}/m")):
        got, expected = (m.transform(fits[0][1]).select(column).collect() for m in (one, again))
        assert got == expected
    importance = {r["feature"]: r["importance"] for r in M.feature_importance(model, "event", features).collect()}
    assert list(map(importance.get, features)) == pytest.approx(again.featureImportances.toArray().tolist())


def test_logistic_penalty_is_of_the_summed_loss(rows):
    """Coefficients on standardised features have a zero gradient of loss plus half the ridge."""
    clean = rows.where("fico is not null").limit(400).cache()
    model = M.fit_logistic(clean, "event", FEATURES, inverse_penalty=0.01)
    f = clean.toPandas()
    x = f[FEATURES].to_numpy(float)
    x = (x - x.mean(0)) / x.std(0, ddof=1)
    y = f["event"].to_numpy(float)
    w = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
    b, a = np.array(model.coefficients), model.intercept
    p = 1 / (1 + np.exp(-(x @ b + a)))
    gradient = x.T @ (w * (p - y)) + b / 0.01
    assert np.abs(gradient).max() < 0.02 * np.abs(b / 0.01).max() and abs((w * (p - y)).sum()) < 0.5


def test_survival(frame):
    rng = random.Random(1)
    rows = []
    for i in range(120):
        risky = i % 2
        end = rng.randrange(2, 6) if risky else rng.randrange(12, 20)
        for m in (1, end):
            gone = m == end and i % 6 != 0
            rows.append(loan_month(f"L{i}", m, fico=620 if risky else 780 + i % 7,
                                   original_ltv=50.0 + i % 30, original_cltv=60.0 + i % 11,
                                   dti=20.0 + i % 13, original_upb=1e5 + 1000 * i,
                                   original_interest_rate=3 + (i % 5) / 4,
                                   mortgage_insurance_pct=float(i % 3),
                                   is_credit_event=gone, is_terminal=gone))
    panel = frame(rows)
    table = M.survival_table(panel, "is_credit_event")
    assert table.count() == 120
    assert table.where("event_observed = 0").select("time_upper").distinct().first()[0] == 1e9
    one = M.survival_rows(panel, "is_credit_event").where("loan_id = 'L0'").first()
    assert one["time_upper"] == -1.0 and not one["event_occurred"]
    model = M.fit_aft(table)
    times = dict(M.predict_survival(model, table).groupBy((F.col("fico") < 700).alias("risky")).agg(
        F.avg("predicted_time")).collect())
    assert times[True] < times[False]
    row = M.aft_metrics(model, table, table, "aft").first()
    assert row["test_events"] == 100 and row["median_predicted_time_event"] > 0


def test_comparison_and_run_record(scored):
    a = M.metric_row(scored, "a", "y", "p", "w")
    both = M.model_comparison(a, a.withColumn("model_name", F.lit("b")).drop("pr_auc"))
    assert [r["pr_auc"] is None for r in both.collect()] == [False, True]
    assert M.run_record(both, "1-2", "3", "4", 22).count() == 2
