"""Newton fits against closed forms, and compiled scores in Spark and DuckDB."""

from __future__ import annotations

import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from loanweave.operators import boosted, linear
from loanweave.operators import models as M

FEATURES = ["fico", "original_ltv"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(11)
    out = []
    for i in range(1500):
        fico, ltv = rng.randrange(600, 800), rng.randrange(50, 100)
        risk = 1 / (1 + math.exp((fico - 660) / 30 - (ltv - 75) / 40))
        time = max(1, round(30 * math.exp((fico - 700) / 200) * rng.expovariate(1)))
        out.append((i, None if i % 17 == 0 else fico, float("nan") if i % 23 == 0 else float(ltv), int(rng.random() < risk),
                    0.01 * (ltv - 50) + rng.gauss(0, 0.05), float(time), int(rng.random() < 0.7)))
    return spark.createDataFrame(
        out, "loan_id long, fico bigint, original_ltv double, event int, loss_severity double, "
        "time_lower double, event_observed int").cache()


def _design(rows, fill=None):
    x = rows.toPandas()[FEATURES].to_numpy(float)
    fills = np.nanmedian(x, 0) if fill is None else fill
    x = np.where(np.isnan(x), fills, x)
    return np.column_stack([np.ones(len(x)), (x - x.mean(0)) / x.std(0)]), rows.toPandas()


def test_logistic_gradient_is_zero(rows):
    v, f = _design(rows)
    model = M.fit_logistic(rows, "event", FEATURES, inverse_penalty=0.5)
    theta = np.array([model.intercept, *model.coefficients])
    y, n = f.event.to_numpy(float), len(f)
    w = np.where(y == 1, n / (2 * y.sum()), n / (2 * (n - y.sum())))
    gradient = v.T @ (w * (1 / (1 + np.exp(-v @ theta)) - y)) + np.array([0, *model.coefficients]) / 0.5
    assert np.abs(gradient).max() / n < 1e-8 and model.gradient < linear.TOLERANCE
    assert model.rows == n and model.passes < 15


def test_full_logistic_fills_with_zero(rows):
    v, f = _design(rows, 0.0)
    model = M.fit_logistic_full(rows, "event", FEATURES)
    theta = np.array([model.intercept, *model.coefficients])
    y = f.event.to_numpy(float)
    w = np.where(y == 1, (1 - y).sum() / y.sum(), 1.0)
    gradient = v.T @ (w * (1 / (1 + np.exp(-v @ theta)) - y)) + 1e-5 * w.sum() * np.array([0, *model.coefficients])
    assert np.abs(gradient).max() / w.sum() < 1e-8


def test_ridge_closed_form(rows):
    v, f = _design(rows)
    y, x = f.loss_severity.to_numpy(), v[:, 1:]
    expected = np.linalg.solve(x.T @ x + 3.0 * np.eye(2), x.T @ (y - y.mean()))
    model = M.fit_severity_ridge(rows, FEATURES, 3.0)
    assert model.coefficients == pytest.approx(expected, rel=1e-9) and model.intercept == pytest.approx(y.mean())


def test_weibull_likelihood_equations(rows):
    v, f = _design(rows)
    model = M.fit_aft(rows, FEATURES, penalty=0.0)
    e = (np.log(f.time_lower.to_numpy()) - v @ np.array([model.intercept, *model.coefficients])) / model.scale
    seen, grown = f.event_observed.to_numpy(float), np.exp(e)
    assert np.abs(v.T @ (seen - grown)).max() / len(f) < 1e-7
    assert abs((seen + seen * e - e * grown).sum()) / len(f) < 1e-7
    assert model.scale == pytest.approx(1.0, abs=0.2) and model.coefficients[0] > 0


def test_constant_and_repeated_features(rows):
    odd = rows.withColumns({"same": F.lit(7.0), "none": F.lit(None).cast("double"), "again": F.col("fico")})
    model = M.fit_logistic(odd, "event", ["fico", "same", "none", "again", "absent"])
    assert [model.coefficients[i] for i in (1, 2, 4)] == [0.0, 0.0, 0.0]
    assert model.coefficients[0] == pytest.approx(model.coefficients[3])


ODD = [(1, 700, 80.0, True), (2, None, float("inf"), None), (3, 650, float("nan"), False), (4, None, None, True)]


def _both(spark, sql):
    frame = spark.createDataFrame(ODD, "i int, fico bigint, original_ltv double, flag boolean")
    in_spark = [r[0] for r in frame.orderBy("i").select(F.expr(sql)).collect()]
    con = duckdb.connect()
    con.execute("CREATE TABLE t (i INT, fico BIGINT, original_ltv DOUBLE, flag BOOLEAN)")
    con.executemany("INSERT INTO t VALUES (?, ?, ?, ?)", ODD)
    return in_spark, [r[0] for r in con.execute(f"SELECT {sql} FROM t ORDER BY i").fetchall()]


def test_scores_as_sql_in_two_engines(spark, rows):
    flagged = rows.withColumn("flag", F.col("loan_id") % 3 == 0)
    for model in (M.fit_logistic(flagged, "event", [*FEATURES, "flag"]), M.fit_severity_ridge(rows, FEATURES),
                  M.fit_aft(rows, FEATURES)):
        a, b = _both(spark, model.sql(["i", "fico", "original_ltv", "flag"]))
        assert a == pytest.approx(b, rel=1e-12) and all(math.isfinite(x) for x in a)
        assert None not in a
    lone = M.fit_logistic(rows, "event", FEATURES)
    assert "original_ltv" not in lone.sql(["fico"])


def test_boosted_trees_as_sql(spark, rows):
    clean = rows.where("not isnan(original_ltv)")
    model = M.fit_gbt(clean, clean, "event", FEATURES, max_iter=12)
    trees = boosted.compiled(spark, model, FEATURES, fill=0.0)
    assert len(trees.trees) == M.tree_count(model)
    scored = trees.score(M.score(model, rows, "p", FEATURES, 0.0), "q")
    assert scored.where("abs(p - q) > 1e-12 or q is null").count() == 0 and scored.columns[-1] == "q"
    a, b = _both(spark, trees.sql(["i", "fico", "original_ltv"]))
    assert a == pytest.approx(b, rel=1e-12)
    severity = M.fit_severity_gbt(clean, clean, FEATURES, max_iter=6)
    values = boosted.compiled(spark, severity, FEATURES)
    both = values.score(M.predict_severity(severity, clean, FEATURES, "p"), "q")
    assert both.where("abs(p - least(greatest(q, 0), 1.5)) > 1e-12 or q is null").count() == 0


def test_old_and_new_models_score_after_an_observation(spark, rows):
    before = M.fit_logistic(rows, "event", FEATURES)
    seen = Observation()
    rows.observe(seen, F.count(F.lit(1)).alias("n")).count()
    assert seen.get["n"] == 1500
    after = M.fit_logistic(rows, "event", FEATURES)
    for model in (before, after):
        assert M.score(model, rows, "p").where("p between 0 and 1").count() == 1500


def test_terms_table(spark, rows):
    table = {r["term"]: r for r in M.fit_aft(rows, FEATURES).table(spark).collect()}
    assert list(table) == ["intercept", *FEATURES, "scale"] and all(r["optimal"] for r in table.values())
    with pytest.raises(ValueError):
        M.fit_aft(rows.where("false"), FEATURES)


def test_large_tables_start_at_the_optimum_of_some_rows(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(6000, 3))
    x[:, 1] = np.round(x[:, 1])
    y = (rng.random(6000) < 1 / (1 + np.exp(2 - 2 * x[:, 0] + x[:, 1]))).astype(int)
    names = ["a", "b", "c"]
    data = [(*(None if i % 13 == j else float(v) for j, v in enumerate(r)), int(y[i])) for i, r in enumerate(x)]
    rows = spark.createDataFrame(data, "a double, b double, c double, y int")

    def fit():
        return linear.fit(rows, names, F.col("y"), linear.LOGISTIC, ridge=1.0)

    whole = fit()
    monkeypatch.setattr(linear, "START_ROWS", 2000)
    begun = fit()
    assert begun.fills == whole.fills and begun.rows == whole.rows == 6000
    assert begun.gradient <= linear.TOLERANCE and begun.passes < whole.passes
    assert np.allclose(begun.coefficients, whole.coefficients, rtol=1e-9, atol=1e-12)


@pytest.mark.parametrize("some", ["a < 0", "a >= -1", "a is null", "false", "true"])
def test_medians_do_not_depend_on_the_rows_that_bracket_them(spark, some):
    data = [(float(i % 101) / 7 - 3, float(i % 3), None, None if i % 2 else float(i)) for i in range(998)]
    rows = spark.createDataFrame(data, "a double, b double, c double, d double")
    found = linear.medians(rows, ["a", "b", "c", "d"], rows.where(some))
    assert found == linear.medians(rows, ["a", "b", "c", "d"])
    assert found[0] == float(np.median([r[0] for r in data])) and found[1:] == [1.0, 0.0, 498.0]
