"""Pool selection against the plain sequential rule, constraints and scenarios."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from loanweave.operators import pool as P
from loanweave.operators import scenarios as S
from loanweave.operators.collateral import portfolio_metrics

DDL = """loan_id string, current_upb double, composite_score double, property_state string,
    fico bigint, original_ltv double, dti double, occupancy string"""


def sequential(rows, low, high, cap):
    """The rule itself, loan by loan."""
    total, held, taken = 0.0, {}, set()
    for loan, upb, _, state, *_ in sorted(rows, key=lambda r: (r[2], r[0])):
        if upb <= 0 or total + upb > high:
            continue
        name = state or "UNKNOWN"
        if cap is not None and held.get(name, 0.0) + upb > cap:
            continue
        taken.add(loan)
        held[name] = held.get(name, 0.0) + upb
        total += upb
        if total >= low:
            break
    return taken


@pytest.mark.parametrize("seed", range(8))
def test_selection_equals_the_sequential_rule(spark, monkeypatch, seed):
    rng = random.Random(seed)
    monkeypatch.setattr(P, "BLOCK_ROWS", rng.choice([7, 16, 1000]))
    n, states = rng.randrange(40, 160), rng.randrange(1, 7)
    rows = [
        (f"L{i:04d}", float(rng.randrange(0, 500)), rng.randrange(20) / 20.0,
         rng.choice(["S%d" % s for s in range(states)] + [None]), 800, 50.0, 10.0, "P")
        for i in range(n)
    ]
    target = sum(r[1] for r in rows) * rng.choice([0.05, 0.3, 0.6, 2.0])
    tolerance, pct = rng.choice([0.1, 0.5, 5.0]), rng.choice([10.0, 30.0, 100.0])
    low, high = target * (1 - tolerance / 100), target * (1 + tolerance / 100)
    got = P.select_pool(spark.createDataFrame(rows, DDL), target, tolerance, max_state_pct=pct)
    assert {r["loan_id"] for r in got.collect()} == sequential(rows, low, high, low * pct / 100)


@pytest.mark.parametrize("seed", range(8, 14))
def test_small_stretches_of_cents(spark, monkeypatch, seed):
    """Many blocks and stretches, balances in cents, few and many states."""
    rng = random.Random(seed)
    monkeypatch.setattr(P, "BLOCK_ROWS", rng.choice([3, 8]))
    monkeypatch.setattr(P, "BLOCKS", rng.choice([2, 5]))
    rows = [
        (f"L{i:04d}", rng.randrange(1, 90_000) / 100, rng.random(), rng.choice("ABC"), 800, 50.0, 10.0, "P")
        for i in range(150)
    ]
    target, pct = sum(r[1] for r in rows) * rng.choice([0.2, 0.7, 1.5]), rng.choice([15.0, 40.0, 100.0])
    low, high = target * 0.99, target * 1.01
    got = P.select_pool(spark.createDataFrame(rows, DDL), target, 1.0, max_state_pct=pct)
    assert {r["loan_id"] for r in got.collect()} == sequential(rows, low, high, low * pct / 100)


def test_only_binding_blocks_are_opened(spark, monkeypatch):
    """Without state limits all blocks but the last needed one are taken by their sums."""
    monkeypatch.setattr(P, "BLOCK_ROWS", 10)
    monkeypatch.setattr(P, "BLOCKS", 4)
    rows = [(f"L{i:04d}", i / 1000.0, "S", 100.0) for i in range(400)]
    loans = spark.createDataFrame(rows, "loan_id string, score double, state string, upb double").coalesce(1)
    walk = P._Walk(P._ordered(loans, "score"), 25_000.0, 25_100.0, None)
    assert {r[0] for r in walk.run().collect()} == {f"L{i:04d}" for i in range(250)}
    assert len(walk.opened) == 1 and sum(map(len, walk.whole.values())) == 1
    capped = P._Walk(P._ordered(loans, "score"), 25_000.0, 25_100.0, 7_050.0)
    assert capped.run().count() == 70 and len(capped.opened) <= 1


def test_state_cap_and_floor(spark):
    rows = [(f"L{i:03d}", 100_000.0, 0.0, f"S{i % 5}", 800, 50.0, 10.0, "P") for i in range(150)]
    pool = P.select_pool(spark.createDataFrame(rows, DDL), 4_000_000, 0.5, max_state_pct=25.0)
    total = pool.agg(F.sum("current_upb")).first()[0]
    assert 3_980_000 <= total <= 4_020_000
    assert pool.groupBy("property_state").agg(F.sum("current_upb").alias("u")).agg(
        F.max("u")).first()[0] <= 0.25 * 3_980_000 + 1e-6


def test_no_score_no_state_no_candidates(spark):
    df = spark.createDataFrame([("B", 10.0), ("A", 10.0)], "loan_id string, current_upb double")
    assert [r[0] for r in P.select_pool(df, 10.0).collect()] == ["A"]
    assert P.select_pool(df.where("false"), 10.0).count() == 0


def test_guardrails_drop_nulls_and_investors(spark):
    rows = [("A", 1.0, 0.0, "S", 745, 72.0, 40.0, "P"), ("B", 1.0, 0.0, "S", None, 72.0, 40.0, "P"),
            ("C", 1.0, 0.0, "S", 800, 50.0, 10.0, "I"), ("D", 1.0, 0.0, "S", 744, 50.0, 10.0, "P")]
    df = spark.createDataFrame(rows, DDL)
    assert [r["loan_id"] for r in P.guardrails(df).collect()] == ["A"]
    assert P.guardrails(df, {}, {}).count() == 4


def test_composite_score(spark):
    df = spark.createDataFrame([(0.0, 0.0, 5.0), (1.0, 0.0, 10.0)], "a double, b double, c double")
    got = [r["composite_score"] for r in P.composite_score(df, "a", "b", "c").collect()]
    assert got == pytest.approx([0.0, 0.5 + 0.3])
    assert P.composite_score(df).first()["composite_score"] == 0.0
    assert P.composite_score(df, "absent").first()["composite_score"] == 0.0


def test_attach_scores_defaults(spark):
    loans = spark.createDataFrame([("A", 100.0), ("B", 100.0)], "loan_id string, current_upb double")
    scores = spark.createDataFrame([("A", 0.1, 0.2)],
                                   "loan_id string, credit_event_score double, prepayment_score double")
    got = {r["loan_id"]: r for r in P.attach_scores(loans, scores).collect()}
    assert got["A"]["expected_loss_usd"] == pytest.approx(100 * 0.1 * 0.35)
    assert (got["B"]["credit_event_score"], got["B"]["expected_loss_usd"]) == (0.0, 0.0)


def test_waterfall_counts_first_failures(small_panel):
    rules = P.Eligibility(vintage_min=2022)
    rows = dict(P.exclusion_waterfall(small_panel, rules).collect())
    assert rows == {"terminated": 1, "vintage_too_old": 8, "_total_excluded": 9, "_candidate_count": 0}
    assert P.eligible(small_panel).count() == 8


def test_constraints_shape_and_zero_limits(small_panel):
    rows = {r["name"]: r for r in P.check_constraints(small_panel).collect()}
    assert len(rows) == 10 and rows["Pool UPB"]["status"] == "FAIL"
    assert rows["Max Low-FICO Share (<660)"]["status"] == "PASS"
    few = P.check_constraints(small_panel, {"min_wa_fico": 0, "concentration": {}}).collect()
    assert [r["name"] for r in few] == ["Max Delinquent Share"]
    summary = P.constraint_summary(P.check_constraints(small_panel)).first()
    assert summary["passed"] + summary["failed"] == 10


def test_build_pool_and_comparison(small_panel):
    candidates, pool = P.build_pool(small_panel.where("reporting_month = 2"), target_upb=200_000,
                                    tolerance_pct=1.0, max_state_pct=100.0)
    assert candidates.count() == 3 and pool.count() <= 1
    rows = {r["metric"]: r for r in P.compare_pools(candidates, candidates).collect()}
    assert len(rows) == 12 and {r["delta"] for r in rows.values()} == {0.0}


def test_scenarios(spark):
    pools = spark.createDataFrame([(100e6, 1000, 0.02, 0.5, 0.18)],
                                  "pool_upb double, loan_count bigint, base_credit_event_rate double,"
                                  "base_severity double, base_prepayment_rate double")
    rows = {r["scenario"]: r for r in S.project(pools, 4.0).collect()}
    base, severe = rows["Base Case"], rows["Severe Stress"]
    assert base["projected_gross_loss_usd"] == pytest.approx(1_000_000)
    assert base["projected_net_loss_usd"] == pytest.approx(1e6 - 2e6 * 0.05)
    assert base["scenario_delta_loss_usd"] == pytest.approx(0.0)
    assert severe["stressed_credit_event_rate"] == pytest.approx(0.04)
    assert severe["stressed_severity"] == pytest.approx(0.65)
    assert severe["stressed_prepayment_rate"] == pytest.approx(0.135)
    assert severe["projected_credit_events"] == 40 and severe["projected_prepayments"] == 135
    assert severe["indicative_loss_cushion"] == pytest.approx(4e6 - severe["projected_gross_loss_usd"])
    assert severe["projected_gross_loss_usd"] >= base["projected_gross_loss_usd"]
    assert S.project(pools).first()["indicative_loss_cushion"] is None
    assert S.scenario_table(S.project(pools, 4.0)).count() == 4


def test_base_rates_from_scores(small_panel):
    plain = S.pool_base_from_scores(small_panel).first()
    assert (plain["base_credit_event_rate"], plain["base_severity"]) == (0.0, 0.35)
    scored = small_panel.withColumn("credit_event_score", F.lit(0.1)).withColumn(
        "loss_severity_score", F.lit(0.0))
    row = S.pool_base_from_scores(scored).first()
    assert row["base_credit_event_rate"] == pytest.approx(0.1) and row["base_severity"] == 0.35


def test_deal_summary(small_panel):
    rows = S.deal_summary(portfolio_metrics(small_panel), P.check_constraints(small_panel),
                          S.project(S.pool_base(small_panel, 0.015, 0.35, 0.18), 4.0))
    sections = dict(rows.groupBy("section").count().collect())
    assert sections == {"collateral": 9, "concentration": 5, "constraint": 20, "scenario": 12}
