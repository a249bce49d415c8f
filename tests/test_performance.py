from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from loanweave.operators import gold as G
from loanweave.operators import performance as P
from tests.conftest import loan_month


def test_prepaid_loan_has_smm_one(small_panel):
    smm = P.compute_smm(small_panel.withColumn(
        "delinquency_state",
        F.when(F.col("is_voluntary_prepayment"), "CURRENT").otherwise(F.col("delinquency_state"))))
    rows = {(r["loan_id"], r["loan_age"]): r for r in smm.collect()}
    assert rows[("B2", 3)]["smm"] == 1.0 and rows[("B2", 3)]["cpr"] == 100.0
    assert all(0 <= r["smm"] <= 1 for r in rows.values())
    assert ("A1", 1) not in rows  # no month before


def test_scheduled_payment_is_no_prepayment(frame):
    r = 4.0 / 1200
    scheduled = 200_000 * r / ((1 + r) ** 359 - 1)
    rows = [loan_month("L", 1), loan_month("L", 2, current_upb=200_000 - scheduled - 500)]
    smm = P.compute_smm(frame(rows)).first()["smm"]
    assert smm == pytest.approx(500 / 200_000)


def test_smm_requires_columns(small_panel):
    with pytest.raises(ValueError):
        P.compute_smm(small_panel.drop("remaining_term"))


def test_weighting_by_prior_balance_counts_payoffs(small_panel):
    panel = small_panel.withColumn("delinquency_state", F.lit("CURRENT"))
    smm = P.compute_smm(panel)
    now = P.aggregate_cpr(smm).where("reporting_period = '2022-03-01'").first()
    prior = P.aggregate_cpr(smm, weight="prior_upb").where("reporting_period = '2022-03-01'").first()
    assert now["wa_smm"] < 0.01 < prior["wa_smm"]
    prior_history = G.cpr_history(panel, weight="prior").where("loan_age = 3")
    assert prior_history.agg(F.max("wa_smm")).first()[0] == 1.0


def test_transition_rows_sum_to_100(small_panel):
    matrix = P.transition_matrix(small_panel)
    sums = matrix.groupBy("cohort_month", "from_state").agg(F.sum("transition_rate_pct").alias("s"))
    assert all(r["s"] == pytest.approx(100.0) for r in sums.collect())
    feb = matrix.where("cohort_month = '2022-02-01' and to_state = 'TERMINAL'").first()
    assert feb["transition_rate_pct"] == pytest.approx(100 / 3)


def _states(frame, *states, gap=False):
    return frame([
        loan_month("L", m + (3 if gap and m > 1 else 0), delinquency_state=s)
        for m, s in enumerate(states, 1)
    ])


def test_unknown_as_destination_but_not_origin(frame):
    panel = _states(frame, "CURRENT", "UNKNOWN", "DQ30")
    got = {(r["from_state"], r["to_state"]) for r in P.transition_matrix(panel).collect()}
    assert got == {("CURRENT", "UNKNOWN")}
    by_vintage = {(r["from_state"], r["to_state"]) for r in G.roll_rates_by_vintage(panel).collect()}
    assert by_vintage == {("CURRENT", "DQ30")}


def test_adjacent_months_only_when_asked(frame):
    panel = _states(frame, "CURRENT", "DQ30", gap=True)
    assert P.transition_matrix(panel).count() == 1
    assert P.transition_matrix(panel, require_adjacent=True).count() == 0


def test_roll_rates_name_transitions(frame):
    panel = _states(frame, "CURRENT", "DQ30", "DQ60", "DQ90PLUS", "CURRENT")
    rows = P.roll_rates(P.transition_matrix(panel)).orderBy("cohort_month").collect()
    assert rows[0]["new_delinquency_rate"] == 100.0
    assert rows[1]["roll_forward_30_to_60"] == 100.0
    assert rows[2]["roll_forward_60_to_90plus"] == 100.0
    assert rows[3]["cure_rate_90plus"] == 100.0 and rows[3]["cure_rate_30"] is None


def _loss(loan, month, **changes):
    return loan_month(loan, month, current_upb=0.0, is_terminal=True, is_credit_event=True,
                      zero_balance_code="09", zero_balance_removal_upb=100_000.0,
                      delinquency_state="REO", **changes)


def test_severity_keeps_over_recoveries(frame):
    panel = frame([
        _loss("A", 1, actual_loss=40_000.0, mi_recoveries=5_000.0),
        _loss("B", 1, actual_loss=-10_000.0), _loss("C", 1),
        _loss("A", 2, actual_loss=60_000.0),
    ])
    rows = {r["loan_id"]: r for r in P.severity_loans(panel).collect()}
    assert rows["A"]["loss_severity"] == pytest.approx(0.6)  # the latest row of the loan
    assert rows["B"]["over_recovery_flag"] and rows["C"]["loss_severity"] is None
    s = P.severity_summary(P.severity_loans(panel)).first()
    assert (s["count"], s["over_recovery_count"]) == (2, 1)
    assert s["median_severity"] == pytest.approx(0.25)
    assert P.severity_by(P.severity_loans(panel), "occupancy").first()["event_count"] == 2
    assert P.severity_histogram(P.severity_loans(panel)).agg(F.sum("loans")).first()[0] == 2
    with pytest.raises(ValueError):
        P.severity_by(P.severity_loans(panel), "nothing")


def test_cdr_denominators(frame):
    panel = frame([loan_month(x, m) for x in "ABC" for m in (1, 2)] + [_loss("D", 2), loan_month("D", 1)])
    same = P.cdr_monthly(panel).where("reporting_period = '2022-02-01'").first()
    assert (same["active_loans"], same["new_credit_events"]) == (4, 1)
    assert same["cdr"] == pytest.approx((1 - 0.75**12) * 100)
    prior = P.cdr_monthly(panel, denominator="prior").where("reporting_period = '2022-02-01'").first()
    assert prior["monthly_rate"] == 0.25


def test_terminations_and_curve(small_panel, frame):
    assert [r["loan_id"] for r in P.terminations(small_panel).collect()] == ["B2"]
    curve = P.vintage_credit_curve(frame([loan_month("A", 1), _loss("B", 2), _loss("C", 5)]))
    got = [r["cumulative_credit_event_rate"] for r in curve.orderBy("loan_age").collect()]
    assert got == pytest.approx([100 / 3, 200 / 3])


def test_headline(small_panel):
    smm = P.compute_smm(small_panel)
    row = P.headline(
        P.aggregate_cpr(smm), P.cdr_monthly(small_panel), P.delinquency_summary(small_panel),
        P.severity_summary(P.severity_loans(small_panel)),
    ).first()
    assert row["latest_period"] == dt.date(2022, 3, 1) and row["latest_cdr"] == 0.0
    assert row["severity_count"] == 0
