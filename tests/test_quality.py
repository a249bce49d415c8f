from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from loanweave.operators import quality as Q

ORIG_DDL = """loan_id string, origination_date date, original_upb double, fico bigint,
    original_ltv double, original_cltv double, dti double, original_interest_rate double,
    original_loan_term bigint"""
PERF_DDL = """loan_id string, reporting_period date, current_upb double, loan_age bigint,
    current_interest_rate double, delinquency_months bigint, actual_loss double"""


def origination(spark, **changes):
    good = {"loan_id": "L", "origination_date": dt.date(2020, 1, 1), "original_upb": 1e5,
            "fico": 700, "original_ltv": 80.0, "original_cltv": 80.0, "dti": 30.0,
            "original_interest_rate": 4.0, "original_loan_term": 360}
    rows = [tuple({**good, "loan_id": f"L{i}"}.values()) for i in range(9)]
    rows.append(tuple({**good, "loan_id": "L9", **changes}.values()))
    return spark.createDataFrame(rows, ORIG_DDL)


def by_rule(results):
    return {r["rule_id"]: r for r in results.collect()}


def test_clean_data_passes(spark):
    rows = by_rule(Q.validate(origination(spark), Q.ORIGINATION_RULES))
    assert len(rows) == 9 and {r["status"] for r in rows.values()} == {"PASS"}
    assert rows["ORIG_001"]["rows_checked"] == 10


@pytest.mark.parametrize(
    "change,rule,status",
    [
        ({"loan_id": None}, "ORIG_001", "FAIL"),
        ({"original_upb": -1.0}, "ORIG_002", "QUARANTINE"),
        ({"fico": 999}, "ORIG_003", "WARN"),
        ({"original_ltv": 0.5}, "ORIG_004", "WARN"),
        ({"original_cltv": 201.0}, "ORIG_005", "WARN"),
        ({"dti": 101.0}, "ORIG_006", "WARN"),
        ({"original_interest_rate": 0.1}, "ORIG_007", "WARN"),
        ({"origination_date": None}, "ORIG_008", "QUARANTINE"),
        ({"original_loan_term": 0}, "ORIG_009", "WARN"),
    ],
)
def test_each_origination_rule(spark, change, rule, status):
    df = origination(spark, **change)
    rows = by_rule(Q.validate(df, Q.ORIGINATION_RULES, "r1"))
    assert (rows[rule]["status"], rows[rule]["rows_failed"]) == (status, 1)
    assert rows[rule]["failure_rate"] == pytest.approx(0.1) and rows[rule]["run_id"] == "r1"
    records = Q.quarantine(df, Q.ORIGINATION_RULES, "r1").collect()
    assert [r["rule_id"] for r in records] == ([rule] if status != "WARN" else [])


def test_nulls_in_optional_columns_pass(spark):
    df = origination(spark, fico=None, dti=None, original_upb=None, original_loan_term=None)
    assert {r["status"] for r in by_rule(Q.validate(df, Q.ORIGINATION_RULES)).values()} == {"PASS"}


def test_performance_rules_and_absent_columns(spark):
    good = ("L", dt.date(2022, 1, 1), 1.0, 1, 4.0, 0, None)
    bad = (None, None, -1.0, -1, 21.0, 100, -5.0)
    df = spark.createDataFrame([good, bad], PERF_DDL)
    rows = by_rule(Q.validate(df, Q.PERFORMANCE_RULES))
    assert {r["rows_failed"] for r in rows.values()} == {1}
    fewer = by_rule(Q.validate(df.select("loan_id"), Q.PERFORMANCE_RULES))
    assert fewer["PERF_003"]["status"] == "PASS" and fewer["PERF_001"]["status"] == "FAIL"


def test_empty_data_passes(spark):
    rows = by_rule(Q.validate(origination(spark).where("false"), Q.ORIGINATION_RULES))
    assert {(r["status"], r["failure_rate"]) for r in rows.values()} == {("PASS", 0.0)}


def test_leakage_rules_fail_on_forbidden_columns(spark):
    clean = origination(spark)
    assert {r["status"] for r in Q.validate(clean, Q.LEAKAGE_RULES).collect()} == {"PASS"}
    rows = by_rule(Q.validate(clean.withColumn("actual_loss", F.lit(1.0)), Q.LEAKAGE_RULES))
    assert rows["LEAK_002"]["status"] == "FAIL" and rows["LEAK_002"]["rows_failed"] == 10
    assert rows["LEAK_001"]["status"] == "PASS"


def test_quarantine_numbers_rows_per_rule(spark):
    rows = [(f"L{i}", dt.date(2022, 1, 1), -1.0, 1, 4.0, 0, None) for i in range(50)]
    records = Q.quarantine(spark.createDataFrame(rows, PERF_DDL), Q.PERFORMANCE_RULES).collect()
    assert sorted(r["row_index"] for r in records) == list(range(50))
    assert {r["row_index"] for r in records if r["loan_id"] == "L0"} == {0}


def test_status_rollup_gate(spark):
    ok = Q.status_rollup(Q.validate(origination(spark, fico=999), Q.ORIGINATION_RULES)).first()
    assert (ok["warn"], ok["pass"], ok["gate_open"]) == (1, 8, True)
    bad = Q.status_rollup(Q.validate(origination(spark, loan_id=None), Q.ORIGINATION_RULES)).first()
    assert not bad["gate_open"]


def test_reconciliation(spark):
    orig = spark.createDataFrame([("A",), ("B",)], "loan_id string")
    perf = spark.createDataFrame([("A", 100.0), ("X", 50.0)], "loan_id string, current_upb double")
    panel = perf.join(orig, "loan_id")
    rows = {r["check_name"]: r for r in Q.reconcile_all(orig, perf, panel).collect()}
    counts = rows["origination_vs_panel_unique_loans"]
    assert (counts["source_count"], counts["target_count"], counts["status"]) == (2, 1, "WARN")
    orphans = rows["performance_orphan_loan_ids"]
    assert (orphans["difference"], orphans["pct_difference"]) == (1, 50.0)
    assert rows["performance_vs_panel_total_upb"]["difference"] == 50
    broken = {r["check_name"]: r for r in Q.reconcile_all(orig, perf.drop("current_upb"), panel).collect()}
    assert broken["performance_vs_panel_total_upb"]["status"] == "FAIL"
    late = perf.withColumn("current_upb", F.raise_error(F.lit("unreadable")).cast("double"))
    failing = {r["check_name"]: r for r in Q.reconcile_all(orig, late, panel).collect()}
    assert failing["performance_vs_panel_total_upb"]["status"] == "FAIL"
    assert failing["performance_orphan_loan_ids"]["status"] != "FAIL" and len(failing) == 3


def test_persist_appends(spark):
    results = Q.validate(origination(spark, loan_id=None), Q.ORIGINATION_RULES, "a")
    records = Q.quarantine(origination(spark, loan_id=None), Q.ORIGINATION_RULES, "a")
    for _ in range(2):
        Q.persist_validation(results, records, "dq_results_t", "quarantine_t")
    assert spark.table("dq_results_t").count() == 18 and spark.table("quarantine_t").count() == 2
    for name in ("dq_results_t", "quarantine_t"):
        spark.sql(f"DROP TABLE {name}")


def test_repeated_run_replaces_its_own_rows_only(spark):
    bad, good = origination(spark, loan_id=None), origination(spark)

    def persist(rows, run):
        results = Q.validate(rows, Q.ORIGINATION_RULES, run)
        Q.persist_validation(
            results, Q.quarantine(rows, Q.ORIGINATION_RULES, run), "dq_results_r", "quarantine_r",
            replace=True,
        )

    def held(table):
        return {r["run_id"]: r["count"] for r in spark.table(table).groupBy("run_id").count().collect()}

    for rows, run in ((bad, "o'a"), (bad, "b"), (bad, "b")):
        persist(rows, run)
    assert held("dq_results_r") == {"o'a": 9, "b": 9}
    assert held("quarantine_r") == {"o'a": 1, "b": 1}
    persist(good, "o'a")
    assert held("dq_results_r") == {"o'a": 9, "b": 9} and held("quarantine_r") == {"b": 1}
    assert spark.table("dq_results_r").where("run_id = 'b' AND status = 'FAIL'").count() == 1
    assert spark.table("dq_results_r").where("run_id <> 'b' AND status = 'FAIL'").count() == 0
    for name in ("dq_results_r", "quarantine_r"):
        spark.sql(f"DROP TABLE {name}")


def test_reconciliation_in_one_merge_equals_the_checks_apart(spark):
    """Orphans, missing loans, repeated and null ids, null balances, one loan with most rows."""
    origination = spark.createDataFrame(
        [("a",), ("b",), ("b",), ("never",), (None,)], "loan_id string")
    months = [("a", 10.5)] * 40 + [("b", None), ("b", 3.25), ("orphan", 7.0), (None, 2.0)]
    performance = spark.createDataFrame(months, "loan_id string, current_upb double")
    panel = performance.where("loan_id in ('a', 'b')").withColumn("extra", F.lit(1))
    for inputs in (
        (origination, performance, panel),
        (origination.limit(0), performance, panel.limit(0)),
        (origination, performance.limit(0), panel.limit(0)),
        (origination.limit(0), performance.limit(0), panel.limit(0)),
    ):
        got = Q.reconcile_all(*inputs)
        apart = Q._one_by_one(*inputs)
        assert got.columns == apart.columns
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, apart.collect()))
    figures = Q.reconciliation_figures(origination, performance, panel).first().asDict()
    assert figures == {
        "filed_loans": 3, "held_loans": 2, "reporting_loans": 3, "orphan_loans": 1,
        "reporting_upb": 432.25, "held_upb": 423.25,
    }
