"""Data-quality queries over deliberately damaged Silver tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanweave.operators import quality as Q
from loanweave.plans.catalog.base import Catalog, Context

# Damage, as SQL in terms of k (the loan number); the same text in both engines.
DAMAGE = {
    "origination": {
        "original_upb": "case when k % 997 = 0 then 0e0 - original_upb else original_upb end",
        "fico": "case when k % 501 = 0 then 999 else fico end",
        "origination_date": "case when k % 503 = 0 then null else origination_date end",
        "loan_id": "case when k % 1009 = 0 then null else loan_id end",
    },
    "performance": {
        "current_upb": "case when k % 701 = 0 and loan_age = 3 then 0e0 - 1 else current_upb end",
        "loan_id": "case when k % 1009 = 0 and loan_age = 2 then null else loan_id end",
    },
}


def _damaged(df: DataFrame, kind: str) -> DataFrame:
    numbered = df.withColumn("k", F.substring("loan_id", 2, 9).cast("bigint"))
    return numbered.withColumns({c: F.expr(e) for c, e in DAMAGE[kind].items()}).drop("k")


def _damaged_sql(source: str, kind: str) -> str:
    changes = ", ".join(f"{e} AS {c}" for c, e in DAMAGE[kind].items())
    return (
        f"SELECT * EXCLUDE (k) REPLACE ({changes}) FROM "
        f"(SELECT *, CAST(substr(loan_id, 2) AS BIGINT) AS k FROM {source})"
    )


# rule, severity, failing condition
ORIGINATION = [
    ("ORIG_001", "FAIL", "loan_id IS NULL"),
    ("ORIG_002", "QUARANTINE", "original_upb <= 0"),
    ("ORIG_003", "WARN", "fico NOT BETWEEN 300 AND 850"),
    ("ORIG_004", "WARN", "original_ltv NOT BETWEEN 1 AND 200"),
    ("ORIG_005", "WARN", "original_cltv NOT BETWEEN 1 AND 200"),
    ("ORIG_006", "WARN", "dti NOT BETWEEN 0 AND 100"),
    ("ORIG_007", "WARN", "original_interest_rate NOT BETWEEN 0.5 AND 20"),
    ("ORIG_008", "QUARANTINE", "origination_date IS NULL"),
    ("ORIG_009", "WARN", "original_loan_term <= 0"),
]
PERFORMANCE = [
    ("PERF_001", "FAIL", "loan_id IS NULL"),
    ("PERF_002", "FAIL", "reporting_period IS NULL"),
    ("PERF_003", "QUARANTINE", "current_upb < 0"),
    ("PERF_004", "WARN", "loan_age < 0"),
    ("PERF_005", "WARN", "current_interest_rate NOT BETWEEN 0 AND 20"),
    ("PERF_006", "WARN", "delinquency_months NOT BETWEEN 0 AND 99"),
    ("PERF_007", "WARN", "actual_loss < 0"),
]
LEAKAGE = [(f"LEAK_00{i}", "FAIL", "true") for i in (1, 2, 3)]


def _results(source: str, dataset: str, rules: list) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{dataset}' AS dataset, '{rule}' AS rule_id, '{severity}' AS severity,
              count(*) AS rows_checked, count(*) FILTER (WHERE {bad}) AS rows_failed,
              count(*) FILTER (WHERE {bad}) / count(*) AS failure_rate,
              if(count(*) FILTER (WHERE {bad}) = 0, 'PASS', '{severity}') AS status
            FROM {source}"""
        for rule, severity, bad in rules
    )


def _records(source: str, dataset: str, rules: list, period: str) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{dataset}' AS dataset, '{rule}' AS rule_id,
              row_number() OVER (ORDER BY loan_id NULLS FIRST, {period} NULLS FIRST,
                _source_file) - 1 AS row_index,
              loan_id, {period} AS reporting_period, _source_file AS source_file
            FROM {source} WHERE {bad}"""
        for rule, severity, bad in rules
        if severity != "WARN"
    )


BAD = f"""
  bado AS ({_damaged_sql('so', 'origination')}),
  badp AS ({_damaged_sql('sp', 'performance')}),
  half AS (SELECT * FROM so WHERE CAST(substr(loan_id, 2) AS BIGINT) % 251 <> 0),
  hpanel AS (SELECT p.* FROM panel p JOIN half USING (loan_id)),
  results AS (
    {_results('bado', 'loan_origination', ORIGINATION)} UNION ALL
    {_results('badp', 'loan_performance', PERFORMANCE)}
  )
"""
RESULT = ["dataset", "rule_id", "severity", "rows_checked", "rows_failed", "failure_rate", "status"]


def _recon(name: str, source: str, target: str, diff: str, reduced: str, ok: str, note: str) -> str:
    return f"""SELECT '{name}' AS check_name, a AS source_count, {target} AS target_count,
        CAST({diff} AS BIGINT) AS difference,
        ifnull(100e0 * abs(a - {reduced}) / nullif(a, 0), 0e0) AS pct_difference,
        if({ok}, 'PASS', 'WARN') AS status, '{note}' AS note FROM ({source})"""


RECON = {
    "recon_counts": _recon(
        "origination_vs_panel_unique_loans",
        "SELECT (SELECT count(DISTINCT loan_id) FROM half) AS a, "
        "(SELECT count(DISTINCT loan_id) FROM hpanel) AS b",
        "b", "a - b", "b", "100e0 * abs(a - b) / a < 1",
        "Loans without monthly rows do not reach the panel",
    ),
    "recon_orphans": _recon(
        "performance_orphan_loan_ids",
        "SELECT (SELECT count(DISTINCT loan_id) FROM sp) AS a, (SELECT count(DISTINCT loan_id) "
        "FROM sp WHERE loan_id NOT IN (SELECT loan_id FROM half)) AS b",
        "b", "b", "(a - b)", "b = 0", "Monthly rows whose loan is not on file",
    ),
    "recon_upb": _recon(
        "performance_vs_panel_total_upb",
        "SELECT CAST(trunc(x) AS BIGINT) AS a, CAST(trunc(y) AS BIGINT) AS b, trunc(x - y) AS d "
        "FROM (SELECT (SELECT sum(current_upb) FROM sp) AS x, "
        "(SELECT sum(current_upb) FROM hpanel) AS y)",
        "b", "d", "b", "100e0 * abs(a - b) / a < 0.1",
        "The panel carries the whole balance of the monthly rows",
    ),
}


def _half(c: Context) -> DataFrame:
    """Origination without every 251st loan, whose monthly rows become orphans."""
    return c.origination.where(F.substring("loan_id", 2, 9).cast("bigint") % 251 != 0)


def _half_panel(c: Context) -> DataFrame:
    held = c.panel_of(("loan_id", "current_upb")).table
    return held.join(_half(c).select("loan_id"), "loan_id", "left_semi")


def _validated(c: Context) -> DataFrame:
    origination = Q.validate(_damaged(c.origination, "origination"), Q.ORIGINATION_RULES, "run")
    performance = Q.validate(_damaged(c.performance, "performance"), Q.PERFORMANCE_RULES, "run")
    return origination.unionByName(performance)


def _quarantined(c: Context) -> DataFrame:
    origination = Q.quarantine(_damaged(c.origination, "origination"), Q.ORIGINATION_RULES)
    performance = Q.quarantine(_damaged(c.performance, "performance"), Q.PERFORMANCE_RULES)
    return origination.unionByName(performance).drop("run_id", "reason", "timestamp")


def _audited(c: Context) -> DataFrame:
    """The audit tables after two runs, the second of which was repeated on repaired loans."""
    tables = [f"audit_{uuid.uuid4().hex}" for _ in range(2)]
    damaged = _damaged(c.origination, "origination")
    for run, rows in (("first", damaged), ("second", damaged), ("second", c.origination)):
        Q.persist_validation(
            Q.validate(rows, Q.ORIGINATION_RULES, run), Q.quarantine(rows, Q.ORIGINATION_RULES, run),
            *tables, replace=True,
        )
    results, records = (c.spark.table(t) for t in tables)
    held = records.groupBy("run_id", "rule_id").agg(F.count(F.lit(1)).alias("records"))
    return results.join(held, ["run_id", "rule_id"], "left").select(
        "run_id", "rule_id", "status", "rows_checked", "rows_failed",
        F.coalesce("records", F.lit(0)).alias("records"),
    )


def register(catalog: Catalog) -> None:
    add = catalog.add
    add(
        "dq_origination",
        lambda c: Q.validate(_damaged(c.origination, "origination"), Q.ORIGINATION_RULES).select(
            *RESULT
        ),
        "SELECT * FROM results WHERE dataset = 'loan_origination'",
        "failure_rate",
        BAD,
    )
    add(
        "dq_performance",
        lambda c: Q.validate(_damaged(c.performance, "performance"), Q.PERFORMANCE_RULES).select(
            *RESULT
        ),
        "SELECT * FROM results WHERE dataset = 'loan_performance'",
        "failure_rate",
        BAD,
    )
    add(
        "dq_leakage",
        lambda c: Q.validate(c.panel, Q.LEAKAGE_RULES).select(*RESULT),
        _results("panel", "model_snapshot", LEAKAGE),
        "failure_rate",
    )
    add("dq_results", lambda c: _validated(c).select(*RESULT), "SELECT * FROM results",
        "failure_rate", BAD)
    add(
        "dq_status",
        lambda c: Q.status_rollup(_validated(c)),
        "SELECT count(*) AS total_rules, "
        + ", ".join(
            f"count(*) FILTER (WHERE status = '{s}') AS \"{s.lower()}\""
            for s in ("PASS", "WARN", "FAIL", "QUARANTINE")
        )
        + ", count(*) FILTER (WHERE status = 'FAIL') = 0 AS gate_open FROM results",
        ctes=BAD,
    )
    add(
        "dq_quarantine",
        _quarantined,
        f"""SELECT * REPLACE (CAST(reporting_period AS VARCHAR) AS reporting_period) FROM (
              {_records('bado', 'loan_origination', ORIGINATION, 'CAST(NULL AS DATE)')} UNION ALL
              {_records('badp', 'loan_performance', PERFORMANCE, 'reporting_period')})""",
        ctes=BAD,
    )
    runs = (("first", "bado"), ("second", "so"))
    add(
        "audit_roundtrip",
        _audited,
        " UNION ALL ".join(
            f"""SELECT '{run}' AS run_id, rule_id, status, rows_checked, rows_failed,
              if(severity = 'WARN', 0, rows_failed) AS records
            FROM ({_results(source, 'loan_origination', ORIGINATION)})"""
            for run, source in runs
        ),
        ctes=BAD,
    )
    builds = {
        "recon_counts": lambda c: Q.reconcile_counts(_half(c), _half_panel(c)),
        "recon_orphans": lambda c: Q.reconcile_orphans(c.performance, _half(c)),
        "recon_upb": lambda c: Q.reconcile_upb(c.performance, _half_panel(c)),
    }
    for name, build in builds.items():
        add(name, build, RECON[name], "pct_difference", BAD)
    add(
        "recon_all",
        lambda c: Q.reconcile_all(_half(c), c.performance, _half_panel(c)),
        " UNION ALL ".join(f"({s})" for s in RECON.values()),
        "pct_difference",
        BAD,
    )
