"""Performance queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from loanweave.functions.columns import scheduled_principal
from loanweave.operators import performance as P
from loanweave.operators.features import loan_sample
from loanweave.plans.catalog.base import Catalog, Context

SMM = """
  prior AS (
    SELECT *, lag(current_upb) OVER w AS p, ifnull(lag(current_interest_rate) OVER w, 0) / 1200e0 AS r,
      ifnull(lag(remaining_term) OVER w, 1) AS n
    FROM panel WINDOW w AS (PARTITION BY loan_id ORDER BY reporting_period)
  ),
  smm AS (
    SELECT *, 100 * (1 - pow(1 - smm, 12)) AS cpr FROM (
      SELECT *, if(is_voluntary_prepayment, 1e0, least(1e0, greatest(0e0,
        (p - ifnull(current_upb, 0e0)
         - p * r / if(pow(1 + r, n) - 1 > 0, pow(1 + r, n) - 1, 1e0)) / p))) AS smm
      FROM prior WHERE p > 0
        AND delinquency_state NOT IN ('DQ60', 'DQ90PLUS', 'REO', 'TERMINAL'))
  )
"""
STEPS = """
  stepped AS (
    SELECT reporting_period AS cohort_month, delinquency_state AS from_state, current_upb,
      lead(delinquency_state) OVER (PARTITION BY loan_id ORDER BY reporting_period) AS to_state
    FROM panel
  ),
  pairs AS (
    SELECT cohort_month, from_state, to_state, count(*) AS loan_count, sum(current_upb) AS upb
    FROM stepped WHERE to_state IS NOT NULL AND from_state <> 'UNKNOWN' GROUP BY ALL
  ),
  matrix AS (
    SELECT *, 100e0 * loan_count / sum(loan_count) OVER (PARTITION BY cohort_month, from_state)
      AS transition_rate_pct
    FROM pairs
  )
"""
MONTHS = """
  cdr AS (
    SELECT *, 100 * (1 - pow(1 - monthly_rate, 12)) AS cdr FROM (
      SELECT reporting_period, count(*) FILTER (WHERE delinquency_state <> 'TERMINAL')
          AS active_loans,
        count(*) FILTER (WHERE is_credit_event) AS new_credit_events,
        new_credit_events / active_loans AS monthly_rate
      FROM panel GROUP BY 1) WHERE active_loans > 0
  ),
  dq AS (
    SELECT reporting_period, sum(current_upb) AS total_upb,
      ifnull(sum(current_upb) FILTER (WHERE delinquency_state = 'DQ30'), 0e0) AS dq30_upb,
      ifnull(sum(current_upb) FILTER (WHERE delinquency_state = 'DQ60'), 0e0) AS dq60_upb,
      ifnull(sum(current_upb) FILTER (WHERE delinquency_state IN ('REO', 'DQ90PLUS')), 0e0)
        AS dq90plus_upb,
      count(*) AS loan_count, 100 * dq30_upb / nullif(total_upb, 0) AS dq30_rate,
      100 * dq60_upb / nullif(total_upb, 0) AS dq60_rate,
      100 * dq90plus_upb / nullif(total_upb, 0) AS dq90plus_rate,
      100 * (dq60_upb + dq90plus_upb) / nullif(total_upb, 0) AS serious_dq_rate
    FROM panel WHERE delinquency_state NOT IN ('UNKNOWN', 'TERMINAL') GROUP BY 1
  )
"""
SEVERITY = """
  sev AS (
    SELECT loan_id, zero_balance_date, terminal_event_type, zero_balance_code, origination_year,
      loan_age, fico, original_ltv, original_cltv, dti, property_state, occupancy, loan_purpose,
      original_upb, mortgage_insurance_pct, zero_balance_removal_upb, net_sale_proceeds,
      mi_recoveries, non_mi_recoveries, expenses, delinquent_accrued_interest, actual_loss,
      actual_loss / zero_balance_removal_upb AS loss_severity,
      ifnull(mi_recoveries, 0e0) + ifnull(non_mi_recoveries, 0e0) AS total_recoveries,
      total_recoveries / zero_balance_removal_upb AS recovery_rate,
      loss_severity < 0 AS over_recovery_flag
    FROM panel WHERE is_credit_event AND zero_balance_removal_upb > 0
    QUALIFY row_number() OVER (PARTITION BY loan_id
      ORDER BY reporting_period DESC, zero_balance_code DESC) = 1
  ),
  sev_summary AS (
    SELECT count(*) AS count, avg(loss_severity) AS mean_severity,
      sum(loss_severity * zero_balance_removal_upb) / sum(zero_balance_removal_upb) AS wa_severity,
      avg(recovery_rate) AS mean_recovery_rate,
      count(*) FILTER (WHERE over_recovery_flag) AS over_recovery_count,
      median(loss_severity) AS median_severity
    FROM sev WHERE loss_severity IS NOT NULL
  )
"""
SEVERITY_FLOATS = (
    "original_ltv original_cltv dti original_upb mortgage_insurance_pct "
    "zero_balance_removal_upb net_sale_proceeds mi_recoveries non_mi_recoveries expenses "
    "delinquent_accrued_interest actual_loss loss_severity total_recoveries recovery_rate"
)
CPR_FLOATS = "total_upb avg_smm wa_smm cpr_wa"


def _cpr(key: str) -> str:
    return f"""SELECT {key}, count(*) AS loan_count, sum(current_upb) AS total_upb,
        avg(smm) AS avg_smm, sum(smm * current_upb) / nullif(sum(current_upb), 0) AS wa_smm,
        100 * (1 - pow(1 - wa_smm, 12)) AS cpr_wa FROM smm GROUP BY {key}"""


def severity(c: Context):
    return P.severity_loans(c.panel_of(P.SEVERITY_PANEL).table)


def register(catalog: Catalog) -> None:
    add = catalog.add
    add(
        "scheduled_principal",
        lambda c: c.panel.groupBy("reporting_period").agg(
            F.sum(scheduled_principal("current_upb", "current_interest_rate", "remaining_term"))
            .alias("scheduled_principal"),
            F.max(scheduled_principal("current_upb", "current_interest_rate", "remaining_term"))
            .alias("largest"),
        ),
        """SELECT reporting_period, sum(x) AS scheduled_principal, max(x) AS largest FROM (
             SELECT reporting_period, current_upb * current_interest_rate / 1200
               / (pow(1 + current_interest_rate / 1200, remaining_term) - 1) AS x FROM panel)
           GROUP BY 1""",
        "scheduled_principal largest",
        digits={"scheduled_principal": 2, "largest": 4},
    )
    kept = (
        "loan_id, reporting_period, origination_year, loan_age, current_upb, fico, original_ltv, "
        "loan_purpose, property_state, occupancy, current_interest_rate, is_voluntary_prepayment"
    )
    add("smm", lambda c: P.compute_smm(c.panel, c.history).drop("prior_upb"),
        f"SELECT {kept}, smm, cpr FROM smm",
        "current_upb original_ltv current_interest_rate smm cpr", SMM)
    for name, key in (
        ("cpr_by_period", "reporting_period"),
        ("cpr_by_vintage", "origination_year"),
        ("cpr_by_age", "loan_age"),
    ):
        add(name, lambda c, key=key: P.aggregate_cpr(P.compute_smm(c.panel, c.history), [key]),
            _cpr(key), CPR_FLOATS, SMM)
    add("transition_matrix", lambda c: P.transition_matrix(c.panel, c.history),
        "SELECT * FROM matrix", "upb transition_rate_pct", STEPS)
    rates = [
        ("new_delinquency_rate", "CURRENT", "DQ30"), ("cure_rate_30", "DQ30", "CURRENT"),
        ("roll_forward_30_to_60", "DQ30", "DQ60"), ("cure_rate_60", "DQ60", "DQ30"),
        ("roll_forward_60_to_90plus", "DQ60", "DQ90PLUS"),
        ("cure_rate_90plus", "DQ90PLUS", "CURRENT"),
        ("credit_event_from_90plus", "DQ90PLUS", "TERMINAL"),
    ]
    add(
        "roll_rates",
        lambda c: P.roll_rates(P.transition_matrix(c.panel, c.history)),
        "SELECT cohort_month, "
        + ", ".join(
            f"sum(transition_rate_pct) FILTER (WHERE from_state = '{a}' AND to_state = '{b}') AS {n}"
            for n, a, b in rates
        )
        + " FROM matrix GROUP BY 1",
        " ".join(n for n, _, _ in rates),
        STEPS,
    )
    states = ("CURRENT", "DQ30", "DQ60", "DQ90PLUS", "REO", "TERMINAL", "UNKNOWN")
    add(
        "transition_pivot",
        lambda c: P.transition_pivot(P.transition_matrix(c.panel, c.history)),
        "SELECT from_state, "
        + ", ".join(
            f"round(ifnull(sum(transition_rate_pct) FILTER (WHERE to_state = '{s}'), 0e0), 2) AS {s}"
            for s in states
        )
        + " FROM matrix WHERE cohort_month = (SELECT max(cohort_month) FROM matrix) GROUP BY 1",
        " ".join(states),
        STEPS,
    )
    add("delinquency_summary", lambda c: P.delinquency_summary(c.panel), "SELECT * FROM dq",
        "total_upb dq30_upb dq60_upb dq90plus_upb dq30_rate dq60_rate dq90plus_rate "
        "serious_dq_rate", MONTHS)
    add(
        "terminations",
        lambda c: P.terminations(c.panel),
        """SELECT loan_id, zero_balance_date, terminal_event_type, zero_balance_code,
             origination_year, loan_age, fico, original_ltv, original_cltv, dti, property_state,
             occupancy, loan_purpose, mortgage_insurance_pct, current_upb,
             zero_balance_removal_upb, actual_loss, is_credit_event, is_voluntary_prepayment
           FROM panel WHERE is_terminal
           QUALIFY row_number() OVER (PARTITION BY loan_id
             ORDER BY reporting_period DESC, zero_balance_code DESC) = 1""",
        "original_ltv original_cltv dti mortgage_insurance_pct current_upb "
        "zero_balance_removal_upb actual_loss",
    )
    add("cdr_monthly", lambda c: P.cdr_monthly(c.panel), "SELECT * FROM cdr",
        "monthly_rate cdr", MONTHS)
    add(
        "vintage_ce_curve",
        lambda c: P.vintage_credit_curve(c.panel),
        """SELECT e.*, sum(credit_events) OVER (PARTITION BY origination_year ORDER BY loan_age)::BIGINT
             AS cumulative_events, n AS orig_loan_count,
             100e0 * cumulative_events / n AS cumulative_credit_event_rate
           FROM (SELECT origination_year, loan_age, count(*) AS credit_events FROM panel
                 WHERE is_credit_event GROUP BY ALL) e
           JOIN (SELECT origination_year, count(DISTINCT loan_id) AS n FROM panel GROUP BY 1)
             USING (origination_year)""",
        "cumulative_credit_event_rate",
    )
    add("severity_loans", severity, "SELECT * FROM sev", SEVERITY_FLOATS, SEVERITY)
    add("severity_summary", lambda c: P.severity_summary(severity(c)),
        "SELECT * FROM sev_summary",
        "mean_severity wa_severity mean_recovery_rate median_severity", SEVERITY)
    add(
        "severity_by_vintage",
        lambda c: P.severity_by(severity(c), "origination_year"),
        """SELECT origination_year, count(*) AS event_count, avg(loss_severity) AS mean_severity,
             sum(loss_severity * zero_balance_removal_upb) / sum(zero_balance_removal_upb)
               AS wa_severity,
             median(loss_severity) AS median_severity
           FROM sev WHERE loss_severity IS NOT NULL GROUP BY 1""",
        "mean_severity wa_severity median_severity",
        SEVERITY,
    )
    add(
        "severity_histogram",
        lambda c: P.severity_histogram(severity(c), 40),
        """SELECT CAST(least(39, floor((loss_severity - lo) / (hi - lo) * 40)) AS BIGINT) AS bin,
             count(*) AS loans
           FROM sev, (SELECT min(loss_severity) AS lo, max(loss_severity) AS hi FROM sev)
           WHERE loss_severity IS NOT NULL GROUP BY 1""",
        ctes=SEVERITY,
    )
    add(
        "headline_perf",
        lambda c: P.headline(
            P.aggregate_cpr(P.compute_smm(c.panel, c.history)),
            P.cdr_monthly(c.panel),
            P.delinquency_summary(c.panel),
            P.severity_summary(severity(c)),
        ),
        f"""SELECT (SELECT max(reporting_period) FROM dq) AS latest_period,
              (SELECT arg_max(dq30_rate, reporting_period) FROM dq) AS latest_dq30_rate,
              (SELECT arg_max(dq90plus_rate, reporting_period) FROM dq) AS latest_dq90plus_rate,
              (SELECT avg(cpr_wa) FROM (SELECT cpr_wa FROM ({_cpr('reporting_period')})
                WHERE cpr_wa IS NOT NULL ORDER BY reporting_period DESC LIMIT 3)) AS latest_cpr,
              (SELECT avg(cdr) FROM (SELECT cdr FROM cdr ORDER BY reporting_period DESC LIMIT 3))
                AS latest_cdr,
              (SELECT count FROM sev_summary) AS severity_count,
              (SELECT wa_severity FROM sev_summary) AS wa_severity""",
        "latest_dq30_rate latest_dq90plus_rate latest_cpr latest_cdr wa_severity",
        f"{SMM}, {MONTHS}, {SEVERITY}",
    )
    add(
        "loan_hash_sample",
        lambda c: loan_sample(c.panel, 100).select("loan_id", "reporting_period", "current_upb"),
        """SELECT loan_id, reporting_period, current_upb FROM panel
           WHERE CAST('0x' || substr(md5(loan_id), 1, 8) AS BIGINT) % 100 = 0""",
        "current_upb",
    )
    add(
        "order_hash_sample",
        lambda c: loan_sample(c.table("orders"), 100, "o_orderkey").select(
            "o_orderkey", "o_totalprice"
        ),
        """SELECT o_orderkey, o_totalprice FROM orders
           WHERE CAST('0x' || substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 8) AS BIGINT) % 100 = 0""",
        "o_totalprice",
    )
