"""Gold queries."""

from __future__ import annotations

from loanweave.fixed import GOLD_COUPON, GOLD_FICO, GOLD_LTV
from loanweave.operators import gold as G
from loanweave.plans.catalog.base import Catalog
from loanweave.plans.oracle import regions, steps

SNAPSHOT_FLOATS = (
    "total_current_upb avg_loan_balance wa_coupon wa_fico wa_ltv wa_cltv wa_dti wala warm "
    "purchase_pct refinance_pct owner_occupied_pct investor_pct mi_share_pct current_pct "
    "dq30_pct dq60_pct dq90plus_pct low_fico_pct high_ltv_pct modified_pct"
)


def _share(condition: str) -> str:
    return f"100e0 * sum(if({condition}, current_upb, 0e0)) / nullif(sum(current_upb), 0)"


def _present(value: str) -> str:
    return (
        f"sum({value} * current_upb) "
        f"/ nullif(sum(current_upb) FILTER (WHERE {value} IS NOT NULL), 0)"
    )


def _snapshot(source: str) -> str:
    def over(value: str) -> str:
        return f"sum({value} * current_upb) / nullif(sum(current_upb), 0)"

    return f"""
      SELECT max(reporting_period) AS as_of_date, count(DISTINCT loan_id) AS loan_count,
        sum(current_upb) AS total_current_upb, avg(current_upb) AS avg_loan_balance,
        {over('current_interest_rate')} AS wa_coupon, {_present('fico')} AS wa_fico,
        {_present('original_ltv')} AS wa_ltv, {_present('original_cltv')} AS wa_cltv,
        {_present('dti')} AS wa_dti, {over('loan_age')} AS wala, {over('remaining_term')} AS warm,
        {_share("loan_purpose = 'P'")} AS purchase_pct,
        {_share("loan_purpose IN ('R', 'C')")} AS refinance_pct,
        {_share("occupancy = 'P'")} AS owner_occupied_pct,
        {_share("occupancy = 'I'")} AS investor_pct,
        {_share("mortgage_insurance_pct > 0")} AS mi_share_pct,
        {_share("delinquency_state = 'CURRENT'")} AS current_pct,
        {_share("delinquency_state = 'DQ30'")} AS dq30_pct,
        {_share("delinquency_state = 'DQ60'")} AS dq60_pct,
        {_share("delinquency_state IN ('DQ90PLUS', 'REO')")} AS dq90plus_pct,
        {_share("fico < 660")} AS low_fico_pct, {_share("original_ltv > 80")} AS high_ltv_pct,
        {_share("modification_flag")} AS modified_pct
      FROM {source} WHERE delinquency_state <> 'TERMINAL' AND NOT is_terminal"""


CPR = """
  lagged AS (
    SELECT *, lag(current_upb) OVER w AS p, lag(current_interest_rate) OVER w / 1200e0 AS r,
      lag(remaining_term) OVER w AS n
    FROM panel WHERE NOT is_terminal OR is_voluntary_prepayment
    WINDOW w AS (PARTITION BY loan_id ORDER BY reporting_period)
  ),
  rated AS (
    SELECT *, CASE WHEN is_voluntary_prepayment THEN 1e0 WHEN p > 0 THEN greatest(0e0,
        (p - ifnull(current_upb, 0e0) - if(r > 0 AND n > 0, p * r / (pow(1 + r, n) - 1), 0e0)) / p)
      END AS smm
    FROM lagged
    WHERE p IS NOT NULL AND NOT list_contains(['DQ60', 'DQ90PLUS', 'REO'], delinquency_state)
  ),
  cells AS (
    SELECT reporting_period, origination_year, loan_age, original_ltv, fico, loan_purpose,
      property_state, occupancy, count(loan_id) AS loan_count, sum(current_upb) AS total_upb,
      avg(smm) AS avg_smm, sum(smm * current_upb) / nullif(sum(current_upb), 0) AS wa_smm
    FROM rated WHERE smm IS NOT NULL GROUP BY ALL
  )
"""
ROLL = """
  known AS (
    SELECT reporting_period AS cohort_month, origination_year, delinquency_state AS from_state,
      lead(delinquency_state) OVER (PARTITION BY loan_id ORDER BY reporting_period) AS to_state,
      current_upb
    FROM panel WHERE delinquency_state <> 'UNKNOWN'
  ),
  pairs AS (
    SELECT cohort_month, origination_year, from_state, to_state, count(*) AS loan_count,
      sum(current_upb) AS upb
    FROM known WHERE to_state IS NOT NULL GROUP BY ALL
  ),
  rolls AS (
    SELECT p.*, 100e0 * loan_count / t.n AS transition_rate_pct
    FROM pairs p JOIN (
      SELECT cohort_month, origination_year, from_state, sum(loan_count) AS n FROM pairs GROUP BY ALL
    ) t USING (cohort_month, origination_year, from_state)
  )
"""


def register(catalog: Catalog) -> None:
    add = catalog.add
    add("portfolio_snapshot_all", lambda c: G.portfolio_snapshot(c.panel), _snapshot("panel"),
        SNAPSHOT_FLOATS)
    add("portfolio_snapshot_asof", lambda c: G.portfolio_snapshot(c.latest), _snapshot("latest"),
        SNAPSHOT_FLOATS)
    add(
        "cpr_history",
        lambda c: G.cpr_history(c.panel, c.history),
        """SELECT reporting_period, origination_year, loan_age, loan_count, total_upb, avg_smm,
             wa_smm, if(wa_smm BETWEEN 0 AND 1, 100 * (1 - pow(1 - wa_smm, 12)), NULL) AS cpr_wa,
             if(avg_smm BETWEEN 0 AND 1, 100 * (1 - pow(1 - avg_smm, 12)), NULL) AS cpr_simple
           FROM cells""",
        "total_upb avg_smm wa_smm cpr_wa cpr_simple",
        CPR,
    )
    add("roll_rates_by_vintage", lambda c: G.roll_rates_by_vintage(c.panel, c.history),
        "SELECT * FROM rolls", "upb transition_rate_pct", ROLL)
    add(
        "transition_latest",
        lambda c: G.transition_latest(G.roll_rates_by_vintage(c.panel, c.history)),
        "SELECT * FROM rolls WHERE cohort_month = (SELECT max(cohort_month) FROM rolls)",
        "upb transition_rate_pct",
        ROLL,
    )
    add(
        "loss_severity",
        lambda c: G.loss_severity(c.panel),
        """SELECT loan_id, zero_balance_date, terminal_event_type, origination_year, fico,
             original_ltv, original_cltv, dti, property_state, loan_age, mortgage_insurance_pct,
             occupancy, loan_purpose, zero_balance_removal_upb AS termination_upb,
             net_sale_proceeds, mi_recoveries, non_mi_recoveries, expenses,
             delinquent_accrued_interest, actual_loss,
             if(zero_balance_removal_upb > 0, actual_loss / zero_balance_removal_upb, NULL)
               AS loss_severity,
             ifnull(mi_recoveries, 0e0) + ifnull(non_mi_recoveries, 0e0) AS total_recoveries,
             if(zero_balance_removal_upb > 0, (ifnull(mi_recoveries, 0e0)
               + ifnull(non_mi_recoveries, 0e0)) / zero_balance_removal_upb, NULL) AS recovery_rate
           FROM panel WHERE is_credit_event AND actual_loss IS NOT NULL
             AND zero_balance_removal_upb IS NOT NULL""",
        "original_ltv original_cltv dti mortgage_insurance_pct termination_upb net_sale_proceeds "
        "mi_recoveries non_mi_recoveries expenses delinquent_accrued_interest actual_loss "
        "loss_severity total_recoveries recovery_rate",
    )
    add(
        "replines_sql",
        lambda c: G.replines_table(c.panel_of(G.REPLINE_COLUMNS).table, min_cell_loans=2),
        f"""SELECT {steps('fico', *GOLD_FICO, '<')} AS fico_band,
              {steps('original_ltv', *GOLD_LTV, '<=')} AS ltv_band,
              {steps('original_interest_rate', *GOLD_COUPON, '<')} AS coupon_band,
              origination_year AS vintage, {regions('DC/MD')} AS state_group,
              count(DISTINCT loan_id) AS loan_count, sum(current_upb) AS upb,
              sum(current_interest_rate * current_upb) / nullif(sum(current_upb), 0) AS wac,
              {_present('fico')} AS wa_fico, {_present('original_ltv')} AS wa_ltv,
              {_present('dti')} AS wa_dti,
              sum(loan_age * current_upb) / nullif(sum(current_upb), 0) AS wala,
              sum(current_upb) AS pool_upb_raw,
              {_share('delinquency_months > 0')} AS delinquency_rate_pct
            FROM latest GROUP BY ALL HAVING count(DISTINCT loan_id) >= 2""",
        "upb wac wa_fico wa_ltv wa_dti wala pool_upb_raw delinquency_rate_pct",
    )
