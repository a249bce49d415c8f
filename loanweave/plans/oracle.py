"""SQL side of the checks: the same results in DuckDB, from the same raw rows."""

from __future__ import annotations

import re

from loanweave.plans import derived as D

_MONEY = re.compile(
    r"(upb|_usd|actual_loss|losses|balance|proceeds|recoveries|expenses|costs?|insurance|interest)$"
)


def decimals(name: str) -> int:
    """Digits a published double is rounded to: cents for money, else six."""
    return 2 if _MONEY.search(name) else 6


def _list(columns: dict[str, str]) -> str:
    return ", ".join(f"{e} AS {name}" for name, e in columns.items())


def _month(text: str) -> str:
    form = {True: "'%Y%m'", False: "'%m%Y'"}
    return (
        f"CAST(if(left({text}, 4) BETWEEN '1900' AND '2100', try_strptime({text}, {form[True]}), "
        f"try_strptime({text}, {form[False]})) AS DATE)"
    )


def _flag(column: str) -> str:
    return f"({column} IS NOT DISTINCT FROM 'Y')"


RAW = f"""
base AS (
  SELECT {_list(D.BASE)}
  FROM (SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_orderkey
          ORDER BY {", ".join(f"{c} DESC NULLS LAST" for c in D._ORDER)}) = 1)
  LEFT JOIN (SELECT c_custkey, max(c_nationkey) AS c_nationkey FROM customer GROUP BY 1)
    ON o_custkey = c_custkey
),
rawo AS (SELECT {_list(D.ORIGINATION)} FROM base),
aged AS (
  SELECT base.*, age FROM base, (SELECT unnest(range(1, {D.MAX_AGE + 1})) AS age)
  WHERE age <= end_age AND fpi + age <= {D._LAST_INDEX + 1}
),
monthly AS (SELECT *, {_list(D.MONTHLY)} FROM aged),
rawp AS (SELECT {_list(D.PERFORMANCE)} FROM monthly)
"""

SILVER = f"""
so AS (
  SELECT loan_sequence_number AS loan_id,
    {_month('first_payment_date')} AS first_payment_date,
    CAST(date_trunc('month', {_month('first_payment_date')} - INTERVAL 1 MONTH) AS DATE)
      AS origination_date,
    {_month('maturity_date')} AS maturity_date,
    original_upb, original_interest_rate, original_loan_term, ltv AS original_ltv,
    cltv AS original_cltv, CAST(credit_score AS BIGINT) AS fico, dti,
    mi_pct AS mortgage_insurance_pct, num_units, num_borrowers, loan_purpose,
    occupancy_status AS occupancy, property_type, property_state, channel, postal_code, msa,
    {_flag('first_time_homebuyer_flag')} AS first_time_homebuyer,
    {_flag('interest_only_indicator')} AS interest_only,
    {_flag('super_conforming_flag')} AS super_conforming,
    {_flag('prepayment_penalty_flag')} AS prepayment_penalty,
    amort_type, program_indicator, _source_file, _source_vintage
  FROM rawo
),
coded AS (
  SELECT *, current_loan_delinquency_status AS st,
    TRY_CAST(current_loan_delinquency_status AS INTEGER) AS num FROM rawp
),
sp AS (
  SELECT loan_sequence_number AS loan_id,
    {_month('monthly_reporting_period')} AS reporting_period,
    current_actual_upb AS current_upb,
    ifnull(current_deferred_upb, 0e0) AS deferred_upb,
    ifnull(interest_bearing_upb, current_actual_upb) AS interest_bearing_upb,
    zero_balance_removal_upb, current_interest_rate, loan_age,
    remaining_months_to_legal_maturity AS remaining_term, st AS raw_delinquency_status,
    CAST(if(st = 'RA', 99, num) AS BIGINT) AS delinquency_months,
    CASE WHEN st = '0' OR st = '00' THEN 'CURRENT' WHEN st = '1' THEN 'DQ30'
      WHEN st = '2' THEN 'DQ60' WHEN num > 2 THEN 'DQ90PLUS' WHEN st = 'RA' THEN 'REO'
      WHEN length(zero_balance_code) > 0 THEN 'TERMINAL' ELSE 'UNKNOWN' END AS delinquency_state,
    {_flag('modification_flag')} AS modification_flag,
    {_flag('step_modification_flag')} AS step_modification_flag,
    {_flag('deferred_payment_plan')} AS deferred_payment_plan,
    borrower_assistance_status_code, zero_balance_code,
    {_month('zero_balance_effective_date')} AS zero_balance_date,
    estimated_ltv,
    if(net_sale_proceeds = 'C', NULL, TRY_CAST(net_sale_proceeds AS DOUBLE)) AS net_sale_proceeds,
    mi_recoveries, non_mi_recoveries, expenses, legal_costs, maintenance_costs,
    taxes_insurance, miscellaneous_expenses, actual_loss_calculation AS actual_loss,
    modification_cost, delinquent_accrued_interest,
    {_flag('delinquency_due_to_disaster')} AS delinquency_due_to_disaster,
    _source_file, _source_vintage
  FROM coded
),
panel AS (
  SELECT p.loan_id, p.reporting_period, o.* EXCLUDE (loan_id, postal_code, program_indicator,
      _source_file, _source_vintage),
    p.* EXCLUDE (loan_id, reporting_period, modification_cost, _source_file, _source_vintage),
    p._source_vintage AS vintage,
    year(o.origination_date) AS origination_year, quarter(o.origination_date) AS origination_quarter,
    year(p.reporting_period) AS reporting_year, month(p.reporting_period) AS reporting_month,
    if(o.original_upb > 0, p.current_upb / o.original_upb, NULL) AS upb_ratio,
    if(zero_balance_code IS NULL, NULL, ifnull(map_extract_value(MAP {{
      '01': 'voluntary_prepayment', '02': 'third_party_sale', '03': 'short_sale',
      '06': 'repurchase', '09': 'reo_disposition', '15': 'note_sale',
      '16': 'reperforming_sale'}}, zero_balance_code), 'other_terminal')) AS terminal_event_type,
    ifnull(length(zero_balance_code) > 0, false) AS is_terminal,
    ifnull(zero_balance_code = '01', false) AS is_voluntary_prepayment,
    ifnull(list_contains(['02', '03', '09', '15'], zero_balance_code), false) AS is_credit_event,
    ifnull(delinquency_months, 0) >= 3
      OR delinquency_state IN ('DQ90PLUS', 'REO', 'TERMINAL') AS is_seriously_delinquent
  FROM sp p JOIN so o ON p.loan_id = o.loan_id
),
latest AS (
  SELECT * FROM panel WHERE NOT is_terminal AND reporting_period =
    (SELECT max(reporting_period) FROM panel WHERE NOT is_terminal)
)
"""

# Weighted average over rows with a value and a positive balance.


def wa(value: str, weight: str = "current_upb") -> str:
    keep = f"FILTER (WHERE {value} IS NOT NULL AND {weight} > 0)"
    return f"sum({value} * {weight}) {keep} / nullif(sum({weight}) {keep}, 0)"


def share(condition: str, weight: str = "current_upb") -> str:
    return (
        f"ifnull(100 * ifnull(sum({weight}) FILTER (WHERE {condition}), 0e0) "
        f"/ nullif(sum({weight}), 0), 0e0)"
    )


def portfolio(source: str) -> str:
    """One row of portfolio metrics of a relation."""
    return f"""
      SELECT count(*) AS loan_count, ifnull(sum(current_upb), 0e0) AS total_current_upb,
        ifnull(sum(current_upb) / nullif(count(*), 0), 0e0) AS avg_loan_balance,
        {wa('current_interest_rate')} AS wa_coupon, {wa('fico')} AS wa_fico,
        {wa('original_ltv')} AS wa_ltv, {wa('original_cltv')} AS wa_cltv, {wa('dti')} AS wa_dti,
        {wa('loan_age')} AS wala, {wa('remaining_term')} AS warm,
        {share("loan_purpose = 'P'")} AS purchase_pct,
        {share("loan_purpose IN ('C', 'R')")} AS refinance_pct,
        {share("occupancy = 'P'")} AS owner_occupied_pct,
        {share("occupancy = 'I'")} AS investor_pct, {share("occupancy = 'S'")} AS second_home_pct,
        {share("mortgage_insurance_pct > 0")} AS mi_share_pct,
        {share("delinquency_state = 'CURRENT'")} AS current_pct,
        {share("delinquency_state = 'DQ30'")} AS dq30_pct,
        {share("delinquency_state = 'DQ60'")} AS dq60_pct,
        {share("delinquency_state IN ('DQ90PLUS', 'REO')")} AS dq90plus_pct,
        {share("fico < 660")} AS low_fico_pct, {share("original_ltv > 80")} AS high_ltv_pct,
        {share("modification_flag")} AS modified_pct,
        (SELECT property_state FROM {source} GROUP BY 1
          ORDER BY sum(current_upb) DESC, property_state LIMIT 1) AS largest_state,
        ifnull(100 * (SELECT sum(current_upb) FROM {source} GROUP BY property_state
          ORDER BY 1 DESC LIMIT 1) / nullif(sum(current_upb), 0), 0e0) AS largest_state_pct
      FROM {source}"""


PORTFOLIO_FLOATS = (
    "total_current_upb avg_loan_balance wa_coupon wa_fico wa_ltv wa_cltv wa_dti wala warm "
    "purchase_pct refinance_pct owner_occupied_pct investor_pct second_home_pct mi_share_pct "
    "current_pct dq30_pct dq60_pct dq90plus_pct low_fico_pct high_ltv_pct modified_pct "
    "largest_state_pct"
)


def bands(column: str, edges: tuple, labels: tuple) -> str:
    """Half-open band label."""
    arms = " ".join(
        f"WHEN {column} >= {lo} AND {column} < {hi} THEN '{label}'"
        for lo, hi, label in zip(edges, edges[1:], labels)
    )
    return f"CASE {arms} ELSE 'Other' END"


def steps(column: str, limits: tuple, labels: tuple, op: str) -> str:
    arms = " ".join(f"WHEN {column} {op} {x} THEN '{y}'" for x, y in zip(limits, labels))
    return f"CASE {arms} ELSE '{labels[-1]}' END"


def regions(dc: str) -> str:
    """State to region by position in one text per region."""
    table = {
        "Northeast": "CT MA ME NH NJ NY PA RI VT",
        "Southeast": "AL AR FL GA KY LA MS NC SC TN VA WV",
        "Midwest": "IA IL IN KS MI MN MO ND NE OH SD WI",
        "Southwest": "AZ NM OK TX",
        "West": "AK CA CO HI ID MT NV OR UT WA WY",
        dc: "DC MD",
    }
    arms = " ".join(
        f"WHEN list_contains(string_split('{states}', ' '), property_state) THEN '{name}'"
        for name, states in table.items()
    )
    return f"CASE {arms} ELSE 'Other' END"


def strat(source: str, label: str, name: str, extra: str = "") -> str:
    def mean(v: str) -> str:
        return (
            f"sum({v} * current_upb) / nullif(sum(current_upb) FILTER (WHERE {v} IS NOT NULL), 0)"
        )

    return f"""
      SELECT {extra} {label} AS {name}, count(*) AS loan_count,
        sum(current_upb) AS current_upb,
        sum(current_interest_rate * current_upb) / nullif(sum(current_upb), 0) AS wa_coupon,
        {mean('fico')} AS wa_fico, {mean('original_ltv')} AS wa_ltv, {mean('dti')} AS wa_dti,
        100 * sum(current_upb) / (SELECT sum(current_upb) FROM {source}) AS pool_pct
      FROM {source} GROUP BY ALL"""


STRAT_FLOATS = "current_upb wa_coupon wa_fico wa_ltv wa_dti pool_pct"


def statement(
    sql: str,
    floats: str = "",
    ctes: str = "",
    digits: dict[str, int] | None = None,
    recursive: bool = False,
) -> str:
    """One statement: shared CTEs, the query's own, and rounding of its doubles."""
    rounded = ", ".join(
        f"ROUND({c}, {(digits or {}).get(c, decimals(c))}) + 0e0 AS {c}" for c in floats.split()
    )
    replace = f" REPLACE ({rounded})" if rounded else ""
    own = f", {ctes}" if ctes else ""
    keyword = "WITH RECURSIVE" if recursive else "WITH"
    return f"{keyword} {RAW}, {SILVER}{own}, result AS ({sql}) SELECT *{replace} FROM result"
