"""Pool and scenario queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanweave.fixed import SCENARIOS
from loanweave.operators import pool as P
from loanweave.operators import scenarios as S
from loanweave.operators.collateral import portfolio_metrics
from loanweave.operators.silver import panel_as_of
from loanweave.plans.catalog.base import Catalog, Context
from loanweave.plans.catalog.models import CREDIT, LOSS, PREPAY
from loanweave.plans.oracle import portfolio
from loanweave.storage import written

TARGET_UPB = 20_000_000.0
LOSS_OR_NULL = f"case when dti is null then null else {LOSS} end"
RULES = P.Eligibility(min_remaining_term=330, vintage_min=1998, allowed_property_types=("SF", "CO"))


def _latest(c: Context) -> DataFrame:
    """Active loans of the last period, with the columns that pools read."""
    return panel_as_of(c.panel_of(P.POOL_COLUMNS).table)


def _scores(c: Context) -> DataFrame:
    """Fixed scores of the latest period."""
    return _latest(c).select(
        "loan_id",
        F.expr(CREDIT).alias("credit_event_score"),
        F.expr(PREPAY).alias("prepayment_score"),
        F.expr(LOSS_OR_NULL).alias("loss_severity_score"),
    )


def _candidates(c: Context) -> DataFrame:
    """Eligible loans of the latest period with fixed scores attached."""
    return P.attach_scores(P.eligible(_latest(c)), _scores(c))


def _job(c: Context) -> DataFrame:
    """The whole pool job: candidates and pool, counted."""
    stages = P.build_pool(_latest(c), _scores(c), target_upb=TARGET_UPB)
    counted = [
        rows.groupBy(F.lit(name).alias("stage")).agg(
            F.count(F.lit(1)).alias("loans"), F.sum("current_upb").alias("current_upb"),
            F.avg("composite_score").alias("mean_score"),
        )
        for name, rows in zip(("candidates", "pool"), stages)
    ]
    return counted[0].unionByName(counted[1])


def _ranked(c: Context) -> DataFrame:
    return P.composite_score(
        _candidates(c), "credit_event_score", "prepayment_score", "expected_loss_usd"
    )


_pools: dict[tuple, DataFrame] = {}


def _select(c: Context, tolerance: float) -> DataFrame:
    return P.select_pool(_ranked(c), TARGET_UPB, tolerance)


def _pool(c: Context) -> DataFrame:
    """The selected pool, stored once a session, since several queries describe it."""
    key = (c.spark.sparkContext.applicationId, c.sf_dir)
    if key not in _pools:
        _pools[key] = written(_select(c, 0.5), "pool")
    return _pools[key]


CANDIDATES = f"""
  eligible AS (
    SELECT * FROM latest WHERE delinquency_state = 'CURRENT'
      AND ifnull(remaining_term, 12) >= 12 AND current_upb BETWEEN 10000 AND 2000000
  ),
  loans AS (
    SELECT *, current_upb * credit_event_score * ifnull(loss_severity_score, 35e-2)
      AS expected_loss_usd
    FROM (SELECT *, {CREDIT} AS credit_event_score, {PREPAY} AS prepayment_score,
            {LOSS_OR_NULL} AS loss_severity_score FROM eligible)
  ),
  limits AS (
    SELECT min(credit_event_score) AS a0, max(credit_event_score) AS a1,
      min(prepayment_score) AS b0, max(prepayment_score) AS b1,
      min(expected_loss_usd) AS c0, max(expected_loss_usd) AS c1 FROM loans
  ),
  ranked AS (
    SELECT loans.*, 0e0 + (credit_event_score - a0) / (a1 - a0) * 5e-1
      + (prepayment_score - b0) / (b1 - b0) * 2e-1
      + (expected_loss_usd - c0) / (c1 - c0) * 3e-1 AS composite_score
    FROM loans, limits
  ),
  guarded AS MATERIALIZED (
    SELECT row_number() OVER (ORDER BY composite_score, loan_id) AS i, loan_id,
      current_upb AS b, dense_rank() OVER (ORDER BY property_state) AS s
    FROM ranked WHERE fico >= 745 AND original_ltv <= 72 AND dti <= 40 AND occupancy <> 'I'
  )
"""


def _walk(tolerance: float) -> str:
    """Loan after loan in order, carrying the total and one balance per state."""
    low, high = TARGET_UPB * (1 - tolerance / 100), TARGET_UPB * (1 + tolerance / 100)
    return f"""{CANDIDATES},
  walk AS (
    SELECT CAST(0 AS BIGINT) AS i, 0e0 AS total, list_resize(CAST([] AS DOUBLE[]), 60, 0e0) AS held,
      '' AS loan_id, false AS taken
    UNION ALL
    SELECT g.i, if(ok, total + b, total),
      if(ok, list_transform(held, lambda x, j: if(j = s, x + b, x)), held), g.loan_id, ok
    FROM (SELECT g.*, total, held, b > 0 AND total + b <= {high}
            AND held[s] + b <= {low} * 20e0 / 100e0 AS ok
          FROM walk w JOIN guarded g ON g.i = w.i + 1 WHERE total < {low}) g
  ),
  pool AS (SELECT r.* FROM ranked r WHERE loan_id IN (SELECT loan_id FROM walk WHERE taken))
"""


def _constraints(source: str) -> str:
    rows = [
        ("'Pool UPB'", TARGET_UPB, "total_current_upb", "~", "$",
         f"total_current_upb BETWEEN {TARGET_UPB * .995} AND {TARGET_UPB * 1.005}",
         "±0.5% tolerance"),
        ("'Min WA FICO'", 745, "wa_fico", ">=", "", "wa_fico >= 744.999", ""),
        ("'Max WA LTV'", 72, "wa_ltv", "<=", "%", "wa_ltv <= 72.001", ""),
        ("'Max WA DTI'", 40, "wa_dti", "<=", "%", "wa_dti <= 40.001", ""),
        ("'Max Investor Share'", 8, "investor_pct", "<=", "%", "investor_pct <= 8.001", ""),
        ("'Max High-LTV Share (>80%)'", 15, "high_ltv_pct", "<=", "%",
         "high_ltv_pct <= 15.001", ""),
        ("'Max Low-FICO Share (<660)'", 5, "low_fico_pct", "<=", "%",
         "low_fico_pct <= 5.001", ""),
        ("'Max Modified Share'", 5, "modified_pct", "<=", "%", "modified_pct <= 5.001", ""),
        ("'Max Delinquent Share'", 0, "dq30_pct + dq60_pct + dq90plus_pct", "<=", "%",
         "dq30_pct + dq60_pct + dq90plus_pct <= 0.001", ""),
        ("'Max State Conc. (' || ifnull(largest_state, 'None') || ')'", 20, "largest_state_pct",
         "<=", "%", "largest_state_pct <= 20.001", ""),
    ]
    return " UNION ALL ".join(
        f"""SELECT {name} AS name, CAST({target} AS DOUBLE) AS target, {actual} AS actual,
              '{direction}' AS direction, '{unit}' AS unit, if({ok}, 'PASS', 'FAIL') AS status,
              '{note}' AS note FROM ({portfolio(source)})"""
        for name, target, actual, direction, unit, ok, note in rows
    )


_LIMITS = {**P.default_constraints(), "target_upb": TARGET_UPB}
_COMPARED = [
    ("Total UPB ($M)", "total_current_upb / 1e6"), ("Loan Count", "CAST(loan_count AS DOUBLE)"),
    ("WA Coupon (%)", "wa_coupon"), ("WA FICO", "wa_fico"), ("WA LTV (%)", "wa_ltv"),
    ("WA DTI (%)", "wa_dti"), ("WALA (mo)", "wala"), ("Investor % (UPB)", "investor_pct"),
    ("High-LTV % (UPB)", "high_ltv_pct"), ("Low-FICO % (UPB)", "low_fico_pct"),
    ("Modified % (UPB)", "modified_pct"), ("Largest State %", "largest_state_pct"),
]


def _project(pools: str, keep: str = "") -> str:
    """Scenario rows of a relation with pool_upb, loan_count and the base rates d, v, q."""
    values = ", ".join(f"('{n}', '{t}', {d}e0, {s}e0, {p}e0)" for n, t, d, s, p in SCENARIOS)
    return f"""
      SELECT {keep} pool_upb, loan_count, d AS base_credit_event_rate, v AS base_severity,
        q AS base_prepayment_rate, scenario, description, dm AS default_multiplier,
        sm AS severity_multiplier, pm AS prepayment_multiplier,
        d * dm AS stressed_credit_event_rate, v * sm AS stressed_severity,
        q * pm AS stressed_prepayment_rate,
        CAST(round_even(loan_count * (d * dm), 0) AS BIGINT) AS projected_credit_events,
        d * dm * 100 AS projected_credit_event_pct,
        CAST(round_even(loan_count * (q * pm), 0) AS BIGINT) AS projected_prepayments,
        q * pm * 100 AS projected_prepayment_pct,
        pool_upb * (d * dm) * (v * sm) AS projected_gross_loss_usd,
        d * dm * (v * sm) * 100 AS projected_gross_loss_pct,
        greatest(0e0, pool_upb * (d * dm) * (v * sm) - pool_upb * (d * dm) * 5e-2)
          AS projected_net_loss_usd,
        d * dm * (v * sm) * 300 AS cumulative_loss_pct_3yr,
        d * dm * (v * sm) * 500 AS cumulative_loss_pct_5yr,
        CAST(round_even(loan_count * (d * dm), 0) - round_even(loan_count * d, 0) AS BIGINT)
          AS scenario_delta_credit_events,
        pool_upb * (d * dm) * (v * sm) - pool_upb * d * v AS scenario_delta_loss_usd,
        pool_upb * 4e-2 - pool_upb * (d * dm) * (v * sm) AS indicative_loss_cushion,
        4e0 AS ce_assumption_pct
      FROM ({pools}), (VALUES {values}) AS m(scenario, description, dm, sm, pm)"""


PROJECT_FLOATS = (
    "pool_upb base_credit_event_rate base_severity base_prepayment_rate "
    "stressed_credit_event_rate stressed_severity stressed_prepayment_rate "
    "projected_credit_event_pct projected_prepayment_pct projected_gross_loss_usd "
    "projected_gross_loss_pct projected_net_loss_usd cumulative_loss_pct_3yr "
    "cumulative_loss_pct_5yr scenario_delta_loss_usd indicative_loss_cushion"
)
CUSHION = {"indicative_loss_cushion": 2}
_BASE = (
    "sum(current_upb) AS pool_upb, count(*) AS loan_count, 15e-3 AS d, 35e-2 AS v, 18e-2 AS q"
)


def _base(c: Context, *by: str) -> DataFrame:
    return S.pool_base(_latest(c), 0.015, 0.35, 0.18, by)


def register(catalog: Catalog) -> None:
    add = catalog.add
    kept = "loan_id remaining_term current_upb origination_year property_type".split()
    eligible = (
        "NOT is_terminal AND delinquency_state = 'CURRENT' AND remaining_term >= 330 "
        "AND current_upb BETWEEN 10000 AND 2000000 AND origination_year >= 1998 "
        "AND property_type IN ('SF', 'CO')"
    )
    add("eligible_candidates", lambda c: P.eligible(_latest(c), RULES).select(*kept),
        f"SELECT {', '.join(kept)} FROM latest WHERE {eligible}", "current_upb")
    tests = [t.strip() for t in eligible.replace("BETWEEN 10000 AND", "BETWEEN 10000 TO").split("AND")]
    tests = [t.replace(" TO ", " AND ") for t in tests]
    names = ["terminated", "not_current", "short_remaining_term", "upb_out_of_range",
             "vintage_too_old", "disallowed_property_type"]
    arms = " ".join(f"WHEN NOT ({t}) THEN '{n}'" for t, n in zip(tests, names, strict=True))
    add(
        "exclusion_waterfall",
        lambda c: P.exclusion_waterfall(_latest(c), RULES),
        f"""WITH r AS (SELECT CASE {arms} END AS reason FROM latest)
            SELECT reason, count(*) AS loans FROM r WHERE reason IS NOT NULL GROUP BY 1
            UNION ALL SELECT '_total_excluded', count(reason) FROM r
            UNION ALL SELECT '_candidate_count', count(*) - count(reason) FROM r""",
    )
    scores = "credit_event_score prepayment_score expected_loss_usd".split()
    add("expected_loss", lambda c: _candidates(c).select("loan_id", *scores),
        f"SELECT loan_id, {', '.join(scores)} FROM loans", " ".join(scores), CANDIDATES)
    add("composite_score", lambda c: _ranked(c).select("loan_id", "composite_score"),
        "SELECT loan_id, composite_score FROM ranked", "composite_score", CANDIDATES)
    add("guardrails", lambda c: P.guardrails(_ranked(c)).select("loan_id", "current_upb"),
        "SELECT loan_id, b AS current_upb FROM guarded", "current_upb", CANDIDATES)
    for name, tolerance in (("pool_greedy", 0.5), ("pool_greedy_wide", 5.0)):
        add(
            name,
            lambda c, tolerance=tolerance: _select(c, tolerance).select(
                "loan_id", "property_state", "current_upb", "composite_score"
            ),
            "SELECT loan_id, property_state, current_upb, composite_score FROM pool",
            "current_upb composite_score",
            _walk(tolerance),
            recursive=True,
        )
    counted = "count(*) AS loans, sum(current_upb) AS current_upb, avg(composite_score) AS mean_score"
    add(
        "pool_job", _job,
        f"SELECT 'candidates' AS stage, {counted} FROM ranked UNION ALL SELECT 'pool', {counted} FROM pool",
        "current_upb mean_score", _walk(0.5), recursive=True,
    )
    add("constraint_check", lambda c: P.check_constraints(_pool(c), _LIMITS),
        _constraints("pool"), "target actual", _walk(0.5), {"actual": 4}, recursive=True)
    add(
        "constraint_summary",
        lambda c: P.constraint_summary(P.check_constraints(_pool(c), _LIMITS)),
        "SELECT count(*) FILTER (WHERE status = 'PASS') AS passed, "
        f"count(*) FILTER (WHERE status = 'FAIL') AS failed FROM ({_constraints('pool')})",
        ctes=_walk(0.5),
        recursive=True,
    )
    add(
        "universe_constraints",
        lambda c: P.check_constraints(_latest(c), _LIMITS),
        _constraints("latest"),
        "target actual",
        digits={"actual": 4},
    )
    lines = " UNION ALL ".join(
        f"SELECT '{label}' AS metric, round(c.v, 2) AS candidate, round(s.v, 2) AS selected, "
        f"round(s.v - c.v, 2) AS delta FROM (SELECT {e} AS v FROM cm) c, (SELECT {e} AS v FROM sm) s"
        for label, e in _COMPARED
    )
    add(
        "pool_comparison",
        lambda c: P.compare_pools(_ranked(c), _pool(c)),
        lines,
        "candidate selected delta",
        f"{_walk(0.5)}, cm AS ({portfolio('ranked')}), sm AS ({portfolio('pool')})",
        recursive=True,
    )
    add(
        "scenario_projection",
        lambda c: S.project(_base(c), 4.0),
        _project(f"SELECT {_BASE} FROM latest"),
        PROJECT_FLOATS,
        digits=CUSHION,
    )
    for name, key in (("scenario_by_vintage", "origination_year"),
                      ("scenario_by_state", "property_state")):
        add(
            name,
            lambda c, key=key: S.project(_base(c, key), 4.0),
            _project(f"SELECT {key}, {_BASE} FROM latest GROUP BY 1", f"{key},"),
            PROJECT_FLOATS,
            digits=CUSHION,
        )

    def rounded(e: str, n: int) -> str:
        return f"CAST(round_even({e}, {n}) AS DOUBLE)"

    table = {
        "stressed_ce_rate_pct": rounded("stressed_credit_event_rate * 100", 2),
        "stressed_severity_pct": rounded("stressed_severity * 100", 2),
        "projected_ce_musd": rounded("projected_gross_loss_usd / 1e6", 2),
        "gross_loss_pct_upb": rounded("projected_gross_loss_pct", 3),
        "cum_loss_3yr_pct": rounded("cumulative_loss_pct_3yr", 3),
        "cum_loss_5yr_pct": rounded("cumulative_loss_pct_5yr", 3),
        "delta_vs_base_musd": rounded("scenario_delta_loss_usd / 1e6", 2),
        "ce_cushion_musd": rounded("indicative_loss_cushion / 1e6", 2),
    }
    add(
        "scenario_table",
        lambda c: S.scenario_table(S.project(_base(c), 4.0)),
        "SELECT scenario, default_multiplier, severity_multiplier, prepayment_multiplier, "
        + ", ".join(f"{e} AS {n}" for n, e in table.items())
        + f" FROM ({_project(f'SELECT {_BASE} FROM latest')})",
        " ".join(table),
    )
    add(
        "scenario_from_scores",
        lambda c: S.project(S.pool_base_from_scores(_pool(c)), 4.0),
        _project(
            "SELECT sum(current_upb) AS pool_upb, count(*) AS loan_count, "
            "avg(credit_event_score) AS d, avg(loss_severity_score) AS v, "
            "avg(prepayment_score) AS q FROM pool"
        ),
        PROJECT_FLOATS,
        _walk(0.5),
        CUSHION,
        recursive=True,
    )
    overview = ("total_current_upb loan_count wa_coupon wa_fico wa_ltv wa_dti wala purchase_pct "
                "investor_pct").split()
    concentration = "low_fico_pct high_ltv_pct modified_pct largest_state_pct".split()

    def item(section: str, name: str, value: str, source: str) -> str:
        return (f"SELECT '{section}' AS section, {name} AS item, CAST({value} AS DOUBLE) AS value "
                f"FROM {source}")

    summary = [item("collateral", f"'{n}'", n, "sm") for n in overview]
    summary += [item("concentration", f"'{n}'", n, "sm") for n in concentration]
    summary.append(item("concentration", "'delinquent_pct'", "dq30_pct + dq60_pct + dq90plus_pct", "sm"))
    summary.append(item("constraint", "name || ' actual'", "actual", "cons"))
    summary.append(item("constraint", "name || ' pass'", "if(status = 'PASS', 1, 0)", "cons"))
    summary += [
        item("scenario", f"scenario || ' {n}'", n, "scen")
        for n in ("projected_gross_loss_pct", "cumulative_loss_pct_3yr", "cumulative_loss_pct_5yr")
    ]
    add(
        "deal_summary",
        lambda c: S.deal_summary(
            portfolio_metrics(_pool(c)),
            P.check_constraints(_pool(c), _LIMITS),
            S.project(S.pool_base(_pool(c), 0.015, 0.35, 0.18), 4.0),
        ),
        " UNION ALL ".join(summary),
        "value",
        f"{_walk(0.5)}, sm AS ({portfolio('pool')}), cons AS ({_constraints('pool')}), "
        f"scen AS ({_project(f'SELECT {_BASE} FROM pool')})",
        {"value": 4},
        recursive=True,
    )
