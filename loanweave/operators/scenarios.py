"""Stress scenarios over pools of loans, and the deal summary."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loanweave.fixed import DEFAULT_SEVERITY, MI_COVERAGE, MI_SHARE, SCENARIOS
from loanweave.functions.columns import total


def _scenario_structs(scenarios: Sequence[tuple]) -> Column:
    names = ("scenario", "description", "default_multiplier", "severity_multiplier",
             "prepayment_multiplier")
    return F.array(
        *[
            F.struct(*[F.lit(value).alias(name) for name, value in zip(names, row, strict=True)])
            for row in scenarios
        ]
    )


def project(
    pools: DataFrame,
    ce_assumption_pct: float | None = None,
    projection_years: int = 5,
    scenarios: Sequence[tuple] = SCENARIOS,
) -> DataFrame:
    """Annual and cumulative projections of every pool row under every scenario.

    ``pools`` has pool_upb, loan_count and the base rates base_credit_event_rate, base_severity
    and base_prepayment_rate (fractions); any other columns are carried along.
    """
    c = F.col
    rows = pools.withColumn("s", F.explode(_scenario_structs(scenarios)))
    rates = rows.select(
        *pools.columns,
        "s.*",
        (c("base_credit_event_rate") * c("s.default_multiplier")).alias(
            "stressed_credit_event_rate"
        ),
        (c("base_severity") * c("s.severity_multiplier")).alias("stressed_severity"),
        (c("base_prepayment_rate") * c("s.prepayment_multiplier")).alias(
            "stressed_prepayment_rate"
        ),
    )
    event_upb = c("pool_upb") * c("stressed_credit_event_rate")
    gross = event_upb * c("stressed_severity")
    gross_pct = c("stressed_credit_event_rate") * c("stressed_severity") * 100.0
    base_loss = c("pool_upb") * c("base_credit_event_rate") * c("base_severity")

    def loans(rate: str) -> Column:
        return F.bround(c("loan_count") * c(rate), 0).cast("bigint")

    cushion = (
        F.lit(None).cast("double")
        if ce_assumption_pct is None
        else c("pool_upb") * ce_assumption_pct / 100.0 - gross
    )
    return rates.withColumns(
        {
            "projected_credit_events": loans("stressed_credit_event_rate"),
            "projected_credit_event_pct": c("stressed_credit_event_rate") * 100.0,
            "projected_prepayments": loans("stressed_prepayment_rate"),
            "projected_prepayment_pct": c("stressed_prepayment_rate") * 100.0,
            "projected_gross_loss_usd": gross,
            "projected_gross_loss_pct": gross_pct,
            "projected_net_loss_usd": F.greatest(
                F.lit(0.0), gross - event_upb * (MI_SHARE * MI_COVERAGE)
            ),
            "cumulative_loss_pct_3yr": gross_pct * min(projection_years, 3),
            "cumulative_loss_pct_5yr": gross_pct * min(projection_years, 5),
            "scenario_delta_credit_events": loans("stressed_credit_event_rate")
            - loans("base_credit_event_rate"),
            "scenario_delta_loss_usd": gross - base_loss,
            "indicative_loss_cushion": cushion,
            "ce_assumption_pct": F.lit(ce_assumption_pct).cast("double"),
        }
    )


def pool_base(
    loans: DataFrame,
    credit_event_rate: float,
    severity: float,
    prepayment_rate: float,
    by: Sequence[str] = (),
) -> DataFrame:
    """Pool balance and loan count (per group of ``by``) with given base rates."""
    sums = [total("current_upb").alias("pool_upb"), F.count(F.lit(1)).alias("loan_count")]
    pools = loans.groupBy(*by).agg(*sums) if by else loans.agg(*sums)
    return pools.withColumns(
        {
            "base_credit_event_rate": F.lit(float(credit_event_rate)),
            "base_severity": F.lit(float(severity)),
            "base_prepayment_rate": F.lit(float(prepayment_rate)),
        }
    )


def pool_base_from_scores(loans: DataFrame) -> DataFrame:
    """Base rates from the pool's mean model scores."""

    def mean(column: str, default: float) -> Column:
        value = F.avg(column) if column in loans.columns else F.lit(None).cast("double")
        present = F.when(value != 0, value) if column in loans.columns else value
        return F.coalesce(present, F.lit(default))

    return loans.agg(
        total("current_upb").alias("pool_upb"),
        F.count(F.lit(1)).alias("loan_count"),
        mean("credit_event_score", 0.0).alias("base_credit_event_rate"),
        mean("loss_severity_score", DEFAULT_SEVERITY).alias("base_severity"),
        mean("prepayment_score", 0.0).alias("base_prepayment_rate"),
    )


def scenario_table(projection: DataFrame) -> DataFrame:
    """Rounded display table."""

    def millions(column: str) -> Column:
        return F.bround(F.col(column) / 1e6, 2)

    return projection.select(
        "scenario",
        "default_multiplier",
        "severity_multiplier",
        "prepayment_multiplier",
        F.bround(F.col("stressed_credit_event_rate") * 100, 2).alias("stressed_ce_rate_pct"),
        F.bround(F.col("stressed_severity") * 100, 2).alias("stressed_severity_pct"),
        millions("projected_gross_loss_usd").alias("projected_ce_musd"),
        F.bround("projected_gross_loss_pct", 3).alias("gross_loss_pct_upb"),
        F.bround("cumulative_loss_pct_3yr", 3).alias("cum_loss_3yr_pct"),
        F.bround("cumulative_loss_pct_5yr", 3).alias("cum_loss_5yr_pct"),
        millions("scenario_delta_loss_usd").alias("delta_vs_base_musd"),
        millions("indicative_loss_cushion").alias("ce_cushion_musd"),
    )


_OVERVIEW = ("total_current_upb", "loan_count", "wa_coupon", "wa_fico", "wa_ltv", "wa_dti",
             "wala", "purchase_pct", "investor_pct")
_CONCENTRATION = ("low_fico_pct", "high_ltv_pct", "modified_pct", "largest_state_pct")


def _long(frame: DataFrame, section: str, items: Sequence[tuple[Column, Column]]) -> DataFrame:
    pairs = F.array(
        *[
            F.struct(
                F.lit(section).alias("section"),
                name.alias("item"),
                value.cast("double").alias("value"),
            )
            for name, value in items
        ]
    )
    return frame.select(F.explode(pairs).alias("i")).select("i.*")


def deal_summary(metrics: DataFrame, constraints: DataFrame, projection: DataFrame) -> DataFrame:
    """Metrics, concentrations, constraint results and scenario losses as (section, item, value)."""
    delinquent = F.col("dq30_pct") + F.col("dq60_pct") + F.col("dq90plus_pct")
    parts = [
        _long(metrics, "collateral", [(F.lit(n), F.col(n)) for n in _OVERVIEW]),
        _long(
            metrics,
            "concentration",
            [(F.lit(n), F.col(n)) for n in _CONCENTRATION] + [(F.lit("delinquent_pct"), delinquent)],
        ),
        _long(
            constraints,
            "constraint",
            [
                (F.concat("name", F.lit(" actual")), F.col("actual")),
                (F.concat("name", F.lit(" pass")), (F.col("status") == "PASS").cast("int")),
            ],
        ),
        _long(
            projection,
            "scenario",
            [
                (F.concat("scenario", F.lit(f" {n}")), F.col(n))
                for n in ("projected_gross_loss_pct", "cumulative_loss_pct_3yr",
                          "cumulative_loss_pct_5yr")
            ],
        ),
    ]
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    return union
