"""Gold tables over the panel."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanweave.fixed import GOLD_COUPON, GOLD_FICO, GOLD_LTV
from loanweave.functions.columns import (
    annualised_pct,
    open_band,
    over_total,
    ratio,
    region,
    scheduled_principal,
    share_pct,
    weighted_mean,
)
from loanweave.operators.ordered import narrowed, over_history
from loanweave.operators.performance import row_shares
from loanweave.operators.silver import latest_period


def portfolio_snapshot(panel: DataFrame) -> DataFrame:
    """One row of balance-weighted collateral metrics over the active rows given."""
    active = panel.where((F.col("delinquency_state") != "TERMINAL") & ~F.col("is_terminal"))
    c = F.col
    return active.agg(
        F.max("reporting_period").alias("as_of_date"),
        F.countDistinct("loan_id").alias("loan_count"),
        F.sum("current_upb").alias("total_current_upb"),
        F.avg("current_upb").alias("avg_loan_balance"),
        over_total("current_interest_rate").alias("wa_coupon"),
        weighted_mean("fico").alias("wa_fico"),
        weighted_mean("original_ltv").alias("wa_ltv"),
        weighted_mean("original_cltv").alias("wa_cltv"),
        weighted_mean("dti").alias("wa_dti"),
        over_total("loan_age").alias("wala"),
        over_total("remaining_term").alias("warm"),
        share_pct(c("loan_purpose") == "P").alias("purchase_pct"),
        share_pct(c("loan_purpose").isin("C", "R")).alias("refinance_pct"),
        share_pct(c("occupancy") == "P").alias("owner_occupied_pct"),
        share_pct(c("occupancy") == "I").alias("investor_pct"),
        share_pct(c("mortgage_insurance_pct") > 0).alias("mi_share_pct"),
        share_pct(c("delinquency_state") == "CURRENT").alias("current_pct"),
        share_pct(c("delinquency_state") == "DQ30").alias("dq30_pct"),
        share_pct(c("delinquency_state") == "DQ60").alias("dq60_pct"),
        share_pct(c("delinquency_state").isin("DQ90PLUS", "REO")).alias("dq90plus_pct"),
        share_pct(c("fico") < 660).alias("low_fico_pct"),
        share_pct(c("original_ltv") > 80).alias("high_ltv_pct"),
        share_pct(c("modification_flag")).alias("modified_pct"),
    )


def cpr_history(panel: DataFrame, history: int | None = None, weight: str = "current") -> DataFrame:
    """Prepayment speed by period, vintage, age and five loan attributes.

    The attributes group but are not returned. The lag runs over active and prepaying months
    only. ``weight='current'`` weighs by the balance after the month, which is zero for a full
    payoff; ``weight='prior'`` weighs by the balance before it.
    """
    kept = narrowed(
        panel.where(~F.col("is_terminal") | F.col("is_voluntary_prepayment")), "loan_id", "reporting_period", "origination_year", "loan_age", "current_upb",
        "current_interest_rate", "remaining_term", "original_ltv", "fico", "loan_purpose",
        "property_state", "occupancy", "is_voluntary_prepayment", "delinquency_state",
    )
    lagged = over_history(
        kept,
        "loan_id",
        "reporting_period",
        lambda w: {
            "prior_upb": F.lag("current_upb").over(w),
            "prior_rate": F.lag("current_interest_rate").over(w),
            "prior_term": F.lag("remaining_term").over(w),
        },
        back=1,
        history=history,
    )
    prior = F.col("prior_upb")
    payable = (F.col("prior_rate") > 0) & (F.col("prior_term") > 0)
    scheduled = F.when(payable, scheduled_principal(prior, "prior_rate", "prior_term")).otherwise(
        F.lit(0.0)
    )
    paid = (prior - F.coalesce("current_upb", F.lit(0.0)) - scheduled) / prior
    smm = F.when(F.col("is_voluntary_prepayment"), F.lit(1.0)).when(
        prior > 0, F.greatest(paid, F.lit(0.0))
    )
    rated = (
        lagged.where(
            prior.isNotNull() & ~F.col("delinquency_state").isin("DQ60", "DQ90PLUS", "REO")
        )
        .withColumn("smm", smm)
        .where(F.col("smm").isNotNull())
    )
    weigh = {"current": F.col("current_upb"), "prior": prior}[weight]
    cells = rated.groupBy(
        "reporting_period", "origination_year", "loan_age", "original_ltv", "fico",
        "loan_purpose", "property_state", "occupancy",
    ).agg(
        F.count("loan_id").alias("loan_count"),
        F.sum("current_upb").alias("total_upb"),
        F.avg("smm").alias("avg_smm"),
        ratio(F.sum(F.col("smm") * weigh), F.sum(weigh)).alias("wa_smm"),
    )

    def speed(monthly):
        return F.when(monthly.between(0, 1), annualised_pct(monthly))

    return cells.select(
        "reporting_period", "origination_year", "loan_age", "loan_count", "total_upb", "avg_smm",
        "wa_smm",
        speed(F.col("wa_smm")).alias("cpr_wa"),
        speed(F.col("avg_smm")).alias("cpr_simple"),
    )


def roll_rates_by_vintage(panel: DataFrame, history: int | None = None) -> DataFrame:
    """Monthly state transitions by vintage; unknown states are removed before the step."""
    known = narrowed(
        panel.where(F.col("delinquency_state") != "UNKNOWN"),
        "loan_id", "reporting_period", "origination_year", "delinquency_state", "current_upb",
    )
    stepped = over_history(
        known,
        "loan_id",
        "reporting_period",
        lambda w: {"to_state": F.lead("delinquency_state").over(w)},
        ahead=1,
        history=history,
    ).where(F.col("to_state").isNotNull())
    cells = stepped.groupBy(
        F.trunc("reporting_period", "month").alias("cohort_month"),
        "origination_year",
        F.col("delinquency_state").alias("from_state"),
        "to_state",
    ).agg(F.count(F.lit(1)).alias("loan_count"), F.sum("current_upb").alias("upb"))
    return row_shares(cells, ["cohort_month", "origination_year", "from_state"])


def transition_latest(roll_rates: DataFrame) -> DataFrame:
    """Transitions of the last cohort month."""
    last = roll_rates.select(F.max("cohort_month")).scalar()
    return roll_rates.where(F.col("cohort_month") == last)


def loss_severity(panel: DataFrame) -> DataFrame:
    """Loss, severity and recoveries of every credit event with a known loss and balance."""
    removal = F.col("zero_balance_removal_upb")
    recovered = F.coalesce("mi_recoveries", F.lit(0.0)) + F.coalesce(
        "non_mi_recoveries", F.lit(0.0)
    )
    return panel.where(
        F.col("is_credit_event") & removal.isNotNull() & F.col("actual_loss").isNotNull()
    ).select(
        "loan_id", "zero_balance_date", "terminal_event_type", "origination_year", "fico",
        "original_ltv", "original_cltv", "dti", "property_state", "loan_age",
        "mortgage_insurance_pct", "occupancy", "loan_purpose",
        removal.alias("termination_upb"),
        "net_sale_proceeds", "mi_recoveries", "non_mi_recoveries", "expenses",
        "delinquent_accrued_interest", "actual_loss",
        F.when(removal > 0, ratio(F.col("actual_loss"), removal)).alias("loss_severity"),
        recovered.alias("total_recoveries"),
        F.when(removal > 0, ratio(recovered, removal)).alias("recovery_rate"),
    )


#: The columns of a panel that ``replines_table`` reads.
REPLINE_COLUMNS = (
    "loan_id reporting_period reporting_year is_terminal fico original_ltv original_interest_rate "
    "origination_year property_state current_upb current_interest_rate dti loan_age "
    "delinquency_months"
).split()


def replines_table(panel: DataFrame, min_cell_loans: int = 5) -> DataFrame:
    """Collateral cells of the latest active period; cells below the minimum are left out."""
    period = latest_period(panel)
    active = panel.where(
        ~F.col("is_terminal")
        & (F.col("reporting_period") == period)
        & (F.col("reporting_year") == F.year(period))
    )
    cells = active.groupBy(
        open_band("fico", *GOLD_FICO).alias("fico_band"),
        open_band("original_ltv", *GOLD_LTV, inclusive=True).alias("ltv_band"),
        open_band("original_interest_rate", *GOLD_COUPON).alias("coupon_band"),
        F.col("origination_year").alias("vintage"),
        region("property_state", {"DC_MD": "DC/MD"}).alias("state_group"),
    ).agg(
        F.countDistinct("loan_id").alias("loan_count"),
        F.sum("current_upb").alias("upb"),
        over_total("current_interest_rate").alias("wac"),
        weighted_mean("fico").alias("wa_fico"),
        weighted_mean("original_ltv").alias("wa_ltv"),
        weighted_mean("dti").alias("wa_dti"),
        over_total("loan_age").alias("wala"),
        F.sum("current_upb").alias("pool_upb_raw"),
        share_pct(F.col("delinquency_months") > 0).alias("delinquency_rate_pct"),
    )
    return cells.where(F.col("loan_count") >= min_cell_loans)
