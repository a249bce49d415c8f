"""Prepayment speeds, delinquency transitions, credit events and loss severity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loanweave.fixed import DELINQUENCY_STATES, ROLL_RATES
from loanweave.functions.columns import annualised_pct, ratio, scheduled_principal, total
from loanweave.operators.ordered import exact_quantiles, narrowed, over_history

# --- prepayment --------------------------------------------------------------------------

_SMM_NEEDS = (
    "loan_id reporting_period current_upb current_interest_rate remaining_term "
    "is_voluntary_prepayment delinquency_state"
).split()
_SMM_KEEPS = (
    "loan_id reporting_period origination_year loan_age current_upb fico original_ltv "
    "loan_purpose property_state occupancy current_interest_rate is_voluntary_prepayment"
).split()


def compute_smm(panel: DataFrame, history: int | None = None) -> DataFrame:
    """Single-month mortality and CPR per loan-month.

    The previous month is looked up over all rows; only then are first months and months 60 or
    more days past due dropped. A voluntary payoff is an SMM of 1.
    """
    missing = sorted(set(_SMM_NEEDS) - set(panel.columns))
    if missing:
        raise ValueError(f"panel lacks columns {missing}")
    used = [c for c in dict.fromkeys(_SMM_NEEDS + _SMM_KEEPS) if c in panel.columns]
    lagged = over_history(
        narrowed(panel, *used),
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
    scheduled = scheduled_principal(
        prior,
        F.coalesce("prior_rate", F.lit(0.0)),
        F.coalesce("prior_term", F.lit(1)),
    )
    paid = (prior - F.coalesce("current_upb", F.lit(0.0)) - scheduled) / prior
    smm = F.when(F.col("is_voluntary_prepayment"), F.lit(1.0)).otherwise(
        F.least(F.greatest(paid, F.lit(0.0)), F.lit(1.0))
    )
    return (
        lagged.where(
            ~F.col("delinquency_state").isin("DQ60", "DQ90PLUS", "REO", "TERMINAL") & (prior > 0)
        )
        .select(
            *[c for c in _SMM_KEEPS if c in panel.columns], "prior_upb", smm.alias("smm")
        )
        .withColumn("cpr", annualised_pct(F.col("smm")))
    )


def aggregate_cpr(
    smm: DataFrame, by: Sequence[str] = ("reporting_period",), weight: str = "current_upb"
) -> DataFrame:
    """Loan count, balance, mean and balance-weighted SMM, and CPR per group.

    ``weight='prior_upb'`` weighs by the balance before the month, so that payoffs count.
    """
    weigh = F.col(weight)
    return (
        smm.groupBy(*by)
        .agg(
            F.count(F.lit(1)).alias("loan_count"),
            total("current_upb").alias("total_upb"),
            F.avg("smm").alias("avg_smm"),
            ratio(F.sum(F.col("smm") * weigh), F.sum(weigh)).alias("wa_smm"),
        )
        .withColumn("cpr_wa", annualised_pct(F.col("wa_smm")))
    )


# --- delinquency -------------------------------------------------------------------------


def row_shares(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add each cell's share of its row's loans; the window covers aggregated cells only."""
    row_total = F.sum("loan_count").over(Window.partitionBy(*keys))
    return cells.withColumn(
        "transition_rate_pct", 100.0 * ratio(F.col("loan_count"), row_total)
    )


def transition_matrix(
    panel: DataFrame, history: int | None = None, require_adjacent: bool = False
) -> DataFrame:
    """Monthly transitions between delinquency states, as counts, balance and row percentages.

    The next state is taken before unknown states are removed as origins, so ``UNKNOWN`` can be
    a destination. ``require_adjacent`` keeps only steps to the very next calendar month.
    """
    steps = over_history(
        narrowed(panel, "loan_id", "reporting_period", "delinquency_state", "current_upb"),
        "loan_id",
        "reporting_period",
        lambda w: {
            "to_state": F.lead("delinquency_state").over(w),
            "to_period": F.lead("reporting_period").over(w),
        },
        ahead=1,
        history=history,
    ).where((F.col("delinquency_state") != "UNKNOWN") & F.col("to_state").isNotNull())
    if require_adjacent:
        steps = steps.where(F.col("to_period") == F.add_months("reporting_period", 1))
    cells = steps.groupBy(
        F.trunc("reporting_period", "month").alias("cohort_month"),
        F.col("delinquency_state").alias("from_state"),
        "to_state",
    ).agg(F.count(F.lit(1)).alias("loan_count"), total("current_upb").alias("upb"))
    return row_shares(cells, ["cohort_month", "from_state"])


def roll_rates(matrix: DataFrame) -> DataFrame:
    """Named roll and cure rates per cohort month, one column each."""
    rates = [
        F.max(
            F.when(
                (F.col("from_state") == origin) & (F.col("to_state") == target),
                F.col("transition_rate_pct"),
            )
        ).alias(name)
        for origin, target, name in ROLL_RATES
    ]
    return matrix.groupBy("cohort_month").agg(*rates)


def transition_pivot(matrix: DataFrame) -> DataFrame:
    """Latest month as a from x to table of percentages with two decimals."""
    last = matrix.select(F.max("cohort_month")).scalar()
    states = [*DELINQUENCY_STATES, "UNKNOWN"]
    return (
        matrix.where(F.col("cohort_month") == last)
        .groupBy("from_state")
        .agg(
            *[
                F.round(
                    total(F.when(F.col("to_state") == s, F.col("transition_rate_pct"))), 2
                ).alias(s)
                for s in states
            ]
        )
    )


def delinquency_summary(panel: DataFrame) -> DataFrame:
    """Delinquent balances and rates per period over known, non-terminal rows."""
    state = F.col("delinquency_state")
    sums = (
        panel.where(~state.isin("TERMINAL", "UNKNOWN"))
        .groupBy("reporting_period")
        .agg(
            total("current_upb").alias("total_upb"),
            total("current_upb", state == "DQ30").alias("dq30_upb"),
            total("current_upb", state == "DQ60").alias("dq60_upb"),
            total("current_upb", state.isin("DQ90PLUS", "REO")).alias("dq90plus_upb"),
            F.count(F.lit(1)).alias("loan_count"),
        )
    )

    def rate(balance):
        return 100.0 * ratio(balance, F.col("total_upb"))

    return sums.withColumns(
        {
            "dq30_rate": rate(F.col("dq30_upb")),
            "dq60_rate": rate(F.col("dq60_upb")),
            "dq90plus_rate": rate(F.col("dq90plus_upb")),
            "serious_dq_rate": rate(F.col("dq60_upb") + F.col("dq90plus_upb")),
        }
    )


# --- credit events -----------------------------------------------------------------------


def _latest_row_per_loan(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per loan: the latest period, then the highest code.

    An aggregate rather than a ranking window: partial results are merged before the shuffle,
    so a loan with very many rows does not gather in one task.
    """
    kept = [c for c in columns if c in rows.columns and c != "loan_id"]
    rank = [c for c in ("reporting_period", "zero_balance_code") if c in rows.columns]
    best = F.max_by(F.struct(*kept), F.struct(*rank)).alias("best")
    return rows.groupBy("loan_id").agg(best).select("loan_id", "best.*")


_TERMINATION_COLUMNS = (
    "loan_id zero_balance_date terminal_event_type zero_balance_code origination_year loan_age "
    "fico original_ltv original_cltv dti property_state occupancy loan_purpose "
    "mortgage_insurance_pct current_upb zero_balance_removal_upb actual_loss is_credit_event "
    "is_voluntary_prepayment"
).split()


def terminations(panel: DataFrame) -> DataFrame:
    """One classified terminal row per terminated loan."""
    return _latest_row_per_loan(panel.where(F.col("is_terminal")), _TERMINATION_COLUMNS)


def cdr_monthly(panel: DataFrame, denominator: str = "same") -> DataFrame:
    """Monthly credit-event rate and its annualised CDR.

    ``denominator='same'`` divides by the month's own non-terminal rows, ``'prior'`` by the
    month before's.
    """
    counts = (
        panel.groupBy("reporting_period")
        .agg(
            F.count_if(F.col("delinquency_state") != "TERMINAL").alias("active_loans"),
            F.count_if("is_credit_event").alias("new_credit_events"),
        )
        .where(F.col("active_loans") > 0)
    )
    base = F.col("active_loans")
    if denominator == "prior":
        # One row per calendar month: joined to its neighbour, no ordering needed.
        prior = counts.select(
            F.add_months("reporting_period", 1).alias("reporting_period"),
            F.col("active_loans").alias("prior_active"),
        )
        counts = counts.join(prior, "reporting_period", "left")
        base = F.col("prior_active")
    rate = ratio(F.col("new_credit_events"), base)
    return counts.withColumn("monthly_rate", rate).withColumn(
        "cdr", annualised_pct(F.col("monthly_rate"))
    ).drop("prior_active")


def vintage_credit_curve(panel: DataFrame) -> DataFrame:
    """Cumulative credit events by vintage and age, as a percentage of the vintage's loans."""
    loans = panel.groupBy("origination_year").agg(
        F.countDistinct("loan_id").alias("orig_loan_count")
    )
    events = (
        panel.where(F.col("is_credit_event"))
        .groupBy("origination_year", "loan_age")
        .agg(F.count(F.lit(1)).alias("credit_events"))
    )
    # The window runs over aggregated cells: one row per vintage and month of age.
    upto = (
        Window.partitionBy("origination_year")
        .orderBy("loan_age")
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    return (
        events.withColumn("cumulative_events", F.sum("credit_events").over(upto))
        .join(loans, "origination_year", "left")
        .withColumn(
            "cumulative_credit_event_rate",
            100.0 * ratio(F.col("cumulative_events"), F.col("orig_loan_count")),
        )
    )


# --- severity ----------------------------------------------------------------------------

_SEVERITY_COLUMNS = (
    "loan_id zero_balance_date terminal_event_type zero_balance_code origination_year loan_age "
    "fico original_ltv original_cltv dti property_state occupancy loan_purpose original_upb "
    "mortgage_insurance_pct zero_balance_removal_upb net_sale_proceeds mi_recoveries "
    "non_mi_recoveries expenses delinquent_accrued_interest actual_loss"
).split()


#: The columns of a panel that ``severity_loans`` reads.
SEVERITY_PANEL = (*_SEVERITY_COLUMNS, "reporting_period", "is_credit_event")


def severity_loans(panel: DataFrame) -> DataFrame:
    """Loss severity and recovery rate per credit-event loan; negative severities are kept."""
    events = panel.where(F.col("is_credit_event") & (F.col("zero_balance_removal_upb") > 0))
    removal = F.col("zero_balance_removal_upb")
    recovered = F.coalesce("mi_recoveries", F.lit(0.0)) + F.coalesce(
        "non_mi_recoveries", F.lit(0.0)
    )
    return (
        _latest_row_per_loan(events, _SEVERITY_COLUMNS)
        .withColumn("loss_severity", ratio(F.col("actual_loss"), removal))
        .withColumn("total_recoveries", recovered)
        .withColumn("recovery_rate", ratio(F.col("total_recoveries"), removal))
        .withColumn("over_recovery_flag", F.col("loss_severity") < 0)
    )


def _weighted_severity():
    weight = F.col("zero_balance_removal_upb")
    return ratio(F.sum(F.col("loss_severity") * weight), F.sum(weight))


def severity_summary(severity: DataFrame) -> DataFrame:
    """Count, mean, exact median, weighted mean, recovery and over-recoveries in one row."""
    valid = severity.where(F.col("loss_severity").isNotNull())
    median = exact_quantiles(valid, "loss_severity", [0.5]).select("q0").scalar()
    return valid.agg(
        F.count(F.lit(1)).alias("count"),
        F.avg("loss_severity").alias("mean_severity"),
        _weighted_severity().alias("wa_severity"),
        F.avg("recovery_rate").alias("mean_recovery_rate"),
        F.count_if("over_recovery_flag").alias("over_recovery_count"),
    ).withColumn("median_severity", median)


def severity_by(severity: DataFrame, dimension: str) -> DataFrame:
    """Event count, mean, exact median and weighted severity per value of ``dimension``."""
    if dimension not in severity.columns:
        raise ValueError(f"no column {dimension!r} in the severity rows")
    valid = severity.where(F.col("loss_severity").isNotNull())
    means = valid.groupBy(dimension).agg(
        F.count(F.lit(1)).alias("event_count"),
        F.avg("loss_severity").alias("mean_severity"),
        _weighted_severity().alias("wa_severity"),
    )
    medians = exact_quantiles(valid, "loss_severity", [0.5], by=[dimension])
    same = F.col(f"a.{dimension}").eqNullSafe(F.col(f"b.{dimension}"))
    return means.alias("a").join(medians.alias("b"), same, "left").select(
        "a.*", F.col("b.q0").alias("median_severity")
    )


def severity_histogram(severity: DataFrame, bins: int = 40) -> DataFrame:
    """Equal-width histogram of severity between its smallest and largest value."""
    valid = severity.where(F.col("loss_severity").isNotNull())
    low = valid.select(F.min("loss_severity")).scalar()
    high = valid.select(F.max("loss_severity")).scalar()
    position = F.floor(ratio(F.col("loss_severity") - low, high - low) * bins)
    return (
        valid.groupBy(
            F.coalesce(F.least(position, F.lit(bins - 1)), F.lit(0)).cast("bigint").alias("bin")
        )
        .agg(F.count(F.lit(1)).alias("loans"))
    )


# --- headline ----------------------------------------------------------------------------


def headline(
    cpr: DataFrame, cdr: DataFrame, delinquency: DataFrame, severity: DataFrame
) -> DataFrame:
    """Mean CPR and CDR of the last three months, latest delinquency rates, severity totals.

    The inputs are monthly series, so "the last three" is a top-3 over months.
    """

    def recent(series: DataFrame, value: str):
        last = (
            series.where(F.col(value).isNotNull()).orderBy(F.desc("reporting_period")).limit(3)
        )
        return last.select(F.coalesce(F.avg(value), F.lit(0.0))).scalar()

    newest = F.col("reporting_period")
    return delinquency.agg(
        F.max(newest).alias("latest_period"),
        F.max_by("dq30_rate", newest).alias("latest_dq30_rate"),
        F.max_by("dq90plus_rate", newest).alias("latest_dq90plus_rate"),
    ).withColumns(
        {
            "latest_cpr": recent(cpr, "cpr_wa"),
            "latest_cdr": recent(cdr, "cdr"),
            "severity_count": severity.select("count").scalar(),
            "wa_severity": severity.select("wa_severity").scalar(),
        }
    )
