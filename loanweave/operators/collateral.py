"""Collateral metrics, stratifications and replines over a snapshot of loans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loanweave.fixed import COUPON_BANDS, FICO_BANDS, LTV_BANDS, STRATIFICATIONS, Bands
from loanweave.functions.columns import band, ratio, region, total

# Weighted averages of the portfolio metrics: output name -> column.
_AVERAGES = {
    "wa_coupon": "current_interest_rate",
    "wa_fico": "fico",
    "wa_ltv": "original_ltv",
    "wa_cltv": "original_cltv",
    "wa_dti": "dti",
    "wala": "loan_age",
    "warm": "remaining_term",
}


def _shares() -> dict[str, tuple[str, Column]]:
    """Balance shares: output name -> (column needed, condition)."""
    c = F.col
    return {
        "purchase_pct": ("loan_purpose", c("loan_purpose") == "P"),
        "refinance_pct": ("loan_purpose", c("loan_purpose").isin("C", "R")),
        "owner_occupied_pct": ("occupancy", c("occupancy") == "P"),
        "investor_pct": ("occupancy", c("occupancy") == "I"),
        "second_home_pct": ("occupancy", c("occupancy") == "S"),
        "mi_share_pct": ("mortgage_insurance_pct", c("mortgage_insurance_pct") > 0),
        "current_pct": ("delinquency_state", c("delinquency_state") == "CURRENT"),
        "dq30_pct": ("delinquency_state", c("delinquency_state") == "DQ30"),
        "dq60_pct": ("delinquency_state", c("delinquency_state") == "DQ60"),
        "dq90plus_pct": ("delinquency_state", c("delinquency_state").isin("DQ90PLUS", "REO")),
        "low_fico_pct": ("fico", c("fico") < 660),
        "high_ltv_pct": ("original_ltv", c("original_ltv") > 80),
        "modified_pct": ("modification_flag", c("modification_flag")),
    }


def portfolio_metrics(loans: DataFrame) -> DataFrame:
    """One row of portfolio metrics; metrics of absent columns are null or zero.

    Sums are taken per state first and then over the states, which yields the largest state and
    all totals from one scan and one small shuffle.
    """
    have = set(loans.columns)
    upb = F.col("current_upb").cast("double")
    averages = {k: v for k, v in _AVERAGES.items() if v in have}
    shares = {k: cond for k, (need, cond) in _shares().items() if need in have}
    state = F.col("property_state") if "property_state" in have else F.lit(None).cast("string")

    sums = [F.count(F.lit(1)).alias("n"), total(upb).alias("upb")]
    for name, column in averages.items():
        usable = F.col(column).isNotNull() & (upb > 0)
        sums.append(F.sum(F.when(usable, F.col(column).cast("double") * upb)).alias(f"{name}_x"))
        sums.append(F.sum(F.when(usable, upb)).alias(f"{name}_w"))
    sums += [total(upb, cond).alias(name) for name, cond in shares.items()]
    by_state = loans.groupBy(state.alias("state")).agg(*sums)

    whole = F.sum("upb")
    top = F.min_by(F.struct("state", "upb"), F.struct(-F.col("upb"), F.col("state")))

    def pct(balance: Column) -> Column:
        return F.coalesce(100.0 * ratio(balance, whole), F.lit(0.0))

    result = [
        F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("loan_count"),
        F.coalesce(whole, F.lit(0.0)).alias("total_current_upb"),
        F.coalesce(ratio(whole, F.sum("n")), F.lit(0.0)).alias("avg_loan_balance"),
        *[
            (
                ratio(F.sum(f"{name}_x"), F.sum(f"{name}_w"))
                if name in averages
                else F.lit(None).cast("double")
            ).alias(name)
            for name in _AVERAGES
        ],
        *[
            (pct(F.sum(name)) if name in shares else F.lit(0.0)).alias(name)
            for name in _shares()
        ],
    ]
    has_state = "property_state" in have
    result += [
        (F.when(whole != 0, top["state"]) if has_state else F.lit(None).cast("string")).alias(
            "largest_state"
        ),
        (pct(top["upb"]) if has_state else F.lit(0.0)).alias("largest_state_pct"),
    ]
    return by_state.agg(*result)


def largest_state(loans: DataFrame, state: str = "property_state") -> DataFrame:
    """The group with the most balance and its share; ties go to the first name."""
    sums = loans.groupBy(F.col(state).alias("state")).agg(total("current_upb").alias("upb"))
    top = F.min_by(F.struct("state", "upb"), F.struct(-F.col("upb"), F.col("state")))
    return sums.agg(top.alias("top"), F.sum("upb").alias("whole")).select(
        F.col("top.state").alias("largest_state"),
        (100.0 * ratio(F.col("top.upb"), F.col("whole"))).alias("largest_state_pct"),
    )


# --- stratification ----------------------------------------------------------------------


def _present_average(value: str, upb: Column) -> Column:
    v = F.col(value).cast("double")
    return ratio(total(v * upb), total(upb, v.isNotNull()))


def _strat_sums(upb: Column) -> list[Column]:
    return [
        F.count(F.lit(1)).alias("loan_count"),
        total(upb).alias("current_upb"),
        ratio(total(F.col("current_interest_rate") * upb), total(upb)).alias("wa_coupon"),
        _present_average("fico", upb).alias("wa_fico"),
        _present_average("original_ltv", upb).alias("wa_ltv"),
        _present_average("dti", upb).alias("wa_dti"),
    ]


def _with_pool_pct(summary: DataFrame, whole: Column, upb: str = "current_upb") -> DataFrame:
    base = F.when(F.coalesce(whole, F.lit(0.0)) == 0, F.lit(1.0)).otherwise(whole)
    return summary.withColumn("pool_pct", F.col(upb) / base * 100.0)


def stratify(loans: DataFrame, label: Column, name: str) -> DataFrame:
    """Loan count, balance, pool share and weighted averages per value of ``label``.

    The pool total is a scalar subquery over one column, not a window, so the number of groups
    does not matter.
    """
    summary = loans.groupBy(label.alias(name)).agg(*_strat_sums(F.col("current_upb")))
    return _with_pool_pct(summary, loans.select(F.sum("current_upb")).scalar())


def stratify_by_band(loans: DataFrame, column: str, bands: Bands, name: str = "band") -> DataFrame:
    return stratify(loans, band(column, bands), name)


def stratify_by_category(loans: DataFrame, column: str) -> DataFrame:
    return stratify(loans, F.col(column), column)


def strat(loans: DataFrame, which: str) -> DataFrame:
    """One of the named stratifications (see ``STRATIFICATIONS``)."""
    column, bands, name = STRATIFICATIONS[which]
    return stratify_by_band(loans, column, bands, name) if bands else stratify_by_category(
        loans, column
    )


def strat_all(loans: DataFrame, which: Sequence[str] = tuple(STRATIFICATIONS)) -> DataFrame:
    """All named stratifications in long form (dimension, label, ...), from one scan."""
    labels = F.array(
        *[
            F.struct(
                F.lit(w).alias("dimension"),
                (
                    band(STRATIFICATIONS[w][0], STRATIFICATIONS[w][1])
                    if STRATIFICATIONS[w][1]
                    else F.col(STRATIFICATIONS[w][0]).cast("string")
                ).alias("label"),
            )
            for w in which
        ]
    )
    rows = loans.select(
        "current_upb", "current_interest_rate", "fico", "original_ltv", "dti",
        F.explode(labels).alias("s"),
    )
    summary = rows.groupBy(
        F.col("s.dimension").alias("dimension"), F.col("s.label").alias("label")
    ).agg(*_strat_sums(F.col("current_upb")))
    return _with_pool_pct(summary, loans.select(F.sum("current_upb")).scalar())


def replines(loans: DataFrame, min_cell_loans: int = 5) -> DataFrame:
    """Collateral cells by FICO, LTV, coupon, vintage and region; small cells are flagged."""
    upb = F.col("current_upb")
    year = (
        F.col("origination_year") if "origination_year" in loans.columns else F.lit(0)
    ).cast("bigint")
    state = region("property_state") if "property_state" in loans.columns else F.lit("Other")
    cells = loans.groupBy(
        band("fico", FICO_BANDS).alias("fico_band"),
        band("original_ltv", LTV_BANDS).alias("ltv_band"),
        band("original_interest_rate", COUPON_BANDS).alias("coupon_band"),
        year.alias("origination_year"),
        state.alias("state_group"),
    ).agg(
        F.count(F.lit(1)).alias("loan_count"),
        total(upb).alias("upb"),
        ratio(total(F.col("current_interest_rate") * upb), total(upb)).alias("wac"),
        _present_average("fico", upb).alias("wa_fico"),
        _present_average("original_ltv", upb).alias("wa_ltv"),
        _present_average("dti", upb).alias("wa_dti"),
        ratio(total(F.col("loan_age") * upb), total(upb)).alias("wala"),
    )
    return _with_pool_pct(cells, loans.select(F.sum("current_upb")).scalar(), "upb").withColumn(
        "small_cell", F.col("loan_count") < min_cell_loans
    )


def fico_ltv_heatmap(loans: DataFrame) -> DataFrame:
    """Loan counts by FICO band (rows) and LTV band (columns), zero where there are none."""
    ltv = band("original_ltv", LTV_BANDS)
    return loans.groupBy(band("fico", FICO_BANDS).alias("fico_band")).agg(
        *[F.count_if(ltv == label).alias(label) for label in (*LTV_BANDS.labels, "Other")]
    )


def universe(
    loans: DataFrame,
    purpose: str | None = None,
    occupancy: str | None = None,
    fico: tuple[float, float] | None = None,
    ltv: tuple[float, float] | None = None,
) -> DataFrame:
    """Loans matching the chosen categories and ranges; loans without a value stay in range."""
    rows = loans
    if purpose is not None:
        rows = rows.where(F.col("loan_purpose") == purpose)
    if occupancy is not None:
        rows = rows.where(F.col("occupancy") == occupancy)
    for column, limits in (("fico", fico), ("original_ltv", ltv)):
        if limits is not None:
            value = F.col(column)
            rows = rows.where(value.isNull() | value.between(*limits))
    return rows
