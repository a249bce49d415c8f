"""Silver tables: typed tapes -> one row per loan, one row per loan-month, and their panel."""

from __future__ import annotations

import datetime as dt
import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loanweave.fixed import CREDIT_EVENT_CODES, PREPAYMENT_CODE, SOURCE_COLUMNS, TERMINAL_EVENTS
from loanweave.functions.columns import is_true, parse_month, ratio, yes_flag
from loanweave.operators.ordered import LONG, MAX_HISTORY
from loanweave.storage import WIDE_PROJECTIONS, fresh_path, settings, written


def delinquency_months(status: Column) -> Column:
    """Months past due: 0 for '0'/'00', 99 for 'RA', the number otherwise, null for other text."""
    months = status.try_cast("int").cast("bigint")
    return F.when(status == "RA", F.lit(99).cast("bigint")).otherwise(months)


def delinquency_state(status: Column, zero_code: Column, normalize_codes: bool = False) -> Column:
    """Delinquency bucket, first match wins.

    Only the literal codes '1' and '2' count as 30 and 60 days; '01' and '02' fall through.
    ``normalize_codes`` reads those as 1 and 2 as well.
    """
    months = status.try_cast("int")
    one = months == 1 if normalize_codes else status == "1"
    two = months == 2 if normalize_codes else status == "2"
    return (
        F.when(status.isin("0", "00"), "CURRENT")
        .when(one, "DQ30")
        .when(two, "DQ60")
        .when(months >= 3, "DQ90PLUS")
        .when(status == "RA", "REO")
        .when(zero_code != "", "TERMINAL")
        .otherwise("UNKNOWN")
    )


def build_origination(bronze: DataFrame) -> DataFrame:
    """One row per loan: parsed months, renamed attributes and Y/N flags as booleans."""
    first_payment = parse_month("first_payment_date")
    return bronze.select(
        F.col("loan_sequence_number").alias("loan_id"),
        first_payment.alias("first_payment_date"),
        F.trunc(F.add_months(first_payment, -1), "month").alias("origination_date"),
        parse_month("maturity_date").alias("maturity_date"),
        "original_upb",
        "original_interest_rate",
        "original_loan_term",
        F.col("ltv").alias("original_ltv"),
        F.col("cltv").alias("original_cltv"),
        F.col("credit_score").alias("fico"),
        "dti",
        F.col("mi_pct").alias("mortgage_insurance_pct"),
        "num_units",
        "num_borrowers",
        "loan_purpose",
        F.col("occupancy_status").alias("occupancy"),
        "property_type",
        "property_state",
        "channel",
        "postal_code",
        "msa",
        yes_flag("first_time_homebuyer_flag").alias("first_time_homebuyer"),
        yes_flag("interest_only_indicator").alias("interest_only"),
        yes_flag("super_conforming_flag").alias("super_conforming"),
        yes_flag("prepayment_penalty_flag").alias("prepayment_penalty"),
        "amort_type",
        "program_indicator",
        *[c for c in SOURCE_COLUMNS if c in bronze.columns],
    )


def build_performance(bronze: DataFrame, normalize_codes: bool = False) -> DataFrame:
    """One row per loan-month: normalised delinquency, defaults and numeric proceeds."""
    status = F.col("current_loan_delinquency_status")
    proceeds = F.col("net_sale_proceeds")
    return bronze.select(
        F.col("loan_sequence_number").alias("loan_id"),
        parse_month("monthly_reporting_period").alias("reporting_period"),
        F.col("current_actual_upb").alias("current_upb"),
        F.coalesce("current_deferred_upb", F.lit(0.0)).alias("deferred_upb"),
        F.coalesce("interest_bearing_upb", "current_actual_upb").alias("interest_bearing_upb"),
        "zero_balance_removal_upb",
        "current_interest_rate",
        "loan_age",
        F.col("remaining_months_to_legal_maturity").alias("remaining_term"),
        status.alias("raw_delinquency_status"),
        delinquency_months(status).alias("delinquency_months"),
        delinquency_state(status, F.col("zero_balance_code"), normalize_codes).alias(
            "delinquency_state"
        ),
        yes_flag("modification_flag").alias("modification_flag"),
        yes_flag("step_modification_flag").alias("step_modification_flag"),
        yes_flag("deferred_payment_plan").alias("deferred_payment_plan"),
        "borrower_assistance_status_code",
        "zero_balance_code",
        parse_month("zero_balance_effective_date").alias("zero_balance_date"),
        "estimated_ltv",
        # 'C' means the proceeds covered the debt; it has no amount.
        F.when(proceeds != "C", proceeds.try_cast("double")).alias("net_sale_proceeds"),
        "mi_recoveries",
        "non_mi_recoveries",
        "expenses",
        "legal_costs",
        "maintenance_costs",
        "taxes_insurance",
        "miscellaneous_expenses",
        F.col("actual_loss_calculation").alias("actual_loss"),
        "modification_cost",
        "delinquent_accrued_interest",
        yes_flag("delinquency_due_to_disaster").alias("delinquency_due_to_disaster"),
        *[c for c in SOURCE_COLUMNS if c in bronze.columns],
    )


def terminal_event_type(code: Column) -> Column:
    """Name of the termination; any unlisted non-null code is ``other_terminal``."""
    named = F.when(code.isNull(), F.lit(None).cast("string"))
    for key, name in TERMINAL_EVENTS.items():
        named = named.when(code == key, F.lit(name))
    return named.otherwise(F.lit("other_terminal"))


def event_flags(code: Column, months: Column, state: Column) -> dict[str, Column]:
    """Null-free event flags of a loan-month."""
    return {
        "is_terminal": is_true(code != ""),
        "is_voluntary_prepayment": is_true(code == PREPAYMENT_CODE),
        "is_credit_event": is_true(code.isin(*CREDIT_EVENT_CODES)),
        "is_seriously_delinquent": is_true(
            (F.coalesce(months, F.lit(-1)) >= 3) | state.isin("DQ90PLUS", "REO", "TERMINAL")
        ),
    }


_FROM_ORIGINATION = (
    "origination_date first_payment_date maturity_date original_upb original_interest_rate "
    "original_loan_term original_ltv original_cltv fico dti mortgage_insurance_pct num_units "
    "num_borrowers loan_purpose occupancy property_type property_state channel msa "
    "first_time_homebuyer interest_only super_conforming prepayment_penalty amort_type"
).split()
_FROM_PERFORMANCE = (
    "current_upb deferred_upb interest_bearing_upb current_interest_rate loan_age "
    "remaining_term delinquency_months delinquency_state raw_delinquency_status "
    "modification_flag step_modification_flag deferred_payment_plan "
    "borrower_assistance_status_code estimated_ltv zero_balance_code zero_balance_date "
    "zero_balance_removal_upb net_sale_proceeds mi_recoveries non_mi_recoveries expenses "
    "legal_costs maintenance_costs taxes_insurance miscellaneous_expenses actual_loss "
    "delinquent_accrued_interest delinquency_due_to_disaster"
).split()


def build_panel(performance: DataFrame, origination: DataFrame) -> DataFrame:
    """The loan x month panel: monthly state joined to the loan's static attributes.

    An inner join, so loan-months without an origination row are dropped. No hint is given:
    the optimizer broadcasts the loan table when its size allows and AQE splits skewed keys.
    """
    static = origination.select("loan_id", *_FROM_ORIGINATION)
    monthly = performance.select(
        "loan_id",
        "reporting_period",
        *_FROM_PERFORMANCE,
        *(
            [F.col("_source_vintage").alias("vintage")]
            if "_source_vintage" in performance.columns
            else []
        ),
    )
    joined = monthly.join(static, "loan_id", "inner")
    flags = event_flags(
        F.col("zero_balance_code"), F.col("delinquency_months"), F.col("delinquency_state")
    )
    derived = {
        "origination_year": F.year("origination_date").cast("bigint"),
        "origination_quarter": F.quarter("origination_date").cast("bigint"),
        "reporting_year": F.year("reporting_period").cast("bigint"),
        "reporting_month": F.month("reporting_period").cast("bigint"),
        "upb_ratio": F.when(
            F.col("original_upb") > 0, ratio(F.col("current_upb"), F.col("original_upb"))
        ),
        "terminal_event_type": terminal_event_type(F.col("zero_balance_code")),
        **flags,
    }
    return joined.withColumns(derived)


# --- storing the panel -------------------------------------------------------------------


@dataclass(frozen=True)
class StoredPanel:
    """A written panel and what was measured about it. ``long_rows`` counts the rows of loans longer
    than ``MAX_HISTORY``; if there are any, the table has the column ``LONG``, which marks them."""

    table: DataFrame
    rows: int
    history: int
    buckets: int
    long_rows: int = 0


def _max_buckets(spark: SparkSession) -> int:
    """The session's own limit on buckets of a table."""
    return int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets", "100000"))


def _kept(panel: DataFrame, columns: Sequence[str] | None) -> DataFrame:
    """``columns`` of the panel and those it is stored by; all of them when not given."""
    if columns is None:
        return panel
    needed = {*columns, "loan_id", "reporting_period", "reporting_year"}
    return panel.select(*[c for c in panel.columns if c in needed])


def _store_long(
    performance: DataFrame, origination: DataFrame, ids: DataFrame, name: str, files: int,
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """Write the panel rows of long histories by year in ranges of (loan, period, row), so that one
    loan, or one of its months, fills as many tasks and files as its rows need."""
    spark = performance.sparkSession
    # Written first, so that the join knows how small these few loans' attributes are.
    static = written(origination.join(ids, "loan_id", "left_semi"), f"{name}-static")
    panel = _kept(build_panel(performance.join(ids, "loan_id", "left_semi"), static), columns)
    path = fresh_path(spark, f"{name}-long")
    (
        panel.withColumn("__row", F.monotonically_increasing_id())
        .repartitionByRange(files, "reporting_year", "loan_id", "reporting_period", "__row")
        .drop("__row")
        .write.partitionBy("reporting_year")
        .parquet(path)
    )
    return spark.read.schema(panel.schema).parquet(path)


def store_panel(
    performance: DataFrame, origination: DataFrame, name: str, rows_per_file: int = 500_000,
    placed: int | None = None, columns: Sequence[str] | None = None,
) -> StoredPanel:
    """Build the panel and write it partitioned by year and bucketed by loan.

    As-of queries then read one year, and every per-loan window or aggregate runs without a
    shuffle. The monthly rows are placed by loan once, for the join and the buckets alike, and are
    counted first, which sizes the buckets; a bucket's rows are sorted in its task's memory. Rows
    that come hash-partitioned by ``loan_id`` into ``placed`` tasks are not moved again. Writing all
    columns takes longer than deriving them, so a panel for one use may be stored with its
    ``columns`` only; its rows are the same. A loan longer than ``MAX_HISTORY`` rows would make its
    bucket one task's work: such loans are stored beside the buckets, by period, and marked in the
    column ``LONG``; the other loans stay bucketed, and ``over_history`` reads both.
    """
    spark = performance.sparkSession
    # Rows without a loan, or of none in ``origination``, never reach the panel.
    performance = performance.where(F.col("loan_id").isNotNull())
    known = origination.select("loan_id").distinct()
    # Counted before they meet the loans on file, so that loans are sorted for it and not months.
    counts = (
        performance.groupBy("loan_id").agg(F.count(F.lit(1)).alias("n"))
        .join(known, "loan_id", "left_semi")
    )
    sizes = counts.agg(F.max("n").alias("longest"), F.sum("n").alias("rows")).first()
    rows, history, long_rows, long = int(sizes["rows"] or 0), int(sizes["longest"] or 0), 0, None
    with settings(spark, WIDE_PROJECTIONS):
        if history > MAX_HISTORY:
            ids = written(counts.where(F.col("n") > MAX_HISTORY), f"{name}-ids")
            long_rows = int(ids.agg(F.sum("n")).first()[0])
            files = max(spark.sparkContext.defaultParallelism, math.ceil(long_rows / rows_per_file))
            long = _store_long(performance, origination, ids, name, files, columns)
            performance = performance.join(ids, "loan_id", "left_anti")
        width = spark.sparkContext.defaultParallelism
        wanted = placed or max(width, math.ceil((rows - long_rows) / rows_per_file))
        buckets = min(_max_buckets(spark), wanted)
        if placed is None:
            performance = performance.repartition(buckets, "loan_id")
        (
            _kept(build_panel(performance, origination), columns)
            .write.partitionBy("reporting_year")
            .bucketBy(buckets, "loan_id")
            .sortBy("loan_id", "reporting_period")
            .option("path", fresh_path(spark, name))
            .option("compression", "zstd")
            .saveAsTable(name)
        )
    table = spark.table(name)
    if long is not None:
        table = table.withColumn(LONG, F.lit(False)).unionByName(long.withColumn(LONG, F.lit(True)))
    return StoredPanel(table, rows, history, buckets, long_rows)


# --- slices and summaries ----------------------------------------------------------------


def within_periods(
    panel: DataFrame, start: dt.date | None = None, end: dt.date | None = None
) -> DataFrame:
    """Rows of periods in [start, end], with the same bounds on the partition column if any.

    The bounds on ``reporting_year`` let the scan skip the other years' files.
    """
    rows = panel
    years = "reporting_year" in panel.columns
    if start is not None:
        rows = rows.where(F.col("reporting_period") >= F.lit(start))
        rows = rows.where(F.col("reporting_year") >= start.year) if years else rows
    if end is not None:
        rows = rows.where(F.col("reporting_period") <= F.lit(end))
        rows = rows.where(F.col("reporting_year") <= end.year) if years else rows
    return rows


def latest_period(panel: DataFrame, cutoff: dt.date | None = None, active_only: bool = True):
    """Scalar: the last reporting period, optionally not after ``cutoff``."""
    rows = within_periods(panel, end=cutoff)
    rows = rows.where(~F.col("is_terminal")) if active_only else rows
    return rows.select(F.max("reporting_period")).scalar()


def panel_as_of(
    panel: DataFrame, cutoff: dt.date | None = None, active_only: bool = True
) -> DataFrame:
    """Rows of the latest period not after ``cutoff`` (the latest of all when not given)."""
    period = latest_period(panel, cutoff, active_only)
    rows = panel.where(F.col("reporting_period") == period)
    if "reporting_year" in panel.columns:
        # Same condition on the partition column, so only that year's files are read.
        rows = rows.where(F.col("reporting_year") == F.year(period))
    return rows.where(~F.col("is_terminal")) if active_only else rows


def panel_range(
    panel: DataFrame, start: dt.date, end: dt.date, active_only: bool = False
) -> DataFrame:
    """Rows with a period in [start, end], ordered by loan and period."""
    rows = within_periods(panel, start, end)
    rows = rows.where(~F.col("is_terminal")) if active_only else rows
    return rows.orderBy("loan_id", "reporting_period")


def reporting_periods(panel: DataFrame) -> DataFrame:
    return panel.select("reporting_period").distinct().orderBy("reporting_period")


def vintage_range(panel: DataFrame, default: tuple[int, int] = (2012, 2022)) -> DataFrame:
    """First and last origination year, or ``default`` for a panel without any."""
    return panel.agg(
        F.coalesce(F.min("origination_year"), F.lit(default[0])).cast("bigint").alias("min_vintage"),
        F.coalesce(F.max("origination_year"), F.lit(default[1])).cast("bigint").alias("max_vintage"),
    )


#: The columns of a panel that ``panel_summary`` reads.
SUMMARY_COLUMNS = (
    "loan_id reporting_period origination_year is_voluntary_prepayment is_credit_event "
    "is_seriously_delinquent actual_loss"
).split()


def panel_summary(panel: DataFrame) -> DataFrame:
    """One-row inspection of the panel."""
    return panel.agg(
        F.countDistinct("loan_id").alias("unique_loans"),
        F.count(F.lit(1)).alias("total_rows"),
        F.min("reporting_period").alias("earliest_period"),
        F.max("reporting_period").alias("latest_period"),
        F.min("origination_year").alias("earliest_vintage"),
        F.max("origination_year").alias("latest_vintage"),
        F.count_if("is_voluntary_prepayment").alias("voluntary_prepayments"),
        F.count_if("is_credit_event").alias("credit_events"),
        F.count_if("is_seriously_delinquent").alias("serious_delinquencies"),
        F.round(F.sum("actual_loss"), 0).alias("total_realized_losses"),
    )


def availability(panel: DataFrame, origination: DataFrame) -> DataFrame:
    """Active rows, loans on file and vintage range."""
    loans = origination.agg(F.countDistinct("loan_id")).scalar()
    return panel.agg(
        F.count_if(~F.col("is_terminal")).alias("active_loan_months"),
        F.min("origination_year").alias("min_vintage"),
        F.max("origination_year").alias("max_vintage"),
    ).withColumn("unique_loans", loans)
