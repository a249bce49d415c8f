"""Data-quality rules with quarantine, and source-to-target reconciliation."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loanweave.functions.columns import ratio
from loanweave.operators.ordered import running_sums
from loanweave.storage import settings, written

# --- predicates --------------------------------------------------------------------------


def not_null(column: str) -> Column:
    return F.col(column).isNotNull()


def in_range(column: str, low: float, high: float) -> Column:
    return F.col(column).isNull() | F.col(column).between(low, high)


def non_negative(column: str) -> Column:
    return F.col(column).isNull() | (F.col(column) >= 0)


def positive(column: str) -> Column:
    return F.col(column).isNull() | (F.col(column) > 0)


@dataclass(frozen=True)
class Rule:
    """A named check; ``passes`` builds the condition that a good row meets.

    A rule on a column that the dataset lacks passes. A rule with ``forbids`` fails every row
    of a dataset which has that column.
    """

    rule_id: str
    dataset: str
    severity: str
    description: str
    column: str
    passes: Callable[[str], Column] | None = None
    forbids: bool = False

    def failed(self, columns: Sequence[str]) -> Column:
        if self.column not in columns:
            return F.lit(False)
        if self.forbids:
            return F.lit(True)
        return ~F.coalesce(self.passes(self.column), F.lit(True))


def _range(low: float, high: float) -> Callable[[str], Column]:
    return lambda column: in_range(column, low, high)


# Rules (fixed values: ids, severities, descriptions and limits).
_O, _P, _M = "loan_origination", "loan_performance", "model_snapshot"
ORIGINATION_RULES = (
    Rule("ORIG_001", _O, "FAIL", "loan_id must not be null", "loan_id", not_null),
    Rule("ORIG_002", _O, "QUARANTINE", "original_upb must be positive", "original_upb", positive),
    Rule("ORIG_003", _O, "WARN", "FICO must be in range 300–850 if present", "fico",
         _range(300, 850)),
    Rule("ORIG_004", _O, "WARN", "LTV must be in range 1–200 if present", "original_ltv",
         _range(1, 200)),
    Rule("ORIG_005", _O, "WARN", "CLTV must be in range 1–200 if present", "original_cltv",
         _range(1, 200)),
    Rule("ORIG_006", _O, "WARN", "DTI must be in range 0–100 if present", "dti", _range(0, 100)),
    Rule("ORIG_007", _O, "WARN", "original_interest_rate must be in range 0.5–20 if present",
         "original_interest_rate", _range(0.5, 20.0)),
    Rule("ORIG_008", _O, "QUARANTINE", "origination_date must not be null", "origination_date",
         not_null),
    Rule("ORIG_009", _O, "WARN", "original_loan_term must be positive if present",
         "original_loan_term", positive),
)
PERFORMANCE_RULES = (
    Rule("PERF_001", _P, "FAIL", "loan_id must not be null", "loan_id", not_null),
    Rule("PERF_002", _P, "FAIL", "reporting_period must not be null", "reporting_period",
         not_null),
    Rule("PERF_003", _P, "QUARANTINE", "current_upb must be >= 0", "current_upb", non_negative),
    Rule("PERF_004", _P, "WARN", "loan_age must be >= 0 if present", "loan_age", non_negative),
    Rule("PERF_005", _P, "WARN", "current_interest_rate must be in range 0–20 if present",
         "current_interest_rate", _range(0, 20)),
    Rule("PERF_006", _P, "WARN", "delinquency_months must be 0–99 if present",
         "delinquency_months", _range(0, 99)),
    Rule("PERF_007", _P, "WARN",
         "loss_severity components should be non-negative if present", "actual_loss",
         lambda column: F.coalesce(F.col(column).try_cast("double") >= 0, F.lit(True))),
)
LEAKAGE_RULES = tuple(
    Rule(rule_id, _M, "FAIL", f"{column} must not appear as a feature column", column,
         forbids=True)
    for rule_id, column in (
        ("LEAK_001", "zero_balance_code"),
        ("LEAK_002", "actual_loss"),
        ("LEAK_003", "net_sale_proceeds"),
    )
)
ALL_RULES = ORIGINATION_RULES + PERFORMANCE_RULES + LEAKAGE_RULES


# --- validation --------------------------------------------------------------------------


def validate(df: DataFrame, rules: Sequence[Rule], run_id: str | None = None) -> DataFrame:
    """One result row per rule, all rules counted in a single pass over every row."""
    counted = df.agg(
        F.count(F.lit(1)).alias("rows_checked"),
        *[F.count_if(rule.failed(df.columns)).alias(rule.rule_id) for rule in rules],
    )
    outcomes = F.array(
        *[
            F.struct(
                F.lit(rule.dataset).alias("dataset"),
                F.lit(rule.rule_id).alias("rule_id"),
                F.lit(rule.description).alias("description"),
                F.lit(rule.severity).alias("severity"),
                F.col(rule.rule_id).alias("rows_failed"),
            )
            for rule in rules
        ]
    )
    run = F.expr("uuid()") if run_id is None else F.lit(run_id)
    stamped = counted.select(
        run.alias("run_id"),
        F.current_timestamp().alias("timestamp"),
        "rows_checked",
        F.explode(outcomes).alias("o"),
    )
    return stamped.select(
        "run_id",
        "o.dataset",
        "o.rule_id",
        "o.description",
        "o.severity",
        "rows_checked",
        "o.rows_failed",
        F.coalesce(ratio(F.col("o.rows_failed"), F.col("rows_checked")), F.lit(0.0)).alias(
            "failure_rate"
        ),
        F.when(F.col("o.rows_failed") == 0, F.lit("PASS"))
        .otherwise(F.col("o.severity"))
        .alias("status"),
        "timestamp",
    )


def quarantine(df: DataFrame, rules: Sequence[Rule], run_id: str = "") -> DataFrame:
    """One record per failing row and FAIL or QUARANTINE rule.

    ``row_index`` numbers a rule's failing rows by loan, period and source. The numbering is a
    distributed running count, since one bad load may fail a large part of the table.
    """
    held = [r for r in rules if r.severity in ("FAIL", "QUARANTINE")]

    def text(column: str) -> Column:
        have = column in df.columns
        return F.col(column).cast("string") if have else F.lit(None).cast("string")

    marks = F.array_compact(
        F.array(
            *[
                F.when(
                    rule.failed(df.columns),
                    F.struct(
                        F.lit(rule.dataset).alias("dataset"),
                        F.lit(rule.rule_id).alias("rule_id"),
                        F.lit(rule.description).alias("reason"),
                    ),
                )
                for rule in held
            ]
        )
    )
    records = df.select(
        F.explode(marks).alias("m"),
        text("loan_id").alias("loan_id"),
        text("reporting_period").alias("reporting_period"),
        text("_source_file").alias("source_file"),
    ).select("m.*", "loan_id", "reporting_period", "source_file")
    numbered = running_sums(
        records,
        ["loan_id", "reporting_period", "source_file"],
        {"__n": F.lit(1)},
        within=["rule_id"],
        label="quarantine",
    )
    return numbered.select(
        F.lit(run_id).alias("run_id"),
        "dataset",
        "rule_id",
        "reason",
        (F.col("__n") - 1).alias("row_index"),
        "loan_id",
        "reporting_period",
        "source_file",
        F.current_timestamp().alias("timestamp"),
    )


def persist_validation(
    results: DataFrame,
    quarantined: DataFrame,
    results_table: str,
    quarantine_table: str,
    replace: bool = False,
) -> None:
    """Append rule results and quarantine records to their audit tables, one partition per run.

    With ``replace``, a run that the tables already hold is replaced, so that a repeated run
    leaves its rows once; other runs stay. An empty run id is read back as null.
    """
    spark = results.sparkSession
    if replace:
        results = written(results, "audit")
    for rows, table in ((results, results_table), (quarantined, quarantine_table)):
        if replace and spark.catalog.tableExists(table):
            # Only the partitions of the runs written are overwritten, when the job commits.
            with settings(spark, {"spark.sql.sources.partitionOverwriteMode": "dynamic"}):
                rows.select(*spark.table(table).columns).write.mode("overwrite").insertInto(table)
        else:
            rows.write.mode("append").partitionBy("run_id").saveAsTable(table)
    if replace:
        _drop_stale(results, quarantined, quarantine_table)


def _drop_stale(results: DataFrame, quarantined: DataFrame, table: str) -> None:
    """Drop the partitions of runs that were repeated and now hold no record at all."""
    repeated = results.select("run_id").distinct()  # a row per rule before, so a few runs
    empty = repeated.join(quarantined.select("run_id").distinct(), "run_id", "left_anti")
    for (run,) in empty.where("run_id <> ''").collect():
        value = run.replace("\\", "\\\\").replace("'", "\\'")
        results.sparkSession.sql(f"ALTER TABLE {table} DROP IF EXISTS PARTITION (run_id = '{value}')")


def status_rollup(results: DataFrame) -> DataFrame:
    """Rules per status, and whether the gate is open (no FAIL)."""
    return results.agg(
        F.count(F.lit(1)).alias("total_rules"),
        *[
            F.count_if(F.col("status") == s).alias(s.lower())
            for s in ("PASS", "WARN", "FAIL", "QUARANTINE")
        ],
        F.coalesce(~F.bool_or(F.col("status") == "FAIL"), F.lit(True)).alias("gate_open"),
    )


# --- reconciliation ----------------------------------------------------------------------


def _distinct_loans(df: DataFrame) -> Column:
    return df.select(F.countDistinct("loan_id")).scalar()


def _check(
    frame: DataFrame, name: str, source: Column, target: Column, difference: Column,
    reduced: Column, passed: Callable[[Column], Column], note: str,
) -> DataFrame:
    """A result row; the percentage compares ``source`` with ``reduced``."""
    off = F.coalesce(100.0 * ratio(F.abs(source - reduced), source), F.lit(0.0))
    return frame.select(
        F.lit(name).alias("check_name"),
        source.cast("bigint").alias("source_count"),
        target.cast("bigint").alias("target_count"),
        difference.cast("bigint").alias("difference"),
        off.alias("pct_difference"),
        F.when(passed(off), "PASS").otherwise("WARN").alias("status"),
        F.lit(note).alias("note"),
    )


def _counts_check(counts: DataFrame) -> DataFrame:
    """From ``a`` loans on file and ``b`` loans in the panel."""
    a, b = F.col("a"), F.col("b")
    return _check(
        counts, "origination_vs_panel_unique_loans", a, b, a - b, b, lambda off: off < 1.0,
        "Loans without monthly rows do not reach the panel",
    )


def _orphans_check(counts: DataFrame) -> DataFrame:
    """From ``a`` loans with monthly rows, ``b`` of which are not on file."""
    a, b = F.col("a"), F.col("b")
    return _check(
        counts, "performance_orphan_loan_ids", a, b, b, a - b, lambda off: b == 0,
        "Monthly rows whose loan is not on file",
    )


def _upb_check(totals: DataFrame) -> DataFrame:
    """From the balances ``x`` of the monthly rows and ``y`` of the panel."""
    whole = totals.select(
        F.col("x").cast("bigint").alias("a"),
        F.col("y").cast("bigint").alias("b"),
        (F.col("x") - F.col("y")).cast("bigint").alias("d"),
    )
    a, b = F.col("a"), F.col("b")
    return _check(
        whole, "performance_vs_panel_total_upb", a, b, F.col("d"), b, lambda off: off < 0.1,
        "The panel carries the whole balance of the monthly rows",
    )


def reconcile_counts(origination: DataFrame, panel: DataFrame) -> DataFrame:
    """Distinct loans on file against distinct loans in the panel."""
    on_file = origination.agg(F.countDistinct("loan_id").alias("a"))
    return _counts_check(on_file.withColumn("b", _distinct_loans(panel)))


def reconcile_orphans(performance: DataFrame, origination: DataFrame) -> DataFrame:
    """Loans with performance rows but no origination row."""
    orphans = performance.join(origination.select("loan_id"), "loan_id", "left_anti")
    # A null id never matches and is not a countable loan.
    reporting = performance.agg(F.countDistinct("loan_id").alias("a"))
    return _orphans_check(reporting.withColumn("b", _distinct_loans(orphans)))


def reconcile_upb(performance: DataFrame, panel: DataFrame) -> DataFrame:
    """Total balance of the performance rows against the panel's."""
    reported = performance.agg(F.coalesce(F.sum("current_upb"), F.lit(0.0)).alias("x"))
    return _upb_check(reported.withColumn(
        "y", panel.select(F.coalesce(F.sum("current_upb"), F.lit(0.0))).scalar()
    ))


def reconciliation_figures(
    origination: DataFrame, performance: DataFrame, panel: DataFrame
) -> DataFrame:
    """One row with all figures of the checks, each input read once.

    The three inputs are stacked with only their loan and balance, summed up per loan, then in all.
    Rows of a loan are merged before the shuffle, so a loan (or a null id) of any share is one row
    per task. Null ids are not loans; their balances count.
    """
    def side(df: DataFrame, name: str, upb: Column) -> DataFrame:
        return df.select(
            "loan_id",
            *[F.lit(name == n).alias(n) for n in ("filed", "reporting", "held")],
            *[(upb if name == n else F.lit(None)).cast("double").alias(f"{n}_upb")
              for n in ("reporting", "held")],
        )

    stacked = (
        side(origination, "filed", F.lit(None))
        .unionByName(side(performance, "reporting", F.col("current_upb")))
        .unionByName(side(panel, "held", F.col("current_upb")))
    )
    loans = stacked.groupBy("loan_id").agg(
        *[F.bool_or(c).alias(c) for c in ("filed", "reporting", "held")],
        *[F.sum(c).alias(c) for c in ("reporting_upb", "held_upb")],
    )
    known, filed = F.col("loan_id").isNotNull(), F.col("filed")
    return loans.agg(
        F.count_if(known & filed).alias("filed_loans"),
        F.count_if(known & F.col("held")).alias("held_loans"),
        F.count_if(known & F.col("reporting")).alias("reporting_loans"),
        F.count_if(known & F.col("reporting") & ~filed).alias("orphan_loans"),
        *[F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in ("reporting_upb", "held_upb")],
    )


def reconcile_all(
    origination: DataFrame, performance: DataFrame, panel: DataFrame
) -> DataFrame:
    """All reconciliation checks as one table, from one merge of the inputs.

    If that fails to plan or run, the checks run one by one, and each that fails is a FAIL row.
    """
    try:
        figures = written(
            reconciliation_figures(origination, performance, panel), "reconciliation"
        )
    except Exception:  # noqa: BLE001 - which check it concerns is found below
        return _one_by_one(origination, performance, panel)
    parts = [
        (_counts_check, {"a": "filed_loans", "b": "held_loans"}),
        (_orphans_check, {"a": "reporting_loans", "b": "orphan_loans"}),
        (_upb_check, {"x": "reporting_upb", "y": "held_upb"}),
    ]
    checks = [
        check(figures.select(*[F.col(c).alias(n) for n, c in names.items()]))
        for check, names in parts
    ]
    return checks[0].unionByName(checks[1]).unionByName(checks[2])


def _one_by_one(origination: DataFrame, performance: DataFrame, panel: DataFrame) -> DataFrame:
    """The checks evaluated apart; a check that fails to plan or run is a FAIL row."""
    checks = {
        "origination_vs_panel_unique_loans": lambda: reconcile_counts(origination, panel),
        "performance_orphan_loan_ids": lambda: reconcile_orphans(performance, origination),
        "performance_vs_panel_total_upb": lambda: reconcile_upb(performance, panel),
    }
    spark = panel.sparkSession
    rows = []
    for name, build in checks.items():
        try:
            rows.append(written(build(), "reconciliation"))  # one row, evaluated here
        except Exception as error:  # noqa: BLE001 - any error becomes a FAIL row
            rows.append(
                spark.range(1).select(
                    F.lit(name).alias("check_name"),
                    *[
                        F.lit(0).cast("bigint").alias(c)
                        for c in ("source_count", "target_count", "difference")
                    ],
                    F.lit(0.0).alias("pct_difference"),
                    F.lit("FAIL").alias("status"),
                    F.lit(str(error)).alias("note"),
                )
            )
    union = rows[0]
    for row in rows[1:]:
        union = union.unionByName(row)
    return union
