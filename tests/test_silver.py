from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from loanweave.operators import features as X
from loanweave.operators import gold as G
from loanweave.operators import ordered
from loanweave.operators import performance as P
from loanweave.operators import silver as S


def test_delinquency_codes(spark):
    rows = [("0", None), ("00", None), ("1", None), ("2", None), ("3", None), ("12", None),
            ("RA", None), ("01", None), ("01", "01"), ("XX", None), (None, "09")]
    df = spark.createDataFrame(rows, "s string, z string")
    got = [tuple(r) for r in df.select(
        S.delinquency_months(F.col("s")), S.delinquency_state(F.col("s"), F.col("z"))).collect()]
    assert got == [(0, "CURRENT"), (0, "CURRENT"), (1, "DQ30"), (2, "DQ60"), (3, "DQ90PLUS"),
                   (12, "DQ90PLUS"), (99, "REO"), (1, "UNKNOWN"), (1, "TERMINAL"),
                   (None, "UNKNOWN"), (None, "TERMINAL")]
    fixed = df.select(S.delinquency_state(F.col("s"), F.col("z"), normalize_codes=True)).collect()
    assert fixed[7][0] == "DQ30"


def test_terminal_types_and_flags(spark):
    codes = ["01", "02", "03", "06", "09", "15", "16", "96", "", None]
    df = spark.createDataFrame([(c,) for c in codes], "z string")
    flags = S.event_flags(F.col("z"), F.lit(None).cast("bigint"), F.lit("CURRENT"))
    got = df.select(S.terminal_event_type(F.col("z")), *flags.values()).collect()
    assert [r[0] for r in got] == [
        "voluntary_prepayment", "third_party_sale", "short_sale", "repurchase", "reo_disposition",
        "note_sale", "reperforming_sale", "other_terminal", "other_terminal", None]
    assert [r[1] for r in got] == [True] * 8 + [False, False]
    assert [r[2] for r in got] == [True] + [False] * 9
    assert [r[3] for r in got] == [False, True, True, False, True, True, False, False, False, False]


def test_panel_as_of_takes_latest_period_not_after_cutoff(small_panel):
    rows = S.panel_as_of(small_panel, dt.date(2022, 2, 20)).collect()
    assert {r["reporting_period"] for r in rows} == {dt.date(2022, 2, 1)} and len(rows) == 3
    latest = S.panel_as_of(small_panel)
    assert {r["loan_id"] for r in latest.collect()} == {"A1", "C3"}
    assert S.panel_as_of(small_panel, active_only=False).count() == 3
    assert S.panel_as_of(small_panel, dt.date(2020, 1, 1)).count() == 0


def test_slices(small_panel):
    got = S.panel_range(small_panel, dt.date(2022, 1, 1), dt.date(2022, 2, 1)).collect()
    assert [r["loan_id"] for r in got] == ["A1", "A1", "B2", "B2", "C3", "C3"]
    assert S.reporting_periods(small_panel).count() == 3
    assert tuple(S.vintage_range(small_panel).first()) == (2021, 2021)
    assert tuple(S.vintage_range(small_panel.where("false")).first()) == (2012, 2022)
    assert S.panel_summary(small_panel).first()["voluntary_prepayments"] == 1


def _performance(spark, months: int):
    rows = [("hot", dt.date(1900 + i // 12, i % 12 + 1, 1), i) for i in range(months)]
    rows += [("cold", dt.date(2000, 1, 1), 1), ("orphan", dt.date(2000, 1, 1), 1)]
    base = spark.createDataFrame(rows, "loan_id string, reporting_period date, loan_age bigint")
    strings = ("delinquency_state", "raw_delinquency_status", "borrower_assistance_status_code",
               "zero_balance_code")
    extra = {
        c: F.lit(None).cast("string" if c in strings else "double")
        for c in S._FROM_PERFORMANCE if c not in ("loan_age",)
    }
    extra |= {c: F.lit(False) for c in ("modification_flag", "step_modification_flag",
                                        "deferred_payment_plan", "delinquency_due_to_disaster")}
    extra["current_upb"] = F.lit(100.0)
    extra["zero_balance_date"] = F.lit(None).cast("date")
    extra["delinquency_state"] = F.when(F.col("loan_age") % 5 == 0, "DQ30").otherwise("CURRENT")
    return base.withColumns(extra)


def _origination(spark):
    base = spark.createDataFrame([("hot",), ("cold",), ("unused",)], "loan_id string")
    extra = {c: F.lit(None).cast("double") for c in S._FROM_ORIGINATION}
    extra["origination_date"] = F.lit(dt.date(1899, 12, 1))
    return base.withColumns(extra)


def test_store_panel_buckets_bounded_histories(spark):
    stored = S.store_panel(_performance(spark, 300), _origination(spark), "bounded_panel")
    assert (stored.rows, stored.history) == (301, 300) and stored.buckets
    assert stored.table.count() == 301  # the orphan month is dropped
    plan = P.transition_matrix(stored.table, stored.history)._jdf.queryExecution().toString()
    scan = plan[plan.index("Physical Plan"):]
    # The loan window needs no shuffle of the bucketed table.
    assert "hashpartitioning(loan_id" not in scan


def _half_in_one_loan(spark):
    """300 months of one loan and of twelve others together; every seventh month has two rows."""
    rows = [("hot", 1900 + i // 12, i % 12 + 1, i) for i in range(300)]
    rows += [(f"cold{k}", 1918 + i // 12, i % 12 + 1, i) for k in range(12) for i in range(25)]
    rows = [(k, dt.date(y, m, 1), i, 100_000.0 - 100 * i - 7 * twice)
            for k, y, m, i in rows for twice in range(1 + (i % 7 == 3))]
    base = spark.createDataFrame(
        rows, "loan_id string, reporting_period date, loan_age bigint, current_upb double")
    model = _performance(spark, 1)
    late = F.when(F.col("loan_age") % 5 == 0, 1).otherwise(0).cast("bigint")
    extra = {f.name: F.lit(None).cast(f.dataType) for f in model.schema if f.name not in base.columns}
    return base.withColumns(extra).withColumns({
        "current_interest_rate": F.lit(4.0), "remaining_term": (400 - F.col("loan_age")).cast("bigint"),
        "delinquency_months": late, "modification_flag": F.col("loan_age") % 11 == 0,
        "delinquency_state": F.when(late == 1, "DQ30").otherwise("CURRENT"),
        "zero_balance_code": F.when(F.col("loan_age") == 24, "01"),
    })


def _described(spark):
    """Origination of those loans with the attributes that features code."""
    ids = [("hot",), *[(f"cold{k}",) for k in range(12)]]
    base = spark.createDataFrame(ids, "loan_id string")
    text = {"loan_purpose": "P", "occupancy": "P", "property_type": "SF", "property_state": "CA",
            "channel": "R"}
    extra = {c: F.lit(text.get(c)) if c in text else F.lit(700.0) for c in S._FROM_ORIGINATION}
    return base.withColumns(extra | {"origination_date": F.lit(dt.date(1899, 12, 1))})


AT = dt.date(1919, 6, 1)
PER_LOAN = {
    "smm": lambda t, n: P.compute_smm(t, n),
    "transition_matrix": lambda t, n: P.transition_matrix(t, n),
    "cpr_history": lambda t, n: G.cpr_history(t, n),
    "roll_rates_by_vintage": lambda t, n: G.roll_rates_by_vintage(t, n),
    "delinquency_history": lambda t, n: X.delinquency_history(t, AT, history=n),
    "snapshot_at": lambda t, n: X.snapshot_at(t, AT, history=n),
    "model_snapshots": lambda t, n: X.model_snapshots(t, n),
    "asof_features": lambda t, n: X.asof_features(t, AT, n),
}


def test_one_loan_with_half_of_the_rows_changes_no_result(spark, monkeypatch):
    """It is stored beside the buckets; the others stay bucketed and need no shuffle."""
    performance, origination = _half_in_one_loan(spark), _described(spark)
    plain = S.store_panel(performance, origination, "plain_panel")
    rows = {k: sorted(map(repr, q(plain.table, plain.history).collect())) for k, q in PER_LOAN.items()}
    assert all(rows.values())
    for module in (S, ordered):
        monkeypatch.setattr(module, "MAX_HISTORY", 50)
    monkeypatch.setattr(ordered, "BLOCK_ROWS", 16)
    stored = S.store_panel(performance, origination, "hot_panel", rows_per_file=50)
    assert (stored.rows, stored.history, stored.long_rows) == (plain.rows, 343, 343)
    assert stored.table.drop(ordered.LONG).exceptAll(plain.table).count() == 0
    marked = stored.table.where(F.col(ordered.LONG))
    assert {r[0] for r in marked.select("loan_id").distinct().collect()} == {"hot"}
    assert marked.count() == 343 and len(marked.inputFiles()) > 7  # many ranges of one loan
    for name, query in PER_LOAN.items():
        got = query(stored.table, stored.history)
        assert ordered.LONG not in got.columns
        assert sorted(map(repr, got.collect())) == rows[name], name
    short = stored.table.where(~F.col(ordered.LONG))
    plan = P.transition_matrix(short.drop(ordered.LONG), 50)._jdf.queryExecution().toString()
    assert "hashpartitioning(loan_id" not in plan[plan.index("Physical Plan"):]


@pytest.mark.parametrize("column", [None, ordered.LONG])
def test_only_long_histories_are_cut(spark, monkeypatch, column):
    """With or without the mark, and for a null key, too."""
    rows = [(k, i // 2, float(i * 7 % 5)) for k, n in (("a", 90), (None, 70), ("b", 30)) for i in range(n)]
    df = spark.createDataFrame(rows, "k string, at int, x double")
    build = lambda w: {"sum": F.sum("x").over(w.rowsBetween(-3, 2)), "last": F.lag("x").over(w)}
    want = sorted(map(repr, ordered.over_history(df, "k", "at", build, 3, 2).collect()))
    monkeypatch.setattr(ordered, "MAX_HISTORY", 50)
    monkeypatch.setattr(ordered, "BLOCK_ROWS", 8)
    marked = df.withColumn(column, ~F.col("k").eqNullSafe("b")) if column else df
    got = ordered.over_history(marked, "k", "at", build, 3, 2)
    assert got.columns == ["k", "at", "x", "sum", "last"]
    assert sorted(map(repr, got.collect())) == want


def test_ids_that_never_reach_the_panel_do_not_shape_it(spark, monkeypatch):
    """Half of the rows under no id or one that is not on file: still bucketed, not counted."""
    monkeypatch.setattr(S, "MAX_HISTORY", 310)
    good = _performance(spark, 300)
    for junk in (None, "junk"):
        rows = good.unionByName(
            good.crossJoin(spark.range(2)).drop("id").withColumn("loan_id", F.lit(junk).cast("string"))
        )
        stored = S.store_panel(rows, _origination(spark), f"junk_panel_{junk or 'null'}".lower())
        assert (stored.rows, stored.history) == (301, 300) and stored.buckets
        assert stored.table.count() == 301


@pytest.mark.parametrize("column", ["loan_id", "reporting_period"])
def test_panel_has_keys(small_panel, column):
    assert small_panel.where(F.col(column).isNull()).count() == 0
