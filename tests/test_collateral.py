from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from loanweave.fixed import STRATIFICATIONS
from loanweave.operators import collateral as C

LOANS = [
    (200e3, 4.0, 720, 75.0, 78.0, 35.0, 12, 348, "P", "P", "CA", None, "CURRENT", False, "SF", 2020, 4.0),
    (150e3, 3.5, 740, 70.0, 72.0, 30.0, 24, 336, "R", "P", "TX", None, "CURRENT", False, "SF", 2020, 3.5),
    (300e3, 4.5, 680, 80.0, 83.0, 40.0, 6, 354, "P", "I", "FL", 0.5, "DQ30", False, "CO", 2021, 4.5),
    (250e3, 5.0, 760, 65.0, 67.0, 28.0, 36, 324, "C", "P", "CA", None, "CURRENT", True, "SF", 2021, 5.0),
]
DDL = """current_upb double, current_interest_rate double, fico bigint, original_ltv double,
    original_cltv double, dti double, loan_age bigint, remaining_term bigint,
    loan_purpose string, occupancy string, property_state string,
    mortgage_insurance_pct double, delinquency_state string, modification_flag boolean,
    property_type string, origination_year bigint, original_interest_rate double"""


@pytest.fixture(scope="module")
def loans(spark):
    return spark.createDataFrame(LOANS, DDL)


def test_metrics(loans):
    m = C.portfolio_metrics(loans).first()
    assert (m["loan_count"], m["total_current_upb"], m["avg_loan_balance"]) == (4, 900e3, 225e3)
    upb = [200, 150, 300, 250]
    fico = [720, 740, 680, 760]
    assert m["wa_fico"] == pytest.approx(sum(a * b for a, b in zip(upb, fico, strict=True)) / 900)
    assert m["investor_pct"] == pytest.approx(300 / 9)
    assert m["purchase_pct"] == pytest.approx(500 / 9)
    assert m["dq30_pct"] == pytest.approx(300 / 9)
    assert m["mi_share_pct"] == pytest.approx(300 / 9)
    assert m["modified_pct"] == pytest.approx(250 / 9)
    assert (m["largest_state"], m["largest_state_pct"]) == ("CA", 50.0)
    assert C.largest_state(loans).first()["largest_state"] == "CA"


def test_metrics_of_nothing_and_of_few_columns(loans):
    m = C.portfolio_metrics(loans.where("false")).first()
    assert (m["loan_count"], m["total_current_upb"], m["wa_fico"]) == (0, 0.0, None)
    assert m["investor_pct"] == 0.0 and m["largest_state"] is None
    m = C.portfolio_metrics(loans.select("current_upb")).first()
    assert (m["loan_count"], m["wa_fico"], m["low_fico_pct"]) == (4, None, 0.0)


@pytest.mark.parametrize("which", list(STRATIFICATIONS))
def test_strats_add_up(loans, which):
    rows = C.strat(loans, which)
    total = rows.agg(F.sum("pool_pct"), F.sum("loan_count")).first()
    assert total[0] == pytest.approx(100.0) and total[1] == 4


def test_strat_all_matches_single_strats(loans):
    long = C.strat_all(loans).toPandas()
    assert set(long["dimension"]) == set(STRATIFICATIONS)
    single = C.strat(loans, "fico").toPandas().set_index("fico_band")["current_upb"]
    part = long[long["dimension"] == "fico"].set_index("label")["current_upb"]
    assert single.to_dict() == part.to_dict()


def test_replines_flag_small_cells(loans):
    rows = C.replines(loans, min_cell_loans=2).collect()
    assert sum(r["loan_count"] for r in rows) == 4 and all(r["small_cell"] for r in rows)
    assert sum(r["pool_pct"] for r in rows) == pytest.approx(100.0)


def test_heatmap_and_universe(loans):
    rows = C.fico_ltv_heatmap(loans).collect()
    assert sum(v for r in rows for k, v in r.asDict().items() if k != "fico_band") == 4
    assert C.universe(loans, purpose="P").count() == 2
    assert C.universe(loans, occupancy="P", fico=(700, 750)).count() == 2
    with_null = loans.withColumn("fico", F.lit(None).cast("bigint"))
    assert C.universe(with_null, fico=(700, 750), ltv=(70, 100)).count() == 3
