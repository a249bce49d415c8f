from __future__ import annotations

import datetime as dt
import sys
import tempfile
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "6g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="loanweave-tests-"))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


PANEL_DDL = """
    loan_id string, reporting_period date, origination_date date, fico bigint,
    original_ltv double, original_cltv double, dti double, original_interest_rate double,
    current_interest_rate double, original_upb double, current_upb double, occupancy string,
    loan_purpose string, property_state string, property_type string, origination_year bigint,
    loan_age bigint, remaining_term bigint, original_loan_term bigint,
    delinquency_months bigint, delinquency_state string, is_terminal boolean,
    is_voluntary_prepayment boolean, is_credit_event boolean, is_seriously_delinquent boolean,
    modification_flag boolean, zero_balance_code string, zero_balance_date date,
    zero_balance_removal_upb double, actual_loss double, mi_recoveries double,
    non_mi_recoveries double, mortgage_insurance_pct double, terminal_event_type string,
    reporting_year bigint, reporting_month bigint, estimated_ltv double
"""


def loan_month(loan: str, month: int, **changes) -> dict:
    """One panel row; month 1 is January 2022."""
    year, m = 2022 + (month - 1) // 12, (month - 1) % 12 + 1
    row = {
        "loan_id": loan, "reporting_period": dt.date(year, m, 1),
        "origination_date": dt.date(2021, 12, 1), "fico": 740, "original_ltv": 75.0,
        "original_cltv": 77.0, "dti": 35.0, "original_interest_rate": 4.0,
        "current_interest_rate": 4.0, "original_upb": 200_000.0,
        "current_upb": 200_000.0 - 300.0 * (month - 1), "occupancy": "P", "loan_purpose": "P",
        "property_state": "CA", "property_type": "SF", "origination_year": 2021,
        "loan_age": month, "remaining_term": 360 - month, "original_loan_term": 360,
        "delinquency_months": 0, "delinquency_state": "CURRENT", "is_terminal": False,
        "is_voluntary_prepayment": False, "is_credit_event": False,
        "is_seriously_delinquent": False, "modification_flag": False, "zero_balance_code": None,
        "zero_balance_date": None, "zero_balance_removal_upb": None, "actual_loss": None,
        "mi_recoveries": None, "non_mi_recoveries": None, "mortgage_insurance_pct": None,
        "terminal_event_type": None, "reporting_year": year, "reporting_month": m, "estimated_ltv": 70.0,
    }
    return {**row, **changes}


@pytest.fixture(scope="session")
def frame(spark):
    """Panel frame from row dicts."""

    def make(rows: list[dict]):
        names = [part.split()[0] for part in PANEL_DDL.replace("\n", " ").split(",")]
        return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], PANEL_DDL)

    return make


@pytest.fixture(scope="session")
def small_panel(frame):
    """Three loans over three months; the second prepays in the third."""
    paid = {
        "current_upb": 0.0, "delinquency_state": "TERMINAL", "is_terminal": True,
        "is_voluntary_prepayment": True, "zero_balance_code": "01",
        "zero_balance_removal_upb": 149_800.0, "terminal_event_type": "voluntary_prepayment",
    }
    rows = [loan_month("A1", m) for m in (1, 2, 3)]
    rows += [
        loan_month("B2", m, current_upb=150_000.0 - 200.0 * (m - 1), fico=680,
                   property_state="TX", occupancy="I", loan_purpose="C")
        for m in (1, 2)
    ]
    rows.append(loan_month("B2", 3, fico=680, property_state="TX", **paid))
    rows += [
        loan_month("C3", m, current_upb=300_000.0 - 400.0 * (m - 1), fico=780,
                   property_state="FL")
        for m in (1, 2, 3)
    ]
    return frame(rows)
