"""Every named query at the smallest scale: against its SQL twin, or for rows where it has none."""

from __future__ import annotations

import pytest

from __spark_entry__ import SMOKE_DIR, entry, oracle_sql, queries
from tests.compare import connect, difference

BUILDS, SQL = queries(), oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return connect(SMOKE_DIR)


@pytest.mark.parametrize("name", [n for n in BUILDS if n in SQL])
def test_equals_sql(spark, duck, name):
    rows = BUILDS[name](spark, SMOKE_DIR).toPandas()
    assert difference(rows, duck.sql(SQL[name]).df()) is None


@pytest.mark.parametrize("name", [n for n in BUILDS if n not in SQL])
def test_gives_rows(spark, name):
    assert BUILDS[name](spark, SMOKE_DIR).count() > 0


def test_entry(spark):
    frame = entry(spark)
    assert frame.columns[:3] == ["cohort_month", "from_state", "to_state"] and frame.count() > 0


def test_every_sql_has_a_query():
    assert set(SQL) <= set(BUILDS) and len(BUILDS) >= 130
