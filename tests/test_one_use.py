"""Queries store the panel with the columns they read."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from loanweave.operators import features as X
from loanweave.operators import silver as S
from loanweave.plans import derived
from loanweave.plans.catalog import load, models
from loanweave.plans.catalog.base import Context

WIDEST = 40  # columns of the widest panel for one use; the whole panel has more
QUERIES = (
    "panel_summary recon_counts recon_upb recon_all weighted_average severity_by_vintage "
    "survival_rows survival_credit_rows asof_features snapshot_at"
).split()


@pytest.fixture(scope="module")
def loans_dir(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("orders"))
    rows = [
        (k, dt.date(1994 + k % 8, k % 12 + 1, 1), k % 9, 1000.0 * k + 500.25, "FOP"[k % 3], f"{k % 5 + 1}-X")
        for k in range(1, 121)
    ]
    spark.createDataFrame(
        rows + rows[:5],
        "o_orderkey bigint, o_orderdate date, o_custkey bigint, o_totalprice double, "
        "o_orderstatus string, o_orderpriority string",
    ).write.parquet(f"{folder}/orders.parquet")
    spark.createDataFrame([(i, i % 25) for i in range(9)], "c_custkey bigint, c_nationkey int").write.parquet(
        f"{folder}/customer.parquet"
    )
    return folder


@pytest.mark.parametrize("name", QUERIES)
def test_a_narrow_panel_gives_the_rows_of_the_whole(spark, loans_dir, monkeypatch, name):
    found, widths = [], []
    for whole in (False, True):
        monkeypatch.setattr(derived, "_stored", {})
        if whole:
            derived.panel(spark, loans_dir)
        found.append(sorted(map(repr, load().builds[name](spark, loans_dir).collect())))
        (stored,) = derived._stored.values()  # one panel serves the query
        widths.append(len(stored.table.columns))
    assert found[0] == found[1] != []
    assert widths[0] < WIDEST < widths[1]


def test_scores_and_fits_share_one_panel(spark, loans_dir, monkeypatch):
    monkeypatch.setattr(derived, "_stored", {})
    monkeypatch.setattr(models, "_cache", {})
    context = Context(spark, loans_dir)

    def fits(c):
        assert models._split(c, "train").count() and models._severity_rows(c, False).count()
        return {}

    monkeypatch.setattr(models, "_ridge", lambda c: models.M.Linear(
        "identity", (), (), (), (), (), 0.5, 1.0, 0, 0.0, 0))
    assert models._score_as_of(context, fits).columns == ["loan_id", "loss_severity_score"]
    (stored,) = derived._stored.values()
    assert len(stored.table.columns) < WIDEST


def test_a_wider_panel_serves(spark, loans_dir, monkeypatch):
    monkeypatch.setattr(derived, "_stored", {})
    wide = derived.panel(spark, loans_dir, tuple(X.SNAPSHOT_COLUMNS))
    assert derived.panel(spark, loans_dir, ("current_upb", "reporting_year")) is wide
    assert derived.panel(spark, loans_dir, ("actual_loss",)) is not wide


def test_loans_are_stored_once_and_their_months_counted_before_they_are_joined(spark, loans_dir, monkeypatch):
    calls, plain = [], derived.base
    monkeypatch.setattr(derived, "_bases", {})
    monkeypatch.setattr(derived, "base", lambda *a: calls.append(a) or plain(*a))
    stored = S.store_panel(
        derived.silver_performance(spark, loans_dir), derived.silver_origination(spark, loans_dir),
        "loans_once_panel", placed=derived.tasks(spark, loans_dir), columns=["current_upb"],
    )
    assert len(calls) == 1 and stored.table.count() == stored.rows
    longest = stored.table.groupBy("loan_id").count().agg(F.max("count")).first()[0]
    assert stored.history == longest
