"""Boosted models are fitted on all rows of the training vintages."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from loanweave.plans.catalog import models
from loanweave.plans.catalog.base import Context


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


@pytest.mark.parametrize("target", ["credit_event_12m", "prepayment_12m"])
def test_boosted_models_are_fitted_on_all_rows(spark, loans_dir, monkeypatch, target):
    monkeypatch.setattr(models, "_cache", {})
    fits = []
    monkeypatch.setattr(models.M, "fit_gbt", lambda *a, **k: fits.append(a))
    context = Context(spark, loans_dir)
    models._gbt(context, target)
    ((train, validation, named),) = fits
    rows = context.snapshots.where(F.col("origination_year") <= models.TRAIN_END)
    assert train.count() == rows.count() > rows.where(F.col(target) == 1).count()
    assert train.select(rows.columns).exceptAll(rows).count() == 0 and named == target
    assert validation.where(F.col("origination_year") <= models.TRAIN_END).count() == 0
