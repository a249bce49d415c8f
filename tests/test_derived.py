"""The derived loans are placed before they grow, and tapes come in parts."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from loanweave.functions.columns import parse_month
from loanweave.operators import features as X
from loanweave.operators import gold as G
from loanweave.operators import silver as S
from loanweave.plans import derived
from loanweave.plans.catalog import pool, sources
from loanweave.plans.catalog.base import Context


@pytest.fixture(scope="module")
def loans_dir(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("orders"))
    rows = [
        (k, dt.date(1994 + k % 6, k % 12 + 1, 1), k % 9, 1000.0 * k + 500.25, "FOP"[k % 3], f"{k % 5 + 1}-X")
        for k in range(1, 61)
    ]
    orders = spark.createDataFrame(
        rows + rows[:5],
        "o_orderkey bigint, o_orderdate date, o_custkey bigint, o_totalprice double, "
        "o_orderstatus string, o_orderpriority string",
    )
    orders.write.parquet(f"{folder}/orders.parquet")
    spark.createDataFrame([(i, i % 25) for i in range(9)], "c_custkey bigint, c_nationkey int").write.parquet(
        f"{folder}/customer.parquet"
    )
    return folder


def test_months_are_not_shuffled_by_loan(spark, loans_dir):
    months = derived.silver_performance(spark, loans_dir)
    counted = months.groupBy("loan_id").count()
    plan = counted._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(loan_id" not in plan
    assert {r["count"] for r in counted.collect()} <= set(range(1, derived.MAX_AGE + 1))


def test_placed_rows_are_stored_as_others_are(spark, loans_dir):
    months, loans = derived.silver_performance(spark, loans_dir), derived.silver_origination(spark, loans_dir)
    placed = S.store_panel(months, loans, "placed_panel", placed=derived.tasks(spark, loans_dir))
    moved = S.store_panel(months.repartition(3), loans, "moved_panel")
    assert (placed.rows, placed.history) == (moved.rows, moved.history)
    assert placed.table.exceptAll(moved.table).count() == 0
    assert placed.table.count() == placed.rows == moved.table.count()
    # Every bucket was one task's, so that each has one file a year.
    names = [f.rsplit("/", 2)[1:] for f in placed.table.inputFiles()]
    assert len(names) == len({(year, leaf.split("_")[1].split(".")[0]) for year, leaf in names})


def test_tapes_come_in_parts_of_bounded_size(spark, loans_dir, monkeypatch):
    monkeypatch.setattr(sources, "LINES_PER_PART", 5)
    monkeypatch.setattr(sources, "_written", {})
    context = Context(spark, loans_dir)
    root = sources.tapes(context)[1]
    lines = sources.R.tape_lines(spark, root).select("_source_file", F.input_file_name().alias("f"))
    per_file = lines.groupBy("_source_file", "f").count()
    assert per_file.agg(F.max("count")).first()[0] <= 5
    parts = per_file.groupBy("_source_file").agg(F.count(F.lit(1)).alias("parts"), F.sum("count").alias("n"))
    held = {r["source_file"]: (r["row_count"], r["checksum_matches"]) for r in sources._manifest(context).collect()}
    assert held == {r["_source_file"]: (r["n"], True) for r in parts.collect()}
    assert max(r["parts"] for r in parts.collect()) > 1


def test_months_read_without_a_parser_equal_those_read_with_one(spark):
    texts = ["199901", "011999", "199913", "131999", "199900", "210012", "122100", "000000", "010000",
             "19991", "1999012", "199901 ", " 199901", "199901\n", "BADDAT", "", "-19991", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    read = F.when(F.substring("t", 1, 4).between("1900", "2100"), F.try_to_date("t", "yyyyMM")).otherwise(
        F.try_to_date("t", "MMyyyy")
    )
    assert df.where(~read.eqNullSafe(parse_month("t"))).count() == 0
    assert df.where(parse_month("t").isNotNull()).count() >= 4


def test_a_panel_for_one_use_has_its_columns_and_the_same_rows(spark, loans_dir, monkeypatch):
    monkeypatch.setattr(derived, "_stored", {})
    snapshots = Context(spark, loans_dir).snapshots
    rows = sorted(map(repr, snapshots.collect()))
    (narrow,) = derived._stored.values()
    assert set(narrow.table.columns) == {*X.SNAPSHOT_COLUMNS, "reporting_year"}
    lines = G.replines_table(derived.panel(spark, loans_dir, tuple(G.REPLINE_COLUMNS)).table, 1)
    whole = derived.panel(spark, loans_dir)
    assert (whole.rows, whole.history) == (narrow.rows, narrow.history)
    assert narrow.table.exceptAll(whole.table.select(narrow.table.columns)).count() == 0
    assert sorted(map(repr, X.model_snapshots(whole.table, whole.history).collect())) == rows != []
    assert sorted(map(repr, G.replines_table(whole.table, 1).collect())) == sorted(map(repr, lines.collect()))
    # The whole panel serves every use once it is there.
    assert derived.panel(spark, loans_dir, X.SNAPSHOT_COLUMNS) is whole


def test_pools_store_the_columns_they_read(spark, loans_dir, monkeypatch):
    found = []
    for columns in (tuple(pool.P.POOL_COLUMNS), None):
        monkeypatch.setattr(derived, "_stored", {})
        derived.panel(spark, loans_dir, columns)
        context = Context(spark, loans_dir)
        guarded = pool.P.guardrails(pool._ranked(context))
        frames = (pool.P.exclusion_waterfall(pool._latest(context), pool.RULES),
                  pool.portfolio_metrics(guarded), pool.S.pool_base_from_scores(guarded))
        found.append([sorted(map(repr, frame.collect())) for frame in frames])
        (stored,) = derived._stored.values()  # no other panel was stored
        assert (set(stored.table.columns) == set(pool.P.POOL_COLUMNS)) == (columns is not None)
    assert found[0] == found[1] and all(found[0])


def test_long_histories_are_stored_with_the_same_columns(spark, loans_dir, monkeypatch):
    monkeypatch.setattr(S, "MAX_HISTORY", 20)
    months, loans = derived.silver_performance(spark, loans_dir), derived.silver_origination(spark, loans_dir)
    narrow = S.store_panel(months, loans, "narrow_long_panel", columns=["current_upb"])
    assert narrow.long_rows and narrow.table.count() == narrow.rows
    assert set(narrow.table.columns) == {"loan_id", "reporting_period", "current_upb", "reporting_year", S.LONG}


def test_tapes_are_stored_compressed(spark, loans_dir, monkeypatch):
    monkeypatch.setattr(sources, "_written", {})
    context = Context(spark, loans_dir)
    names = [r["f"] for r in sources.R.tape_lines(spark, sources.tapes(context)[1]).select(
        F.input_file_name().alias("f")).distinct().collect()]
    assert names and all(name.endswith(".txt.gz") for name in names)
    assert all(r["checksum_matches"] for r in sources._manifest(context).collect())
