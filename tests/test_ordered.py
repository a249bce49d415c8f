"""Distributed ordering against plain single-task answers, with hot keys."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from loanweave.operators import ordered as O


@pytest.fixture(scope="module")
def skewed(spark):
    """One key holds a third of all rows."""
    rng = random.Random(3)
    rows = [("hot", i, float(rng.randrange(50))) for i in range(1500)]
    rows += [(f"k{i % 97}", 10_000 + i, float(rng.randrange(50))) for i in range(3000)]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "key string, at bigint, x double").repartition(7)


def test_running_sums_over_everything(skewed):
    got = O.running_sums(skewed, ["at"], {"n": F.lit(1), "s": F.col("x")}).orderBy("at").toPandas()
    assert got["n"].tolist() == list(range(1, len(got) + 1))
    assert np.allclose(got["s"], got["x"].cumsum())


def test_running_sums_within_hot_groups(skewed):
    got = O.running_sums(skewed, ["at"], {"s": F.col("x")}, within=["key"]).toPandas()
    got = got.sort_values(["key", "at"])
    assert np.allclose(got["s"], got.groupby("key")["x"].cumsum())


def test_running_sums_with_null_group_and_ties(spark):
    df = spark.createDataFrame([(None, 1), (None, 1), ("a", 1), (None, 2)], "k string, o int")
    got = O.running_sums(df, ["o"], {"n": F.lit(1)}, within=["k"]).collect()
    assert sorted(r["n"] for r in got if r["k"] is None) == [1, 2, 3]
    assert [r["n"] for r in got if r["k"] == "a"] == [1]


def test_running_sums_of_nothing(spark):
    empty = spark.createDataFrame([], "k string, o int")
    assert O.running_sums(empty, ["o"], {"n": F.lit(1)}).count() == 0


def test_exact_quantiles(skewed):
    frame = skewed.toPandas()
    row = O.exact_quantiles(skewed, "x", [0.0, 0.25, 0.5, 0.9, 1.0]).first()
    expected = [np.quantile(frame["x"], p) for p in (0, 0.25, 0.5, 0.9, 1)]
    assert list(row) == pytest.approx(expected)
    for r in O.exact_quantiles(skewed, "x", [0.5], by=["key"]).collect():
        assert r["q0"] == pytest.approx(frame[frame["key"] == r["key"]]["x"].median())


def test_history_blocks_equal_plain_windows(skewed, monkeypatch):
    """A key too long for one task gives the same lags, leads and frames."""

    def build(w):
        return {
            "before": F.lag("x").over(w),
            "after": F.lead("at").over(w),
            "back": F.sum("x").over(w.rowsBetween(-11, 0)),
            "ahead": F.max("x").over(w.rowsBetween(1, 12)),
            "left": F.count(F.lit(1)).over(w.rowsBetween(1, 12)),
        }

    columns = ["key", "at", "before", "after", "back", "ahead", "left"]
    plain = skewed.withColumns(build(Window.partitionBy("key").orderBy("at"))).select(*columns)
    monkeypatch.setattr(O, "MAX_HISTORY", 100)
    monkeypatch.setattr(O, "BLOCK_ROWS", 64)
    blocked = O.over_history(skewed, "key", "at", build, back=11, ahead=12).select(*columns)
    a = plain.toPandas().sort_values(["key", "at"]).reset_index(drop=True)
    b = blocked.toPandas().sort_values(["key", "at"]).reset_index(drop=True)
    assert a.equals(b)


def test_hot_key_is_spread(skewed, monkeypatch):
    """In the block path no window group is larger than a block and its edges."""
    monkeypatch.setattr(O, "MAX_HISTORY", 100)
    monkeypatch.setattr(O, "BLOCK_ROWS", 64)
    seen = O.over_history(
        skewed, "key", "at",
        lambda w: {"group": F.count(F.lit(1)).over(w.rowsBetween(-10_000, 10_000))},
        back=1, ahead=1,
    )
    assert seen.agg(F.max("group")).first()[0] <= 66


def test_longest_history(skewed):
    assert O.longest_history(skewed, "key") == 1500
