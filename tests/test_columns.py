from __future__ import annotations

import datetime as dt
import hashlib
import math

import pytest
from pyspark.sql import functions as F

from loanweave.fixed import DTI_BANDS, FICO_BANDS, GOLD_LTV
from loanweave.functions import columns as C


def one(spark, rows, ddl, *columns):
    return spark.createDataFrame(rows, ddl).select(*columns).collect()


@pytest.mark.parametrize(
    "rows,expected",
    [
        ([(4.0, 100.0), (6.0, 300.0)], 5.5),
        ([(4.0, 100.0), (None, 300.0)], 4.0),
        ([(4.0, 100.0), (9.0, 0.0)], 4.0),
        ([(4.0, None)], None),
        ([(None, 100.0)], None),
    ],
)
def test_weighted_average(spark, rows, expected):
    df = spark.createDataFrame(rows, "v double, w double")
    assert df.agg(C.weighted_average("v", "w")).first()[0] == expected


def test_share_counts_null_as_false(spark):
    df = spark.createDataFrame([(True, 1.0), (None, 1.0), (False, 2.0)], "p boolean, w double")
    assert df.agg(C.share_pct(F.col("p"), "w")).first()[0] == 25.0


def test_bands_are_half_open(spark):
    values = [(299,), (300,), (619,), (620,), (780,), (850,), (851,), (None,)]
    got = [r[0] for r in one(spark, values, "x bigint", C.band("x", FICO_BANDS))]
    assert got == ["Other", "< 620", "< 620", "620–639", "780+", "780+", "Other", "Other"]
    assert len(DTI_BANDS.edges) == len(DTI_BANDS.labels) + 1


def test_gold_bands_are_right_closed_and_open_ended(spark):
    got = [
        r[0]
        for r in one(spark, [(60.0,), (60.5,), (95.0,), (120.0,), (None,)], "x double",
                     C.open_band("x", *GOLD_LTV, inclusive=True))
    ]
    assert got == ["<= 60%", "60-65%", "90-95%", "95%+", "95%+"]


def test_parse_month_reads_both_orders(spark):
    text = [("202203",), ("032022",), ("121999",), ("BADDAT",), ("132022",), (None,)]
    got = [r[0] for r in one(spark, text, "t string", C.parse_month("t"))]
    assert got == [dt.date(2022, 3, 1), dt.date(2022, 3, 1), dt.date(1999, 12, 1), None, None, None]


def test_scheduled_principal(spark):
    rows = [(200_000.0, 4.0, 360), (200_000.0, 0.0, 360), (None, 4.0, 360), (1000.0, 5.0, 0)]
    got = [
        r[0] for r in one(spark, rows, "u double, r double, n bigint",
                          C.scheduled_principal("u", "r", "n"))
    ]
    r = 4.0 / 1200
    assert got[0] == pytest.approx(200_000 * r / ((1 + r) ** 360 - 1))
    assert got[0] == pytest.approx(290.43, rel=0.01)
    assert got[1:3] == [0.0, 0.0]
    assert got[3] == pytest.approx(1000 * 5 / 1200)


def test_annualised_pct(spark):
    got = one(spark, [(0.005,), (0.0,), (1.0,)], "m double", C.annualised_pct(F.col("m")))
    assert got[0][0] == pytest.approx(5.8377, rel=0.001)
    assert [got[1][0], got[2][0]] == [0.0, 100.0]


def test_hash_bucket_is_plain_md5(spark):
    ids = [f"F{i:09d}" for i in range(200)]
    got = one(spark, [(i,) for i in ids], "id string", C.hash_bucket(100, "id"))
    expected = [int(hashlib.md5(i.encode()).hexdigest()[:8], 16) % 100 for i in ids]
    assert [r[0] for r in got] == expected


def test_region_and_yes_flag(spark):
    got = one(spark, [("CA", "Y"), ("PR", "N"), (None, None)], "s string, f string",
              C.region("s"), C.yes_flag("f"))
    assert [tuple(r) for r in got] == [("West", True), ("Other", False), ("Other", False)]


def test_ratio_by_zero_is_null(spark):
    assert one(spark, [(1.0, 0.0)], "a double, b double", C.ratio(F.col("a"), F.col("b")))[0][0] is None
    assert not math.isnan(0.0)
