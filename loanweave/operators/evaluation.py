"""Exact classification and regression metrics, curves and backtests, as Spark aggregates."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loanweave.functions.columns import ratio
from loanweave.operators.ordered import exact_quantiles, running_sums

CLIP = 1e-8


def _weight(weight: str | None) -> Column:
    return F.lit(1.0) if weight is None else F.col(weight).cast("double")


def _labelled(df: DataFrame, target: str, score: str, weight: str | None = None) -> DataFrame:
    """Rows with a label and a score: y, p (clipped away from 0 and 1) and w."""
    return df.where(F.col(target).isNotNull() & F.col(score).isNotNull()).select(
        F.col(target).cast("double").alias("y"),
        F.least(F.greatest(F.col(score).cast("double"), F.lit(CLIP)), F.lit(1 - CLIP)).alias("p"),
        _weight(weight).alias("w"),
    )


def classification_metrics(
    df: DataFrame, target: str, score: str, weight: str | None = None
) -> DataFrame:
    """Weighted Brier score and log loss with row counts."""
    y, p, w = F.col("y"), F.col("p"), F.col("w")
    loss = -(y * F.ln(p) + (1.0 - y) * F.ln(1.0 - p))
    return _labelled(df, target, score, weight).agg(
        F.count(F.lit(1)).alias("n_total"),
        F.sum("y").cast("bigint").alias("n_positive"),
        ratio(F.sum(w * (p - y) * (p - y)), F.sum(w)).alias("brier_score"),
        ratio(F.sum(w * loss), F.sum(w)).alias("log_loss"),
    )


def score_thresholds(
    df: DataFrame, target: str, score: str, weight: str | None = None
) -> DataFrame:
    """One row per distinct score, highest first, with cumulative true and false positives.

    Ties are merged by the aggregate before anything is ordered, so the curve has one point per
    score and its size is the number of distinct scores, not of rows.
    """
    y, w = F.col("y"), F.col("w")
    per_score = (
        _labelled(df, target, score, weight)
        .groupBy("p")
        .agg(F.sum(w * y).alias("pos"), F.sum(w * (1.0 - y)).alias("neg"))
    )
    return running_sums(
        per_score,
        [F.col("p").desc()],
        {"tp": F.col("pos"), "fp": F.col("neg")},
        label="thresholds",
    )


def roc_pr_auc(thresholds: DataFrame) -> DataFrame:
    """Area under the ROC curve (trapezoid) and average precision (steps); null for one class."""
    tp, fp, pos, neg = (F.col(c) for c in ("tp", "fp", "pos", "neg"))
    area = F.sum(neg * (tp + (tp - pos)) / 2.0)
    return thresholds.agg(
        ratio(area, F.sum(pos) * F.sum(neg)).alias("roc_auc"),
        F.when(
            F.sum(neg) > 0, ratio(F.sum(pos * ratio(tp, tp + fp)), F.sum(pos))
        ).alias("pr_auc"),
    )


def curve_points(thresholds: DataFrame) -> DataFrame:
    """ROC and precision-recall points, one per distinct score."""
    positives = thresholds.select(F.sum("pos")).scalar()
    negatives = thresholds.select(F.sum("neg")).scalar()
    tp, fp = F.col("tp"), F.col("fp")
    return thresholds.select(
        F.col("p").alias("threshold"),
        ratio(fp, negatives).alias("false_positive_rate"),
        ratio(tp, positives).alias("true_positive_rate"),
        ratio(tp, tp + fp).alias("precision"),
        ratio(tp, positives).alias("recall"),
    )


def top_decile_capture(df: DataFrame, target: str, score: str) -> DataFrame:
    """Share of events among rows scoring at or above the exact 90th percentile."""
    rows = _labelled(df, target, score)
    cutoff = exact_quantiles(rows, "p", [0.9]).select("q0").scalar()
    return rows.withColumn("cutoff", cutoff).agg(
        F.max("cutoff").alias("cutoff"),
        ratio(F.sum(F.when(F.col("p") >= F.col("cutoff"), F.col("y"))), F.sum("y")).alias(
            "top_decile_capture_rate"
        ),
    )


def top_rows_capture(
    df: DataFrame, target: str, score: str, tiebreak: Sequence[str]
) -> DataFrame:
    """Share of events among the best-scored tenth of the rows (at least one row)."""
    rows = df.where(F.col(target).isNotNull() & F.col(score).isNotNull()).select(
        F.col(target).cast("double").alias("y"), F.col(score).alias("p"), *tiebreak
    )
    ranked = running_sums(
        rows, [F.col("p").desc(), *tiebreak], {"__rank": F.lit(1)}, label="top-rows"
    )
    size = F.greatest(F.floor(ranked.select(F.count(F.lit(1))).scalar() / 10), F.lit(1))
    return ranked.withColumn("__size", size).agg(
        ratio(
            F.sum(F.when(F.col("__rank") <= F.col("__size"), F.col("y"))),
            F.greatest(F.sum("y"), F.lit(1.0)),
        ).alias("top_rows_capture_rate")
    )


def calibration_curve(df: DataFrame, target: str, score: str, bins: int = 10) -> DataFrame:
    """Mean score and event rate per quantile bin of the score; empty bins are left out."""
    rows = df.where(F.col(target).isNotNull() & F.col(score).isNotNull()).select(
        F.col(target).cast("double").alias("y"), F.col(score).cast("double").alias("p")
    )
    inner = [i / bins for i in range(1, bins)]
    edges = exact_quantiles(rows, "p", inner)
    row = edges.select(F.struct(*edges.columns)).scalar()
    # A row belongs to the bin numbered by how many inner edges lie below it.
    below = [F.when(row[name] < F.col("p"), 1).otherwise(0) for name in edges.columns]
    return (
        rows.withColumn("bin", reduce(lambda a, b: a + b, below).cast("bigint"))
        .groupBy("bin")
        .agg(
            F.count(F.lit(1)).alias("observations"),
            F.avg("p").alias("mean_predicted"),
            F.avg("y").alias("fraction_positive"),
        )
    )


def severity_errors(
    df: DataFrame, actual: str, predicted: str, weight: str | None = None
) -> DataFrame:
    """MAE, RMSE, bias (predicted minus actual) and weighted MAE."""
    error = F.col(predicted) - F.col(actual)
    w = _weight(weight)
    return df.where(error.isNotNull()).agg(
        F.count(F.lit(1)).alias("observations"),
        F.avg(F.abs(error)).alias("mae"),
        F.sqrt(F.avg(error * error)).alias("rmse"),
        F.avg(error).alias("prediction_bias"),
        ratio(F.sum(F.abs(error) * w), F.sum(w)).alias("balance_weighted_mae"),
    )


# --- backtests ---------------------------------------------------------------------------


def portfolio_backtest(
    df: DataFrame, target: str, score: str, dimensions: Sequence[str]
) -> DataFrame:
    """Realized and predicted event rates per cohort; absent dimensions are ignored."""
    dims = [c for c in dimensions if c in df.columns]
    if not dims and "scoring_date" in df.columns:
        dims = ["scoring_date"]
    return df.groupBy(*dims).agg(
        F.count(F.lit(1)).alias("observations"),
        F.avg(target).alias("realized_rate"),
        F.avg(score).alias("predicted_rate"),
        (F.avg(score) - F.avg(target)).alias("prediction_bias"),
    )


def backtest_table(scores: DataFrame, target: str, score: str) -> DataFrame:
    """Backtest by scoring date and vintage with balance-weighted rates."""
    upb = F.col("current_upb")
    return scores.groupBy("scoring_date", "origination_year").agg(
        F.count(F.lit(1)).alias("observations"),
        F.sum(upb).alias("current_upb"),
        F.avg(target).alias("realized_rate"),
        F.avg(score).alias("predicted_rate"),
        (F.avg(score) - F.avg(target)).alias("prediction_bias"),
        ratio(F.sum(upb * F.col(target)), F.sum(upb)).alias("balance_weighted_realized_rate"),
        ratio(F.sum(upb * F.col(score)), F.sum(upb)).alias("balance_weighted_predicted_rate"),
    )


def backtest_curve(backtest: DataFrame) -> DataFrame:
    """Balance-weighted realized and predicted rate per date, one row per series."""
    upb = F.col("current_upb")
    wide = backtest.groupBy("scoring_date").agg(
        *[
            ratio(F.sum(F.col(c) * upb), F.sum(upb)).alias(c)
            for c in ("realized_rate", "predicted_rate")
        ]
    )
    return wide.unpivot(["scoring_date"], ["realized_rate", "predicted_rate"], "series", "rate")


def cohort_performance(scores: DataFrame, target: str, score: str) -> DataFrame:
    """Mean realized and predicted rate per vintage."""
    return scores.groupBy("origination_year").agg(
        F.avg(target).alias("realized"), F.avg(score).alias("predicted")
    )


def backtest_listing(backtest: DataFrame, rows: int = 20) -> DataFrame:
    """The first cohorts by date, for display."""
    return backtest.orderBy("scoring_date", "origination_year").limit(rows)
