"""Evaluation queries on a fixed score, and model-fitting queries.

The metric queries score with a plain formula, so their results do not depend on any fitted
model. Linear fits have SQL twins that find the same optimum; boosted trees have none.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanweave.operators import evaluation as E
from loanweave.operators import features as X
from loanweave.operators import models as M
from loanweave.operators.performance import SEVERITY_PANEL
from loanweave.plans.catalog.base import CUTOFF, TRAIN_END, VALIDATION_END, Catalog, Context
from loanweave.plans.catalog import fits
from loanweave.plans.catalog.features import ASOF_ROWS, SNAPSHOTS
from loanweave.plans.catalog.performance import SEVERITY
from loanweave.storage import written

# Fixed scores as SQL, the same text in both engines. Rounding makes ties, which the curves must
# merge; the odd factor keeps their averages off the half-way points of the published digits.
CREDIT = (
    "99999e-5 * round(1e0 / (1e0 + exp(0e0 - ((700e0 - coalesce(fico, 700)) / 60e0 - 45e-1 "
    "+ (original_ltv - 80e0) / 25e0 + 9e-1 * coalesce(delinquency_months, 0)))), 6)"
)
PREPAY = (
    "99999e-5 * round(1e0 / (1e0 + exp(0e0 - ((coalesce(fico, 700) - 720e0) / 90e0 - 18e-1 "
    "+ (current_interest_rate - 5e0) / 3e0))), 6)"
)
LOSS = "99999e-5 * round(5e-2 + 4e-3 * (original_ltv - 45e0), 6)"
TARGET, SCORE = "credit_event_12m", "credit_event_score"
# The columns of a panel that the survival tables read.
SURVIVAL_PANEL = (
    "loan_id", "origination_year", *M.SURVIVAL_FEATURES, "loan_age", "is_credit_event",
    "is_voluntary_prepayment",
)

SCORED = f"""
  {SNAPSHOTS},
  scored AS (SELECT *, {CREDIT} AS credit_event_score, {PREPAY} AS prepayment_score FROM snaps),
  pw AS (SELECT CAST(credit_event_12m AS DOUBLE) AS y,
    least(greatest(credit_event_score, 1e-8), 1 - 1e-8) AS p, current_upb AS w FROM scored)
"""
CURVE = f"""
  {SCORED},
  steps AS (
    SELECT p, pos, neg, sum(pos) OVER o AS tp, sum(neg) OVER o AS fp FROM (
      SELECT p, sum(w * y) AS pos, sum(w * (1 - y)) AS neg FROM pw GROUP BY p)
    WINDOW o AS (ORDER BY p DESC)
  )
"""
DRY = """
  dry AS (SELECT loan_id, zero_balance_date, terminal_event_type, zero_balance_code,
      origination_year, loan_age, fico, original_ltv, original_cltv, dti, property_state,
      occupancy, loan_purpose, original_upb, mortgage_insurance_pct, zero_balance_removal_upb,
      loss_severity FROM sev WHERE loss_severity >= 0 AND loss_severity <= 1.5)
"""


def scored(c: Context) -> DataFrame:
    return c.snapshots.withColumns(
        {"credit_event_score": F.expr(CREDIT), "prepayment_score": F.expr(PREPAY)}
    )


def _thresholds(c: Context) -> DataFrame:
    return E.score_thresholds(scored(c), TARGET, SCORE, "current_upb")


def _backtest(target: str, score: str) -> str:
    def weighted(x: str) -> str:
        return f"sum(current_upb * {x}) / nullif(sum(current_upb), 0)"

    return f"""SELECT scoring_date, origination_year, count(*) AS observations,
        sum(current_upb) AS current_upb, avg({target}) AS realized_rate,
        avg({score}) AS predicted_rate, avg({score}) - avg({target}) AS prediction_bias,
        {weighted(target)} AS balance_weighted_realized_rate,
        {weighted(score)} AS balance_weighted_predicted_rate
      FROM scored GROUP BY ALL"""


BACKTEST_FLOATS = (
    "current_upb realized_rate predicted_rate prediction_bias balance_weighted_realized_rate "
    "balance_weighted_predicted_rate"
)

# --- fitted models, once per session and directory -----------------------------------------

_cache: dict[tuple, object] = {}


def _once(c: Context, name: str, build):
    key = (c.spark.sparkContext.applicationId, c.sf_dir, name)
    if key not in _cache:
        _cache[key] = build()
    return _cache[key]


def _split(c: Context, which: str) -> DataFrame:
    """Stored snapshots of one split, since a fit passes over its rows many times."""
    table = _once(c, "snapshots", lambda: written(c.snapshots, "snapshots"))
    return X.temporal_split(table, TRAIN_END, VALIDATION_END).where(F.col("split") == which).drop(
        "split"
    )


def _full(c: Context, target: str):
    return _once(
        c, f"full {target}", lambda: M.fit_logistic_full(_split(c, "train"), target)
    )


def _gbt(c: Context, target: str):
    """Boosted trees on all rows of the training vintages."""
    return _once(
        c, f"gbt {target}",
        lambda: M.fit_gbt(_split(c, "train"), _split(c, "validation"), target),
    )


def _severity_rows(c: Context, test: bool) -> DataFrame:
    rows = _once(
        c, "severity", lambda: written(M.severity_training(c.panel_of(SEVERITY_PANEL).table), "severity")
    )
    year = F.col("origination_year")
    return rows.where(year > VALIDATION_END) if test else rows.where(year <= VALIDATION_END)


def _ridge(c: Context):
    return _once(c, "ridge", lambda: M.fit_severity_ridge(_severity_rows(c, False)))


def _survived(c: Context, event: str) -> DataFrame:
    return M.survival_table(c.panel_of(SURVIVAL_PANEL).table, event)


def _survival(c: Context, event: str, test: bool) -> DataFrame:
    rows = _once(c, f"survival {event}", lambda: written(_survived(c, event), "survival"))
    year = F.col("origination_year")
    return rows.where(year > VALIDATION_END) if test else rows.where(year <= VALIDATION_END)


def _aft(c: Context, event: str):
    return _once(c, f"aft {event}", lambda: M.fit_aft(_survival(c, event, False)))


def _aft_row(c: Context, event: str, name: str) -> DataFrame:
    return M.aft_metrics(
        _aft(c, event), _survival(c, event, False), _survival(c, event, True), name
    )


def _metrics(c: Context, model, name: str, target: str, fill: float | None) -> DataFrame:
    rows = written(M.score(model, _split(c, "test"), "probability_of_event", fill=fill), "scored")
    return M.metric_row(rows, name, target, "probability_of_event")


def _linear(c: Context) -> dict:
    return {
        "credit_event_score": (_full(c, "credit_event_12m"), M.MODEL_FEATURES, 0.0),
        "prepayment_score": (_full(c, "prepayment_12m"), M.MODEL_FEATURES, 0.0),
    }


def _models(c: Context) -> dict:
    challenger = (_gbt(c, "credit_event_12m"), M.MODEL_FEATURES, 0.0)
    return {**_linear(c), "credit_event_gbt_score": challenger}


def _score_as_of(c: Context, models: Callable[[Context], dict]) -> DataFrame:
    # One panel for the scored rows and for the fits of all models.
    stored = c.panel_of(tuple(dict.fromkeys((*X.ASOF_COLUMNS, *X.SNAPSHOT_COLUMNS, *SEVERITY_PANEL))))
    rows, fitted = X.asof_features(stored.table, CUTOFF, stored.history), models(c)
    for name, (model, features, fill) in fitted.items():
        rows = M.score(model, rows, name, features, fill)
    return M.predict_severity(_ridge(c), rows).select("loan_id", *fitted, "loss_severity_score")


# --- SQL twins of the linear fits ----------------------------------------------------------


def _logistic_sql(name: str, target: str, end: int) -> fits.Fit:
    return fits.Fit(
        name, "snaps", M.MODEL_FEATURES, target, one="(ones + zeros) / (2e0 * ones)",
        zero="(ones + zeros) / (2e0 * zeros)", where=f"{target} IS NOT NULL AND origination_year <= {end}",
    )


def _full_sql(name: str, target: str) -> fits.Fit:
    return fits.Fit(
        name, "snaps", M.MODEL_FEATURES, target, fill="0e0", one="zeros / CAST(ones AS DOUBLE)",
        ridge="1e-5 * (one * ones + zero * zeros)",
        where=f"{target} IS NOT NULL AND origination_year <= {TRAIN_END}",
    )


RIDGE_FIT = fits.Fit("ridge", "dry", M.SEVERITY_FEATURES, "loss_severity", "identity",
                     where=f"origination_year <= {VALIDATION_END}")


def _survival_sql(event: str) -> str:
    """Survival rows of all loans."""
    static = ", ".join(["loan_id", "origination_year", *M.SURVIVAL_FEATURES])
    return f"""SELECT {static}, ifnull(e, last_age) AS time_lower, if(e IS NULL, 0, 1) AS event_observed,
        CAST(ifnull(e, 1e9) AS DOUBLE) AS time_upper
      FROM (SELECT DISTINCT {static} FROM panel)
      JOIN (SELECT loan_id, max(loan_age) AS last_age, min(loan_age) FILTER (WHERE {event}) AS e
        FROM panel GROUP BY 1) USING (loan_id)"""


def _aft_sql(name: str) -> fits.Fit:
    return fits.Fit(
        name, f"{name}_rows", M.SURVIVAL_FEATURES, "ln(time_lower)", "weibull", ridge="1e-6 * n",
        seen="event_observed", where=f"time_lower > 0 AND origination_year <= {VALIDATION_END}",
    )


def _aft_ctes(name: str, event: str) -> str:
    return f"{name}_rows AS MATERIALIZED ({_survival_sql(event)}), {_aft_sql(name).ctes()}"


def _clipped(fit: fits.Fit, target: str, where: str, weight: str = "current_upb", rows: str = "snaps") -> str:
    return f"""clipped AS MATERIALIZED (SELECT CAST({target} AS DOUBLE) AS y, {weight} AS w,
      least(greatest({fit.score()}, 1e-8), 1 - 1e-8) AS p FROM {rows}, {fit.name}_model
      WHERE {target} IS NOT NULL AND {where})"""


def _severity_metrics(name: str) -> str:
    return f"""SELECT '{name}' AS model_name, count(*) AS observations, avg(abs(e)) AS mae,
        sqrt(avg(e * e)) AS rmse, avg(e) AS prediction_bias, sum(abs(e) * w) / sum(w) AS balance_weighted_mae
      FROM (SELECT least(greatest({RIDGE_FIT.score()}, 0), {M.MAX_SEVERITY}) - loss_severity AS e,
          zero_balance_removal_upb AS w FROM dry, ridge_model WHERE origination_year > {VALIDATION_END})"""


def _aft_metrics(name: str, label: str) -> str:
    late = f"{name}_rows WHERE origination_year > {VALIDATION_END}"
    early = f"{name}_rows WHERE origination_year <= {VALIDATION_END}"
    return f"""SELECT '{label}' AS model_name, (SELECT count(*) FROM {early}) AS train_loans, count(*) AS test_loans,
        (SELECT sum(event_observed) FROM {early}) AS train_events, sum(event_observed) AS test_events,
        median(t) FILTER (WHERE event_observed = 1) AS median_predicted_time_event,
        median(t) FILTER (WHERE event_observed = 0) AS median_predicted_time_censored
      FROM (SELECT event_observed, {_aft_sql(name).score()} AS t FROM {name}_rows, {name}_model
        WHERE origination_year > {VALIDATION_END})"""


def _balance(c: Context, target: str) -> DataFrame:
    """Rows and events of the logistic fit, and whether weighted expected events meet the events."""
    train = _split(c, "train").where(F.col(target).isNotNull())
    model = _once(c, "logistic", lambda: M.fit_logistic(_split(c, "train"), target))
    rows = M.score(model, train, "p").groupBy().agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col(target).cast("bigint")).alias("e"),
        F.avg(F.when(F.col(target) == 1, 1 - F.col("p"))).alias("short"),
        F.avg(F.when(F.col(target) != 1, F.col("p"))).alias("over"),
    )
    # Each class weighs one half in all: the mean shortfall of events is the mean excess of others.
    return rows.select(
        F.col("n").alias("observations"), F.col("e").alias("events"),
        (F.abs(F.col("short") - F.col("over")) < 1e-3).alias("balanced"),
    )


def register(catalog: Catalog) -> None:
    add = catalog.add
    add(
        "classification_metrics",
        lambda c: E.classification_metrics(scored(c), TARGET, SCORE, "current_upb"),
        """SELECT count(*) AS n_total, CAST(sum(y) AS BIGINT) AS n_positive,
             sum(w * (p - y) ** 2) / sum(w) AS brier_score,
             sum(-w * ln(if(y = 1, p, 1 - p))) / sum(w) AS log_loss FROM pw""",
        "brier_score log_loss",
        SCORED,
    )
    add(
        "roc_pr_auc",
        lambda c: E.roc_pr_auc(_thresholds(c)),
        """SELECT sum(neg * (tp - pos / 2)) / (sum(pos) * sum(neg)) AS roc_auc,
             sum(pos * tp / (tp + fp)) / sum(pos) AS pr_auc FROM steps""",
        "roc_auc pr_auc",
        CURVE,
    )
    add(
        "roc_curve_points",
        lambda c: E.curve_points(_thresholds(c)),
        """SELECT p AS threshold, fp / n AS false_positive_rate, tp / m AS true_positive_rate,
             tp / (tp + fp) AS precision, tp / m AS recall
           FROM steps, (SELECT sum(pos) AS m, sum(neg) AS n FROM steps)""",
        "threshold false_positive_rate true_positive_rate precision recall",
        CURVE,
    )
    add(
        "top_decile_capture",
        lambda c: E.top_decile_capture(scored(c), TARGET, SCORE),
        """SELECT max(q) AS cutoff, sum(y) FILTER (WHERE p >= q) / sum(y) AS top_decile_capture_rate
           FROM pw, (SELECT quantile_cont(p, 0.9) AS q FROM pw)""",
        "cutoff top_decile_capture_rate",
        SCORED,
    )
    add(
        "top_rows_capture",
        lambda c: E.top_rows_capture(scored(c), TARGET, SCORE, ["loan_id", "scoring_date"]),
        """SELECT sum(y) FILTER (WHERE i <= greatest(n // 10, 1)) / greatest(sum(y), 1)
             AS top_rows_capture_rate FROM (
             SELECT CAST(credit_event_12m AS DOUBLE) AS y, count(*) OVER () AS n, row_number() OVER
               (ORDER BY credit_event_score DESC, loan_id, scoring_date) AS i FROM scored)""",
        "top_rows_capture_rate",
        SCORED,
    )
    cuts = ", ".join(str(i / 10) for i in range(1, 10))
    add(
        "calibration_curve",
        lambda c: E.calibration_curve(scored(c), TARGET, SCORE),
        f"""SELECT len(list_filter(qs, lambda q: q < credit_event_score)) AS bin,
              count(*) AS observations, avg(credit_event_score) AS mean_predicted,
              avg(credit_event_12m) AS fraction_positive
            FROM scored, (SELECT quantile_cont(credit_event_score, [{cuts}]) AS qs FROM scored)
            GROUP BY 1""",
        "mean_predicted fraction_positive",
        SCORED,
    )
    add(
        "portfolio_backtest",
        lambda c: E.portfolio_backtest(scored(c), TARGET, SCORE, ["scoring_date", "absent"]),
        """SELECT scoring_date, count(*) AS observations, avg(credit_event_12m) AS realized_rate,
             avg(credit_event_score) AS predicted_rate,
             avg(credit_event_score) - avg(credit_event_12m) AS prediction_bias
           FROM scored GROUP BY 1""",
        "realized_rate predicted_rate prediction_bias",
        SCORED,
    )
    for name, target, score in (
        ("backtest_credit", "credit_event_12m", "credit_event_score"),
        ("backtest_prepay", "prepayment_12m", "prepayment_score"),
    ):
        add(name, lambda c, t=target, s=score: E.backtest_table(scored(c), t, s),
            _backtest(target, score), BACKTEST_FLOATS, SCORED)
    add(
        "backtest_listing",
        lambda c: E.backtest_listing(E.backtest_table(scored(c), TARGET, SCORE)),
        f"SELECT * FROM ({_backtest(TARGET, SCORE)}) ORDER BY scoring_date, origination_year LIMIT 20",
        BACKTEST_FLOATS,
        SCORED,
    )
    add(
        "backtest_curve",
        lambda c: E.backtest_curve(E.backtest_table(scored(c), TARGET, SCORE)),
        f"""UNPIVOT (SELECT scoring_date,
              sum(realized_rate * current_upb) / sum(current_upb) AS realized_rate,
              sum(predicted_rate * current_upb) / sum(current_upb) AS predicted_rate
            FROM ({_backtest(TARGET, SCORE)}) GROUP BY 1)
            ON realized_rate, predicted_rate INTO NAME series VALUE rate""",
        "rate",
        SCORED,
    )
    add(
        "cohort_performance",
        lambda c: E.cohort_performance(scored(c), TARGET, SCORE),
        "SELECT origination_year, avg(credit_event_12m) AS realized, "
        "avg(credit_event_score) AS predicted FROM scored GROUP BY 1",
        "realized predicted",
        SCORED,
    )
    add(
        "severity_training",
        lambda c: M.severity_training(c.panel_of(SEVERITY_PANEL).table),
        "SELECT * FROM dry",
        "original_ltv original_cltv dti original_upb mortgage_insurance_pct "
        "zero_balance_removal_upb loss_severity",
        f"{SEVERITY}, {DRY}",
    )
    add(
        "severity_errors",
        lambda c: E.severity_errors(
            M.severity_training(c.panel_of(SEVERITY_PANEL).table).withColumn("guess", F.expr(LOSS)),
            "loss_severity", "guess", "zero_balance_removal_upb",
        ),
        f"""SELECT count(*) AS observations, avg(abs(e)) AS mae, sqrt(avg(e * e)) AS rmse,
              avg(e) AS prediction_bias, sum(abs(e) * w) / sum(w) AS balance_weighted_mae
            FROM (SELECT {LOSS} - loss_severity AS e, zero_balance_removal_upb AS w FROM dry)""",
        "mae rmse prediction_bias balance_weighted_mae",
        f"{SEVERITY}, {DRY}",
    )
    survival = "fico original_ltv dti property_state delinquency_state current_upb".split()
    add(
        "survival_rows",
        lambda c: M.survival_rows(
            c.panel_of(("loan_id", "reporting_period", "is_credit_event", "loan_age", *survival)).table,
            "is_credit_event",
        ).select(
            "loan_id", "event_occurred", "time_lower", "time_upper", *survival
        ),
        f"""SELECT loan_id, bool_or(is_credit_event) AS event_occurred,
              arg_max(loan_age, reporting_period) AS time_lower,
              if(bool_or(is_credit_event), arg_max(loan_age, reporting_period), -1e0) AS time_upper,
              {', '.join(f'arg_max_null({c}, reporting_period) AS {c}' for c in survival)}
            FROM panel GROUP BY 1""",
        "time_upper original_ltv dti current_upb",
    )
    static = (
        "loan_id, origination_year, fico, original_ltv, original_cltv, dti, original_upb, "
        "original_interest_rate, mortgage_insurance_pct"
    )
    for name, event in (
        ("survival_credit_rows", "is_credit_event"),
        ("survival_prepay_rows", "is_voluntary_prepayment"),
    ):
        add(
            name,
            lambda c, event=event: _survived(c, event),
            f"""SELECT {static}, ifnull(e, last_age) AS time_lower, ifnull(e, 1e9) AS time_upper,
                  if(e IS NULL, 0, 1) AS event_observed
                FROM (SELECT DISTINCT {static} FROM panel)
                JOIN (SELECT loan_id, max(loan_age) AS last_age,
                  min(loan_age) FILTER (WHERE {event}) AS e FROM panel GROUP BY 1)
                USING (loan_id)""",
            "original_ltv original_cltv dti original_upb original_interest_rate "
            "mortgage_insurance_pct time_upper",
        )

    # Fitted models.
    credit, prepay = "credit_event_12m", "prepayment_12m"
    late = f"origination_year > {VALIDATION_END}"
    one = _logistic_sql("lg", credit, TRAIN_END)
    full, full_prepay = _full_sql("fc", credit), _full_sql("fp", prepay)
    add(
        "fit_logistic",
        lambda c: _metrics(
            c, _once(c, "logistic", lambda: M.fit_logistic(_split(c, "train"), credit)),
            "logistic", credit, None,
        ),
        fits.metrics("clipped", "logistic", credit), fits.METRIC_FLOATS,
        f"{SNAPSHOTS}, {one.ctes()}, {_clipped(one, credit, late)}", recursive=True,
    )
    add(
        "fit_logistic_full",
        lambda c: _metrics(c, _full(c, credit), "full_logistic", credit, 0.0),
        fits.metrics("clipped", "full_logistic", credit), fits.METRIC_FLOATS,
        f"{SNAPSHOTS}, {full.ctes()}, {_clipped(full, credit, late)}", recursive=True,
    )
    add(
        "fit_logistic_full_prepay",
        lambda c: _metrics(c, _full(c, prepay), "full_logistic", prepay, 0.0),
        fits.metrics("clipped", "full_logistic", prepay), fits.METRIC_FLOATS,
        f"{SNAPSHOTS}, {full_prepay.ctes()}, {_clipped(full_prepay, prepay, late)}", recursive=True,
    )
    # Coefficients, and whether the gradient of the penalised loss is zero at them.
    add(
        "logistic_terms",
        lambda c: _once(c, "logistic", lambda: M.fit_logistic(_split(c, "train"), credit)).table(c.spark),
        fits.terms(one), fits.TERM_FLOATS, f"{SNAPSHOTS}, {one.ctes()}", recursive=True,
    )
    add(
        "logistic_full_terms",
        lambda c: _full(c, credit).table(c.spark),
        fits.terms(full), fits.TERM_FLOATS, f"{SNAPSHOTS}, {full.ctes()}", recursive=True,
    )
    add(
        "severity_ridge_terms",
        lambda c: _ridge(c).table(c.spark),
        fits.terms(RIDGE_FIT), fits.TERM_FLOATS, f"{SEVERITY}, {DRY}, {RIDGE_FIT.ctes()}", recursive=True,
    )
    for name, event in (("credit", "is_credit_event"), ("prepay", "is_voluntary_prepayment")):
        add(
            f"aft_{name}_terms",
            lambda c, event=event: _aft(c, event).table(c.spark),
            fits.terms(_aft_sql("aft")), fits.TERM_FLOATS, _aft_ctes("aft", event), recursive=True,
        )
    add("fit_gbt", lambda c: _metrics(
        c, _gbt(c, credit), "gbt_challenger", credit, 0.0
    ).withColumn("trees", F.lit(M.tree_count(_gbt(c, credit)))))
    add("feature_importance", lambda c: M.feature_importance(_gbt(c, credit), credit))
    add(
        "model_comparison",
        lambda c: M.run_record(
            M.model_comparison(
                _metrics(c, _full(c, credit), "full_logistic", credit, 0.0),
                _metrics(c, _gbt(c, credit), "gbt_challenger", credit, 0.0),
                _metrics(c, _full(c, prepay), "full_logistic", prepay, 0.0),
            ),
            f"-{TRAIN_END}", f"{TRAIN_END + 1}-{VALIDATION_END}", f"{VALIDATION_END + 1}-",
            len(M.MODEL_FEATURES),
        ).drop("logged_at"),
    )
    add(
        "fit_severity_ridge",
        lambda c: M.severity_metrics(_ridge(c), _severity_rows(c, True), "ridge_conditional_severity"),
        _severity_metrics("ridge_conditional_severity"),
        "mae rmse prediction_bias balance_weighted_mae",
        f"{SEVERITY}, {DRY}, {RIDGE_FIT.ctes()}", recursive=True,
    )
    add("fit_severity_gbt", lambda c: M.severity_metrics(
        _once(c, "severity gbt", lambda: M.fit_severity_gbt(
            _severity_rows(c, False).where(F.col("origination_year") <= TRAIN_END),
            _severity_rows(c, False).where(F.col("origination_year") > TRAIN_END),
        )),
        _severity_rows(c, True), "gbt_conditional_severity"))
    for name, event in (("credit", "is_credit_event"), ("prepay", "is_voluntary_prepayment")):
        add(
            f"fit_aft_{name}",
            lambda c, event=event: M.predict_survival(_aft(c, event), _survival(c, event, True)),
            f"""SELECT {static}, time_lower, time_upper, event_observed, {_aft_sql("aft").score()} AS predicted_time
                FROM aft_rows, aft_model WHERE {late}""",
            "original_ltv original_cltv dti original_upb original_interest_rate "
            "mortgage_insurance_pct time_upper predicted_time",
            _aft_ctes("aft", event), recursive=True,
        )
    add(
        "aft_metrics",
        lambda c: _aft_row(c, "is_credit_event", "aft_credit").unionByName(
            _aft_row(c, "is_voluntary_prepayment", "aft_prepayment")),
        f"{_aft_metrics('ac', 'aft_credit')} UNION ALL {_aft_metrics('ap', 'aft_prepayment')}",
        "median_predicted_time_event median_predicted_time_censored",
        f"{_aft_ctes('ac', 'is_credit_event')}, {_aft_ctes('ap', 'is_voluntary_prepayment')}",
        recursive=True,
    )
    # Composed jobs. Of boosted scores SQL states the rows and that they are in range.

    def cohorts(fit: fits.Fit, where: str, columns: str = "") -> str:
        return f"""SELECT {columns} scoring_date, origination_year, count(*) AS observations,
            avg(CAST({credit} AS DOUBLE)) AS realized_rate, avg({fit.score()}) AS predicted_rate,
            avg({fit.score()}) - avg(CAST({credit} AS DOUBLE)) AS prediction_bias
          FROM snaps, {fit.name}_model WHERE {credit} IS NOT NULL AND {where} GROUP BY ALL"""

    rates = "realized_rate predicted_rate prediction_bias"
    add(
        "baseline_backtest",
        lambda c: M.baseline_job(
            _once(c, "snapshots", lambda: written(c.snapshots, "snapshots")), credit, TRAIN_END,
            VALIDATION_END,
        )[2],
        cohorts(one, late), rates, f"{SNAPSHOTS}, {one.ctes()}", recursive=True,
    )
    splits = (TRAIN_END, TRAIN_END + 1)
    by_year = {year: _logistic_sql(f"lg{year}", credit, year) for year in splits}
    add(
        "split_backtest",
        lambda c: M.split_backtest(
            _once(c, "snapshots", lambda: written(c.snapshots, "snapshots")), credit, splits
        ),
        " UNION ALL ".join(
            cohorts(fit, f"origination_year > {year}", f"{year} AS split_year,") for year, fit in by_year.items()
        ),
        rates, f"{SNAPSHOTS}, {', '.join(fit.ctes() for fit in by_year.values())}", recursive=True,
    )
    add(
        "logistic_balance",
        lambda c: _balance(c, credit),
        f"""SELECT count(*) AS observations, CAST(sum({credit}) AS BIGINT) AS events,
              true AS balanced FROM snaps
            WHERE {credit} IS NOT NULL AND origination_year <= {TRAIN_END}""",
        ctes=SNAPSHOTS,
    )
    add(
        "score_oot_rows",
        lambda c: M.score_holdout(_split(c, "test"), _models(c)).select(
            "loan_id", "scoring_date", "origination_year", credit,
            *[F.col(name).between(0, 1).alias(name) for name in _models(c)],
        ),
        f"""SELECT loan_id, scoring_date, origination_year, {credit}, true AS credit_event_score,
              true AS prepayment_score, true AS credit_event_gbt_score
            FROM snaps WHERE {late}""",
        ctes=SNAPSHOTS,
    )
    add(
        "score_as_of_rows",
        lambda c: _score_as_of(c, _models).select(
            "loan_id", *[F.col(name).between(0, 1).alias(name) for name in _models(c)],
            F.col("loss_severity_score").between(0, 1.5).alias("loss_severity_score"),
        ),
        f"""SELECT loan_id, true AS credit_event_score, true AS prepayment_score,
              true AS credit_event_gbt_score, true AS loss_severity_score
            FROM panel WHERE reporting_period = DATE '{CUTOFF}'""",
    )
    # The linear scores by value; with the boosted ones there is no SQL.
    linear_ctes = f"{SNAPSHOTS}, {full.ctes()}, {full_prepay.ctes()}"
    linear_sql = f"{full.score()} AS credit_event_score, {full_prepay.score()} AS prepayment_score"
    add(
        "score_oot_linear",
        lambda c: M.score_holdout(_split(c, "test"), _linear(c)),
        f"""SELECT loan_id, scoring_date, origination_year, current_upb, fico, original_ltv, {credit},
              {prepay}, {linear_sql} FROM snaps, fc_model, fp_model WHERE {late}""",
        "current_upb original_ltv credit_event_score prepayment_score", linear_ctes, recursive=True,
    )
    add(
        "score_as_of_linear",
        lambda c: _score_as_of(c, _linear),
        f"""SELECT loan_id, {linear_sql},
              least(greatest({RIDGE_FIT.score()}, 0), {M.MAX_SEVERITY}) AS loss_severity_score
            FROM ({ASOF_ROWS}), fc_model, fp_model, ridge_model""",
        "credit_event_score prepayment_score loss_severity_score",
        f"{linear_ctes}, {SEVERITY}, {DRY}, {RIDGE_FIT.ctes()}", recursive=True,
    )
    add("score_oot", lambda c: M.score_holdout(_split(c, "test"), _models(c)))
    add("score_as_of", lambda c: _score_as_of(c, _models))
