"""Feature, snapshot and audit queries."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanweave.operators import features as X
from loanweave.plans.catalog.base import CUTOFF, TRAIN_END, VALIDATION_END, Catalog, Context

HISTORY_AT, SNAPSHOT_AT = dt.date(2001, 6, 1), dt.date(2000, 6, 1)
CODES = """
  CASE loan_purpose WHEN 'P' THEN 0 WHEN 'C' THEN 1 WHEN 'R' THEN 2 ELSE 3 END AS loan_purpose_code,
  CASE occupancy WHEN 'P' THEN 0 WHEN 'S' THEN 1 WHEN 'I' THEN 2 ELSE 3 END AS occupancy_code,
  ifnull(list_position(['SF', 'CO', 'MH', 'PU'], property_type) - 1, 4) AS property_type_code,
  month(reporting_period) AS reporting_month
"""
TRAILING = """
  count(*) FILTER (WHERE delinquency_months >= 1) OVER back AS dq30_months_last_12m,
  count(*) FILTER (WHERE delinquency_months >= 2) OVER back AS dq60_months_last_12m,
  count(*) FILTER (WHERE delinquency_months >= 3) OVER back AS dq90_months_last_12m,
  max(delinquency_months) OVER back AS max_dq_last_12m,
  CAST(bool_or(modification_flag) OVER back AS INTEGER) AS ever_modified_last_12m
"""
BACK = "back AS (PARTITION BY loan_id ORDER BY reporting_period ROWS 11 PRECEDING)"
SNAPSHOTS = f"""
  snaps AS (
    SELECT * EXCLUDE (fwd) FROM (
      SELECT loan_id, reporting_period AS scoring_date, origination_year, is_terminal,
        current_upb, original_upb, original_interest_rate, current_interest_rate, fico,
        original_ltv, original_cltv, dti, loan_age, remaining_term, delinquency_months,
        estimated_ltv, CAST(modification_flag AS INTEGER) AS modification_flag, {CODES},
        {TRAILING},
        CAST(bool_or(is_credit_event) OVER nxt AS INTEGER) AS credit_event_12m,
        CAST(bool_or(is_voluntary_prepayment) OVER nxt AS INTEGER) AS prepayment_12m,
        CAST(bool_or(is_seriously_delinquent) OVER nxt AS INTEGER) AS serious_delinquency_12m,
        count(*) OVER nxt AS fwd
      FROM panel
      WINDOW {BACK}, nxt AS (PARTITION BY loan_id ORDER BY reporting_period
        ROWS BETWEEN 1 FOLLOWING AND 12 FOLLOWING))
    WHERE reporting_month % 3 = 0 AND NOT is_terminal AND (fwd >= 12
      OR credit_event_12m + prepayment_12m + serious_delinquency_12m > 0)
  )
"""
ASOF_ROWS = f"""SELECT * FROM (
    SELECT loan_id, reporting_period, current_upb, original_upb, original_interest_rate,
      current_interest_rate, fico, original_ltv, original_cltv, dti, loan_age,
      remaining_term, delinquency_months, estimated_ltv, mortgage_insurance_pct,
      CAST(modification_flag AS INTEGER) AS modification_flag, {CODES}, {TRAILING}
    FROM panel WHERE reporting_period <= DATE '{CUTOFF}' WINDOW {BACK})
  WHERE reporting_period = DATE '{CUTOFF}'"""
SNAPSHOT_FLOATS = (
    "current_upb original_upb original_interest_rate current_interest_rate original_ltv "
    "original_cltv dti estimated_ltv"
)
_HISTORY = """
  count(*) FILTER (WHERE {at} AND delinquency_months = 1) AS months_in_30dpd_last_12m,
  count(*) FILTER (WHERE {at} AND delinquency_months = 2) AS months_in_60dpd_last_12m,
  count(*) FILTER (WHERE {at} AND delinquency_months >= 3) AS months_in_90plus_last_12m,
  bool_or(modification_flag) FILTER (WHERE {at}) AS ever_modified,
  max(delinquency_months) FILTER (WHERE {at}) AS max_delinquency_ever,
  max(reporting_period) FILTER (WHERE {at} AND delinquency_months > 0) AS last_dq_period,
  count(*) FILTER (WHERE {at} AND delinquency_months = 0 AND pdq > 0
    AND pper >= {t} - INTERVAL 12 MONTH) AS prior_cure_events
"""
LAGGED = """
  lagged AS (
    SELECT *, lag(delinquency_months) OVER w AS pdq, lag(reporting_period) OVER w AS pper
    FROM panel WINDOW w AS (PARTITION BY loan_id ORDER BY reporting_period)
  )
"""


def _labels() -> str:
    def label(name: str, flag: str) -> str:
        return (
            f"if(count(*) FILTER (WHERE reporting_period > t) >= 12, "
            f"CAST(bool_or({flag}) FILTER (WHERE reporting_period > t) AS INTEGER), NULL) AS {name}"
        )

    return ", ".join(
        label(n, f)
        for n, f in (
            ("credit_event_12m", "is_credit_event"),
            ("serious_delinquency_12m", "is_seriously_delinquent"),
            ("prepayment_12m", "is_voluntary_prepayment"),
        )
    )


def _around(dates: str, source: str = "panel") -> str:
    """History and labels of every loan and date, joined to the rows scored."""
    return f"""{LAGGED.replace('FROM panel', f'FROM {source}')},
      dates AS ({dates}),
      around AS (
        SELECT loan_id, t, {_HISTORY.format(at='reporting_period <= t', t='t')}, {_labels()}
        FROM lagged JOIN dates ON reporting_period >= t - INTERVAL 12 MONTH
          AND reporting_period <= t + INTERVAL 12 MONTH GROUP BY ALL
      )"""


OUT = (
    "loan_id scoring_date fico original_ltv current_upb delinquency_months "
    "months_in_30dpd_last_12m months_in_60dpd_last_12m months_in_90plus_last_12m ever_modified "
    "max_delinquency_ever last_dq_period prior_cure_events credit_event_12m "
    "serious_delinquency_12m prepayment_12m"
).split()


# The columns of a panel that a snapshot with these columns is made of.
AROUND = (
    "loan_id", "reporting_period", "fico", "original_ltv", "current_upb", "delinquency_months",
    "modification_flag", "is_terminal", "is_credit_event", "is_seriously_delinquent",
    "is_voluntary_prepayment",
)


def _scored(source: str) -> str:
    names = ", ".join("t AS scoring_date" if c == "scoring_date" else c for c in OUT)
    return f"""SELECT {names} FROM {source} p JOIN around a
        ON p.loan_id = a.loan_id AND p.reporting_period = a.t
      WHERE NOT is_terminal""".replace("SELECT loan_id", "SELECT p.loan_id")


VINTAGES = (1994, 1996)
DATES = f"""
  months AS (SELECT DISTINCT reporting_period AS m FROM panel
    WHERE origination_year BETWEEN {VINTAGES[0]} AND {VINTAGES[1]}),
  third AS (SELECT m, row_number() OVER (ORDER BY m) - 1 AS j FROM (
    SELECT m, row_number() OVER (ORDER BY m) - 1 AS i FROM months) WHERE i % 3 = 0),
  picked AS (SELECT m AS scoring_date FROM third)
"""


# Thinned evenly to at most twelve.
THINNED = f"""
{DATES},
  thinned AS (SELECT m AS scoring_date FROM third WHERE (SELECT count(*) FROM third) <= 12 OR j IN (
    SELECT CAST(round_even(k * ((SELECT count(*) FROM third) - 1) / 11e0, 0) AS BIGINT)
    FROM (SELECT unnest(range(12)) AS k)))
"""


# What the panel offers a model: its numbers and flags, without facts known after the event.
PANEL_FEATURES = (
    "current_upb", "deferred_upb", "interest_bearing_upb", "current_interest_rate", "loan_age",
    "remaining_term", "delinquency_months", "modification_flag", "step_modification_flag",
    "deferred_payment_plan", "estimated_ltv", "delinquency_due_to_disaster", "original_upb",
    "original_interest_rate", "original_loan_term", "original_ltv", "original_cltv", "fico", "dti",
    "mortgage_insurance_pct", "num_units", "num_borrowers", "first_time_homebuyer",
    "interest_only", "super_conforming", "prepayment_penalty", "origination_year",
    "origination_quarter", "reporting_month", "upb_ratio", "is_seriously_delinquent",
    "reporting_year",
)


def _snapshot_at(c: Context) -> DataFrame:
    stored = c.panel_of(AROUND)
    return X.snapshot_at(stored.table, SNAPSHOT_AT, history=stored.history)


def _asof(c: Context) -> DataFrame:
    stored = c.panel_of(X.ASOF_COLUMNS)
    return X.asof_features(stored.table, CUTOFF, stored.history)


def register(catalog: Catalog) -> None:
    add = catalog.add
    coded = ["loan_purpose", "occupancy", "property_type", "channel"]
    flags = ["first_time_homebuyer", "interest_only", "super_conforming", "prepayment_penalty"]
    encoded = [f"{c}_encoded" for c in coded] + [f"{f}_flag" for f in flags]
    add(
        "encode_categoricals",
        lambda c: X.encode_categoricals(c.origination).select("loan_id", *encoded),
        """SELECT loan_id,
             ifnull(list_position(['P', 'C', 'R', 'U'], loan_purpose) - 1, -1)
               AS loan_purpose_encoded,
             ifnull(list_position(['P', 'S', 'I', 'U'], occupancy) - 1, -1) AS occupancy_encoded,
             ifnull(list_position(['SF', 'CO', 'MH', 'CP', 'PU'], property_type) - 1, -1)
               AS property_type_encoded,
             ifnull(list_position(['R', 'B', 'C', 'T'], channel) - 1, -1) AS channel_encoded, """
        + ", ".join(f"CAST({f} AS INTEGER) AS {f}_flag" for f in flags)
        + " FROM so",
    )
    at = f"DATE '{HISTORY_AT}'"
    add(
        "dq_history",
        lambda c: X.delinquency_history(c.panel, HISTORY_AT, history=c.history),
        f"""SELECT *, date_diff('month', last_dq_period, {at}) AS months_since_last_dq FROM (
              SELECT loan_id, {_HISTORY.format(at='true', t=at)} FROM lagged
              WHERE reporting_period BETWEEN {at} - INTERVAL 12 MONTH AND {at} GROUP BY 1)""",
        ctes=LAGGED,
    )
    add(
        "snapshot_at",
        lambda c: _snapshot_at(c).select(*OUT),
        _scored("panel"),
        "original_ltv current_upb",
        # Rows outside the year before and the year after serve neither history nor labels.
        "near AS (SELECT loan_id, reporting_period, delinquency_months, modification_flag, "
        "is_credit_event, is_seriously_delinquent, is_voluntary_prepayment FROM panel "
        f"WHERE reporting_period BETWEEN DATE '{SNAPSHOT_AT}' - INTERVAL 12 MONTH AND "
        f"DATE '{SNAPSHOT_AT}' + INTERVAL 12 MONTH), "
        + _around(f"SELECT DATE '{SNAPSHOT_AT}' AS t", "near"),
    )
    add(
        "scoring_dates",
        lambda c: X.scoring_dates(
            c.panel.where(F.col("origination_year").between(*VINTAGES))
        ),
        "SELECT * FROM picked",
        ctes=DATES,
    )
    add(
        "scoring_dates_thinned",
        lambda c: X.scoring_dates(
            c.panel.where(F.col("origination_year").between(*VINTAGES)), max_dates=12
        ),
        "SELECT * FROM thinned",
        ctes=THINNED,
    )
    add(
        "training_dataset",
        lambda c: X.training_dataset(c.panel, *VINTAGES, history=c.history).select(*OUT),
        _scored("young"),
        "original_ltv current_upb",
        f"""young AS (SELECT * FROM panel WHERE origination_year BETWEEN {VINTAGES[0]} AND
              {VINTAGES[1]}), {DATES},
            {_around('SELECT scoring_date AS t FROM picked', 'young')}""",
    )
    add("model_snapshots", lambda c: c.snapshots, "SELECT * FROM snaps", SNAPSHOT_FLOATS,
        SNAPSHOTS)
    add(
        "asof_features",
        lambda c: _asof(c),
        ASOF_ROWS,
        SNAPSHOT_FLOATS + " mortgage_insurance_pct",
    )
    add(
        "temporal_split",
        lambda c: X.temporal_split(c.snapshots, TRAIN_END, VALIDATION_END)
        .groupBy("split", "origination_year")
        .agg(F.count(F.lit(1)).alias("n")),
        f"""SELECT if(origination_year <= {TRAIN_END}, 'train',
              if(origination_year <= {VALIDATION_END}, 'validation', 'test')) AS split,
              origination_year, count(*) AS n FROM snaps GROUP BY ALL""",
        ctes=SNAPSHOTS,
    )
    add(
        "negative_downsample",
        lambda c: X.negative_downsample(c.snapshots, "credit_event_12m", 10).select(
            "loan_id", "scoring_date", "credit_event_12m"
        ),
        """SELECT loan_id, scoring_date, credit_event_12m FROM snaps
           WHERE credit_event_12m = 1 OR CAST('0x' || substr(md5(
             loan_id || '|' || CAST(scoring_date AS VARCHAR)), 1, 8) AS BIGINT) % 100 < 10""",
        ctes=SNAPSHOTS,
    )
    numbers = ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in PANEL_FEATURES)
    add(
        "feature_profile",
        lambda c: X.feature_profile(X.model_matrix(c.panel)),
        f"""SELECT feature, count(*) AS rows, count(value) AS filled, avg(value) AS mean,
              min(value) AS lowest, max(value) AS highest
            FROM (SELECT {numbers} FROM panel)
              UNPIVOT INCLUDE NULLS (value FOR feature IN ({', '.join(PANEL_FEATURES)})) GROUP BY 1""",
        "mean lowest highest",
    )
    note = "Vintages to 1997 train, 1998-1999 validate, later ones test."
    add(
        "leakage_audit",
        lambda c: X.leakage_audit(
            X.temporal_split(c.snapshots, TRAIN_END, VALIDATION_END), split_note=note
        ),
        f"""SELECT unnest([
              {{'check_name': 'forbidden_feature_name_scan', 'severity': 'FAIL',
                'status': 'PASS', 'metric': 0e0,
                'detail': 'No feature name holds a token of later knowledge.'}},
              {{'check_name': 'terminal_scoring_rows_excluded', 'severity': 'FAIL',
                'status': if(bad = 0, 'PASS', 'FAIL'), 'metric': CAST(bad AS DOUBLE),
                'detail': 'Only loans alive at the scoring date are scored.'}},
              {{'check_name': 'forward_target_population', 'severity': 'WARN',
                'status': 'PASS', 'metric': CAST(n AS DOUBLE),
                'detail': 'Within twelve months of scoring: ' || format('{{:,}}', ce)
                  || ' credit events, ' || format('{{:,}}', pp)
                  || ' voluntary prepayments.'}},
              {{'check_name': 'temporal_split_design', 'severity': 'FAIL',
                'status': if(crossed = 0, 'PASS', 'FAIL'),
                'metric': CAST(crossed AS DOUBLE), 'detail': '{note}'}}], recursive := true)
            FROM (SELECT count(*) AS n, count(*) FILTER (WHERE is_terminal) AS bad,
              CAST(sum(credit_event_12m) AS BIGINT) AS ce,
              CAST(sum(prepayment_12m) AS BIGINT) AS pp,
              (SELECT count(*) FROM parts a JOIN parts b ON a.place < b.place AND a.hi >= b.lo)
                AS crossed FROM snaps)""",
        ctes=f"""{SNAPSHOTS}, parts AS (
          SELECT CASE WHEN origination_year <= {TRAIN_END} THEN 1
              WHEN origination_year <= {VALIDATION_END} THEN 2 ELSE 3 END AS place,
            min(origination_year) AS lo, max(origination_year) AS hi FROM snaps GROUP BY 1)""",
    )
    cohorts = f"""cohorts AS (
        SELECT origination_year, scoring_date, delinquency_months, max_dq_last_12m,
          count(*) AS observations, CAST(sum(credit_event_12m) AS BIGINT) AS credit_events,
          avg(credit_event_12m) AS credit_event_rate
        FROM snaps WHERE origination_year > {VALIDATION_END} GROUP BY ALL)"""
    add(
        "ce_cohort_audit",
        lambda c: X.credit_cohort_audit(c.snapshots, VALIDATION_END + 1, 9999),
        "SELECT * FROM cohorts",
        "credit_event_rate",
        f"{SNAPSHOTS}, {cohorts}",
    )
    add(
        "ce_by_delinquency",
        lambda c: X.credit_by_delinquency(
            X.credit_cohort_audit(c.snapshots, VALIDATION_END + 1, 9999)
        ),
        """SELECT delinquency_months, CAST(sum(observations) AS BIGINT) AS observations,
             CAST(sum(credit_events) AS BIGINT) AS credit_events,
             sum(credit_events) / sum(observations) AS credit_event_rate
           FROM cohorts GROUP BY 1""",
        "credit_event_rate",
        f"{SNAPSHOTS}, {cohorts}",
    )
