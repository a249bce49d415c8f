"""Pool construction: eligibility, scoring, constrained greedy selection, constraint checks."""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import dataclass
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loanweave.fixed import (
    CONCENTRATION_LIMITS,
    CONSTRAINT_TOLERANCE,
    DEFAULT_SEVERITY,
    POOL_TARGET_UPB,
    POOL_TOLERANCE_PCT,
    SCORE_WEIGHTS,
    WA_LIMITS,
)
from loanweave.functions.columns import ratio
from loanweave.operators.collateral import portfolio_metrics
from loanweave.storage import written

#: The columns of a panel that eligibility, scores, selection and portfolio metrics read.
POOL_COLUMNS = (
    "loan_id reporting_period reporting_year is_terminal delinquency_state delinquency_months "
    "remaining_term loan_age current_upb current_interest_rate fico original_ltv original_cltv dti "
    "mortgage_insurance_pct occupancy loan_purpose property_type property_state origination_year "
    "modification_flag"
).split()

# --- eligibility -------------------------------------------------------------------------


@dataclass(frozen=True)
class Eligibility:
    """Hard filters a loan must pass, in this order."""

    exclude_terminated: bool = True
    require_current: bool = True
    min_remaining_term: int = 12
    min_upb: float = 10_000.0
    max_upb: float = 2_000_000.0
    vintage_min: int | None = None
    vintage_max: int | None = None
    allowed_property_types: Sequence[str] | None = None
    allowed_occupancy_types: Sequence[str] | None = None

    def filters(self, columns: Sequence[str]) -> list[tuple[str, Column]]:
        c = F.col
        wanted: list[tuple[str, bool, str, Column]] = [
            ("terminated", self.exclude_terminated, "is_terminal", ~c("is_terminal")),
            ("not_current", self.require_current, "delinquency_state",
             c("delinquency_state") == "CURRENT"),
            ("short_remaining_term", True, "remaining_term",
             c("remaining_term").isNull() | (c("remaining_term") >= self.min_remaining_term)),
            ("upb_out_of_range", True, "current_upb",
             c("current_upb").between(self.min_upb, self.max_upb)),
            ("vintage_too_old", bool(self.vintage_min), "origination_year",
             c("origination_year") >= (self.vintage_min or 0)),
            ("vintage_too_new", bool(self.vintage_max), "origination_year",
             c("origination_year") <= (self.vintage_max or 0)),
            ("disallowed_property_type", bool(self.allowed_property_types), "property_type",
             c("property_type").isin(*(self.allowed_property_types or ()))),
            ("disallowed_occupancy", bool(self.allowed_occupancy_types), "occupancy",
             c("occupancy").isin(*(self.allowed_occupancy_types or ()))),
        ]
        return [(name, cond) for name, on, need, cond in wanted if on and need in columns]


def first_failure(loans: DataFrame, rules: Eligibility) -> Column:
    """Name of the first filter a loan fails, null for an eligible loan."""
    reason = F.lit(None).cast("string")
    for name, passes in reversed(rules.filters(loans.columns)):
        reason = F.when(F.coalesce(passes, F.lit(False)), reason).otherwise(F.lit(name))
    return reason


def eligible(loans: DataFrame, rules: Eligibility | None = None) -> DataFrame:
    """Loans passing every filter."""
    return loans.where(first_failure(loans, rules or Eligibility()).isNull())


def exclusion_waterfall(loans: DataFrame, rules: Eligibility | None = None) -> DataFrame:
    """Loans removed by each filter in order, with totals; every loan is counted once."""
    rules = rules or Eligibility()
    names = [name for name, _ in rules.filters(loans.columns)]
    reason = first_failure(loans, rules)
    counts = loans.select(reason.alias("r")).agg(
        *[F.count_if(F.col("r") == n).alias(n) for n in names],
        F.count("r").alias("_total_excluded"),
        F.count_if(F.col("r").isNull()).alias("_candidate_count"),
    )
    listed = [*names, "_total_excluded", "_candidate_count"]
    return counts.unpivot([], listed, "reason", "loans").where(
        F.col("reason").startswith("_") | (F.col("loans") > 0)
    )


# --- scoring -----------------------------------------------------------------------------


def attach_scores(candidates: DataFrame, scores: DataFrame) -> DataFrame:
    """Join model scores by loan; absent probabilities count as 0, absent severity as the default."""
    joined = candidates.join(scores, "loan_id", "left")
    severity = (
        F.col("loss_severity_score") if "loss_severity_score" in joined.columns else F.lit(None)
    ).cast("double")
    return joined.withColumns(
        {
            "credit_event_score": F.coalesce("credit_event_score", F.lit(0.0)),
            "prepayment_score": F.coalesce("prepayment_score", F.lit(0.0)),
        }
    ).withColumn(
        "expected_loss_usd",
        F.col("current_upb")
        * F.col("credit_event_score")
        * F.coalesce(severity, F.lit(DEFAULT_SEVERITY)),
    )


def composite_score(
    candidates: DataFrame,
    credit_event: str | None = None,
    prepayment: str | None = None,
    expected_loss: str | None = None,
    weights: Mapping[str, float] = SCORE_WEIGHTS,
) -> DataFrame:
    """Weighted sum of min-max normalised scores; lower is better.

    A missing score column contributes 0. The ranges come from one aggregate whose single row
    reaches the scan as scalar subqueries.
    """
    given = {"credit_event": credit_event, "prepayment": prepayment, "expected_loss": expected_loss}
    used = {k: c for k, c in given.items() if c and c in candidates.columns}
    score = F.lit(0.0)
    if used:
        limits = candidates.agg(
            F.struct(
                *[
                    F.coalesce(f(c), F.lit(empty)).cast("double").alias(f"{k}_{n}")
                    for k, c in used.items()
                    for n, f, empty in (("low", F.min, 0.0), ("high", F.max, 1.0))
                ]
            )
        ).scalar()
        for k, c in used.items():
            low, high = limits[f"{k}_low"], limits[f"{k}_high"]
            # An all-zero column has the range 0..0, which divides by 1.
            span = F.when(high - low == 0, F.lit(1.0)).otherwise(high - low)
            score = score + (F.col(c) - low) / span * weights[k]
    return candidates.withColumn("composite_score", score)


def guardrails(
    candidates: DataFrame,
    wa_limits: Mapping[str, float] = WA_LIMITS,
    concentration: Mapping[str, float] = CONCENTRATION_LIMITS,
) -> DataFrame:
    """Pool limits applied to single loans; a loan without the value does not pass."""
    c = F.col
    kept = candidates
    tests = [
        ("fico", wa_limits.get("min_wa_fico"), lambda x: c("fico") >= x),
        ("original_ltv", wa_limits.get("max_wa_ltv"), lambda x: c("original_ltv") <= x),
        ("dti", wa_limits.get("max_wa_dti"), lambda x: c("dti") <= x),
    ]
    for column, limit, test in tests:
        if limit is not None and column in candidates.columns:
            kept = kept.where(test(limit))
    if concentration.get("max_investor_pct", 100.0) < 100.0 and "occupancy" in candidates.columns:
        kept = kept.where(c("occupancy") != "I")
    return kept


# --- greedy selection --------------------------------------------------------------------

BLOCK_ROWS = 65_536  # loans in a block, the most that one task decides one by one
BLOCKS = 256  # in a stretch, the upper level of the summaries


class _Walk:
    """Exact greedy selection over summaries of blocks.

    The rule is sequential: in (score, loan) order take a loan unless it would lift the pool above
    its ceiling or its state above its cap, and stop once the pool reaches its floor. Most of it is
    settled without looking at loans. From the total and the smallest balance of a state within a
    block (or a stretch of blocks) it follows that all its loans are taken, when they fit the
    state's room together, or none, when not even the smallest fits. A block in which a state fits
    in part, or in which the floor may be reached, is opened: one task walks its loans, those
    larger than their room left out by the scan. Balances are integer cents, so sums are exact in
    any order.

    The driver holds the rooms per state, one summary row per stretch and state, those of the
    blocks of one stretch at a time, and the runs of blocks that are taken whole; never loans.
    """

    def __init__(self, ordered: DataFrame, lower: float, upper: float, state_cap: float | None):
        self.ordered, self.spark = ordered, ordered.sparkSession
        self.lower, self.upper = Fraction(lower) * 100, Fraction(upper) * 100
        self.cap = None if state_cap is None else Fraction(state_cap) * 100
        self.total, self.held = 0, {}
        self.whole: dict[str, list[list[int]]] = {}  # state -> runs of positions taken whole
        self.last: dict[str, int] = {}  # the node up to which a state's last run goes
        self.opened: list[DataFrame] = []
        self.nodes = 0
        cells = ordered.groupBy("block", "state").agg(F.sum("cents").alias("sum"), F.min("cents").alias("least"))
        self.cells = written(cells.withColumn("stretch", F.floor(F.col("block") / BLOCKS)), "block-sums")

    def _summaries(self, rows: DataFrame, node: str) -> list[tuple[int, dict[str, tuple[int, int]]]]:
        """(node, state -> (total, smallest)) in order."""
        found: dict[int, dict[str, tuple[int, int]]] = {}
        for row in rows.groupBy(node, "state").agg(F.sum("sum").alias("sum"), F.min("least").alias("least")).collect():
            found.setdefault(row[node], {})[row["state"]] = (row["sum"], row["least"])
        return sorted(found.items())

    def _settled(self, sums: dict[str, tuple[int, int]]) -> dict[str, int] | None:
        """The states whose loans are all taken, with their totals, if all others take none; or
        nothing if the loans must be looked at."""
        everything = {}
        for state, (total, least) in sums.items():
            held = self.held.get(state, 0)
            if self.total + least > self.upper or self.cap is not None and held + least > self.cap:
                continue
            if self.cap is not None and held + total > self.cap:
                return None
            everything[state] = total
        return everything if self.total + sum(everything.values()) < self.lower else None

    def _take(self, taken: dict[str, int], first: int, last: int) -> None:
        """All loans of the states in positions [first, last); runs of neighbouring nodes join."""
        self.nodes += 1
        for state, total in taken.items():
            self._add(state, total)
            if self.last.get(state) == self.nodes - 1:
                self.whole[state][-1][1] = last
            else:
                self.whole.setdefault(state, []).append([first, last])
            self.last[state] = self.nodes

    def _add(self, state: str, cents: int) -> None:
        self.total += cents
        self.held[state] = self.held.get(state, 0) + cents

    def _open(self, block: int) -> None:
        """Decide a block's loans one by one, in one task."""
        self.nodes += 1
        total, held, lower, upper, cap = self.total, dict(self.held), self.lower, self.upper, self.cap

        def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            pool, states, done = total, dict(held), False
            for batch in batches:
                kept = []
                for i, (state, cents) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())):
                    if done:
                        break
                    mine = states.get(state, 0) + cents
                    if pool + cents > upper or cap is not None and mine > cap:
                        continue
                    kept.append(i)
                    pool, states[state] = pool + cents, mine
                    done = pool >= lower
                yield batch.take(pa.array(kept, pa.int32()))

        room = {s: int((self.cap if self.cap is not None else self.upper) - self.held.get(s, 0)) for s in self.held}
        limit = F.lit(int(self.upper) - self.total)
        if self.cap is not None:
            limit = F.least(limit, _by_state(room, int(self.cap)))
        rows = self.ordered.where((F.col("block") == block) & (F.col("cents") <= limit))
        rows = rows.select("pos", "loan_id", "state", "cents").coalesce(1).sortWithinPartitions("pos")
        chosen = written(rows.mapInArrow(walk, rows.schema), "opened-block")
        self.opened.append(chosen)
        for state, cents in chosen.groupBy("state").agg(F.sum("cents")).collect():  # a row per state
            self._add(state, cents)

    def run(self) -> DataFrame:
        """loan_id of all loans taken."""
        for stretch, sums in self._summaries(self.cells, "stretch"):
            if self.total >= self.lower:
                break
            taken = self._settled(sums)
            if taken is not None:
                size = BLOCKS * BLOCK_ROWS
                self._take(taken, stretch * size, (stretch + 1) * size)
                continue
            for block, inner in self._summaries(self.cells.where(F.col("stretch") == stretch), "block"):
                if self.total >= self.lower:
                    break
                taken = self._settled(inner)
                if taken is None:
                    self._open(block)
                else:
                    self._take(taken, block * BLOCK_ROWS, (block + 1) * BLOCK_ROWS)
        chosen = self.ordered.where(self._in_runs()).select("loan_id")
        for table in self.opened:
            chosen = chosen.unionByName(table.select("loan_id"))
        return chosen

    def _in_runs(self) -> Column:
        """Whether a loan stands in a run of its state that is taken whole."""
        inside = F.lit(False)
        for state, runs in sorted(self.whole.items()):
            mine = F.lit(False)
            for first, last in runs:
                mine = mine | (F.col("pos") >= first) & (F.col("pos") < last)
            inside = inside | (F.col("state") == state) & mine
        return inside


def _by_state(values: Mapping[str, int], default: int) -> Column:
    if not values:
        return F.lit(default)
    pairs = [F.lit(x) for item in values.items() for x in item]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), F.col("state")), F.lit(default))


def _ordered(loans: DataFrame, score: str) -> DataFrame:
    """Loans (loan_id, score, state, upb) by score and loan: pos, increasing but with gaps, and
    block; stored once, as the bounds of ranges come from a sample."""
    ranged = loans.repartitionByRange(score, "loan_id").sortWithinPartitions(score, "loan_id")
    placed = ranged.withColumn("pos", F.monotonically_increasing_id())
    cents = F.round(F.col("upb") * 100).cast("bigint")
    return written(
        placed.select("pos", "loan_id", "state", cents.alias("cents"),
                      F.floor(F.col("pos") / BLOCK_ROWS).alias("block")),
        "ordered-candidates",
    )


def select_pool(
    candidates: DataFrame,
    target_upb: float = POOL_TARGET_UPB,
    tolerance_pct: float = POOL_TOLERANCE_PCT,
    score: str = "composite_score",
    max_state_pct: float | None = None,
    wa_limits: Mapping[str, float] = WA_LIMITS,
    concentration: Mapping[str, float] = CONCENTRATION_LIMITS,
) -> DataFrame:
    """Loans chosen greedily by score (ties by loan id) under the pool ceiling and state caps.
    Balances count in whole cents."""
    if score not in candidates.columns:
        candidates = candidates.withColumn(score, F.lit(0.0))
    lower = target_upb * (1.0 - tolerance_pct / 100.0)
    upper = target_upb * (1.0 + tolerance_pct / 100.0)
    cap_pct = max_state_pct if max_state_pct is not None else concentration.get("max_state_pct")
    has_state = "property_state" in candidates.columns
    state_cap = lower * cap_pct / 100.0 if cap_pct is not None and has_state else None
    state = F.coalesce("property_state", F.lit("UNKNOWN")) if has_state else F.lit("*")
    loans = (
        guardrails(candidates, wa_limits, concentration)
        .where(F.col("current_upb") > 0)
        .select("loan_id", F.col(score).alias("score"), state.alias("state"),
                F.col("current_upb").cast("double").alias("upb"))
    )
    chosen = _Walk(_ordered(loans, "score"), lower, upper, state_cap).run()
    return candidates.join(chosen, "loan_id", "left_semi")


# --- constraints -------------------------------------------------------------------------


def default_constraints() -> dict:
    return {
        "target_upb": POOL_TARGET_UPB,
        "upb_tolerance_pct": POOL_TOLERANCE_PCT,
        **WA_LIMITS,
        "concentration": dict(CONCENTRATION_LIMITS),
    }


def check_constraints(pool: DataFrame, constraints: Mapping | None = None) -> DataFrame:
    """Pass or fail of every configured constraint, from one row of portfolio metrics.

    Averages without a limit (or with limit 0) or without a value are left out; so are
    concentrations without a limit, except the delinquent share, whose default limit is 0.
    """
    return constraint_results(portfolio_metrics(pool), constraints)


def constraint_results(metrics: DataFrame, constraints: Mapping | None = None) -> DataFrame:
    cfg = default_constraints() if constraints is None else constraints
    limits = cfg.get("concentration", {})
    tol = CONSTRAINT_TOLERANCE
    c = F.col

    def result(name, target, actual, direction, unit, passed, note="", present=None):
        row = F.struct(
            name.alias("name") if isinstance(name, Column) else F.lit(name).alias("name"),
            F.lit(float(target)).alias("target"),
            actual.cast("double").alias("actual"),
            F.lit(direction).alias("direction"),
            F.lit(unit).alias("unit"),
            F.when(passed, "PASS").otherwise("FAIL").alias("status"),
            F.lit(note).alias("note"),
        )
        return row if present is None else F.when(present, row)

    def at_most(name, limit, actual, present=None):
        return result(name, limit, actual, "<=", "%", actual <= limit + tol, present=present)

    rows = []
    target = cfg.get("target_upb")
    band_pct = cfg.get("upb_tolerance_pct", 0.5)
    if target:
        low, high = target * (1 - band_pct / 100.0), target * (1 + band_pct / 100.0)
        upb = c("total_current_upb")
        rows.append(
            result("Pool UPB", target, upb, "~", "$", upb.between(low, high),
                   f"±{band_pct:.1f}% tolerance")
        )
    fico = cfg.get("min_wa_fico")
    if fico:
        rows.append(
            result("Min WA FICO", fico, c("wa_fico"), ">=", "", c("wa_fico") >= fico - tol,
                   present=c("wa_fico").isNotNull())
        )
    for key, name, actual in (
        ("max_wa_ltv", "Max WA LTV", "wa_ltv"),
        ("max_wa_dti", "Max WA DTI", "wa_dti"),
    ):
        if cfg.get(key):
            rows.append(at_most(name, cfg[key], c(actual), present=c(actual).isNotNull()))
    for key, name, actual in (
        ("max_investor_pct", "Max Investor Share", "investor_pct"),
        ("max_high_ltv_pct", "Max High-LTV Share (>80%)", "high_ltv_pct"),
        ("max_low_fico_pct", "Max Low-FICO Share (<660)", "low_fico_pct"),
        ("max_modified_pct", "Max Modified Share", "modified_pct"),
    ):
        if limits.get(key) is not None:
            rows.append(at_most(name, limits[key], c(actual)))
    delinquent = c("dq30_pct") + c("dq60_pct") + c("dq90plus_pct")
    rows.append(
        at_most("Max Delinquent Share", limits.get("max_delinquent_pct", 0.0), delinquent)
    )
    if limits.get("max_state_pct") is not None:
        named = F.concat(
            F.lit("Max State Conc. ("), F.coalesce("largest_state", F.lit("None")), F.lit(")")
        )
        rows.append(at_most(named, limits["max_state_pct"], c("largest_state_pct")))
    return metrics.select(F.explode(F.array_compact(F.array(*rows))).alias("r")).select("r.*")


def constraint_summary(results: DataFrame) -> DataFrame:
    """Number of constraints passed and failed."""
    return results.agg(
        F.count_if(F.col("status") == "PASS").alias("passed"),
        F.count_if(F.col("status") == "FAIL").alias("failed"),
    )


# Comparison lines (fixed values: label, metric, divisor).
_COMPARED = (
    ("Total UPB ($M)", "total_current_upb", 1e6),
    ("Loan Count", "loan_count", 1.0),
    ("WA Coupon (%)", "wa_coupon", 1.0),
    ("WA FICO", "wa_fico", 1.0),
    ("WA LTV (%)", "wa_ltv", 1.0),
    ("WA DTI (%)", "wa_dti", 1.0),
    ("WALA (mo)", "wala", 1.0),
    ("Investor % (UPB)", "investor_pct", 1.0),
    ("High-LTV % (UPB)", "high_ltv_pct", 1.0),
    ("Low-FICO % (UPB)", "low_fico_pct", 1.0),
    ("Modified % (UPB)", "modified_pct", 1.0),
    ("Largest State %", "largest_state_pct", 1.0),
)


def compare_pools(candidates: DataFrame, selected: DataFrame) -> DataFrame:
    """Twelve metrics of the candidates and the selected pool with their difference."""

    def lines(pool: DataFrame, name: str) -> DataFrame:
        pairs = F.array(
            *[
                F.struct(F.lit(label).alias("metric"),
                         (F.col(metric).cast("double") / divisor).alias("value"))
                for label, metric, divisor in _COMPARED
            ]
        )
        return portfolio_metrics(pool).select(F.explode(pairs).alias("p")).select(
            "p.metric", F.col("p.value").alias(name)
        )

    both = lines(candidates, "c").join(lines(selected, "s"), "metric", "inner")
    return both.select(
        "metric",
        F.round("c", 2).alias("candidate"),
        F.round("s", 2).alias("selected"),
        F.round(F.col("s") - F.col("c"), 2).alias("delta"),
    )


def pool_weight_pct(pool: DataFrame, column: str) -> DataFrame:
    """Balance share per value of ``column``."""
    whole = pool.select(F.sum("current_upb")).scalar()
    return pool.groupBy(column).agg(F.sum("current_upb").alias("upb")).withColumn(
        "pct", 100.0 * ratio(F.col("upb"), whole)
    )


def build_pool(
    snapshot: DataFrame,
    scores: DataFrame | None = None,
    rules: Eligibility | None = None,
    target_upb: float = POOL_TARGET_UPB,
    tolerance_pct: float = POOL_TOLERANCE_PCT,
    max_state_pct: float | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Candidates and selected pool of a snapshot: eligibility, scores, selection."""
    candidates = eligible(snapshot, rules)
    if scores is None:
        candidates = composite_score(candidates)
    else:
        candidates = composite_score(
            attach_scores(candidates, scores),
            "credit_event_score", "prepayment_score", "expected_loss_usd",
        )
    return candidates, select_pool(
        candidates, target_upb, tolerance_pct, max_state_pct=max_state_pct
    )
