"""Linear models fitted by Newton's method, and their scores as plain expressions.

Logistic, ridge and right-censored Weibull regressions have one optimum each. A pass over the
stored rows gives the penalised loss, its gradient and its second derivatives, summed by matrix
products within Arrow batches and then by a Spark aggregate, so a handful of small sums reaches the
driver, whatever the row count; a dozen passes find the optimum to rounding. Above ``START_ROWS`` rows
the steps begin at the optimum of about so many of them, which saves most passes over all rows; the
loss, and so the optimum, remain those of all rows. The largest component of the last gradient is kept
with the model as the certificate of its fit.

A fitted model is numbers only. Its score is one SQL expression over the raw columns, with missing,
NaN and infinite values filled; Spark runs it as code of its own, and any engine gives the same.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import suppress
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loanweave.operators.ordered import exact_quantiles, running_sums
from loanweave.storage import written

LOGISTIC, IDENTITY, WEIBULL = "logistic", "identity", "weibull"
MAX_PASSES = 100
TOLERANCE = 1e-9  # largest mean gradient at which a fit is done
CONSTANT = 1e-9  # a deviation below this part of the mean is rounding: the feature is constant
START_ROWS = 200_000  # rows that tell where a larger table's medians lie and its Newton steps begin
STARTED = 1e-6  # largest mean gradient at which those rows' own steps end
_SUMS = "at int, value double"


def literal(x: float) -> str:
    """A double in SQL, in full."""
    text = repr(float(x))
    return text if "e" in text or "n" in text else f"{text}e0"


def filled(column: str, columns: Sequence[str] | None, fill: float) -> str:
    """SQL of a feature as a finite double: ``fill`` where it is missing, NaN, infinite or absent."""
    if columns is not None and column not in columns:
        return literal(fill)
    number = f"CAST({column} AS DOUBLE)"
    return f"CASE WHEN abs({number}) < CAST('Infinity' AS DOUBLE) THEN {number} ELSE {literal(fill)} END"


@dataclass(frozen=True)
class Linear:
    """A fitted model: coefficients on standardised features, and how it was fitted."""

    link: str
    features: tuple[str, ...]
    fills: tuple[float, ...]
    means: tuple[float, ...]
    deviations: tuple[float, ...]
    coefficients: tuple[float, ...]
    intercept: float
    scale: float
    rows: int
    gradient: float  # the largest component of the mean penalised gradient at the end
    passes: int

    def margin(self, columns: Sequence[str] | None = None) -> str:
        """SQL of the linear predictor; features that ``columns`` lacks count as missing."""
        terms = [literal(self.intercept)]
        for name, fill, mean, deviation, b in zip(
            self.features, self.fills, self.means, self.deviations, self.coefficients
        ):
            if deviation and b:
                value = filled(name, columns, fill)
                terms.append(f"{literal(b)} * (({value}) - {literal(mean)}) / {literal(deviation)}")
        return " + ".join(terms)

    def sql(self, columns: Sequence[str] | None = None) -> str:
        """SQL of the score: a probability, a value, or a time (of survival e^-1)."""
        margin = self.margin(columns)
        if self.link == LOGISTIC:
            return f"1e0 / (1e0 + exp(-({margin})))"
        return f"exp({margin})" if self.link == WEIBULL else margin

    def score(self, df: DataFrame) -> Column:
        return F.expr(self.sql(df.columns))

    def table(self, spark: SparkSession) -> DataFrame:
        """One row per term (the intercept first, a Weibull scale last): term, coefficient per
        standard deviation of its feature, mean, deviation, fill, and whether the fit is optimal."""
        rows = [("intercept", self.intercept, None, None, None)]
        rows += list(zip(self.features, self.coefficients, self.means, self.deviations, self.fills))
        if self.link == WEIBULL:
            rows.append(("scale", self.scale, None, None, None))
        return spark.createDataFrame(
            [(*row, self.rows, self.gradient <= TOLERANCE) for row in rows],
            "term string, coefficient double, mean double, deviation double, fill double, "
            "observations bigint, optimal boolean",
        )


# --- the sums of one pass ----------------------------------------------------------------


def _upper(n: int) -> tuple[np.ndarray, np.ndarray]:
    return np.triu_indices(n)


def _row_sums(link: str, theta: np.ndarray, v: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Loss, gradient and upper second derivatives, summed over rows. ``w`` is the row's weight,
    or for Weibull whether the event was seen; ``y`` then is the logarithm of the time."""
    if link == WEIBULL:
        # With theta = (coefficients / scale, 1 / scale) the loss is convex.
        e = theta[-1] * y - v @ theta[:-1]
        grown, u = np.exp(e), np.column_stack([-v, y])
        loss = (grown - w * (e + np.log(theta[-1]))).sum() if theta[-1] > 0 else np.inf
        gradient, second = (grown - w) @ u, (u * grown[:, None]).T @ u
        gradient[-1] -= w.sum() / theta[-1]
        second[-1, -1] += w.sum() / theta[-1] ** 2
    else:
        margin = v @ theta
        if link == LOGISTIC:
            p = 1 / (1 + np.exp(-np.clip(margin, -700, 700)))
            loss = (w * (np.logaddexp(0, margin) - y * margin)).sum()
            d, h = w * (p - y), w * p * (1 - p)
        else:
            loss, d, h = (w * (margin - y) ** 2).sum() / 2, w * (margin - y), w
        gradient, second = d @ v, (v * h[:, None]).T @ v
    return np.concatenate([[loss], gradient, second[_upper(len(theta))]])


class _Fit:
    """Passes over a stored design: columns x0.. (doubles, null where missing), y, w."""

    def __init__(self, link, design: DataFrame, fills, means, deviations, ridge: float, scale: float):
        self.link, self.design, self.ridge, self.scale = link, design, ridge, scale
        self.fills, self.means, self.deviations = map(np.array, (fills, means, deviations))
        self.n = len(fills) + (2 if link == WEIBULL else 1)
        self.penalty = np.zeros(self.n)
        self.penalty[1 : len(fills) + 1] = ridge
        # A constant feature stands at zero; this keeps its place from being singular.
        self.prop = np.zeros(self.n)
        self.prop[1 : len(fills) + 1] = self.deviations == 0
        self.passes = 0

    def at(self, theta: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Mean penalised loss, gradient and second derivatives at ``theta``."""
        link, fills, means, deviations = self.link, self.fills, self.means, self.deviations
        size = np.where(deviations > 0, deviations, 1.0)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for batch in batches:
                columns = [c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns]
                x = np.column_stack(columns[:-2]) if len(columns) > 2 else np.zeros((batch.num_rows, 0))
                x = np.where(np.isnan(x), fills, x)
                v = np.column_stack([np.ones(len(x)), np.where(deviations > 0, (x - means) / size, 0.0)])
                sums = _row_sums(link, theta, v, columns[-2], columns[-1])
                total = sums if total is None else total + sums
            if total is not None:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(len(total)), pa.int32()), pa.array(total)], ["at", "value"]
                )

        rows = self.design.mapInArrow(run, _SUMS).groupBy("at").agg(F.sum("value").alias("value")).collect()
        sums = np.zeros(1 + self.n + self.n * (self.n + 1) // 2)
        for row in rows:
            sums[row["at"]] = row["value"]
        second = np.zeros((self.n, self.n))
        second[_upper(self.n)] = sums[1 + self.n :]
        second = second + np.triu(second, 1).T
        loss = sums[0] + (self.penalty * theta**2).sum() / 2
        gradient = sums[1 : 1 + self.n] + self.penalty * theta
        self.passes += 1
        return loss / self.scale, gradient / self.scale, second / self.scale + np.diag(self.penalty / self.scale + self.prop)

    def minimum(self, *starts: np.ndarray, enough: float = TOLERANCE / 100) -> tuple[np.ndarray, float]:
        """(optimum, largest gradient): Newton steps from the start of least loss, halved while they
        do not lower the loss."""
        loss, theta, gradient, second = np.inf, None, None, None
        for start in starts:
            found = self.at(start)
            if theta is None or found[0] < loss:
                theta, (loss, gradient, second) = start, found
        while np.abs(gradient).max() > enough and self.passes < MAX_PASSES:
            step = np.linalg.solve(second, gradient)
            part = 1.0
            while True:
                found = self.at(theta - part * step)
                if np.isfinite(found[0]) and found[0] <= loss + 1e-13 * (1 + abs(loss)):
                    break
                if part < 1e-6 or self.passes >= MAX_PASSES:
                    return theta, float(np.abs(gradient).max())
                part /= 2
            still = np.abs(part * step).max() < 1e-14 * (1 + np.abs(theta).max())
            theta, (loss, gradient, second) = theta - part * step, found
            if still:
                break
        return theta, float(np.abs(gradient).max())


def _long(rows: DataFrame, values: Sequence[Column]) -> DataFrame:
    """(i, x): the i-th of ``values`` of each row, where there is one."""
    each = F.array(*[F.struct(F.lit(i).alias("i"), x.alias("x")) for i, x in enumerate(values)])
    return rows.select(F.explode(F.filter(each, lambda e: e["x"].isNotNull())).alias("e")).select("e.i", "e.x")


def medians(rows: DataFrame, columns: Sequence[str], some: DataFrame | None = None) -> list[float]:
    """Exact interpolated median of each column; 0 for one without values.

    ``some`` of the rows tell between which two values each median should lie. All rows are then
    counted below, at and above these values, and only values strictly between are put in order. A
    column whose median proves to lie elsewhere is ordered whole.
    """
    found: dict[int, float] = {}
    rest = list(range(len(columns)))
    if some is not None and columns:
        found = _bracketed(rows, columns, some)
        rest = [i for i in rest if i not in found]
    if rest:
        long = _long(rows, [F.col(columns[i]) for i in rest])
        for r in exact_quantiles(long, "x", [0.5], by=["i"]).collect():
            found[rest[r["i"]]] = r["q0"]
    return [float(found.get(i, 0.0)) for i in range(len(columns))]


def _bracketed(rows: DataFrame, columns: Sequence[str], some: DataFrame) -> dict[int, float]:
    """Medians that lie between two near quantiles of ``some`` rows, by the column's place."""
    near = some.agg(*[F.percentile_approx(c, [0.49, 0.51], 10_000) for c in columns]).first()
    bounds = {i: b for i, b in enumerate(near) if b}
    if not bounds:
        return {}
    lows, highs = ({i: F.lit(float(b[k])) for i, b in bounds.items()} for k in (0, 1))
    x = {i: F.col(columns[i]) for i in bounds}
    row = rows.agg(*[
        F.struct(
            F.count(x[i]).alias("n"), F.count_if(x[i] < lows[i]).alias("below"),
            F.count_if(x[i] <= lows[i]).alias("low"), F.count_if(x[i] < highs[i]).alias("inside"),
            F.count_if(x[i] <= highs[i]).alias("high"),
        ).alias(f"c{i}")
        for i in bounds
    ]).first()
    ends: dict[int, list[float | None]] = {}
    for i, (low, high) in bounds.items():
        counts = row[f"c{i}"]
        places = (counts["n"] - 1) // 2, counts["n"] // 2
        if counts["below"] <= places[0] and places[1] < counts["high"]:
            ends[i] = [low if p < counts["low"] else None if p < counts["inside"] else high for p in places]
    open_ = [i for i in ends if None in ends[i]]
    if open_:
        between = _long(rows, [F.when((x[i] > lows[i]) & (x[i] < highs[i]), x[i]) for i in open_])
        tallied = between.groupBy("i", "x").agg(F.count(F.lit(1)).alias("n"))
        upto = running_sums(tallied, ["x"], {"upto": F.col("n")}, within=["i"], label="medians")

        def value(which: int) -> Column:
            place = F.array(*[
                F.lit((row[f"c{i}"]["n"] - 1 + which) // 2 - row[f"c{i}"]["low"]) for i in open_
            ])[F.col("i")]
            return F.max(F.when((F.col("upto") - F.col("n") <= place) & (place < F.col("upto")), F.col("x")))

        for r in upto.groupBy("i").agg(value(0).alias("a"), value(1).alias("b")).collect():
            i = open_[r["i"]]
            ends[i] = [e if e is not None else r[k] for e, k in zip(ends[i], "ab")]
    return {i: a + (b - a) * 0.5 for i, (a, b) in ends.items()}


def fit(
    rows: DataFrame, features: Sequence[str], label: Column, link: str, *, ridge: float = 0.0,
    mean_ridge: float = 0.0, fill: float | None = None, weigh=None, seen: Column | None = None,
) -> Linear:
    """Fit ``label`` (no nulls) on the features, standardised by population deviation.

    Missing values become ``fill``, or each feature's exact median. The loss is the weighted sum
    over rows plus half the squared coefficients times (``ridge`` + ``mean_ridge`` times the sum of
    weights). ``weigh`` maps the numbers of labels 1 and 0 to the weights of such rows. ``seen``
    marks events among Weibull times.
    """
    names = [f"x{i}" for i in range(len(features))]
    numbers = [
        F.expr(f"CASE WHEN abs(CAST({c} AS DOUBLE)) < CAST('Infinity' AS DOUBLE) THEN CAST({c} AS DOUBLE) END")
        if c in rows.columns else F.lit(None).cast("double")
        for c in features
    ]
    second = F.lit(1.0) if seen is None else seen.cast("double")
    design = written(
        rows.select(*[x.alias(n) for x, n in zip(numbers, names)], label.cast("double").alias("y"), second.alias("w")),
        "design",
    )
    stored = design.count()
    some = None
    if stored > START_ROWS:
        some = written(design.sample(START_ROWS / stored, seed=1), "start")
    fills = [fill] * len(names) if fill is not None else medians(design, names, some)
    whole = [F.coalesce(n, F.lit(f)) for n, f in zip(names, fills)]
    row = design.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("y") == 1).alias("ones"), F.sum("w").alias("events"),
        F.sum(F.exp("y")).alias("time") if link == WEIBULL else F.lit(0.0).alias("time"),
        *[F.avg(x).alias(f"a{i}") for i, x in enumerate(whole)],
        *[F.stddev_pop(x).alias(f"s{i}") for i, x in enumerate(whole)],
    ).first()
    count = row["n"]
    if not count:
        raise ValueError("no rows to fit")
    means = [float(row[f"a{i}"]) for i in range(len(names))]
    deviations = [float(row[f"s{i}"]) for i in range(len(names))]
    deviations = [s if s > CONSTANT * abs(a) else 0.0 for s, a in zip(deviations, means)]
    total = float(count)
    if weigh:
        one, zero = weigh(row["ones"], count - row["ones"])
        weight = F.when(F.col("y") == 1, one).otherwise(zero)
        design = design.withColumn("w", weight)
        some = None if some is None else some.withColumn("w", weight)
        total = one * row["ones"] + zero * (count - row["ones"])
    penalty = ridge + mean_ridge * total
    passes = _Fit(link, design, fills, means, deviations, penalty, total)
    theta = np.zeros(passes.n)
    if link == WEIBULL:  # the optimum without features at scale 1
        theta[0], theta[-1] = np.log(row["time"] / max(row["events"], 1e-9)), 1.0
    starts = [theta]
    if some is not None:
        share = START_ROWS / stored
        begun = _Fit(link, some, fills, means, deviations, penalty * share, total * share)
        with suppress(np.linalg.LinAlgError):  # these rows may not tell all coefficients apart
            starts.append(begun.minimum(theta, enough=STARTED)[0])
    theta, gradient = passes.minimum(*starts)
    scale = 1 / theta[-1] if link == WEIBULL else 1.0
    k = len(names)
    return Linear(
        link, tuple(features), tuple(map(float, fills)), tuple(means), tuple(deviations),
        tuple(float(b * scale) for b in theta[1 : k + 1]), float(theta[0] * scale), float(scale), count,
        gradient, passes.passes,
    )
