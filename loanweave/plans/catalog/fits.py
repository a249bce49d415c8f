"""SQL twins of fitted models: the same optimum by Newton steps in a recursive query.

Nothing of a fit is handed over. SQL imputes, standardises and weighs the training rows itself,
sums the derivatives of the penalised loss in each step, eliminates, and scores other rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

STEPS = 30


@dataclass(frozen=True)
class Fit:
    """CTEs named ``<name>_...`` of one fit; ``rows`` is a relation of raw columns."""

    name: str
    rows: str
    features: Sequence[str]
    label: str
    link: str = "logistic"
    ridge: str = "1e0"  # may use n, one, zero, ones, zeros
    fill: str | None = None  # else medians
    one: str = "1e0"  # weights of labels 1 and 0; may use ones and zeros
    zero: str = "1e0"
    seen: str = "1e0"
    where: str = "true"

    def vector(self, values: Sequence[str], cal: str) -> str:
        parts = [
            f"if({cal}.s[{i}] > 0, (ifnull({x}, {cal}.m[{i}]) - {cal}.a[{i}]) / {cal}.s[{i}], 0e0)"
            for i, x in enumerate(values, 1)
        ]
        return f"[{', '.join(['1e0', *parts])}]"

    def margin(self) -> str:
        """Linear predictor of a relation that is joined with ``<name>_model``."""
        raw = [f"CAST({c} AS DOUBLE)" for c in self.features]
        return f"list_dot_product({self.vector(raw, f'{self.name}_model')}, {self.name}_model.b)"

    def score(self) -> str:
        if self.link == "logistic":
            return f"1 / (1 + exp(-({self.margin()})))"
        return f"exp({self.margin()})" if self.link == "weibull" else self.margin()

    def ctes(self) -> str:
        p, k = self.name, len(self.features)
        xs = [f"x{i}" for i in range(k)]
        raw = ", ".join(f"CAST({c} AS DOUBLE) AS {x}" for c, x in zip(self.features, xs))
        fills = ", ".join(self.fill or f"ifnull(median({x}), 0e0)" for x in xs)
        means = ", ".join(f"avg(ifnull({x}, m[{i}]))" for i, x in enumerate(xs, 1))
        spread = ", ".join(f"stddev_pop(ifnull({x}, m[{i}]))" for i, x in enumerate(xs, 1))
        sizes = "list_transform(s, lambda d, i: if(d > 1e-9 * abs(a[i]), d, 0e0))"
        weight = "w" if self.link == "weibull" else "if(y = 1, cal.one, cal.zero)"
        return f"""
          {p}_tr AS MATERIALIZED (SELECT {raw}, CAST({self.label} AS DOUBLE) AS y,
            CAST({self.seen} AS DOUBLE) AS w FROM {self.rows} WHERE {self.where}),
          {p}_count AS MATERIALIZED (SELECT count(*) AS n, count_if(y = 1) AS ones,
            count(*) - count_if(y = 1) AS zeros, sum(w) AS events,
            {"sum(exp(y))" if self.link == "weibull" else "0e0"} AS time, [{fills}] AS m FROM {p}_tr),
          {p}_cal AS MATERIALIZED (SELECT *, {sizes} AS s FROM (
            SELECT any_value(m) AS m, any_value(n) AS n, any_value(events) AS events,
              any_value(time) AS time, any_value({self.one}) AS one, any_value({self.zero}) AS zero,
              any_value({self.ridge}) AS r, [{means}] AS a, [{spread}] AS s
            FROM (SELECT *, {self.one} AS one, {self.zero} AS zero FROM {p}_tr, {p}_count))),
          {p}_z AS MATERIALIZED (SELECT y, {weight} AS w, {self.vector(xs, "cal")} AS v
            FROM {p}_tr, {p}_cal AS cal),
          {self._newton()},
          {p}_model AS MATERIALIZED (SELECT cal.m, cal.a, cal.s, cal.n, {self._final()}
            FROM {p}_newton, {p}_cal AS cal WHERE step = {STEPS})"""

    def _final(self) -> str:
        k = len(self.features)
        if self.link == "weibull":
            return f"list_transform(t[1:{k + 1}], lambda e: e / t[{k + 2}]) AS b, 1 / t[{k + 2}] AS scale"
        return "t AS b, 1e0 AS scale"

    def _newton(self) -> str:
        p, k = self.name, len(self.features)
        weibull = self.link == "weibull"
        n = k + 1 + weibull
        # Per row: u, the derivative d of the loss in its direction, and the second one h.
        if weibull:
            start = f"list_concat(list_concat([ln(time / events)], list_transform(range({k}), lambda i: 0e0)), [1e0])"
            u = "list_append(list_transform(v, lambda e: -e), y)"
            inner = f"SELECT *, {u} AS u, exp(t[{n}] * y - list_dot_product(v, t[1:{k + 1}])) AS g"
            rows = f"SELECT step, t, r, s, u, w, g - w AS d, g AS h FROM ({inner} FROM {p}_newton, {p}_z, {p}_cal AS cal WHERE step < {STEPS})"
        else:
            start = f"list_transform(range({n}), lambda i: 0e0)"
            g = "list_dot_product(v, t)"
            g = f"1 / (1 + exp(-({g})))" if self.link == "logistic" else g
            rows = f"""SELECT step, t, r, s, v AS u, w, w * (g - y) AS d,
              {"w * g * (1 - g)" if self.link == "logistic" else "w"} AS h
              FROM (SELECT *, {g} AS g FROM {p}_newton, {p}_z, {p}_cal AS cal WHERE step < {STEPS})"""
            rows = rows.replace("SELECT *,", f"SELECT step, t, y, {p}_z.w AS w, v, r, s,")
        rows = rows.replace("SELECT *,", f"SELECT step, t, y, {p}_z.w AS w, v, r, s,")
        sums = [f"sum(d * u[{i}]) AS d{i}" for i in range(1, n + 1)]
        sums += [f"sum(h * u[{i}] * u[{j}]) AS h{i}_{j}" for i in range(1, n + 1) for j in range(i, n + 1)]

        def second(i: int, j: int) -> str:
            text = f"h{min(i, j)}_{max(i, j)}"
            if i == j and 1 < i <= k + 1:
                text += f" + r + if(s[{i - 1}] > 0, 0, 1)"
            return text + (f" + events / t[{n}] ** 2" if weibull and i == j == n else "")

        def first(i: int) -> str:
            text = f"d{i}" + (f" + r * t[{i}]" if 1 < i <= k + 1 else "")
            return text + (f" - events / t[{n}]" if weibull and i == n else "")

        matrix = ", ".join(
            f"[{', '.join([*(second(i, j) for j in range(1, n + 1)), first(i)])}]" for i in range(1, n + 1)
        )
        solved = f"""(SELECT step, t, [{matrix}] AS m FROM (SELECT step, t, any_value(r) AS r,
          any_value(s) AS s, sum(w) AS events, {', '.join(sums)} FROM ({rows}) GROUP BY step, t))"""
        for c in range(1, n + 1):  # elimination, one column after the other
            solved = f"""(SELECT step, t, list_transform(m, lambda x, i: if(i = {c},
              list_transform(x, lambda e: e / x[{c}]),
              list_transform(x, lambda e, j: e - x[{c}] * m[{c}][j] / m[{c}][{c}]))) AS m FROM {solved})"""
        return f"""{p}_newton AS (SELECT 0 AS step, {start} AS t FROM {p}_cal UNION ALL
          SELECT step + 1, list_transform(t, lambda e, i: e - m[i][{n + 1}]) FROM {solved})"""


def metrics(scored: str, model: str, target: str) -> str:
    """One row of out-of-time metrics of a relation (y, p, w)."""
    return f"""
      SELECT '{model}' AS model_name, '{target}' AS target, n_total, n_positive, brier_score, log_loss,
        roc_auc, pr_auc, top_decile_capture_rate
      FROM (SELECT count(*) AS n_total, CAST(sum(y) AS BIGINT) AS n_positive,
          sum(w * (p - y) ** 2) / sum(w) AS brier_score,
          sum(-w * ln(if(y = 1, p, 1 - p))) / sum(w) AS log_loss FROM {scored}),
        (SELECT sum(neg * (tp - pos / 2)) / (sum(pos) * sum(neg)) AS roc_auc,
          sum(pos * tp / (tp + fp)) / sum(pos) AS pr_auc
         FROM (SELECT p, pos, neg, sum(pos) OVER o AS tp, sum(neg) OVER o AS fp FROM (
             SELECT p, sum(w * y) AS pos, sum(w * (1 - y)) AS neg FROM {scored} GROUP BY p)
           WINDOW o AS (ORDER BY p DESC))),
        (SELECT sum(y) FILTER (WHERE p >= q) / sum(y) AS top_decile_capture_rate
         FROM {scored}, (SELECT quantile_cont(p, 0.9) AS q FROM {scored}))"""


METRIC_FLOATS = "brier_score log_loss roc_auc pr_auc top_decile_capture_rate"


def terms(fit: Fit) -> str:
    """The coefficient table of a fit."""
    k = len(fit.features)
    names = ", ".join(f"'{f}'" for f in ("intercept", *fit.features))
    scale = f"""UNION ALL SELECT 'scale', scale, NULL, NULL, NULL, n, true FROM {fit.name}_model""" \
        if fit.link == "weibull" else ""
    return f"""SELECT [{names}][i] AS term, b[i] AS coefficient, if(i > 1, a[i - 1], NULL) AS mean,
        if(i > 1, s[i - 1], NULL) AS deviation, if(i > 1, m[i - 1], NULL) AS fill,
        n AS observations, true AS optimal
      FROM {fit.name}_model, (SELECT unnest(range(1, {k + 2})) AS i) {scale}"""


TERM_FLOATS = "coefficient mean deviation fill"
