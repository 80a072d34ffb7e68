"""Hiding known cells of a table by a missingness mechanism, to score an imputation on them.

Each mechanism yields one boolean condition per feature, so hiding is a single projection.
The statistics it needs come from aggregates over the table; weights are literals of the plan.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from lacuna.functions.randomness import cell_uniform, normal_weights, pick_names, uniform_below
from lacuna.functions.holes import q
from lacuna.operators.cells import apply_mask
from lacuna.operators.position import order_statistics
from lacuna.roles import Roles
from lacuna.scratch import cut

# Share of fully observed inputs, and default quantile of the censoring mechanism
OBSERVED_SHARE = 0.3
QUANTILE = 0.25

MECHANISMS = ("MCAR", "MAR", "MNARL", "MNARQ")


def mcar(roles: Roles, rate: float, seed: int, features=None, salt: str = "mcar") -> dict[str, Column]:
    """Every cell hidden with the same probability."""
    return {f: uniform_below(rate, F.col(roles.key), f, salt, seed) for f in (features or roles.features)}


@dataclass(frozen=True)
class LogitModel:
    """sigmoid(score + intercept) per target column, score being centred with unit variance."""

    scores: dict[str, Column]
    intercepts: dict[str, float]

    def probability(self, target: str) -> Column:
        return 1 / (1 + F.exp(-(self.scores[target] + F.lit(self.intercepts[target]))))


def weighted_sum(inputs, weights) -> Column:
    total = None
    for name, w in zip(inputs, weights):
        term = q(name).cast("double") * F.lit(float(w))
        total = term if total is None else total + term
    return total


def unit_scores(df: DataFrame, raw: dict[str, Column]) -> dict[str, Column]:
    """Centre every score and divide it by its sample standard deviation (1 when flat); one aggregate."""
    names = list(raw)
    stats = df.agg(*[g(raw[t]).alias(f"{i}{tag}") for i, t in enumerate(names)
                     for tag, g in (("m", F.avg), ("s", F.stddev_samp))]).first().asDict()
    return {t: (raw[t] - F.lit(stats[f"{i}m"])) / F.lit(stats[f"{i}s"] or 1.0) for i, t in enumerate(names)}


def fit_intercepts(df: DataFrame, scores: dict[str, Column], rate: float,
                   tolerance: float = 1e-12, rounds: int = 80) -> dict[str, float]:
    """The b of each column at which the mean of sigmoid(score + b) is ``rate``.

    The scores are written once. Every round is one aggregate over all columns: the mean and its
    slope at the current b, a Newton step kept inside a shrinking bracket. It ends when the mean is met or the step
    is lost in rounding; not to end is an error.
    """
    if not 0 < rate < 1:
        raise ValueError("rate must lie between 0 and 1")
    names = list(scores)
    table = cut(df.select(*[scores[t].alias(f"z{i}") for i, t in enumerate(names)]), "scores")
    low, high = table.agg(F.least(*_each(F.min, names)), F.greatest(*_each(F.max, names))).first()
    start = math.log(rate / (1 - rate))
    state = {i: (start - high - 1, start - low + 1, start) for i in range(len(names))}
    done: dict[int, float] = {}
    for _ in range(rounds):
        live = [i for i in state if i not in done]
        if not live:
            break
        exprs = []
        for i in live:
            s = 1 / (1 + F.exp(-(F.col(f"z{i}") + F.lit(state[i][2]))))
            exprs += [F.avg(s).alias(f"p{i}"), F.avg(s * (1 - s)).alias(f"d{i}")]
        got = table.agg(*exprs).first().asDict()
        for i in live:
            lo, hi, b = state[i]
            gap = got[f"p{i}"] - rate
            lo, hi = (b, hi) if gap < 0 else (lo, b)
            if abs(gap) <= tolerance or hi - lo <= tolerance:
                done[i] = b
                continue
            slope = got[f"d{i}"]
            nxt = b - gap / slope if slope > 0 else (lo + hi) / 2
            if abs(nxt - b) <= tolerance * max(1.0, abs(b)):
                done[i] = nxt
            state[i] = (lo, hi, nxt if lo < nxt < hi else (lo + hi) / 2)
    if len(done) < len(names):
        missed = [t for i, t in enumerate(names) if i not in done]
        raise ArithmeticError(f"no intercept within {rounds} rounds for {missed}")
    return {t: done[i] for i, t in enumerate(names)}


def _each(f, names):
    cols = [f(F.col(f"z{i}")) for i in range(len(names))]
    return cols if len(cols) > 1 else cols * 2


def _fitted(df: DataFrame, raw: dict[str, Column], rate: float) -> LogitModel:
    scores = unit_scores(df, raw)
    return LogitModel(scores, fit_intercepts(df, scores, rate))


def logistic_inputs(roles: Roles, share: float, seed: int, salt: str) -> tuple[list[str], list[str]]:
    """Inputs of the logistic model, and the other features in role order."""
    chosen = set(pick_names(roles.features, max(int(share * len(roles.features)), 1), salt, seed))
    return [f for f in roles.features if f in chosen], [f for f in roles.features if f not in chosen]


def logistic_mask(df: DataFrame, roles: Roles, inputs, targets, rate: float, seed: int, salt: str) -> dict[str, Column]:
    weights = normal_weights(len(inputs), len(targets), seed)
    raw = {t: weighted_sum(inputs, [row[j] for row in weights]) for j, t in enumerate(targets)}
    model = _fitted(df, raw, rate)
    return {t: cell_uniform(F.col(roles.key), t, salt, seed) < model.probability(t) for t in targets}


def mar(df: DataFrame, roles: Roles, rate: float, seed: int, observed: float = OBSERVED_SHARE) -> dict[str, Column]:
    """Some features stay whole and decide, by a logistic model, which other cells are hidden."""
    inputs, targets = logistic_inputs(roles, observed, seed, "mar")
    return logistic_mask(df, roles, inputs, targets, rate, seed, "mar")


def mnar_logistic(df: DataFrame, roles: Roles, rate: float, seed: int,
                  share: float = OBSERVED_SHARE, exclude_inputs: bool = True) -> dict[str, Column]:
    """As ``mar`` with the inputs then hidden at random; or every feature both input and target."""
    if not exclude_inputs:
        return logistic_mask(df, roles, roles.features, roles.features, rate, seed, "mnarl")
    inputs, targets = logistic_inputs(roles, share, seed, "mnarl")
    hidden = logistic_mask(df, roles, inputs, targets, rate, seed, "mnarl")
    return hidden | mcar(roles, rate, seed, inputs, "mnarl-inputs")


def mnar_self(df: DataFrame, roles: Roles, rate: float, seed: int) -> dict[str, Column]:
    """Every cell hidden by a logistic model of its own value."""
    weights = normal_weights(1, len(roles.features), seed)[0]
    raw = {f: q(f).cast("double") * F.lit(w) for f, w in zip(roles.features, weights)}
    model = _fitted(df, raw, rate)
    return {f: cell_uniform(F.col(roles.key), f, "self", seed) < model.probability(f) for f in roles.features}


def quantile_orders(n: int, quantile: float, cut_at: str) -> dict[str, int]:
    """Order of the threshold values: int(q n)-th smallest. Order 0 is an error."""
    orders = {"lower": int(quantile * n)} if cut_at == "lower" else \
        {"upper": int((1 - quantile) * n)} if cut_at == "upper" else \
        {"lower": int(quantile * n), "upper": int((1 - quantile) * n)}
    if min(orders.values()) < 1:
        raise ValueError(f"quantile {quantile} of {n} rows has no order statistic")
    return orders


def quantile_thresholds(df: DataFrame, features, quantile: float, cut_at: str = "both") -> dict[tuple[str, str], float]:
    orders = quantile_orders(df.count(), quantile, cut_at)
    values = order_statistics(df, {f: (q(f), list(orders.values())) for f in features})
    return {(side, f): v for f in features for side, v in zip(orders, values[f])}


def mnar_quantile(df: DataFrame, roles: Roles, rate: float, seed: int, quantile: float = QUANTILE,
                  share: float = 1 - OBSERVED_SHARE, cut_at: str = "both", overlay: bool = False) -> dict[str, Column]:
    """Cells in the tails of some features hidden at random; optionally more cells anywhere."""
    if cut_at not in ("both", "upper", "lower"):
        raise ValueError("cut_at is one of both, upper, lower")
    targets = pick_names(roles.features, max(int(share * len(roles.features)), 1), "mnarq", seed)
    limits = quantile_thresholds(df, targets, quantile, cut_at)
    hidden = {}
    for f in targets:
        tail = F.lit(False)
        if ("lower", f) in limits:
            tail = tail | (q(f) <= F.lit(limits["lower", f]))
        if ("upper", f) in limits:
            tail = tail | (q(f) >= F.lit(limits["upper", f]))
        hidden[f] = tail & uniform_below(rate, F.col(roles.key), f, "mnarq", seed)
    if overlay:
        for f, c in mcar(roles, rate, seed, salt="mnarq-overlay").items():
            hidden[f] = hidden[f] | c if f in hidden else c
    return hidden


def hidden_cells(df: DataFrame, roles: Roles, mechanism: str, rate: float, seed: int, **options) -> dict[str, Column]:
    """Conditions of the named mechanism. ``df`` holds numbers and category codes, without holes."""
    if mechanism == "MCAR":
        return mcar(roles, rate, seed)
    build = {"MAR": mar, "MNARL": mnar_logistic, "MNARQ": mnar_quantile}
    if mechanism not in build:
        raise ValueError(f"unknown mechanism {mechanism!r}, one of {MECHANISMS}")
    return build[mechanism](df, roles, rate, seed, **options)


def ampute(df: DataFrame, roles: Roles, mechanism: str = "MAR", rate: float = 0.3, seed: int = 0, **options) -> DataFrame:
    """The table with cells hidden."""
    return apply_mask(df, hidden_cells(df, roles, mechanism, rate, seed, **options))
