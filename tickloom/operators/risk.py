"""Seventeen risk measures per group of returns, and portfolios that are least in one of them."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .allocation import Constraints, _result
from .panel import EPSILON, moments, observations
from .solvers import minimize_on_box

PLAIN = ("variance", "std", "semi_variance", "mad", "flpm", "gini_md", "var", "cvar", "worst", "entropic")
PATH = ("mdd", "avg_drawdown", "dar", "cdar", "ulcer")
SEARCHED = ("evar", "edar")
RISK_MEASURES = (*PLAIN, "evar", *PATH, "edar")


def drawdowns(returns: DataFrame, keys: Sequence[str], order: str, ret: str = "ret", compounded: bool = True) -> DataFrame:
    """Adds ``depth`` (>= 0): fall from the highest wealth so far; the first wealth is the first peak."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    wealth = F.product(1 + F.col(ret)).over(w) if compounded else 1 + F.sum(ret).over(w)
    return returns.withColumn("_w", wealth).withColumn("depth", 1 - F.col("_w") / F.max("_w").over(w)).drop("_w")


def entropic_at_risk(losses: np.ndarray, beta: float) -> float:
    """inf over z > 0 of z ln(mean exp(loss / z) / (1 - beta)): golden section over ln z in [-20, 20]."""
    if not len(losses):
        return 0.0
    top, tail = losses.max(), max(1 - beta, EPSILON)

    def value(log_z: float) -> float:
        z = math.exp(log_z)
        return z * (top / z + math.log(np.exp((losses - top) / z).mean()) - math.log(tail))

    a, b, golden = -20.0, 20.0, (math.sqrt(5) - 1) / 2
    c, d = b - golden * (b - a), a + golden * (b - a)
    fc, fd = value(c), value(d)
    while b - a > 1e-9:
        if fc < fd:
            b, d, fd = d, c, fc
            c = b - golden * (b - a)
            fc = value(c)
        else:
            a, c, fc = c, d, fd
            d = a + golden * (b - a)
            fd = value(d)
    return min(fc, fd)


def all_risk_measures(returns: DataFrame, keys: Sequence[str] = ("strategy",), order: str = "obs_id", ret: str = "ret", *, beta: float = 0.95, theta: float = 1.0, compounded: bool = True, measures: Sequence[str] = RISK_MEASURES) -> DataFrame:
    """A row per key with every measure (or those asked for): one exchange, and one kernel over each key's returns in order."""
    keys = list(keys)
    clean = returns.where(F.col(ret).isNotNull() & ~F.isnan(ret)).select(*keys, F.col(order).alias("_at"), F.col(ret).cast("double").alias("_r"))
    kinds = dict(clean.dtypes)

    def measure(rows: pd.DataFrame) -> pd.DataFrame:
        r = rows.sort_values("_at", kind="stable")["_r"].to_numpy()
        fall = depths(r, compounded)
        found = {k: risk_of(r, k, beta, theta, fall) for k in measures}
        return pd.DataFrame({k: [rows[k].iloc[0]] for k in keys} | {k: [None if np.isnan(v) else v] for k, v in found.items()})

    return clean.groupBy(*keys).applyInPandas(measure, ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), *(f"{k} double" for k in measures)]))


def compute_risk(returns: DataFrame, measure: str = "variance", **options) -> DataFrame:
    if measure not in RISK_MEASURES:
        raise ValueError(f"unknown risk measure {measure!r}")
    return all_risk_measures(returns, **options, measures=[measure]).withColumnRenamed(measure, "risk")


def depths(r: np.ndarray, compounded: bool = True) -> np.ndarray:
    """Fall from the highest wealth so far at each step; the first wealth is the first peak."""
    wealth = np.cumprod(1 + r) if compounded else 1 + np.cumsum(r)
    return 1 - wealth / np.maximum.accumulate(wealth)


def risk_of(r: np.ndarray, measure: str, beta: float = 0.95, theta: float = 1.0, fall: np.ndarray | None = None) -> float:
    """One measure of returns in order; ``fall``: their depths, if known."""
    if measure in PATH or measure == "edar":
        d = depths(r) if fall is None else fall
        if measure == "edar":
            return entropic_at_risk(d, beta)
        at = np.quantile(d, beta)
        return float({"mdd": d.max(), "avg_drawdown": d.mean(), "dar": at, "cdar": d[d >= at].mean(), "ulcer": math.sqrt((d * d).mean())}[measure])
    if measure == "evar":
        return entropic_at_risk(-r, beta)
    if measure in ("variance", "std"):
        spread = r.var(ddof=1) if len(r) > 1 else 0.0
        return float(spread if measure == "variance" else math.sqrt(spread))
    if measure in ("var", "cvar"):
        at = np.quantile(r, max(1 - beta, EPSILON))
        return float(-at if measure == "var" else -r[r <= at].mean())
    if measure == "gini_md":
        n = len(r)
        return float(2 / n / n * ((2 * np.arange(1, n + 1) - n - 1) @ np.sort(r)))
    if measure == "entropic":
        low = (-theta * r).max()
        return float((low + math.log(np.exp(-theta * r - low).mean())) / theta)
    off = r - r.mean()
    return float({"semi_variance": (np.minimum(off, 0) ** 2).mean(), "mad": np.abs(off).mean(), "flpm": np.maximum(-r, 0).mean(), "worst": -r.min()}[measure])


def mean_risk_optimize(returns: DataFrame, *, risk_measure: str = "cvar", objective: str = "min_risk", beta: float = 0.95, risk_aversion: float = 1.0, min_weight: float = 0.0, max_weight: float = 1.0, budget: float = 1.0, rf: float = 0.0) -> DataFrame:
    """min_risk, max_ratio, max_return (no risk limit) or max_utility in any measure, by projected search with restarts."""
    if risk_measure not in RISK_MEASURES:
        raise ValueError(f"unknown risk measure {risk_measure!r}")
    m = moments(returns)
    _, r = observations(returns)
    mean = r.mean(axis=0)
    goals = {
        "min_risk": lambda w: risk_of(r @ w, risk_measure, beta),
        "max_ratio": lambda w: -(mean @ w - rf) / max(risk_of(r @ w, risk_measure, beta), EPSILON),
        "max_return": lambda w: -(mean @ w),
        "max_utility": lambda w: risk_aversion * risk_of(r @ w, risk_measure, beta) - mean @ w,
    }
    if objective not in goals:
        raise ValueError(f"unknown objective {objective!r}")
    low, high = Constraints(min_weight=min_weight, max_weight=max_weight, long_only=min_weight >= 0).bounds()
    w = minimize_on_box(goals[objective], len(mean), low, high, budget)
    risk = risk_of(r @ w, risk_measure, beta)
    return _result(returns.sparkSession, m.ids, w, f"mean_risk_{objective}", *m.annual, risk_measure=risk_measure, risk=risk, ratio=float((mean @ w - rf) / max(risk, EPSILON)))


def monte_carlo_var(spark, weights: Sequence[float], mean: Sequence[float], cov: np.ndarray, *, horizon: int = 21, paths: int = 100_000, value: float = 1.0, seed: int = 42) -> DataFrame:
    """(var95, es95, var99, es99) in percent of normal paths; paths are generated and ranked on the executors."""
    w = np.asarray(weights)
    mu, sd = float(w @ np.asarray(mean)), float(np.sqrt(max(w @ np.asarray(cov) @ w, 0)))
    # the sum of independent normal steps is one normal draw per path
    ends = spark.range(paths).select((value * (F.randn(seed) * (sd * math.sqrt(horizon)) + mu * horizon)).alias("pnl"))
    cuts = ends.agg(*[F.percentile("pnl", p).alias(f"q{q}") for q, p in ((95, 0.05), (99, 0.01))])
    out: list[Column] = []
    for q in (95, 99):
        out += [(-F.first(f"q{q}") * 100 / value).alias(f"var{q}"), (-F.avg(F.when(F.col("pnl") <= F.col(f"q{q}"), F.col("pnl"))) * 100 / value).alias(f"es{q}")]
    return ends.join(F.broadcast(cuts)).agg(*out)

