"""Copulas, synthetic returns and entropy pooling over scenario tables."""

from __future__ import annotations

import itertools
import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .panel import observations
from .solvers import Infeasible


def pseudo_observations(returns: DataFrame) -> DataFrame:
    """(obs_id, asset, u): average rank over T + 1 within each asset."""
    w = Window.partitionBy("asset")
    return returns.select("obs_id", "asset", ((F.rank().over(w.orderBy("ret")) + (F.count(F.lit(1)).over(Window.partitionBy("asset", "ret")) - 1) / 2) / (F.count(F.lit(1)).over(w) + 1)).alias("u"))


def inversions(ranks: np.ndarray, block: int = 64) -> int:
    """Pairs of places in which the earlier number is the greater, by merging sorted blocks of twice the size each time."""
    ranks = np.asarray(ranks, dtype=np.int64)
    pad = -len(ranks) % block
    parts = np.concatenate((ranks, np.full(pad, np.iinfo(np.int64).max))).reshape(-1, block)
    later = np.triu(np.ones((block, block), dtype=bool), 1)
    total = sum(int(((p[:, :, None] > p[:, None, :]) & later).sum()) for p in np.array_split(parts, max(1, len(parts) // 256)))
    blocks = list(np.sort(parts, axis=1))
    while len(blocks) > 1:
        merged = []
        for left, right in itertools.zip_longest(blocks[::2], blocks[1::2]):
            if right is not None:
                total += int((len(left) - np.searchsorted(left, right, side="right")).sum())
            merged.append(left if right is None else np.sort(np.concatenate((left, right)), kind="stable"))
        blocks = merged
    return total


def kendall_tau(x: np.ndarray, y: np.ndarray) -> float:
    """Tau-b from tied pairs and the inversions of y in the order of x, in n log n."""
    pairs = lambda counts: float((counts * (counts - 1) // 2).sum())
    x, y = (np.unique(v, return_inverse=True)[1].astype(np.int64) for v in (x, y))
    whole = pairs(np.array([len(x)]))
    in_x, in_y = (pairs(np.bincount(v)) for v in (x, y))
    in_both = pairs(np.unique(x * (len(x) + 1) + y, return_counts=True)[1])
    net = whole - in_x - in_y + in_both - 2 * inversions(y[np.lexsort((y, x))])
    span = (whole - in_x) * (whole - in_y)
    return net / math.sqrt(span) if span else 0.0


def _rank_correlation(x: np.ndarray) -> np.ndarray:
    n = x.shape[1]
    c = np.eye(n)
    for i in range(n):
        for j in range(i):
            c[i, j] = c[j, i] = math.sin(math.pi / 2 * kendall_tau(x[:, i], x[:, j]))
    values, vectors = np.linalg.eigh(c)
    c = vectors * np.maximum(values, 1e-8) @ vectors.T
    d = np.sqrt(np.diag(c))
    return c / np.outer(d, d)


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta_fraction(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    f, c, d = 1.0, 1.0, 0.0
    for k in range(400):
        m = k // 2
        top = 1.0 if k == 0 else m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if k % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / (1 + top * d or 1e-300)
        c = 1 + top / c or 1e-300
        f *= c * d
        if abs(1 - c * d) < 1e-13:
            break
    return front * (f - 1)


def t_cdf(x: float, dof: float) -> float:
    tail = _beta_fraction(dof / 2, 0.5, dof / (dof + x * x)) / 2
    return 1 - tail if x > 0 else tail


def t_ppf(p: np.ndarray, dof: float) -> np.ndarray:
    """Quantiles by bisection on a grid of the distribution function."""
    grid = np.sinh(np.linspace(-9, 9, 4001))
    levels = np.array([t_cdf(float(g), dof) for g in grid])
    return np.interp(p, levels, grid)


@dataclass(frozen=True)
class Copula:
    """family: gaussian, student-t, clayton or gumbel (the last two of two columns)."""

    family: str
    correlation: np.ndarray | None = None
    dof: float = 0.0
    theta: float = 0.0

    @property
    def tail_dependence(self) -> tuple[float, float]:
        """(lower, upper)."""
        if self.family == "clayton":
            return (2 ** (-1 / self.theta) if self.theta > 0 else 0.0), 0.0
        if self.family == "gumbel":
            return 0.0, 2 - 2 ** (1 / self.theta)
        if self.family == "student-t":
            rho = float(self.correlation[0, 1])
            lam = 2 * t_cdf(-math.sqrt((self.dof + 1) * (1 - rho) / (1 + rho)), self.dof + 1)
            return lam, lam
        return 0.0, 0.0

    def sample(self, spark: SparkSession, n: int, seed: int = 42, partitions: int | None = None) -> DataFrame:
        """(id, u_1, ..., u_d): draws are made by the executors from seeded columns."""
        base = spark.range(0, n, 1, partitions or max(1, n // 100_000))
        clip = lambda c: F.least(F.greatest(c, F.lit(1e-12)), F.lit(1 - 1e-12))
        if self.family == "clayton":
            u, v = clip(F.col("a")), clip(F.col("b"))
            second = F.pow(F.pow(u, -self.theta) * (F.pow(v, -self.theta / (1 + self.theta)) - 1) + 1, -1 / self.theta)
            return base.select("id", F.rand(seed).alias("a"), F.rand(seed + 1).alias("b")).select("id", u.alias("u_1"), second.alias("u_2"))
        if self.family == "gumbel":  # a positive stable frailty shared by both
            alpha = 1 / self.theta
            angle, wait = clip(F.col("a")) * math.pi, -F.ln(clip(F.col("b")))
            stable = F.sin(alpha * angle) / F.pow(F.sin(angle), 1 / alpha) * F.pow(F.sin((1 - alpha) * angle) / wait, (1 - alpha) / alpha) if self.theta > 1 else F.lit(1.0)
            draws = base.select("id", *[F.rand(seed + k).alias(c) for k, c in enumerate("abcd")])
            u = [F.exp(-F.pow(-F.ln(clip(F.col(c))) / stable, alpha)) for c in "cd"]
            return draws.select("id", u[0].alias("u_1"), u[1].alias("u_2"))
        d = len(self.correlation)
        root = np.linalg.cholesky(self.correlation)
        dof = int(self.dof)
        squares = [F.randn(seed + d + k).alias(f"s{k}") for k in range(dof)]  # their sum is chi-square, row by row
        draws = base.select("id", *[F.randn(seed + k).alias(f"z{k}") for k in range(d)], *squares)
        scale = F.sqrt(sum((F.col(f"s{k}") ** 2 for k in range(dof)), F.lit(0.0)) / dof) if dof else F.lit(1.0)
        mixed = draws.select("id", *[(sum((F.col(f"z{j}") * float(root[i, j]) for j in range(i + 1)), F.lit(0.0)) / scale).alias(f"x_{i + 1}") for i in range(d)])

        def to_uniform(batches):
            from statistics import NormalDist as Normal

            import pandas as pd

            if dof:
                grid = np.sinh(np.linspace(-9, 9, 4001))
                levels = np.array([t_cdf(float(g), dof) for g in grid])
            for batch in batches:
                x = batch[[f"x_{i + 1}" for i in range(d)]].to_numpy()
                if dof:
                    u = np.interp(x, grid, levels)
                else:
                    u = np.vectorize(Normal().cdf, otypes=[float])(x) if len(x) else x
                out = pd.DataFrame(u, columns=[f"u_{i + 1}" for i in range(d)])
                out.insert(0, "id", batch["id"].to_numpy())
                yield out

        return mixed.mapInPandas(to_uniform, "id long" + "".join(f", u_{i + 1} double" for i in range(d)))


def fit_copula(returns: DataFrame, family: str = "student-t") -> Copula:
    _, x = observations(returns)
    return fit_copula_array(x, family)


def fit_copula_array(x: np.ndarray, family: str) -> Copula:
    if family in ("clayton", "gumbel"):
        if x.shape[1] != 2:
            raise ValueError("this family takes exactly two columns")
        tau = min(max(kendall_tau(x[:, 0], x[:, 1]), 1e-6), 1 - 1e-6)
        return Copula(family, theta=2 * tau / (1 - tau) if family == "clayton" else 1 / (1 - tau))
    if family not in ("gaussian", "student-t"):
        raise ValueError(f"unknown family {family!r}")
    c = _rank_correlation(x)
    if family == "gaussian":
        return Copula(family, c)
    u = (np.argsort(np.argsort(x, axis=0), axis=0) + 1) / (len(x) + 1)
    inverse, log_det = np.linalg.inv(c), np.linalg.slogdet(c)[1]
    d, best = x.shape[1], (-math.inf, 3)
    for dof in range(3, 31):
        z = t_ppf(u, dof)
        joint = math.lgamma((dof + d) / 2) - math.lgamma(dof / 2) - d / 2 * math.log(dof * math.pi) - log_det / 2 - (dof + d) / 2 * np.log1p(np.einsum("ti,ij,tj->t", z, inverse, z) / dof)
        single = math.lgamma((dof + 1) / 2) - math.lgamma(dof / 2) - 0.5 * math.log(dof * math.pi) - (dof + 1) / 2 * np.log1p(z * z / dof)
        best = max(best, (float((joint - single.sum(axis=1)).sum()), dof))
    return Copula(family, c, dof=float(best[1]))


def synthetic_returns(returns: DataFrame, n_samples: int = 10_000, *, family: str = "student-t", seed: int = 42) -> DataFrame:
    """(id, one column per asset): copula draws mapped through each asset's empirical quantiles."""
    spark = returns.sparkSession
    ids, x = observations(returns)
    draws = fit_copula_array(x, family).sample(spark, n_samples, seed)
    out = []
    for k, a in enumerate(ids):
        sorted_x = F.array(*[F.lit(float(v)) for v in np.sort(x[:, k])])
        place = F.col(f"u_{k + 1}") * (len(x) - 1)
        low = F.floor(place).cast("int")
        a0, a1 = F.get(sorted_x, low), F.get(sorted_x, F.least(low + 1, F.lit(len(x) - 1)))
        out.append((a0 + (a1 - a0) * (place - low)).alias(str(a)))
    return draws.select("id", *out)


# ---- entropy pooling ------------------------------------------------------


def entropy_pooling(prior: np.ndarray, a_eq: np.ndarray | None = None, b_eq: Sequence[float] = (), a_ineq: np.ndarray | None = None, b_ineq: Sequence[float] = (), rounds: int = 500) -> np.ndarray:
    """The probabilities nearest to ``prior`` (in relative entropy) with A q = b and G q <= h: damped projected Newton on the dual."""
    prior = np.asarray(prior, dtype=float)
    if (prior < 0).any() or prior.sum() <= 0:
        raise ValueError("the prior must be non-negative and not all zero")
    prior = prior / prior.sum()
    t = len(prior)
    a = np.zeros((0, t)) if a_eq is None else np.atleast_2d(a_eq)
    g = np.zeros((0, t)) if a_ineq is None else np.atleast_2d(a_ineq)
    rows, target = np.vstack((a, g)), np.concatenate((np.asarray(b_eq, dtype=float), np.asarray(b_ineq, dtype=float)))
    free = np.arange(len(rows)) < len(a)
    lam = np.zeros(len(rows))
    scale = np.maximum(np.abs(rows).max(axis=1, initial=0), 1e-12)
    rows, target = rows / scale[:, None], target / scale

    def posterior(lam: np.ndarray) -> tuple[np.ndarray, float]:
        log = np.log(np.maximum(prior, 1e-300)) - lam @ rows
        top = log.max()
        q = np.exp(log - top)
        return q / q.sum(), top + math.log(q.sum()) + lam @ target

    q, value = posterior(lam)
    for _ in range(rounds):
        gradient = target - rows @ q
        active = free | (lam > 0) | (gradient < 0)
        if not active.any() or np.abs(gradient[active]).max() < 1e-11:
            break
        centred = rows[active] - (rows[active] @ q)[:, None]
        step = np.zeros_like(lam)
        step[active] = np.linalg.lstsq(centred * q @ centred.T + 1e-12 * np.eye(active.sum()), -gradient[active], rcond=None)[0]
        size = 1.0
        while size > 1e-10:
            new = lam + size * step
            new[~free] = np.maximum(new[~free], 0)
            q_new, v_new = posterior(new)
            if v_new < value - 1e-16:
                break
            size /= 2
        else:
            break
        lam, q, value = new, q_new, v_new
    if len(a) and np.abs(rows[: len(a)] @ q - target[: len(a)]).max() > 1e-6 or len(g) and (rows[len(a) :] @ q - target[len(a) :]).max() > 1e-6:
        raise Infeasible("no posterior satisfies the views")
    return q


def mean_view_rows(x: np.ndarray, views: Mapping[int, float]) -> tuple[np.ndarray, np.ndarray]:
    """(A, b) for E[x_k] = target."""
    return np.array([x[:, k] for k in views]), np.array(list(views.values()))


def pooled_scenarios(returns: DataFrame, mean_views: Mapping[str, float]) -> DataFrame:
    """(obs_id, probability, effective_scenarios, relative_entropy) under views on asset means."""
    ids, x = observations(returns)
    names = [str(a) for a in ids]
    a, b = mean_view_rows(x, {names.index(k): v for k, v in mean_views.items()})
    prior = np.full(len(x), 1 / len(x))
    q = entropy_pooling(prior, a, b)
    live = q[q > 0]
    effective, relative = math.exp(-(live * np.log(live)).sum()), float((live * np.log(live * len(x))).sum())
    return returns.sparkSession.createDataFrame([(k + 1, float(p), effective, relative) for k, p in enumerate(q)], "obs_id int, probability double, effective_scenarios double, relative_entropy double")


def posterior_moments(returns: DataFrame, probabilities: DataFrame) -> DataFrame:
    """(i, j, mean_i, cov) under scenario probabilities, as one join and one aggregation."""
    rows = returns.join(probabilities.select("obs_id", F.col("probability").alias("q")), "obs_id")
    means = rows.groupBy("asset").agg(F.sum(F.col("q") * F.col("ret")).alias("m"))
    off = rows.join(means, "asset").select("obs_id", "asset", "q", (F.col("ret") - F.col("m")).alias("d"), "m")
    left = off.select("obs_id", "q", F.col("asset").alias("i"), F.col("d").alias("di"), F.col("m").alias("mean_i"))
    right = off.select("obs_id", F.col("asset").alias("j"), F.col("d").alias("dj"))
    return left.join(right, "obs_id").groupBy("i", "j").agg(F.first("mean_i").alias("mean_i"), F.sum(F.col("q") * F.col("di") * F.col("dj")).alias("cov"))

