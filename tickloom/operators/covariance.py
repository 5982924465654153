"""Covariance estimators over long return panels; each returns (i, j, value)."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.sources.bars import tail_aligned

from .panel import EPSILON, TRADING_DAYS, Moments, matrix_frame, moments, pair_moments


def _scale(annualize: bool, trading_days: int) -> float:
    return float(trading_days if annualize else 1)


def _named(frame: DataFrame, value) -> DataFrame:
    return frame.select(F.col("a").cast("string").alias("i"), F.col("b").cast("string").alias("j"), value.alias("value"))


def sample_cov(returns: DataFrame, *, annualize: bool = True, trading_days: int = TRADING_DAYS, ddof: int = 1) -> DataFrame:
    return _named(pair_moments(tail_aligned(returns)), F.col("cov") * (F.col("n") - 1) / (F.col("n") - ddof) * _scale(annualize, trading_days))


def ledoit_wolf(returns: DataFrame, *, annualize: bool = True, trading_days: int = TRADING_DAYS, target: str = "constant_correlation") -> DataFrame:
    """Shrinkage towards constant correlation (also what ``single_factor`` means here) or a scaled identity.

    The intensity needs no second pass: the spread of the outer products is
    sum(xi^2 xj^2) - T s_ij^2 per pair, with s over T.  Adds ``shrinkage``.
    """
    if target not in ("constant_correlation", "single_factor", "identity"):
        raise ValueError(f"unknown target {target!r}")
    aligned = tail_aligned(returns)
    w = Window.partitionBy("asset")
    centred = aligned.withColumn("ret", F.col("ret") - F.avg("ret").over(w))
    pairs = pair_moments(centred, F.sum(F.col("xa") ** 2 * F.col("xb") ** 2).alias("q"), F.avg(F.col("xa") * F.col("xb")).alias("s"))
    own = F.sqrt(F.max(F.when(F.col("a") == F.col("b"), F.col("cov"))).over(Window.partitionBy("a")))
    other = F.sqrt(F.max(F.when(F.col("a") == F.col("b"), F.col("cov"))).over(Window.partitionBy("b")))
    joined = pairs.withColumns({"sa": own, "sb": other})
    joined = joined.withColumn("rho", F.col("cov") / (F.col("sa") * F.col("sb") + EPSILON))
    whole = joined.agg(F.sqrt(F.count(F.lit(1)).cast("double")).alias("assets"), F.sum("rho").alias("rhos"), F.sum(F.when(F.col("a") == F.col("b"), F.col("cov"))).alias("trace"))
    joined = joined.join(F.broadcast(whole))
    if target == "identity":
        aim = F.when(F.col("a") == F.col("b"), F.col("trace") / F.col("assets")).otherwise(0.0)
    else:
        mean_rho = (F.col("rhos") - F.col("assets")) / F.greatest(F.col("assets") * (F.col("assets") - 1), F.lit(1.0))
        aim = F.when(F.col("a") == F.col("b"), F.col("cov")).otherwise(mean_rho * F.col("sa") * F.col("sb"))
    joined = joined.withColumn("aim", aim)
    terms = joined.agg(
        (F.sum((F.col("cov") - F.col("aim")) ** 2) / F.first("assets")).alias("d2"),
        (F.sum(F.col("q") - F.col("n") * F.col("s") ** 2) / F.first("assets") / F.first("n") ** 2).alias("b2"),
    )
    shrink = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.least("b2", "d2") / F.greatest(F.col("d2"), F.lit(EPSILON))))
    out = joined.join(F.broadcast(terms.select(shrink.alias("shrinkage"))))
    value = (F.col("shrinkage") * F.col("aim") + (1 - F.col("shrinkage")) * F.col("cov")) * _scale(annualize, trading_days)
    return out.select(F.col("a").cast("string").alias("i"), F.col("b").cast("string").alias("j"), value.alias("value"), "shrinkage")


def ewma_cov(returns: DataFrame, *, halflife: float = 60, annualize: bool = True, trading_days: int = TRADING_DAYS) -> DataFrame:
    """Recursion from zero on demeaned rows, in closed form: weight (1 - l) l^(T - k) of row k of T."""
    keep = 1 - math.log(2) / halflife
    aligned = tail_aligned(returns)
    w = Window.partitionBy("asset")
    weight = F.sqrt((1 - keep) * F.pow(F.lit(keep), F.count(F.lit(1)).over(w) - F.col("obs_id")))
    scaled = aligned.withColumn("ret", (F.col("ret") - F.avg("ret").over(w)) * weight)
    return _named(pair_moments(scaled, F.sum(F.col("xa") * F.col("xb")).alias("s")), F.col("s") * _scale(annualize, trading_days))


def gerber_cov(returns: DataFrame, *, threshold: float = 0.5, annualize: bool = True, trading_days: int = TRADING_DAYS) -> DataFrame:
    """Co-movement beyond +-threshold standard deviations around zero, as a correlation."""
    aligned = tail_aligned(returns)
    sd = F.stddev_samp("ret").over(Window.partitionBy("asset"))
    signed = aligned.withColumns({"_sd": sd, "_side": F.when(F.col("ret") > threshold * sd, 1).when(F.col("ret") < -threshold * sd, -1).otherwise(0)})
    left = signed.select("obs_id", F.col("asset").alias("a"), F.col("_side").alias("sa"), F.col("_sd").alias("da"))
    right = signed.select("obs_id", F.col("asset").alias("b"), F.col("_side").alias("sb"), F.col("_sd").alias("db"))
    both = F.col("sa") * F.col("sb")
    pairs = left.join(right, "obs_id").groupBy("a", "b").agg(F.sum(both).alias("net"), F.sum(F.abs(both)).alias("met"), F.first("da").alias("da"), F.first("db").alias("db"))
    rho = F.when(F.col("a") == F.col("b"), 1.0).when(F.col("met") > 0, F.col("net") / F.col("met")).otherwise(0.0)
    return _named(pairs, rho * F.col("da") * F.col("db") * _scale(annualize, trading_days))


# ---- spectral estimators: pair moments from the cluster, one eigenproblem on the driver


def _spectral(returns: DataFrame, rebuild, annualize: bool, trading_days: int) -> DataFrame:
    m = moments(returns)
    return matrix_frame(returns.sparkSession, m.ids, rebuild(m) * _scale(annualize, trading_days))


def _with_volatility(m: Moments, corr: np.ndarray) -> np.ndarray:
    sd = np.sqrt(np.diag(m.cov))
    return (corr + corr.T) / 2 * np.outer(sd, sd)


def shrink_eigenvalues(m: Moments) -> np.ndarray:
    values, vectors = np.linalg.eigh(m.cov)
    values = np.maximum(values, 0)
    mean = np.trace(m.cov) / len(m.ids)
    shrunk = values / np.maximum(1 + len(m.ids) / m.observations * (values - mean) / max(mean, EPSILON), EPSILON)
    return vectors * np.maximum(shrunk, EPSILON) @ vectors.T


def flatten_noise(m: Moments) -> np.ndarray:
    """Eigenvalues of the correlation inside the Marchenko-Pastur band take their mean; the trace stays n."""
    values, vectors = np.linalg.eigh(_exact_corr(m))
    values = np.maximum(values, 0)
    edge = math.sqrt(len(m.ids) / m.observations)
    noise = (values >= (1 - edge) ** 2) & (values <= (1 + edge) ** 2)
    if noise.any():
        values[noise] = values[noise].mean()
    values *= len(m.ids) / max(values.sum(), EPSILON)
    return _with_volatility(m, vectors * values @ vectors.T)


def _exact_corr(m: Moments) -> np.ndarray:
    sd = np.sqrt(np.diag(m.cov))
    return m.cov / np.outer(sd, sd)


def drop_leading(m: Moments, n_detones: int) -> np.ndarray:
    values, vectors = np.linalg.eigh(_exact_corr(m))
    kept = len(m.ids) - min(n_detones, len(m.ids) - 1)
    corr = vectors[:, :kept] * values[:kept] @ vectors[:, :kept].T
    scale = np.sqrt(np.maximum(np.diag(corr), EPSILON))
    return _with_volatility(m, corr / np.outer(scale, scale))


def oracle_approximating(returns: DataFrame, *, annualize: bool = True, trading_days: int = TRADING_DAYS) -> DataFrame:
    return _spectral(returns, shrink_eigenvalues, annualize, trading_days)


def denoise_mp(returns: DataFrame, *, annualize: bool = True, trading_days: int = TRADING_DAYS) -> DataFrame:
    return _spectral(returns, flatten_noise, annualize, trading_days)


def detone_cov(returns: DataFrame, *, n_detones: int = 1, annualize: bool = True, trading_days: int = TRADING_DAYS) -> DataFrame:
    return _spectral(returns, lambda m: drop_leading(m, n_detones), annualize, trading_days)


def principal_factors(m: Moments, n_factors: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(loadings n x k, factor covariance k x k, specific variances) of the leading principal components."""
    values, vectors = np.linalg.eigh(m.cov)
    k = min(n_factors, len(m.ids), m.observations)
    loadings = vectors[:, ::-1][:, :k]
    factor_cov = loadings.T @ m.cov @ loadings
    rest = np.eye(len(m.ids)) - loadings @ loadings.T
    return loadings, factor_cov, np.maximum(np.diag(rest @ m.cov @ rest), 0)


def factor_model_cov(returns: DataFrame, *, n_factors: int = 5, annualize: bool = True, trading_days: int = TRADING_DAYS) -> DataFrame:
    def rebuild(m: Moments) -> np.ndarray:
        loadings, factor_cov, specific = principal_factors(m, n_factors)
        return loadings @ factor_cov @ loadings.T + np.diag(specific)

    return _spectral(returns, rebuild, annualize, trading_days)
