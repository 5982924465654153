"""Moments of long return panels (obs_id, asset, ret).

Pair moments are one equi self-join on obs_id and one aggregation with map-side
combine; only n means and n^2 covariances ever reach the driver, and
``MAX_ASSETS`` bounds them.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.sources.bars import tail_aligned

TRADING_DAYS = 252
EPSILON = 1e-15
MAX_ASSETS = 5_000


def pair_moments(returns: DataFrame, *extra) -> DataFrame:
    """(a, b, n, cov, ...) for every ordered pair of assets; ``extra``: aggregates over xa and xb."""
    left = returns.select("obs_id", F.col("asset").alias("a"), F.col("ret").alias("xa"))
    right = returns.select("obs_id", F.col("asset").alias("b"), F.col("ret").alias("xb"))
    return left.join(right, "obs_id").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.covar_samp("xa", "xb").alias("cov"), *extra)


@dataclass
class Moments:
    """Of aligned returns: per-observation mean (n) and sample covariance (n x n)."""

    ids: list
    observations: int
    mean: np.ndarray
    cov: np.ndarray

    @property
    def annual(self) -> tuple[np.ndarray, np.ndarray]:
        return self.mean * TRADING_DAYS, self.cov * TRADING_DAYS

    @property
    def corr(self) -> np.ndarray:
        sd = np.sqrt(np.maximum(np.diag(self.cov), 0))
        return np.clip(np.nan_to_num(self.cov / np.outer(sd + EPSILON, sd + EPSILON)), -1, 1)


def moments(returns: DataFrame, align: bool = True) -> Moments:
    """Means and covariances of tail-aligned returns; ValueError below two observations or on non-finite ones."""
    aligned = tail_aligned(returns) if align else returns
    means = aligned.groupBy("asset").agg(F.avg("ret").alias("m"), F.count("ret").alias("n")).orderBy("asset").limit(MAX_ASSETS + 1).collect()
    if len(means) > MAX_ASSETS:
        raise ValueError(f"more than {MAX_ASSETS} assets")
    ids = [r.asset for r in means]
    if not means or means[0].n < 2 or not all(np.isfinite(r.m) for r in means):
        raise ValueError("at least two finite observations are needed")
    rows = pair_moments(aligned).groupBy("a").agg(F.sort_array(F.collect_list(F.struct("b", "cov"))).alias("row"))
    packed = rows.select("a", F.transform("row", lambda x: x["cov"]).alias("row")).orderBy("a").toArrow()  # a row of n numbers for each asset
    cov = packed.column("row").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(ids), len(ids))
    return Moments(ids, means[0].n, np.array([r.m for r in means]), (cov + cov.T) / 2)


def observations(returns: DataFrame, limit: int = 1_000_000) -> tuple[list, np.ndarray]:
    """(assets, T x n matrix) of tail-aligned returns for driver-side programs over scenarios; at most ``limit`` values."""
    aligned = tail_aligned(returns)
    wide = aligned.groupBy("obs_id").agg(F.sort_array(F.collect_list(F.struct("asset", "ret"))).alias("row")).orderBy("obs_id")
    shape = aligned.count()
    if shape > limit:
        raise ValueError(f"{shape} values; this program takes at most {limit}")
    rows = wide.collect()
    ids = [x.asset for x in rows[0].row] if rows else []
    return ids, np.array([[x.ret for x in r.row] for r in rows])


def matrix_frame(spark: SparkSession, ids: list, matrix: np.ndarray, rows: list | None = None) -> DataFrame:
    """(i, j, value) rows of a matrix."""
    left = ids if rows is None else rows
    data = [(str(a), str(b), float(matrix[p, q])) for p, a in enumerate(left) for q, b in enumerate(ids)]
    return spark.createDataFrame(data, "i string, j string, value double")
