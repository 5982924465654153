"""pyspark.ml estimators over allocators: fit on returns, transform returns to the portfolio's."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.ml import Estimator, Model
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import allocation, risk
from .panel import TRADING_DAYS


class PortfolioModel(Model):
    """Fitted weights; ``transform`` gives (obs_id, ret)."""

    def __init__(self, weights: DataFrame):
        super().__init__()
        self.weights = weights

    def _transform(self, returns: DataFrame) -> DataFrame:
        held = F.broadcast(self.weights.select("asset", "weight"))
        return returns.withColumn("asset", F.col("asset").cast("string")).join(held, "asset").groupBy("obs_id").agg(F.sum(F.col("ret") * F.col("weight")).alias("ret"))

    def score(self, returns: DataFrame) -> float:
        """Annualised Sharpe ratio."""
        row = self.transform(returns).agg(F.avg("ret").alias("m"), F.stddev_samp("ret").alias("s")).first()
        return float(row.m / row.s * math.sqrt(TRADING_DAYS)) if row.s else 0.0


class AllocationEstimator(Estimator):
    """Any allocator of :mod:`allocation` with its options."""

    def __init__(self, allocator: Callable[..., DataFrame], **options):
        super().__init__()
        self.allocator, self.options = allocator, options

    def _fit(self, returns: DataFrame) -> PortfolioModel:
        return PortfolioModel(self.allocator(returns, **self.options))


def mean_risk_estimator(**options) -> AllocationEstimator:
    return AllocationEstimator(risk.mean_risk_optimize, **options)


def hrp_estimator(**options) -> AllocationEstimator:
    return AllocationEstimator(allocation.hierarchical_risk_parity, **options)


def herc_estimator(**options) -> AllocationEstimator:
    return AllocationEstimator(allocation.hierarchical_equal_risk_contribution, **options)


def nco_estimator(**options) -> AllocationEstimator:
    return AllocationEstimator(allocation.nested_clustered_optimization, **options)
