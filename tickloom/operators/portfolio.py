"""Costs, attribution, factor models, pre-selection, cross-validation and plot data over DataFrames."""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import add
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.functions.exprs import EPSILON, TRADING_DAYS
from tickloom.sources.bars import tail_aligned

from .covariance import principal_factors
from .panel import moments
from .solvers import leaf_order, linkage

Number = Column | float


def _c(x: Number) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


# ---- costs (basis points, as column expressions) --------------------------


def linear_impact(notional: Number, adv: Number, *, coefficient: float = 0.1) -> Column:
    return F.when(_c(adv) > EPSILON, _c(notional) / _c(adv) * (coefficient * 1e4)).otherwise(0.0)


def sqrt_impact(notional: Number, adv: Number, *, coefficient: float = 0.1, volatility: Number = 0.0, exponent: float = 0.5) -> Column:
    vol = F.when(_c(volatility) > EPSILON, _c(volatility)).otherwise(1.0)
    return F.when(_c(adv) > EPSILON, F.pow(F.abs(_c(notional)) / _c(adv), exponent) * vol * (coefficient * 1e4)).otherwise(0.0)


def spread_cost(bid_ask_spread_bps: Number) -> Column:
    return _c(bid_ask_spread_bps) / 2


def almgren_chriss(notional: Number, adv: Number, volatility: Number, *, gamma: float = 0.314, eta: float = 0.142, alpha: float = 0.6, beta: float = 0.6, participation_rate: float = 0.1) -> Column:
    """Struct of permanent, temporary and total impact; all zero without volume or volatility."""
    live = (_c(adv) > EPSILON) & (_c(volatility) > EPSILON)
    permanent = F.when(live, F.pow(F.abs(_c(notional)) / _c(adv), alpha) * _c(volatility) * (gamma * 1e4)).otherwise(0.0)
    temporary = F.when(live, _c(volatility) * (eta * participation_rate**beta * 1e4)).otherwise(0.0)
    return F.struct(permanent.alias("permanent_cost_bps"), temporary.alias("temporary_cost_bps"), (permanent + temporary).alias("total_cost_bps"))


def total_cost(notional: Number, adv: Number, volatility: Number, *, bid_ask_bps: float = 5.0, commission_bps: float = 0.0, impact_model: str = "sqrt", impact_coefficient: float = 0.1, impact_exponent: float = 0.5) -> Column:
    """Struct of spread, impact, commission and total."""
    if impact_model == "sqrt":
        impact = sqrt_impact(notional, adv, coefficient=impact_coefficient, volatility=volatility, exponent=impact_exponent)
    elif impact_model == "linear":
        impact = linear_impact(notional, adv, coefficient=impact_coefficient)
    elif impact_model == "almgren_chriss":
        impact = almgren_chriss(notional, adv, volatility)["total_cost_bps"]
    else:
        raise ValueError(f"unknown impact model {impact_model!r}")
    parts = {"spread_cost_bps": spread_cost(bid_ask_bps), "impact_cost_bps": impact, "commission_bps": F.lit(float(commission_bps))}
    return F.struct(*[v.alias(k) for k, v in parts.items()], reduce(add, parts.values()).alias("total_cost_bps"))


@dataclass(frozen=True)
class CostModel:
    spread_bps: float = 5.0
    impact_coefficient: float = 0.1
    impact_exponent: float = 0.5
    impact_model: str = "sqrt"
    commission_bps: float = 0.0

    def estimate(self, notional: Number, adv: Number = 0.0, volatility: Number = 0.0) -> Column:
        return total_cost(notional, adv, volatility, bid_ask_bps=self.spread_bps, commission_bps=self.commission_bps, impact_model=self.impact_model, impact_coefficient=self.impact_coefficient, impact_exponent=self.impact_exponent)["total_cost_bps"]


def turnover_analysis(current: DataFrame, target: DataFrame, *, model: CostModel = CostModel(), portfolio_value: float = 1e6) -> DataFrame:
    """(symbol, turnover, cost_bps, share) of every symbol of either side; ``target`` may carry adv and volatility."""
    more = [c for c in ("adv", "volatility") if c in target.columns]
    both = current.select("symbol", F.col("weight").alias("w0")).join(target.select("symbol", F.col("weight").alias("w1"), *more), "symbol", "full_outer")
    moved = F.abs(F.coalesce("w1", F.lit(0.0)) - F.coalesce("w0", F.lit(0.0)))
    adv, vol = (F.coalesce(c, F.lit(0.0)) if c in more else F.lit(0.0) for c in ("adv", "volatility"))
    return both.select("symbol", moved.alias("turnover"), model.estimate(moved * portfolio_value, adv, vol).alias("cost_bps")).withColumn("weighted_cost_bps", F.col("turnover") * F.col("cost_bps"))


def turnover_summary(analysis: DataFrame) -> DataFrame:
    return analysis.agg((F.sum("turnover") / 2).alias("one_way_turnover"), F.sum("turnover").alias("two_way_turnover"), F.sum("weighted_cost_bps").alias("estimated_cost_bps"))


def alpha_decay_capacity(holdings: DataFrame, gross_alpha_bps: float, annual_turnover: float, *, keys: Sequence[str] = (), spread_bps: float = 5.0, commission_bps: float = 0.0, impact_coefficient: float = 0.1, impact_exponent: float = 0.5, max_participation: float = 0.1, max_aum: float = 1e12) -> DataFrame:
    """Assets under management at which costs eat the alpha, or a position reaches its share of volume.

    With one exponent for all holdings impact is A * aum^e, so the break-even has a
    closed form and the whole estimate is one aggregation over (symbol, weight,
    adv_usd [, volatility]).
    """
    vol = F.coalesce("volatility", F.lit(0.0)) if "volatility" in holdings.columns else F.lit(0.0)
    slope = F.col("weight") * sqrt_impact(F.col("weight"), F.col("adv_usd"), coefficient=impact_coefficient, volatility=vol, exponent=impact_exponent)
    cap = F.col("adv_usd") * max_participation / F.col("weight")
    a = holdings.groupBy(*keys).agg(F.sum(slope).alias("slope"), F.sum("weight").alias("held"), F.min(F.struct(cap.alias("cap"), F.col("symbol").cast("string").alias("symbol"))).alias("floor"))
    fixed = F.col("held") * (spread_bps / 2 + commission_bps) * annual_turnover
    left = gross_alpha_bps - fixed
    cost = lambda aum: fixed + annual_turnover * F.col("slope") * F.pow(aum, impact_exponent)
    even = F.pow(F.greatest(left, F.lit(0.0)) / F.greatest(annual_turnover * F.col("slope"), F.lit(1e-300)), 1 / impact_exponent)
    alpha_cap = F.when(gross_alpha_bps - cost(F.lit(1.0)) <= 0, 0.0).when(gross_alpha_bps - cost(F.lit(max_aum)) > 0, max_aum).otherwise(even)
    out = a.withColumn("alpha_decay_capacity_usd", alpha_cap).withColumn("participation_capacity_usd", F.col("floor.cap"))
    out = out.withColumn("capacity_usd", F.least("alpha_decay_capacity_usd", "participation_capacity_usd"))
    binding = F.when(F.col("alpha_decay_capacity_usd") <= F.col("participation_capacity_usd"), "alpha_decay").otherwise("participation")
    return out.select(*keys, "capacity_usd", "alpha_decay_capacity_usd", "participation_capacity_usd", binding.alias("binding_constraint"), F.when(binding == "participation", F.col("floor.symbol")).alias("bottleneck_symbol"), (gross_alpha_bps - cost(F.col("capacity_usd"))).alias("net_alpha_bps_at_capacity"))


# ---- attribution ----------------------------------------------------------


def brinson_fachler(portfolio: DataFrame, benchmark: DataFrame, sectors: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, sector, allocation, selection, interaction, total) in percent; sector NULL is the total of a period.

    portfolio, benchmark: (keys, asset, weight, ret), a period for each value of the
    keys; sectors: (asset, sector); assets without a sector are left out.
    """
    of = [*keys, "sector"]

    def side(frame: DataFrame, name: str) -> DataFrame:
        joined = frame.join(sectors.where("sector is not null"), "asset").groupBy(*of).agg(F.sum("weight").alias("w"), F.sum(F.col("weight") * F.coalesce("ret", F.lit(0.0))).alias("wr"))
        return joined.select(*of, F.col("w").alias(f"w{name}"), F.when(F.col("w") > EPSILON, F.col("wr") / F.col("w")).otherwise(0.0).alias(f"r{name}"))

    names = sectors.where("sector is not null").select("sector").distinct()
    periods = portfolio.select(*keys).unionByName(benchmark.select(*keys)).distinct() if keys else None
    rows = names if periods is None else periods.join(names)  # periods times sectors, the rows of the result
    both = rows.join(side(portfolio, "p"), of, "left").join(side(benchmark, "b"), of, "left").fillna(0.0, ["wp", "rp", "wb", "rb"])
    whole = F.sum(F.col("wb") * F.col("rb")).over(Window.partitionBy(*keys))  # of a period's sectors
    dw, dr = F.col("wp") - F.col("wb"), F.col("rp") - F.col("rb")
    parts = both.withColumn("total_b", whole).select(*of, (dw * (F.col("rb") - F.col("total_b")) * 100).alias("allocation"), (F.col("wb") * dr * 100).alias("selection"), (dw * dr * 100).alias("interaction"))
    effects = ["allocation", "selection", "interaction", "total"]
    parts = parts.withColumn("total", F.col("allocation") + F.col("selection") + F.col("interaction"))
    kind = dict(parts.dtypes)["sector"]
    total = parts.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in effects]).select(*keys, F.lit(None).cast(kind).alias("sector"), *effects)
    return parts.unionByName(total)


def alpha_beta(pairs: DataFrame, keys: Sequence[str] = (), y: str = "ret", x: str = "bench", *, annualize: bool = True, trading_days: int = TRADING_DAYS) -> DataFrame:
    """alpha, beta, tracking error, information ratio and R2 of y on x, per key."""
    scale = float(trading_days if annualize else 1)
    whole = pairs.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    # the guards keep a constant benchmark from dividing by zero
    a = whole.groupBy(*keys).agg(F.covar_samp(x, y).alias("c"), F.var_samp(x).alias("vx"), F.var_samp(y).alias("vy"), F.avg(x).alias("mx"), F.avg(y).alias("my"), F.stddev_samp(F.col(y) - F.col(x)).alias("te"))
    beta = F.when(F.col("vx") > EPSILON, F.col("c") / F.col("vx")).otherwise(0.0)
    r2 = F.when((F.col("vx") > EPSILON) & (F.col("vy") > EPSILON), F.col("c") * F.col("c") / (F.col("vx") * F.col("vy"))).otherwise(0.0)
    alpha, te = (F.col("my") - beta * F.col("mx")) * scale, F.col("te") * math.sqrt(scale)
    return a.select(*keys, alpha.alias("alpha"), beta.alias("beta"), te.alias("tracking_error"), F.when(te > EPSILON, alpha / te).otherwise(0.0).alias("information_ratio"), r2.alias("r_squared"))


def rolling_attribution(pairs: DataFrame, keys: Sequence[str] = ("strategy",), order: str = "obs_id", y: str = "ret", x: str = "bench", *, window: int = 60, trading_days: int = TRADING_DAYS) -> DataFrame:
    """alpha and beta over the ``window`` rows before each row (the row itself is not part of its window)."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(-window, -1)
    full = F.count(F.col(x) * F.col(y)).over(w) == window
    vx = F.var_samp(x).over(w)
    rows = pairs.withColumns({"_f": full, "_c": F.covar_samp(x, y).over(w), "_v": vx, "_mx": F.avg(x).over(w), "_my": F.avg(y).over(w)}).where("_f")
    beta = F.when(F.col("_v") > EPSILON, F.col("_c") / F.col("_v")).otherwise(0.0)
    return rows.select(*keys, order, ((F.col("_my") - beta * F.col("_mx")) * trading_days).alias("alpha"), beta.alias("beta"))


def normal_equations(rows: DataFrame, y: str, factors: Sequence[str]) -> tuple[np.ndarray, np.ndarray, float, float, int]:
    """(X'X, X'y, y'y, sum y, T) with an intercept first: one aggregation, (k + 1)^2 numbers."""
    names = ["_one", *factors]
    col = lambda n: F.lit(1.0) if n == "_one" else F.col(f"`{n}`")
    a = [F.sum(col(p) * col(q)).alias(f"x{i}_{j}") for i, p in enumerate(names) for j, q in enumerate(names) if i <= j]
    a += [F.sum(col(p) * F.col(y)).alias(f"y{i}") for i, p in enumerate(names)]
    r = rows.dropna(subset=[y, *factors]).agg(*a, F.sum(F.col(y) * F.col(y)).alias("yy"), F.count(F.lit(1)).alias("n")).first()
    k = len(names)
    xx = np.array([[r[f"x{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)], dtype=float)
    xy = np.array([r[f"y{i}"] for i in range(k)], dtype=float)
    return xx, xy, float(r.yy), float(xy[0]), int(r.n)


def factor_attribution(rows: DataFrame, y: str, factors: Sequence[str], *, trading_days: int = TRADING_DAYS) -> DataFrame:
    """(term, coefficient, t_stat, contribution) of a regression with intercept ('alpha'), with R2, appraisal ratio and observations beside."""
    if not factors:
        raise ValueError("at least one factor is needed")
    spark = rows.sparkSession
    xx, xy, yy, sy, n = normal_equations(rows, y, factors)
    if n <= len(factors) + 1:
        raise ValueError("too few observations for these factors")
    coefficient = np.linalg.lstsq(xx, xy, rcond=None)[0]
    left = max(yy - coefficient @ xy, 0.0)
    spread = yy - sy * sy / n
    r2 = 1 - left / spread if spread > 0 else 0.0
    error = np.sqrt(np.maximum(np.diag(np.linalg.pinv(xx)) * left / (n - len(xx)), 0))
    t = np.divide(coefficient, error, out=np.zeros_like(coefficient), where=error > 0)
    sd = math.sqrt(left / (n - 1))
    appraisal = coefficient[0] / sd * math.sqrt(trading_days) if sd > 0 else 0.0
    mean = xx[0] / n
    data = [(name, float(b), float(v), float(b * m * trading_days), float(r2), float(appraisal), n) for name, b, v, m in zip(["alpha", *factors], coefficient, t, mean)]
    return spark.createDataFrame(data, "term string, coefficient double, t_stat double, contribution double, r_squared double, appraisal_ratio double, observations long")


def risk_attribution(spark: SparkSession, weights: Mapping[str, float], loadings: np.ndarray, factor_cov: np.ndarray, specific_var: Sequence[float], factor_names: Sequence[str] | None = None) -> DataFrame:
    """(part, variance, share): each factor's own variance, the factors together, the specific part and the total."""
    w = np.array(list(weights.values()))
    exposure = w @ np.asarray(loadings)
    factor = float(exposure @ factor_cov @ exposure)
    specific = float((w * w) @ np.asarray(specific_var))
    total = factor + specific
    names = list(factor_names or (f"factor_{k + 1}" for k in range(len(exposure))))
    rows = [(n, float(e * e * factor_cov[k][k])) for k, (n, e) in enumerate(zip(names, exposure))] + [("factor", factor), ("specific", specific), ("total", total)]
    return spark.createDataFrame([(n, v, v / total if total > EPSILON else 0.0) for n, v in rows], "part string, variance double, share double")


# ---- factor models --------------------------------------------------------


def factor_exposure(weights: DataFrame, loadings: DataFrame) -> DataFrame:
    """(factor, exposure) from (asset, weight) and (asset, factor, loading)."""
    return weights.join(loadings, "asset").groupBy("factor").agg(F.sum(F.col("weight") * F.col("loading")).alias("exposure"))


def statistical_factors(returns: DataFrame, *, n_factors: int = 5) -> tuple[DataFrame, DataFrame]:
    """((asset, factor, loading, specific_variance), (factor, variance, explained_ratio)), annualised."""
    spark, m = returns.sparkSession, moments(returns)
    loadings, factor_cov, specific = principal_factors(m, n_factors)
    total = np.trace(m.cov)
    long = [(str(a), k + 1, float(loadings[i, k]), float(specific[i] * TRADING_DAYS)) for i, a in enumerate(m.ids) for k in range(loadings.shape[1])]
    var = [(k + 1, float(factor_cov[k, k] * TRADING_DAYS), float(factor_cov[k, k] / total)) for k in range(loadings.shape[1])]
    return spark.createDataFrame(long, "asset string, factor int, loading double, specific_variance double"), spark.createDataFrame(var, "factor int, variance double, explained_ratio double")


def factor_returns(returns: DataFrame, loadings: DataFrame) -> DataFrame:
    """(obs_id, factor, value): demeaned returns projected on loadings."""
    centred = returns.withColumn("x", F.col("ret") - F.avg("ret").over(Window.partitionBy("asset"))).withColumn("asset", F.col("asset").cast("string"))
    return centred.join(loadings.select("asset", "factor", "loading"), "asset").groupBy("obs_id", "factor").agg(F.sum(F.col("x") * F.col("loading")).alias("value"))


def fundamental_factors(returns: DataFrame, attributes: DataFrame, *, momentum_window: int = 252, trading_days: int = TRADING_DAYS) -> DataFrame:
    """(factor, premium, t_stat, r_squared) of cross-sectional regressions on market, size [, value] [, momentum].

    ``attributes``: (asset, market_cap [, book_value]).  Exposures do not change over
    time, so every date's regression is one product with a fixed pseudo-inverse.
    """
    spark, aligned = returns.sparkSession, tail_aligned(returns).withColumn("asset", F.col("asset").cast("string"))
    back = Window.partitionBy("asset").orderBy(F.desc("obs_id"))
    recent = aligned.withColumn("k", F.row_number().over(back)).where(f"k > 21 and k <= {momentum_window}").groupBy("asset").agg((F.product(1 + F.col("ret")) - 1).alias("mom"), F.count("ret").alias("past"))
    sizes = aligned.groupBy("asset").agg(F.count("ret").alias("n"))
    table = sizes.join(attributes.withColumn("asset", F.col("asset").cast("string")), "asset", "left").join(recent, "asset", "left").orderBy("asset").toPandas()
    cap = table["market_cap"].fillna(1.0).clip(lower=EPSILON)
    columns = {"market": np.ones(len(table)), "size": -(np.log(cap) - np.log(cap).mean())}
    if "book_value" in table:
        ratio = table["book_value"].fillna(0.0) / cap
        columns["value"] = ratio - ratio.mean()
    if len(table) and table["n"].min() >= momentum_window:
        moved = table["mom"].where(table["n"] > momentum_window, 0.0).fillna(0.0)
        columns["momentum"] = moved - moved.mean()
    b = np.column_stack([np.asarray(v, dtype=float) for v in columns.values()])
    inverse = np.linalg.pinv(b)
    weights = spark.createDataFrame([(a, f, float(inverse[k, i]), float(b[i, k])) for i, a in enumerate(table["asset"]) for k, f in enumerate(columns)], "asset string, factor string, p double, loading double")
    premia = aligned.join(weights, "asset").groupBy("obs_id", "factor").agg(F.sum(F.col("ret") * F.col("p")).alias("f"))
    fitted = aligned.join(weights.select("asset", "factor", "loading"), "asset").join(premia, ["obs_id", "factor"]).groupBy("obs_id", "asset").agg(F.first("ret").alias("ret"), F.sum(F.col("f") * F.col("loading")).alias("fit"))
    fit = fitted.agg((1 - F.sum((F.col("ret") - F.col("fit")) ** 2) / F.greatest(F.var_pop("ret") * F.count("ret"), F.lit(EPSILON))).alias("r_squared"))
    stats = premia.groupBy("factor").agg((F.avg("f") * trading_days).alias("premium"), (F.avg("f") / F.greatest(F.stddev_samp("f"), F.lit(EPSILON)) * F.sqrt(F.count("f"))).alias("t_stat"))
    return stats.join(F.broadcast(fit))


def rolling_factor_exposure(rows: DataFrame, y: str, factors: Sequence[str], keys: Sequence[str] = ("asset",), order: str = "obs_id", *, window: int = 60) -> DataFrame:
    """Betas without intercept over the ``window`` rows before each row: rolling products by windows, small solves in Arrow batches."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(-window, -1)
    pairs = [(i, j) for i in range(len(factors)) for j in range(i, len(factors))]
    cols = {f"_x{i}_{j}": F.sum(F.col(factors[i]) * F.col(factors[j])).over(w) for i, j in pairs} | {f"_y{i}": F.sum(F.col(f) * F.col(y)).over(w) for i, f in enumerate(factors)}
    ready = rows.withColumns(cols | {"_n": F.count(F.lit(1)).over(w)}).where(F.col("_n") == window).select(*keys, order, *cols)
    kinds = {f.name: f.dataType.simpleString() for f in ready.schema.fields}
    names = [f"beta_{f}" for f in factors]

    def solve(batches: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        k = len(factors)
        for batch in batches:
            xx = np.zeros((len(batch), k, k))
            for i, j in pairs:
                xx[:, i, j] = xx[:, j, i] = batch[f"_x{i}_{j}"]
            xy = batch[[f"_y{i}" for i in range(k)]].to_numpy()[:, :, None]
            out = batch[[*keys, order]].copy()
            out[names] = (np.linalg.pinv(xx) @ xy)[:, :, 0] if len(batch) else np.zeros((0, k))
            yield out

    return ready.mapInPandas(solve, ", ".join(f"`{c}` {kinds[c]}" for c in [*keys, order]) + "".join(f", `{n}` double" for n in names))


# ---- pre-selection (each keeps the rows of the assets it selects) ---------

#: Statistics of returns that differ by less are equal: sums of the same numbers in another order do.
TIE = 1e-12


def drop_zero_variance(returns: DataFrame, *, tol: float = 1e-12) -> DataFrame:
    kept = returns.groupBy("asset").agg(F.var_pop("ret").alias("v")).where(F.col("v") > tol)
    return returns.join(kept.select("asset"), "asset", "left_semi")


def select_complete_assets(returns: DataFrame, *, min_obs: int | None = None) -> DataFrame:
    counts = returns.groupBy("asset").agg(F.count("ret").alias("n"))
    least = counts.agg(F.max("n").alias("least")) if min_obs is None else counts.sparkSession.range(1).select(F.lit(min_obs).alias("least"))
    return returns.join(counts.join(F.broadcast(least)).where("n >= least").select("asset"), "asset", "left_semi")


def drop_highly_correlated(returns: DataFrame, *, threshold: float = 0.95) -> DataFrame:
    """Of the most correlated pair, the asset of greater mean absolute correlation goes, until none exceeds the threshold.

    What is equal within ``TIE`` is equal: the first of such pairs counts, and of equal means its first asset goes.
    """
    m = moments(returns)
    c = np.abs(m.corr)
    np.fill_diagonal(c, 0)
    live = list(range(len(m.ids)))
    while len(live) > 1:
        sub = c[np.ix_(live, live)]
        if sub.max() <= threshold:
            break
        i, j = divmod(int(np.argmax((sub >= sub.max() - TIE) & (sub > threshold))), len(live))
        mean = sub.sum(axis=1) / (len(live) - 1)
        live.pop(i if mean[i] >= mean[j] - TIE else j)
    return returns.where(F.col("asset").isin([m.ids[k] for k in live]))


def _scores(returns: DataFrame, measure: str) -> DataFrame:
    if measure not in ("sharpe", "return", "volatility"):
        raise ValueError(f"unknown measure {measure!r}")
    sd = F.stddev_samp("ret")
    value = {"sharpe": F.when(sd > EPSILON, F.avg("ret") / sd).otherwise(0.0), "return": F.avg("ret"), "volatility": sd}[measure]
    return returns.groupBy("asset").agg(value.alias("score"))


def select_k_extremes(returns: DataFrame, *, k: int, measure: str = "sharpe", highest: bool = True) -> DataFrame:
    best = _scores(returns, measure).orderBy(F.desc("score") if highest else F.asc("score"), "asset").limit(k)
    return returns.join(best.select("asset"), "asset", "left_semi")


def select_non_dominated(returns: DataFrame, *, risk_measure: str = "volatility") -> DataFrame:
    """Assets that no other beats in mean and risk (volatility, or the mean loss of the worst 5 percent).

    In order of falling mean an asset is beaten exactly if one before it has no more
    risk, or one of equal mean less, so running minima replace the comparison of all
    pairs.  What is equal within ``TIE`` is equal, so assets of the same returns stay together.
    """
    if risk_measure == "volatility":
        risk = returns.groupBy("asset").agg(F.avg("ret").alias("m"), F.stddev_samp("ret").alias("risk"))
    elif risk_measure == "cvar":
        cut = returns.withColumn("q", F.percentile("ret", 0.05).over(Window.partitionBy("asset")))
        risk = cut.groupBy("asset").agg(F.avg("ret").alias("m"), (-F.avg(F.when(F.col("ret") <= F.col("q"), F.col("ret")))).alias("risk"))
    else:
        raise ValueError(f"unknown risk measure {risk_measure!r}")
    least = "min(risk) OVER (ORDER BY m DESC RANGE BETWEEN UNBOUNDED PRECEDING AND {}D {})"
    ranked = risk.withColumns({"above": F.expr(least.format(TIE, "PRECEDING")), "level": F.expr(least.format(TIE, "FOLLOWING"))})
    front = ranked.where(f"(above is null or risk < above - {TIE}D) and risk <= level + {TIE}D")
    return returns.join(front.select("asset"), "asset", "left_semi")


# ---- cross-validation -----------------------------------------------------


def _parts(n: int, k: int) -> list[tuple[int, int]]:
    """Near-equal runs of 0..n-1, longer ones first."""
    edges = np.cumsum([0] + [n // k + (i < n % k) for i in range(k)])
    return list(zip(edges[:-1].tolist(), edges[1:].tolist()))


@dataclass(frozen=True)
class WalkForward:
    """``n_splits`` test blocks at the end; the train set grows, or keeps ``train_size``."""

    n_splits: int = 5
    test_size: int | None = None
    train_size: int | None = None
    expanding: bool = True

    def __post_init__(self):
        if self.n_splits < 1:
            raise ValueError("n_splits must be >= 1")

    def split(self, n: int) -> list[tuple[int, int, int, int]]:
        """(fold, train from, train to, test to); the test block starts where the train set ends."""
        size = self.test_size or n // (self.n_splits + 1)
        first = n - self.n_splits * size
        if size < 1 or first < 1:
            raise ValueError("too few observations")
        return [(k, 0 if self.expanding or self.train_size is None else max(0, first + k * size - self.train_size), first + k * size, first + (k + 1) * size) for k in range(self.n_splits)]

    def folds(self, spark: SparkSession, n: int) -> DataFrame:
        """(fold, role, lo, hi): half-open ranges of observations from 0."""
        rows = [r for k, a, b, c in self.split(n) for r in ((k, "train", a, b), (k, "test", b, c))]
        return spark.createDataFrame(rows, "fold int, role string, lo int, hi int")


@dataclass(frozen=True)
class CombinatorialPurgedCV:
    """All choices of ``n_test`` of ``n_groups`` groups as test sets, purged before and embargoed after."""

    n_groups: int = 6
    n_test: int = 2
    purge: int = 0
    embargo: int = 0

    def __post_init__(self):
        if not 1 <= self.n_test < self.n_groups:
            raise ValueError("n_test must be between 1 and n_groups - 1")
        if self.purge < 0 or self.embargo < 0:
            raise ValueError("purge and embargo must be >= 0")

    @property
    def n_folds(self) -> int:
        return math.comb(self.n_groups, self.n_test)

    @property
    def n_paths(self) -> int:
        return math.comb(self.n_groups - 1, self.n_test - 1)

    def folds(self, spark: SparkSession, n: int) -> DataFrame:
        if n < self.n_groups:
            raise ValueError("fewer observations than groups")
        groups = _parts(n, self.n_groups)
        rows = []
        for fold, chosen in enumerate(itertools.combinations(range(self.n_groups), self.n_test)):
            free = np.ones(n, dtype=bool)
            for g in chosen:
                lo, hi = groups[g]
                free[max(0, lo - self.purge) : hi + max(self.purge, self.embargo)] = False
                rows.append((fold, "test", g, lo, hi))
            edges = np.flatnonzero(np.diff(np.r_[False, free, False]))
            rows += [(fold, "train", -1, int(a), int(b)) for a, b in zip(edges[::2], edges[1::2])]
        return spark.createDataFrame(rows, "fold int, role string, grp int, lo int, hi int")


def fold_rows(returns: DataFrame, folds: DataFrame) -> DataFrame:
    """Each observation of each fold with its role: a range join on a small broadcast table."""
    at = F.col("obs_id") - 1
    return returns.join(F.broadcast(folds), (at >= F.col("lo")) & (at < F.col("hi")))


def reconstruct_paths(fold_returns: DataFrame) -> DataFrame:
    """Adds ``path``: the r-th fold that tests a group belongs to path r.  Input: (fold, grp, obs_id, ret)."""
    rank = fold_returns.select("grp", "fold").distinct().withColumn("path", F.row_number().over(Window.partitionBy("grp").orderBy("fold")) - 1)
    return fold_returns.join(F.broadcast(rank), ["grp", "fold"])


Allocator = Callable[[pd.DataFrame], Mapping[Any, float]]


def cross_validate(returns: DataFrame, allocator: Allocator, cv: WalkForward | CombinatorialPurgedCV) -> DataFrame:
    """(fold, obs_id, ret [, grp]) out of sample: folds are fitted in parallel, one grouped map per fold.

    ``allocator`` takes a (obs_id x asset) pandas table of training returns and gives weights by asset.
    """
    aligned = tail_aligned(returns)
    n = aligned.agg(F.max("obs_id")).first()[0]
    rows = fold_rows(aligned, cv.folds(returns.sparkSession, n))
    kind = {f.name: f.dataType.simpleString() for f in rows.schema.fields}["asset"]

    def train(part: pd.DataFrame) -> pd.DataFrame:
        wide = part.pivot_table(index="obs_id", columns="asset", values="ret")
        weights = allocator(wide)
        return pd.DataFrame({"fold": [int(part["fold"].iloc[0])] * len(weights), "asset": list(weights), "weight": [float(v) for v in weights.values()]})

    weights = rows.where("role = 'train'").select("fold", "obs_id", "asset", "ret").groupBy("fold").applyInPandas(train, f"fold int, asset {kind}, weight double")
    keys = ["fold", "obs_id"] + (["grp"] if "grp" in rows.columns else [])
    return rows.where("role = 'test'").join(weights, ["fold", "asset"]).groupBy(*keys).agg(F.sum(F.col("ret") * F.col("weight")).alias("ret"))


def performance(frame: DataFrame, *keys: str, ret: str = "ret") -> DataFrame:
    """Annualised return, volatility and Sharpe ratio per key."""
    mean, vol = F.avg(ret) * TRADING_DAYS, F.coalesce(F.stddev_samp(ret), F.lit(0.0)) * math.sqrt(TRADING_DAYS)
    return frame.groupBy(*keys).agg(mean.alias("return_ann"), vol.alias("vol_ann"), F.when(vol > EPSILON, mean / vol).otherwise(0.0).alias("sharpe"))


def cv_summary(fold_returns: DataFrame) -> DataFrame:
    """Means over paths (over the one path of a walk), and the share of folds with a positive Sharpe ratio."""
    paths = reconstruct_paths(fold_returns) if "grp" in fold_returns.columns else fold_returns.withColumn("path", F.lit(0))
    each = performance(paths, "path").agg(F.avg("sharpe").alias("oos_sharpe"), F.avg("return_ann").alias("oos_return_ann"), F.avg("vol_ann").alias("oos_vol_ann"), F.count(F.lit(1)).alias("n_paths"))
    folds = performance(fold_returns, "fold").agg(F.avg((F.col("sharpe") > 0).cast("double")).alias("stability"), F.count(F.lit(1)).alias("n_splits"))
    return each.join(folds)


def grid_search(returns: DataFrame, factory: Callable[..., Allocator], grid: Mapping[str, Sequence[Any]], cv: WalkForward | CombinatorialPurgedCV, *, score: str = "oos_sharpe") -> DataFrame:
    """(params, score) of every combination, best first; ties keep the order of the grid."""
    spark, rows = returns.sparkSession, []
    for k, values in enumerate(itertools.product(*grid.values())):
        params = dict(zip(grid, values))
        rows.append((k, str(params), float(cv_summary(cross_validate(returns, factory(**params), cv)).first()[score])))
    return spark.createDataFrame(rows, "trial int, params string, score double").orderBy(F.desc("score"), "trial")


# ---- plot data ------------------------------------------------------------


def weights_chart(weights: DataFrame) -> DataFrame:
    return weights.select("asset", "weight").orderBy(F.desc("weight"), "asset")


def drawdown_chart(equity: DataFrame, keys: Sequence[str] = ("strategy",), order: str = "obs_id") -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return equity.select(*keys, order, "equity", (F.col("equity") / F.max("equity").over(w) - 1).alias("drawdown"))


def correlation_chart(returns: DataFrame) -> DataFrame:
    """(row, column, i, j, correlation) in the leaf order of single linkage."""
    m = moments(returns)
    order = leaf_order(linkage(np.sqrt(np.maximum(0.5 * (1 - m.corr), 0)), "single"), len(m.ids)) if len(m.ids) > 1 else [0]
    rows = [(a, b, str(m.ids[p]), str(m.ids[q]), float(m.corr[p, q])) for a, p in enumerate(order) for b, q in enumerate(order)]
    return returns.sparkSession.createDataFrame(rows, "row int, column int, i string, j string, correlation double")

