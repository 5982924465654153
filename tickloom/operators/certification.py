"""Strategy certification: analytics of equity curves, regimes, factor attribution, overfitting and grades."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.exprs import EPSILON, TRADING_DAYS, safe_divide

YEAR = math.sqrt(TRADING_DAYS)
#: Decimals of the reported analytics.
DECIMALS = {"sharpe": 3, "sortino": 3, "calmar": 3, "ulcer_index": 3, "tail_ratio": 3, "skew": 3, "excess_kurtosis": 3, "min_trl_years": 2, "track_years": 2, "beta": 3, "correlation": 3, "up_capture": 3, "down_capture": 3}
MIN_POINTS, MIN_RETURNS = 30, 20


def _returns(equity: DataFrame, keys: list[str], order: str, benchmark: str | None) -> DataFrame:
    """Positive equity in order with ret and bret; strategies that are too short are left out."""
    w = Window.partitionBy(*keys).orderBy(order)
    good = equity.where((F.col("equity") > 0) & ~F.isnan("equity") & (F.col("equity") < float("inf")))
    cols = {"i": F.row_number().over(w) - 1, "ret": F.col("equity") / F.lag("equity").over(w) - 1, "points": F.count("equity").over(Window.partitionBy(*keys))}
    if benchmark:
        cols["bret"] = safe_divide(F.col(benchmark), F.lag(benchmark).over(w)) - 1
    return good.withColumns(cols).where(F.col("points") >= MIN_POINTS)


def risk_analytics(equity: DataFrame, keys: Sequence[str] = ("strategy",), order: str = "obs_id", *, benchmark: str | None = None, date: str | None = None) -> DataFrame:
    """A row per strategy from (keys, order, equity [, benchmark] [, date]): returns, drawdown shape, tails and, with a benchmark, captures and the crisis window.

    ``order`` must be a total order.  One exchange by the keys carries all windows.
    """
    keys = list(keys)
    base = _returns(equity, keys, order, benchmark)
    own = Window.partitionBy(*keys)
    run = own.orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    base = base.withColumns({"peak": F.max("equity").over(run), "mu": F.avg("ret").over(own), "sd": F.stddev_samp("ret").over(own), "q05": F.percentile("ret", 0.05).over(own), "q01": F.percentile("ret", 0.01).over(own)})
    base = base.withColumn("fresh", F.when((F.col("i") == 0) | (F.col("equity") > F.lag("peak").over(own.orderBy("i"))), F.col("i")))
    base = base.withColumns({"dd": F.col("equity") / F.col("peak") - 1, "under": F.col("i") - F.max("fresh").over(run) + F.when(F.max("fresh").over(run) == 0, 1).otherwise(0)})
    down = F.when(F.col("ret") < 0, F.col("ret")).when(F.col("ret").isNotNull(), 0.0)
    off = F.col("ret") - F.col("mu")
    aggregates: list[Column] = [
        F.count("ret").alias("n"), F.first("mu").alias("mu"), F.first("sd").alias("sd"),
        F.max_by("equity", "i").alias("last"), F.min_by("equity", "i").alias("first"),
        F.sqrt(F.avg(down * down)).alias("dn"), F.least(F.min("dd"), F.lit(0.0)).alias("max_drawdown"), F.sqrt(F.avg((F.col("dd") * 100) ** 2)).alias("ulcer_index"),
        F.max(F.when(F.col("fresh").isNotNull() & (F.col("i") > 0), 0).otherwise(F.col("under"))).alias("uw"),
        F.first("q05").alias("q05"), F.avg(F.when(F.col("ret") <= F.col("q05"), F.col("ret"))).alias("cvar95"), F.avg(F.when(F.col("ret") <= F.col("q01"), F.col("ret"))).alias("cvar99"),
        F.percentile("ret", 0.95).alias("q95"), F.avg(off**3).alias("m3"), F.avg(off**4).alias("m4"),
    ]
    if benchmark:
        up, fall = F.col("bret") > 0, F.col("bret") < 0
        aggregates += [F.covar_samp("ret", "bret").alias("cov"), F.stddev_samp("bret").alias("bsd"), F.min(F.coalesce(F.col(benchmark) > 0, F.lit(False))).alias("bgood")]
        for name, test in (("up", up), ("dn", fall)):
            aggregates += [F.product(F.when(test, 1 + F.col("ret"))).alias(f"s_{name}"), F.product(F.when(test, 1 + F.col("bret"))).alias(f"b_{name}")]
    a = base.groupBy(*keys).agg(*aggregates).where(F.col("n") >= MIN_RETURNS)
    growth = F.pow(F.col("last") / F.col("first"), TRADING_DAYS / F.col("n")) - 1
    rate = F.when(F.col("sd") > 0, F.col("mu") / F.col("sd"))
    skew, kurt = F.when(F.col("sd") > 0, F.col("m3") / F.col("sd") ** 3), F.when(F.col("sd") > 0, F.col("m4") / F.col("sd") ** 4)
    least = F.when(rate > 0, (1 + (1 - skew * rate + (kurt - 1) / 4 * rate * rate) * (F.lit(1.645) / rate) ** 2))
    years = F.when(least > 0, least / TRADING_DAYS)
    out = {
        "observations": F.col("n"), "annualized_return": growth, "annualized_vol": F.col("sd") * YEAR, "sharpe": rate * YEAR,
        "sortino": F.when(F.col("dn") > 0, F.col("mu") / F.col("dn") * YEAR), "calmar": F.when(F.col("max_drawdown") < 0, growth / F.abs("max_drawdown")),
        "max_drawdown": F.col("max_drawdown"), "ulcer_index": F.col("ulcer_index"), "max_time_under_water_days": F.col("uw").cast("long"), "downside_deviation": F.col("dn") * YEAR,
        "var95": F.col("q05"), "cvar95": F.col("cvar95"), "cvar99": F.col("cvar99"), "tail_ratio": F.when(F.col("q05") != 0, F.abs("q95") / F.abs("q05")),
        "skew": skew, "excess_kurtosis": kurt - 3, "min_trl_years": years, "track_years": F.col("n") / TRADING_DAYS, "significant": F.col("n") / TRADING_DAYS >= years,
    }
    if benchmark:
        ok = F.col("bgood")
        out |= {
            "beta": F.when(ok & (F.col("bsd") > 0), F.col("cov") / (F.col("bsd") * F.col("bsd"))),
            "correlation": F.when(ok & (F.col("bsd") > 0) & (F.col("sd") > 0), F.col("cov") / (F.col("sd") * F.col("bsd"))),
            "up_capture": F.when(ok & (F.col("b_up") != 1), (F.col("s_up") - 1) / (F.col("b_up") - 1)),
            "down_capture": F.when(ok & (F.col("b_dn") != 1), (F.col("s_dn") - 1) / (F.col("b_dn") - 1)),
        }
    result = a.select(*keys, *[F.round(v, DECIMALS.get(k, 4)).alias(k) if k not in ("observations", "max_time_under_water_days", "significant") else v.alias(k) for k, v in out.items()])
    if benchmark:
        result = result.join(_crisis(base, keys, benchmark), keys, "left")
    if date:
        result = result.join(_months(equity, keys, order, date), keys, "left")
    return result


def _crisis(base: DataFrame, keys: list[str], benchmark: str) -> DataFrame:
    """Both returns over the benchmark's deepest fall, from its peak (the first of equal ones) to the trough (likewise)."""
    own = Window.partitionBy(*keys)
    run = own.orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    b = F.col(benchmark)
    at = base.withColumn("bpeak", F.max(F.struct(b.alias("b"), (-F.col("i")).alias("k"), F.col("equity").alias("e"))).over(run))
    at = at.withColumn("bdd", b / F.col("bpeak.b") - 1)
    low = at.groupBy(*keys).agg(F.min(F.struct("bdd", "i", b.alias("b"), F.col("equity").alias("e"), "bpeak")).alias("x"), F.min(F.coalesce(b > 0, F.lit(False))).alias("good"))
    real = F.col("good") & (F.col("x.bdd") < 0)
    return low.select(*keys, F.round(F.when(real, F.col("x.e") / F.col("x.bpeak.e") - 1), 4).alias("crisis_return"), F.round(F.when(real, F.col("x.b") / F.col("x.bpeak.b") - 1), 4).alias("crisis_benchmark_return"))


def _months(equity: DataFrame, keys: list[str], order: str, date: str) -> DataFrame:
    """Last over first equity of each month, least and greatest."""
    month = F.when(F.lit(dict(equity.dtypes)[date] == "string"), F.substring(F.col(date).cast("string"), 1, 7)).otherwise(F.date_format(date, "yyyy-MM"))
    each = equity.groupBy(*keys, month.alias("_m")).agg((F.max_by("equity", order) / F.min_by("equity", order) - 1).alias("r"))
    return each.groupBy(*keys).agg(F.round(F.min("r"), 4).alias("worst_month"), F.round(F.max("r"), 4).alias("best_month"))


def regime_performance(equity: DataFrame, keys: Sequence[str] = ("strategy",), order: str = "obs_id", *, benchmark: str | None = None, vol_window: int = 21, trend_window: int = 50) -> DataFrame:
    """(keys, kind, regime, share_of_days, n_days, annualized_return, annualized_vol, sharpe, hit_rate): terciles of rolling volatility, and with a benchmark above or below its mean."""
    keys = list(keys)
    own = Window.partitionBy(*keys)
    w = own.orderBy("i")
    base = _returns(equity, keys, order, benchmark).where(F.col("points") >= max(vol_window + 20, 40))
    frame = w.rowsBetween(-(vol_window - 1), 0)
    rows = base.withColumns({"rv": F.when((F.count("ret").over(frame) >= 2) & F.col("ret").isNotNull(), F.stddev_samp("ret").over(frame))})
    if benchmark:
        rows = rows.withColumn("bull", F.col(benchmark) >= F.avg(benchmark).over(w.rowsBetween(-(trend_window - 1), 0)))
    rows = rows.withColumns({"q1": F.percentile("rv", 1 / 3).over(own), "q2": F.percentile("rv", 2 / 3).over(own)}).where(F.col("ret").isNotNull())
    vol = rows.where("rv is not null").select(*keys, F.lit("volatility").alias("kind"), F.when(F.col("rv") <= F.col("q1"), "calm").when(F.col("rv") <= F.col("q2"), "normal").otherwise("stressed").alias("regime"), "ret")
    if benchmark:
        vol = vol.unionByName(rows.select(*keys, F.lit("trend").alias("kind"), F.when(F.col("bull"), "bull").otherwise("bear").alias("regime"), "ret"))
    stats = vol.groupBy(*keys, "kind", "regime").agg(F.count("ret").alias("n_days"), F.avg("ret").alias("mu"), F.coalesce(F.stddev_samp("ret"), F.lit(0.0)).alias("sd"), F.product(1 + F.col("ret")).alias("grown"), F.avg((F.col("ret") > 0).cast("int")).alias("hit"))
    total = F.sum("n_days").over(Window.partitionBy(*keys, "kind"))
    return stats.select(
        *keys, "kind", "regime", F.round(F.col("n_days") / total, 4).alias("share_of_days"), "n_days",
        F.round(F.pow("grown", TRADING_DAYS / F.col("n_days")) - 1, 4).alias("annualized_return"), F.round(F.col("sd") * YEAR, 4).alias("annualized_vol"),
        F.round(F.when(F.col("sd") > 0, F.col("mu") / F.col("sd") * YEAR), 3).alias("sharpe"), F.round("hit", 4).alias("hit_rate"),
    )


def regime_summary(regimes: DataFrame, keys: Sequence[str] = ("strategy",)) -> DataFrame:
    """The volatility regime of least Sharpe ratio, and whether all are positive."""
    vol = regimes.where("kind = 'volatility' and sharpe is not null")
    order = F.when(F.col("regime") == "calm", 0).when(F.col("regime") == "normal", 1).otherwise(2)
    return vol.groupBy(*keys).agg(F.min_by("regime", F.struct("sharpe", order)).alias("worst_vol_regime"), (F.min("sharpe") > 0).alias("consistent_across_regimes"))


# ---- overfitting ----------------------------------------------------------


#: Block sums (blocks times trials) that are sent to the tasks as one matrix; more are joined with the splits.
MAX_BLOCK_SUMS = 1_000_000


def _ranked_by_matrix(stats: DataFrame, chosen: list[tuple[int, ...]], splits: int) -> DataFrame:
    """(fit, test, place, trials) of each split's best trial: products of split masks with the block sums, batch by batch."""
    spark = stats.sparkSession
    table = stats.toPandas().sort_values(["trial", "block"])
    trials = table["trial"].unique()
    wide = {c: table.pivot(index="block", columns="trial", values=c).reindex(index=range(splits), columns=trials).fillna(0.0).to_numpy(dtype=float) for c in ("n", "s", "q")}
    centre = table.groupby("trial", sort=False)["c"].first().reindex(trials).to_numpy(dtype=float)
    shared = spark.sparkContext.broadcast((wide, centre))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        wide, centre = shared.value

        def rates(masks: np.ndarray) -> np.ndarray:
            n, s, q = (masks @ wide[c] for c in ("n", "s", "q"))
            with np.errstate(divide="ignore", invalid="ignore"):
                spread = np.sqrt(np.maximum((q - s * s / n) / (n - 1), 0.0))
                return np.where(spread > EPSILON, (s / n + centre) / np.maximum(spread, EPSILON), 0.0)

        for batch in batches:
            for k in range(0, len(batch), 256):
                masks = np.zeros((len(batch[k : k + 256]), splits))
                for row, blocks in enumerate(batch["blocks"].iloc[k : k + 256]):
                    masks[row, blocks] = 1
                fit, test = rates(masks), rates(1 - masks)
                best = fit.argmax(axis=1)
                own = test[np.arange(len(best)), best]
                place = 1 + (test < own[:, None]).sum(axis=1) + ((test == own[:, None]) & (np.arange(len(centre)) < best[:, None])).sum(axis=1)
                yield pd.DataFrame({"fit": fit[np.arange(len(best)), best], "test": own, "place": place, "trials": len(centre)})

    frame = spark.createDataFrame([(list(c),) for c in chosen], "blocks array<int>").repartition(max(1, min(64, len(chosen) // 2_000)))
    return frame.mapInPandas(run, "fit double, test double, place long, trials long")


def _ranked_by_join(stats: DataFrame, chosen: list[tuple[int, ...]], splits: int) -> DataFrame:
    """The same as relational algebra: the splits are a table that joins the block sums."""
    sides = stats.sparkSession.createDataFrame([(k, b, int(b in own)) for k, own in enumerate(chosen) for b in range(splits)], "combo int, block int, inside int")
    sums = stats.join(F.broadcast(sides), "block").groupBy("combo", "trial", "inside").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.first("c").alias("c"))
    var = (F.col("q") - F.col("s") * F.col("s") / F.col("n")) / (F.col("n") - 1)
    sharpe = F.when(F.sqrt(F.greatest(var, F.lit(0.0))) > EPSILON, (F.col("s") / F.col("n") + F.col("c")) / F.sqrt(F.greatest(var, F.lit(EPSILON * EPSILON)))).otherwise(F.lit(0.0))
    rated = sums.groupBy("combo", "trial").agg(F.max(F.when(F.col("inside") == 1, sharpe)).alias("fit"), F.max(F.when(F.col("inside") == 0, sharpe)).alias("test"))
    one = Window.partitionBy("combo")
    return rated.withColumns({"best": F.row_number().over(one.orderBy(F.desc("fit"), "trial")), "place": F.row_number().over(one.orderBy("test", "trial")), "trials": F.count(F.lit(1)).over(one)}).where("best = 1")


def backtest_overfitting(trials: DataFrame, *, n_splits: int = 16, t: str = "t", trial: str = "trial", ret: str = "ret") -> DataFrame:
    """Probability of backtest overfitting by combinatorial cross-validation.

    One scan keeps (n, sum, sum of squares) per block and trial, and the C(S, S/2)
    splits work on these sums, dealt out over the tasks.  Returns pbo, n_trials, n_splits,
    n_combinations, mean_logit and performance_degradation (slope of out-of-sample
    on in-sample Sharpe of the chosen trial).
    """
    splits = max(2, n_splits + n_splits % 2)
    base = trials.select(F.col(t).alias("t"), F.col(trial).alias("trial"), F.col(ret).alias("r"))
    times = base.select("t").distinct().withColumn("block", F.ntile(splits).over(Window.orderBy("t")) - 1)  # one row per date, not per return
    centre = base.groupBy("trial").agg(F.avg("r").alias("c"))
    stats = base.join(times, "t").join(centre, "trial").withColumn("x", F.col("r") - F.col("c"))
    stats = stats.groupBy("block", "trial").agg(F.count("x").alias("n"), F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"), F.first("c").alias("c"))
    chosen = list(combinations(range(splits), splits // 2))
    if stats.count() <= MAX_BLOCK_SUMS:
        ranked = _ranked_by_matrix(stats, chosen, splits)
    else:
        ranked = _ranked_by_join(stats, chosen, splits)
    omega = F.col("place") / (F.col("trials") + 1)
    logits = ranked.withColumn("logit", F.ln(omega / (1 - omega)))
    return logits.agg(
        F.avg((F.col("logit") <= 0).cast("int")).alias("pbo"), F.max("trials").alias("n_trials"), F.lit(splits).alias("n_splits"), F.count(F.lit(1)).alias("n_combinations"), F.avg("logit").alias("mean_logit"), F.regr_slope("test", "fit").alias("performance_degradation")
    )


def sharpe_significance(trials: DataFrame, keys: Sequence[str] = ("trial",), ret: str = "ret", benchmark_sharpe: float = 0.0) -> DataFrame:
    """Probabilistic and deflated Sharpe ratios (per observation) by the published formulas; an extension."""
    keys = list(keys)
    own = Window.partitionBy(*keys)
    off = F.col(ret) - F.avg(ret).over(own)
    base = trials.withColumns({"_off": off}).groupBy(*keys).agg(F.count(ret).alias("n"), F.avg(ret).alias("m"), F.stddev_samp(ret).alias("sd"), F.avg(F.col("_off") ** 3).alias("m3"), F.avg(F.col("_off") ** 4).alias("m4"))
    base = base.where("sd > 0").withColumn("sr", F.col("m") / F.col("sd"))
    several = base.agg(F.var_samp("sr").alias("v"), F.count(F.lit(1)).alias("k")).first()
    top = 0.0
    if several and several.k and several.k > 1:
        from statistics import NormalDist

        inverse, gamma = NormalDist().inv_cdf, 0.5772156649015329
        top = math.sqrt(several.v or 0) * ((1 - gamma) * inverse(1 - 1 / several.k) + gamma * inverse(1 - 1 / (several.k * math.e)))

    def probability(against: float) -> Column:
        spread = F.sqrt(F.greatest(1 - F.col("m3") / F.col("sd") ** 3 * F.col("sr") + (F.col("m4") / F.col("sd") ** 4 - 1) / 4 * F.col("sr") ** 2, F.lit(EPSILON)))
        return normal_cdf((F.col("sr") - against) * F.sqrt(F.col("n") - 1) / spread)

    return base.select(*keys, "sr", probability(benchmark_sharpe).alias("probabilistic_sharpe"), probability(top).alias("deflated_sharpe"))


def normal_cdf(z: Column) -> Column:
    """Standard normal distribution function (Marsaglia's series, within 1e-12 for |z| <= 7)."""
    x = F.least(F.greatest(z, F.lit(-7.0)), F.lit(7.0))
    term = F.aggregate(F.sequence(F.lit(1), F.lit(120)), F.struct(x.alias("s"), x.alias("t")), lambda a, k: F.struct((a["s"] + a["t"] * x * x / (2 * k + 1)).alias("s"), (a["t"] * x * x / (2 * k + 1)).alias("t")), lambda a: a["s"])
    return F.lit(0.5) + term * F.exp(-x * x / 2) / math.sqrt(2 * math.pi)


# ---- grades ---------------------------------------------------------------

#: Dimension weights, and bands as (least value, points).
WEIGHTS = {"robustness": 0.25, "out_of_sample": 0.20, "risk": 0.15, "factor_independence": 0.15, "capacity_cost": 0.10, "live_track_record": 0.15}
BANDS = {
    "deflated_sharpe": ((0.95, 100), (0.90, 90), (0.75, 75), (0.50, 55), (0.25, 35), (None, 20)),
    "probabilistic_sharpe_cost": ((0.95, 0), (0.90, 5), (0.75, 12), (0.50, 22), (None, 35)),
    "oos_sharpe": ((1.0, 80), (0.5, 60), (0.25, 45), (None, 30)),
    "oos_decay": ((1.0, 100), (0.9, 90), (0.7, 75), (0.5, 55), (0.35, 40), (0.2, 25), (None, 10)),
    "loss_control": ((90, 100), (80, 80), (70, 60), (60, 40), (45, 20), (None, 5)),
    "independence": ((0.8, 100), (0.6, 80), (0.4, 60), (0.2, 40), (None, 20)),
    "capacity": ((50_000_000, 100), (10_000_000, 85), (1_000_000, 65), (250_000, 45), (50_000, 25), (None, 10)),
    "live_ratio": ((0.8, 100), (0.6, 85), (0.4, 65), (0.2, 45), (0.001, 30), (None, 10)),
    "grade": ((80, "A"), (70, "B"), (60, "C"), (50, "D"), (None, "Not Certified")),
}
MIN_LIVE_TRADES, MIN_LIVE_DAYS = 20, 30
INPUTS = ("sharpe_ratio", "max_drawdown", "profit_factor", "alpha", "beta", "deflated_sharpe", "probabilistic_sharpe", "num_trials", "oos_sharpe", "turnover", "capacity", "live_sharpe", "live_trades", "live_days", "sortino", "calmar", "tail_ratio", "excess_kurtosis")


def banded(value: Column, name: str) -> Column:
    out = None
    for least, points in BANDS[name]:
        if least is None:
            return out.otherwise(F.lit(points))
        out = F.when(value >= least, F.lit(points)) if out is None else out.when(value >= least, F.lit(points))
    return out


def _within(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(float(low))), F.lit(float(high)))


def _points(test: Column, points: float) -> Column:
    """``points`` where the test is true, else (and where it is unknown) 0."""
    return F.when(F.coalesce(test, F.lit(False)), F.lit(float(points))).otherwise(F.lit(0.0))


def score_robustness() -> Column:
    dsr, psr = F.col("deflated_sharpe"), F.col("probabilistic_sharpe")
    score = banded(dsr, "deflated_sharpe") - F.when(psr.isNotNull(), banded(psr, "probabilistic_sharpe_cost")).otherwise(0)
    capped = F.when(F.coalesce(F.col("num_trials") <= 1, F.lit(False)), F.least(score, F.lit(60))).otherwise(score)
    return F.when(dsr > 0, _within(capped, 0, 100)).otherwise(0.0)


def score_out_of_sample() -> Column:
    oos, inside = F.col("oos_sharpe"), F.col("sharpe_ratio")
    decay = _within(oos / F.when(inside > 0, inside), 0, 1.2)
    return F.when(oos.isNull(), 0.0).when(oos <= 0, 5.0).when(F.coalesce(inside <= 0, F.lit(True)), banded(oos, "oos_sharpe").cast("double")).otherwise(banded(decay, "oos_decay").cast("double"))


def score_risk() -> Column:
    factor = F.col("profit_factor")
    score = banded(100 - F.abs("max_drawdown"), "loss_control").cast("double")
    score = F.when(factor < 1, F.least(score, F.lit(45.0))).when(factor >= 2, F.least(score + 5, F.lit(100.0))).otherwise(score)
    score = score + _points(F.col("sortino") >= 2, 5) + _points(F.col("sortino") < 0.5, -15) + _points(F.col("calmar") >= 1, 5) + _points(F.col("calmar") < 0.3, -10)
    score = score + _points(F.col("tail_ratio") < 0.8, -10) + _points(F.col("excess_kurtosis") > 5, -5)
    return F.when(F.col("max_drawdown").isNotNull(), _within(score, 0, 100)).otherwise(0.0)


def score_factor_independence() -> Column:
    alpha, beta = F.col("alpha"), F.col("beta")
    score = banded(1 - F.abs(beta), "independence").cast("double")
    known = F.when(alpha > 0, F.least(score + 5, F.lit(100.0))).when(alpha < 0, F.least(score, F.lit(50.0))).otherwise(score)
    return F.when(beta.isNotNull(), _within(known, 0, 100)).when(alpha > 0, 60.0).when(alpha < 0, 40.0).otherwise(50.0)


def score_capacity_cost() -> Column:
    base = F.when(F.col("capacity").isNotNull(), banded(F.col("capacity"), "capacity")).otherwise(40)
    cost = F.when(F.col("turnover") > 10, 15).when(F.col("turnover") > 5, 8).otherwise(0)
    return _within(base - cost, 0, 100)


def score_live_track_record() -> Column:
    live, inside = F.col("live_sharpe"), F.col("sharpe_ratio")
    ratio = F.when(inside > 0, _within(live / F.when(inside > 0, inside), 0, 1.5)).otherwise(F.when(live > 0, 1.0).otherwise(0.0))
    return F.when(live.isNull(), 20.0).otherwise(banded(ratio, "live_ratio").cast("double"))


def evaluate_gates() -> dict[str, Column]:
    """Pass or fail; unknown fails."""
    true = lambda c: F.coalesce(c, F.lit(False))
    return {
        "gate_backtest_verified": true(F.col("backtest_verified")),
        "gate_no_high_severity_lookahead": ~F.coalesce(F.col("has_high_severity_lookahead"), F.lit(False)),
        "gate_deflated_sharpe_positive": true(F.col("deflated_sharpe") > 0),
        "gate_core_metrics_present": F.col("sharpe_ratio").isNotNull() & F.col("max_drawdown").isNotNull(),
    }


def certify(strategies: DataFrame) -> DataFrame:
    """Adds the six scores, the gates, composite, grade, provisional and certified, as one projection.

    Columns of ``INPUTS`` that are missing count as unknown.  Without a live record
    of at least 20 trades and 30 days its weight is dealt to the others and the
    grade is provisional (A at best).
    """
    frame = strategies.withColumns({c: F.lit(None).cast("double") for c in INPUTS if c not in strategies.columns} | {c: F.lit(False) for c in ("backtest_verified", "has_high_severity_lookahead") if c not in strategies.columns})
    frame = frame.withColumns({c: F.when(~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c).cast("double")) < float("inf")), F.col(c).cast("double")) for c in INPUTS})
    live = F.coalesce((F.col("live_trades") >= MIN_LIVE_TRADES) & (F.col("live_days") >= MIN_LIVE_DAYS), F.lit(False))
    scores = {"robustness": score_robustness(), "out_of_sample": score_out_of_sample(), "risk": score_risk(), "factor_independence": score_factor_independence(), "capacity_cost": score_capacity_cost(), "live_track_record": F.when(live, score_live_track_record())}
    frame = frame.withColumns({f"score_{k}": v.cast("double") for k, v in scores.items()} | evaluate_gates() | {"provisional": ~live})
    kept = sum(w for k, w in WEIGHTS.items() if k != "live_track_record")
    total = sum((F.col(f"score_{k}") * w for k, w in WEIGHTS.items() if k != "live_track_record"), F.lit(0.0))
    composite = F.round(_within(F.when(F.col("provisional"), total / kept).otherwise(total + F.col("score_live_track_record") * WEIGHTS["live_track_record"]), 0, 100), 1)
    passed = F.lit(True)
    for gate in evaluate_gates():
        passed = passed & F.col(gate)
    frame = frame.withColumns({"gates_passed": passed, "composite": F.when(passed, composite)})
    grade = F.when(~F.col("gates_passed"), "Not Certified").when((F.col("composite") >= 90) & ~F.col("provisional"), "A+").otherwise(banded(F.col("composite"), "grade"))
    return frame.withColumn("grade", grade).withColumn("certified", F.col("grade") != "Not Certified")
