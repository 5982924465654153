"""Indicators that Catalyst computes: lags, frames and cumulative frames only.

Each function takes a :class:`~tickloom.functions.exprs.Series` and parameters
and returns its outputs by name.  Registered in ``INDICATORS``.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from tickloom.functions.exprs import EPSILON, TRADING_DAYS, Series, positive_log, safe_divide

Outputs = dict[str, Column]
INDICATORS: dict[str, Callable[..., Outputs]] = {}


def indicator(f: Callable[..., Outputs]) -> Callable[..., Outputs]:
    INDICATORS[f.__name__] = f
    return f


def _share(value: Column, low: Column, spread: Column, scale: float, empty: float) -> Column:
    """scale * (value - low) / spread, ``empty`` for a zero spread."""
    return F.when(spread > EPSILON, (value - low) / spread * scale).when(spread.isNotNull() & value.isNotNull(), F.lit(empty))


def _annual(x: Column, annualize: bool, days: int) -> Column:
    return x * math.sqrt(days) if annualize else x


# ---- trend ----------------------------------------------------------------


@indicator
def sma(s: Series, period: int = 20, *, source: str = "close") -> Outputs:
    return {"sma": s.mean(s.source(source), period)}


@indicator
def wma(s: Series, period: int = 20, *, source: str = "close") -> Outputs:
    return {"wma": s.wma(s.source(source), period)}


@indicator
def trima(s: Series, period: int = 30, *, source: str = "close") -> Outputs:
    rise = [min(k + 1, period - k) for k in range(period)]
    return {"trima": s.weighted(s.source(source), [w / sum(rise) for w in rise])}


@indicator
def hma(s: Series, period: int = 20, *, source: str = "close") -> Outputs:
    if period < 2:
        raise ValueError("period must be >= 2")
    x = s.source(source)
    return {"hma": s.wma(s.let(2 * s.wma(x, period // 2) - s.wma(x, period)), math.isqrt(period))}


@indicator
def alma(s: Series, period: int = 9, *, offset: float = 0.85, sigma: float = 6.0, source: str = "close") -> Outputs:
    centre, width = math.floor(offset * (period - 1)), period / sigma
    bell = [math.exp(-((k - centre) ** 2) / (2 * width * width)) for k in range(period)]
    return {"alma": s.weighted(s.source(source), [b / sum(bell) for b in bell])}


@indicator
def ichimoku(s: Series, tenkan: int = 9, kijun: int = 26, senkou: int = 52, *, displacement: int = 26) -> Outputs:
    middle = lambda p: s.let((s.max(s.h, p) + s.min(s.l, p)) / 2)
    t, k, b = middle(tenkan), middle(kijun), middle(senkou)
    ahead = displacement - 1
    return {"tenkan": t, "kijun": k, "senkou_a": s.lag(s.let((t + k) / 2), ahead), "senkou_b": s.lag(b, ahead)}


def _since(s: Series, x: Column, period: int, pick) -> Column:
    """Rows since the extreme of the last period + 1 rows; the latest of equal ones."""
    row = s.row()
    w = s.window.rowsBetween(-period, 0)
    key = F.struct(x.alias("x"), (row if pick is F.max else -row).alias("k"))
    at = pick(key).over(w)["k"]
    return s.let(F.when(F.count(x).over(w) == period + 1, row - (at if pick is F.max else -at)))


def _aroon(s: Series, period: int) -> tuple[Column, Column]:
    place = lambda since: s.let(100.0 * (period - since) / period)
    return place(_since(s, s.l, period, F.min)), place(_since(s, s.h, period, F.max))


@indicator
def aroon(s: Series, period: int = 14) -> Outputs:
    down, up = _aroon(s, period)
    return {"aroon_down": down, "aroon_up": up}


@indicator
def aroon_osc(s: Series, period: int = 14) -> Outputs:
    down, up = _aroon(s, period)
    return {"aroon_osc": up - down}


@indicator
def vortex(s: Series, period: int = 14) -> Outputs:
    total = s.sum(s.true_range(first=False), period)
    plus, minus = s.let(F.abs(s.h - s.lag(s.l))), s.let(F.abs(s.l - s.lag(s.h)))
    return {"vi_plus": safe_divide(s.sum(plus, period), total), "vi_minus": safe_divide(s.sum(minus, period), total)}


@indicator
def midpoint(s: Series, period: int = 14, *, source: str = "close") -> Outputs:
    x = s.source(source)
    return {"midpoint": (s.max(x, period) + s.min(x, period)) / 2}


@indicator
def midprice(s: Series, period: int = 14) -> Outputs:
    return {"midprice": (s.max(s.h, period) + s.min(s.l, period)) / 2}


# ---- momentum -------------------------------------------------------------


@indicator
def stochastic(s: Series, k_period: int = 14, d_period: int = 3) -> Outputs:
    low = s.min(s.l, k_period)
    k = s.let(_share(s.c, low, s.max(s.h, k_period) - low, 100.0, 50.0))
    smooth = s.mean(s.let(F.coalesce(k, F.lit(50.0))), d_period)  # rows without a range count as 50
    return {"k": k, "d": F.when(s.row() >= k_period - 1, smooth)}


@indicator
def williams_r(s: Series, period: int = 14) -> Outputs:
    high = s.max(s.h, period)
    spread = high - s.min(s.l, period)
    return {"williams_r": F.when(spread > EPSILON, (high - s.c) / spread * -100.0).when(spread.isNotNull(), F.lit(-50.0))}


@indicator
def cci(s: Series, period: int = 20, *, constant: float = 0.015) -> Outputs:
    x = s.source("hlc3")
    mean = s.mean(x, period)
    seen = F.collect_list(x).over(s.window.rowsBetween(-(period - 1), 0))
    off = s.let(F.aggregate(F.transform(s.let(seen), lambda v: F.abs(v - mean)), F.lit(0.0), lambda a, v: a + v) / period)
    scale = constant * off
    return {"cci": F.when(scale > EPSILON, (x - mean) / scale).when(scale.isNotNull(), F.lit(0.0))}


def _change(s: Series, period: int, source: str) -> tuple[Column, Column]:
    x = s.source(source)
    return x, s.lag(x, period)


@indicator
def roc(s: Series, period: int = 12, *, source: str = "close") -> Outputs:
    x, prev = _change(s, period, source)
    return {"roc": safe_divide(x - prev, prev, 0.0) * 100}


@indicator
def momentum(s: Series, period: int = 20, *, source: str = "close") -> Outputs:
    x, prev = _change(s, period, source)
    return {"momentum": F.when(F.abs(prev) > EPSILON, (x / prev - 1) * 100).when(prev.isNotNull() & x.isNotNull(), F.lit(0.0))}


@indicator
def mom(s: Series, period: int = 10, *, source: str = "close") -> Outputs:
    x, prev = _change(s, period, source)
    return {"mom": x - prev}


@indicator
def rocp(s: Series, period: int = 10, *, source: str = "close") -> Outputs:
    x, prev = _change(s, period, source)
    return {"rocp": safe_divide(x - prev, prev, 0.0)}


@indicator
def rocr(s: Series, period: int = 10, *, scale: float = 1.0, source: str = "close") -> Outputs:
    x, prev = _change(s, period, source)
    return {"rocr": safe_divide(x, prev, 0.0) * scale}


@indicator
def mfi(s: Series, period: int = 14) -> Outputs:
    x = s.source("hlc3")
    step = s.diff(x)
    flow = lambda sign: s.let(F.when(step * sign > 0, x * s.v).when(step.isNotNull(), F.lit(0.0)))
    up, down = s.sum(flow(1), period), s.sum(flow(-1), period)
    return {"mfi": 100 - 100 / (1 + up / F.greatest(down, F.lit(EPSILON)))}


@indicator
def stochastic_slow(s: Series, fastk_period: int = 5, slowk_period: int = 3, slowd_period: int = 3) -> Outputs:
    low = s.min(s.l, fastk_period)
    raw = s.let(safe_divide(s.c - low, s.max(s.h, fastk_period) - low, 0.0) * 100)
    k = s.mean(raw, slowk_period)
    d = s.mean(k, slowd_period)
    return {"slow_k": F.when(d.isNotNull(), k), "slow_d": d}


@indicator
def cmo(s: Series, period: int = 14, *, source: str = "close") -> Outputs:
    step = s.diff(s.source(source))
    up = s.sum(s.let(F.greatest(step, F.when(step.isNotNull(), F.lit(0.0)))), period)
    down = s.sum(s.let(F.greatest(-step, F.when(step.isNotNull(), F.lit(0.0)))), period)
    return {"cmo": safe_divide(up - down, up + down, 0.0) * 100}


@indicator
def ultimate_oscillator(s: Series, period1: int = 7, period2: int = 14, period3: int = 28) -> Outputs:
    prev = s.lag(s.c)
    floor = F.when(prev.isNotNull(), F.least(s.l, prev))
    buying, spread = s.let(s.c - floor), s.let(F.greatest(s.h, prev) - floor)
    part = lambda p: safe_divide(s.sum(buying, p), s.sum(spread, p), 0.0)
    value = s.let(100 * (4 * part(period1) + 2 * part(period2) + part(period3)) / 7)
    return {"ultimate_oscillator": F.when(s.row() >= max(period1, period2, period3), value)}


@indicator
def awesome_oscillator(s: Series, fast_period: int = 5, slow_period: int = 34) -> Outputs:
    x = s.source("hl2")
    return {"awesome_oscillator": s.mean(x, fast_period) - s.mean(x, slow_period)}


@indicator
def kst(s: Series, roc_periods: Sequence[int] = (10, 15, 20, 30), sma_periods: Sequence[int] = (10, 10, 10, 15), signal_period: int = 9, *, source: str = "close") -> Outputs:
    x = s.source(source)
    total = F.lit(0.0)
    for weight, (back, smooth) in enumerate(zip(roc_periods, sma_periods), 1):
        prev = s.lag(x, back)
        total = total + weight * s.mean(s.let(safe_divide(x - prev, prev, 0.0) * 100), smooth)
    line = s.let(total)
    return {"kst": line, "signal": s.mean(line, signal_period)}


@indicator
def coppock(s: Series, wma_period: int = 10, long_roc: int = 14, short_roc: int = 11, *, source: str = "close") -> Outputs:
    x = s.source(source)
    a, b = s.lag(x, long_roc), s.lag(x, short_roc)
    return {"coppock": s.wma(s.let((safe_divide(x - a, a, 0.0) + safe_divide(x - b, b, 0.0)) * 100), wma_period)}


@indicator
def dpo(s: Series, period: int = 20, *, source: str = "close") -> Outputs:
    x = s.source(source)
    return {"dpo": s.lag(x, period // 2 + 1) - s.mean(x, period)}


@indicator
def rvgi(s: Series, period: int = 10) -> Outputs:
    four = (1 / 6, 2 / 6, 2 / 6, 1 / 6)
    up, spread = s.weighted(s.let(s.c - s.o), four), s.weighted(s.let(s.h - s.l), four)
    line = s.let(safe_divide(s.sum(up, period), s.sum(spread, period)))
    return {"rvgi": line, "signal": s.weighted(line, four)}


@indicator
def bop(s: Series) -> Outputs:
    return {"bop": safe_divide(s.c - s.o, s.h - s.l, 0.0)}


# ---- volatility -----------------------------------------------------------


@indicator
def bollinger(s: Series, period: int = 20, *, num_std: float = 2.0, source: str = "close") -> Outputs:
    x = s.source(source)
    mid, spread = s.mean(x, period), s.std(x, period, ddof=0)
    return {"upper": mid + num_std * spread, "middle": mid, "lower": mid - num_std * spread}


@indicator
def donchian(s: Series, period: int = 20) -> Outputs:
    return {"upper": s.max(s.h, period), "lower": s.min(s.l, period)}


@indicator
def realized_vol(s: Series, period: int = 20, *, annualize: bool = True, trading_days: int = TRADING_DAYS, source: str = "close") -> Outputs:
    change = s.diff(s.let(F.ln(F.greatest(s.source(source), F.lit(EPSILON)))))
    return {"realized_vol": _annual(s.std(change, period), annualize, trading_days)}


@indicator
def garman_klass(s: Series, period: int = 20, *, annualize: bool = True, trading_days: int = TRADING_DAYS) -> Outputs:
    tiny = F.lit(EPSILON)
    span = F.ln(F.greatest(s.h / F.greatest(s.l, tiny), tiny))
    body = F.ln(F.greatest(s.c / F.greatest(s.o, tiny), tiny))
    mean = s.mean(s.let(0.5 * span * span - (2 * math.log(2) - 1) * body * body), period)
    return {"garman_klass": F.when(mean >= 0, _annual(F.sqrt(mean), annualize, trading_days))}


@indicator
def ulcer_index(s: Series, period: int = 14, *, source: str = "close") -> Outputs:
    x = s.source(source)
    peak = s.max(x, period)
    fall = safe_divide(x - peak, peak) * 100
    return {"ulcer_index": F.sqrt(s.mean(s.let(fall * fall), period))}


@indicator
def choppiness(s: Series, period: int = 14) -> Outputs:
    ratio = s.let(safe_divide(s.sum(s.true_range(first=False), period), s.max(s.h, period) - s.min(s.l, period)))
    return {"choppiness": F.when(ratio > 0, 100 * F.log10(ratio) / math.log10(period))}


@indicator
def parkinson(s: Series, period: int = 20, *, annualize: bool = True, trading_days: int = TRADING_DAYS) -> Outputs:
    span = positive_log(safe_divide(s.h, s.l))
    return {"parkinson": _annual(F.sqrt(s.mean(s.let(span * span), period) / (4 * math.log(2))), annualize, trading_days)}


def _drift_free(s: Series) -> Column:
    log = lambda a, b: positive_log(safe_divide(a, b))
    return s.let(log(s.h, s.c) * log(s.h, s.o) + log(s.l, s.c) * log(s.l, s.o))


@indicator
def rogers_satchell(s: Series, period: int = 20, *, annualize: bool = True, trading_days: int = TRADING_DAYS) -> Outputs:
    mean = s.mean(_drift_free(s), period)
    return {"rogers_satchell": F.when(mean.isNotNull(), _annual(F.sqrt(F.greatest(mean, F.lit(0.0))), annualize, trading_days))}


@indicator
def yang_zhang(s: Series, period: int = 20, *, annualize: bool = True, trading_days: int = TRADING_DAYS) -> Outputs:
    if period < 2:
        raise ValueError("period must be >= 2")
    gap = s.let(positive_log(safe_divide(s.o, s.lag(s.c))))
    day = s.let(F.when(gap.isNotNull(), positive_log(safe_divide(s.c, s.o))))
    inner = s.mean(s.let(F.when(gap.isNotNull(), _drift_free(s))), period)
    k = 0.34 / (1.34 + (period + 1) / (period - 1))
    total = s.let(s.var(gap, period) + k * s.var(day, period) + (1 - k) * inner)
    return {"yang_zhang": F.when(total.isNotNull(), _annual(F.sqrt(F.greatest(total, F.lit(0.0))), annualize, trading_days))}


# ---- volume ---------------------------------------------------------------


@indicator
def vwap(s: Series, *, session_col: str | None = None) -> Outputs:
    """Over the whole series, or anew from each change of ``session_col`` (timestamps count by date)."""
    worth = s.source("hlc3") * s.v
    w = s.window
    if session_col is not None:
        label = F.col(f"`{session_col}`")
        if dict(s.df.dtypes)[session_col].startswith("timestamp"):
            label = F.to_date(label)
        changed = s.let((~label.eqNullSafe(F.lag(label).over(s.window))).cast("int"))
        w = Window.partitionBy(*s.keys, s.cumulative(F.sum, changed)).orderBy(*s.order)
    w = w.rowsBetween(Window.unboundedPreceding, 0)
    return {"vwap": safe_divide(s.let(F.sum(s.let(worth)).over(w)), s.let(F.sum(s.v).over(w)))}


@indicator
def obv(s: Series, *, source: str = "close") -> Outputs:
    step = s.diff(s.source(source))
    return {"obv": s.cumulative(F.sum, s.let(F.coalesce(F.signum(step) * s.v, F.lit(0.0))))}


def _close_place(s: Series) -> Column:
    return safe_divide((s.c - s.l) - (s.h - s.c), s.h - s.l, 0.0) * s.v


@indicator
def cmf(s: Series, period: int = 20) -> Outputs:
    return {"cmf": safe_divide(s.sum(s.let(_close_place(s)), period), s.sum(s.v, period), 0.0)}


def _standing(s: Series, x: Column, period: int, ddof: int) -> Column:
    spread = s.std(x, period, ddof)
    return F.when(spread > EPSILON, (x - s.mean(x, period)) / spread).when(spread.isNotNull(), F.lit(0.0))


@indicator
def volume_zscore(s: Series, period: int = 20) -> Outputs:
    return {"volume_zscore": _standing(s, s.v, period, 1)}


@indicator
def vwma(s: Series, period: int = 20) -> Outputs:
    return {"vwma": safe_divide(s.sum(s.let(s.c * s.v), period), s.sum(s.v, period))}


@indicator
def ad_line(s: Series) -> Outputs:
    return {"ad_line": s.cumulative(F.sum, s.let(_close_place(s)))}


@indicator
def eom(s: Series, period: int = 14, *, divisor: float = 1e8) -> Outputs:
    move = s.diff(s.source("hl2"))
    return {"eom": s.mean(s.let(safe_divide(move * (s.h - s.l) * divisor, s.v)), period)}


def _volume_index(s: Series, initial: float, sign: int) -> Column:
    """Compounded close ratios of the bars whose volume moved by ``sign``."""
    prev, turn = s.lag(s.c), s.diff(s.v)
    growth = s.let(F.when((turn * sign > 0) & (F.abs(prev) > EPSILON), safe_divide(s.c, prev)).otherwise(F.lit(1.0)))
    return s.cumulative(F.product, growth) * initial


@indicator
def nvi(s: Series, *, initial: float = 1000.0) -> Outputs:
    return {"nvi": _volume_index(s, initial, -1)}


@indicator
def pvi(s: Series, *, initial: float = 1000.0) -> Outputs:
    return {"pvi": _volume_index(s, initial, 1)}


@indicator
def pvt(s: Series) -> Outputs:
    prev = s.lag(s.c)
    return {"pvt": s.cumulative(F.sum, s.let(F.coalesce(safe_divide(s.c - prev, prev, 0.0) * s.v, F.lit(0.0))))}


# ---- statistics -----------------------------------------------------------


@indicator
def zscore(s: Series, period: int = 60, *, ddof: int = 1, source: str = "close") -> Outputs:
    return {"zscore": _standing(s, s.source(source), period, ddof)}


def _pair_frames(s: Series, x: Column, y: Column, period: int) -> tuple[Column, Column, Column]:
    """(covariance, variance of x, variance of y), sample, where both are there in the whole frame."""
    w = s.window.rowsBetween(-(period - 1), 0)
    full = F.count(x * y).over(w) == period
    return tuple(s.let(F.when(full, f.over(w))) for f in (F.covar_samp(x, y), F.var_samp(x), F.var_samp(y)))


@indicator
def rolling_corr(s: Series, a: str, b: str, period: int = 60) -> Outputs:
    cov, vx, vy = _pair_frames(s, F.col(f"`{a}`"), F.col(f"`{b}`"), period)
    flat = (F.sqrt(vx) <= EPSILON) | (F.sqrt(vy) <= EPSILON)
    return {"rolling_corr": F.when(cov.isNull(), F.lit(None)).when(flat, F.lit(0.0)).otherwise(safe_divide(cov, F.sqrt(vx) * F.sqrt(vy), 0.0))}


@indicator
def rolling_beta(s: Series, asset: str, benchmark: str, period: int = 60) -> Outputs:
    cov, vx, _ = _pair_frames(s, F.col(f"`{benchmark}`"), F.col(f"`{asset}`"), period)
    return {"rolling_beta": safe_divide(cov, vx, 0.0)}


def _line(s: Series, source: str, period: int) -> tuple[Column, Column, Column]:
    """(slope, intercept, R2) of the last rows on 0 .. period - 1."""
    x = s.source(source)
    mean_t, var_t = (period - 1) / 2, period * (period * period - 1) / 12
    mean = s.mean(x, period)
    cross = s.weighted(x, [k - mean_t for k in range(period)])
    slope = s.let(cross / var_t if var_t > EPSILON else cross * 0.0)
    spread = s.let(s.frame(F.var_pop, x, period) * period)
    fit = F.when(spread > EPSILON, cross * cross / (max(var_t, EPSILON) * spread)).when(spread.isNotNull(), F.lit(0.0))
    return slope, s.let(mean - slope * mean_t), fit


@indicator
def linear_reg(s: Series, period: int = 20, *, source: str = "close") -> Outputs:
    slope, intercept, fit = _line(s, source, period)
    return {"slope": slope, "r_squared": fit, "intercept": intercept, "forecast": intercept + slope * period}


@indicator
def linear_reg_value(s: Series, period: int = 14, *, source: str = "close") -> Outputs:
    slope, intercept, _ = _line(s, source, period)
    return {"linear_reg_value": intercept + slope * (period - 1)}


@indicator
def linear_reg_angle(s: Series, period: int = 14, *, source: str = "close") -> Outputs:
    return {"linear_reg_angle": F.degrees(F.atan(_line(s, source, period)[0]))}


@indicator
def efficiency_ratio(s: Series, period: int = 10, *, source: str = "close") -> Outputs:
    x = s.source(source)
    path = s.sum(s.let(F.abs(s.diff(x))), period)
    return {"efficiency_ratio": safe_divide(F.abs(s.diff(x, period)), path)}


@indicator
def rolling_sharpe(s: Series, period: int = 63, *, returns: str = "ret", risk_free: float = 0.0, annualize: bool = True, trading_days: int = TRADING_DAYS) -> Outputs:
    x = s.let(F.col(f"`{returns}`") - risk_free)
    return {"rolling_sharpe": _annual(safe_divide(s.mean(x, period), s.std(x, period)), annualize, trading_days)}


@indicator
def rolling_sortino(s: Series, period: int = 63, *, returns: str = "ret", target: float = 0.0, annualize: bool = True, trading_days: int = TRADING_DAYS) -> Outputs:
    x = s.let(F.col(f"`{returns}`") - target)
    below = s.let(F.when(x.isNotNull(), F.least(x, F.lit(0.0)) * F.least(x, F.lit(0.0))))
    return {"rolling_sortino": _annual(safe_divide(s.mean(x, period), F.sqrt(s.mean(below, period))), annualize, trading_days)}
