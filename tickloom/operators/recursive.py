"""Indicators with true recurrences: one NumPy kernel per series.

A kernel sees the bars of one key in order (NULL as NaN) and returns arrays by
output name (NaN becomes NULL).  All kernels of a request run in one grouped map.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable

import numpy as np

from tickloom.functions.exprs import EPSILON

Outputs = dict[str, np.ndarray]
KERNELS: dict[str, Callable[..., Outputs]] = {}
#: Names of the outputs of each kernel.
OUTPUTS: dict[str, tuple[str, ...]] = {}


def kernel(*outputs: str):
    def register(f):
        KERNELS[f.__name__] = f
        OUTPUTS[f.__name__] = outputs or (f.__name__,)
        return f

    return register


class Bars:
    """Arrays of one series."""

    def __init__(self, **arrays: np.ndarray):
        self.o, self.h, self.l, self.c, self.v = (arrays.get(k) for k in ("open", "high", "low", "close", "volume"))
        self.n = len(next(iter(arrays.values())))

    def source(self, name: str) -> np.ndarray:
        if name == "hl2":
            return (self.h + self.l) / 2
        if name == "hlc3":
            return (self.h + self.l + self.c) / 3
        if name == "ohlc4":
            return (self.o + self.h + self.l + self.c) / 4
        if name in ("close", "open"):
            return self.c if name == "close" else self.o
        raise ValueError(f"unknown source {name!r}")

    def true_range(self, first: bool = True) -> np.ndarray:
        prev = lagged(self.c)
        out = np.fmax.reduce([self.h - self.l, np.abs(self.h - prev), np.abs(self.l - prev)])
        if self.n and not first:
            out[0] = np.nan
        return out


# ---- toolkit --------------------------------------------------------------


def lagged(x: np.ndarray, k: int = 1) -> np.ndarray:
    return np.concatenate((np.full(min(k, len(x)), np.nan), x[: len(x) - k])) if k else x


def ratio(a: np.ndarray, b: np.ndarray, fill: float = np.nan) -> np.ndarray:
    with np.errstate(all="ignore"):
        out = np.where(np.abs(b) > EPSILON, a / b, fill)
    return np.where(np.isnan(a) | np.isnan(b), np.nan, out)


def rolling(x: np.ndarray, period: int, how) -> np.ndarray:
    out = np.full(len(x), np.nan)
    if len(x) >= period:
        out[period - 1 :] = how(np.lib.stride_tricks.sliding_window_view(x, period), axis=1)
    return out


def scan(step: Callable[..., float], start: float, *inputs: np.ndarray) -> list[float]:
    """Successive states of ``state = step(state, *row)``."""
    out, state = [], start
    for row in zip(*(x.tolist() for x in inputs)):
        state = step(state, *row)
        out.append(state)
    return out


def _started(x: np.ndarray) -> int:
    valid = np.flatnonzero(~np.isnan(x))
    return int(valid[0]) if len(valid) else len(x)


def ema_from_mean(x: np.ndarray, period: int, alpha: float | None = None) -> np.ndarray:
    """Exponential mean that begins with the plain mean of the first ``period`` known values."""
    if period < 1:
        raise ValueError("period must be >= 1")
    out = np.full(len(x), np.nan)
    at = _started(x) + period - 1
    if at < len(x):
        a = 2 / (period + 1) if alpha is None else alpha
        out[at] = x[at - period + 1 : at + 1].mean()
        out[at + 1 :] = scan(lambda y, z: a * z + (1 - a) * y, out[at], x[at + 1 :])
    return out


def ema_from_first(x: np.ndarray, period: int, alpha: float | None = None) -> np.ndarray:
    """Exponential mean that begins with the first known value."""
    return ema_from_mean(x, 1, 2 / (period + 1) if alpha is None else alpha)


def wilder(x: np.ndarray, period: int) -> np.ndarray:
    return ema_from_mean(x, period, 1 / period)


def moving(x: np.ndarray, period: int, ma_type: str) -> np.ndarray:
    if ma_type == "sma":
        return rolling(x, period, np.mean)
    if ma_type == "ema":
        return ema_from_mean(x, period)
    raise ValueError(f"unknown ma_type {ma_type!r}; sma or ema")


def up_down(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rises and falls from the last value, NaN at the first."""
    step = x - lagged(x)
    return np.where(np.isnan(step), np.nan, np.maximum(step, 0)), np.where(np.isnan(step), np.nan, np.maximum(-step, 0))


def average_range(b: Bars, period: int, smoothing: str) -> np.ndarray:
    tr = b.true_range()
    if smoothing == "wilder":
        return wilder(tr, period)
    if smoothing == "ema":
        return ema_from_first(tr, period)
    if smoothing == "sma":
        return rolling(tr, period, np.mean)
    raise ValueError(f"unknown smoothing {smoothing!r}; wilder, ema or sma")


def strength(x: np.ndarray, period: int, alpha: float) -> np.ndarray:
    up, down = (ema_from_mean(part, period, alpha) for part in up_down(x))
    with np.errstate(all="ignore"):
        return 100 - 100 / (1 + up / np.maximum(down, EPSILON))


# ---- trend ----------------------------------------------------------------


@kernel()
def ema(b: Bars, period: int = 20, *, alpha: float | None = None, source: str = "close") -> Outputs:
    return {"ema": ema_from_first(b.source(source), period, alpha)}


def _chain(x: np.ndarray, times: int, smooth: Callable[[np.ndarray], np.ndarray]) -> list[np.ndarray]:
    out = []
    for _ in range(times):
        x = smooth(x)
        out.append(x)
    return out


@kernel()
def dema(b: Bars, period: int = 20, *, alpha: float | None = None, source: str = "close") -> Outputs:
    one, two = _chain(b.source(source), 2, lambda x: ema_from_first(x, period, alpha))
    return {"dema": 2 * one - two}


@kernel()
def tema(b: Bars, period: int = 20, *, alpha: float | None = None, source: str = "close") -> Outputs:
    one, two, three = _chain(b.source(source), 3, lambda x: ema_from_first(x, period, alpha))
    return {"tema": 3 * one - 3 * two + three}


@kernel()
def kama(b: Bars, period: int = 10, *, fast_period: int = 2, slow_period: int = 30, source: str = "close") -> Outputs:
    x = b.source(source)
    out = np.full(b.n, np.nan)
    if b.n > period:
        fast, slow = 2 / (fast_period + 1), 2 / (slow_period + 1)
        path = rolling(np.abs(np.diff(x)), period, np.sum)[period - 1 :]
        trend = ratio(np.abs(x[period:] - x[:-period]), path, 0.0)
        rate = (trend * (fast - slow) + slow) ** 2
        out[period - 1] = x[period - 1]
        out[period:] = scan(lambda y, z, r: y + r * (z - y), x[period - 1], x[period:], rate)
    return {"kama": out}


@kernel()
def supertrend(b: Bars, period: int = 10, *, multiplier: float = 3.0) -> Outputs:
    """Starts on the upper band at ``period``; the side follows the last close against the last line."""
    width = multiplier * average_range(b, period, "wilder")
    middle = (b.h + b.l) / 2
    out = np.full(b.n, np.nan)
    if b.n > period:
        # state: line, and the lower and upper band as ratcheted so far
        first = (middle[period] + width[period], middle[period] - width[period], middle[period] + width[period])

        def step(state, close, centre, w):
            line, floor, roof = state
            if close > line:
                floor, roof = max(centre - w, floor), centre + w
                return floor, floor, roof
            floor, roof = centre - w, min(centre + w, roof)
            return roof, floor, roof

        rest = slice(period + 1, None)
        out[period] = first[0]
        out[rest] = [s[0] for s in scan(step, first, b.c[period:-1], middle[rest], width[rest])]
    return {"supertrend": out}


@kernel()
def t3(b: Bars, period: int = 5, *, vfactor: float = 0.7, source: str = "close") -> Outputs:
    _, _, e3, e4, e5, e6 = _chain(b.source(source), 6, lambda x: ema_from_mean(x, period))
    a = vfactor
    return {"t3": -(a**3) * e6 + 3 * a * a * (1 + a) * e5 - 3 * a * (1 + a) ** 2 * e4 + (1 + a) ** 3 * e3}


@kernel()
def zlema(b: Bars, period: int = 20, *, source: str = "close") -> Outputs:
    x = b.source(source)
    return {"zlema": ema_from_mean(2 * x - lagged(x, (period - 1) // 2), period)}


@kernel()
def vidya(b: Bars, period: int = 14, *, cmo_period: int = 9, source: str = "close") -> Outputs:
    x = b.source(source)
    up, down = (rolling(p, cmo_period, np.sum) for p in up_down(x))
    rate = np.abs(ratio(up - down, up + down, 0.0)) * 2 / (period + 1)
    out = np.full(b.n, np.nan)
    if b.n > cmo_period:
        out[cmo_period] = x[cmo_period]
        rest = slice(cmo_period + 1, None)
        out[rest] = scan(lambda y, z, r: r * z + (1 - r) * y, x[cmo_period], x[rest], rate[rest])
    return {"vidya": out}


@kernel()
def mcginley(b: Bars, period: int = 10, *, k: float = 0.6, source: str = "close") -> Outputs:
    x = b.source(source)

    def step(y, z):
        pull = (z / y) ** 4 if abs(y) > EPSILON else 0.0
        return y + (z - y) / (k * period * pull) if pull else math.nan  # diverged

    return {"mcginley": np.array([*x[:1], *scan(step, float(x[0]), x[1:])]) if b.n else x}


@kernel()
def psar(b: Bars, *, acceleration: float = 0.02, maximum: float = 0.2) -> Outputs:
    """Parabolic stop: accelerates towards the extreme point and turns when it is touched.

    Both sides are one rule on mirrored prices: for a short the signs of highs and
    lows are swapped.
    """
    out = np.full(b.n, np.nan)
    if b.n < 2:
        return {"psar": out}
    high, low = b.h.tolist(), b.l.tolist()
    fall, rise = low[0] - low[1], high[1] - high[0]
    side = -1 if fall > 0 and rise < fall else 1
    reach = lambda t: high[t] if side > 0 else -low[t]  # noqa: E731  in the direction of the side
    guard = lambda t: low[t] if side > 0 else -high[t]  # noqa: E731  against it
    stop, extreme, speed = guard(0), reach(1), acceleration
    guards = (guard(1), guard(1))  # of the bar before and of this one
    for t in range(1, b.n):
        if t > 1:
            guards = (guard(t - 1), guard(t))
        if guards[1] <= stop:  # touched: the stop jumps to the extreme point, on the other side
            side = -side
            stop = min(-extreme, guard(t - 1) if t > 1 else guard(t), guard(t))
            out[t] = side * stop
            speed, extreme = acceleration, reach(t)
        else:
            out[t] = side * stop
            if reach(t) > extreme:
                extreme, speed = reach(t), min(speed + acceleration, maximum)
        stop = min(stop + speed * (extreme - stop), guard(t - 1) if t > 1 else guard(t), guard(t))
    return {"psar": out}


@kernel()
def trix(b: Bars, period: int = 30, *, source: str = "close") -> Outputs:
    triple = _chain(b.source(source), 3, lambda x: ema_from_mean(x, period))[2]
    return {"trix": ratio(triple - lagged(triple), lagged(triple), 0.0) * 100}


@kernel()
def mass_index(b: Bars, fast_period: int = 9, slow_period: int = 25) -> Outputs:
    one, two = _chain(b.h - b.l, 2, lambda x: ema_from_mean(x, fast_period))
    return {"mass_index": rolling(ratio(one, two), slow_period, np.sum)}


def _smoothed_place(x: np.ndarray, period: int, factor: float) -> np.ndarray:
    """Place of x in its rolling range, in percent (the last one where the range is empty), smoothed from its first value."""
    low, high = rolling(x, period, np.min), rolling(x, period, np.max)
    out = np.full(len(x), np.nan)
    start = _started(low)
    state = (0.0, math.nan)  # last place, smoothed

    def step(s, value, a, z):
        place = (value - a) / (z - a) * 100 if z > a else s[0]
        return place, place if math.isnan(s[1]) else s[1] + factor * (place - s[1])

    out[start:] = [s[1] for s in scan(step, state, x[start:], low[start:], high[start:])]
    return out


@kernel()
def stc(b: Bars, cycle: int = 10, fast_period: int = 23, slow_period: int = 50, *, factor: float = 0.5, source: str = "close") -> Outputs:
    x = b.source(source)
    line = ema_from_mean(x, fast_period) - ema_from_mean(x, slow_period)
    return {"stc": _smoothed_place(_smoothed_place(line, cycle, factor), cycle, factor)}


# ---- momentum -------------------------------------------------------------


@kernel()
def rsi(b: Bars, period: int = 14, *, smoothing: str = "wilder", source: str = "close") -> Outputs:
    rates = {"wilder": 1 / period, "ema": 2 / (period + 1)}
    if smoothing not in rates:
        raise ValueError(f"unknown smoothing {smoothing!r}; wilder or ema")
    return {"rsi": strength(b.source(source), period, rates[smoothing])}


@kernel("macd", "signal", "histogram")
def macd(b: Bars, fast_period: int = 12, slow_period: int = 26, signal_period: int = 9, *, source: str = "close") -> Outputs:
    x = b.source(source)
    line = ema_from_first(x, fast_period) - ema_from_first(x, slow_period)
    signal = ema_from_first(line, signal_period)
    return {"macd": line, "signal": signal, "histogram": line - signal}


def _directional(b: Bars) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(+DM, -DM, true range), NaN at the first bar."""
    rise, fall = b.h - lagged(b.h), lagged(b.l) - b.l
    nothing = np.where(np.isnan(rise), np.nan, 0.0)
    return np.where((rise > fall) & (rise > 0), rise, nothing), np.where((fall > rise) & (fall > 0), fall, nothing), b.true_range(first=False)


def _dx(plus: np.ndarray, minus: np.ndarray) -> np.ndarray:
    return ratio(100 * np.abs(plus - minus), plus + minus, 0.0)


@kernel()
def adx(b: Bars, period: int = 14) -> Outputs:
    up, down, tr = (wilder(x, period) for x in _directional(b))
    return {"adx": wilder(_dx(ratio(up, tr, 0.0) * 100, ratio(down, tr, 0.0) * 100), period)}


@kernel("fast_k", "fast_d")
def stoch_rsi(b: Bars, period: int = 14, fastk_period: int = 5, fastd_period: int = 3, *, ma_type: str = "sma", source: str = "close") -> Outputs:
    r = strength(b.source(source), period, 1 / period)
    low = rolling(r, fastk_period, np.min)
    k = ratio(r - low, rolling(r, fastk_period, np.max) - low, 0.0) * 100
    d = moving(k, fastd_period, ma_type)
    return {"fast_k": np.where(np.isnan(d), np.nan, k), "fast_d": d}


@kernel()
def cmo_wilder(b: Bars, period: int = 14, *, source: str = "close") -> Outputs:
    up, down = (wilder(x, period) for x in up_down(b.source(source)))
    return {"cmo_wilder": ratio(up - down, up + down, 0.0) * 100}


@kernel("slow_k", "slow_d")
def stochastic_slow_ema(b: Bars, fastk_period: int = 5, slowk_period: int = 3, slowd_period: int = 3) -> Outputs:
    low = rolling(b.l, fastk_period, np.min)
    k = ema_from_mean(ratio(b.c - low, rolling(b.h, fastk_period, np.max) - low, 0.0) * 100, slowk_period)
    d = ema_from_mean(k, slowd_period)
    return {"slow_k": np.where(np.isnan(d), np.nan, k), "slow_d": d}


@kernel("k", "d")
def stochastic_ema(b: Bars, k_period: int = 14, d_period: int = 3) -> Outputs:
    low = rolling(b.l, k_period, np.min)
    spread = rolling(b.h, k_period, np.max) - low
    k = np.where(np.isnan(spread), np.nan, ratio(b.c - low, spread, 0.5) * 100)
    d = ema_from_first(np.where(np.isnan(k), 50.0, k), d_period)
    d[: k_period - 1] = np.nan
    return {"k": k, "d": d}


def _two_means(x: np.ndarray, fast_period: int, slow_period: int, ma_type: str) -> tuple[np.ndarray, np.ndarray]:
    fast, slow = sorted((fast_period, slow_period))
    return moving(x, fast, ma_type), moving(x, slow, ma_type)


@kernel()
def apo(b: Bars, fast_period: int = 12, slow_period: int = 26, *, ma_type: str = "ema", source: str = "close") -> Outputs:
    fast, slow = _two_means(b.source(source), fast_period, slow_period, ma_type)
    return {"apo": fast - slow}


@kernel()
def ppo(b: Bars, fast_period: int = 12, slow_period: int = 26, *, ma_type: str = "ema", source: str = "close") -> Outputs:
    fast, slow = _two_means(b.source(source), fast_period, slow_period, ma_type)
    return {"ppo": ratio(fast - slow, slow, 0.0) * 100}


@kernel("tsi", "signal")
def tsi(b: Bars, long_period: int = 25, short_period: int = 13, signal_period: int = 13, *, source: str = "close") -> Outputs:
    x = b.source(source)
    step = x - lagged(x)
    smooth = lambda z: ema_from_mean(ema_from_mean(z, long_period), short_period)
    line = ratio(smooth(step), smooth(np.abs(step)), 0.0) * 100
    return {"tsi": line, "signal": ema_from_mean(line, signal_period)}


@kernel()
def connors_rsi(b: Bars, rsi_period: int = 3, streak_period: int = 2, rank_period: int = 100, *, source: str = "close") -> Outputs:
    x = b.source(source)
    turn = np.sign(np.diff(x, prepend=x[:1]))
    streak = np.array(scan(lambda y, t: t if y * t <= 0 else y + t, 0.0, turn))
    step = ratio(x - lagged(x), lagged(x), 0.0)
    rank = np.full(b.n, np.nan)
    if b.n > rank_period + 1:
        before = np.lib.stride_tricks.sliding_window_view(step[1:], rank_period)[:-1]
        rank[rank_period + 1 :] = (before < step[rank_period + 1 :, None]).mean(axis=1) * 100
    return {"connors_rsi": (strength(x, rsi_period, 1 / rsi_period) + strength(streak, streak_period, 1 / streak_period) + rank) / 3}


@kernel("fisher", "trigger")
def fisher_transform(b: Bars, period: int = 9) -> Outputs:
    x = (b.h + b.l) / 2
    low = rolling(x, period, np.min)
    place = ratio(x - low, rolling(x, period, np.max) - low, 0.5) - 0.5

    def bounded(v, p):
        v = 0.66 * p + 0.67 * v
        return math.copysign(0.999, v) if abs(v) > 0.99 else v

    out = np.full(b.n, np.nan)
    value = np.array(scan(bounded, 0.0, place[period - 1 :]))
    out[period - 1 :] = scan(lambda f, v: 0.5 * math.log((1 + v) / (1 - v)) + 0.5 * f, 0.0, value)
    return {"fisher": out, "trigger": lagged(out)}


@kernel("bull_power", "bear_power")
def elder_ray(b: Bars, period: int = 13) -> Outputs:
    mean = ema_from_mean(b.c, period)
    return {"bull_power": b.h - mean, "bear_power": b.l - mean}


@kernel("wt1", "wt2")
def wavetrend(b: Bars, channel_period: int = 10, average_period: int = 21, signal_period: int = 4) -> Outputs:
    x = b.source("hlc3")
    off = x - ema_from_mean(x, channel_period)
    line = ema_from_mean(ratio(off, 0.015 * ema_from_mean(np.abs(off), channel_period)), average_period)
    return {"wt1": line, "wt2": rolling(line, signal_period, np.mean)}


@kernel("plus_di", "minus_di", "dx", "adx", "adxr", "plus_dm", "minus_dm")
def dmi(b: Bars, period: int = 14) -> Outputs:
    """Running sums that lose a ``period``-th of themselves with each bar, from the first ``period - 1`` movements on."""

    def total(x: np.ndarray) -> np.ndarray:
        out = np.full(b.n, np.nan)
        if b.n >= period >= 2:
            out[period - 1] = x[1:period].sum()
            out[period:] = scan(lambda s, z: s - s / period + z, out[period - 1], x[period:])
        return out

    up, down, tr = (total(x) for x in _directional(b))
    tr[: min(period, b.n)] = np.nan
    plus, minus = ratio(100 * up, tr, 0.0), ratio(100 * down, tr, 0.0)
    dx = _dx(plus, minus)
    mean = wilder(dx, period)
    return {"plus_di": plus, "minus_di": minus, "dx": dx, "adx": mean, "adxr": (mean + lagged(mean, period - 1)) / 2, "plus_dm": up, "minus_dm": down}


# ---- volatility -----------------------------------------------------------


@kernel()
def atr(b: Bars, period: int = 14, *, smoothing: str = "wilder") -> Outputs:
    return {"atr": average_range(b, period, smoothing)}


@kernel()
def natr(b: Bars, period: int = 14, *, smoothing: str = "wilder") -> Outputs:
    return {"natr": ratio(average_range(b, period, smoothing), b.c) * 100}


@kernel("upper", "middle", "lower")
def keltner(b: Bars, period: int = 20, *, atr_period: int = 10, multiplier: float = 1.5, atr_smoothing: str = "wilder") -> Outputs:
    middle, width = ema_from_first(b.c, period), multiplier * average_range(b, atr_period, atr_smoothing)
    return {"upper": middle + width, "middle": middle, "lower": middle - width}


@kernel("upper", "middle", "lower")
def bollinger_ema(b: Bars, period: int = 20, *, num_std: float = 2.0, source: str = "close") -> Outputs:
    x = b.source(source)
    middle, width = ema_from_first(x, period), num_std * rolling(x, period, np.std)
    return {"upper": middle + width, "middle": middle, "lower": middle - width}


@kernel()
def chaikin_volatility(b: Bars, period: int = 10, roc_period: int = 10) -> Outputs:
    mean = ema_from_mean(b.h - b.l, period)
    prev = lagged(mean, roc_period)
    return {"chaikin_volatility": ratio(mean - prev, prev) * 100}


# ---- volume ---------------------------------------------------------------


@kernel()
def adosc(b: Bars, fast_period: int = 3, slow_period: int = 10) -> Outputs:
    line = np.cumsum(ratio((b.c - b.l) - (b.h - b.c), b.h - b.l, 0.0) * b.v)
    out = ema_from_first(line, fast_period) - ema_from_first(line, slow_period)
    out[: max(fast_period, slow_period) - 1] = np.nan
    return {"adosc": out}


@kernel()
def force_index(b: Bars, period: int = 13) -> Outputs:
    return {"force_index": ema_from_mean((b.c - lagged(b.c)) * b.v, period)}


@kernel("klinger", "signal")
def klinger(b: Bars, fast_period: int = 34, slow_period: int = 55, signal_period: int = 13) -> Outputs:
    x = b.source("hlc3")
    flow = np.sign(x - lagged(x)) * b.v
    line = ema_from_mean(flow, fast_period) - ema_from_mean(flow, slow_period)
    return {"klinger": line, "signal": ema_from_mean(line, signal_period)}


@kernel("pvo", "signal", "histogram")
def pvo(b: Bars, fast_period: int = 12, slow_period: int = 26, signal_period: int = 9) -> Outputs:
    fast, slow = ema_from_mean(b.v, fast_period), ema_from_mean(b.v, slow_period)
    line = ratio(fast - slow, slow) * 100
    signal = ema_from_mean(line, signal_period)
    return {"pvo": line, "signal": signal, "histogram": line - signal}


def outputs_of(names: Iterable[str]) -> list[str]:
    return [o for n in names for o in OUTPUTS[n]]
