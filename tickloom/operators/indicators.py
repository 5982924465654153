"""Technical indicators over long bars tables.

``compute(bars, "rsi", "sma", ("macd", {"fast_period": 8}))`` returns the keys,
the order columns and every output.  Windowed indicators are Catalyst window
expressions over one shared sort; recursive ones run together in one grouped map
that reuses that partitioning, so any request costs a single exchange.  A series
is one task's work: parallelism is the number of keys.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.functions.exprs import EPSILON, Series

from . import recursive, windowed

Request = str | tuple[str, dict[str, Any]]
ROLES = ("open", "high", "low", "close", "volume")

#: A parameter value that makes a windowed indicator recursive, and the kernel then used.
_VARIANTS = {
    ("cmo", "smoothing", "wilder"): "cmo_wilder",
    ("stochastic_slow", "ma_type", "ema"): "stochastic_slow_ema",
    ("stochastic", "d_ma_type", "ema"): "stochastic_ema",
    ("bollinger", "ma_type", "ema"): "bollinger_ema",
}
_PLAIN = {("cmo", "smoothing"): "sum", ("stochastic_slow", "ma_type"): "sma", ("stochastic", "d_ma_type"): "sma", ("bollinger", "ma_type"): "sma"}
NAMES = sorted(set(windowed.INDICATORS) | (set(recursive.KERNELS) - set(_VARIANTS.values())) | {"hurst"})


def _resolve(request: Request) -> tuple[str, str, dict[str, Any]]:
    """(public name, implementation, parameters)."""
    name, options = (request, {}) if isinstance(request, str) else (request[0], dict(request[1]))
    for key in [k for k in options if (name, k) in _PLAIN]:
        value = options.pop(key)
        if value != _PLAIN[name, key]:
            if (name, key, value) not in _VARIANTS:
                raise ValueError(f"unknown {key} {value!r}")
            return name, _VARIANTS[name, key, value], options
    if name not in windowed.INDICATORS and name not in recursive.KERNELS:
        raise ValueError(f"unknown indicator {name!r}")
    return name, name, options


def compute(bars: DataFrame, *requests: Request, keys: Sequence[str] = ("symbol",), order: Sequence[str] = ("ts",), columns: dict[str, str] | None = None, prefix: bool | None = None) -> DataFrame:
    """Keys, order columns and outputs; with several requests outputs are named ``<indicator>_<output>`` where that differs.

    ``order`` must be a total order within a key.  ``columns`` renames roles
    (open, high, low, close, volume).
    """
    plans = [_resolve(r) for r in requests]
    prefix = len(plans) > 1 if prefix is None else prefix
    named = lambda name, out: out if not prefix or out == name else f"{name}_{out}"
    series = Series(bars, keys, order, columns)
    made: list[str] = []
    for name, impl, options in plans:
        if impl in windowed.INDICATORS:
            for out, value in windowed.INDICATORS[impl](series, **options).items():
                series.df = series.df.withColumn(named(name, out), value)
                made.append(named(name, out))
    folds = [(name, impl, options) for name, impl, options in plans if impl in recursive.KERNELS and impl not in windowed.INDICATORS]
    head = [*keys, *order]
    if not folds:
        return series.df.select(*head, *made)
    present = [r for r in ROLES if f"_{r}" in series.df.columns]
    narrow = series.df.select(*head, *made, *[f"_{r}" for r in present])
    new = [named(name, out) for name, impl, _ in folds for out in recursive.OUTPUTS[impl]]
    kinds = {f.name: f.dataType.simpleString() for f in narrow.schema.fields}
    schema = ", ".join([f"`{c}` {kinds[c]}" for c in [*head, *made]] + [f"`{c}` double" for c in new])
    ordering = list(order)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(ordering, kind="stable")
        b = recursive.Bars(**{r: rows[f"_{r}"].to_numpy(dtype=np.float64, copy=True) for r in present})
        out = {c: rows[c] for c in [*head, *made]}
        for name, impl, options in folds:
            for label, values in recursive.KERNELS[impl](b, **options).items():
                out[named(name, label)] = pd.Series(values, index=rows.index)
        return pd.DataFrame(out)[[*head, *made, *new]]

    return narrow.groupBy(*keys).applyInPandas(run, schema)


def latest(values: DataFrame, *outputs: str, keys: Sequence[str] = ("symbol",), order: str = "ts") -> DataFrame:
    """The last known value of each output per key."""
    return values.groupBy(*keys).agg(*[F.max_by(F.col(o), F.when(F.col(o).isNotNull(), F.col(order))).alias(o) for o in outputs])


def rescaled_range_exponent(steps: np.ndarray, max_lag: int, min_lag: int) -> float:
    """Slope of ln(mean R/S) on ln(lag) over the whole blocks of each lag; 0.5 where it cannot be told."""
    known = int(np.isfinite(steps).sum())
    points = []
    for lag in range(min_lag, min(max_lag, known // 2) + 1):
        blocks = steps[: known // lag * lag].reshape(-1, lag)
        counts = np.isfinite(blocks).sum(axis=1)
        blocks = blocks[counts > 1]
        if not len(blocks):
            continue
        off = blocks - np.nanmean(blocks, axis=1, keepdims=True)
        walk = np.nancumsum(off, axis=1)
        spread = np.sqrt(np.nansum(off**2, axis=1) / (counts[counts > 1] - 1))
        live = spread > EPSILON
        if live.any():
            points.append((np.log(lag), np.log(((walk.max(axis=1) - walk.min(axis=1))[live] / spread[live]).mean())))
    if len(points) < 2:
        return 0.5
    x, y = np.array(points).T
    return float(((x - x.mean()) * (y - y.mean())).sum() / ((x - x.mean()) ** 2).sum())


def hurst(bars: DataFrame, max_lag: int = 100, *, min_lag: int = 2, source: str = "close", keys: Sequence[str] = ("symbol",), order: Sequence[str] = ("ts",), columns: dict[str, str] | None = None) -> DataFrame:
    """Rescaled-range exponent per key: one exchange, one kernel per series."""
    s = Series(bars, keys, order, columns)
    narrow = s.df.select(*keys, *order, F.ln(F.greatest(s.source(source), F.lit(EPSILON))).alias("_log"))
    kinds, ordering = dict(narrow.dtypes), list(order)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        steps = np.diff(rows.sort_values(ordering, kind="stable")["_log"].to_numpy(dtype=np.float64))
        return pd.DataFrame({k: [rows[k].iloc[0]] for k in keys} | {"hurst": [rescaled_range_exponent(steps, max_lag, min_lag)]})

    return narrow.groupBy(*keys).applyInPandas(run, ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "hurst double"]))
