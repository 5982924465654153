"""Null-safe arithmetic and window frames over ordered series.

Undefined values are NULL, never NaN: a frame is defined only if it is full and
none of its inputs is NULL.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Denominators up to this size count as zero.
EPSILON = 1e-15
TRADING_DAYS = 252


def safe_divide(numerator: Column, denominator: Column, fill: float | None = None) -> Column:
    """numerator / denominator; ``fill`` where the denominator is zero, NULL where an operand is."""
    whole = numerator.isNotNull() & denominator.isNotNull()
    return F.when(whole & (F.abs(denominator) > EPSILON), numerator / denominator).when(whole, F.lit(fill))


def number(column: Column) -> Column:
    """As double, with NaN as NULL."""
    x = column.cast("double")
    return F.when(~F.isnan(x), x)


def positive_log(column: Column) -> Column:
    """ln, NULL for what has none."""
    return F.when(column > 0, F.ln(column))


class Series:
    """A bars DataFrame with frames over its (key, order) windows.

    Intermediate columns are added to ``df`` under reserved names.  All frames
    share one partitioning and one sort, so a whole set of indicators costs one
    exchange.
    """

    SOURCES = ("close", "open", "hl2", "hlc3", "ohlc4")

    def __init__(self, df: DataFrame, keys: Sequence[str] = ("symbol",), order: Sequence[str] = ("ts",), columns: dict[str, str] | None = None):
        names = {"open": "open", "high": "high", "low": "low", "close": "close", "volume": "volume"} | (columns or {})
        self.keys, self.order = list(keys), list(order)
        self.window = Window.partitionBy(*self.keys).orderBy(*self.order)
        self._count = 0
        present = {role: name for role, name in names.items() if name in df.columns}
        self.df = df.withColumns({f"_{role}": number(F.col(f"`{name}`")) for role, name in present.items()})

    def __getattr__(self, name: str) -> Column:
        if name in ("o", "h", "l", "c", "v"):
            role = {"o": "open", "h": "high", "l": "low", "c": "close", "v": "volume"}[name]
            return self.df[f"_{role}"]  # a missing column is an analysis error here
        raise AttributeError(name)

    def let(self, value: Column) -> Column:
        self._count += 1
        name = f"_t{self._count}"
        self.df = self.df.withColumn(name, value)
        return F.col(name)

    def source(self, name: str = "close") -> Column:
        if name not in self.SOURCES:
            raise ValueError(f"unknown source {name!r}; one of {', '.join(self.SOURCES)}")
        if name in ("close", "open"):
            return F.col(f"_{name}")
        o, h, l, c = (F.col(f"_{r}") for r in ("open", "high", "low", "close"))  # noqa: E741
        return self.let({"hl2": (h + l) / 2, "hlc3": (h + l + c) / 3, "ohlc4": (o + h + l + c) / 4}[name])

    def row(self) -> Column:
        """Place in the series, from 0."""
        if "_row" not in self.df.columns:
            self.df = self.df.withColumn("_row", F.row_number().over(self.window) - 1)
        return F.col("_row")

    def lag(self, x: Column, n: int = 1) -> Column:
        return self.let(F.lag(x, n).over(self.window)) if n else x

    def diff(self, x: Column, n: int = 1) -> Column:
        return self.let(x - F.lag(x, n).over(self.window))

    def frame(self, aggregate, x: Column, period: int, end: int = 0) -> Column:
        """``aggregate(x)`` over ``period`` rows up to ``end`` rows before this one, if all are there."""
        if period < 1:
            raise ValueError("period must be >= 1")
        w = self.window.rowsBetween(-(period - 1) - end, -end)
        return self.let(F.when(F.count(x).over(w) == period, aggregate(x).over(w)))

    def mean(self, x: Column, period: int, end: int = 0) -> Column:
        return self.frame(F.avg, x, period, end)

    def sum(self, x: Column, period: int) -> Column:
        return self.frame(F.sum, x, period)

    def max(self, x: Column, period: int) -> Column:
        return self.frame(F.max, x, period)

    def min(self, x: Column, period: int) -> Column:
        return self.frame(F.min, x, period)

    def std(self, x: Column, period: int, ddof: int = 1) -> Column:
        return self.frame(F.stddev_samp if ddof else F.stddev_pop, x, period)

    def var(self, x: Column, period: int) -> Column:
        return self.frame(F.var_samp, x, period)

    def weighted(self, x: Column, weights: Sequence[float]) -> Column:
        """Sum of the last rows by weights, oldest first; NULL unless all are there."""
        last = len(weights) - 1
        return self.let(reduce(add, (F.lag(x, last - k).over(self.window) * float(w) for k, w in enumerate(weights))))

    def wma(self, x: Column, period: int) -> Column:
        total = period * (period + 1) / 2
        return self.weighted(x, [(k + 1) / total for k in range(period)])

    def cumulative(self, aggregate, x: Column) -> Column:
        return self.let(aggregate(x).over(self.window.rowsBetween(Window.unboundedPreceding, 0)))

    def true_range(self, first: bool = True) -> Column:
        """Greatest of the bar's range and its distance from the last close; the first bar has its range, or nothing."""
        prev = self.lag(self.c)
        full = F.greatest(self.h - self.l, F.abs(self.h - prev), F.abs(self.l - prev))
        return self.let(F.when(prev.isNotNull(), full).otherwise((self.h - self.l) if first else F.lit(None)))
