"""Small helpers that write DuckDB SQL over ordered series (s: symbol, i from 0, o, h, l, c, v)."""

from __future__ import annotations

OVER = "PARTITION BY symbol ORDER BY i"


def roll(fn: str, x: str, p: int, end: int = 0) -> str:
    w = f"OVER ({OVER} ROWS BETWEEN {p - 1 + end} PRECEDING AND {f'{end} PRECEDING' if end else 'CURRENT ROW'})"
    return f"(CASE WHEN count({x}) {w} = {p} THEN {fn}({x}) {w} END)"


def mean(x: str, p: int) -> str:
    return roll("avg", x, p)


def total(x: str, p: int) -> str:
    return roll("sum", x, p)


def top(x: str, p: int) -> str:
    return roll("max", x, p)


def low(x: str, p: int) -> str:
    return roll("min", x, p)


def lag(x: str, n: int = 1) -> str:
    return f"lag({x}, {n}) OVER ({OVER})"


def cum(fn: str, x: str) -> str:
    return f"{fn}({x}) OVER ({OVER} ROWS UNBOUNDED PRECEDING)"


def div(n: str, d: str, fill: str = "NULL") -> str:
    return f"(CASE WHEN ({n}) IS NULL OR ({d}) IS NULL THEN NULL WHEN abs({d}) > 1e-15 THEN ({n}) / ({d}) ELSE {fill} END)"


def weighted(x: str, weights: list[float]) -> str:
    n = len(weights)
    return "(" + " + ".join(f"{w!r}::DOUBLE * {lag(x, n - 1 - k)}" for k, w in enumerate(weights)) + ")"


def wma(x: str, p: int) -> str:
    return weighted(x, [2 * (k + 1) / (p * (p + 1)) for k in range(p)])


class Query:
    """A chain of materialised stages; each adds columns to the series."""

    def __init__(self, bars_sql: str):
        self.parts = [f"bars AS MATERIALIZED ({bars_sql})", f"s0 AS MATERIALIZED (SELECT symbol, ts, open AS o, high AS h, low AS l, close AS c, volume AS v, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS i FROM bars)"]
        self.at = 0

    def let(self, **columns: str) -> "Query":
        self.parts.append(f"s{self.at + 1} AS MATERIALIZED (SELECT *, {', '.join(f'{e} AS {n}' for n, e in columns.items())} FROM s{self.at})")
        self.at += 1
        return self

    def fold(self, seed: str, **steps: str) -> "Query":
        """Columns by recursion.  ``seed``: SELECT symbol, i, <columns>; in steps r is the last state and t this row."""
        self.at += 1
        k, s = self.at, f"s{self.at - 1}"
        names = list(steps)
        self.parts.append(
            f"f{k}(symbol, i, {', '.join(names)}) AS ({seed.replace('@', s)} UNION ALL "
            f"SELECT t.symbol, t.i, {', '.join(steps[n] for n in names)} FROM f{k} r JOIN {s} t ON t.symbol = r.symbol AND t.i = r.i + 1)"
        )
        self.parts.append(f"s{k} AS MATERIALIZED (SELECT t.*, {', '.join(f'r.{n}' for n in names)} FROM {s} t LEFT JOIN f{k} r ON r.symbol = t.symbol AND r.i = t.i)")
        return self

    def ema(self, new: str, x: str, p: int, alpha: float | None = None) -> "Query":
        """Exponential mean from the plain mean of the first p known values."""
        a = 2 / (p + 1) if alpha is None else alpha
        seed = (
            f"SELECT d.symbol, d.k, avg(t.{x}) FROM (SELECT symbol, min(i) + {p - 1} AS k FROM @ WHERE {x} IS NOT NULL GROUP BY symbol) d "
            f"JOIN @ t ON t.symbol = d.symbol AND t.i BETWEEN d.k - {p - 1} AND d.k GROUP BY d.symbol, d.k HAVING max(t.i) = d.k"
        )
        return self.fold(seed, **{new: f"{a!r}::DOUBLE * t.{x} + {1 - a!r}::DOUBLE * r.{new}"})

    def ema1(self, new: str, x: str, p: int, alpha: float | None = None) -> "Query":
        """Exponential mean from the first known value."""
        return self.ema(new, x, 1, 2 / (p + 1) if alpha is None else alpha)

    def wilder(self, new: str, x: str, p: int) -> "Query":
        return self.ema(new, x, p, 1 / p)

    def tr(self, first: bool = True) -> "Query":
        self.let(pc=lag("c"))
        return self.let(tr=f"CASE WHEN pc IS NULL THEN {'h - l' if first else 'NULL'} ELSE greatest(h - l, abs(h - pc), abs(l - pc)) END")

    def updown(self, x: str = "c") -> "Query":
        self.let(dx=f"{x} - {lag(x)}")
        return self.let(up="CASE WHEN dx > 0 THEN dx WHEN dx IS NOT NULL THEN 0.0 END", dn="CASE WHEN dx < 0 THEN -dx WHEN dx IS NOT NULL THEN 0.0 END")

    def rsi(self, new: str, x: str, p: int) -> "Query":
        self.let(**{f"{new}_d": f"{x} - {lag(x)}"})
        self.let(**{f"{new}_u": f"CASE WHEN {new}_d > 0 THEN {new}_d WHEN {new}_d IS NOT NULL THEN 0.0 END", f"{new}_n": f"CASE WHEN {new}_d < 0 THEN -{new}_d WHEN {new}_d IS NOT NULL THEN 0.0 END"})
        self.wilder(f"{new}_a", f"{new}_u", p).wilder(f"{new}_b", f"{new}_n", p)
        return self.let(**{new: f"100 - 100 / (1 + {new}_a / greatest({new}_b, 1e-15))"})

    def done(self, digits: int = 6, **outputs: str) -> str:
        columns = ", ".join(f"round(({e})::DOUBLE, {digits}) AS {n}" for n, e in outputs.items())
        return f"WITH RECURSIVE {', '.join(self.parts)} SELECT symbol, ts, {columns} FROM s{self.at}"
