"""Candlestick patterns as a table of rules.

A rule is a SQL condition over names of recent bars: ``o1`` is the open one bar
back, ``c0`` this close.  Per bar there are o, h, l, c, body (its size), top and
bot (its ends), up and dn (shadows) and col (1 rising, else -1); per bar and
setting there is the mean over the bars before it: long, short, doji, svs (very
short shadow), ssh (short shadow), near, far and eq.  All names a request needs
become columns over one window; each pattern is then one CASE expression.

Signals are integers: 0 none, +-100, +-80 (an edge touches) and +-200 (a hikkake
confirmed).  Rows before a rule's look-back, and rows with missing prices, are 0.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.exprs import Series

#: Fixed values: (quantity averaged, bars, factor) of each setting.
SETTINGS = {
    "long": ("body", 10, 1.0),
    "short": ("body", 10, 1.0),
    "doji": ("range", 10, 0.1),
    "svs": ("range", 10, 0.1),
    "ssh": ("shadows", 10, 0.5),
    "near": ("range", 5, 0.2),
    "far": ("range", 5, 0.6),
    "eq": ("range", 5, 0.05),
}
QUANTITIES = {"body": "abs(c - o)", "range": "h - l", "shadows": "(h - greatest(o, c)) + (least(o, c) - l)"}
BAR = {"o": "o", "h": "h", "l": "l", "c": "c", "body": "abs(c - o)", "top": "greatest(o, c)", "bot": "least(o, c)", "up": "h - greatest(o, c)", "dn": "least(o, c) - l", "col": "CASE WHEN c >= o THEN 1 ELSE -1 END"}
_NAME = re.compile(rf"\b({'|'.join([*BAR, *SETTINGS])})(\d)\b")
MAX_PENETRATION = 3e37


@dataclass(frozen=True)
class Rule:
    condition: str
    signal: str
    back: int  # bars before this one that it looks at
    lookback: int | None = None  # where it is not the longest mean plus ``back``
    penetration: float | None = None

    def text(self, penetration: float | None = None) -> tuple[str, str]:
        if penetration is not None:
            if self.penetration is None:
                raise TypeError("this pattern has no penetration")
            if not 0 <= penetration <= MAX_PENETRATION:
                raise ValueError(f"penetration must be in [0, {MAX_PENETRATION:g}]")
        value = self.penetration if penetration is None else penetration
        return self.condition.replace("PEN", repr(float(value or 0.0)) + "D"), self.signal

    @property
    def first(self) -> int:
        """Rows from the first complete one on that give 0."""
        if self.lookback is not None:
            return self.lookback
        return max((SETTINGS[n][1] for n, _ in _NAME.findall(self.condition) if n in SETTINGS), default=0) + self.back


def _all(*parts: str) -> str:
    return " AND ".join(f"({p})" for p in parts)


def _white(*bars: int) -> str:
    return " AND ".join(f"col{k} = 1" for k in bars)


def _black(*bars: int) -> str:
    return " AND ".join(f"col{k} = -1" for k in bars)


def _above(a: int, b: int) -> str:
    return f"bot{a} > top{b}"


def _below(a: int, b: int) -> str:
    return f"top{a} < bot{b}"


def _equal(x: str, y: str, k: int, name: str = "eq") -> str:
    return f"{x} BETWEEN {y} - {name}{k} AND {y} + {name}{k}"


def _bare(k: int) -> str:
    """Hardly any shadow."""
    return f"up{k} < svs{k} AND dn{k} < svs{k}"


def _falling(x: str, *bars: int) -> str:
    return " AND ".join(f"{x}{a} > {x}{b}" for a, b in zip(bars, bars[1:]))


def _sided(up: str, down: str, k: int) -> str:
    """``up`` if bar k rises, else ``down``."""
    return f"(col{k} = 1 AND {up}) OR (col{k} = -1 AND {down})"


_DOJI = "body0 <= doji0"
_LONG0 = "body0 > long0"
_NECK = _all("col1 = -1", "body1 > long1", "col0 = 1", "o0 < l1")
_HAMMER = _all("body0 < short0", "dn0 > body0", "up0 < svs0")
_STAR = _all("body0 < short0", "up0 > body0", "dn0 < svs0")
_KICK = _all("col1 = -col0", "body1 > long1", _bare(1), _LONG0, _bare(0), _sided("h0 < l1", "l0 > h1", 1))
_MORNING = _all("col2 = -1 AND col0 = 1", _below(1, 2), "c0 > c2 + body2 * PEN", "body2 > long2", "body0 > short0")
_EVENING = _all("col2 = 1 AND col0 = -1", _above(1, 2), "c0 < c2 - body2 * PEN", "body2 > long2", "body0 > short0")
_TOUCHING = "CASE WHEN top0 < top1 AND bot0 > bot1 THEN -col1 * 100 ELSE -col1 * 80 END"
_INSIDE = "top0 <= top1 AND bot0 >= bot1"

RULES: dict[str, Rule] = {
    # one bar
    "doji": Rule(_DOJI, "100", 0),
    "dragonfly_doji": Rule(_all(_DOJI, "up0 < svs0", "dn0 > svs0"), "100", 0),
    "gravestone_doji": Rule(_all(_DOJI, "dn0 < svs0", "up0 > svs0"), "100", 0),
    "long_legged_doji": Rule(_all(_DOJI, "greatest(up0, dn0) > body0"), "100", 0),
    "rickshaw_man": Rule(_all(_DOJI, "least(up0, dn0) > body0", "bot0 <= l0 + (h0 - l0) / 2 + near0", "top0 >= l0 + (h0 - l0) / 2 - near0"), "100", 0),
    "takuri": Rule(_all(_DOJI, "up0 < svs0", "dn0 > 2 * body0"), "100", 0),
    "marubozu": Rule(_all(_LONG0, _bare(0)), "col0 * 100", 0),
    "closing_marubozu": Rule(_all(_LONG0, _sided("up0 < svs0", "dn0 < svs0", 0)), "col0 * 100", 0),
    "belt_hold": Rule(_all(_LONG0, _sided("dn0 < svs0", "up0 < svs0", 0)), "col0 * 100", 0),
    "long_line": Rule(_all(_LONG0, "greatest(up0, dn0) < ssh0"), "col0 * 100", 0),
    "short_line": Rule(_all("body0 < short0", "greatest(up0, dn0) < ssh0"), "col0 * 100", 0),
    "spinning_top": Rule(_all("body0 < short0", "least(up0, dn0) > body0"), "col0 * 100", 0),
    "high_wave": Rule(_all("body0 < short0", "least(up0, dn0) > 2 * body0"), "col0 * 100", 0),
    # two bars
    "hammer": Rule(_all(_HAMMER, "bot0 <= l1 + near1"), "100", 1),
    "hanging_man": Rule(_all(_HAMMER, "bot0 >= h1 - near1"), "-100", 1),
    "inverted_hammer": Rule(_all(_STAR, _below(0, 1)), "100", 1),
    "shooting_star": Rule(_all(_STAR, _above(0, 1)), "-100", 1),
    "engulfing": Rule(
        _all("col0 = -col1", "top0 >= top1 AND bot0 <= bot1", "top0 > top1 OR bot0 < bot1"),
        "CASE WHEN top0 > top1 AND bot0 < bot1 THEN col0 * 100 ELSE col0 * 80 END", 1, lookback=2,
    ),
    "harami": Rule(_all("body1 > long1", "body0 <= short0", _INSIDE), _TOUCHING, 1),
    "harami_cross": Rule(_all("body1 > long1", "body0 <= doji0", _INSIDE), _TOUCHING, 1),
    "doji_star": Rule(_all("body1 > long1", _DOJI, _sided(_above(0, 1), _below(0, 1), 1)), "-col1 * 100", 1),
    "piercing": Rule(_all("col1 = -1", "body1 > long1", "col0 = 1", _LONG0, "o0 < l1", "c0 < o1", "c0 > c1 + body1 * 0.5D"), "100", 1),
    "dark_cloud_cover": Rule(_all("col1 = 1", "body1 > long1", "col0 = -1", "o0 > h1", "c0 > o1", "c0 < c1 - body1 * PEN"), "-100", 1, penetration=0.5),
    "counterattack": Rule(_all("col1 = -col0", "body1 > long1", _LONG0, _equal("c0", "c1", 1)), "col0 * 100", 1),
    "homing_pigeon": Rule(_all(_black(0, 1), "body1 > long1", "body0 <= short0", "o0 < o1 AND c0 > c1"), "100", 1),
    "matching_low": Rule(_all(_black(0, 1), _equal("c0", "c1", 1)), "100", 1),
    "separating_lines": Rule(_all("col1 = -col0", _equal("o0", "o1", 1), _LONG0, _sided("dn0 < svs0", "up0 < svs0", 0)), "col0 * 100", 1),
    "in_neck": Rule(_all(_NECK, "c0 BETWEEN c1 AND c1 + eq1"), "-100", 1),
    "on_neck": Rule(_all(_NECK, _equal("c0", "l1", 1)), "-100", 1),
    "thrusting": Rule(_all(_NECK, "c0 > c1 + eq1", "c0 <= c1 + body1 * 0.5D"), "-100", 1),
    "kicking": Rule(_KICK, "col0 * 100", 1),
    "kicking_by_length": Rule(_KICK, "CASE WHEN body0 > body1 THEN col0 * 100 ELSE col1 * 100 END", 1),
    # three bars
    "morning_star": Rule(_all(_MORNING, "body1 <= short1"), "100", 2, penetration=0.3),
    "morning_doji_star": Rule(_all(_MORNING, "body1 <= doji1"), "100", 2, penetration=0.3),
    "evening_star": Rule(_all(_EVENING, "body1 <= short1"), "-100", 2, penetration=0.3),
    "evening_doji_star": Rule(_all(_EVENING, "body1 <= doji1"), "-100", 2, penetration=0.3),
    "abandoned_baby": Rule(
        _all("body2 > long2", "body1 <= doji1", "body0 > short0", "col0 = -col2", _sided("c0 < c2 - body2 * PEN AND l1 > h2 AND h0 < l1", "c0 > c2 + body2 * PEN AND h1 < l2 AND l0 > h1", 2)),
        "col0 * 100", 2, penetration=0.3,
    ),
    "tristar": Rule(
        _all("greatest(body0, body1, body2) <= doji2", f"({_above(1, 2)} AND top0 < top1) OR ({_below(1, 2)} AND bot0 > bot1)"),
        f"CASE WHEN {_above(1, 2)} THEN -100 ELSE 100 END", 2,
    ),
    "three_inside": Rule(_all("body2 > long2", "body1 <= short1", "top1 < top2 AND bot1 > bot2", "col0 = -col2", _sided("c0 < o2", "c0 > o2", 2)), "-col2 * 100", 2),
    "three_outside": Rule(_all("col2 = -col1", "top1 > top2 AND bot1 < bot2", _sided("c0 > c1", "c0 < c1", 1)), "col1 * 100", 2, lookback=3),
    "three_white_soldiers": Rule(
        _all(_white(0, 1, 2), "up0 < svs0 AND up1 < svs1 AND up2 < svs2", _falling("c", 0, 1, 2), _falling("o", 0, 1, 2), "o1 <= c2 + near2", "o0 <= c1 + near1", "body1 > body2 - far2", "body0 > body1 - far1", "body0 > short0"),
        "100", 2,
    ),
    "three_black_crows": Rule(_all(_white(3), _black(0, 1, 2), "o1 < o2 AND o1 > c2", "o0 < o1 AND o0 > c1", "h3 > c2", _falling("c", 2, 1, 0), "dn0 < svs0 AND dn1 < svs1 AND dn2 < svs2"), "-100", 3),
    "identical_three_crows": Rule(_all(_black(0, 1, 2), "dn0 < svs0 AND dn1 < svs1 AND dn2 < svs2", _falling("c", 2, 1, 0), _equal("o1", "c2", 2), _equal("o0", "c1", 1)), "-100", 2),
    "two_crows": Rule(_all(_white(2), "body2 > long2", _black(0, 1), _above(1, 2), "o0 < o1 AND o0 > c1", "c0 > o2 AND c0 < c2"), "-100", 2),
    "upside_gap_two_crows": Rule(_all(_white(2), "body2 > long2", _black(0, 1), "body1 <= short1", _above(1, 2), "o0 > o1 AND c0 < c1", "c0 > c2"), "-100", 2),
    "three_stars_in_south": Rule(
        _all(_black(0, 1, 2), "body2 > long2", "dn2 > body2", "body1 < body2", "o1 > c2 AND o1 <= h2", "l1 < c2 AND l1 >= l2", "dn1 > svs1", "body0 < short0", _bare(0), "l0 > l1 AND h0 < h1"),
        "100", 2,
    ),
    "advance_block": Rule(
        _all(
            _white(0, 1, 2), _falling("c", 0, 1, 2), _falling("o", 0, 1, 2), "o1 <= c2 + near2", "o0 <= c1 + near1", "body2 > long2", "up2 < ssh2",
            "(body1 < body2 - far2 AND body0 < body1 + near1) OR body0 < body1 - far1 OR (body0 < body1 AND (up0 > body0 OR (body1 < body2 AND (up0 > ssh0 OR up1 > ssh1))))",
        ),
        "-100", 2,
    ),
    "stalled_pattern": Rule(_all(_white(0, 1, 2), _falling("c", 0, 1, 2), "body2 > long2", "body1 > long1", "up1 < svs1", "o1 > o2 AND o1 <= c2 + near2", "body0 < short0", "o0 >= c1 - body0 - near1"), "-100", 2),
    "stick_sandwich": Rule(_all(_black(0, 2), _white(1), "l1 > c2", _equal("c0", "c2", 2)), "100", 2),
    "unique_three_river": Rule(_all(_black(1, 2), _white(0), "c1 > c2 AND o1 <= o2", "l1 < l2", "o0 > l1", "body2 > long2", "body0 < short0"), "100", 2),
    "tasuki_gap": Rule(
        _all("col0 = -col1", "abs(body1 - body0) < near1", "o0 > bot1 AND o0 < top1", _sided(f"{_above(1, 2)} AND c0 < o1 AND c0 > top2", f"{_below(1, 2)} AND c0 > o1 AND c0 < bot2", 1)),
        "col1 * 100", 2,
    ),
    "gap_side_side_white": Rule(
        _all(_white(0, 1), f"({_above(1, 2)} AND {_above(0, 2)}) OR ({_below(1, 2)} AND {_below(0, 2)})", _equal("body0", "body1", 1, "near"), _equal("o0", "o1", 1)),
        f"CASE WHEN {_above(1, 2)} THEN 100 ELSE -100 END", 2,
    ),
    "xside_gap_three_methods": Rule(_all("col2 = col1 AND col1 = -col0", "o0 > bot1 AND o0 < top1", "c0 > bot2 AND c0 < top2", _sided(_above(1, 2), _below(1, 2), 2)), "col2 * 100", 2, lookback=2),
    # four and five bars
    "three_line_strike": Rule(
        _all("col3 = col2 AND col2 = col1 AND col0 = -col1", "o2 BETWEEN bot3 - near3 AND top3 + near3", "o1 BETWEEN bot2 - near2 AND top2 + near2", _sided("c1 > c2 AND c2 > c3 AND o0 > c1 AND c0 < o3", "c1 < c2 AND c2 < c3 AND o0 < c1 AND c0 > o3", 1)),
        "col1 * 100", 3,
    ),
    "concealing_baby_swallow": Rule(_all(_black(0, 1, 2, 3), _bare(3), _bare(2), _below(1, 2), "up1 > svs1", "h1 > c2", "h0 > h1 AND l0 < l1"), "100", 3),
    "ladder_bottom": Rule(_all(_black(1, 2, 3, 4), _falling("o", 4, 3, 2), _falling("c", 4, 3, 2), "up1 > svs1", _white(0), "o0 > o1", "c0 > h1"), "100", 4),
    "breakaway": Rule(
        _all(
            "col4 = col3 AND col3 = col1 AND col1 = -col0", "body4 > long4",
            _sided(f"{_above(3, 4)} AND {_falling('h', 1, 2, 3)} AND {_falling('l', 1, 2, 3)} AND c0 < o3 AND c0 > c4", f"{_below(3, 4)} AND {_falling('h', 3, 2, 1)} AND {_falling('l', 3, 2, 1)} AND c0 > o3 AND c0 < c4", 4),
        ),
        "col0 * 100", 4,
    ),
    "rise_fall_three_methods": Rule(
        _all(
            "col4 = col0 AND col3 = -col4 AND col2 = -col4 AND col1 = -col4", "greatest(bot1, bot2, bot3) < h4", "least(top1, top2, top3) > l4",
            "c2 * col4 < c3 * col4", "c1 * col4 < c2 * col4", "o0 * col4 > c1 * col4", "c0 * col4 > c4 * col4", "body4 > long4", "body3 < short3 AND body2 < short2 AND body1 < short1", _LONG0,
        ),
        "col4 * 100", 4,
    ),
    "mat_hold": Rule(
        _all(
            _white(0, 4), _black(3), _above(3, 4), "greatest(bot1, bot2) < c4", "least(bot1, bot2) > c4 - body4 * PEN", "top2 < o3", "top1 < top2", "o0 > c1", "c0 > greatest(h1, h2, h3)",
            "body4 > long4", "body3 < short3 AND body2 < short2 AND body1 < short1",
        ),
        "100", 4, penetration=0.5,
    ),
}


@dataclass(frozen=True)
class Breakout:
    """A setup bar that a later close within three bars may confirm."""

    setup: str
    lookback: int


_BREAK = "((h0 < h1 AND l0 < l1{down}) OR (h0 > h1 AND l0 > l1{up}))"
BREAKOUTS = {
    "hikkake": Breakout(_all("h1 < h2 AND l1 > l2", _BREAK.format(down="", up="")), 5),
    "hikkake_modified": Breakout(_all("h2 < h3 AND l2 > l3", "h1 < h2 AND l1 > l2", _BREAK.format(down=" AND c2 <= l2 + near2", up=" AND c2 >= h2 - near2")), 10),
}
NAMES = sorted([*RULES, *BREAKOUTS])


def names_in(*texts: str) -> list[tuple[str, int]]:
    return sorted({(n, int(k)) for t in texts for n, k in _NAME.findall(t)})


def _columns(s: Series, names: Sequence[tuple[str, int]]) -> None:
    """Adds the named columns: bars back by lags, means by frames, all over one window."""
    for role, short in (("open", "o"), ("high", "h"), ("low", "l"), ("close", "c")):
        s.df = s.df.withColumn(short, F.col(f"_{role}"))
    s.df = s.df.withColumns({f"q_{q}": F.expr(e) for q, e in QUANTITIES.items()} | {f"b_{b}": F.expr(e) for b, e in BAR.items()})
    w, added = s.window, {}
    for name, k in names:
        if name in BAR:
            added[f"{name}{k}"] = F.lag(f"b_{name}", k).over(w) if k else F.col(f"b_{name}")
        else:
            quantity, period, factor = SETTINGS[name]
            frame = w.rowsBetween(-period - k, -1 - k)
            added[f"{name}{k}"] = F.when(F.count(f"q_{quantity}").over(frame) == period, F.avg(f"q_{quantity}").over(frame) * factor)
    s.df = s.df.withColumns(added)


def _age(s: Series) -> Column:
    """Rows since the first complete one."""
    complete = F.col("o").isNotNull() & F.col("h").isNotNull() & F.col("l").isNotNull() & F.col("c").isNotNull()
    return s.row() - F.min(F.when(complete, s.row())).over(s.window.rowsBetween(Window.unboundedPreceding, 0))


def _breakout(s: Series, name: str, rule: Breakout) -> Column:
    setup = s.let(F.coalesce(F.expr(rule.setup), F.lit(False)) & (F.col("_age") >= rule.lookback - 3))
    value = s.let(F.when(setup, F.when(F.col("h0") < F.col("h1"), F.struct(s.row().alias("at"), F.lit(100).alias("side"), F.col("h1").alias("edge"))).otherwise(F.struct(s.row().alias("at"), F.lit(-100).alias("side"), F.col("l1").alias("edge")))))
    last = s.let(F.last(value, ignorenulls=True).over(s.window.rowsBetween(Window.unboundedPreceding, -1)))
    past = F.when(last["side"] > 0, F.col("c0") > last["edge"]).otherwise(F.col("c0") < last["edge"])
    hit = s.let(F.coalesce(~setup & (s.row() - last["at"] <= 3) & past, F.lit(False)))
    # only the first close past the edge confirms: none of the bars since the setup was one
    before = [F.coalesce((s.row() - last["at"] > k) & F.lag(hit, k).over(s.window), F.lit(False)) for k in (1, 2)]
    confirmed = s.let(hit & ~before[0] & ~before[1])
    return F.when(setup, value["side"]).when(confirmed, last["side"] * 2).otherwise(F.lit(0))


def candle_patterns(bars: DataFrame, patterns: Sequence[str] = tuple(NAMES), *, penetration: float | None = None, keys: Sequence[str] = ("symbol",), order: Sequence[str] = ("ts",), columns: dict[str, str] | None = None) -> DataFrame:
    """Keys, order columns and an integer column per pattern.  One exchange and one sort, however many patterns."""
    if unknown := sorted(set(patterns) - set(NAMES)):
        raise ValueError(f"unknown patterns: {', '.join(unknown)}")
    texts = {p: RULES[p].text(penetration) for p in patterns if p in RULES}
    for p in patterns:
        if p in BREAKOUTS and penetration is not None:
            raise TypeError("this pattern has no penetration")
    s = Series(bars.select(*keys, *order, *[c for c in dict.fromkeys((columns or {}).get(r, r) for r in ("open", "high", "low", "close"))]), keys, order, columns)
    needed = names_in(*[x for t in texts.values() for x in t], *[BREAKOUTS[p].setup for p in patterns if p in BREAKOUTS])
    _columns(s, needed + [n for n in (("c", 0), ("h", 0), ("h", 1), ("l", 1)) if n not in needed])
    age = _age(s)
    s.df = s.df.withColumn("_age", age)
    made = {}
    for p in patterns:
        if p in texts:
            condition, signal = texts[p]
            made[p] = F.when((F.col("_age") >= RULES[p].first) & F.expr(condition), F.expr(signal)).otherwise(F.lit(0)).cast("int")
        else:
            made[p] = F.when(F.col("_age") >= BREAKOUTS[p].lookback, _breakout(s, p, BREAKOUTS[p])).otherwise(F.lit(0)).cast("int")
    return s.df.select(*keys, *order, *[value.alias(p) for p, value in made.items()])


def candle_pattern(bars: DataFrame, pattern: str, **options) -> DataFrame:
    """One pattern; its column is ``signal``."""
    return candle_patterns(bars, [pattern], **options).withColumnRenamed(pattern, "signal")


def candle_hits(bars: DataFrame, patterns: Sequence[str] = tuple(NAMES), *, keys: Sequence[str] = ("symbol",), order: Sequence[str] = ("ts",), **options) -> DataFrame:
    """(keys, order, pattern, signal) of every signal other than 0."""
    wide = candle_patterns(bars, patterns, keys=keys, order=order, **options)
    return wide.unpivot([*keys, *order], list(patterns), "pattern", "signal").where("signal <> 0")
