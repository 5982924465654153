"""``cdl_<pattern>`` on daily bars, and ``cdl_all_long`` with every hit of every pattern."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tickloom.operators import candles
from tickloom.sources import bars

OVER = "PARTITION BY symbol ORDER BY ts"


def _query(pattern: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: candles.candle_pattern(bars.bars_daily(spark, sf_dir), pattern)


def all_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candles.candle_hits(bars.bars_daily(spark, sf_dir))


def _sql(patterns: list[str]) -> str:
    """The bars' columns, then a column for each pattern, in DuckDB."""
    rules = {p: candles.RULES[p].text() for p in patterns if p in candles.RULES}
    texts = [x for r in rules.values() for x in r] + [candles.BREAKOUTS[p].setup for p in patterns if p in candles.BREAKOUTS]
    columns = []
    for name, k in sorted({*candles.names_in(*texts), ("c", 0), ("h", 0), ("h", 1), ("l", 1)}):
        if name in candles.BAR:
            columns.append(f"lag({candles.BAR[name]}, {k}) OVER ({OVER}) AS {name}{k}")
        else:
            quantity, period, factor = candles.SETTINGS[name]
            w = f"OVER ({OVER} ROWS BETWEEN {period + k} PRECEDING AND {1 + k} PRECEDING)"
            columns.append(f"CASE WHEN count({candles.QUANTITIES[quantity]}) {w} = {period} THEN avg({candles.QUANTITIES[quantity]}) {w} * {factor} END AS {name}{k}")
    plain = [f"CASE WHEN i >= {candles.RULES[p].first} AND ({re.sub(r'([0-9])D', r'\1', c)}) THEN {v} ELSE 0 END::INT AS {p}" for p, (c, v) in rules.items()]
    parts = [
        f"b AS (SELECT symbol, ts, open AS o, high AS h, low AS l, close AS c FROM ({bars.DAILY_SQL}))",
        f"n AS MATERIALIZED (SELECT symbol, ts, row_number() OVER ({OVER}) - 1 AS i, {', '.join(columns)} FROM b)",
    ]
    joins, more = "", []
    for p in (p for p in patterns if p in candles.BREAKOUTS):
        rule = candles.BREAKOUTS[p]
        # walked row by row: bars left in which a close may confirm, the side and the edge of the last setup
        hit = f"coalesce({rule.setup}, false) AND t.i >= {rule.lookback - 3}"
        parts.append(
            f"w_{p}(symbol, i, out, open_for, side, edge) AS (SELECT symbol, 0::BIGINT, 0, 0, 0, 0.0::DOUBLE FROM n WHERE i = 0 UNION ALL "
            f"SELECT t.symbol, t.i, CASE WHEN {hit} THEN CASE WHEN h0 < h1 THEN 100 ELSE -100 END WHEN open_for > 0 AND ((side > 0 AND c0 > edge) OR (side < 0 AND c0 < edge)) THEN side * 2 ELSE 0 END, "
            f"CASE WHEN {hit} THEN 3 WHEN open_for > 0 AND ((side > 0 AND c0 > edge) OR (side < 0 AND c0 < edge)) THEN 0 ELSE greatest(open_for - 1, 0) END, "
            f"CASE WHEN {hit} THEN CASE WHEN h0 < h1 THEN 100 ELSE -100 END ELSE side END, CASE WHEN {hit} THEN CASE WHEN h0 < h1 THEN h1 ELSE l1 END ELSE edge END "
            f"FROM w_{p} r JOIN n t ON t.symbol = r.symbol AND t.i = r.i + 1)"
        )
        joins += f" JOIN w_{p} ON w_{p}.symbol = n.symbol AND w_{p}.i = n.i"
        more.append(f"CASE WHEN n.i >= {rule.lookback} THEN w_{p}.out ELSE 0 END::INT AS {p}")
    return f"WITH RECURSIVE {', '.join(parts)}, wide AS (SELECT n.symbol, n.ts, {', '.join([*[x.replace('WHEN i >=', 'WHEN n.i >=') for x in plain], *more])} FROM n{joins})"


def _one(pattern: str) -> str:
    return f"{_sql([pattern])} SELECT symbol, ts, {pattern} AS signal FROM wide"


QUERIES = {f"cdl_{p}": _query(p) for p in candles.NAMES} | {"cdl_all_long": all_long}
SQL = {f"cdl_{p}": _one(p) for p in candles.NAMES} | {
    "cdl_all_long": f"{_sql(candles.NAMES)} SELECT * FROM (UNPIVOT wide ON {', '.join(candles.NAMES)} INTO NAME pattern VALUE signal) WHERE signal <> 0"
}
