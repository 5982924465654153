"""All registered queries of the library."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tickloom.operators import indicators
from tickloom.sources import bars

from . import candle_queries, indicator_queries, portfolio_queries
from .indicator_queries import rounded
from .sqlgen import mean, roll


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(indicators.compute(bars.bars_daily(spark, sf_dir), "sma", "bollinger", "rsi"))


QUERIES = {"flagship": flagship} | indicator_queries.QUERIES | candle_queries.QUERIES | portfolio_queries.QUERIES
_BANDS = indicator_queries.Query(bars.DAILY_SQL).rsi("y", "c", 14).let(m=mean("c", 20), s=roll("stddev_pop", "c", 20))
SQL = {"flagship": _BANDS.done(sma="m", bollinger_upper="m + 2 * s", bollinger_middle="m", bollinger_lower="m - 2 * s", rsi="y")} | indicator_queries.SQL | candle_queries.SQL | portfolio_queries.SQL
